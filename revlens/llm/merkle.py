"""Merkle manifest of a data set: a SHA-256 tree whose parents keep states.

A leaf is the hash of a row's fields.  The leaves of a group (a language) are
ordered by id; every run of eight neighbours becomes their hash, level by
level, until one node, the group's subroot, is left.  The subroots, ordered by
group, become the root in the same way.

A parent retains a copy of the SHA-256 state before each of its children's
slots.  Folding a changed child resumes the state of its slot, takes the
replacement and the siblings to the right, and is done: the siblings to the
left are never hashed again.

Work is split by position: two levels at a time, 64 neighbouring nodes form a
chunk, whatever the size of their group, so no task ever sees a group.
States cannot leave a process, so a chunk carries the runs of its ancestors
(at most eight digests a level), and its task makes their parents once for
its 64 leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import arrow_map, checkpointed
from revlens.operators.ordered import sorted_ranges

FAN = 8
LEVELS = 2                     # that a chunk folds at once
CHUNK = FAN ** LEVELS
HEX = 64                       # characters of a digest
PATH = "array<struct<slot: int, run: string>>"
PROOF = "array<struct<slot: int, siblings: string>>"


def record_hash(fields: Sequence[Column]) -> Column:
    """Hash of the fields in order: ``-`` for a null one, else its UTF-8 length
    in bytes, a colon, and its text."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[
        F.when(t.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def leaves(docs: DataFrame, fields: Sequence[str], id_col: str = "doc_id",
           group_col: str = "lang", changed: Mapping[str, Column] | None = None,
           where: Column | None = None) -> DataFrame:
    """``id``, ``key`` (the group, null before any other), ``leaf`` and
    ``changed``: the leaf of the row with the fields in ``changed`` replaced
    where ``where`` holds, else null.  The text is hashed in the scan and does
    not travel."""
    found = F.lit(None).cast("string")
    if changed:
        found = record_hash([changed.get(c, F.col(f"`{c}`")) for c in fields])
        if where is not None:
            found = F.when(where, found)
    group = F.col(f"`{group_col}`").cast("string")
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("key"),
        record_hash([F.col(f"`{c}`") for c in fields]).alias("leaf"), found.alias("changed"))


class Parent:
    """The children of a node, and the hash state before each of their slots."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: Sequence[bytes]):
        state = hashlib.sha256()
        self.children, self.states = children, []
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in the slot."""
        state = self.states[slot].copy()
        state.update(child)
        for right in self.children[slot + 1:]:
            state.update(right)
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> str:
        return b"".join([*self.children[:slot], *self.children[slot + 1:]]).decode()


def _levels(n: int) -> int:
    """Levels that a chunk of a group of n nodes goes up."""
    count = 0
    while n > 1 and count < LEVELS:
        n, count = -(-n // FAN), count + 1
    return count


def _parents(nodes: Sequence[bytes], levels: int) -> list[list[Parent]]:
    tree = []
    for _ in range(levels):
        tree.append([Parent(nodes[i:i + FAN]) for i in range(0, len(nodes), FAN)])
        nodes = [p.digest for p in tree[-1]]
    return tree


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    for batch in batches:
        for first in range(0, batch.num_rows, CHUNK):
            yield batch.slice(first, CHUNK).to_pylist()


def _up(batches):
    """Each chunk's only node after its levels."""
    for rows in _rows(batches):
        digests = []
        for row in rows:
            nodes = [d.encode() for d in row["digests"]]
            tree = _parents(nodes, _levels(row["n"]))
            digests.append((tree[-1][0].digest if tree else nodes[0]).decode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["key"] for r in rows], pa.string()),
             pa.array([r["chunk"] for r in rows], pa.int64()),
             pa.array([-(-r["n"] // CHUNK) for r in rows], pa.int64()),
             pa.array(digests, pa.string())], names=["key", "pos", "n", "leaf"])


def _down(batches):
    """The path of each node of a chunk: its runs in the chunk, then the chunk's."""
    for rows in _rows(batches):
        out = {"key": [], "pos": [], "id": [], "leaf": [], "path": [], "top": []}
        for row in rows:
            nodes = [d["leaf"].encode() for d in row["members"]]
            tree = _parents(nodes, _levels(row["n"]))
            for i, member in enumerate(row["members"]):
                path, at = [], i
                for level in tree:
                    at, slot = divmod(at, FAN)
                    path.append({"slot": slot, "run": b"".join(level[at].children).decode()})
                out["key"].append(row["key"])
                out["pos"].append(member["pos"])
                out["id"].append(member["id"])
                out["leaf"].append(member["leaf"])
                out["path"].append(path + row["path"])
                out["top"].append(row["top"])
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.string())]))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), kind, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)],
                                         names=list(out))


def _folded(batches):
    """For each leaf: its proof, and the root that its replacement, else the
    leaf itself, folds to."""
    for rows in _rows(batches):
        places, leaf, subroot, root, folded = [], [], [], [], []
        slots, siblings, ends = [], [], [0]
        for row in rows:
            members = row["members"]
            nodes = [m["leaf"].encode() for m in members]
            tree = _parents(nodes, _levels(row["n"]))
            above = [(p["slot"], Parent([p["run"][i:i + HEX].encode()
                                         for i in range(0, len(p["run"]), HEX)]))
                     for p in row["path"]]
            outer = [(slot, parent.siblings(slot)) for slot, parent in above]
            if above:
                whole = above[-1][1].digest
            else:
                whole = tree[-1][0].digest if tree else nodes[0]
            for i, member in enumerate(members):
                node = (member["changed"] or member["leaf"]).encode()
                at = i
                for level in tree:
                    at, slot = divmod(at, FAN)
                    slots.append(slot)
                    siblings.append(level[at].siblings(slot))
                    node = level[at].fold(slot, node)
                for slot, parent in above:
                    node = parent.fold(slot, node)
                for slot, text in outer:
                    slots.append(slot)
                    siblings.append(text)
                ends.append(len(slots))
                places.append(member["pos"])
                leaf.append(member["leaf"])
                subroot.append(row["top"])
                root.append(whole.decode())
                folded.append(node.decode())
        proofs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(slots, pa.int32()), pa.array(siblings, pa.string())], ["slot", "siblings"]))
        keys = [row["key"] for row in rows for _ in row["members"]]
        ids = pa.array([m["id"] for row in rows for m in row["members"]], pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(places, pa.int64()), ids,
             *[pa.array(c, pa.string()) for c in (leaf, subroot, root, folded)], proofs],
            names=["key", "pos", "id", "leaf", "subroot", "root", "folded_root", "proof"])


def _placed(nodes: DataFrame, order: Sequence) -> DataFrame:
    """``nodes`` (with ``key``) and each one's place ``pos`` in its key's
    order, from 0, and ``n``, the number of nodes of the key.

    The nodes are sorted over all keys in ranges; a range tells how many nodes
    of a key it holds, and the counts of the ranges before it add up."""
    ranges = sorted_ranges(nodes.withColumn("_tie", F.monotonically_increasing_id()),
                           ["key", *order, "_tie"]).drop("_tie")
    held = ranges.groupBy("_rid", "key").agg(F.count(F.lit(1)).alias("_c"),
                                             F.min("_pos").alias("_first"))
    before = Window.partitionBy("key").orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("_rid", "key", "_first",
                         F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
                         F.sum("_c").over(Window.partitionBy("key")).alias("n"))
    return (ranges.join(starts, ["_rid", "key"])
            .withColumn("pos", F.col("_pos") - F.col("_first") + F.col("_before"))
            .drop("_rid", "_pos", "_first", "_before"))


def _chunks(placed: DataFrame) -> DataFrame:
    """One row per chunk with its nodes in order: 64 at most."""
    member = F.struct("pos", "id", "leaf", "changed")
    return checkpointed(
        placed.groupBy("key", F.floor(F.col("pos") / CHUNK).cast("long").alias("chunk"))
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members")))


def _tree(placed: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The chunks of each round, leaves first, and one node per key."""
    rounds: list[DataFrame] = []
    while True:
        chunks = _chunks(placed)
        rounds.append(chunks)
        largest = chunks.agg(F.max("n")).first()[0]
        nodes = arrow_map(chunks.select("key", "chunk", "n",
                                        F.transform("members", lambda m: m["leaf"]).alias("digests")),
                          _up, "key string, pos long, n long, leaf string")
        if largest is None or largest <= CHUNK:
            return rounds, nodes
        placed = nodes.withColumns({"id": F.lit(None).cast("string"),
                                    "changed": F.lit(None).cast("string")})


def _with_path(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Each chunk with the path of the node that it becomes."""
    node = paths.select("key", F.col("pos").alias("chunk"), "path", "top")
    return chunks.join(node, ["key", "chunk"])


NODE = f"key string, pos long, id string, leaf string, path {PATH}, top string"


def manifest(rows: DataFrame) -> DataFrame:
    """The manifest of ``leaves(...)``: one row per leaf with ``id``, ``key``,
    ``pos``, ``leaf``, ``subroot``, ``root``, ``proof`` (per level the leaf's
    slot and the digests of its siblings, leaf level first) and
    ``folded_root``: what the root becomes with ``changed`` in the place of
    the leaf.

    Leaves of a key are ordered by id, null first, then by digest; rows that
    repeat an id with other contents each have a place of their own, and equal
    rows have neighbouring ones.  An empty table gives an empty result.  A
    single leaf is its own subroot and root and has an empty proof."""
    id_type = rows.schema["id"].dataType
    narrow = checkpointed(rows.select("id", "key", "leaf", "changed"))
    placed = _placed(narrow, [F.col("id").asc_nulls_first(), "leaf"])
    placed = placed.withColumn("id", F.col("id").cast("string"))
    rounds, tops = _tree(placed)

    groups = tops.select(F.lit("").alias("key"), F.col("key").alias("id"), "leaf",
                         F.lit(None).cast("string").alias("changed"))
    upper, _ = _tree(_placed(checkpointed(groups), ["id"]))
    nothing = F.array().cast(PATH)
    paths = upper[-1].select("key", F.col("chunk").alias("pos"), nothing.alias("path"),
                             F.lit(None).cast("string").alias("top"))
    for chunks in reversed(upper):
        paths = arrow_map(_with_path(chunks, paths), _down, NODE)
    # the nodes of the upper tree are the subroots
    paths = paths.select(F.col("id").alias("key"), F.lit(0).cast("long").alias("pos"), "path",
                         F.col("leaf").alias("top"))
    for chunks in reversed(rounds[1:]):
        paths = arrow_map(_with_path(chunks, paths), _down, NODE)
    out = arrow_map(_with_path(rounds[0], paths), _folded,
                    "key string, pos long, id string, leaf string, subroot string, root string, "
                    f"folded_root string, proof {PROOF}")
    return out.withColumn("id", F.col("id").cast(id_type))


def siblings_of(proof: Column) -> Column:
    """All digests of a proof in order, as one text."""
    return F.array_join(F.transform(proof, lambda p: p["siblings"]), "")


def proven_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give (no tree needed)."""
    def step(node, p):
        left = p["slot"] * HEX
        return F.sha2(F.concat(F.substr(p["siblings"], F.lit(1), left), node,
                               F.substr(p["siblings"], left + 1)), 256)
    return F.aggregate(proof, leaf, step)
