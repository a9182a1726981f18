"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Each text becomes its set of word shingles, and the set a MinHash
   signature of ``BANDS * ROWS`` values.  Texts with one set form a class;
   only classes go on, so copies cost one row each from here.
2. Banding: classes that agree in a whole band meet in a bucket.  A pair with
   similarity 0.75 misses all 48 bands with a probability of 2e-6.
3. Sequential verification: the signatures of a candidate pair are compared a
   batch of hashes at a time.  After each batch the posterior of the
   similarity (uniform prior, so Beta) is bounded: a pair whose probability to
   reach the threshold is below ``MISS`` is dropped.  The fewest matches that
   go on are a table of a few numbers.
4. Survivors are verified exactly, on their full shingle sets.

Only connectivity is asked for, so pairs inside a bucket are not all formed.

* First every member of a bucket is paired with the bucket's first member, and
  the links that hold are joined into components.
* Buckets that still hold several components go on.  A member can only link to
  another component when three quarters of its shingles occur in other
  components; the shingles are counted, and members that fail this exact bound
  are done.  In a large family of near copies these are the copies with many
  edits of their own.
* Those left are compared in their buckets, exactly, on the shingles that other
  components have.  A bucket is cut into blocks of ``BLOCK`` members, a task
  takes two blocks, and gives back only links that join components which
  nothing before in the two blocks has joined: fewer links than members.

So every link inside a bucket is found, runs inside one component, or is ruled
out by the bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import arrow_map, checkpointed, checkpointed_count, spread_lookup
from revlens.llm.components import component_roots
from revlens.llm.words import document_chunks, mix, shingle_sets

SHINGLE = 5
SIMILARITY = 75      # per cent
BANDS, ROWS = 48, 5
BATCH = 48           # hashes compared between two looks at the posterior
MISS = 1e-6
BLOCK = 512          # members of a bucket that a task compares with as many

_ROW_BLOCK = 512


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
    flips = (seeds[::2] >> np.uint64(32)).astype(np.uint32)
    factors = (seeds[1::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return flips, factors


def signature(shingle_set: np.ndarray) -> bytes:
    """BANDS * ROWS MinHash values, a byte of each.

    Different values share a byte in one of 256 cases.  That adds candidates
    (a band of unequal values agrees in one of 2 ** 40) and matches, so it can
    keep a pair that would be dropped, and never drops one."""
    flips, factors = _permutations_once()
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(flips), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), _ROW_BLOCK):
        block = x[i:i + _ROW_BLOCK, None] ^ flips
        block *= factors
        np.minimum(least, block.min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


_cached: list = []


def _permutations_once() -> tuple[np.ndarray, np.ndarray]:
    if not _cached:
        _cached.extend(_permutations())
    return _cached[0], _cached[1]


def set_key(shingle_set: np.ndarray) -> bytes:
    """128 bits that name a set: two independent sums over its elements."""
    a = mix(shingle_set + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix(shingle_set ^ np.uint64(0x14057B7EF767814F)), initial=np.uint64(0))
    return a.tobytes() + b.tobytes()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, sigs = [], [], []
        for _, texts in document_chunks(batch, "text"):
            for s in shingle_sets(texts, SHINGLE):
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("th"), pa.array(sizes, pa.int64()),
             pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
            names=["id", "th", "n", "key", "sig"])


def required_matches(compared: int, similarity: float = SIMILARITY / 100,
                     miss: float = MISS) -> int:
    """The fewest matches among ``compared`` hashes with which the posterior
    probability of at least ``similarity`` is not below ``miss``.

    With a uniform prior the posterior is Beta(m + 1, compared - m + 1); its
    mass above s is the chance of at most m successes in compared + 1 trials
    of probability s."""
    total, n = 0.0, compared + 1
    for m in range(compared + 1):
        total += math.comb(n, m) * similarity ** m * (1 - similarity) ** (n - m)
        if total >= miss:
            return m
    return compared + 1


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    looks = [(c, required_matches(c)) for c in range(BATCH, BANDS * ROWS + 1, BATCH)]
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8)
                       .reshape(batch.num_rows, BANDS * ROWS) for c in ("sig_a", "sig_b"))
        alive = np.arange(batch.num_rows)
        matches = np.zeros(batch.num_rows, dtype=np.int32)
        for compared, needed in looks:
            part = slice(compared - BATCH, compared)
            matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1, dtype=np.int32)
            alive = alive[matches[alive] >= needed]
        yield batch.take(pa.array(alive)).select(["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        holds = []
        for i in range(batch.num_rows):
            x, y = shingle_sets([batch.column("text_a")[i].as_py().encode(),
                                 batch.column("text_b")[i].as_py().encode()], SHINGLE)
            both = len(np.intersect1d(x, y, assume_unique=True))
            holds.append(100 * both >= SIMILARITY * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(holds, pa.bool_()))


def _sizes_allow(n: Column, m: Column) -> Column:
    """No link when the smaller set is under the threshold of the larger."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * SIMILARITY


def _texts(vids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``vid`` and ``text`` of the classes named."""
    wanted = vids.distinct().join(classes.select("vid", "id", "th"), "vid")
    keys = wanted.select(F.col("id").alias("wid"), F.col("th").alias("wth"))
    texts = docs.join(keys, F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth")),
                      "left_semi") \
        .groupBy(F.col("id").alias("tid"), F.col("th").alias("tth")) \
        .agg(F.first("text").alias("text"))
    return checkpointed(
        wanted.join(texts, F.col("id").eqNullSafe(F.col("tid")) & (F.col("th") == F.col("tth")))
        .select("vid", "text"))


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are similar: pruned, then verified."""
    def side(table: DataFrame, name: str) -> DataFrame:
        return table.select(F.col("vid").alias(name), *[
            F.col(c).alias(f"{c}_{name}") for c in table.columns if c != "vid"])

    signed = classes.select("vid", "n", "sig")
    sized = pairs.join(side(signed, "a"), "a").join(side(signed, "b"), "b") \
        .filter(_sizes_allow(F.col("n_a"), F.col("n_b")))
    likely = checkpointed(arrow_map(sized.select("a", "b", "sig_a", "sig_b"), _prune,
                                    "a long, b long"))
    texts = _texts(likely.select(F.col("a").alias("vid")).union(likely.select("b")), classes, docs)
    both = likely.join(side(texts, "a"), "a").join(side(texts, "b"), "b")
    return checkpointed(arrow_map(both.select("a", "b", "text_a", "text_b"), _verify,
                                  "a long, b long"))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in document_chunks(batch, "text"):
            sets = list(shingle_sets(texts, SHINGLE))
            vids = batch.column("vid").slice(first, len(sets)).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(vids, [len(s) for s in sets])),
                 pa.array(np.concatenate(sets).view(np.int64))], names=["vid", "shingle"])


def _still_open(members: DataFrame) -> DataFrame:
    """Members (bucket, vid, n, root) of buckets with several roots."""
    open_buckets = members.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return members.join(open_buckets.select("bucket"), "bucket", "left_semi")


def _may_link(members: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members that can have a link to another root, and once for each vid
    ``others``, those of its shingles that other roots have.  ``held``: vid,
    shingle."""
    names = members.select("vid", "n", "root").distinct()
    placed = held.join(names.select("vid", "root"), "vid")
    foreign = placed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")) \
        .filter("low <> high").select("shingle")
    shared = placed.join(foreign, "shingle").groupBy("vid").agg(
        F.collect_list("shingle").alias("others"))
    able = names.join(shared, "vid").filter(F.size("others") * 100 >= F.col("n") * SIMILARITY)
    able = checkpointed(able.select("vid", "others"))
    return checkpointed(_still_open(members.join(able.select("vid"), "vid"))), able


def _cells(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members in the cells of their buckets: a bucket of one block is one
    cell, one of more blocks has a cell for each two."""
    blocks = members.groupBy("bucket").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")
    return members.join(blocks, "bucket").withColumn("own", own).select(
        "bucket", "vid", "n", "root", "own",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")) \
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                "vid", "n", "root")


def joining_links(vids: list[int], sizes: np.ndarray, roots: list[int],
                  sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between different roots, only as many as join them all: a link
    is left out when the ones before it connect its ends' roots."""
    k = len(vids)
    values, columns, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(k), [len(s) for s in sets])
    often = seen > 1
    place = np.cumsum(often) - 1
    inside = often[columns]
    rows, columns = rows[inside], place[columns[inside]]
    common = np.zeros((k, k), dtype=np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    width = 2048
    for first in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(columns, [first, first + width])
        part = np.zeros((k, width), dtype=np.float32)
        part[rows[lo:hi], columns[lo:hi] - first] = 1.0
        common += part @ part.T
    both = common.astype(np.int64)
    similar = 100 * both >= SIMILARITY * (sizes[:, None] + sizes[None, :] - both)
    names = np.array(roots)
    similar &= names[:, None] != names[None, :]
    parent = {r: r for r in roots}

    def top(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    out = []
    for x, y in zip(*np.nonzero(np.triu(similar, 1))):
        a, b = top(roots[x]), top(roots[y])
        if a != b:
            parent[a] = b
            out.append((vids[x], vids[y]))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joining links of each cell; the rows of a cell follow one another."""
    def links(cell: list[tuple]) -> list[tuple[int, int]]:
        if len({row[2] for row in cell}) < 2:
            return []
        return joining_links([r[0] for r in cell], np.array([r[1] for r in cell], dtype=np.int64),
                             [r[2] for r in cell], [r[3] for r in cell])

    def result(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()),
                                           pa.array([b for _, b in found], pa.int64())],
                                          names=["a", "b"])

    cell, key = [], None
    for batch in batches:
        found = []
        columns = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "vid", "n", "root")]
        sets = batch.column("others")
        for row, (*here, vid, n, root) in enumerate(zip(*columns)):
            if here != key:
                found += links(cell)
                cell, key = [], here
            cell.append((vid, n, root, sets[row].values.to_numpy()))
        yield result(found)
    yield result(links(cell))


def _relabelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, F.col("vid") == F.col("node"), "left").select(
        "bucket", "vid", "n", F.coalesce("root", "vid").alias("root"))


def _star_pairs(members: DataFrame) -> DataFrame:
    """Each member with its bucket's first member."""
    centers = members.groupBy("bucket").agg(F.min("vid").alias("center"))
    return members.join(centers, "bucket").filter("vid <> center").select(
        F.least("vid", "center").alias("a"), F.greatest("vid", "center").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``text_key`` (64 bits of the text),
    ``n_shingles``, ``component_id`` (the smallest id reachable over links),
    ``kept`` (the id is that one) and ``stays``: the row, with its id and text,
    is the one that stands for its component.

    A text with fewer words than a shingle is one shingle; a null, empty or
    blank text has none, links with nothing, is its own component and stays.
    A component's id is the smallest that is not null, or null.  Rows that
    repeat an id with other texts are judged each by its own text, so they may
    lie in several components, and of several in one, one text stays; rows
    equal in id and text have one answer.  Other columns are ignored.  An empty
    table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    rows = checkpointed(arrow_map(
        source, _signatures, f"id {id_type}, th long, n long, key binary, sig binary"))

    best = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "th")).alias("least")
    classes = rows.filter("n > 0").groupBy("key").agg(
        best, F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = checkpointed(classes.select("key", "least.id", "least.th", "n", "sig")) \
        .withColumn("vid", F.monotonically_increasing_id())

    bucket = F.xxhash64("band", F.expr(f"substring(sig, band * {ROWS} + 1, {ROWS})"))
    members = classes.select("vid", "n", "sig", F.explode(
        F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")) \
        .select("vid", "n", bucket.alias("bucket"))
    busy = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = checkpointed(members.join(busy.select("bucket"), "bucket", "left_semi"))
    links = _links(_star_pairs(shared), classes, source)
    roots = component_roots(links)

    left = checkpointed(_still_open(_relabelled(shared, roots)))
    # exploded anew for each use: a written copy would be many times the texts
    held = arrow_map(_texts(left.select("vid"), classes, source), _exploded,
                     "vid long, shingle long")
    left, others = _may_link(left, held)
    # narrow up to here; the shingles join last and travel once
    cells = _cells(left).join(others, "vid").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    late, found_late = checkpointed_count(arrow_map(cells, _compare, "a long, b long"))
    if found_late:
        roots = component_roots(late, roots)

    labels = classes.select("vid", "key", "id", "th").join(
        roots, F.col("vid") == F.col("node"), "left") \
        .select("key", "id", "th", F.coalesce("root", "vid").alias("root"))
    smallest = labels.groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "th")).alias("least"))
    named = labels.join(smallest, "root").select(
        "key", F.col("least.id").alias("component_id"), F.col("least.th").alias("stays_th"))
    linked = spread_lookup(rows.filter("n > 0").select("id", "th", "n", "key"), ["key"], named, "id")
    found = linked.select("id", "th", "n", "component_id", "stays_th").unionByName(
        rows.filter("n = 0").select("id", "th", "n", F.col("id").alias("component_id"),
                                    F.col("th").alias("stays_th")))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return found.select("id", F.col("th").alias("text_key"), F.col("n").alias("n_shingles"),
                        "component_id", kept.alias("kept"),
                        (kept & (F.col("th") == F.col("stays_th"))).alias("stays"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component.  Rows
    equal in id and text are one document and stay together."""
    stays = near_duplicates(docs, id_col, text_col).filter("stays") \
        .select(F.col("id").alias("_stays_id"), F.col("text_key").alias("_stays_key")).distinct()
    here = docs[id_col].eqNullSafe(stays["_stays_id"]) \
        & (F.xxhash64(docs[text_col]) == stays["_stays_key"])
    return docs.join(stays, here, "left_semi")
