"""Secret scans (DataFrame operations only): fixed patterns, and character
Markov models for what the patterns do not know.

Two first-order Markov models over the alphabet of tokens, one of random
strings and one of ordinary identifiers, are trained from labelled samples by
counting character pairs in Spark.  A token is scored by the sum of
log-likelihood ratios of its character pairs, which come from one table of
fixed size; a token whose ratio is high enough is reported beside the
patterns' spans.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import md5_fraction

#: The base patterns and the least length of what they find.
ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

#: Characters of tokens, as the models number them; others end a token.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
TOKEN_LENGTH = 20
MIN_RATIO = 1.0           # nats a character
SAMPLE_DOCUMENTS = 2_000  # the documents that give ordinary identifiers

_SPAN = "array<struct<start:long,kind:int,end:long,value:string>>"


def _found(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All matches: struct(start, kind, end, value), in code points.

    ``split`` by the pattern gives the text between the matches, so the
    lengths of both, summed up, are the positions."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    walk = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))).alias("at"),
            F.when(p["hit"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(
                F.struct((acc["at"] + F.length(p["gap"])).alias("start"),
                         F.lit(kind).alias("kind"),
                         (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("end"),
                         p["value"].alias("value"))))).alias("spans")))["spans"]
    return F.when(text.rlike(pattern), walk).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the fixed patterns, by kind, leftmost and not overlapping.

    A run shorter than its least length is no match; for ``access`` and
    ``hex`` the run's length is written into the pattern, which finds the
    same runs, as a run is as long as it can be."""
    assign = F.filter(_found(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= ASSIGN_VALUE)
    return {
        "assign": assign,
        "access": _found(text, rf"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}", 1),
        "hex": _found(text, rf"[0-9a-f]{{{HEX_LENGTH},}}", 2),
    }


def _pairs(samples: DataFrame) -> DataFrame:
    token = F.col("value")
    return samples.filter(F.length(token) >= 2).select("random", F.explode(F.transform(
        F.sequence(F.lit(1), F.length(token) - 1),
        lambda i: token.substr(i, F.lit(2)))).alias("pair"))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of all character pairs, from rows of ``value``
    and ``random`` (true: a random string, false: an ordinary identifier).

    Pairs are counted in Spark; what reaches the driver has at most two rows
    for each pair of the alphabet.  Pairs with other characters, null values
    and null labels are left out.  A class without samples is uniform."""
    size = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = {True: [smoothing] * (size * size), False: [smoothing] * (size * size)}
    inside = "[" + ALPHABET.replace("-", r"\-") + "]{2}"
    rows = _pairs(samples.filter("value is not null and random is not null")) \
        .filter(F.col("pair").rlike("^" + inside + "$")).groupBy("random", "pair").count()
    for random, pair, n in rows.collect():
        counts[random][at[pair[0]] * size + at[pair[1]]] += n

    def log_probability(table: list[float]) -> list[float]:
        totals = [sum(table[i * size:(i + 1) * size]) for i in range(size)]
        return [math.log(n / totals[k // size]) for k, n in enumerate(table)]

    return [a - b for a, b in zip(log_probability(counts[True]), log_probability(counts[False]))]


def log_ratio(token: Column, model: list[float]) -> Column:
    """Sum of the pair ratios of an alphabet-only token."""
    size = len(ALPHABET)
    ratios = F.from_json(F.lit(json.dumps(model)), "array<double>")
    codes = F.transform(F.sequence(F.lit(1), F.length(token)),
                        lambda i: F.position(token.substr(i, F.lit(1)), F.lit(ALPHABET)) - 1)
    follow = F.zip_with(codes, F.slice(codes, F.lit(2), F.length(token)),
                        lambda a, b: a * size + b)
    return F.aggregate(follow, F.lit(0.0),
                       lambda acc, k: acc + F.coalesce(F.get(ratios, k), F.lit(0.0)))


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text",
         min_ratio: float = MIN_RATIO, token_length: int = TOKEN_LENGTH) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``base`` and ``spans``, arrays of
    struct(start, kind, end, value) ordered by start, then kind.

    ``spans`` has the base spans and the tokens of ``token_length`` and more
    characters that no base span touches and whose ratio is ``min_ratio`` a
    character or more.  Null
    text counts as empty, and gives empty arrays.  Repeated rows each give a
    row.  Other columns are ignored.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    runs = "[" + ALPHABET.replace("-", r"\-") + "]{%d,}" % token_length
    found = docs.select(F.col(id_col).alias("id"), F.array_sort(F.concat(
        *base_spans(text).values())).alias("base"), _found(text, runs, 3).alias("tokens"))
    random = F.filter("tokens", lambda t: (log_ratio(t["value"], model) >= F.length(t["value"]) * min_ratio)
                      & ~F.exists("base", lambda b: (t["start"] < b["end"]) & (t["end"] > b["start"])))
    return found.select("id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     sample_documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Labelled samples out of a corpus: ``value`` and ``random``.

    Random: every value that the base patterns find in any document, and for
    hexadecimal ones the same bytes in base 64.  Ordinary: the words of
    about ``sample_documents`` documents (those with the least hashes of their
    ids) outside assignments, each word alone and joined with the next one as
    identifiers are written (snake_case, SNAKE_CASE, camelCase, kebab-case,
    paths)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")) \
        .filter("text is not null")
    spans = F.concat(*base_spans(F.col("text")).values())
    values = rows.select(F.explode(spans).alias("span")).select("span.value").distinct()
    encoded = F.regexp_replace(F.base64(F.unhex("value")), "=+$", "")
    even_hex = F.col("value").rlike(r"^([0-9a-f]{2}){12,}$")
    secret = values.union(values.filter(even_hex).select(encoded)) \
        .select("value", F.lit(True).alias("random"))

    share = min(1.0, sample_documents / max(1, rows.count()))
    few = rows.filter(md5_fraction(F.coalesce(F.col("id").cast("string"), F.lit(""))) <= share)
    words = few.select(F.regexp_extract_all(
        F.regexp_replace("text", ASSIGN, " "), F.lit(r"[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    follow = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ordinary = words.select(F.explode(F.concat("w", F.flatten(F.transform(follow, lambda p: F.array(
        F.concat_ws("_", p["a"], p["b"]), F.concat_ws("-", p["a"], p["b"]),
        F.concat_ws("/", p["a"], p["b"]), F.concat(p["a"], F.initcap(p["b"])),
        F.upper(F.concat_ws("_", p["a"], p["b"]))))))).alias("value")) \
        .select("value", F.lit(False).alias("random"))
    return secret.union(ordinary)


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
