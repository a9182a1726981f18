import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from revlens.llm import line_dedup as L


def _brute(docs, least):
    """Windows, first occurrences, diagonals and runs, straight from the definition."""
    lines = {}
    for i, text in sorted(docs.items()):
        kept = [(p, x) for p, x in enumerate(text.split("\n")) if x.strip(" ")]
        lines[i] = [(p, x, x.strip(" ").count(" ") + 1) for p, x in kept]
    first, diagonals, gone = {}, set(), {i: set() for i in docs}
    for i, rows in sorted(lines.items()):
        for a in range(len(rows)):
            held, b = 0, a
            while b < len(rows) and held < least:
                held += rows[b][2]
                b += 1
            if held >= least:
                j, c = first.setdefault(tuple(x for _, x, _ in rows[a:b]), (i, a))
                if (j, c) != (i, a):
                    diagonals.add((i, j, a - c))
    for i, j, shift in diagonals:
        run = []
        for k, row in enumerate([*lines[i], None]):
            if row and 0 <= k - shift < len(lines[j]) and row[1] == lines[j][k - shift][1]:
                run.append(row)
                continue
            if sum(r[2] for r in run) >= least:
                gone[i] |= {r[0] for r in run}
            run = []
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i])
            for i, t in docs.items()}


def _check(spark, docs, least):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup_lines(df, min_words=least, salts=3).collect()}
    assert got == _brute(docs, least)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10_000))
def test_matches_the_definition(spark, seed):
    rnd = random.Random(seed)
    pool = [" ".join([c] * rnd.randint(1, 4)) for c in "abcdef"] + ["", " "]
    docs = {i: "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14))) for i in range(12)}
    _check(spark, docs, 4)


def test_a_long_passage_is_cut_and_short_common_lines_stay(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = {i: f"own {i}\n{passage}\nCommon line.\nend {i}" for i in range(40)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    assert got[0] == docs[0]
    # the run reaches over the common line that follows the passage everywhere
    assert all(got[i] == f"own {i}\nend {i}" for i in range(1, 40))


def test_nulls_repeats_and_other_columns(small, none):
    got = L.dedup_lines(small, min_words=20).collect()
    assert len(got) == small.count() and "_removed" in got[0]
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[1] == [None] and texts[2] == [""] and texts[3] == [" \n\t "]
    assert texts[5] == ["", ""] and texts[9] == ["tail"] and texts[7] == ["a b c"]
    assert {r.id for r in got} == {r.id for r in small.collect()}
    assert L.dedup_lines(none).count() == 0


def _brute_words(docs, least):
    """Every pair of runs of lines, with words split at ASCII white space."""
    def count(line):
        return len([w for w in re.split("[ \\t-\\r]+", line) if w])
    lines = {i: [(p, x, count(x)) for p, x in enumerate(t.split("\n")) if count(x)]
             for i, t in docs.items()}
    places = [(i, a) for i in sorted(lines) for a in range(len(lines[i]))]
    gone = {i: set() for i in docs}
    for i, a in places:
        for j, c in places:
            held, k = 0, 0
            while (j, c) < (i, a) and a + k < len(lines[i]) and c + k < len(lines[j]) \
                    and lines[i][a + k][1] == lines[j][c + k][1]:
                held += lines[i][a + k][2]
                k += 1
            if held >= least:
                gone[i] |= {lines[i][x][0] for x in range(a, a + k)}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i])
            for i, t in docs.items()}


def test_words_between_tabs_padding_and_crlf(spark):
    row = "\t".join(f"cell{i}" for i in range(60))
    padded = "two" + " " * 49 + "words"
    table = "\n".join(f"name{i}" + " " * 12 + f"{i}" for i in range(5))
    blank = "\r\n" * 55 + "\t\n" * 5
    docs = {i: f"own {i}\r\n{part}\nend {i}" for i, part in enumerate(
        [row, row, padded, padded, table, table, blank, blank])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    assert got == _brute_words(docs, 50)
    assert got == {**docs, 1: "own 1\r\nend 1"}
