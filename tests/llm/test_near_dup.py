import random
from itertools import combinations

import numpy as np
import pytest

from revlens.llm import near_dup as N
from revlens.llm.components import component_roots


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def _brute(rows):
    sets = {i: _shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def _got(docs):
    return {r.id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs).collect()}


def _family(rnd, size, words, edits):
    template = [f"t{rnd.randint(0, 9999)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(template)
        for _ in range(rnd.randint(0, edits)):
            copy[rnd.randrange(words)] = f"e{rnd.randint(0, 10 ** 6)}"
        out.append(" ".join(copy))
    return out


def test_matches_brute_force_on_families_of_near_copies(spark):
    rnd = random.Random(3)
    texts = _family(rnd, 150, 120, 9) + _family(rnd, 20, 60, 4) + _family(rnd, 2, 40, 1)
    texts += ["A b c", "a  B\nc", "a b", "", None, " \t"] + [
        " ".join(str(rnd.random()) for _ in range(50)) for _ in range(30)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    assert _got(spark.createDataFrame(rows, "doc_id long, text string")) == _brute(rows)


def test_blocks_of_a_bucket_find_what_one_block_finds(spark, monkeypatch):
    rnd = random.Random(4)
    rows = list(enumerate(_family(rnd, 120, 100, 8)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = N._cells
    monkeypatch.setattr(N, "_cells", lambda members: whole(members, 8))
    assert _got(docs) == _brute(rows)


def test_nulls_repeats_and_empty(small, none):
    got = N.near_duplicates(small).collect()
    assert len(got) == small.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert by_id[1] == by_id[2] - {(0, 2, True)} | {(0, 1, True)}
    assert by_id[3] == {(0, 3, True)} and by_id[8] == {(1, 7, False)}
    assert by_id[5] == {(116, 4, False)} and by_id[9] == {(117, 4, False)}
    assert by_id[None] == {(1, None, True), (0, None, True)}
    assert N.near_duplicates(none).count() == 0


def test_posterior_table():
    needed = [N.required_matches(n) for n in range(48, 241, 48)]
    assert needed == sorted(needed) and 0.55 * 240 < needed[-1] < 0.7 * 240
    # the posterior mass, by numerical integration
    m, n = needed[-1], 240
    x = (np.arange(200_000) + 0.5) / 200_000
    density = np.exp(m * np.log(x) + (n - m) * np.log1p(-x) - (m * np.log(m / n) + (n - m) * np.log(1 - m / n)))
    assert density[x >= 0.75].sum() / density.sum() >= N.MISS
    assert N.required_matches(240, miss=1e-3) > m


@pytest.mark.parametrize("known", [0, 7, 25])
@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape, known):
    rnd = random.Random(1)
    edges = {"chain": [(i, i + 1) for i in range(40)], "star": [(99, i) for i in range(30)],
             "random": [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)]}[shape]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[top(a)] = top(b)
    def table(links):
        return spark.createDataFrame(links, "a long, b long")

    before = component_roots(table(edges[:known])) if known else None
    rows = component_roots(table(edges[known:]), before).collect()
    got = {r.node: r.root for r in rows}
    assert len(got) == len(rows)
    assert set(got) == set(parent)
    assert all((got[a] == got[b]) == (top(a) == top(b)) for a, b in combinations(sorted(got), 2))
    assert not component_roots(table([]), None).collect()


def test_rows_that_repeat_an_id_or_have_none_are_judged_by_their_text(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(4, a), (5, a + " x"), (5, b), (5, b), (7, b + " y"), (8, "c d e f g h"), (8, "C d e f g h"),
            (None, "n o p q r s"), (None, "N o p q r s"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id or 0, r.component_id or 0, r.kept, r.stays) for r in N.near_duplicates(df).collect())
    assert [g for g in got if g[0] not in (0, 8)] == [
        (4, 4, True, True), (5, 4, False, False), (5, 5, True, True), (5, 5, True, True), (7, 5, False, False)]
    left = sorted((r.doc_id or 0, (r.text or "").lower()) for r in N.one_of_each(df).collect())
    assert left == [(0, ""), (0, "n o p q r s"), (4, a), (5, b), (5, b), (8, "c d e f g h")]
