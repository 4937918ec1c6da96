import random

import numpy as np
import pytest

from cuelark.llm import joins, minhash
from cuelark.llm.components import connected_components
from tests.llm.test_textbatch import words_of


def shingles(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, num, den):
    """Components over all pairs of rows."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    name = {i: i for i, _ in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, s in sets:
        for b, t in sets:
            if a < b and s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    return {i: root(i) for i in name}


def near(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed, groups=12, size=9):
    rng = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        base = " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice([8, 60, 150])))
        for _ in range(size if g else 40):
            rows.append((i, rng.choice([base, near(rng, base, 1), near(rng, base, 3)])))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "  \n"), (i + 3, "one two"), (i + 4, "ONE\ttwo"), (i + 5, "one")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("num", "seed"), [(80, 1), (85, 2)])
def test_components_are_those_of_all_pairs(spark, num, seed):
    rows = corpus(seed)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), num, 100).collect()
    want = brute(rows, num, 100)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in rows}
    assert all(r.kept == (r.doc_id == want[r.doc_id]) for r in got)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Small limits send every bucket through stars and block comparison."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    # Pairs of near copies inside a group whose members share a long passage but are not near.
    rows, i = [], 0
    for _ in range(12):
        own = " ".join(base + [f"y{rng.randrange(10**6)}" for _ in range(45)])
        for text in (own, near(rng, own, 1)):
            rows.append((i, text))
            i += 1
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 85, 100)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", 9, 9), (1, "a b c d e f", 9, 9), (2, "A b c d e f", 9, 9), (None, "a b c d e f", 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, component long")
    got = {(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(1, 1, True, 2), (2, 1, False, 2), (None, None, False, 2)}
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    name = {}
    for a, b in edges:
        if a != b:
            name.setdefault(a, a), name.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and name[a] != name[b]:
                name[a] = name[b] = min(name[a], name[b])
                changed = True
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == name and len(got) == len(name)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_doc_id_of_several_texts_keeps_all_their_links(spark):
    words = [f"w{i}" for i in range(300)]
    a, b, other = " ".join(words[:100]), " ".join(words[100:200]), " ".join(words[200:])
    changed = " ".join([*words[100:150], "x", *words[151:200]])
    rows = [(5, a), (5, b), (9, b), (7, changed), (3, a), (8, other), (8, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (9, 3), (7, 3), (3, 3), (8, 8)} and len(got) == len(rows)
    left = minhash.deduplicated(spark.createDataFrame([(5, a), (5, b), (5, b), (9, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([(5, a), (5, b)])


def test_rarest_shingles_meet_wherever_a_link_is():
    rng = random.Random(11)
    often = np.array([rng.randrange(9) for _ in range(minhash.CELLS)])
    for _ in range(300):
        s = {rng.getrandbits(64) for _ in range(rng.randrange(1, 40))}
        t = {x for x in s if rng.random() < 0.95} | {rng.getrandbits(64) for _ in range(rng.randrange(3))}
        if t and 100 * len(s & t) >= 85 * len(s | t):
            first = [set(minhash.rarest(np.array(sorted(x), np.uint64), often, 85, 100).tolist()) for x in (s, t)]
            assert first[0] & first[1]


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    """A third of all rows on one key: small limits, so that the rows take several salts."""
    monkeypatch.setattr(joins, "HOT_LEAST", 5)
    left = spark.createDataFrame([(i, 7 if i % 3 == 0 else i, None if i == 50 else i % 4) for i in range(300)], "x long, k long, j long")
    right = spark.createDataFrame([(7, "hot"), (4, "four"), (None, "none")], "k long, v string")
    for how in ("inner", "left"):
        got = sorted(joins.spread_join(left, right, ["k"], how).select("x", "k", "v").collect(), key=repr)
        assert got == sorted(left.join(right, ["k"], how).select("x", "k", "v").collect(), key=repr)
    star = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(399, 400)], "a long, b long")
    assert {(r.node, r.component) for r in connected_components(star).collect()} == {(i, 0) for i in range(401)}


def test_a_very_long_text(spark):
    """5 MB, and a copy with one word changed."""
    words = [f"w{i}" for i in range(700_000)]
    changed = [*words[:350_000], "x", *words[350_001:]]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, "a b c")]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 699_996), 2: (1, 699_996), 3: (3, 1)}
