import random
import re

import numpy as np
import pyarrow as pa

from cuelark.llm import decontam


def words(t):
    return re.findall(r"[0-9a-z\u0080-￿]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(doc, item):
    """Best overlap over all offsets, by the documented scores."""
    d, w, best = words(doc), words(item), None
    if len(w) < decontam.SHORTEST_ITEM:
        return None
    for offset in range(-len(w) + 1, len(d)):
        a, b = max(0, offset), min(len(d), offset + len(w))
        equal = np.array([d[i] == w[i - offset] for i in range(a, b)], bool)
        s, e = decontam.best_stretch(equal)
        same = int(equal[s:e].sum())
        if e - s >= min(decontam.LEAST_WORDS, len(w)) and same >= decontam.LEAST_SHARE * (e - s):
            best = max(best or (0, 0), (same, e - s))
    return best


def test_overlaps_are_those_of_all_offsets(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([4, 7, 15, 40])))) for i in range(30)]
    docs = []
    for i in range(160):
        own = [word() for _ in range(rng.randint(0, 120))]
        if i % 2:
            part = items[rng.randrange(30)][1].split()
            part = [w if rng.random() > rng.choice([0, 0.1]) else "zzz" for w in part][rng.randrange(3) :]
            at = rng.randint(0, len(own))
            own[at:at] = part
        docs.append((i, " ".join(own).upper() if i % 5 == 0 else ", ".join(own)))
    got = {(r.doc_id, r.item_id): (r.n_equal, r.n_words) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): best for d, t in docs for i, x in items if (best := brute(t, x))}
    assert len(want) > 25 and set(got) <= set(want)
    # Masks forgive substitutions; no exact or nearly exact overlap may be missed.
    assert len(set(want) - set(got)) <= 0.03 * len(want)
    assert all(got[k] == want[k] for k in got)
    exact = {k for k, (same, n) in want.items() if same == n}
    assert exact <= set(got)


def test_any_stretch_that_meets_the_rule_counts():
    runs = np.array(([True] * 14 + [False] * 6) * 2 + [True] * 14)
    assert decontam.best_stretch(runs) == (0, 35)
    rng = np.random.default_rng(5)
    for _ in range(400):
        equal = rng.random(rng.integers(1, 60)) > rng.choice([0.1, 0.2, 0.25, 0.4])
        least = min(decontam.LEAST_WORDS, len(equal))
        want = [(int(equal[a:b].sum()), b - a) for a in range(len(equal)) for b in range(a + least, len(equal) + 1) if 5 * equal[a:b].sum() >= 4 * (b - a)]
        a, b = decontam.best_stretch(equal)
        got = (int(equal[a:b].sum()), b - a)
        assert got in want if want else (a, b) == (0, 0)


def test_runs_apart_are_an_overlap(spark):
    item = [f"a{j}" for j in range(59)]
    apart = [w if j % 20 < 14 else f"x{j}" for j, w in enumerate(item[:54])]
    every_4th = [w if j % 4 else f"y{j}" for j, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(apart)), (2, " ".join(every_4th)), (3, " ".join(w if j % 3 else "z" for j, w in enumerate(item)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_equal) for r in decontam.contaminated(docs, items).collect()}
    assert got == {1: (35, 28), 2: (15, 12)}
    assert [r.doc_id for r in decontam.decontaminated(docs, items).collect()] == [3]


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"a{i}b{j}" for j in range(20))) for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "x y " + " ".join(f"a{i}b{j}" for j in range(20))) for i in range(8)], "doc_id long, text string")
    whole = sorted(map(tuple, decontam.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontam.seed_blocks, "__defaults__", (100,))
    assert sorted(map(tuple, decontam.contaminated(docs, items).collect())) == whole and len(whole) == 6
    assert sorted(r.doc_id for r in decontam.decontaminated(docs, items).collect()) == [6, 7]


def test_nulls_empties_repeats_and_clashing_columns(spark):
    text = " ".join(f"q{j}" for j in range(20))
    docs = spark.createDataFrame([(1, text, 0, 0), (1, text, 0, 0), (None, text, 0, 0), (2, None, 0, 0), (3, "", 0, 0)], "doc_id long, text string, item_id int, seeds int")
    items = spark.createDataFrame([(7, text), (7, text), (8, None), (None, text), (9, ""), (10, "q1 q2")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()]
    assert sorted(got, key=str) == [(1, 7), (1, 7), (None, 7)]
    left = decontam.decontaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
    assert decontam.contaminated(docs, items.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.decontaminated(docs, items.limit(0)).count() == 5


def test_common_phrases_meet_in_portions(spark, monkeypatch):
    """A phrase of every item, many times in one text: the same overlaps, a few meetings at a time."""
    phrase = " ".join(f"p{i}" for i in range(9))
    items = [(i, f"{phrase} item{i} of its own with some words more {i}") for i in range(40)]
    docs = [(1, " ".join([phrase] * 50) + " " + items[3][1]), (2, phrase), (3, items[7][1] * 2)]
    run = lambda: sorted(map(tuple, decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()))
    want = run()
    assert {(r[0], r[1]) for r in want} >= {(1, 3), (3, 7)} and all(r[0] != 2 for r in want)
    seeds = next(decontam.seed_blocks(*zip(*items, strict=True)))
    column = pa.array([t for _, t in docs], pa.string())
    whole = list(decontam.matches(column, seeds))
    monkeypatch.setattr(decontam, "HITS_TOGETHER", 7)
    assert list(decontam.matches(column, seeds)) == whole


def test_a_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(1, " ".join(f"w{i % 9999}" for i in range(600_000)) + " " + item + " end")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(4, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.doc_word, r.n_words) for r in got] == [(1, 4, 600_000, 20)]
