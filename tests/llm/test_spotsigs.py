import hashlib
import random

from pyspark.sql import functions as F

from cuelark.llm import spotsigs


def texts(seed=2, n=40):
    rng = random.Random(seed)
    common = ["the", "of", "and", "der", "les"]
    return [(i * 3, " ".join(rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(n)]


def plain_signatures(text):
    """Stretch of content words after each anchor, by a loop over words."""
    import re

    words = [w for w in re.findall(r"[^\W_]+", (text or "").lower())]
    common, out = set(spotsigs.COMMON), set()
    for i in range(-1, len(words)):
        if i >= 0 and words[i] not in common:
            continue
        chain = [w for w in words[i + 1 :] if w not in common][: spotsigs.CHAIN]
        if chain:
            out.add(" ".join(chain))
    return out


def test_signatures_are_chains_after_anchors(spark):
    rows = [*texts(), (900, "The THE cat, and a dog!"), (901, "12 — of\nthe\tmoon"), (902, "!!"), (903, "of the"), (904, "a " * 3000 + "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: set(r.s) for r in df.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    assert got == {i: {hashlib.md5(w.encode()).hexdigest()[:8] for w in plain_signatures(t)} for i, t in rows}


def test_edited_texts_and_likenesses(spark):
    rows = [*texts(), (1000, "é😀 the cat"), (1001, None), (1002, "é😀 the cat")]
    random.Random(1).shuffle(rows)
    got = {r.doc_id: r for r in spotsigs.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    prints = {i: got[i].fingerprint for i, _ in rows}

    def jaccard(a, b):
        a, b = set(a.split()), set(b.split())
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, (i, t) in enumerate(order):
        t, (j, x) = t or "", order[(k + 1) % len(order)]
        half = len(t) // 2
        edited = t[: len(t) - half] + (x or "")[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert abs(r.near_edited - jaccard(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - jaccard(r.fingerprint, prints[j])) < 1e-12
    assert got[1000].fingerprint == got[1002].fingerprint != ""


def test_nulls_repeats_lone_and_empty(spark):
    docs = spark.createDataFrame([(1, "the cat sat", 1), (1, "the cat sat", 1), (None, "the cat sat", 1)], "doc_id long, text string, id int")
    got = spotsigs.compare_edited(docs).collect()
    assert len(got) == 3 and {r.near_next for r in got if r.doc_id == 1} == {1.0}
    assert spotsigs.compare_edited(docs.limit(0)).count() == 0


def test_near_pairs_are_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for g in range(10):
        base = [rng.choice(["the", "of"]) if rng.random() < 0.4 else f"g{g}w{rng.randrange(200)}" for _ in range(120)]
        for i in range(4):
            own = list(base)
            for _ in range(i):
                own[rng.randrange(120)] = f"z{rng.randrange(999)}"
            rows.append((g * 10 + i, " ".join(own)))
    rows += [(500, rows[0][1]), (501, None), (502, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {r.doc_id: frozenset(r.s) for r in df.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(sets[i], i)
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert len(want) > 5 and {(r.a, r.b) for r in spotsigs.near_pairs(df, 0.7).collect()} == want


def test_near_pairs_make_signatures_once(spark, monkeypatch):
    """They are most of the work; texts without any, all of one class, pair with none."""
    from cuelark.llm import spotsigs

    plans, cut = [], spotsigs.cut
    monkeypatch.setattr(spotsigs, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    df = spark.createDataFrame([(1, "the red fox and the blue bird"), (2, "the red fox and the blue bird!"), (3, ""), (4, None), (5, "..."), (None, "the red fox")], "doc_id long, text string")
    assert spotsigs.near_pairs(df).count() == 0  # 1 and 2 are one class
    assert sum(p.count("regexp_extract_all") for p in plans) == 1
