import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from cuelark.llm import quality, toxicity


def corpus(n=500, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("ka to mi ru ne so".split(), k=rng.randint(1, 3))) for _ in range(rng.choice([6, 40, 400]))]
        junk, toxic = rng.random() < 0.3, rng.random() < 0.3
        if junk:
            words = [w + rng.choice(["$$$", "&&&"]) for w in words]
        if toxic:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["vile", "foul", "nastyka", "nastymi"])
        docs.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out_accuracy(rows, labels, column):
    labels = {r.doc_id: r[column] for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 40 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    return sum(labels[r.doc_id] == r.predicted for r in held) / len(held)


def test_quality_on_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 12)
    docs, labels = frames(spark)
    net = quality.learn(docs, labels)
    assert held_out_accuracy(quality.classify(docs, net).collect(), labels, "quality") >= 0.95
    left = quality.accepted(docs.selectExpr("*", "1 as score"), net)
    assert left.columns == ["doc_id", "text", "score"] and 0 < left.count() < docs.count()


def test_quality_edges(spark):
    net = quality.Network.fresh(np.random.default_rng(1))
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x" * 300_000, 1), (3, "x" * 300_000, 1), (None, "a", 1)], "doc_id long, text string, label int")
    got = {r.doc_id: r.score for r in quality.classify(docs, net).collect()}
    assert got[1] == got[2] and len(got) == 4 and quality.classify(docs.limit(0), net).count() == 0
    nothing = quality.learn(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.classify(docs, nothing).collect()} == {0.5}


def test_chunks_cover_every_byte():
    for n in [0, 1, quality.CHUNK, quality.CHUNK + 1, 5000, 100_001]:
        starts = quality.chunk_starts(n)
        seen = np.zeros(n, bool)
        for s in starts:
            assert s == 0 or s < n
            seen[s : s + quality.CHUNK] = True
        assert seen.all()


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    net = quality.Network.fresh(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    chunks, length = rng.integers(97, 123, (3, quality.CHUNK)).astype(np.uint8), np.array([quality.CHUNK, 500, 3])
    y, w = np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5])
    loss = lambda: float(np.mean(w * (np.logaddexp(0, net.forward(chunks, length)) - y * net.forward(chunks, length))))
    g = net.gradient(chunks, length, y, w)
    for k in ("vectors", "filters", "shift", "hidden", "hidden_shift", "out", "out_shift"):
        flat = net.p[k].reshape(-1)
        i = int(np.abs(g[k].reshape(-1)).argmax())
        held, step = flat[i], 1e-3
        flat[i] = held + step
        up = loss()
        flat[i] = held - step
        down = loss()
        flat[i] = held
        assert abs((up - down) / (2 * step) - g[k].reshape(-1)[i]) <= 0.05 * abs(g[k].reshape(-1)[i]) + 1e-4, k


def test_toxicity_on_held_out_rows(spark):
    docs, labels = frames(spark)
    rows = toxicity.classify(docs, toxicity.learn(docs, labels)).collect()
    assert held_out_accuracy(rows, labels, "toxic") >= 0.95


def test_toxicity_edges(spark):
    docs, labels = frames(spark)
    index = toxicity.learn(docs, labels)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "vile " * 100_000, 1), (3, "vile " * 100_000, 1), (None, "foul", 1)], "doc_id long, text string, label int")
    got = {r.doc_id: (r.score, r.evidence) for r in toxicity.classify(odd, index).collect()}
    assert got[1] == got[2] == index.scores([([], [])])[0] and not got[1][1] and got[3][0] > 0.5 and len(got[3][1]) == toxicity.EVIDENCE
    nothing = toxicity.learn(docs.limit(0), labels.limit(0))
    assert {round(r.score, 5) for r in toxicity.classify(odd, nothing).collect()} == {0.0}
    assert toxicity.classify(odd.limit(0), index).count() == 0


def test_copies_of_examples_without_telling_terms_find_them(spark):
    docs, labels = frames(spark)
    word = lambda i, j: f"own{chr(97 + i)}{chr(97 + j)}"
    rare = spark.createDataFrame([(1000 + i, " ".join(word(i, j) for j in range(12))) for i in range(20)], "doc_id long, text string")
    index = toxicity.learn(docs.unionByName(rare), labels.unionByName(spark.createDataFrame([(1000 + i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")))
    rows = toxicity.classify(rare, index).collect()
    known = {r.doc_id for r in rows if not r.held_out}
    assert known and all(r.evidence[0] == r.doc_id and r.score > index.base for r in rows if r.doc_id in known)


def test_nearest_is_exact():
    rng = np.random.default_rng(4)
    n, terms = 1500, 30
    dense = (rng.random((n, terms)) * (rng.random((n, terms)) < 0.15)).astype(np.float32)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    lists = [(np.flatnonzero(dense[:, t]), dense[dense[:, t] > 0, t]) for t in range(terms)]
    index = toxicity.Index(np.arange(terms, dtype=np.uint64), np.ones(terms), np.arange(n), np.zeros(n), lists, 0.1)
    for _ in range(40):
        at = np.sort(rng.choice(terms, rng.integers(1, 6), replace=False))
        q = rng.random(len(at)).astype(np.float32)
        q /= np.linalg.norm(q)
        _, cosine = index.nearest(at, q, 20)
        want = np.sort(dense[:, at] @ q)[::-1][:20]
        assert np.allclose(cosine, want[: len(cosine)], atol=2e-6) and (len(cosine) == 20 or want[len(cosine)] <= 0)


def test_term_counts_cover_words_and_beginnings():
    column = pa.array(["Vile vile nastymi", None, "nasty"], pa.string())
    every = [h for _, h, _, _ in toxicity.terms(column)][0]
    counts = list(toxicity.term_counts(column, np.unique(every)))
    assert [int(c.sum()) for _, c in counts] == [5, 0, 1]


def plain_words(text):
    """Lower-cased words, and the beginnings of the longer ones."""
    own = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return own, [(n, w[:n]) for w in own for n in toxicity.BEGINNINGS if len(w) > n]


def scores_by_hand(docs, examples):
    """Terms, weights, cosines, votes and the curve in plain loops."""
    seen = {i: Counter([*plain_words(t)[0], *plain_words(t)[1]]) for i, t in docs}
    p, n = sum(examples.values()), sum(1 - y for y in examples.values())
    weight = {}
    for term in {t for i in examples for t in seen[i]}:
        a, b = (sum(y == k for i, y in examples.items() if term in seen[i]) for k in (1, 0))
        rest = (a + b) * (p + n - a - b) * p * n
        chi2 = (a * (n - b) - b * (p - a)) ** 2 * (p + n) / rest if rest else 0
        more = max(0, math.sqrt(chi2) - toxicity.SIGMAS) ** 2
        if isinstance(term, bytes) or more > 0:
            df = sum(term in c for c in seen.values())
            weight[term] = math.log(1 + len(docs) / df) * (1 + more), more
    vectors = {}
    for i, c in seen.items():
        v = {t: (1 + math.log(k)) * weight[t][0] for t, k in c.items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / size for t, x in v.items()}
    plain = [y for i, y in examples.items() if not any(weight[t][1] > 0 for t in seen[i] if t in weight)]
    base = (sum(plain) + p / (p + n)) / (len(plain) + 1)

    def vote(i, but=None):
        near = sorted(((sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()), j) for j in examples if j != but), reverse=True)[: toxicity.NEAREST]
        w = [(max(c, 0) ** toxicity.POWER, examples[j]) for c, j in near]
        return (sum(x * y for x, y in w) + toxicity.PRIOR * base) / (sum(x for x, _ in w) + toxicity.PRIOR)

    ids = list(examples)
    slope, shift = toxicity.fitted_curve(np.array([vote(i, i) for i in ids]), np.array([float(examples[i]) for i in ids]))
    return {i: 1 / (1 + math.exp(-(slope * math.log(vote(i) / (1 - vote(i))) + shift))) for i in seen}


def test_scores_are_those_of_plain_loops(spark):
    docs, labels = corpus(150, seed=9)
    docs = [*docs, (998, None), (999, "words never seen before")]
    examples = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 5}
    index = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.classify(spark.createDataFrame(docs, "doc_id long, text string"), index).collect()}
    want = scores_by_hand(docs, examples)
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-3


def test_calibration_makes_votes_rates():
    rng = np.random.default_rng(6)
    true = rng.random(20_000)
    labels = (rng.random(20_000) < true).astype(float)
    votes = toxicity.sigmoid(0.5 * toxicity.logit(true) - 1)  # too flat and too low
    slope, shift = toxicity.fitted_curve(votes, labels)
    score = toxicity.sigmoid(slope * toxicity.logit(votes) + shift)
    for low in np.arange(0, 1, 0.1):
        own = (score >= low) & (score < low + 0.1)
        assert abs(score[own].mean() - labels[own].mean()) < 0.05
    apart = toxicity.fitted_curve(np.array([0.1, 0.2, 0.9]), np.array([0.0, 0.0, 1.0]))
    assert 0 < apart[0] < 50 and toxicity.fitted_curve(np.empty(0), np.empty(0)) == (1.0, 0.0)


def logits_by_hand(net, text):
    """The network's layers in plain loops, chunk by chunk."""
    p, out = net.p, []
    step = quality.CHUNK - quality.OVERLAP
    for a in range(0, max(1, len(text) - quality.OVERLAP), step):
        own = text[a : a + quality.CHUNK]
        data = own.ljust(quality.CHUNK, b"\0")
        blocks = [np.concatenate([p["vectors"][b] for b in data[i : i + quality.STRIDE]]) for i in range(0, quality.CHUNK, quality.STRIDE)]
        places = min(max(-(-len(own) // quality.STRIDE), 1), quality.PLACES)
        shown = [np.maximum(sum(blocks[i + t] @ p["filters"][t] for t in range(quality.TAPS)) + p["shift"], 0) for i in range(places)]
        pooled = np.concatenate([np.max(shown, 0), np.sum(shown, 0) / places, [len(own) / quality.CHUNK]])
        out.append(np.maximum(pooled @ p["hidden"] + p["hidden_shift"], 0) @ p["out"] + p["out_shift"][0])
    return np.array(out)


def test_scores_of_the_network_are_those_of_plain_loops():
    rng = np.random.default_rng(2)
    net = quality.Network.fresh(rng)
    net.p["combine"] = np.array([0.7, 0.2, 0.4, -0.1], np.float32)
    column = ["", "short é", "x" * 1024, "word $$$ " * 330, None, "".join(chr(rng.integers(32, 900)) for _ in range(2500))]
    got = net.score(pa.array(column, pa.string()))
    for t, s in zip(column, got, strict=True):
        z = logits_by_hand(net, (t or "").encode())
        want = 1 / (1 + math.exp(-float(np.dot([z.mean(), z.max(), z.min(), 1], net.p["combine"]))))
        assert abs(s - want) < 1e-5
    chunks = list(quality._fit_chunks([pa.record_batch({"ticket": [1], "label": [1], "text": ["a" * 10_000]})]))[0]
    assert chunks.num_rows == len(quality.chunk_starts(10_000)) == 12
