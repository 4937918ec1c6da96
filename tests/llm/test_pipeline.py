from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cuelark.llm import decontam, joins, minhash, mixing, quality, sharding, storage
from tests.llm.test_decontam import words
from tests.llm.test_minhash import brute

DATA = "/root/testdata/sf0.001"
HEAD = "doc_id long, text string, lang string, source string, n_chars long"


def overlaps(doc, item):
    """Whether any stretch along any offset meets the rule; offsets with too few equal words are passed over."""
    names = {}
    d, w = (np.array([names.setdefault(x, len(names)) for x in words(t)], int) for t in (doc, item))
    least = min(decontam.LEAST_WORDS, len(w))
    if len(w) < decontam.SHORTEST_ITEM:
        return False
    for offset in range(-len(w) + 1, len(d)):
        a, b = max(0, offset), min(len(d), offset + len(w))
        equal = d[a:b] == w[a - offset : b - offset]
        if equal.sum() >= decontam.LEAST_SHARE * least:
            s, e = decontam.best_stretch(equal)
            if e - s >= least and equal[s:e].sum() >= decontam.LEAST_SHARE * (e - s):
                return True
    return False


def tables(spark, home, rows, head=HEAD, labels=(), items=()):
    spark.createDataFrame(list(rows), head).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return str(home)


@pytest.fixture(scope="module")
def stages(spark):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.staged(stage(spark, docs, DATA), name)
        seen.append((name, before, docs))
    return {name: (before, after) for name, before, after in seen}


def test_each_stage_keeps_columns_and_does_its_part(spark, stages):
    before, after = stages["quality"]
    net = quality.learn(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    kept = {r.doc_id for r in quality.classify(before, net).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == kept and after.columns == before.columns

    before, after = stages["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == set(brute(rows, 80, 100).values()) and after.columns == before.columns

    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after.collect()}
    assert {r.doc_id for r in before.collect() if not any(overlaps(r.text, x) for x in items)} == kept
    assert after.columns == before.columns

    before, after = stages["mixing"]
    want = Counter()
    for r in mixing.mix(before).collect():
        want[r.doc_id] += int(r.taken / r.size + 0.5) if r.size else 0
    assert Counter(r.doc_id for r in after.collect()) == +want and after.columns == before.columns

    before, after = stages["sharding"]
    assert Counter(r.doc_id for r in after.collect()) == Counter(r.doc_id for r in before.collect())
    assert minhash.WORDS == 5


def test_run_is_all_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect()), key=str) == sorted(map(tuple, stages["sharding"][1].collect()), key=str)


def test_nulls_empty_texts_repeats_and_clashing_columns(spark, tmp_path):
    """With one label for all texts nothing is rejected, so every odd row reaches every stage."""
    passage = " ".join(f"q{i}" for i in range(30))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " ".join(f"u{i}" for i in range(40)), None, None, 7), (3, " ".join(f"u{i}" for i in range(40)), None, None, 7),
        (None, "no id but words", "en", "a", 1), (None, None, None, None, None), (4, " ".join(f"u{i}" for i in range(40)), "en", "b", 1), (5, f"before {passage} after", "en", "b", 1),
        (6, "long " * 200_000, "en", "a", 1), *[(100 + i, f"text {i} of its own with some words", "en", "c", 1) for i in range(12)],
    ]
    head = HEAD + ", kept long, component long, size long, score long, taken long, shard long"
    home = tables(spark, tmp_path / "odd", [(*r, 1, 2, 3, 4, 5, 6) for r in rows], head, [(100 + i, 1, 0) for i in range(12)], [(1, passage), (2, None), (None, "x")])
    docs = spark.read.parquet(f"{home}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.staged(stage(spark, docs, home), name)
        left[name] = Counter(r.doc_id for r in docs.collect())
        assert name == "sharding" or docs.columns == before.columns
    assert left["quality"] == Counter(r[0] for r in rows)
    assert left["near_dedup"][3] == 1 and left["near_dedup"][4] == 0 and left["near_dedup"][None] == 2 and left["near_dedup"][1] == left["near_dedup"][2] == 1
    assert left["decontamination"] == left["near_dedup"] - Counter({5: 1})
    assert left["mixing"][1] == left["mixing"][2] == 0 and left["mixing"][6] >= 1  # nothing to take of texts without words
    assert left["sharding"] == left["mixing"]


def test_empty_tables(spark, tmp_path):
    home = tables(spark, tmp_path / "none", [])
    assert corpus_pipeline.run(spark, home).count() == 0


def test_rows_of_the_driver_need_no_workers_of_another_kind(spark, tmp_path):
    """A list given to createDataFrame is copied by RDD workers, which stay beside the operators' (LogicalRDD)."""
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    left = spark.range(2000).selectExpr("if(id < 1500, 7, id) as k", "id")
    met = joins.spread_join(left, spark.range(2000).withColumnRenamed("id", "k"), ["k"])
    assert "_salt" in plan(met) and "LogicalRDD" not in plan(met)
    assert met.count() == 2000

    texts = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    texts.write.parquet(f"{tmp_path}/d")
    dealt = sharding.shard(spark.read.parquet(f"{tmp_path}/d"), home=f"{tmp_path}/maps")
    places = [x for x in plan(dealt).splitlines() if "first" in x and ("LocalRelation" in x or "LogicalRDD" in x)]
    assert places and all("LocalRelation" in x for x in places)


def _measured(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])


def test_near_dedup_hands_texts_to_workers_in_batches_of_bounded_size(spark, monkeypatch):
    seen, real = [], minhash.staged

    def watched(df, name):
        if name == "fingerprints":
            rows = spark.range(6000, numPartitions=1).selectExpr("id", "repeat('x', 4000) as t")
            seen.extend(rows.mapInArrow(_measured, "n long, bytes long").collect())
        return real(df, name)

    monkeypatch.setattr(minhash, "staged", watched)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "other")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert sum(r.n for r in seen) == 6000 and max(r.bytes for r in seen) < 1.1 * storage.BATCH_BYTES
    assert spark.conf.get(storage.BATCH_SETTING, None) is None
