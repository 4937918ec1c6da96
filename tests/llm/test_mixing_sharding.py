import random
import zlib
from collections import Counter, defaultdict

import pytest

from cuelark.llm import mixing
from cuelark.llm.sharding import SlotMap, shard


def documents(n=300, seed=2):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "a", "a", "b", "c", "dd", None]), " ".join("w" for _ in range(rng.choice([0, 1, 30, 300])))) for i in range(n)]


def aims(sizes, most=3):
    """Targets by resharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        rest, weight = total - sum(fixed.values()), sum(w[s] for s in open_)
        over = [s for s in open_ if rest * w[s] / weight >= most * sizes[s]]
        if not over:
            return fixed | {s: rest * w[s] / weight for s in open_}
        fixed |= {s: most * sizes[s] for s in over}
        if len(fixed) == len(names):
            return fixed


@pytest.mark.parametrize("shard_docs", [4096, 20])
def test_mix(spark, shard_docs):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = {r.doc_id: r for r in mixing.mix(df, shard_docs=shard_docs, block=16).collect()}
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(5), shard_docs=shard_docs, block=16).collect()}
    sizes, taken = Counter(), Counter()
    for i, s, t in rows:
        assert got[i].size == len(t.split()) and got[i].taken <= 3 * got[i].size
        sizes[s] += got[i].size
        taken[s] += got[i].taken
    want = aims(sizes)
    for i, s, _ in rows:
        assert got[i].source_size == sizes[s] and abs(got[i].target - want[s]) < 1e-3
    assert all(abs(taken[s] - want[s]) <= 16 * 20 for s in sizes)
    assert again == {i: r.taken for i, r in got.items()}


def plain_sainte_lague(weights, seats):
    given = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * given[i] + 1), -i))
        given[best] += 1
    return given


def test_sainte_lague_is_that_of_highest_quotients(spark):
    rng = random.Random(1)
    rows = []
    for g in range(30):
        seats, n = rng.randint(0, 60), rng.randint(1, 12)
        rows += [(g, i, float(rng.choice([0, 1, rng.randint(1, 1000)])), seats) for i in range(n)]
    got = mixing.sainte_lague(spark.createDataFrame(rows, "g int, i int, w double, seats long"), ["g"], ["i"], "w", "seats", "won").collect()
    by = defaultdict(dict)
    for r in got:
        by[r.g][r.i] = r.won
    for g, won in by.items():
        w = [x[2] for x in rows if x[0] == g]
        seats = next(x[3] for x in rows if x[0] == g)
        assert [won[i] for i in range(len(w))] == (plain_sainte_lague(w, seats) if sum(w) else [0] * len(w)), (w, seats)


def test_mixed_rows_and_edges(spark):
    rows = [(*r, 1) for r in documents()]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(df).collect()}
    out = mixing.mixed(df)
    count = Counter(r.doc_id for r in out.collect())
    assert out.columns == df.columns and all(count[i] == (int(t / n + 0.5) if n else 0) for i, (t, n) in taken.items())
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, None, ""), (1, None, "")], "doc_id long, source string, text string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(odd).collect()] == [(0, 0.0, 0)] * 3


def test_shards_are_even_and_slots_gapless(spark):
    rows = [(i, "é" * (i % 50)) for i in range(2000)] + [(None, None), (5, "x"), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as size")
    got = shard(df).collect()
    load, places = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert len(got) == len(rows) and set(load) == set(range(16)) and max(load.values()) - min(load.values()) < 60
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    texts = {i: t for i, t in rows}
    for r in got:
        if r.doc_id != 5:
            body = (texts[r.doc_id] or "").encode()
            assert r.size == len(body) + 1 and r.text_crc32 == zlib.crc32(body) and r.law == "bytes" and r.grown_shard is None
    assert sorted(map(tuple, shard(df.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert shard(df.limit(0)).count() == 0


def test_slot_maps_are_edited_in_versions(spark, tmp_path):
    rng = random.Random(1)
    weight = [rng.randint(0, 100) for _ in range(512)]
    first = SlotMap.first(8, 512)
    even = first.rebalanced(weight)
    assert even.version == 2 and even.rebalanced(weight) == even
    load = [sum(w for w, s in zip(weight, even.shard_of, strict=True) if s == k) for k in range(8)]
    assert max(load) - min(load) <= 2
    grown = even.grown(weight)
    moved = [(a, b) for a, b in zip(even.shard_of, grown.shard_of, strict=True) if a != b]
    assert moved and all(b == 8 for _, b in moved) and grown.version == 3
    part = sum(w for w, s in zip(weight, grown.shard_of, strict=True) if s == 8)
    assert abs(part - sum(weight) / 9) < 0.1 * sum(weight) / 9
    for m in (first, even, grown):
        m.save(spark, str(tmp_path / "map"))
    assert SlotMap.load(spark, str(tmp_path / "map")) == grown and SlotMap.load(spark, str(tmp_path / "map"), 2) == even


def test_shards_are_those_of_plain_loops(spark):
    """Slots' bytes, the moves between shards and every row's place, from the virtual slots alone."""
    rng = random.Random(12)
    rows = [(rng.choice([None, i]), rng.choice([None, "", "é" * rng.randrange(400), "same"])) for i in range(900)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), 5, 64).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 1) for i, t in rows)
    held, lies = Counter(), {s: s % 5 for s in range(64)}
    for r in got:
        held[r.virtual_slot] += r.size
    while True:
        load = {k: sum(held[s] for s in lies if lies[s] == k) for k in range(5)}
        high, low = max(load, key=lambda k: (load[k], -k)), min(load, key=lambda k: (load[k], k))
        able = [s for s in lies if lies[s] == high and 0 < held[s] < load[high] - load[low]]
        if not able:
            break
        lies[min(able, key=lambda s: (abs(load[high] - load[low] - 2 * held[s]), s))] = low
    assert all(r.shard == lies[r.virtual_slot] for r in got)
    order = sorted(got, key=lambda r: (r.virtual_slot, r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32))
    places = Counter()
    for r in order:
        same = [x.slot for x in got if x[:3] == r[:3] and x.virtual_slot == r.virtual_slot]
        assert places[r.shard] in same
        places[r.shard] += 1


def test_each_run_edits_the_stored_map(spark, tmp_path):
    home = str(tmp_path / "maps")
    df = spark.createDataFrame([(i, "x" * (i % 90)) for i in range(600)], "doc_id long, text string")
    first = shard(df, 4, 128, home=home).collect()
    assert {r.map_version for r in first} == {2} and SlotMap.load(spark, home).version == 2
    assert sorted(shard(df, 4, 128, home=home).collect()) == sorted(first) and SlotMap.load(spark, home).version == 2
    more = df.unionByName(df.selectExpr("doc_id + 1000 as doc_id", "repeat('y', 300) as text"))
    later = {r.doc_id: r for r in shard(more, 4, 128, home=home).collect()}
    assert {r.map_version for r in later.values()} == {3} and SlotMap.load(spark, home, 2).version == 2
    assert sum(later[r.doc_id].shard == r.shard for r in first) > len(first) / 3


def test_rows_of_one_doc_id_or_none_are_spread(spark):
    df = spark.createDataFrame([(None, f"text {i}") for i in range(1000)] + [(7, f"other {i}") for i in range(1000)], "doc_id long, text string")
    got = shard(df).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert len(got) == 2000 and len({r.virtual_slot for r in got}) > 1000 and max(load.values()) - min(load.values()) < 30


def test_very_long_texts(spark):
    long = "é word " * 700_000
    df = spark.createDataFrame([(1, "a", long), (2, "a", "x y"), (3, "b", long)], "doc_id long, source string, text string")
    assert {r.doc_id: r.size for r in mixing.mix(df).collect()} == {1: 1_400_000, 2: 2, 3: 1_400_000}
    assert {r.doc_id: r.size for r in shard(df).collect()} == {1: len(long.encode()) + 1, 2: 4, 3: len(long.encode()) + 1}


def test_repeated_ids_of_other_texts_are_rows_of_their_own(spark):
    rows = [(5, "a", "one two three"), (5, "a", "four"), (5, "b", "five six"), (5, "a", "one two three")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert sorted(r.size for r in got) == [1, 2, 3, 3] and all(0 <= r.taken <= 3 * r.size for r in got)
