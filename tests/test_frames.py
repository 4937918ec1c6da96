import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelark.functions import vector
from cuelark.functions.timebase import TimeBase, format_timestamp
from cuelark.operators import frames as fr
from cuelark.operators import intervals as it
from cuelark.sinks import subtitles

SCHEMA = "video_id long, pts long, frame_idx long, on boolean, x double, v array<double>"


def rows(seed=1, videos=8, most=45):
    rng = random.Random(seed)
    out = []
    for video in range(videos):
        on, pts = rng.random() < 0.5, 0
        for i in range(rng.randint(1, most)):
            on = on if rng.random() < 0.75 else not on
            pts += rng.choice([0, 1, 7])
            out.append((video, pts, i, on, float(rng.choice([0, 1, 5, 20])), [float(rng.randint(0, 3)) for _ in range(3)]))
    return out


def by_video(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return out


def scan_noise(flags, value, least):
    """Left to right: a short visible run is flipped, edges are left alone."""
    flags, n = list(flags), len(flags)
    for i in range(n):
        if i < least or i + least > n - 1 or flags[i] != value:
            continue
        length = 1
        for step in (-1, 1):
            for d in range(1, least + 1):
                if flags[i + step * d] != value:
                    break
                length += 1
        if length < least:
            # The whole run lies in view; the rest of it is flipped for the same reason.
            j = i
            while j < n and flags[j] == value:
                if j >= least and j + least <= n - 1:
                    flags[j] = not value
                j += 1
    return flags


@pytest.mark.parametrize("value", [True, False])
@pytest.mark.parametrize("least", [1, 2, 3, 10])
def test_remove_noise_is_the_sequential_scan(spark, value, least):
    data = rows(least)
    got = fr.remove_noise(spark.createDataFrame(data, SCHEMA), "on", value, least).collect()
    got = {(r.video_id, r.frame_idx): r.on for r in got}
    for video, own in by_video(data).items():
        want = scan_noise([r[3] for r in own], value, least)
        assert [got[video, r[2]] for r in own] == want


def test_remove_noise_is_idempotent_and_keeps_nulls_as_false(spark):
    df = spark.createDataFrame([(1, i, i, None if i == 3 else True, 0.0, None) for i in range(9)], SCHEMA)
    once = fr.remove_noise(df, "on", False, 2)
    assert {r.frame_idx for r in once.where("not on").collect()} == set()
    assert sorted(map(str, fr.remove_noise(once, "on", False, 2).collect())) == sorted(map(str, once.collect()))


@pytest.mark.parametrize(("window", "inverse", "spread"), [(3, False, 0.0), (5, True, 0.0), (5, False, 6.0)])
def test_feature_jumps(spark, window, inverse, spread):
    data = rows(4)
    df = spark.createDataFrame(data, SCHEMA)
    scalar = {(r.video_id, r.frame_idx): r.j for r in fr.feature_jump(df, "x", "j", vector.falling, 3.0, window, inverse, spread, 2.0).collect()}
    vectors = {(r.video_id, r.frame_idx): r.j for r in fr.vector_jump(df, "v", "j", 3, vector.l2, 1.2, window, inverse, spread / 6, 1.0).collect()}
    for video, own in by_video(data).items():
        x = np.array([r[4] for r in own] + [2.0] * window)
        v = np.array([r[5] for r in own] + [[1.0] * 3] * window)
        for i in range(len(own)):
            a, b = x[i + 1 : i + 1 + window], v[i + 1 : i + 1 + window]
            want = (x[i] - a.mean() >= 3.0) != inverse
            assert scalar[video, i] == (False if spread and a.std() > spread else want)
            want = (np.linalg.norm(v[i] - b.mean(0)) >= 1.2) != inverse
            assert vectors[video, i] == (False if spread and b.std(0).mean() > spread / 6 else want)


def test_shift_break_and_conjunction(spark):
    df = spark.createDataFrame([(1, i, i, i % 2 == 0, float(i), None) for i in range(5)], SCHEMA)
    assert [r.s for r in fr.shift(df, "s", "x", 2, -1.0).orderBy("frame_idx").collect()] == [-1, -1, 0, 1, 2]
    assert [r.s for r in fr.shift(df, "s", "x", -1, -1.0).orderBy("frame_idx").collect()] == [1, 2, 3, 4, -1]
    df = df.withColumn("jump", F.col("x") == 2)
    assert [r.on for r in fr.break_on(df, "on", "jump").orderBy("frame_idx").collect()] == [True, False, False, False, True]
    assert fr.conjunction(df, "both", "on", "jump").where("both").count() == 1


def test_intervals_cover_exactly_the_set_frames(spark):
    data = rows(7)
    got = fr.build_intervals(spark.createDataFrame(data, SCHEMA), ["on"], "v", 3).collect()
    want = []
    for video, own in by_video(data).items():
        begin = None
        for i, r in enumerate(own):
            if r[3] and begin is None:
                begin, total, n = r[1], np.zeros(3), 0
            if r[3]:
                total, n = total + r[5], n + 1
            if begin is not None and (not r[3] or i == len(own) - 1):
                want.append((video, begin, r[1], n, total.tolist()))
                begin = None
    assert sorted((r.video_id, r.begin, r.end, r.n_points, r.feat_sum) for r in got) == sorted(want)
    assert fr.build_intervals(spark.createDataFrame([], SCHEMA), ["on"]).count() == 0


def test_golden_example(spark):
    base = TimeBase(1, 90_000)
    data = [(1, 3000 * i, i, c == "T", 0.0, None) for i, c in enumerate("FFTTTFTTFFFT")]
    built = fr.build_intervals(spark.createDataFrame(data, SCHEMA).withColumnRenamed("on", "Dialog"), ["Dialog"])
    assert [(r.begin, r.end) for r in built.orderBy("seq").collect()] == [(6000, 15000), (18000, 24000), (33000, 33000)]
    filled = it.fill_gap(built, "Dialog", 300, 0.5, base)
    assert [(r.begin, r.end) for r in filled.orderBy("seq").collect()] == [(6000, 16500), (16500, 28500), (28500, 33000)]
    assert [r.line for r in subtitles.subtitle_lines(filled, base).orderBy("ord").collect()] == [
        "Dialogue: 0,00:00:00.06,00:00:00.18,Default,,0,0,0,,Subtitle_Dialog_0",
        "Dialogue: 0,00:00:00.18,00:00:00.31,Default,,0,0,0,,Subtitle_Dialog_1",
        "Dialogue: 0,00:00:00.31,00:00:00.36,Default,,0,0,0,,Subtitle_Dialog_2",
    ]


def test_clock_text(spark):
    base = TimeBase(1, 90_000)
    ticks = {0: "00:00:00.00", 899: "00:00:00.00", 900: "00:00:00.01", 1800: "00:00:00.02", 86_399 * 90_000 + 89_100: "23:59:59.99", 90_000 * 90_000: "01:00:00.00"}
    got = spark.createDataFrame([(t,) for t in ticks], "t long").select("t", format_timestamp(F.col("t"), base).alias("c")).collect()
    assert {r.t: r.c for r in got} == ticks
    assert base.ticks(300) == 27_000 and TimeBase(1001, 30_000).ticks(1000) == 29


def test_segments_with_halos_see_the_same(spark):
    data = [r for r in rows(3, 3, 60)]
    df = spark.createDataFrame(data, SCHEMA)
    whole = {(r.video_id, r.frame_idx): r.j for r in fr.feature_jump(df, "x", "j", least=3.0, window=3, default=2.0).collect()}
    dealt = fr.with_halo(df, 7, 0, 3)
    assert dealt.where("own").count() == len(data)
    parts = dealt.withColumn("ahead", F.avg("x").over(fr.in_order("segment").rowsBetween(1, 3))).withColumn("n", F.count("x").over(fr.in_order("segment").rowsBetween(1, 3))).where("own")
    got = {(r.video_id, r.frame_idx): abs(r.x - (((r.ahead or 0) * r.n + 2.0 * (3 - r.n)) / 3)) >= 3.0 for r in parts.collect()}
    assert got == whole


@pytest.mark.parametrize("value,least", [(True, 1), (True, 2), (True, 5), (False, 3), (False, 10), (True, 40)])
def test_noise_is_that_of_a_plain_loop(spark, value, least):
    rng = np.random.default_rng(least)
    rows, want = [], []
    for video, n in ((1, 0), (2, 1), (3, 2 * least), (4, 2 * least + 1), (5, 120), (6, 33)):
        on = [None if x < 0.1 else bool(x < 0.1 + 0.9 * p) for x, p in zip(rng.random(n), np.repeat(rng.random(n), rng.integers(1, 9, n))[:n] if n else [], strict=True)]
        rows += [(video, i * 10 - i % 2 * 10, i, x) for i, x in enumerate(on)]
        plain = [bool(x) for x in on]
        out, a = list(plain), 0
        for b in range(1, n + 1):
            if b == n or plain[b] != plain[a]:
                if plain[a] == value and b - a < least:
                    for i in range(a, b):
                        if least <= i <= n - 1 - least:
                            out[i] = not value
                a = b
        want += [(video, i, x) for i, x in enumerate(out)]
    df = spark.createDataFrame(rows, "video_id long, pts long, frame_idx long, f boolean").repartition(3)
    got = fr.remove_noise(df, "f", value, least)
    assert got.columns == df.columns
    assert sorted((r.video_id, r.frame_idx, r.f) for r in got.collect()) == want


def test_noise_needs_no_order_of_its_own(spark):
    """Each sort of a task holds memory of its own: of eight steps all but the first need none."""
    df = spark.createDataFrame([(1, i, i, i % 3 > 0, i % 5 > 0) for i in range(50)], "video_id long, pts long, frame_idx long, f boolean, g boolean")
    sorts = lambda x: x._jdf.queryExecution().executedPlan().toString().count("Sort [")
    many = df
    for flag in ("f", "g"):
        for value, least in ((False, 2), (True, 10), (False, 3), (True, 4)):
            many = fr.remove_noise(many, flag, value, least)
    assert sorts(many) == sorts(fr.shift(df, "s", "f", 1, False)) == 1


@pytest.mark.parametrize(("name", "most"), [("plan_mr", 13), ("plan_mr_s0", 11)])
def test_plans_with_noise_sort_few_times(spark, name, most):
    """The noise steps add none: 29 and 25 sorts before."""
    from cuelark.plans import catalogue

    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Sort [") <= most
