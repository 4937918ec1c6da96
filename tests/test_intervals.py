import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelark.functions.timebase import TimeBase
from cuelark.operators import intervals as it
from cuelark.operators import speculative as sp

MS = TimeBase(1, 1000)
SCHEMA = "video_id long, main_flag string, begin long, end long, style string, n_points int, feat_sum array<double>, seq long"


def rows(seed, n=12, flags=("a", "b"), apart=True):
    """Intervals in order; those of one flag neither touch nor overlap if ``apart``."""
    rng = random.Random(seed)
    out = []
    for video in range(4):
        own = []
        for flag in flags:
            t = 0
            for _ in range(n):
                t += rng.randint(1 if apart else 0, 30)
                b, t = t, t + rng.randint(0, 20)
                own.append((video, flag, b, t, "Default", 1, [float(rng.randint(0, 9))]))
        own.sort(key=lambda r: r[2])
        out += [(*r, i) for i, r in enumerate(own)]
    return out


def ordered(df):
    return [(r.video_id, r.main_flag, r.begin, r.end) for r in df.orderBy("video_id", "seq").collect()]


def videos(data):
    return [[list(r) for r in data if r[0] == v] for v in sorted({r[0] for r in data})]


def plain_fill(own, flag, most, meet):
    for i, x in enumerate(own):
        if x[1] != flag:
            continue
        for y in own[i + 1 :]:
            if y[1] != flag:
                continue
            gap = y[2] - x[3]
            if gap > most:
                break
            if gap > 0:
                x[3] = y[2] = int(x[3] * (1 - meet) + y[2] * meet)
                break
    return sorted(own, key=lambda r: r[2])


@pytest.mark.parametrize("meet", [0.0, 0.5, 1.0])
def test_fill_gap(spark, meet):
    data = rows(1)
    df = spark.createDataFrame(data, SCHEMA)
    want = [tuple(r[:4]) for own in videos(data) for r in plain_fill(own, "a", 12, meet)]
    assert ordered(it.fill_gap(df, "a", 12, meet, MS)) == want == ordered(it.fill_gap_sequential(df, "a", 12, meet, MS))


def test_sequential_fill_sees_touching_neighbours(spark):
    data = rows(2, apart=False)
    want = [tuple(r[:4]) for own in videos(data) for r in plain_fill(own, "a", 12, 0.5)]
    assert ordered(it.fill_gap_sequential(spark.createDataFrame(data, SCHEMA), "a", 12, 0.5, MS)) == want


def test_extend(spark):
    data, want = rows(3), []
    for own in videos(data):
        for i, x in enumerate(own):
            if x[1] == "a":
                x[2] = max(x[2] - 5, own[i - 1][3] if i else 0)
                x[3] = min(x[3] + 9, own[i + 1][2]) if i + 1 < len(own) else x[3] + 9
        want += [tuple(r[:4]) for r in own]
    assert ordered(it.extend(spark.createDataFrame(data, SCHEMA), "a", 5, 9, MS)) == want


def test_align(spark):
    data, want = rows(4), []
    for own in videos(data):
        points = sorted({t for r in own if r[1] == "b" for t in r[2:4]})
        snap = lambda t: (p := min(points, key=lambda q: (abs(q - t), q))) if abs(p := min(points, key=lambda q: (abs(q - t), q))) is not None and abs(p - t) <= 6 else t  # noqa: E731,B023
        for r in own:
            if r[1] == "a":
                r[2], r[3] = snap(r[2]), snap(r[3])
        want += [tuple(r[:4]) for r in sorted(own, key=lambda r: r[2])]
    assert ordered(it.align(spark.createDataFrame(data, SCHEMA), "a", "b", 6, MS)) == want
    alone = spark.createDataFrame([r for r in data if r[1] == "a"], SCHEMA)
    assert ordered(it.align(alone, "a", "b", 6, MS)) == ordered(it.resort(alone))


def test_filters_offset_and_numbers(spark):
    df = spark.createDataFrame([(1, "a", 0, 9, "s", 1, None, 0), (1, "a", 10, 20, "s", 1, None, 1), (1, "b", 11, 22, None, 1, None, 2)], SCHEMA)
    assert ordered(it.denoise(df, "a", 10, MS)) == [(1, "a", 10, 20), (1, "b", 11, 22)]
    assert it.remove(df, F.col("style") == "s").count() == 1 and it.with_flag(df, "b").count() == 1
    assert ordered(it.offset(df, -5))[0] == (1, "a", -5, 4)
    assert [r.name for r in it.numbered(df).orderBy("seq").collect()] == ["Subtitle_a_0", "Subtitle_a_1", "Subtitle_b_0"]
    assert [r.midpoint for r in it.midpoints(df).orderBy("midpoint").collect()] == [4, 15, 16]
    assert it.append(df, df).count() == 6 and it.append(df, df).select("seq").distinct().count() == 6


def test_merge_folds_with_what_has_gathered(spark):
    data = [(1, "a", 10 * i, 10 * i + 5, "x", 1, [float(f)], i) for i, f in enumerate([0, 3, 6, 9, 0, 1])]
    got = it.merge(spark.createDataFrame(data, SCHEMA), it.alike_features(4.0)).orderBy("seq").collect()
    # 0 and 3 join (mean 1.5), 6 is 4.5 away, 9 joins it, 0 and 1 are of their own.
    assert [(r.begin, r.end, r.n_points, r.feat_sum, r.style) for r in got] == [(0, 15, 2, [3.0], "Default"), (20, 35, 2, [15.0], "Default"), (40, 55, 2, [1.0], "Default")]


def test_pairs_within_are_all_pairs(spark):
    data = rows(6, 8)
    got = {(r.video_id, r.seq_a, r.seq_b) for r in it.pairs_within(spark.createDataFrame(data, SCHEMA), 16).collect()}
    want = {(a[0], a[7], b[7]) for a in data for b in data if a[0] == b[0] and a[7] < b[7] and (a[2] - b[3] if a[2] > b[2] else b[2] - a[3]) <= 0}
    assert got == want and want


def test_nearest_centroid_and_colours(spark):
    df = spark.createDataFrame([(1, 255.0, 0.0, 0.0), (2, 0.0, 255.0, 0.0), (3, 10.0, 10.0, 10.0)], "i int, b double, g double, r double")
    x, y = it.hue_saturation_point(F.col("b"), F.col("g"), F.col("r"))
    df = df.withColumns({"x": x, "y": y})
    got = df.select("i", it.nearest_centroid(F.col("x"), F.col("y"), {"blue": (np.cos(np.radians(240)), np.sin(np.radians(240))), "grey": (0.0, 0.0)}, 0.2, "other").alias("n")).collect()
    assert {r.i: r.n for r in got} == {1: "blue", 2: "other", 3: "grey"}


def test_sparse_looks_find_every_change():
    rng = random.Random(9)
    for _ in range(60):
        spans, t, feature = [], 0, []
        for k in range(rng.randint(1, 6)):
            n = rng.randint(70, 200)
            spans.append((t, t + n))
            feature += [float(k * 10)] * n
            t += n
        key = [i % 60 == 0 for i in range(t)]
        got = list(sp.simulate([3 * i for i in range(t)], key, feature, 1.0))
        assert got == [(3 * a, 3 * min(b, t - 1)) for a, b in spans]


def model(pts, key, feature, threshold, reach):
    """The same growth told otherwise: lists of looks, gaps closed by recursion."""
    found, looked = [], []

    def fits(own, i, gated):
        mean = [sum(feature[j][c] for j in own["looks"]) / len(own["looks"]) for c in range(len(feature[i]))]
        near = sum((a - b) ** 2 for a, b in zip(mean, feature[i], strict=True)) ** 0.5 < threshold
        away = max(own["begin"] - pts[i], pts[i] - own["end"], 0)
        return near and not (gated and not any(feature[i]) and away > reach)

    def add(own, i):
        own["looks"].append(i)
        own["begin"], own["end"] = min(own["begin"], pts[i]), max(own["end"], pts[i])

    def new(i):
        return {"begin": pts[i], "end": pts[i], "looks": [i]}

    def close(left, right):
        """What lies between two neighbours, both of which may grow."""
        between = [i for i, t in enumerate(pts) if left["end"] < t < right["begin"]]
        if not between or left["end"] >= right["begin"]:
            left["end"] = max(left["end"], right["begin"])
            return []
        middle = left["end"] + (right["begin"] - left["end"]) // 2
        i = min(between, key=lambda j: (abs(pts[j] - middle), j))
        looked.append(i)
        if fits(left, i, True):
            add(left, i)
            return close(left, right)
        if fits(right, i, True):
            add(right, i)
            return close(left, right)
        inner = new(i)
        before = close(left, inner)
        # What was found before may have grown the new one; then the rest.
        return [*before, inner, *close(inner, right)]

    keys = sorted({0, len(pts) - 1, *(i for i, k in enumerate(key) if k)})
    for n, i in enumerate(keys):
        looked.append(i)
        if found and fits(found[-1], i, n > 1):
            add(found[-1], i)
            continue
        right = new(i)
        if found:
            found += close(found[-1], right)
        found.append(right)
    return [(x["begin"], x["end"], len(x["looks"])) for x in found], len(looked)


def test_growth_is_that_of_a_plain_model():
    rng = random.Random(21)
    for _ in range(150):
        n = rng.randrange(2, 90)
        pts = sorted(rng.sample(range(1000), n))
        level, feature = [0.0, 0.0], []
        for _ in range(n):
            if rng.random() < 0.15:
                level = rng.choice([[0.0, 0.0], [1.0, 0.0], [0.6, 0.8], [0.3, 0.1]])
            feature.append([x + rng.choice([0, 0, 0.05]) if any(level) else 0.0 for x in level])
        key = [rng.random() < 0.1 for _ in range(n)]
        for reach in (0, 60, 10**6):
            video = sp.Video(np.array(pts), np.array(key), lambda i, f=feature: (True, np.array(f[i])), 0.4, reach)
            got = [(g.begin, g.end, g.looks) for g in video.run()]
            want, looks = model(pts, key, feature, 0.4, reach)
            assert got == want and video.analysed == looks and looks <= video.decoded <= n


def test_speculative_operator(spark):
    data = [(1, 10 * i, i, i % 60 == 0, 100 <= i < 300, [1.0 if 100 <= i < 300 else 0.0]) for i in range(400)]
    df = spark.createDataFrame([*data, (2, 0, 0, True, True, [1.0])], "video_id long, pts long, frame_idx long, is_key boolean, on boolean, f array<double>")
    got = {r.video_id: r for r in sp.speculative_intervals(df, "on", "f", 0.5, 10_000_000, MS).collect()}
    assert (got[1].begin, got[1].end) == (1000, 3000) and got[1].n_analysed < 40 and got[1].n_frames == 400
    assert (got[2].begin, got[2].end) == (0, 0)
    assert sp.speculative_intervals(df.limit(0), "on", "f", 0.5).count() == 0
    dark = df.withColumn("on", F.lit(False))
    looks = sp.by_features(dark, "on", "f", 0.5, 10_000_000, MS)
    work = sp.looked_at(looks).first()  # videos without an interval count too
    assert sp.grown(looks).count() == 0 and work.n_frames == 401 and 0 < work.n_analysed < 42
    assert sp.looked_at(sp.by_features(df.limit(0), "on", "f", 0.5)).first() == (0, 0, 0)


def test_empty_looks_far_away_do_not_join(spark):
    data = [(1, 1000 * i, i, i in (0, 20), True, [0.0]) for i in range(21)]
    df = spark.createDataFrame(data, "video_id long, pts long, frame_idx long, is_key boolean, on boolean, f array<double>")
    assert sp.speculative_intervals(df, "on", "f", 0.5, 0, MS).first().n_analysed <= 21
    wide = sp.speculative_intervals(df, "on", "f", 0.5, 10**6, MS).collect()
    assert len(wide) == 1 and wide[0].n_analysed == 2
