"""Adaptive sampling: look at key frames first, then only where they differ.

Grows a video's intervals from sparse looks. Two key frames alike are taken as one
interval without a look between; where they differ the gap is halved until no
frame is left in it. A look is compared with the mean of all looks of an interval,
so the order of looks matters: the state of one video is sequential, and videos are
parallel. What travels to the grower are feature columns, or only what is needed to
fetch a frame: a look then reads and analyses that one frame, and no other is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelark.functions.timebase import MICROS, TimeBase

GROWN = "video_id long, main_flag string, begin long, end long, style string, n_points int, feat_sum array<double>, first_main boolean, ocr_pts long, seq long, n_frames long, n_decoded long, n_analysed long"

_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in GROWN.split(", ")])

#: Whether a frame, by its place, has the main flag, and its feature.
Look = Callable[[int], tuple[bool, np.ndarray]]


@dataclass
class Grown:
    """An interval and the sum of its looks."""

    begin: int
    end: int
    total: np.ndarray
    looks: int
    first_main: bool
    first_pts: int

    def away(self, t: int) -> int:
        return max(self.begin - t, t - self.end, 0)

    def take(self, t: int, feature: np.ndarray) -> None:
        self.begin, self.end = min(self.begin, t), max(self.end, t)
        self.total = self.total + feature
        self.looks += 1


@dataclass
class Video:
    """One video's frames in order, and the intervals grown so far, in order."""

    pts: np.ndarray
    key: np.ndarray
    fetch: Look
    threshold: float
    empty_reach: int
    grown: list[Grown] = field(default_factory=list)
    seen: dict[int, tuple[bool, np.ndarray]] = field(default_factory=dict)

    def look(self, i: int) -> tuple[bool, np.ndarray]:
        if i not in self.seen:
            self.seen[i] = self.fetch(i)
        return self.seen[i]

    @property
    def analysed(self) -> int:
        return len(self.seen)

    @property
    def decoded(self) -> int:
        """Frames that a decoder goes through: of each key segment those up to its last look."""
        last: dict[int, int] = {}
        for i in self.seen:
            begin = int(self.begins[i])
            last[begin] = max(i, last.get(begin, begin))
        return sum(i - begin + 1 for begin, i in last.items())

    def __post_init__(self):
        at = np.arange(len(self.pts))
        self.begins = np.maximum.accumulate(np.where(self.key, at, 0))

    def joins(self, interval: Grown, i: int, gated: bool = True) -> bool:
        """Whether frame i belongs to the interval: alike, and if empty, not too far."""
        _, f = self.look(i)
        alike = float(np.linalg.norm(interval.total / interval.looks - f)) < self.threshold
        return alike and not (gated and not f.any() and interval.away(int(self.pts[i])) > self.empty_reach)

    def insert(self, place: int, i: int) -> None:
        t = int(self.pts[i])
        self.grown.insert(place, Grown(t, t, self.look(i)[1].astype(float), 1, self.look(i)[0], t))

    def reach(self, i: int, gated: bool = True) -> None:
        """The next key frame: part of the last interval or a new one."""
        if self.grown and self.joins(self.grown[-1], i, gated):
            self.grown[-1].take(int(self.pts[i]), self.look(i)[1])
        else:
            self.insert(len(self.grown), i)

    def settle(self, k: int) -> None:
        """Closes every gap from interval k on by halving."""
        while k + 1 < len(self.grown):
            left, right = self.grown[k], self.grown[k + 1]
            if left.end >= right.begin:
                k += 1
                continue
            a, b = np.searchsorted(self.pts, left.end, "right"), np.searchsorted(self.pts, right.begin, "left")
            if a >= b:
                left.end = right.begin
                continue
            middle = left.end + (right.begin - left.end) // 2
            at = int(np.searchsorted(self.pts[a:b], middle)) + a
            near = [i for i in (at - 1, at) if a <= i < b]
            i = min(near, key=lambda j: (abs(int(self.pts[j]) - middle), j))
            if self.joins(left, i):
                left.take(int(self.pts[i]), self.look(i)[1])
            elif self.joins(right, i):
                right.take(int(self.pts[i]), self.look(i)[1])
            else:
                self.insert(k + 1, i)

    def run(self) -> list[Grown]:
        """Grows all intervals: from key frame to key frame, and at last to the final frame."""
        keys = [0, *[int(i) for i in np.flatnonzero(self.key) if i > 0]]
        if keys[-1] != len(self.pts) - 1:
            keys.append(len(self.pts) - 1)
        for n, i in enumerate(keys):
            before = max(len(self.grown) - 1, 0)
            self.reach(i, gated=n > 1)
            self.settle(before)
        return self.grown


def sparse_looks(frames: DataFrame, look_of: Callable[[pd.DataFrame], Look], flag: str, threshold: float, empty_gap: int = 0, base: TimeBase = MICROS) -> DataFrame:
    """Intervals grown from ``frames(video_id, pts, frame_idx, is_key, ...)`` by looks, and a row of seq -1 a video that tells its work.

    ``look_of`` gets a video's rows in order and gives the function that fetches and
    analyses one of them by its place; it is called for the frames looked at only.
    See ``speculative_intervals``.
    """
    # The rows are small and the looks dear: a stated number of partitions, so that none are put together by their bytes.
    spark = frames.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = frames.repartition(parts, "video_id").sortWithinPartitions("video_id", "pts", F.asc_nulls_last("frame_idx"))
    return dealt.mapInArrow(partial(_looks, look_of=look_of, flag=flag, threshold=threshold, reach=base.ticks(empty_gap)), GROWN)


def _starts(video: list) -> list[int]:
    """Where a run of equal ids begins."""
    return [i for i, v in enumerate(video) if not i or v != video[i - 1]]


def _videos(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, pd.DataFrame]]]:
    """Whole videos of rows sorted by video, those that end with a batch together; only the last one is held."""
    held: list[pd.DataFrame] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        video, rows = batch.column("video_id").to_pylist(), batch.to_pandas()
        starts = _starts(video)
        out = []
        for a, b in zip(starts, [*starts[1:], len(video)], strict=True):
            if held and video[a] != name:
                out.append((name, held[0] if len(held) == 1 else pd.concat(held)))
                held = []
            name = video[a]
            held.append(rows.iloc[a:b])
        yield out
    if held:
        yield [(name, pd.concat(held))]


def _looks(batches: Iterator[pa.RecordBatch], look_of: Callable[[pd.DataFrame], Look], flag: str, threshold: float, reach: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``sparse_looks`` for sorted frames; a batch of many short videos is one of results, too."""
    for videos in _videos(batches):
        rows = []
        for name, pdf in videos:
            pts = pdf["pts"].to_numpy(np.int64)
            first = np.append(True, pts[1:] != pts[:-1])
            if not first.all():
                pdf, pts = pdf[first], pts[first]
            pdf.index = pd.RangeIndex(len(pts))
            video = Video(pts, pdf["is_key"].fillna(False).to_numpy(bool), look_of(pdf), threshold, reach)
            found = [g for g in video.run() if g.first_main]
            work = len(pts), video.decoded, video.analysed
            rows += [(name, flag, g.begin, g.end, "Default", g.looks, g.total.tolist(), True, g.first_pts, k, *work) for k, g in enumerate(found)]
            rows.append((name, flag, 0, 0, "Default", 0, [], False, 0, -1, *work))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)


def by_features(frames: DataFrame, flag: str, feature: str, threshold: float, empty_gap: int = 0, base: TimeBase = MICROS) -> DataFrame:
    """``sparse_looks`` at frames whose flag and feature are columns."""

    def look_of(pdf: pd.DataFrame) -> Look:
        main, feature = pdf["main"].fillna(False).to_numpy(bool), pdf["feature"]
        return lambda i: (bool(main[i]), np.asarray(feature[i], float))

    slim = frames.select("video_id", "pts", "frame_idx", "is_key", F.col(flag).alias("main"), F.col(feature).cast("array<double>").alias("feature")).where("feature is not null")
    return sparse_looks(slim, look_of, flag, threshold, empty_gap, base)


def grown(looks: DataFrame) -> DataFrame:
    """The intervals of ``sparse_looks``."""
    return looks.where("seq >= 0")


def looked_at(looks: DataFrame) -> DataFrame:
    """(n_frames, n_decoded, n_analysed) over all videos of ``sparse_looks``, with or without intervals."""
    return looks.where("seq = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_frames", "n_decoded", "n_analysed")])


def speculative_intervals(frames: DataFrame, flag: str, feature: str, threshold: float, empty_gap: int = 0, base: TimeBase = MICROS) -> DataFrame:
    """Intervals grown from ``frames(video_id, pts, frame_idx, is_key, <flag>, <feature>)``.

    ``feature`` is an array of doubles. Two looks are alike if the distance of a
    look to an interval's mean is below ``threshold``; a look of all zeros farther
    than ``empty_gap`` ms from an interval never joins it. Intervals whose first
    look lacks the flag are dropped. ``n_frames``, ``n_decoded`` and ``n_analysed``
    tell how much was looked at. Frames of equal pts are one, the first. A video
    without key frames has its first and last frame; an empty table gives an empty
    one. Not equal to the framewise result by design: what lies between alike key
    frames is never seen.
    """
    return grown(by_features(frames, flag, feature, threshold, empty_gap, base))


def key_segments(frames: DataFrame) -> DataFrame:
    """(video_id, segment, begin, end): each key frame and the next one, or the video's last frame."""
    order = Window.partitionBy("video_id").orderBy("pts", "frame_idx")
    last = frames.groupBy("video_id").agg(F.max("pts").alias("_last"))
    keys = frames.where("is_key").join(last, "video_id")
    return keys.select("video_id", (F.row_number().over(order) - 1).cast("long").alias("segment"), F.col("pts").alias("begin"), F.coalesce(F.lead("pts").over(order), "_last").alias("end"))


def nearest_frame(frames: DataFrame, low: int, centre: int, high: int) -> DataFrame:
    """(video_id, frame_idx, pts): per video the frame in [low, high) nearest to ``centre``, the earlier on a tie."""
    inside = frames.where((F.col("pts") >= low) & (F.col("pts") < high))
    best = inside.groupBy("video_id").agg(F.min_by(F.struct("frame_idx", "pts"), F.struct(F.abs(F.col("pts") - centre), "pts", "frame_idx")).alias("f"))
    return best.select("video_id", "f.frame_idx", "f.pts")


def simulate(pts: list[int], key: list[bool], feature: list[float], threshold: float) -> Iterator[tuple[int, int]]:
    """Begins and ends for scalar features of one video, without Spark."""
    f = np.array(feature, float)[:, None]
    for g in Video(np.array(pts), np.array(key), lambda i: (True, f[i]), threshold, 1 << 60).run():
        yield g.begin, g.end
