"""Operators on ordered frame rows: window functions by video and time.

A frame table has video_id, pts (ticks) and frame_idx beside its flag columns.
Spark keeps no order, so every operator orders by (pts, frame_idx) itself. Each
returns its input with one column changed or added; rows never change in number.
Within one video only bounded neighbourhoods matter (``with_halo`` makes use of
that), so long videos can be worked on in segments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelark.functions import vector

VIDEO, TIME, INDEX = "video_id", "pts", "frame_idx"


def in_order(*more: str):
    """The window of a video's frames in order."""
    return Window.partitionBy(VIDEO, *more).orderBy(TIME, INDEX)


def every_nth(frames: DataFrame, n: int) -> DataFrame:
    """Keeps one frame in ``n``, counted over all frames of the video."""
    return frames.where(F.col(INDEX) % n == 0)


def remove_noise(frames: DataFrame, flag: str, value: bool = True, min_length: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Flips runs of ``value`` shorter than ``min_length`` frames.

    Frames within ``min_length`` of either end of the video are left alone. A null
    flag counts as false. ``min_length`` 1 changes nothing. All windows have the
    frames' own order, so that any number of these share one sort: a frame that has
    ``min_length`` frames after it lies in a short run only if the next run begins
    among them.
    """
    order, most = in_order(*by), max(min_length, 1)
    own = F.coalesce(F.col(flag), F.lit(False))
    marked = frames.withColumn("_on", own).withColumns({"_at": F.row_number().over(order), "_new": F.col("_on") != F.lag("_on", 1).over(order)})
    begins = F.when(F.coalesce("_new", F.lit(True)), F.col("_at"))
    length = F.min(begins).over(order.rowsBetween(1, most)) - F.max(begins).over(order.rowsBetween(Window.unboundedPreceding, 0))
    inner = F.lag(F.lit(1), most).over(order).isNotNull() & F.lead(F.lit(1), most).over(order).isNotNull()
    marked = marked.withColumns({"_length": length, "_inner": inner})
    flip = F.col("_inner") & (F.col("_on") == F.lit(value)) & F.coalesce(F.col("_length") < min_length, F.lit(False))
    return marked.withColumn(flag, F.when(flip, F.lit(not value)).otherwise(F.col("_on"))).drop("_on", "_at", "_new", "_length", "_inner")


def _marked(frames: DataFrame, dst: str, distance: Column, spread: Column | None, least: float, most_spread: float, inverse: bool) -> DataFrame:
    hit = distance >= least
    hit = ~hit if inverse else hit
    if most_spread > 0 and spread is not None:
        before = F.coalesce(F.col(dst), F.lit(False)) if dst in frames.columns else F.lit(False)
        hit = F.when(spread > most_spread, before).otherwise(hit)
    return frames.withColumn(dst, F.coalesce(hit, F.lit(False)))


def feature_jump(
    frames: DataFrame,
    feature: str,
    dst: str,
    distance: Callable[[Column, Column], Column] = vector.absolute,
    least: float = 0.5,
    window: int = 3,
    inverse: bool = False,
    most_spread: float = 0.0,
    default: float = 0.0,
) -> DataFrame:
    """Marks frames whose scalar feature lies ``least`` or more from the mean of the next ``window`` frames.

    Past the video's end the column's default stands in. With ``most_spread`` above
    0, frames before a window of a larger population standard deviation keep what
    ``dst`` has. Boolean features count as 0 and 1. The distance is called with the
    frame's own value and the mean.
    """
    f = F.col(feature).cast("double")
    ahead = in_order().rowsBetween(1, window)
    missing = (F.lit(window) - F.count(f).over(ahead)) * F.lit(float(default))
    mean = (F.coalesce(F.sum(f).over(ahead), F.lit(0.0)) + missing) / window
    spread = None
    if most_spread > 0:
        squares = F.coalesce(F.sum(f * f).over(ahead), F.lit(0.0)) + missing * F.lit(float(default))
        spread = F.sqrt(F.greatest(squares / window - mean * mean, F.lit(0.0)))
    return _marked(frames, dst, distance(f, mean), spread, least, most_spread, inverse)


def vector_jump(
    frames: DataFrame,
    feature: str,
    dst: str,
    size: int,
    distance: Callable[[Column, Column], Column] = vector.l2,
    least: float = 0.1,
    window: int = 5,
    inverse: bool = False,
    most_spread: float = 0.0,
    default: float = 0.0,
) -> DataFrame:
    """``feature_jump`` for features of ``size`` components; the spread is averaged over them."""
    ahead = F.collect_list(F.col(feature).cast("array<double>")).over(in_order().rowsBetween(1, window))
    filler = F.array_repeat(F.array_repeat(F.lit(float(default)), size), F.lit(window) - F.size("_ahead"))
    rows = frames.withColumn("_ahead", ahead).withColumn("_ahead", F.concat("_ahead", filler)).withColumn("_mean", vector.mean_of(F.col("_ahead"), size))
    spread = vector.spread_of(F.col("_ahead"), size) if most_spread > 0 else None
    return _marked(rows, dst, distance(F.col(feature), F.col("_mean")), spread, least, most_spread, inverse).drop("_ahead", "_mean")


def shift(frames: DataFrame, dst: str, ref: str, by: int, padding) -> DataFrame:
    """``dst`` takes the value of ``ref`` ``by`` frames earlier (later if negative), else the padding."""
    at = F.lag(ref, by, padding) if by >= 0 else F.lead(ref, -by, padding)
    return frames.withColumn(dst, at.over(in_order()))


def break_on(frames: DataFrame, flag: str, *jumps: str) -> DataFrame:
    """Clears a flag where any of the jumps is set."""
    keep = F.coalesce(F.col(flag), F.lit(False))
    for jump in jumps:
        keep = keep & ~F.coalesce(F.col(jump), F.lit(False))
    return frames.withColumn(flag, keep)


def prioritise(frames: DataFrame, flag: str, over: str) -> DataFrame:
    """Clears a flag where the one of higher priority is set."""
    return break_on(frames, flag, over)


def conjunction(frames: DataFrame, dst: str, *flags: str) -> DataFrame:
    """``dst`` is set where all flags are."""
    every = F.lit(True)
    for flag in flags:
        every = every & F.coalesce(F.col(flag), F.lit(False))
    return frames.withColumn(dst, every)


def build_intervals(frames: DataFrame, flags: list[str], feature: str | None = None, size: int = 0, keep: dict[str, Column] | None = None) -> DataFrame:
    """Maximal runs of true frames of each flag as labelled intervals.

    An interval begins at its first frame and ends at the first frame after it
    where the flag is false, or at the video's last frame. Columns: video_id,
    main_flag, begin, end, style, n_points, first_pts, seq (order of emission: by
    closing frame, then by the flag's place), with ``feat_sum`` of a vector
    ``feature`` of ``size`` components and any further aggregates in ``keep``.
    """
    order = in_order()
    extra = {feature} if feature else set()
    rows = frames.withColumns({"_at": F.row_number().over(order), "_next": F.lead(TIME).over(order)})
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f).alias("flag"), F.coalesce(F.col(f), F.lit(False)).alias("on")) for i, f in enumerate(flags)]))
    long = rows.withColumn("_f", each).where("_f.on")
    run = F.col("_at") - F.row_number().over(Window.partitionBy(VIDEO, "_f.place").orderBy("_at"))
    aggs = [F.min(TIME).alias("begin"), F.max(F.coalesce("_next", TIME)).alias("end"), F.count("*").alias("n_points"), F.max("_at").alias("_last")]
    if extra:
        parts = [F.sum(F.element_at(F.col(feature), i + 1).cast("double")) for i in range(size)]
        aggs.append(F.array(*parts).alias("feat_sum"))
    aggs += [c.alias(n) for n, c in (keep or {}).items()]
    found = long.withColumn("_run", run).groupBy(VIDEO, F.col("_f.place").alias("_place"), F.col("_f.flag").alias("main_flag"), "_run").agg(*aggs)
    seq = F.row_number().over(Window.partitionBy(VIDEO).orderBy("_last", "_place")) - 1
    return found.withColumns({"style": F.lit("Default"), "first_pts": F.col("begin"), "seq": seq.cast("long")}).drop("_place", "_run", "_last")


def with_halo(frames: DataFrame, rows: int, before: int, after: int) -> DataFrame:
    """Deals each video out in segments of ``rows`` frames with the neighbours that they look at.

    Adds ``segment`` and ``own``: a frame is its own in one segment and a mere
    neighbour in those that see it from ``before`` frames back or ``after`` ahead.
    Needs a dense frame_idx. An operator with a bounded view may then treat
    (video_id, segment) as a video of its own; ``where own`` ends it. A long video
    becomes many tasks for the price of the neighbours' copies.
    """
    home = F.call_function("div", F.col(INDEX), F.lit(rows))
    seen = F.sequence(F.call_function("div", F.greatest(F.col(INDEX) - after, F.lit(0)), F.lit(rows)), F.call_function("div", F.col(INDEX) + before, F.lit(rows)))
    last = frames.groupBy(VIDEO).agg(F.max(home).alias("_last"))
    return frames.withColumns({"_home": home, "segment": F.explode(seen)}).join(last, VIDEO).where("segment <= _last").withColumn("own", F.col("segment") == F.col("_home")).drop("_home", "_last")


def remove_noise_in_segments(frames: DataFrame, flag: str, value: bool = True, min_length: int = 10, rows: int = 4096) -> DataFrame:
    """``remove_noise`` with a long video dealt out in segments of ``rows`` frames.

    Whether a run is shorter than ``min_length`` shows within as many frames on
    either side, so segments see that far beyond themselves. Needs a dense
    frame_idx from 0; the video's ends are told by it.
    """
    ends = frames.groupBy(VIDEO).agg(F.max(INDEX).alias("_end"))
    dealt = with_halo(frames, rows, min_length, min_length).join(ends, VIDEO)
    on = F.coalesce(F.col(flag), F.lit(False))
    marked = dealt.withColumn("_on", on).withColumn("_run", F.col(INDEX) - F.row_number().over(in_order("segment", "_on")))
    length = F.count("*").over(Window.partitionBy(VIDEO, "segment", "_on", "_run"))
    short = (F.col("_on") == F.lit(value)) & (length < min_length) & F.col(INDEX).between(F.lit(min_length), F.col("_end") - min_length)
    return marked.withColumn(flag, F.when(short, F.lit(not value)).otherwise(F.col("_on"))).where("own").select(*frames.columns)
