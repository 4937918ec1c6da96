"""Operators on labelled intervals: an algebra of windows over (begin, seq).

An interval table has video_id, main_flag, begin, end (ticks), style and seq, the
tie-break of equal begins; ``resort`` renumbers it. Parameters in milliseconds are
turned into ticks once, on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelark.functions import interval as iv
from cuelark.functions import vector
from cuelark.functions.timebase import MICROS, TimeBase, div, midpoint

VIDEO = "video_id"


def in_order(*more: str):
    return Window.partitionBy(VIDEO, *more).orderBy("begin", "seq")


def append(*tables: DataFrame) -> DataFrame:
    """The bag union of interval tables; later tables' seq follow earlier ones'."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("_table", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    seq = F.row_number().over(Window.partitionBy(VIDEO).orderBy("_table", "seq")) - 1
    return out.withColumn("seq", seq.cast("long")).drop("_table")


def resort(intervals: DataFrame) -> DataFrame:
    """Stable order by begin: seq is renumbered."""
    return intervals.withColumn("seq", (F.row_number().over(in_order()) - 1).cast("long"))


def numbered(intervals: DataFrame) -> DataFrame:
    """``number``: the running id within the label, ``name`` made of both."""
    number = (F.row_number().over(in_order("main_flag")) - 1).cast("long")
    return intervals.withColumn("number", number).withColumn("name", iv.name(F.col("main_flag"), F.col("number")))


def midpoints(intervals: DataFrame) -> DataFrame:
    """(video_id, name, midpoint) of each interval."""
    return numbered(intervals).select(VIDEO, "name", midpoint(F.col("begin"), F.col("end")).alias("midpoint"))


def with_flag(intervals: DataFrame, flag: str) -> DataFrame:
    return intervals.where(F.col("main_flag") == flag)


def fill_gap(intervals: DataFrame, flag: str, max_gap: int = 300, meet: float = 0.5, base: TimeBase = MICROS) -> DataFrame:
    """Consecutive intervals of ``flag`` with a gap of at most ``max_gap`` ms meet within it.

    They meet at ``meet`` of the way back from the later begin to the earlier end:
    0 at the earlier end, 1 at the later begin. Touching and overlapping ones stay.
    """
    most = base.ticks(max_gap)
    order = in_order("main_flag")
    a, b = F.col("begin"), F.col("end")
    next_begin, last_end = F.lead("begin").over(order), F.lag("end").over(order)
    meeting = lambda end, begin: (end.cast("double") * F.lit(1.0 - meet) + begin.cast("double") * F.lit(float(meet))).cast("long")
    mine = F.col("main_flag") == flag
    close = lambda end, begin: mine & (begin - end > 0) & (begin - end <= most)
    rows = intervals.withColumns({"_next": next_begin, "_last": last_end})
    rows = rows.withColumns({
        "begin": F.when(close(F.col("_last"), a), meeting(F.col("_last"), a)).otherwise(a),
        "end": F.when(close(b, F.col("_next")), meeting(b, F.col("_next"))).otherwise(b),
    })
    return resort(rows.drop("_next", "_last"))


def extend(intervals: DataFrame, flag: str, front: int = 0, back: int = 0, base: TimeBase = MICROS) -> DataFrame:
    """Widens intervals of ``flag`` by ``front`` and ``back`` ms, not over their neighbours of any label.

    Ends first, bounded by the next begin; then begins, bounded by the new end
    before (0 for the first).
    """
    order = in_order()
    mine = F.col("main_flag") == flag
    rows = intervals.withColumn("_next", F.lead("begin").over(order))
    rows = rows.withColumn("end", F.when(mine, F.least(F.col("end") + base.ticks(back), F.col("_next"))).otherwise(F.col("end")))
    rows = rows.withColumn("_last", F.lag("end").over(order))
    return rows.withColumn("begin", F.when(mine, F.greatest(F.col("begin") - base.ticks(front), F.coalesce("_last", F.lit(0)))).otherwise(F.col("begin"))).drop("_next", "_last")


def align(intervals: DataFrame, target: str, ref: str, max_gap: int = 300, base: TimeBase = MICROS) -> DataFrame:
    """Snaps begins and ends of ``target`` to the nearest end point of ``ref`` within ``max_gap`` ms.

    On a tie the earlier point wins. An as-of join by union and window: no pair is
    ever formed.
    """
    points = intervals.where(F.col("main_flag") == ref).select(VIDEO, F.explode(F.array("begin", "end")).alias("t")).distinct()
    points = points.select(VIDEO, "t", F.col("t").alias("p"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("side"))
    asked = intervals.where(F.col("main_flag") == target)
    asked = asked.select(VIDEO, "seq", F.explode(F.array(F.struct(F.lit("begin").alias("side"), F.col("begin").alias("t")), F.struct(F.lit("end").alias("side"), F.col("end").alias("t")))).alias("s"))
    asked = asked.select(VIDEO, F.col("s.t").alias("t"), F.lit(None).cast("long").alias("p"), "seq", F.col("s.side").alias("side"))
    line = Window.partitionBy(VIDEO).orderBy("t")
    near = points.unionByName(asked).withColumns({
        "before": F.last("p", True).over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "after": F.first("p", True).over(line.rangeBetween(Window.currentRow, Window.unboundedFollowing)),
    }).where("side is not null")
    t, lo, hi = F.col("t"), F.col("before"), F.col("after")
    best = F.when(lo.isNull() | (hi - t < t - lo), hi).otherwise(lo)
    snapped = F.when(F.abs(best - t) <= base.ticks(max_gap), best).otherwise(t)
    by_row = near.groupBy(VIDEO, "seq").agg(F.max(F.when(F.col("side") == "begin", snapped)).alias("_begin"), F.max(F.when(F.col("side") == "end", snapped)).alias("_end"))
    out = intervals.join(by_row, [VIDEO, "seq"], "left").withColumns({"begin": F.coalesce("_begin", "begin"), "end": F.coalesce("_end", "end")})
    return resort(out.drop("_begin", "_end").select(*intervals.columns))


def offset(intervals: DataFrame, ticks: int) -> DataFrame:
    """Moves all intervals by ``ticks``."""
    return intervals.withColumns({"begin": F.col("begin") + ticks, "end": F.col("end") + ticks})


def remove(intervals: DataFrame, predicate: Column) -> DataFrame:
    """Drops intervals for which the predicate holds."""
    return intervals.where(~F.coalesce(predicate, F.lit(False)))


def denoise(intervals: DataFrame, flag: str, min_time: int, base: TimeBase = MICROS) -> DataFrame:
    """Drops intervals of ``flag`` shorter than ``min_time`` ms."""
    return remove(intervals, (F.col("main_flag") == flag) & (F.col("end") - F.col("begin") < base.ticks(min_time)))


def restyled(intervals: DataFrame, style: Column) -> DataFrame:
    """Changes the style of each interval by an expression."""
    return intervals.withColumn("style", style)


Alike = Callable[[Column, Column], Column]


def alike_features(least: float) -> Alike:
    """Whether the mean features of two intervals are nearer than ``least``."""

    def alike(a: Column, b: Column) -> Column:
        mean = lambda x: vector.scaled(x["feat_sum"], F.lit(1.0) / x["n_points"])
        return vector.l2(mean(a), mean(b)) < least

    return alike


def merge(intervals: DataFrame, alike: Alike) -> DataFrame:
    """Folds each video's intervals in order: one that is ``alike`` what has gathered so far joins it.

    What has gathered keeps the first interval's label, loses its style, spans both
    and adds up their members. A fold in the JVM over one video's sorted intervals.
    """
    names = [c for c in intervals.columns if c != VIDEO]
    first = ["begin", "seq"]
    packed = F.array_sort(F.collect_list(F.struct(*first, *[c for c in names if c not in first])))
    item = intervals.select(F.struct(*first, *[c for c in names if c not in first]).alias("s")).schema["s"].dataType

    def both(a: Column, b: Column) -> Column:
        made = {"begin": F.least(a["begin"], b["begin"]), "end": F.greatest(a["end"], b["end"]), "style": F.lit("Default")}
        if "n_points" in names:
            made["n_points"] = a["n_points"] + b["n_points"]
        if "feat_sum" in names:
            made["feat_sum"] = vector.added(a["feat_sum"], b["feat_sum"])
        return F.struct(*[made.get(f.name, a[f.name]).cast(f.dataType).alias(f.name) for f in item.fields])

    # Only what has gathered last is carried; what it was joins the list when the next one differs.
    kind = item.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        joins = last.isNotNull() & F.coalesce(alike(last, x), F.lit(False))
        done = F.when(joins | last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))
        return F.struct(done.alias("done"), F.when(joins, both(last, x)).otherwise(x).alias("last"))

    folded = intervals.groupBy(VIDEO).agg(F.aggregate(packed, start, step, lambda acc: F.concat(acc["done"], F.array(acc["last"]))).alias("all"))
    return resort(folded.select(VIDEO, F.explode("all").alias("s")).select(VIDEO, *[F.col(f"s.{c}").alias(c) for c in names]))


def nearest_centroid(x: Column, y: Column, centroids: dict[str, tuple[float, float]], farthest: float, otherwise: str) -> Column:
    """Name of the centroid of least squared distance, the first on ties; ``otherwise`` beyond ``farthest``."""
    near = F.least(*[F.struct(((x - a) * (x - a) + (y - b) * (y - b)).alias("d"), F.lit(i).alias("i"), F.lit(label).alias("label")) for i, (label, (a, b)) in enumerate(centroids.items())])
    return F.when(near["d"] > farthest, F.lit(otherwise)).otherwise(near["label"])


def hue_saturation_point(b: Column, g: Column, r: Column) -> tuple[Column, Column]:
    """A colour's (saturation * cos hue, saturation * sin hue); components 0 to 255."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    spread = top - low
    hue = F.when(spread == 0, 0.0).when(top == r, 60 * (g - b) / spread).when(top == g, 120 + 60 * (b - r) / spread).otherwise(240 + 60 * (r - g) / spread)
    turn = F.radians(F.when(hue < 0, hue + 360).otherwise(hue))
    saturation = F.when(top == 0, 0.0).otherwise(spread / top)
    return saturation * F.cos(turn), saturation * F.sin(turn)


def pairs_within(intervals: DataFrame, bucket: int) -> DataFrame:
    """Pairs of a video's intervals that overlap or touch, by a range join over buckets of ticks.

    Each interval stands in the buckets it covers; a pair is reported only in the
    first bucket that both share, so nothing is compared twice.
    """
    a = intervals.select(VIDEO, F.col("seq").alias("seq_a"), F.col("begin").alias("begin_a"), F.col("end").alias("end_a"))
    b = intervals.select(F.col(VIDEO).alias("_video"), F.col("seq").alias("seq_b"), F.col("begin").alias("begin_b"), F.col("end").alias("end_b"))
    spread = lambda df, x: df.withColumn(f"_slot_{x}", F.explode(F.sequence(div(F.col(f"begin_{x}"), bucket), div(F.col(f"end_{x}"), bucket))))
    first = div(F.greatest("begin_a", "begin_b"), bucket)
    met = spread(a, "a").join(spread(b, "b"), (F.col(VIDEO) == F.col("_video")) & (F.col("_slot_a") == F.col("_slot_b")))
    near = iv.gap(F.col("begin_a"), F.col("end_a"), F.col("begin_b"), F.col("end_b"))
    return met.where((F.col("seq_a") < F.col("seq_b")) & (first == F.col("_slot_a")) & (near <= 0)).withColumn("gap", near).drop("_video", "_slot_a", "_slot_b")


def neighbours(intervals: DataFrame) -> DataFrame:
    """Each interval with the next one of its video and the gap between them."""
    order = in_order()
    rows = intervals.withColumns({"next_begin": F.lead("begin").over(order), "next_end": F.lead("end").over(order)}).where("next_begin is not null")
    return rows.withColumn("gap", iv.gap(F.col("begin"), F.col("end"), F.col("next_begin"), F.col("next_end")))


def fill_gap_sequential(intervals: DataFrame, flag: str, max_gap: int = 300, meet: float = 0.5, base: TimeBase = MICROS) -> DataFrame:
    """``fill_gap`` in list order, each interval seeing what earlier ones changed.

    Differs from the closed form only where intervals of ``flag`` touch or overlap:
    an interval then looks past those neighbours for the first real gap. Sequential
    within a video; videos are apart.
    """
    import pandas as pd

    most = base.ticks(max_gap)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["begin", "seq"], kind="stable").reset_index(drop=True)
        begin, end = pdf["begin"].to_numpy(copy=True), pdf["end"].to_numpy(copy=True)
        own = [i for i, f in enumerate(pdf["main_flag"]) if f == flag]
        for k, i in enumerate(own):
            for j in own[k + 1 :]:
                lead = begin[j] - end[i]
                if lead > most:
                    break
                if lead > 0:
                    end[i] = begin[j] = int(end[i] * (1 - meet) + begin[j] * meet)
                    break
        return pdf.assign(begin=begin, end=end)

    return resort(intervals.groupBy(VIDEO).applyInPandas(one, intervals.schema))
