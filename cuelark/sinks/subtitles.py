"""Subtitle timelines and recognised texts as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelark.functions import interval as iv
from cuelark.functions.timebase import MICROS, TimeBase
from cuelark.operators.intervals import numbered

#: The fixed lines of a subtitle file. Fixed values.
HEADER = (
    "[Script Info]",
    "ScriptType: v4.00+",
    "WrapStyle: 0",
    "PlayResX: 1280",
    "PlayResY: 720",
    "",
    "[V4+ Styles]",
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding",
    "Style: Default,Microsoft YaHei,40,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,2,2,10,10,100,1",
)
EVENTS = ("", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text")


def subtitle_lines(intervals: DataFrame, base: TimeBase = MICROS) -> DataFrame:
    """(video_id, ord, line): the event lines of each video, numbered within their label."""
    order = Window.partitionBy("video_id").orderBy("begin", "seq")
    rows = numbered(intervals).withColumn("ord", (F.row_number().over(order) - 1).cast("long"))
    return rows.select("video_id", "ord", iv.dialogue(F.col("begin"), F.col("end"), F.col("style"), F.col("name"), base).alias("line"))


def document_lines(intervals: DataFrame, styles: tuple[str, ...] = (), base: TimeBase = MICROS) -> DataFrame:
    """(video_id, ord, line): whole subtitle files, their fixed lines and styles first."""
    head = [*HEADER, *styles, *EVENTS]
    events = subtitle_lines(intervals, base).withColumn("ord", F.col("ord") + len(head))
    fixed = events.select("video_id").distinct().select("video_id", F.posexplode(F.array(*map(F.lit, head))).alias("ord", "line"))
    return fixed.withColumn("ord", F.col("ord").cast("long")).unionByName(events)


def write_documents(intervals: DataFrame, path: str, styles: tuple[str, ...] = (), base: TimeBase = MICROS) -> None:
    """One folder a video with its subtitle file; videos are written in parallel, each in order."""
    lines = document_lines(intervals, styles, base).repartition("video_id").sortWithinPartitions("video_id", "ord")
    lines.select("video_id", "line").write.mode("overwrite").partitionBy("video_id").text(path)


def ocr_lines(texts: DataFrame) -> DataFrame:
    """(video_id, ord, line) of ``texts(video_id, main_flag, begin, seq, text)``: name and text, numbered over the video."""
    order = Window.partitionBy("video_id").orderBy("begin", "seq")
    rows = texts.withColumn("ord", (F.row_number().over(order) - 1).cast("long"))
    return rows.select("video_id", "ord", F.concat(iv.name(F.col("main_flag"), F.col("ord")), F.lit(","), F.coalesce("text", F.lit(""))).alias("line"))


def frame_text(frames: DataFrame, flags: list[str]) -> DataFrame:
    """(video_id, frame_idx, line): a dump of frames and their flags."""
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("null"))) for f in flags])
    return frames.select("video_id", "frame_idx", F.format_string("frame %d: %s", "pts", shown).alias("line"))
