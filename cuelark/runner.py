"""Runs a configuration: frames in, subtitle files out, all videos in parallel.

    python -m cuelark.runner --config config.yml

A source is a folder of raw frame files (``sources.raw_video``); a destination is
the folder that gets one subtitle file a video, and with ``ocr`` the texts beside it.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelark.functions.timebase import TimeBase
from cuelark.operators import recognise, vision
from cuelark.operators.geometry import Rect
from cuelark.operators.recognise import image_in_row
from cuelark.operators.speculative import looked_at, sparse_looks
from cuelark.plans.strategies import framewise, sparse_plan, sparse_threshold
from cuelark.sinks import subtitles
from cuelark.sources import config
from cuelark.sources.raw_video import RawFrames, image_of


def looks_of(frames: DataFrame, run: config.Run, base: TimeBase, image_of: Callable = image_in_row, **extra) -> DataFrame:
    """The sparse looks of a speculative run; ``image_of`` says how a frame's image is fetched."""
    look = vision.looks(run.strategy, run.params, run.plan.flags[0], run.plan.feature, image_of, run.content, **extra)
    return sparse_looks(frames, look, run.plan.flags[0], sparse_threshold(run.plan), run.empty_gap, base)


def intervals_of(frames: DataFrame, run: config.Run, base: TimeBase, image_of: Callable = image_in_row, **extra) -> DataFrame:
    """The labelled intervals of a frame table under a checked configuration."""
    if run.engine == "speculative":
        return sparse_plan(looks_of(frames, run, base, image_of, **extra), run.plan, base)
    if run.every > 1:
        frames = frames.where(F.col("frame_idx") % run.every == 0)
    return framewise(vision.analyse(frames, run.strategy, run.params, run.content, **extra), run.plan, base)


def work_of(frames: DataFrame, run: config.Run, base: TimeBase, image_of: Callable = image_in_row, **extra) -> DataFrame:
    """(n_frames, n_decoded, n_analysed) of a speculative run."""
    return looked_at(looks_of(frames, run, base, image_of, **extra))


def dialog_crop(run: config.Run):
    """The part of a frame that a recogniser reads."""

    def of(image):
        return Rect.source(image.shape[1], image.shape[0]).part(*run.content).part(*run.params["dialogRect"]).cut(image)

    return of if "dialogRect" in run.params else None


def text_masks(run: config.Run):
    """The mask of text in a crop; None where a strategy makes none."""
    values = {k: v for k, v in run.params.items() if not k.endswith("Rect")}
    if run.strategy == "otl":
        return lambda crop: vision.outlined_text(crop, values)
    if run.strategy == "bcs":
        return lambda crop: vision.boxes_of_text(crop, values)
    return None


def execute(spark: SparkSession, run: config.Run, base: TimeBase, recognisers: list[recognise.Recogniser] | None = None, **extra) -> list[float]:
    """Writes the files of all sources; gives the seconds that each took."""
    spark.dataSource.register(RawFrames)
    seconds = []
    for source, destination in zip(run.sources, run.destinations, strict=True):
        begin = time.time()
        frames = spark.read.format("raw_frames").load(source)
        if run.engine == "speculative":  # pixels only of the frames looked at
            found = intervals_of(spark.read.format("raw_frames").option("pixels", "false").load(source), run, base, image_of(source), **extra)
        else:
            found = intervals_of(frames, run, base, **extra)
        subtitles.write_documents(found, f"{destination}/subtitles", run.plan.styles, base)
        if run.ocr and recognisers:
            texts = recognise.interval_texts(found, frames, recognisers, run.ocr["separator"], dialog_crop(run), text_masks(run))
            lines = subtitles.ocr_lines(texts).repartition("video_id").sortWithinPartitions("video_id", "ord")
            lines.select("video_id", "line").write.mode("overwrite").partitionBy("video_id").text(f"{destination}/texts{run.ocr['suffix']}")
        seconds.append(time.time() - begin)
    return seconds


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Subtitle timelines from videos.")
    parser.add_argument("--config", default="config.yml")
    parser.add_argument("--ticks", type=int, default=1_000_000, help="ticks of a second")
    asked = parser.parse_args(args)
    run = config.load(asked.config)
    spark = SparkSession.builder.appName("subtitle timelines").getOrCreate()
    for source, s in zip(run.sources, execute(spark, run, TimeBase(1, asked.ticks)), strict=True):
        print(f"{source}: {s:.1f} s")


if __name__ == "__main__":
    main()
