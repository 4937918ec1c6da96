"""Texts of intervals: the frame that stands for each, through pluggable recognisers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (image, text mask) -> text
Recogniser = Callable[[np.ndarray, np.ndarray | None], str]


def image_in_row(pdf: pd.DataFrame) -> Callable[[int], np.ndarray]:
    """The images of rows that have their pixels."""
    return lambda i: np.frombuffer(pdf["img"][i], np.uint8).reshape(pdf["h"][i], pdf["w"][i], 3)


def joined_lines(lines: list[list[str]]) -> str:
    """Words of a line put together, lines under each other, blanks cut off."""
    return "\n".join("".join(words) for words in lines).strip()


def one_line(raw: str) -> str:
    """A recogniser's page without its last character and line ends."""
    return raw[:-1].replace("\n", "")


def joined(texts: list[str], separator: str) -> str:
    """What the recognisers read, one after the other; no separator before the first text."""
    out = ""
    for text in texts:
        out = f"{out}{separator}{text}" if out else text
    return out


def interval_texts(
    intervals: DataFrame,
    frames: DataFrame,
    recognisers: list[Recogniser],
    separator: str = "@",
    crop: Callable[[np.ndarray], np.ndarray] | None = None,
    text_mask: Callable[[np.ndarray], np.ndarray] | None = None,
    image_of: Callable | None = None,
) -> DataFrame:
    """The intervals with ``text``: what each recogniser reads in their frame, joined by ``separator``.

    A recogniser gets the ``crop`` of the frame (the whole frame without one) and
    the ``text_mask`` of that crop. An interval's frame is at its ``ocr_pts``, or
    where it has none at its first frame. Only those frames' pixels are shuffled:
    the keys are joined first. With ``image_of`` none are: ``frames`` has what fetches
    an image instead of h, w and img, as in ``vision.each_frame``, and an image is
    fetched where it is read. An interval without a frame has an empty text.
    """
    at = F.coalesce("ocr_pts", "first_pts") if "ocr_pts" in intervals.columns and "first_pts" in intervals.columns else F.col("ocr_pts" if "ocr_pts" in intervals.columns else "first_pts")
    asked = intervals.withColumn("_at", at)
    wanted = asked.select("video_id", F.col("_at").alias("pts")).distinct()
    fetch = [c for c in frames.columns if c not in ("video_id", "pts")] if image_of else ["h", "w", "img"]
    found = frames.join(wanted, ["video_id", "pts"]).groupBy("video_id", "pts").agg(F.min_by(F.struct(*fetch), "frame_idx").alias("f")).select("video_id", "pts", "f.*")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fetched = (image_of or image_in_row)(pdf)
            texts = []
            for i in range(len(pdf)):
                image = fetched(i)
                image = crop(image) if crop else image
                mask = text_mask(image) if text_mask else None
                texts.append(joined([r(image, mask) for r in recognisers], separator))
            yield pd.DataFrame({"video_id": pdf.video_id, "pts": pdf.pts, "text": texts})

    texts = found.mapInPandas(read, "video_id long, pts long, text string").withColumnRenamed("pts", "_at")
    return asked.join(texts, ["video_id", "_at"], "left").withColumn("text", F.coalesce("text", F.lit(""))).drop("_at")
