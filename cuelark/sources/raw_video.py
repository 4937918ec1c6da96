"""A data source of raw frame files: one partition a file and key segment.

A file ``<video_id>.npz`` holds ``pts`` (n) and ``key`` (n, boolean); the pixels are
``<video_id>.npy`` (n, h, w, 3) beside it, of which only the frames asked for are read,
or ``img`` in the first file, which is read whole. Sampling (option ``every``) and a
pushed-down range of ``pts`` or ``video_id`` decide before any pixel is read, and with
the option ``pixels`` false none is. Decoders of compressed video take this reader's
place where they are installed.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "video_id long, pts long, frame_idx long, is_key boolean, h int, w int, img binary"


def pixels(folder: str, video: int) -> np.ndarray:
    """A video's frames, read from the disk as they are looked at."""
    path = os.path.join(folder, f"{video}.npy")
    if os.path.exists(path):
        return np.load(path, mmap_mode="r")
    with np.load(os.path.join(folder, f"{video}.npz")) as z:
        return z["img"]


def image_of(folder: str):
    """For ``vision.looks``: the image of a row of a video's frames."""

    def of(pdf):
        held = pixels(folder, int(pdf["video_id"].iloc[0]))
        index = pdf["frame_idx"].to_numpy()
        return lambda i: np.asarray(held[index[i]])

    return of


class Segment(InputPartition):
    def __init__(self, path: str, video: int, begin: int, end: int):
        self.path, self.video, self.begin, self.end = path, video, begin, end


class RawFrames(DataSource):
    """``spark.read.format("raw_frames").load(folder)``; options ``every`` and ``segment`` (frames of a partition at least)."""

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RawFramesReader(self.options)


class RawFramesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.every, self.least = int(options.get("every", 1)), int(options.get("segment", 64))
        self.pixels = str(options.get("pixels", "true")).lower() == "true"
        self.low, self.high, self.video = -(1 << 63), (1 << 63) - 1, None

    def pushFilters(self, filters: list[Filter]):
        """Bounds on pts and a video_id are used here; everything else is left to Spark."""
        for f in filters:
            match f:
                case EqualTo(("video_id",), v):
                    self.video = v
                case GreaterThanOrEqual(("pts",), v):
                    self.low = max(self.low, v)
                case GreaterThan(("pts",), v):
                    self.low = max(self.low, v + 1)
                case LessThanOrEqual(("pts",), v):
                    self.high = min(self.high, v)
                case LessThan(("pts",), v):
                    self.high = min(self.high, v - 1)
                case EqualTo(("pts",), v):
                    self.low, self.high = max(self.low, v), min(self.high, v)
                case _:
                    yield f

    def partitions(self) -> list[Segment]:
        out = []
        for name in sorted(os.listdir(self.folder)):
            stem, ext = os.path.splitext(name)
            if ext != ".npz" or self.video is not None and int(stem) != self.video:
                continue
            path = os.path.join(self.folder, name)
            with np.load(path) as z:
                n, keys = len(z["pts"]), np.flatnonzero(z["key"])
            cuts = [0]
            for k in keys.tolist():
                if k - cuts[-1] >= self.least:
                    cuts.append(k)
            out += [Segment(path, int(stem), a, b) for a, b in zip(cuts, [*cuts[1:], n], strict=True) if b > a]
        return out

    def read(self, partition: Segment):
        with np.load(partition.path) as z:
            at = np.arange(partition.begin, partition.end)
            pts = z["pts"][at]
            at = at[(at % self.every == 0) & (pts >= self.low) & (pts <= self.high)]
            if not len(at):
                return
            pts, key = z["pts"][at], z["key"][at]
        n = len(at)
        img = pixels(self.folder, partition.video)[at] if self.pixels else np.empty((n, 0, 0, 3), np.uint8)
        h, w = img.shape[1:3]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, partition.video)), pa.array(pts.astype(np.int64)), pa.array(at), pa.array(key.astype(bool)), pa.array(np.full(n, h, np.int32)), pa.array(np.full(n, w, np.int32)), pa.array([x.tobytes() for x in img], pa.binary())],
            ["video_id", "pts", "frame_idx", "is_key", "h", "w", "img"],
        )
