"""Projection models: trained on frames, kept as two arrays in a file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: One frame in so many trains: a caption lasts for seconds.
TRAIN_EVERY, COMPONENTS = 50, 4


def train_projection(frames: DataFrame, feature: str, every: int = TRAIN_EVERY, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and k leading eigenvectors (rows) of a vector feature over sampled frames.

    The moments are summed by Spark; the driver gets one row of them, of the
    feature's size squared, whatever the number of frames.
    """
    order = Window.partitionBy("video_id").orderBy("pts", "frame_idx")
    rows = frames.where(F.col(feature).isNotNull()).withColumn("_at", F.row_number().over(order) - 1).where(F.col("_at") % every == 0)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's rows, their sum and the sum of their outer products."""
        n, total, outer = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = np.stack([v.values.to_numpy() for v in batch.column(0)])
                n, total, outer = n + len(x), total + x.sum(0), outer + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([outer.ravel().tolist()])], ["n", "total", "outer"])

    parts = rows.select(F.col(feature).cast("array<double>").alias("v")).mapInArrow(moments, "n long, total array<double>, outer array<double>")
    got = parts.select("n", F.posexplode(F.concat("total", "outer")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").toArrow()
    x, n = got["x"].to_numpy(), got["n"][0].as_py()
    size = int((np.sqrt(1 + 4 * len(x)) - 1) / 2)
    mean = x[:size] / n
    _, vectors = np.linalg.eigh(x[size:].reshape(size, size) / n - np.outer(mean, mean))
    return mean, vectors[:, ::-1][:, :k].T


def save_projection(path: str, mean: np.ndarray, vectors: np.ndarray) -> None:
    np.savez(path, mean=mean, eigenvectors=vectors)


def load_projection(path: str) -> tuple[np.ndarray, np.ndarray]:
    """What ``save_projection`` wrote; a mean in one row is taken as well."""
    with np.load(path) as z:
        return z["mean"].ravel(), z["eigenvectors"]
