"""A quality classifier: a small convolutional network over bytes, in NumPy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each
byte has a learned vector; learned filters, TAPS blocks of STRIDE bytes wide, run
over a chunk, are rectified and pooled (the maximum, and the mean beside it); a
hidden layer makes a logit of that. A logistic layer combines the mean, the
largest and the smallest logit of the chunks into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cuelark.llm.textbatch import flat

CHUNK, OVERLAP = 1024, 128
STEP = CHUNK - OVERLAP
STRIDE, TAPS, DEPTH, FILTERS, HIDDEN = 4, 3, 8, 32, 16
BLOCKS = CHUNK // STRIDE
PLACES = BLOCKS - TAPS + 1
#: The classifier is fitted on so many labelled documents at most, all chunks of each.
FIT_DOCS = 6_000
EPOCHS, BATCH, RATE, SEED = 5, 64, 3e-3, 5
#: Chunks scored together: bounds a worker's memory (about 30 KB a chunk).
TOGETHER = 256
REJECT_BELOW = 0.3


def chunk_starts(n: int) -> np.ndarray:
    """Where the chunks of a text of n bytes begin; the last one reaches its end."""
    return np.arange(max(1, -(-(n - OVERLAP) // STEP))) * STEP


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Network:
    """Weights; ``p`` by name."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        wide = STRIDE * DEPTH
        return cls({
            "vectors": normal(256, DEPTH, scale=0.5),
            "filters": normal(TAPS, wide, FILTERS, scale=(2 / (TAPS * wide)) ** 0.5),
            "shift": np.zeros(FILTERS, np.float32),
            "hidden": normal(2 * FILTERS + 1, HIDDEN, scale=(2 / (2 * FILTERS)) ** 0.5),
            "hidden_shift": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, scale=HIDDEN**-0.5),
            "out_shift": np.zeros(1, np.float32),
            "combine": np.array([1, 0, 0, 0], np.float32),
        })

    def forward(self, chunks: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logit of each chunk of bytes (k, CHUNK); ``length`` says how many bytes are text."""
        p, k = self.p, len(chunks)
        x = p["vectors"][chunks].reshape(k, BLOCKS, STRIDE * DEPTH)
        a = np.zeros((k, PLACES, FILTERS), np.float32)
        for t in range(TAPS):
            a += x[:, t : t + PLACES] @ p["filters"][t]
        a += p["shift"]
        np.maximum(a, 0, out=a)
        places = np.clip(-(-length // STRIDE), 1, PLACES)
        a *= (np.arange(PLACES) < places[:, None])[:, :, None]
        pooled = np.concatenate([a.max(1), a.sum(1) / places[:, None].astype(np.float32), (length[:, None] / CHUNK).astype(np.float32)], 1)
        h = np.maximum(pooled @ p["hidden"] + p["hidden_shift"], 0)
        z = h @ p["out"] + p["out_shift"]
        return (z, x, a, places, pooled, h) if keep else z

    def gradient(self, chunks: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean logistic loss of chunks."""
        p = self.p
        z, x, a, places, pooled, h = self.forward(chunks, length, keep=True)
        dz = ((sigmoid(z) - y) * weight / len(y)).astype(np.float32)
        g = {"out": h.T @ dz, "out_shift": dz.sum(keepdims=True)}
        dh = np.outer(dz, p["out"]) * (h > 0)
        g["hidden"], g["hidden_shift"] = pooled.T @ dh, dh.sum(0)
        dp = dh @ p["hidden"].T
        da = np.repeat((dp[:, FILTERS : 2 * FILTERS] / places[:, None])[:, None, :], PLACES, 1)
        i, j = np.indices((len(chunks), FILTERS))
        da[i, a.argmax(1), j] += dp[:, :FILTERS]
        da *= a > 0
        g["shift"] = da.sum((0, 1))
        dx = np.zeros_like(x)
        g["filters"] = np.empty_like(p["filters"])
        for t in range(TAPS):
            part = x[:, t : t + PLACES]
            g["filters"][t] = part.reshape(-1, part.shape[2]).T @ da.reshape(-1, FILTERS)
            dx[:, t : t + PLACES] += da @ p["filters"][t].T
        dx = dx.reshape(-1, DEPTH)
        g["vectors"] = np.stack([np.bincount(chunks.ravel(), dx[:, d], 256) for d in range(DEPTH)], 1).astype(np.float32)
        return g

    def combined(self, logits: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One probability a text from its chunks' logits; ``first`` is each text's first chunk, one more than texts."""
        at = first[:-1]
        f = np.stack([np.add.reduceat(logits, at) / np.diff(first), np.maximum.reduceat(logits, at), np.minimum.reduceat(logits, at), np.ones(len(at))], 1)
        return sigmoid(f @ self.p["combine"].astype(np.float64))

    def score(self, column) -> np.ndarray:
        """Probability of each text of a column."""
        data, begins = flat(column)
        counts = np.array([len(chunk_starts(n)) for n in np.diff(begins)], np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        starts = np.concatenate([begins[i] + chunk_starts(begins[i + 1] - begins[i]) for i in range(len(counts))]) if len(counts) else np.empty(0, np.int64)
        stops = np.minimum(starts + CHUNK, np.repeat(begins[1:], counts))
        logits = np.empty(len(starts))
        for a in range(0, len(starts), TOGETHER):
            b = min(a + TOGETHER, len(starts))
            chunks = np.zeros((b - a, CHUNK), np.uint8)
            for i in range(a, b):
                chunks[i - a, : stops[i] - starts[i]] = data[starts[i] : stops[i]]
            logits[a:b] = self.forward(chunks, stops[a:b] - starts[a:b])
        return self.combined(logits, first) if len(counts) else np.empty(0)


def _fit_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All chunks of each labelled text."""
    for batch in batches:
        data, begins = flat(batch.column("text"))
        ids, labels, parts = [], [], []
        for i, label in enumerate(batch.column("label").to_pylist()):
            for s in chunk_starts(begins[i + 1] - begins[i]):
                ids.append(batch.column("ticket")[i].as_py())
                labels.append(label)
                parts.append(data[begins[i] + s : min(begins[i] + s + CHUNK, begins[i + 1])].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(parts, pa.binary())], ["ticket", "label", "part"])


def fit(ids: np.ndarray, labels: np.ndarray, parts: list[bytes]) -> Network:
    """A network from chunks (``ids`` tells which belong to one text), reproducible."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    net = Network.fresh(rng)
    if not len(ids):
        net.p["combine"][:] = 0
        return net
    length = np.array([len(x) for x in parts])
    chunks = np.zeros((len(parts), CHUNK), np.uint8)
    for i, x in enumerate(parts):
        chunks[i, : len(x)] = np.frombuffer(x, np.uint8)
    y = labels.astype(np.float32)
    _, inverse, count = np.unique(ids, return_inverse=True, return_counts=True)
    weight = (1 / count)[inverse].astype(np.float32)
    weight /= weight.mean()
    rate = np.clip((y * weight).sum() / weight.sum(), 0.01, 0.99)
    net.p["out_shift"][:] = np.log(rate / (1 - rate))
    m, v = ({k: np.zeros_like(w) for k, w in net.p.items()} for _ in range(2))
    turn = 0
    steps = EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            at = order[a : a + BATCH]
            turn += 1
            pace = RATE * (1 - turn / (steps + 1))
            for k, g in net.gradient(chunks[at], length[at], y[at], weight[at]).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                net.p[k] -= pace * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.99**turn)) + 1e-7)
    # The combination of a text's chunks, by Newton steps with a small ridge.
    order = np.argsort(ids, kind="stable")
    logits = np.concatenate([net.forward(chunks[order[a : a + TOGETHER]], length[order[a : a + TOGETHER]]) for a in range(0, len(order), TOGETHER)])
    first = np.concatenate([[0], np.cumsum(count)])
    at = first[:-1]
    f = np.stack([np.add.reduceat(logits, at) / count, np.maximum.reduceat(logits, at), np.minimum.reduceat(logits, at), np.ones(len(at))], 1).astype(np.float64)
    t = y[order][at].astype(np.float64)
    w = np.array([1.0, 0, 0, 0])
    for _ in range(30):
        s = sigmoid(f @ w)
        hess = (f * (s * (1 - s))[:, None]).T @ f + np.eye(4)
        w -= np.linalg.solve(hess, f.T @ (s - t) + (w - [1, 0, 0, 0]))
    net.p["combine"] = w.astype(np.float32)
    return net


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(ticket, label, text): at most ``most`` labelled documents that are not held out.

    ``labels(doc_id, <label>)`` is narrowed to the smallest hashes first, so what is
    joined to the texts is bounded and broadcast. Repeated labels of a document
    count once, as the largest; null labels and ids do not count.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    one = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).withColumn("ticket", F.xxhash64("doc_id"))
    few = one.orderBy("ticket").limit(most)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(few), "doc_id").select("ticket", "label", "text")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network:
    """A network fitted on FIT_DOCS labelled documents at most, whose whole texts come to the driver; each document weighs 1, however long."""
    got = labelled(docs, labels, label, FIT_DOCS).mapInArrow(_fit_chunks, "ticket long, label int, part binary").toArrow()
    ids, y, parts = got["ticket"].to_numpy(), got["label"].to_numpy(), got["part"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], parts[i]))
    return fit(ids[order], y[order], [parts[i] for i in order])


def _scored(batches: Iterator[pa.RecordBatch], net, text: str, score: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column(score, pa.array(net.value.score(batch.column(text)), pa.float64()))


def with_score(docs: DataFrame, net: Network, score: str, text: str = "text") -> DataFrame:
    """``docs`` with one more column, the probability of its text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.mapInArrow(partial(_scored, net=shared, text=text, score=score), StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def classify(docs: DataFrame, net: Network, least: float = REJECT_BELOW) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs(doc_id, text)``.

    ``score`` is the probability of label 1, ``predicted`` 1 from ``least`` up. A
    null text scores as an empty one does; texts of any length are covered whole;
    repeated rows are rows of their own; a null doc_id is not held out; an empty
    table gives an empty one; other columns are never read. With no labels at all
    every score is 0.5.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = with_score(rows, net, "score").drop("text")
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def accepted(docs: DataFrame, net: Network, least: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns as they were."""
    name = "score_" + "_".join(sorted(docs.columns))[:40]
    while name in docs.columns:
        name += "_"
    return with_score(docs, net, name).where(F.col(name) >= least).drop(name)
