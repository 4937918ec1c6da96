"""Toxicity by nearest labelled examples: exact TF-IDF cosine, block-max index.

Texts are vectors over all words of the labelled examples, and over those
beginnings of words whose use tells the two labels apart. A term weighs its IDF,
and more by how far beyond chance (SIGMAS deviations) its use tells the labels
apart. The examples stand in an inverted index cut into blocks of examples. Lists
of rare terms are added up as they are; of the long ones each block keeps the
largest weight, so a bound on every block's cosines is known beforehand and blocks
that cannot hold one of the nearest are never opened: the result is exact. The
nearest vote, weighted by likeness, with a little of the base rate; the vote is
calibrated by a logistic curve fitted on the examples, each scored without itself.
The nearest examples' ids are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelark.llm.storage import cut, staged
from cuelark.llm.textbatch import LOWER, NOT_WORD, U64, Stretches, flat, hashed_words, pieces, words

#: Labelled examples at most.
EXAMPLES = 10_000
#: Deviations that a term's use must differ between the labels before it weighs more: its IDF by 1 + (chi - SIGMAS) squared.
SIGMAS = 3.0
#: Bytes of the beginnings that are terms, of words that are longer.
BEGINNINGS = (5, 6, 7, 8)
NEAREST, EVIDENCE, BLOCK = 50, 3, 128
#: Weight of the base rate among the votes, and power of the likeness.
PRIOR, POWER = 1.0, 4
#: Of the calibration, towards votes as they are.
RIDGE = 4.0
#: Terms of more examples have dense lists. Texts that are scored together, and steps of a cosine that count as different.
LONG, TOGETHER, STEPS = 300, 128, 1_000_000
TABLE_BITS = 22


def terms(column) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first text, term hashes, the text of each, texts) for runs of texts."""
    data, begins = flat(column)
    for i, j in pieces(begins):
        part, at = LOWER[data[begins[i] : begins[j]]], begins[i : j + 1] - begins[i]
        starts, ends, first = words(part, at, NOT_WORD)
        owner = np.repeat(np.arange(j - i), np.diff(first))
        of = Stretches(part)
        hashes, owners = [of.hashes(starts, ends)], [owner]
        for n in BEGINNINGS:
            longer = ends - starts > n
            hashes.append(of.hashes(starts[longer], starts[longer] + n) ^ U64(n))
            owners.append(owner[longer])
        yield i, np.concatenate(hashes), np.concatenate(owners), j - i


def term_counts(column, vocabulary: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the sorted vocabulary, times) of each text, from all its terms."""
    table = np.zeros(1 << TABLE_BITS, bool)
    table[(vocabulary >> U64(64 - TABLE_BITS)).astype(np.int64)] = True
    for _, h, owner, n in terms(column):
        maybe = np.flatnonzero(table[(h >> U64(64 - TABLE_BITS)).astype(np.int64)])
        at = np.searchsorted(vocabulary, h[maybe])
        real = vocabulary[np.minimum(at, len(vocabulary) - 1)] == h[maybe] if len(vocabulary) else np.zeros(len(maybe), bool)
        # Text and place in one number: one sort for all texts of a run.
        wide = max(len(vocabulary), 1)
        both, times = np.unique(owner[maybe[real]] * wide + at[real], return_counts=True)
        cuts = np.searchsorted(both, np.arange(n + 1) * wide)
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            yield both[a:b] - i * wide, times[a:b]


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fitted_curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and shift that make votes probabilities.

    The logistic loss with a ridge towards votes as they are, by Newton steps that
    are halved until they help.
    """
    x, as_is = np.stack([logit(votes), np.ones(len(votes))], 1), np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - labels @ z + RIDGE / 2 * ((w - as_is) ** 2).sum())

    w = as_is
    for _ in range(100):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(2), x.T @ (p - labels) + RIDGE * (w - as_is))
        size = 1.0
        while size > 1e-9 and (w[0] - size * step[0] <= 0 or loss(w - size * step) > loss(w)):
            size /= 2
        if size <= 1e-9 or abs(step).max() < 1e-9:
            break
        w = w - size * step
    return float(w[0]), float(w[1])


@dataclass
class Index:
    """Examples in an inverted index with block maxima; scores new texts."""

    vocabulary: np.ndarray  # sorted term hashes
    idf: np.ndarray  # with what a term weighs more for telling labels apart
    ids: np.ndarray  # of the examples
    votes: np.ndarray  # their labels
    lists: tuple[np.ndarray, np.ndarray, np.ndarray] | list[tuple[np.ndarray, np.ndarray]]  # a term's examples and weights: begins of all, examples, weights; or a pair each
    base: float  # rate of label 1 among examples without telling terms
    curve: tuple[float, float] = (1.0, 0.0)  # slope and shift of a vote's logit
    dense = None

    def lay_out(self) -> None:
        """Lays the long lists out densely, by block, where texts are scored."""
        if self.dense is not None:
            return
        if isinstance(self.lists, list):
            begins = np.concatenate([[0], np.cumsum([len(e) for e, _ in self.lists])]).astype(np.int64)
            self.lists = begins, np.concatenate([np.empty(0, np.int32), *(e for e, _ in self.lists)]).astype(np.int32), np.concatenate([np.empty(0, np.float32), *(w for _, w in self.lists)]).astype(np.float32)
        begins, examples, weights = self.lists
        n = max(1, -(-len(self.ids) // BLOCK))
        long = np.flatnonzero(np.diff(begins) > LONG)
        self.row = np.full(len(begins) - 1, -1, np.int32)
        self.row[long] = np.arange(len(long))
        self.dense = np.zeros((n, len(long), BLOCK), np.float32)
        for i, t in enumerate(long):
            e = examples[begins[t] : begins[t + 1]]
            self.dense[e // BLOCK, i, e % BLOCK] = weights[begins[t] : begins[t + 1]]
        self.most = self.dense.max(2).T.copy()

    def vector(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = (1 + np.log(times)) * self.idf[terms]
        return (w / np.sqrt((w * w).sum())).astype(np.float32)

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of (terms, weights) the k examples of largest cosine above 0, exactly to 1 / STEPS; ties go by place."""
        self.lay_out()
        begins, examples, weights = self.lists
        n = len(self.dense)
        size = n * BLOCK
        long = np.zeros((len(queries), len(self.most)), np.float32)
        rare = np.zeros((len(queries), size), np.float32)
        for i, (terms, w) in enumerate(queries):
            row = self.row[terms]
            long[i, row[row >= 0]] = w[row >= 0]
            t, w = terms[row < 0], w[row < 0]
            times = begins[t + 1] - begins[t]
            at = np.repeat(begins[t] - np.cumsum(times) + times, times) + np.arange(times.sum())
            rare[i] = np.bincount(examples[at], np.repeat(w, times) * weights[at], size)
        bound = long @ self.most + rare.reshape(-1, n, BLOCK).max(2)
        # Whole steps of the cosine and the place in one number.
        best, worst = np.zeros((len(queries), k), np.int64), np.zeros(len(queries))
        for b in np.argsort(-bound.max(0), kind="stable"):
            open_to = np.flatnonzero((bound[:, b] > 0) & (bound[:, b] + 1e-5 > worst))
            if not len(open_to):
                continue
            held = rare[open_to, b * BLOCK : (b + 1) * BLOCK] + long[open_to] @ self.dense[b]
            keys = np.rint(held.astype(np.float64) * STEPS).astype(np.int64) * size + (size - 1 - b * BLOCK - np.arange(BLOCK))
            best[open_to] = np.partition(np.concatenate([best[open_to], keys], 1), -k, 1)[:, -k:]
            worst[open_to] = best[open_to, 0] // size / STEPS
        best = -np.sort(-best, 1)
        return [(size - 1 - x % size, (x // size / STEPS).astype(np.float32)) for x in (y[y >= size] for y in best)]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(terms, weights)], k)[0]

    def votes_on(self, counted: list[tuple[np.ndarray, np.ndarray]], but: list[int] | None = None) -> list[tuple[float, list[int]]]:
        """(vote, evidence) of each text of (terms, times); ``but`` names an example a text that has no vote on it."""
        out: list[tuple[float, list[int]]] = [(self.base, [])] * len(counted)
        some = [i for i, (terms, _) in enumerate(counted) if len(terms)]
        for a in range(0, len(some), TOGETHER):
            now = some[a : a + TOGETHER]
            for i, (near, cosine) in zip(now, self.nearest_of([(counted[i][0], self.vector(*counted[i])) for i in now], NEAREST + (but is not None)), strict=True):
                if but is not None:
                    other = self.ids[near] != but[i]
                    near, cosine = near[other][:NEAREST], cosine[other][:NEAREST]
                w = np.minimum(cosine, 1.0).astype(np.float64) ** POWER
                out[i] = float(((w * self.votes[near]).sum() + PRIOR * self.base) / (w.sum() + PRIOR)), self.ids[near[:EVIDENCE]].tolist()
        return out

    def scores(self, counted: list[tuple[np.ndarray, np.ndarray]], curve: tuple[float, float] | None = None) -> list[tuple[float, list[int]]]:
        """(score, evidence) of each text of (terms, times)."""
        found = self.votes_on(counted)
        slope, shift = curve or self.curve
        calibrated = sigmoid(slope * logit(np.array([v for v, _ in found])) + shift)
        return [(float(x), e) for x, (_, e) in zip(calibrated, found, strict=True)]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("row", "dense", "most", "shared")}


def _term_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By parts, in how many examples of label 1 and 0 each term is."""
    for batch in batches:
        labels = batch.column("label").to_numpy()
        for i, h, owner, _ in terms(batch.column("text")):
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            term, where = np.unique(h[new], return_inverse=True)
            pos, every = np.bincount(where, labels[i + owner[new]], len(term)).astype(np.int64), np.bincount(where, minlength=len(term))
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(pos), pa.array(every - pos)], ["term", "pos", "neg"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By parts, the hashes of all words."""
    for batch in batches:
        for _, h, _ in hashed_words(batch.column("text"), NOT_WORD):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).view(np.int64))], ["term"])


def _examples(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = list(term_counts(batch.column("text"), vocabulary.value))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("ticket"), batch.column("label"), pa.array([t.astype(np.int32) for t, _ in got], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in got], pa.list_(pa.int32()))], ["id", "ticket", "label", "terms", "times"]
        )


def _left_out(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    """What the other examples vote on each."""
    for batch in batches:
        arrays = [[x.values.to_numpy() for x in batch.column(c)] for c in ("terms", "times")]
        got = index.value.votes_on(list(zip(*arrays, strict=True)), batch.column("id").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([v for v, _ in got], pa.float64())], ["label", "vote"])


def _document_counts(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """A task's texts, as the count of term -1, and in how many of them each term is."""
    total, n = np.zeros(len(vocabulary.value), np.int64), 0
    for batch in batches:
        n += batch.num_rows
        for terms, _ in term_counts(batch.column("text"), vocabulary.value):
            total[terms] += 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[n], total[some]]))], ["term", "k"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = EXAMPLES) -> Index:
    """The index of at most ``most`` labelled examples that are not held out, of ``labels(doc_id, <label>)``.

    Statistics of terms and labels come from the examples; document frequencies
    for the IDF come from all of ``docs(doc_id, text)``. The driver gets the words
    of the examples, their vectors and the votes on them. Repeated labels of a
    document count once, as the largest; null labels and ids do not count.
    """
    sc = docs.sparkSession.sparkContext
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    one = usable.groupBy(F.col("doc_id").alias("id")).agg(F.max(label).cast("int").alias("label")).withColumn("ticket", F.xxhash64("id"))
    few = one.orderBy("ticket").limit(most)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = cut(texts.join(F.broadcast(few), "id").select(F.col("id").cast("long").alias("id"), "ticket", "label", "text"))

    each = cut(sample.mapInArrow(_term_labels, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    counts = {r.label: r["count"] for r in few.groupBy("label").count().collect()}
    p, n = float(counts.get(1, 0)), float(counts.get(0, 0))
    cross = F.col("pos") * (n - F.col("neg")) - F.col("neg") * (p - F.col("pos"))
    margins = (F.col("pos") + F.col("neg")) * (p + n - F.col("pos") - F.col("neg")) * p * n
    chi2 = F.when(margins > 0, cross * cross * (p + n) / margins).otherwise(0.0)
    weight = F.pow(F.greatest(F.sqrt(chi2) - SIGMAS, F.lit(0.0)), F.lit(2.0))
    kept = each.select("term", weight.alias("weight")).where("weight > 0").orderBy("term").toArrow()
    telling = kept["term"].to_numpy().view(np.uint64)
    every = sample.mapInArrow(_words, "term long").distinct().toArrow()["term"].to_numpy().view(np.uint64)
    vocabulary = np.union1d(every, telling)
    more = np.zeros(len(vocabulary))
    more[np.searchsorted(vocabulary, telling)] = kept["weight"].to_numpy()

    shared = sc.broadcast(vocabulary)
    df = np.zeros(len(vocabulary) + 1, np.int64)
    counted = texts.select("text").mapInArrow(partial(_document_counts, vocabulary=shared), "term long, k long").groupBy("term").agg(F.sum("k").alias("k")).toArrow()
    df[counted["term"].to_numpy()] = counted["k"].to_numpy()
    idf = np.log(1 + df[-1] / np.maximum(df[:-1], 1)) * (1 + more)

    examples = staged(sample.mapInArrow(partial(_examples, vocabulary=shared), "id long, ticket long, label int, terms array<int>, times array<int>"), "examples")
    got = examples.toArrow()
    got = got.take(pa.array(np.lexsort((got["id"].to_numpy(), got["ticket"].to_numpy())), pa.int64())).combine_chunks()
    ids, votes = got["id"].to_numpy(), got["label"].to_numpy().astype(np.float64)
    flattened = lambda c: np.concatenate([np.empty(0, np.int32), *(x.flatten().to_numpy() for x in got[c].chunks)])
    terms, times = flattened("terms"), flattened("times")
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.concatenate([np.empty(0, np.int64), *(x.value_lengths().to_numpy() for x in got["terms"].chunks)]))
    w = (1 + np.log(times)) * idf[terms]
    w = (w / np.sqrt(np.bincount(owner, w * w, len(ids)))[owner]).astype(np.float32)
    order = np.argsort(terms, kind="stable")
    lists = np.searchsorted(terms[order], np.arange(len(vocabulary) + 1)), owner[order], w[order]
    none = np.bincount(owner, more[terms] > 0, len(ids)) == 0
    rate = float(votes.mean()) if len(votes) else 0.0
    base = float((votes[none].sum() + rate) / (none.sum() + 1))
    index = Index(vocabulary, idf, ids, votes, lists, base)
    index.shared = sc.broadcast(index)
    left = examples.mapInArrow(partial(_left_out, index=index.shared), "label int, vote double").toArrow()
    index.curve = fitted_curve(left["vote"].to_numpy(), left["label"].to_numpy().astype(np.float64))
    return index


def _scored(batches: Iterator[pa.RecordBatch], index, curve: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = index.value.scores(list(term_counts(batch.column("text"), index.value.vocabulary)), curve)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= 0.5) for s, _ in got], pa.int32()), pa.array([e for _, e in got], pa.list_(pa.int64()))],
            ["doc_id", "held_out", "score", "predicted", "evidence"],
        )


def classify(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for each row of ``docs(doc_id, text)``.

    ``predicted`` is 1 from a score of 0.5 up; ``evidence`` lists the nearest
    examples' ids. A text without any word of the examples (also a null or empty
    one) has the rate of examples without telling terms and no evidence. Whole texts count, however long;
    repeated rows are rows of their own; a null doc_id is not held out; an empty
    table gives an empty one; other columns are never read.
    """
    shared = getattr(index, "shared", None) or docs.sparkSession.sparkContext.broadcast(index)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_scored, index=shared, curve=index.curve), f"doc_id {kind}, held_out boolean, score double, predicted int, evidence array<long>")
