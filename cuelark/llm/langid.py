"""Language identification by n-gram filters with a bit for each language.

One Bloom filter a language, stored bit-sliced: the filters share their hash
positions, and each position holds a bitmask with one bit a language. The AND of
an n-gram's positions is the mask of all languages that contain it. A text's
popcounts, one a language, are corrected for the filters' false positives and
the largest decides.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelark.llm.storage import cut
from cuelark.llm.textbatch import U64, mixed

#: Lengths of the n-grams, in characters; a word's edges count as blanks.
LENGTHS = (2, 3, 4)  # 2 at least
#: Positions of a filter at least (8 languages a byte), for each n-gram of the largest language, and looked at for an n-gram.
POSITIONS, ROOM, PROBES = 1 << 20, 8, 3
#: Different texts that a language is learnt from at most (about; dealt by a hash of the text).
SAMPLE_DOCS = 2_000
#: An n-gram belongs to a language if this share of the most frequent language's rate is reached, and this share of its texts.
LEAST_SHARE, LEAST_RATE = 0.2, 0.0015
PIECE_CHARS = 1 << 17
UNKNOWN = "und"

_rng = np.random.Generator(np.random.PCG64(99))
GRAM_FACTORS = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * U64(2) + U64(1)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)]))
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the text of each, and whether each text has a letter.

    Texts are lower-cased; every run of other characters than letters is one
    blank; blanks stand before and after a text, and no n-gram has one inside.
    """
    body = "\0".join(["", *((t or "").replace("\0", " ").lower() for t in texts), ""])
    code = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.cumsum(code == 0) - 1
    is_letter = letter_table()[code]
    keep = is_letter | np.concatenate([[True], is_letter[:-1]]) | (code == 0)
    code, text, is_letter = np.where(is_letter, code, 0)[keep].astype(np.uint64), text[keep], is_letter[keep]
    has = np.zeros(len(texts) + 1, bool)
    has[text[is_letter]] = True
    hashes, owners = [], []
    for n in LENGTHS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        whole = np.ones(m, bool)
        for j in range(n):
            h += (code[j : j + m] + U64(1)) * GRAM_FACTORS[j]
            if 0 < j < n - 1:
                whole &= is_letter[j : j + m]
        if n == 2:
            whole &= is_letter[:m] | is_letter[1 : 1 + m]
        hashes.append(mixed(h[whole] + U64(n)))
        owners.append((text[1 : 1 + m] if n > 2 else np.where(is_letter[:m], text[:m], text[1 : 1 + m]))[whole])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), has[:-1]
    return np.concatenate(hashes), np.concatenate(owners), has[:-1]


def portions(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about PIECE_CHARS characters, with the place of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PIECE_CHARS:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


@dataclass
class Filters:
    """Bit-sliced Bloom filters of all languages."""

    langs: list[str]
    rate: np.ndarray  # of false positives, a language
    slices: np.ndarray  # (positions, bytes of a mask)

    @staticmethod
    def places(h: np.ndarray, positions: int) -> Iterator[np.ndarray]:
        """Where an n-gram's bits are, by double hashing; ``positions`` is a power of two."""
        step = (h >> U64(32)) | U64(1)
        for probe in range(PROBES):
            yield ((h + U64(probe) * step) & U64(positions - 1)).astype(np.int64)

    @classmethod
    def of(cls, langs: list[str], members: list[np.ndarray]) -> Filters:
        """Filters sized by the language of most n-grams."""
        positions = max(POSITIONS, 1 << (ROOM * max((len(h) for h in members), default=0)).bit_length())
        slices = np.zeros((positions, (len(langs) + 7) // 8), np.uint8)
        rate = np.zeros(len(langs))
        for i, h in enumerate(members):
            for at in cls.places(h, positions):
                slices[at, i // 8] |= np.uint8(128 >> i % 8)
            rate[i] = np.mean((slices[:, i // 8] >> np.uint8(7 - i % 8)) & 1) ** PROBES
        return cls(langs, rate, slices)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of all languages that contain it."""
        found = None
        for at in self.places(h, len(self.slices)):
            found = self.slices[at] if found is None else found & self.slices[at]
        return found

    def counts(self, h: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, popcounts a text and language)."""
        masks, total = self.masks(h), np.bincount(owner, minlength=texts)
        found = np.empty((texts, len(self.langs)))
        for i in range(len(self.langs)):
            found[:, i] = np.bincount(owner, (masks[:, i // 8] >> np.uint8(7 - i % 8)) & 1, texts)
        return total, found

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for _, part in portions(texts):
            h, owner, has = grams(part)
            total, found = self.counts(h, owner, len(part))
            held = np.maximum(found - total[:, None] * self.rate, 0) / (1 - self.rate)
            best = held.argmax(1) if len(self.langs) else np.zeros(len(part), int)
            for i in range(len(part)):
                if not has[i] or not self.langs:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    names.append(self.langs[best[i]])
                    whole = held[i].sum()
                    scores.append(float(held[i, best[i]] / whole) if whole > 0 else 0.0)
        return names, scores


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of a language each n-gram is, by parts."""
    for batch in batches:
        langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for _, part in portions(own):
                h, owner, _ = grams(part)
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                gram, docs = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(docs.astype(np.int64))], ["lang", "gram", "docs"])


def _decided(batches: Iterator[pa.RecordBatch], filters) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, scores = filters.value.decide(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def held_out(doc_id) -> F.Column:
    """Rows that nothing is learnt from: crc32 of the id as text is divisible by 5; false without id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Filters from the text and non-null lang of ``docs(lang, text)``.

    A language is learnt from about ``sample_docs`` of its different texts, chosen
    by a hash of the text, or from all where it has fewer; a text that stands in
    many rows counts once. The driver gets the n-grams that belong to a language,
    which the sample bounds.
    """
    rows = docs.where("lang is not null and text is not null").select("lang", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("ticket"))
    sizes = {r.lang: r["count"] for r in rows.select("lang", "ticket").distinct().groupBy("lang").count().collect()}
    if not sizes:
        return Filters.of([], [])
    part = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample_docs / n))])
    chosen = cut(rows.where((F.col("ticket").bitwiseAND(0xFFFFFF) / 0x1000000) < part[F.col("lang")]).dropDuplicates(["lang", "ticket"]).select("lang", "text"))
    taken = {r.lang: r["count"] for r in chosen.groupBy("lang").count().collect()}
    langs = sorted(taken)
    if not langs:
        return Filters.of([], [])
    of = F.create_map(*[F.lit(x) for lang in langs for x in (lang, float(taken[lang]))])
    counted = chosen.mapInArrow(_counted, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    rated = cut(counted.select("lang", "gram", (F.col("docs") / of[F.col("lang")]).alias("rate")).where(F.col("rate") >= LEAST_RATE))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    got = rated.join(top, "gram").where(F.col("rate") >= LEAST_SHARE * F.col("top")).select("lang", "gram").toArrow()
    place = {lang: i for i, lang in enumerate(langs)}
    at, values = np.array([place[x] for x in got["lang"].to_pylist()], np.int64), got["gram"].to_numpy().view(np.uint64)
    return Filters.of(langs, [values[at == i] for i in range(len(langs))])


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs(doc_id, text)``.

    ``lang_pred`` is a learned language, or ``und`` (score 0) if the text is null
    or has no letter, or nothing was learned. ``score`` is the language's part of
    all corrected counts; 0 where no n-gram is known. Ties go to the first language by
    name. Whole texts count, however long; repeated rows are rows of their own;
    an empty table gives an empty one; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_decided, filters=shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
