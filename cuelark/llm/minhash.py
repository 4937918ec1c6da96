"""MinHash near-duplicates: universal minima, bands, verification, components.

The shape of the job, each step linear in what it reads:

1. One pass over the texts makes each document's shingle set, its minima and
   its band keys. Equal sets are one class from here on, so a group of copies,
   however large, is a single row.
2. Band keys shared by two classes or more are buckets. Buckets of at most
   ``SMALL`` classes give all their pairs. A larger bucket gives star edges: its
   most central class (the one whose buckets are fullest) against all others.
3. Pairs whose minima agree too rarely are dropped, the rest are confirmed on
   the full sets, and confirmed links are merged into components.
4. Classes that stars hold together are a group; it is done if it now lies in one
   component. In the others every set gives its rarest shingles, as many as any
   link must share one of; shingles that classes of two components give make
   families, mostly far smaller than the groups. In a family the classes outside
   the largest component are compared with all on full sets, in blocks of bounded
   size, so no link between different sets is lost and no family is ever gathered
   whole. A block gives a spanning forest of its links, not all of them.

A class is named after its smallest doc_id. Where a doc_id repeats with different
texts, one name may stand for several sets: it is then linked with whatever one of
them is linked with, as a document is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelark.llm.components import connected_components
from cuelark.llm.joins import spread_join
from cuelark.llm.storage import cut, small_batches, staged
from cuelark.llm.textbatch import U64, mixed, shingle_sets

WORDS = 5
BANDS, ROWS = 32, 5
MINIMA = BANDS * ROWS
#: Largest bucket that gives all its pairs.
SMALL = 16
#: Classes and shingles of a block at most (about), and columns of its matrix at a time.
BLOCK, BLOCK_ITEMS, COLUMNS = 2048, 1_000_000, 1024
#: A family is cut into so many blocks at least, unless they are smaller than that.
LEAST_BLOCKS, LEAST_BLOCK = 16, 128
#: Ids of which the text join may be broadcast (16 bytes each).
BROADCAST_IDS = 1_000_000
#: Cells of the table of how often shingles occur.
CELLS = 1 << 20

_rng = np.random.Generator(np.random.PCG64(4711))
FACTORS = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * U64(2) + U64(1)
TERMS = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * U64(2)
BAND_FACTORS = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * U64(2) + U64(1)
BAND_TERMS = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)

FINGERPRINT = "doc_id long, n long, d1 long, d2 long, bands array<long>, minima binary"


def minima(s: np.ndarray) -> np.ndarray:
    """The upper halves of the smallest values of each universal hash (multiply-add-shift) over a set."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 512):
        np.minimum(least, (s[a : a + 512, None] * FACTORS + TERMS).min(0), out=least)
    return least >> U64(32)


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n, d1, d2, bands, low = batch.column("doc_id"), [], [], [], [], []
        for s in shingle_sets(batch.column("text"), k):
            n.append(len(s))
            d1.append(np.bitwise_xor.reduce(mixed(s)) if len(s) else U64(0))
            d2.append(mixed(s + U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
            if len(s):
                m = minima(s)
                bands.append(mixed((m.reshape(BANDS, ROWS) * BAND_FACTORS).sum(1, dtype=np.uint64) + BAND_TERMS).view(np.int64))
                low.append((mixed(m) & U64(255)).astype(np.uint8).tobytes())
            else:
                bands.append(None)
                low.append(None)
        yield pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())],
            ["doc_id", "n", "d1", "d2", "bands", "minima"],
        )


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The sets of texts whose digest is the one asked for."""
    for batch in batches:
        sets = list(shingle_sets(batch.column("text"), k))
        asked = batch.column("d1").to_numpy().view(np.uint64)
        found = [i for i, s in enumerate(sets) if len(s) and np.bitwise_xor.reduce(mixed(s)) == asked[i]]
        at = pa.array(found, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("d1").take(at), pa.array([sets[i].tobytes() for i in found], pa.binary())], ["id", "d1", "items"])


def agreement(num: int, den: int) -> int:
    """How many minima must agree: six standard deviations below what ``num/den`` leads one to expect."""
    tau = num / den
    return max(1, int(MINIMA * (tau - 6 * (tau * (1 - tau) / MINIMA) ** 0.5)))


def _alike(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, MINIMA) for c in ("minima_a", "minima_b"))
        yield batch.select(["a", "b"]).filter(pa.array((left == right).sum(1) >= least))


def _confirmed(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
            s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(den * both >= num * (len(s) + len(t) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _forest(links: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of a bipartite graph given as a boolean matrix, as (row, column)."""
    rows_left, columns_left = links.any(1), links.any(0)
    for root in range(len(links)):
        if not rows_left[root]:
            continue
        rows_left[root] = False
        rows = [root]
        while rows:
            row = rows.pop()
            for column in np.flatnonzero(links[row] & columns_left):
                columns_left[column] = False
                yield row, int(column)
                more = np.flatnonzero(links[:, column] & rows_left)
                rows_left[more] = False
                yield from ((int(r), int(column)) for r in more)
                rows.extend(more.tolist())


def _linked(table: pa.Table, same: bool, num: int, den: int) -> pa.Table:
    """A spanning forest of the links between two blocks (or inside one) of different components.

    Sizes of intersections are a product of two incidence matrices over the
    shingles that more than one set has, some columns at a time.
    """
    side = table.column("side").to_numpy()
    at = [np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))]
    if not len(at[0]) or not len(at[1]):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    ids, comp = table.column("id").to_numpy(), table.column("component").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
    n = np.array([len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    live = np.cumsum(count > 1) - 1
    owner, keep = np.repeat(np.arange(len(sets)), n), (count > 1)[column]
    column, owner = live[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((len(at[0]), len(at[1])), np.float32)
    for low in range(0, int(live[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        shared += dense[at[0]] @ dense[at[1]].T
    n, c, i = ([x[k] for k in at] for x in (n, comp, ids))
    links = (den * shared >= num * (n[0][:, None] + n[1] - shared)) & (c[0][:, None] != c[1])
    found = list(_forest(links))
    left, right = i[0][[r for r, _ in found]], i[1][[k for _, k in found]]
    return pa.table({"a": np.minimum(left, right).astype(np.int64), "b": np.maximum(left, right).astype(np.int64)})


def _cells(items: np.ndarray) -> np.ndarray:
    return (items >> U64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task's sets fall into each cell."""
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        for x in batch.column("items"):
            np.add.at(total, _cells(np.frombuffer(x.as_buffer(), np.uint64)), 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "times"])


def rarest(items: np.ndarray, often: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest shingles of a set, as many as every linked set shares one of.

    A link has at least ``num/den`` of either set in common, so two linked sets
    cannot be apart in the first ``n - ceil(n * num / den) + 1`` of any one order.
    """
    first = len(items) - -(-len(items) * num // den) + 1
    return items[np.lexsort((items, often[_cells(items)]))[:first]]


def _keys(batches: Iterator[pa.RecordBatch], often, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """A row for each of a set's rarest shingles."""
    for batch in batches:
        sets = [rarest(np.frombuffer(x.as_buffer(), np.uint64), often.value, num, den) for x in batch.column("items")]
        ids, comp = (np.repeat(batch.column(c).to_numpy(), [len(x) for x in sets]) for c in ("id", "component"))
        items = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
        for a in range(0, len(ids), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(comp[part]), pa.array(items[part])], ["id", "component", "item"])


class _Links:
    """Confirms candidate pairs of classes; holds the sets of those that may be asked for."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int):
        self.docs, self.classes, self.k, self.num, self.den = docs, classes, k, num, den
        self.sets: DataFrame | None = None

    def _both(self, pairs: DataFrame, sides: DataFrame) -> DataFrame:
        """Pairs with the columns of either class; a class of many pairs is dealt over several tasks."""
        rows, met = pairs.count(), pairs
        for side in ("a", "b"):
            own = sides.select(*[F.col(c).alias(side if c == "id" else f"{c}_{side}") for c in sides.columns])
            met = spread_join(met, own, [side], counts=pairs.groupBy(side).agg(F.count("*").alias("_c")), rows=rows)
        return met

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the link and whose minima agree often enough."""
        fits = F.least("n_a", "n_b") * self.den >= F.greatest("n_a", "n_b") * self.num
        return self._both(pairs, self.classes.select("id", "n", "minima")).where(fits).mapInArrow(partial(_alike, least=agreement(self.num, self.den)), "a long, b long")

    def gather(self, ids: DataFrame) -> None:
        """Makes the full sets of these classes, from one more read of the texts."""
        near = cut(ids.distinct().join(self.classes.select("id", "d1"), "id"))
        asked = near.count()
        texts = self.docs.select(F.col("doc_id").alias("id"), "text").where("id is not null")
        near = F.broadcast(near) if asked <= BROADCAST_IDS else near
        self.sets = staged(texts.join(near, "id").mapInArrow(partial(_sets, k=self.k), "id long, d1 long, items binary"), "sets")
        if self.sets.count() > asked:  # repeated rows
            self.sets = staged(self.sets.dropDuplicates(["id", "d1"]), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        return self._both(pairs, self.sets.select("id", "items")).mapInArrow(partial(_confirmed, num=self.num, den=self.den), "a long, b long")


def _stars(big: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's most central class, the hub, with every other class in it."""
    hub = big.groupBy("key").agg(F.max_by("id", F.struct("central", -F.col("id"))).alias("hub"))
    met = spread_join(big, hub, ["key"]).where("id <> hub")
    return met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _families(held: DataFrame, num: int, den: int) -> DataFrame:
    """(id, family): classes that may have a link to one of another component.

    They give a rare shingle that a class of another component gives as well.
    """
    spark = held.sparkSession
    often = np.zeros(CELLS, np.int64)
    seen = held.select("items").mapInArrow(_often, "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times")).toArrow()
    often[seen["cell"].to_numpy()] = seen["times"].to_numpy()
    keys = staged(held.select("id", "component", "items").mapInArrow(partial(_keys, often=spark.sparkContext.broadcast(often), num=num, den=den), "id long, component long, item long"), "keys")
    shared = cut(keys.groupBy("item").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("id").alias("hub"), F.count("*").alias("_c")).where("lo <> hi"))
    met = spread_join(keys.select("id", "item"), shared.select("item", "hub"), ["item"], counts=shared, rows=keys.count())
    return connected_components(met.select(F.col("id").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("id"), F.col("component").alias("family"))


def _settled(stars: DataFrame, comps: DataFrame, links: _Links) -> DataFrame | None:
    """Edges for the links that stars have missed in groups of more than one component; None if there are no such."""
    num, den = links.num, links.den
    groups = connected_components(stars).withColumnRenamed("node", "id").withColumnRenamed("component", "group")
    named = cut(groups.join(comps.withColumnRenamed("node", "id"), "id", "left").select("id", "group", F.coalesce("component", "id").alias("component")))
    mixed_ones = named.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("group")
    rest = cut(spread_join(named, mixed_ones, ["group"]).select("id", "component"))
    if rest.isEmpty():
        return None
    held = staged(rest.join(links.sets.select("id", "items"), "id"), "held")
    near = cut(_families(held, num, den))
    if near.isEmpty():
        return None
    sized = staged(held.join(near, "id").withColumn("n", (F.octet_length("items") / 8).cast("long")), "sized")
    inside = (F.col("component") == F.col("main")).cast("int")
    largest = sized.groupBy("family", "component").agg(F.count("*").alias("c")).groupBy("family").agg(F.max_by("component", F.struct("c", -F.col("component"))).alias("main"))
    marked = spread_join(sized.select("id", "family", "component", "n"), largest, ["family"]).withColumn("inside", inside)
    size = F.greatest(F.lit(min(LEAST_BLOCK, BLOCK)), F.least(F.lit(BLOCK), F.ceil(F.count("*") / LEAST_BLOCKS)))
    blocks = marked.groupBy("family").agg(F.max("main").alias("main"), *[
        F.ceil(F.greatest(F.sum(F.when(F.col("inside") == k, 1).otherwise(0)) / size, F.sum(F.when(F.col("inside") == k, F.col("n")).otherwise(0)) / BLOCK_ITEMS)).cast("long").alias(f"blocks_{k}") for k in (0, 1)
    ])
    dealt = spread_join(sized, cut(blocks), ["family"]).withColumn("inside", inside).where("blocks_0 > 0")
    mine = dealt.withColumn("mine", F.when(F.col("inside") == 1, F.col("blocks_0") + F.pmod(F.xxhash64("id"), F.col("blocks_1"))).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks_0"))))
    # Blocks outside the largest component meet all blocks, those inside it only the ones outside.
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("inside") == 1, F.col("blocks_0")).otherwise(F.col("blocks_0") + F.col("blocks_1")) - 1)
    laid = mine.withColumn("other", F.explode(others)).select("id", "family", "component", "items", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"))

    def pairs(key, table):
        return _linked(table, key[1].as_py() == key[2].as_py(), num, den)

    return laid.groupBy("family", "i", "j").applyInArrow(pairs, "a long, b long")


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text)``.

    Two documents are linked if ``den * |A & B| >= num * |A | B|`` for their sets
    of distinct ``k``-word shingles; a component is what links reach, named after
    its smallest doc_id, and ``kept`` marks that one. A text of fewer than ``k``
    words is one shingle; one that is null, empty or blank has none and is linked
    with nothing. A very long text is taken whole. Rows that repeat a doc_id
    belong to one document: its component is one, the links of each of its texts
    are its own, and each row has its own set size. Rows without doc_id come back
    with a null component, not kept. Ties need no rule. An empty table gives an
    empty one; other columns are never read.
    """
    with small_batches(docs.sparkSession):  # all that runs Python is done in here
        return _classed(docs, num, den, k)


def _classed(docs: DataFrame, num: int, den: int, k: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = staged(texts.mapInArrow(partial(_fingerprints, k=k), FINGERPRINT), "fingerprints")
    known = prints.where("n > 0 and doc_id is not null")
    first = cut(known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id"), F.count("*").alias("_c")))
    own = known.withColumnRenamed("doc_id", "id").join(first.drop("_c"), ["id", "n", "d1", "d2"])
    classes = staged(own.select("id", "n", "d1", "d2", "bands", "minima").dropDuplicates(["id", "n", "d1", "d2"]), "classes")

    rows = classes.select("id", "n", F.explode("bands").alias("key"))
    shared = cut(rows.groupBy("key").agg(F.count("*").alias("_c")).where("_c > 1"))
    buckets = cut(spread_join(rows, shared, ["key"], counts=shared, rows=classes.count() * BANDS).withColumnRenamed("_c", "c"))
    few = buckets.where(F.col("c") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    pairs = few.select(F.explode(F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b").distinct()
    central = buckets.where(F.col("c") > SMALL).groupBy("id").agg(F.sum("c").alias("central"))
    big = cut(buckets.where(F.col("c") > SMALL).join(central, "id").select("key", "id", "n", "central"))
    wide = not big.isEmpty()

    links = _Links(texts, classes, k, num, den)
    if wide:
        stars = cut(_stars(big))
        pairs = pairs.unionByName(stars).distinct()
    pairs = cut(links.alike(cut(pairs)))
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    links.gather(asked.unionByName(big.select("id")) if wide else asked)
    edges = links.confirmed(pairs)
    # A document of several texts holds their classes together.
    several = cut(prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo <> hi").select("doc_id"))
    repeated = not several.isEmpty()
    if repeated:
        texts_of = known.select("doc_id", "n", "d1", "d2").join(several, "doc_id").join(first.drop("_c"), ["n", "d1", "d2"]).select("doc_id", "id")
        edges = edges.unionByName(texts_of.select(F.col("id").alias("a"), F.col("doc_id").alias("b")))
    comps = connected_components(edges)
    more = _settled(stars, comps, links) if wide else None
    if more is not None:
        comps = connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    # Every row has the component of its class.
    label = first.join(comps.withColumnRenamed("node", "id"), "id", "left").select("n", "d1", "d2", F.coalesce("component", "id").alias("component"))
    slim = prints.select("doc_id", "n", "d1", "d2")
    met = spread_join(slim.where("n > 0 and doc_id is not null"), label, ["n", "d1", "d2"], counts=first, rows=prints.count())
    none = slim.where("n = 0 or doc_id is null").withColumn("component", F.col("doc_id"))
    out = met.unionByName(none)
    if repeated:
        one = several.join(out, "doc_id").groupBy("doc_id").agg(F.min("component").alias("_one"))
        out = out.join(cut(one), "doc_id", "left").withColumn("component", F.coalesce("_one", "component"))
    kept = F.coalesce(F.col("component") == F.col("doc_id"), F.lit(False))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, num: int = 80, den: int = 100, k: int = WORDS) -> DataFrame:
    """The rows of ``docs`` without near copies, with their columns as they were.

    The document of the smallest doc_id stays of each component of
    ``near_duplicates``. Of rows that repeat its doc_id and text one stays, the one
    whose columns have the smallest hash; rows of its doc_id and another text stay.
    Rows without doc_id stay.
    """
    found = near_duplicates(docs, num, den, k)
    gone = cut(found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    left = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    repeated = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")))
    if repeated.isEmpty():
        return left
    again = F.col("doc_id") == F.col("_again")
    one = Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
    single = left.join(repeated, again, "left_semi").withColumn("_turn", F.row_number().over(one)).where("_turn = 1").drop("_turn")
    return left.join(repeated, again, "left_anti").unionByName(single)
