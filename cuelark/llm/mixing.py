"""Mixing sources to target weights: Sainte-Laguë apportionment of token blocks.

A source's documents are dealt over shards by a seeded hash and laid on each
shard's token axis in seeded order; the axis is cut into blocks of equal tokens.
Sainte-Laguë gives each source its number of blocks by its target, and each of
its shards an integer quota by the shard's tokens. A quota takes the axis from
its start: whole laps repeat every document, the last lap takes the first blocks
of the seeded order. Only DataFrame operations; the only sorts are within one
shard of one source, and the rankings of the small source and shard tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelark.llm.storage import cut

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST = 3
#: Tokens of a block, documents that a shard is meant to hold, and the seed.
BLOCK, SHARD_DOCS, SEED = 64, 4096, "mix-1"
#: Ids of which the join with the texts may be broadcast (16 bytes each).
BROADCAST_IDS = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for ``sizes(source, source_size)``, one row a source.

    Sources in code-point order, null last, take the repeating weights and share
    the sum of all sizes. No target passes ``most`` times its size; what is over
    goes to the others by weight. The closed form: sources stop in the order of
    cap by weight, so the level at which the sharing ends is the first at which
    the next source does not stop.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", share.cast("double").alias("w"), (F.col("source_size") * most).cast("double").alias("cap"))
    all_rows = Window.partitionBy()
    stops = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "total": F.sum("source_size").over(all_rows).cast("double"),
        "left_w": F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
    }).withColumn("level", (F.col("total") - F.col("full")) / F.col("left_w"))
    # The first source in that order that does not stop has the level.
    free = F.min(F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct(F.row_number().over(stops).alias("turn"), "level"))).over(all_rows)["level"]
    return rows.select("source", "source_size", F.least("cap", F.coalesce(free * F.col("w"), F.col("cap"))).alias("target"))


def sainte_lague(rows: DataFrame, group: list[str], key: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: the seats of each row by Sainte-Laguë within its group.

    ``seats`` seats go one by one to the highest quotient weight / (2 * given + 1).
    A row's share of seats q by proportion differs from the result by at most
    q * n / (2 * seats) + 1 for n rows, so all seats below that are given at once
    and only the quotients near it, O(n) in all, are ranked. Ties go by key.
    """
    each = Window.partitionBy(*group)
    q = F.when(F.col("_sum") > 0, F.col(weight) / F.col("_sum") * F.col(seats)).otherwise(F.lit(0.0))
    wide = F.ceil(F.col("_q") * F.col("_n") / (2 * F.greatest(F.col(seats), F.lit(1))) + 1)
    base = rows.withColumns({"_sum": F.sum(weight).over(each), "_n": F.count("*").over(each)}).withColumn("_q", q)
    base = base.withColumn("_low", F.greatest(F.floor("_q") - wide, F.lit(0)).cast("long")).withColumn("_high", (F.ceil("_q") + wide).cast("long"))
    base = base.withColumn("_open", F.col(seats) - F.sum("_low").over(each))
    near = base.withColumn("_k", F.explode(F.sequence("_low", "_high"))).withColumn("_quotient", F.col(weight) / (2 * F.col("_k") + 1))
    best = Window.partitionBy(*group).orderBy(F.col("_quotient").desc(), *[F.col(c).asc_nulls_last() for c in key])
    won = near.withColumn("_rank", F.row_number().over(best)).withColumn("_won", (F.col("_rank") <= F.col("_open")) & (F.col(weight) > 0))
    names = rows.columns
    return won.groupBy(*names).agg((F.min("_low") + F.sum(F.col("_won").cast("long"))).alias(out))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs(doc_id, source, text)``.

    ``size`` counts the words of the text (null or blank: 0, and nothing is taken
    of it), ``target`` is the source's, ``taken`` is how many words the mix takes
    of the row, repeats counted, never over ``most`` times its size. The null
    source is a source. Rows that repeat a doc_id are rows of their own; equal
    rows tie and share what they get in any order. Reruns agree. An empty table
    gives an empty one; other columns are never read. A source of no words has
    target 0.
    """
    sized = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    dealt = sized.withColumn("ticket", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    dealt = cut(dealt)
    counted = dealt.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / shard_docs).cast("long").alias("shards"))
    aims = targets(counted.select("source", "source_size"), weights, most)
    counted = counted.join(aims.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    blocks = F.floor(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    counted = counted.withColumn("all_blocks", blocks).withColumn("one", F.lit(1))
    sources = cut(sainte_lague(counted, ["one"], ["source"], "target", "all_blocks", "blocks").drop("one", "all_blocks"))

    spread = F.pmod(F.conv(F.substring("ticket", 1, 8), 16, 10).cast("long"), F.col("shards"))
    named = sources.select(F.col("source").alias("s"), "source_size", "target", "shards", "blocks")
    placed = dealt.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("shard", spread)
    cells = placed.groupBy("source", "shard", "blocks").agg(F.sum("size").alias("cell")).withColumn("cell", F.col("cell").cast("long"))
    quotas = sainte_lague(cells, ["source"], ["shard"], "cell", "blocks", "quota").select(F.col("source").alias("s"), F.col("shard").alias("h"), "cell", "quota")
    placed = placed.join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h"))).drop("s", "h")

    axis = Window.partitionBy("source", "shard").orderBy("ticket", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("size").over(axis), F.lit(0)).cast("long")
    words = F.least(F.col("quota") * block, F.col("cell") * most)
    laps = F.when(F.col("cell") > 0, F.expr("words div cell")).otherwise(0)
    last = F.greatest(F.least(F.col("begin") + F.col("size"), F.col("words") - F.col("laps") * F.col("cell")) - F.col("begin"), F.lit(0))
    taken = placed.withColumn("begin", begin).withColumn("words", words).withColumn("laps", laps).withColumn("taken", (F.col("laps") * F.col("size") + last).cast("long"))
    return taken.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, with their columns as they were.

    A document comes once for each whole time that ``mix`` takes it, and once more
    if the last time takes half of it or more; only where a shard's quota ends can
    that be a part. What is taken of no document, such as one without words, goes.
    Rows that repeat a doc_id come alike often, as the one taken most; rows without
    doc_id count as one such group.
    """
    taken = mix(docs, **how).where("taken > 0")
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    times = taken.groupBy(F.col("doc_id").alias("_mix_id")).agg(F.max(copies).alias("_mix_copies")).where("_mix_copies > 0")
    times = cut(times)
    times = F.broadcast(times) if times.count() <= BROADCAST_IDS else times
    own = docs.columns
    met = docs.select("*", F.col("doc_id").alias("_mix_key")).join(times, F.col("_mix_key").eqNullSafe(F.col("_mix_id")))
    return met.withColumn("_mix_turn", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*own)
