"""Document fingerprints by SpotSigs: chains of content words after common words.

An anchor is a common word, or the beginning of the text; its signature is the
hash of the next CHAIN content words, common words left out. A document's
fingerprint is its sorted set of signatures. Only DataFrame functions: one
pattern finds all anchors with the stretch that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelark.llm.joins import spread_join
from cuelark.llm.storage import cut

#: Common words: they anchor chains and do not count in them. Fixed values.
COMMON = (
    "a an and are as at be but by for from has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "als am auf aus bei das dass dem den der des die ein eine einem einen einer er es für im ist mit nach nicht sich sie sind und vom von war wie wird zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les mais ne nous ou par pas plus pour que qui sa se ses son sont sur un une vous "
    "al como con del el ella ellos ese esta este fue ha hay las lo los más muy no o para pero por sin sobre su sus una uno y ya"
).split()
CHAIN = 3
LETTER, BREAK = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"


def _tree(words: set[str]) -> str:
    """A pattern for any of the words that looks at each character once."""
    ends = "" in words
    heads = sorted({w[0] for w in words if w})
    tails = {c: {w[1:] for w in words if w[:1] == c} for c in heads}
    single = [c for c in heads if tails[c] == {""}]
    parts = ([f"[{''.join(single)}]" if len(single) > 1 else single[0]] if single else []) + [c + _tree(tails[c]) for c in heads if c not in single]
    if not parts:
        return ""
    return (parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)})") + ("?+" if ends else "")


#: Longest first by its possessive steps; a longer word of letters is none of them.
_common = _tree(set(COMMON)) + f"(?!{LETTER})"
_skip = rf"(?:{_common}(?:{BREAK}++|\z))*+"
_word = rf"{LETTER}++"
#: Group 1 is the stretch from the first to the last content word of the chain, fewer at the text's end.
ANCHORED = rf"(?:\A{BREAK}*+|(?<!{LETTER}){_common}{BREAK}++)(?={_skip}({_word}(?:{BREAK}++{_skip}{_word}){{0,{CHAIN - 1}}}+))"
COMMON_INSIDE = rf"{BREAK}++(?:{_common}(?:{BREAK}++|$))*+"


def signatures(text: Column) -> Column:
    """Sorted distinct signatures of a text, 8 hexadecimal digits each; none for null and for texts without letters or digits."""
    stretches = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ANCHORED), F.lit(1))
    hashed = F.transform(stretches, lambda s: F.left(F.md5(F.regexp_replace(s, COMMON_INSIDE, " ").cast("binary")), F.lit(8)))
    return F.array_sort(F.array_distinct(hashed))


def fingerprint(found: Column) -> Column:
    """The signatures as one string."""
    return F.array_join(found, " ")


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 1 for two empty ones.

    Where the lengths alone rule ``least`` out the sets are not looked at: 0.
    """
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both)
    pruned = F.when(F.least(F.size(a), F.size(b)) < F.lit(least) * F.greatest(F.size(a), F.size(b)), 0.0).otherwise(exact)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(pruned).cast("double")


def _neighbours(docs: DataFrame) -> DataFrame:
    """(id, n, next, prev, prev_n) for each distinct non-null doc_id, next being the next smaller one, after the last the first.

    Ids are dealt by range, so that no task orders them all; the ends of the
    ranges, a row each, tell the next id across a border.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("n").alias("n"))
    dealt = cut(ids.repartitionByRange(parts, F.desc("id")).withColumn("part", F.spark_partition_id()))
    ends = dealt.groupBy("part").agg(F.max(F.struct("id", "n")).alias("first"), F.min(F.struct("id", "n")).alias("last"))
    row = Window.orderBy("part")
    whole = Window.partitionBy()
    ends = ends.select("part", F.coalesce(F.lead("first").over(row), F.max("first").over(whole)).alias("after"), F.coalesce(F.lag("last").over(row), F.min("last").over(whole)).alias("before"))
    order = Window.partitionBy("part").orderBy(F.desc("id"))
    me = F.struct("id", "n")
    near = dealt.withColumns({"after_here": F.lead(me).over(order), "before_here": F.lag(me).over(order)}).join(F.broadcast(ends), "part")
    after, before = F.coalesce("after_here", "after"), F.coalesce("before_here", "before")
    return near.select("id", after["id"].alias("next"), before["id"].alias("prev"), before["n"].alias("prev_n"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``docs(doc_id, text)``, of its edited text and of the next document.

    The edited text has its last floor(n / 2) code points replaced by the first as
    many (or all) of the next document's by descending doc_id, the first's after
    the last. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A null text is an empty one; an
    empty text, or one without words, has no signatures, and two such have
    likeness 1. A lone document is its own next. Of rows that repeat a doc_id the
    one with the largest text stands for it as a neighbour, and each row comes
    back; rows without doc_id have an empty next document. Whole texts count,
    however long; an empty table gives an empty one; other columns are not read.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", body.alias("text"))
    near = cut(_neighbours(rows.withColumn("n", F.length("text"))))
    # Both joins below read one exchange: the same rows, dealt by doc_id. Signatures are
    # made again on either side of it: they would add half of the text's bytes to it.
    mine = rows.where("doc_id is not null")
    # What goes to the row before: no more of the text than that row can take.
    head = F.left("text", F.floor(F.col("prev_n") / 2).cast("int"))
    sent = mine.join(near, F.col("doc_id") == F.col("id")).select(F.col("prev").alias("to"), F.struct(head.alias("head"), F.unhex(F.array_join(signatures(F.col("text")), "")).alias("sigs")).alias("sent"))
    heads = sent.groupBy("to").agg(F.max("sent").alias("sent"))
    nameless = rows.where("doc_id is null").withColumn("sent", F.lit(None).cast("struct<head:string,sigs:binary>"))
    met = mine.join(heads, F.col("doc_id") == F.col("to"), "left").drop("to").unionByName(nameless)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", (n - half).cast("int")), F.left(F.coalesce("sent.head", F.lit("")), half))
    next_sigs = F.regexp_extract_all(F.lower(F.hex(F.coalesce("sent.sigs", F.lit(b"")))), F.lit(".{8}"), F.lit(0))
    made = met.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), signatures(F.col("text")).alias("s"), next_sigs.alias("x"))
    seen = made.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "s", signatures(F.col("edited")).alias("e"), "x")
    return seen.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), jaccard(F.col("s"), F.col("e")).alias("near_edited"), jaccard(F.col("s"), F.col("x")).alias("near_next"))


def near_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness): pairs of classes of equal fingerprints whose Jaccard reaches ``least``.

    A class is named after its smallest doc_id. Sets are partitioned by length,
    each meeting its own and the next partition only; within them two sets meet
    if their rarest signatures, as many as must overlap, have one in common; then
    lengths and the exact Jaccard decide. Documents without signatures pair with
    none; null ids are left out; nothing is capped. A signature of many sets is
    dealt over several tasks. An empty table gives an empty one; other columns are
    not read.
    """
    sets = docs.where("doc_id is not null").select("doc_id", signatures(F.col("text")).alias("s"))
    # Empty sets go after the cut: a filter before it would make all signatures once more.
    classes = cut(sets.groupBy("s").agg(F.min("doc_id").alias("id")).withColumn("part", F.floor(F.log(F.size("s").cast("double")) / F.log(F.lit(1 / least))).cast("int"))).where("size(s) > 0")
    every = classes.select("id", F.explode("s").alias("sig"))
    often = every.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = every.join(often, "sig").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("r"))
    prefix = F.size("r") - F.ceil(F.size("r") * least).cast("int") + 1
    keys = cut(ranked.join(classes.select("id", "part"), "id").select("id", "part", F.explode(F.transform(F.slice("r", F.lit(1), prefix), lambda x: x["sig"])).alias("sig")))
    other = keys.select(F.col("id").alias("id_2"), F.col("part").alias("part_2"), "sig")
    meets = spread_join(keys, other, ["sig"]).where("part_2 - part in (0, 1) and id <> id_2").select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")).distinct()
    left, right = classes.select(F.col("id").alias("a"), F.col("s").alias("s_a")), classes.select(F.col("id").alias("b"), F.col("s").alias("s_b"))
    return meets.join(left, "a").join(right, "b").select("a", "b", jaccard(F.col("s_a"), F.col("s_b"), least).alias("likeness")).where(F.col("likeness") >= least)
