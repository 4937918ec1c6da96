"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Only DataFrame functions. A pattern's matches and the texts between them (the
split at the pattern) give every position without a user function: a match begins
where all pieces and matches before it end. Patterns use possessive loops and may
begin only where a run begins or the last match ended, which finds the same
leftmost matches in time linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"


@dataclass(frozen=True)
class Kind:
    """A kind of span: what proposes it, what a text must contain for that, and its score.

    ``score`` is what a confirmed match has by itself; a context word within
    CONTEXT code points before it adds CONTEXT_BONUS. A span counts from LEAST up.
    """

    name: str
    pattern: str
    hint: str
    score: float
    words: str
    base: bool = True
    apart: str = ""  # characters that may not stand beside a span


CONTEXT, CONTEXT_BONUS, LEAST = 40, 0.3, 0.5
#: Matches of a text whose lengths are summed together.
CHUNK = 256

KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++", "@", 0.9, r"e-?mail|mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"\bip\b|address|host|server|adresse|dirección"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", "", 0.7, r"card|visa|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, r"phone|tel|call|mobile|fax|telefon|móvil"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", "", 0.8, r"iban|account|konto|cuenta|compte", base=False, apart="[A-Za-z0-9]"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", 0.3, r"ssn|social security", base=False, apart="[0-9-]"),
)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right Luhn check digit."""
    places = F.sequence(F.lit(1), F.length(number))

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return (F.length(number) > 0) & (F.aggregate(places, F.lit(0), add) % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an account number, blanks left out, leaves 1 modulo 97 (letters count from A = 10)."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        c = F.substr(turned, i, F.lit(1))
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + letter) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1)


def small_parts(ip: Column) -> Column:
    """Whether every part is at most 255; leading zeros do not matter."""
    short = F.transform(F.split(ip, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(F.try_to_number(F.concat(F.lit("0"), p), F.lit("9999")).cast("int"), F.lit(0)) <= 255))


def confirmed(kind: Kind, match: Column) -> Column:
    n = F.length(digits(match))
    return {
        "ip": lambda: small_parts(match),
        "card": lambda: n.between(14, 19) & luhn(digits(match)),
        "phone": lambda: n.between(10, 15),
        "iban": lambda: mod97(match),
    }.get(kind.name, lambda: F.lit(True))()


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is found once: a projection before may be merged into the function, which would find it at each step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, kind: Kind, order: int) -> Column:
    """Array of (start, ord, kind, end, score) of a kind's confirmed spans, in code points, end exclusive.

    A step is a match and the text between it and the last one. Running sums over
    chunks of steps, and within its chunk for each confirmed match, tell where it
    lies: Spark copies what an aggregate gathers at each step, so nothing is
    gathered over all steps, and long texts take time linear in their length.
    """
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,score:double>>")

    def steps(found: Column, gaps: Column) -> Column:
        def step(match: Column, i: Column) -> Column:
            gap = F.get(gaps, i)
            parts = [i.alias("i"), gap.alias("gap"), match.alias("match"), (F.length(gap) + F.length(match)).alias("n")]
            if kind.apart:
                left = F.right(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), gap), F.lit(1))
                right = F.left(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), F.lit(1))
                parts.append(F.concat(left, right).alias("beside"))
            return F.struct(*parts)

        return F.transform(found, step)

    def stands(step: Column) -> Column:
        right = confirmed(kind, step["match"])
        return right & ~step["beside"].rlike(kind.apart) if kind.apart else right

    def total(every: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(every, first + 1, n), F.lit(0), lambda sum, step: sum + step["n"])

    def chunk_starts(every: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor(F.size(every) / CHUNK).cast("int"))
        return F.aggregate(chunks, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + total(every, c * CHUNK, F.lit(CHUNK)))))

    def context(every: Column, step: Column) -> Column:
        # A match has two characters at least.
        first = F.greatest(step["i"] - CONTEXT // 2, F.lit(0))
        last = F.transform(F.slice(every, first + 1, step["i"] - first), lambda p: F.concat(F.right(p["gap"], F.lit(CONTEXT)), F.right(p["match"], F.lit(CONTEXT))))
        return F.right(F.concat(F.array_join(last, ""), F.right(step["gap"], F.lit(CONTEXT))), F.lit(CONTEXT))

    def scored(every: Column, starts: Column, step: Column) -> Column:
        chunk = F.floor(step["i"] / CHUNK).cast("int")
        begin = F.get(starts, chunk) + total(every, chunk * CHUNK, step["i"] - chunk * CHUNK) + F.length(step["gap"])
        score = F.lit(kind.score) + F.when(F.lower(context(every, step)).rlike(kind.words), CONTEXT_BONUS).otherwise(0.0)
        score = F.round(F.least(score, F.lit(1.0)), 2)
        return _held(begin, lambda b: F.struct(b.alias("start"), F.lit(order).alias("ord"), F.lit(kind.name).alias("kind"), (b + F.length(step["match"])).alias("end"), score.alias("score")))

    def placed(every: Column) -> Column:
        def all_of(right: Column) -> Column:
            return F.when(F.size(right) > 0, _held(chunk_starts(every), lambda starts: F.transform(right, lambda step: scored(every, starts, step)))).otherwise(none)

        return _held(F.filter(every, stands), all_of)

    def searched(found: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)
        return F.when(F.size(found) > 0, _held(gaps, lambda g: _held(steps(found, g), placed))).otherwise(none)

    every = _held(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), searched)
    every = F.when(F.contains(text, F.lit(kind.hint)), every).otherwise(none) if kind.hint else every
    return every if kind.base else F.filter(every, lambda s: s["score"] >= LEAST)


def written(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scored) a row of ``docs(doc_id, text)``.

    The first four kinds are the base: leftmost non-overlapping matches that pass
    their check, none tried again. ``spans`` has the base and the method's own
    kinds, an account number (mod-97) and, only with a context word near, a social
    security number. Order is by start, then by kind as listed; overlapping spans
    of two kinds both stay. ``scored`` gives kind:start:end:score. A null or empty
    text has no spans; whole texts are read, however long; repeated rows are rows
    of their own; an empty table gives an empty one; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    per_kind = docs.select("doc_id", text.alias("text")).select("doc_id", *[spans(F.col("text"), k, i).alias(k.name) for i, k in enumerate(KINDS)])
    base = F.array_sort(F.concat(*[F.col(k.name) for k in KINDS if k.base]))
    every = F.array_sort(F.concat(*[F.col(k.name) for k in KINDS]))
    rows = per_kind.withColumns({"_base": base, "_all": every})
    counts = [F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base]
    scored = F.array_join(F.transform("_all", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), s["score"].cast("string"))), ",")
    return rows.select("doc_id", *counts, F.sha2(written(F.col("_base")).cast("binary"), 256).alias("base_sha256"), written(F.col("_all")).alias("spans"), scored.alias("scored"))
