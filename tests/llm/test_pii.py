import hashlib
import random
import re

from cuelark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]():  # noqa: B023
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def card(rng, n=16):
    d = [rng.randrange(10) for _ in range(n - 1)]
    return next("".join(map(str, [*d, c])) for c in range(10) if luhn([*d, c]))


def samples():
    rng = random.Random(8)
    bits = ["a.b@c.de", "x@y", "@", "me@@you.org", "x@y@z.com", "a@b.c_d@e.f", "a@b..c", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.004", "99999999999.1.2.3", "+1 (555) 010-9999", "+49--30 123456 78", "+1", "++123 456 7890", "é漢😀",
            "1234 5678", "-", " ", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "GB00 WEST 1234 5698 7654 32", "ssn 123-45-6789", "123-45-6789", "\n", "call", "card:"]
    rows = [None, "", "a" * 5000 + "@", "1" * 5000, "a.b." * 3000 + "@c" + ".d" * 3000]
    for _ in range(250):
        parts = [rng.choice([*bits, card(rng, rng.choice([14, 16, 19])), re.sub("(....)", r"\1 ", card(rng)).strip()]) for _ in range(rng.randint(1, 9))]
        rows.append(rng.choice(["", " "]).join(parts))
    return list(enumerate(rows))


def test_base_spans_are_those_of_plain_matching(spark):
    rows = samples()
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        spans = base_spans(text)
        line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
        r = got[i]
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[2] == k for x in spans) for k in BASE], text
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (text, line, r.spans)
        assert ",".join(x for x in r.spans.split(",") if x.split(":")[0] in BASE) == line


def test_the_methods_own_kinds_need_their_checks(spark):
    rows = [(1, "konto GB82 WEST 1234 5698 7654 32."), (2, "GB00 WEST 1234 5698 7654 32"), (3, "my ssn is 123-45-6789"), (4, "part 123-45-6789")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "iban:6:33" in got[1] and "iban" not in got[2] and "ssn:10:21" in got[3] and "ssn" not in got[4]


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.co", 1), (1, "a@b.co", 1), (None, None, 1)], "doc_id long, text string, email int")
    got = [(r.doc_id, r.n_email) for r in pii.find(docs).collect()]
    assert sorted(got, key=str) == [(1, 1), (1, 1), (None, 0)] and pii.find(docs.limit(0)).count() == 0


def test_long_texts_of_many_matches(spark):
    rng = random.Random(5)
    text = " ".join(f"é{rng.randrange(10**6)} a{i}@b.co {card(rng)}" for i in range(20000))
    near = "12 " * 700 + "ssn " + "12-" * 19 + " 123-45-6789 " + "7 8 " * 20 + "123-45-6789"
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame([(1, text), (2, near)], "doc_id long, text string")).collect()}
    line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base_spans(text))
    assert got[1].n_email == 20000 and got[1].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
    assert "ssn" not in got[2].spans


def test_context_reaches_over_matches_before(spark):
    words = [(1, "ssn " + "12 " * 11 + "123-45-6789"), (2, "ssn " + "12 " * 14 + "123-45-6789"), (3, "ssn 123-45-6789123-45-6789"), (4, "ssn 123-45-6789 123-45-6789")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(words, "doc_id long, text string")).collect()}
    assert "ssn:37:48" in got[1] and "ssn" not in got[2] and "ssn" not in got[3] and got[4].count("ssn:") == 2
