import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from cuelark.llm import langid

SYLLABLES = {"aa": "ka to mi ru ne so hi".split(), "bb": "str ung keit sch ver ge än".split(), "cc": "ción do que la ez ar íñ".split()}


def texts(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.choice([5, 40, 300]))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(texts(300), "doc_id long, text string, lang string")
    filters = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    got = langid.identify(docs, filters).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_nulls_letterless_repeats_and_clashing_columns(spark):
    rows = [(1, None, "aa", 1), (2, "", "aa", 1), (3, "12 ### 34", None, 1), (4, "kato miru neso", None, 1), (4, "kato miru neso", None, 1), (None, "kato", None, 1), (5, "漢字", "bb", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    learned = langid.learn(spark.createDataFrame(texts(60), "doc_id long, text string, lang string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, learned).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "aa" and got[5][0] in SYLLABLES
    assert langid.identify(docs, learned).count() == len(rows) and langid.identify(docs.limit(0), learned).count() == 0
    nothing = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_filters_never_miss_and_the_correction_is_the_false_positive_rate():
    h, _, _ = langid.grams(["kato miru neso hika", "strung verkeit gesch"])
    f = langid.Filters.of(["x", "y"], [h[: len(h) // 2], h[len(h) // 2 :]])
    _, found = f.counts(h[: len(h) // 2], h[: len(h) // 2].astype(int) * 0, 1)
    assert found[0, 0] == len(h) // 2
    assert (f.rate < 1e-6).all()


def test_grams_are_those_of_a_plain_loop():
    text = "Ab-cd é1x"
    padded = "\0".join(["", "ab\0cd\0é\0x", ""]).replace("\0", " ")
    n = sum(1 for k in langid.LENGTHS for i in range(len(padded) - k + 1) if " " not in padded[i + 1 : i + k - 1] and padded[i : i + k].strip(" "))
    assert len(langid.grams([text])[0]) == n


def plain_grams(text):
    """All n-grams in a plain loop; blanks only at their edges."""
    body = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    body = re.sub(" +", " ", body)
    return [body[i : i + n] for n in langid.LENGTHS for i in range(len(body) - n + 1) if " " not in body[i + 1 : i + n - 1] and body[i : i + n].strip()]


def exact_decisions(train, rows):
    """Languages by exact sets in place of filters: no false positives, so nothing to correct."""
    docs = defaultdict(set)
    for _, text, lang in train:
        docs[lang].add(text)
    rate = {lang: {g: n / len(own) for g, n in Counter(g for t in own for g in set(plain_grams(t))).items() if n / len(own) >= langid.LEAST_RATE} for lang, own in docs.items()}
    top = {}
    for own in rate.values():
        for g, x in own.items():
            top[g] = max(x, top.get(g, 0))
    sets = {lang: {g for g, x in own.items() if x >= langid.LEAST_SHARE * top[g]} for lang, own in rate.items()}
    out = {}
    for i, text, _ in rows:
        found = {lang: sum(g in own for g in plain_grams(text)) for lang, own in sorted(sets.items())}
        best = max(found, key=lambda k: (found[k], [-ord(c) for c in k]))
        has = any(c.isalpha() for c in text or "")
        out[i] = (best, found[best] / sum(found.values()) if sum(found.values()) else 0.0) if has else ("und", 0.0)
    return out


def test_decisions_are_those_of_exact_sets(spark):
    rows = [*texts(150, seed=5), (900, "Iñ do que! 12 ÇÃO", "cc"), (901, "strkato", "bb"), (902, "7", "aa")]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))).collect()}
    want = exact_decisions(train, rows)
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert max(abs(got[i][1] - want[i][1]) for i in got) < 1e-3


def test_a_language_of_one_text_is_learnt_and_copies_count_once(spark):
    rare = "zxq wvx qzzx xqw zwv"
    rows = [*((t, lang) for _, t, lang in texts(60)), (rare, "zz"), *[("kato miru " * 5, "aa")] * 500]
    filters = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert filters.langs == ["aa", "bb", "cc", "zz"] and filters.decide([rare])[0] == ["zz"]
    once = langid.learn(spark.createDataFrame([*rows[:61], rows[-1]], "text string, lang string"))
    assert (once.slices == filters.slices).all()


def test_many_languages_and_ties(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i + 1000)) * 3
    rows = [(word(i), f"l{i:03d}") for i in range(300)]
    filters = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert len(filters.langs) == 300 and filters.slices.shape[1] == 38
    assert filters.decide([word(i) for i in range(300)])[0] == [f"l{i:03d}" for i in range(300)]
    assert langid.Filters.of(["x", "y"], [np.array([5], np.uint64)] * 2).decide(["ab"])[0] == ["x"]


def test_a_long_text_is_read_whole(spark):
    """5 MB whose languages change: the counts are those of its parts."""
    filters = langid.learn(spark.createDataFrame(texts(60), "doc_id long, text string, lang string"))
    long = "kato miru " * 300_000 + "strung " * 300_000
    assert [len(p) for _, p in langid.portions(["a" * (2 * langid.PIECE_CHARS), "b"])] == [1, 1]
    r = langid.identify(spark.createDataFrame([(1, long)], "doc_id long, text string"), filters).first()
    assert r.lang_pred == "aa" and 0.3 < r.score < 0.8
