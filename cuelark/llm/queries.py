"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelark.llm import decontam, html_extract, langid, mixing, pii, quality, sharding, spotsigs, toxicity
from cuelark.llm.minhash import near_duplicates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs.where(~langid.held_out(docs["doc_id"]))))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85, 100)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), home=sharding.map_home(spark, f"op10 {sf_dir}"))


def spotsigs_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair search of op5's fingerprints, beside its query, which compares given pairs."""
    return spotsigs.near_pairs(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_minhash, op3_decontamination, op4_pii, op5_spotsigs, op6_toxicity, op7_quality, op8_html, op9_mixing, op10_sharding, spotsigs_near_pairs)}

ORACLE_SQL: dict[str, str] = {}

#: Set links by a self join on shingles, components by a recursive query.
ORACLE_SQL["op2_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS items
  FROM w),
d AS MATERIALIZED (SELECT doc_id, len(items)::BIGINT AS n, items FROM s),
t AS MATERIALIZED (SELECT doc_id, n, unnest(items) AS item FROM d),
link AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, d.n AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN comp c USING (doc_id)
"""

#: Seeds by tuples of words, overlaps by running sums along each offset.
ORACLE_SQL["op3_decontamination"] = r"""
WITH low AS (
  SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'i', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
parts AS (SELECT side, id, regexp_extract_all(t, '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM low),
w AS MATERIALIZED (SELECT side, id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM parts WHERE side = 'd' OR len(ws) >= 5),
l AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4, lead(w, 5) OVER o AS w5, lead(w, 6) OVER o AS w6, lead(w, 7) OVER o AS w7
  FROM w WINDOW o AS (PARTITION BY side, id ORDER BY i)),
seed AS MATERIALIZED (
  SELECT side, id, i, unnest([w || ' ' || w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || '/0', w || ' ' || w1 || ' ' || w3 || ' ' || w5 || ' ' || w6 || '/1',
    w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w7 || '/2', w || ' ' || w1 || ' ' || w4 || ' ' || w6 || ' ' || w7 || '/3']) AS seed FROM l),
hit AS MATERIALIZED (SELECT DISTINCT d.id AS doc_id, b.id AS item_id, d.i - b.i AS shift FROM seed d JOIN seed b ON d.side = 'd' AND b.side = 'i' AND d.seed = b.seed),
line AS (
  SELECT h.doc_id, h.item_id, h.shift, b.n, b.i AS j, CASE WHEN d.w = b.w THEN 1 ELSE 0 END AS same
  FROM hit h JOIN w b ON b.side = 'i' AND b.id = h.item_id JOIN w d ON d.side = 'd' AND d.id = h.doc_id AND d.i = b.i + h.shift),
total AS (SELECT *, sum(CASE WHEN same = 1 THEN 1 ELSE -2 END) OVER o AS after, sum(CASE WHEN same = 1 THEN 1 ELSE -2 END) OVER o - CASE WHEN same = 1 THEN 1 ELSE -2 END AS before
  FROM line WINDOW o AS (PARTITION BY doc_id, item_id, shift ORDER BY j)),
least_before AS (SELECT *, min(before) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) AS low FROM total),
stop AS (SELECT doc_id, item_id, shift, n, j AS last, low FROM least_before QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY after - low DESC, j) = 1),
start AS (SELECT s.*, min(t.j) AS first FROM stop s JOIN least_before t USING (doc_id, item_id, shift) WHERE t.before = s.low AND t.j <= s.last GROUP BY ALL),
found AS (SELECT s.doc_id, s.item_id, s.shift + s.first AS doc_word, s.first AS item_word, s.last - s.first + 1 AS n_words, sum(l.same) AS n_equal, any_value(s.n) AS n
  FROM start s JOIN line l ON l.doc_id = s.doc_id AND l.item_id = s.item_id AND l.shift = s.shift AND l.j BETWEEN s.first AND s.last GROUP BY s.doc_id, s.item_id, s.shift, s.first, s.last)
SELECT doc_id, item_id, doc_word, item_word, n_words, n_equal::BIGINT AS n_equal FROM found WHERE n_words >= least(12, n) AND n_equal >= 0.8 * n_words
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, n_words DESC, doc_word) = 1
"""

_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, t, {i} AS ord, '{k}' AS kind, {score} AS base_score, '{words}' AS words, '{apart}' AS apart, regexp_extract_all(t, '{pattern}') AS f, string_split_regex(t, '{pattern}') AS g FROM d"
    for i, (k, pattern, score, words, apart) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0.9, "e-?mail|mail|contact|kontakt|correo|courriel", ""),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0.6, r"\bip\b|address|host|server|adresse|dirección", ""),
        ("card", r"[0-9]([\x20-]?[0-9])+", 0.7, "card|visa|credit|karte|tarjeta|carte", ""),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|tel|call|mobile|fax|telefon|móvil", ""),
        ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", 0.8, "iban|account|konto|cuenta|compte", "[A-Za-z0-9]"),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, "ssn|social security", "[0-9-]"),
    ))
)

#: Plain patterns; places by the lengths of what stands between the matches.
ORACLE_SQL["op4_pii"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_FOUND}),
u AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m WHERE len(f) > 0),
s AS (
  SELECT doc_id, t, ord, kind, base_score, words, apart, f[i] AS v, regexp_replace(f[i], '[^0-9]', '', 'g') AS digits,
    (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT AS b FROM u),
c AS (
  SELECT *, b + length(v) AS e, replace(v, ' ', '') AS plain, apart = '' OR NOT (
    (b > 0 AND regexp_matches(substr(t, b, 1), apart)) OR regexp_matches(substr(t, b + length(v) + 1, 1), CASE WHEN apart = '' THEN 'x' ELSE apart END)) AS stands FROM s),
ok AS (
  SELECT *, round(least(1.0, base_score::DOUBLE + CASE WHEN regexp_matches(lower(substr(t, greatest(b - 40, 0) + 1, least(b, 40))), words) THEN 0.3 ELSE 0.0 END), 2) AS score FROM c
  WHERE stands AND CASE kind
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255))
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda p: CASE WHEN p % 2 = 1 THEN digits[-p]::INT
      WHEN digits[-p]::INT > 4 THEN 2 * digits[-p]::INT - 9 ELSE 2 * digits[-p]::INT END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
    WHEN 'iban' THEN length(plain) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(plain[5:] || plain[:4], ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END::BIGINT)),
      lambda r, x: CASE WHEN x < 10 THEN (r * 10 + x) % 97 ELSE (r * 100 + x) % 97 END) = 1
    ELSE true END),
kept AS (SELECT *, kind || ':' || b || ':' || e AS span FROM ok WHERE ord < 4 OR score >= 0.5),
o AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(span, ',' ORDER BY b, ord) FILTER (ord < 4) AS base, string_agg(span, ',' ORDER BY b, ord) AS spans, string_agg(span || ':' || score, ',' ORDER BY b, ord) AS scored FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scored, '') AS scored FROM d LEFT JOIN o USING (doc_id)
"""

#: Chains over lists of words.
ORACLE_SQL["op5_spotsigs"] = rf"""
WITH common AS (SELECT [{", ".join(f"'{w}'" for w in spotsigs.COMMON)}] AS c),
d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
nx AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS x FROM d),
ed AS (SELECT doc_id, t, n, x, substr(t, 1, n - n // 2) || substr(x, 1, n // 2) AS e FROM nx),
body AS (SELECT doc_id, unnest(['t', 'e', 'x']) AS which, unnest([t, e, x]) AS b FROM ed),
ws AS (SELECT doc_id, which, regexp_extract_all(lower(b), '[\p{{L}}\p{{N}}]+') AS ws FROM body),
f AS (SELECT doc_id, which, unnest(list_prepend('', ws)) AS w, unnest(range(len(ws) + 1)) AS i FROM ws),
k AS (SELECT f.*, w = '' OR list_contains(c, w) AS anchor FROM f, common),
r AS MATERIALIZED (SELECT *, sum((NOT anchor)::INT) OVER (PARTITION BY doc_id, which ORDER BY i) AS nth FROM k),
content AS MATERIALIZED (SELECT doc_id, which, nth, w || coalesce(' ' || lead(w, 1) OVER o, '') || coalesce(' ' || lead(w, 2) OVER o, '') AS chain FROM r WHERE NOT anchor WINDOW o AS (PARTITION BY doc_id, which ORDER BY nth)),
sig AS (SELECT DISTINCT a.doc_id, a.which, substr(md5(c.chain), 1, 8) AS s FROM r a JOIN content c ON a.anchor AND c.doc_id = a.doc_id AND c.which = a.which AND c.nth = a.nth + 1),
fp AS (SELECT doc_id, which, list(s ORDER BY s) AS s FROM sig GROUP BY doc_id, which),
j AS (SELECT ed.*, coalesce(a.s, []) AS ts, coalesce(b.s, []) AS es, coalesce(c.s, []) AS xs FROM ed LEFT JOIN fp a ON a.doc_id = ed.doc_id AND a.which = 't' LEFT JOIN fp b ON b.doc_id = ed.doc_id AND b.which = 'e' LEFT JOIN fp c ON c.doc_id = ed.doc_id AND c.which = 'x')
SELECT doc_id, n AS n_chars, sha256(e) AS edited_sha256, array_to_string(ts, ' ') AS fingerprint, array_to_string(es, ' ') AS edited_fingerprint,
  CASE WHEN len(ts) + len(es) = 0 THEN 1.0 ELSE len(list_intersect(ts, es))::DOUBLE / (len(ts) + len(es) - len(list_intersect(ts, es))) END::DOUBLE AS near_edited,
  CASE WHEN len(ts) + len(xs) = 0 THEN 1.0 ELSE len(list_intersect(ts, xs))::DOUBLE / (len(ts) + len(xs) - len(list_intersect(ts, xs))) END::DOUBLE AS near_next FROM j
"""

#: All pairs of different fingerprints that share a signature.
ORACLE_SQL["spotsigs_near_pairs"] = rf"""
WITH common AS (SELECT [{", ".join(f"'{w}'" for w in spotsigs.COMMON)}] AS c),
ws AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
f AS (SELECT doc_id, unnest(list_prepend('', ws)) AS w, unnest(range(len(ws) + 1)) AS i FROM ws),
k AS (SELECT f.*, w = '' OR list_contains(c, w) AS anchor FROM f, common),
r AS MATERIALIZED (SELECT *, sum((NOT anchor)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM k),
content AS MATERIALIZED (SELECT doc_id, nth, w || coalesce(' ' || lead(w, 1) OVER o, '') || coalesce(' ' || lead(w, 2) OVER o, '') AS chain FROM r WHERE NOT anchor WINDOW o AS (PARTITION BY doc_id ORDER BY nth)),
sig AS (SELECT DISTINCT a.doc_id, substr(md5(c.chain), 1, 8) AS s FROM r a JOIN content c ON a.anchor AND c.doc_id = a.doc_id AND c.nth = a.nth + 1),
fp AS (SELECT doc_id, list(s ORDER BY s) AS s FROM sig GROUP BY doc_id),
cl AS MATERIALIZED (SELECT s, min(doc_id) AS id, len(s) AS n FROM fp GROUP BY s),
e AS MATERIALIZED (SELECT id, n, unnest(s) AS s FROM cl),
p AS (SELECT a.id AS a, b.id AS b, count(*)::DOUBLE AS same, a.n + b.n AS n FROM e a JOIN e b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n)
SELECT a, b, same / (n - same) AS likeness FROM p WHERE same / (n - same) >= 0.8
"""

#: Sainte-Laguë by ranking every quotient; targets by raising the level source by source.
ORACLE_SQL["op9_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS ticket FROM documents),
s AS MATERIALIZED (
  SELECT source, sum(size)::BIGINT AS source_size, ceil(count(*) / 4096.0)::BIGINT AS shards,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w
  FROM d GROUP BY source),
o AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS id, 3 * source_size::DOUBLE AS cap,
    row_number() OVER (ORDER BY 3 * source_size::DOUBLE / w, source NULLS LAST) AS turn, sum(source_size) OVER ()::DOUBLE AS total FROM s),
fill(turn, rest, weights, level) AS (
  SELECT 0, max(total), sum(w), max(total) / sum(w) FROM o
  UNION ALL
  SELECT f.turn + 1, f.rest - o.cap, f.weights - o.w, (f.rest - o.cap) / nullif(f.weights - o.w, 0)
  FROM fill f JOIN o ON o.turn = f.turn + 1 WHERE o.cap / o.w <= f.level),
ending AS (SELECT level FROM fill ORDER BY turn DESC LIMIT 1),
aim AS MATERIALIZED (SELECT o.*, CASE WHEN cap / w <= level OR level IS NULL THEN cap ELSE level * w END AS target FROM o, ending),
n AS (SELECT floor(sum(target) / 64)::BIGINT AS n FROM aim),
seat AS MATERIALIZED (
  SELECT id, count(*) AS blocks FROM (
    SELECT id, row_number() OVER (ORDER BY q DESC, id) AS place FROM (
      SELECT id, source, target / (2 * k + 1) AS q FROM aim, n, range(0, n.n) r(k) WHERE target > 0 AND k <= ceil(2 * target / 64) + 1)), n
  WHERE place <= n.n GROUP BY id),
p AS MATERIALIZED (
  SELECT d.*, a.id, a.source_size, a.target, coalesce(t.blocks, 0) AS blocks, ('0x' || substr(d.ticket, 1, 8))::BIGINT % a.shards AS shard
  FROM d JOIN aim a ON d.source IS NOT DISTINCT FROM a.source LEFT JOIN seat t ON t.id = a.id),
cell AS MATERIALIZED (SELECT id, shard, blocks, sum(size)::BIGINT AS cell FROM p GROUP BY id, shard, blocks),
quota AS MATERIALIZED (
  SELECT id, shard, count(*) AS quota FROM (
    SELECT id, shard, blocks, row_number() OVER (PARTITION BY id ORDER BY cell / (2.0 * k + 1) DESC, shard) AS place FROM cell, range(0, (SELECT max(blocks) FROM cell)) r(k) WHERE cell > 0 AND k < blocks)
  WHERE place <= blocks GROUP BY id, shard),
laid AS (
  SELECT p.*, c.cell, least(coalesce(q.quota, 0) * 64, 3 * c.cell)::BIGINT AS words,
    (sum(size) OVER (PARTITION BY p.id, p.shard ORDER BY ticket, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM p JOIN cell c USING (id, shard) LEFT JOIN quota q USING (id, shard))
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CASE WHEN cell = 0 THEN 0 ELSE words // cell * size + greatest(least(start + size, words % cell) - start, 0) END::BIGINT AS taken
FROM laid
"""
