"""All queries of the engine, each over its whole table, and their SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelark.functions import interval as iv
from cuelark.functions import pixel as px
from cuelark.functions import vector
from cuelark.functions.timebase import MICROS, TimeBase, div, format_timestamp, midpoint, ms_to_ticks
from cuelark.operators import frames as fr
from cuelark.operators import intervals as it
from cuelark.operators import recognise, speculative, vision
from cuelark.plans import growth_sql as gs
from cuelark.plans import pixel_sql as ps
from cuelark.plans.presets import PRESETS
from cuelark.plans.strategies import KEYS, SPEAKERS, classify_speaker, framewise, plan, sparse_plan, sparse_threshold
from cuelark.plans.strategies import speculative as speculative_plan
from cuelark.sinks import subtitles
from cuelark.streaming import intervals as stream
from cuelark.sources.pictures import image_of
from cuelark.sources.tables import embedding_frames, event_frames, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Events are hours apart: a millisecond of a plan is 144 seconds here, so 300 ms are 12 hours.
HOURS = TimeBase(1, 144_000_000_000)
TICKS = {ms: HOURS.ticks(ms) for ms in (100, 200, 300, 400, 500, 1000, 1200, 2000)}

FP = """fp AS (
  SELECT user_id AS video_id, epoch_us(ts) AS pts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
    value > 40 AS dialog, value AS feat, event_type, value FROM events),
kf AS (SELECT *, frame_idx % 12 = 0 AS is_key FROM fp)"""
VP = """vp AS (
  SELECT label::BIGINT AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, embedding AS feat, embedding[1] > 0 AS dialog FROM embeddings),
vf AS (SELECT *, frame_idx * 40000 AS pts FROM vp)"""
ORDER = "PARTITION BY video_id ORDER BY pts, frame_idx"


def islands(source: str, flags: dict[str, str], name: str = "iv", extra: str = "", out: str = "") -> str:
    """SQL for the runs of each flag: a run begins where the flag is set and was not before."""
    parts = " UNION ALL ".join(f"SELECT *, {i} AS place, '{flag}' AS main_flag, coalesce({expr}, false) AS is_on FROM {source}" for i, (flag, expr) in enumerate(flags.items()))
    return f"""{name}_a AS ({parts}),
{name}_b AS (SELECT *, row_number() OVER w AS nth, lead(pts) OVER w AS nxt, is_on AND NOT coalesce(lag(is_on) OVER w, false) AS starts FROM {name}_a WINDOW w AS (PARTITION BY video_id, place ORDER BY pts, frame_idx)),
{name}_c AS (SELECT *, sum(starts::INT) OVER (PARTITION BY video_id, place ORDER BY nth) AS run FROM {name}_b),
{name}_d AS (SELECT video_id, place, main_flag, run, min(pts) AS b, max(coalesce(nxt, pts)) AS e, count(*) AS n_points, max(nth) AS last{extra} FROM {name}_c WHERE is_on GROUP BY video_id, place, main_flag, run),
{name} AS (SELECT video_id, main_flag, b, e, n_points, row_number() OVER (PARTITION BY video_id ORDER BY last, place) - 1 AS seq{out} FROM {name}_d)"""


def resorted(source: str, name: str, more: str = "") -> str:
    return f"{name} AS (SELECT video_id, main_flag, b, e, n_points, row_number() OVER (PARTITION BY video_id ORDER BY b, seq) - 1 AS seq{more} FROM {source})"


def gap_sql(source: str, name: str, flag: str, most: int, meet: float, more: str = "") -> str:
    """SQL for filling the gaps of a flag."""
    m = lambda e, b: f"trunc({e}::DOUBLE * {1.0 - meet} + {b}::DOUBLE * {float(meet)})::BIGINT"
    ok = lambda e, b: f"main_flag = '{flag}' AND {b} - {e} > 0 AND {b} - {e} <= {most}"
    return f"""{name}_n AS (SELECT *, lead(b) OVER w AS nb, lag(e) OVER w AS le FROM {source} WINDOW w AS (PARTITION BY video_id, main_flag ORDER BY b, seq)),
{name}_m AS (SELECT * REPLACE (CASE WHEN {ok("le", "b")} THEN {m("le", "b")} ELSE b END AS b, CASE WHEN {ok("e", "nb")} THEN {m("e", "nb")} ELSE e END AS e) FROM {name}_n),
{resorted(f"{name}_m", name, more)}"""


def extend_sql(source: str, name: str, flag: str, front: int, back: int) -> str:
    return f"""{name}_n AS (SELECT *, lead(b) OVER (PARTITION BY video_id ORDER BY b, seq) AS nb FROM {source}),
{name}_m AS (SELECT * REPLACE (CASE WHEN main_flag = '{flag}' THEN least(e + {back}, coalesce(nb, e + {back})) ELSE e END AS e) FROM {name}_n),
{name}_o AS (SELECT *, lag(e) OVER (PARTITION BY video_id ORDER BY b, seq) AS le FROM {name}_m),
{name} AS (SELECT video_id, main_flag, CASE WHEN main_flag = '{flag}' THEN greatest(b - {front}, coalesce(le, 0)) ELSE b END AS b, e, n_points, seq FROM {name}_o)"""


def noise_sql(source: str, name: str, flag: str, value: bool, least: int) -> str:
    """SQL for removing short runs: a run's length is the distance between changes."""
    return f"""{name}_a AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY video_id) AS n, {flag} IS DISTINCT FROM lag({flag}) OVER w AS turn FROM {source} WINDOW w AS ({ORDER})),
{name}_b AS (SELECT *, sum(turn::INT) OVER (PARTITION BY video_id ORDER BY nth) AS run FROM {name}_a),
{name}_c AS (SELECT *, count(*) OVER (PARTITION BY video_id, run) AS long FROM {name}_b),
{name} AS (SELECT * EXCLUDE (nth, n, turn, run, long) REPLACE (CASE WHEN {flag} = {str(value).lower()} AND long < {least} AND nth - 1 BETWEEN {least} AND n - 1 - {least} THEN NOT {flag} ELSE {flag} END AS {flag}) FROM {name}_c)"""


def jump_sql(source: str, name: str, feature: str, dst: str, distance: str, least: float, window: int, inverse: bool = False, spread: float = 0.0) -> str:
    """SQL for jumps of a scalar feature; the list of values ahead is filled up with zeros."""
    ahead = f"list({feature}::DOUBLE) OVER ({ORDER} ROWS BETWEEN 1 FOLLOWING AND {window} FOLLOWING)"
    hit = f"{'NOT ' if inverse else ''}({distance}) >= {least}" if not inverse else f"NOT (({distance}) >= {least})"
    hit = f"CASE WHEN round(list_stddev_pop(v), 9) > {spread} THEN false ELSE {hit} END" if spread else hit
    return f"""{name}_a AS (SELECT *, {ahead} AS h FROM {source}),
{name}_b AS (SELECT *, list_concat(coalesce(h, []), list_transform(range({window} - len(coalesce(h, []))), lambda i: 0.0::DOUBLE)) AS v FROM {name}_a),
{name}_c AS (SELECT *, list_sum(v) / {window} AS mean, {feature}::DOUBLE AS f FROM {name}_b),
{name} AS (SELECT * EXCLUDE (h, v, mean, f), coalesce({hit}, false) AS {dst} FROM {name}_c)"""


IV = "SELECT video_id, main_flag, b AS \"begin\", e AS \"end\", n_points, seq FROM "
IV_COLUMNS = ["video_id", "main_flag", "begin", "end", "n_points", "seq"]
ONE = islands("fp", {"dialog": "dialog"})
TWO_FLAGS = {"dialog": "dialog", "click": "event_type = 'click'"}
TWO = islands("fp", TWO_FLAGS)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.build_intervals(event_frames(spark, sf_dir), ["dialog"])


def two(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_frames(spark, sf_dir).withColumn("click", F.col("event_type") == "click")
    return fr.build_intervals(rows, ["dialog", "click"])


# Frame operators


@query("build_intervals", f"WITH {FP}, {ONE} {IV} iv")
def build_intervals(spark, sf_dir):
    return one(spark, sf_dir).select(*IV_COLUMNS)


@query("build_intervals_multi", f"WITH {FP}, {islands('fp', {t: f'''event_type = '{t}' ''' for t in ('click', 'view', 'purchase')})} {IV} iv")
def build_intervals_multi(spark, sf_dir):
    rows = event_frames(spark, sf_dir)
    kinds = ["click", "view", "purchase"]
    return fr.build_intervals(rows.withColumns({t: F.col("event_type") == t for t in kinds}), kinds).select(*IV_COLUMNS)


for _value in (True, False):

    @query(f"remove_noise_{str(_value).lower()}", f"WITH {FP}, {noise_sql('fp', 'clean', 'dialog', _value, 3)} SELECT video_id, frame_idx, dialog FROM clean")
    def remove_noise(spark, sf_dir, value=_value):
        return fr.remove_noise(event_frames(spark, sf_dir), "dialog", value, 3).select("video_id", "frame_idx", "dialog")


for _name, _how, _distance, _sql in (
    ("abs", {"least": 30.0}, vector.absolute, "abs(f - mean)"),
    ("rising", {"least": 20.0, "window": 5}, vector.rising, "mean - f"),
    ("falling", {"least": 20.0}, vector.falling, "f - mean"),
    ("inverse", {"least": 30.0, "inverse": True}, vector.absolute, "abs(f - mean)"),
    ("std_gated", {"least": 20.0, "window": 5, "most_spread": 25.0}, vector.absolute, "abs(f - mean)"),
):

    @query(
        f"feature_jump_{_name}",
        f"WITH {FP}, {jump_sql('fp', 'j', 'feat', 'jump', f'round({_sql}, 9)', _how['least'], _how.get('window', 3), _how.get('inverse', False), _how.get('most_spread', 0.0))} SELECT video_id, frame_idx, jump FROM j",
    )
    def feature_jump(spark, sf_dir, how=_how, distance=_distance):
        return fr.feature_jump(event_frames(spark, sf_dir), "feat", "jump", lambda a, b: F.round(distance(a, b), 9), **how).select("video_id", "frame_idx", "jump")


def _vector_jump_sql(window: int, default: float, measure: str, least: float) -> str:
    """Frames far from the mean of the frames ahead."""
    return f"""WITH {VP},
h AS (SELECT video_id, frame_idx, feat::DOUBLE[] AS f, coalesce(list(feat::DOUBLE[]) OVER ({ORDER} ROWS BETWEEN 1 FOLLOWING AND {window} FOLLOWING), []) AS a FROM vf),
m AS (SELECT video_id, frame_idx, f, list_transform(range(1, 65), lambda i: (list_sum(list_concat([0.0::DOUBLE], list_transform(a, lambda v: v[i]))) + {default} * ({window} - len(a))) / {window}) AS mean FROM h)
SELECT video_id, frame_idx, round({measure}, 6) >= {least} AS jump FROM m"""


for _name, _measure, _sql, _least, _window, _default in (
    ("l2", vector.l2, "list_distance(f, mean)", 1.1, 5, 0.0),
    ("cosine", vector.half_cosine, "0.5 - list_cosine_similarity(f, mean) / 2", 0.5, 3, 1.0),
):

    @query(f"feature_jump_{_name}", _vector_jump_sql(_window, _default, _sql, _least))
    def vector_jump(spark, sf_dir, measure=_measure, least=_least, window=_window, default=_default):
        far = lambda a, b: F.round(measure(a, b), 6)
        return fr.vector_jump(embedding_frames(spark, sf_dir), "feat", "jump", 64, far, least, window, default=default).select("video_id", "frame_idx", "jump")


_PAIRWISE = """p AS (SELECT video_id, frame_idx, feat::DOUBLE[] AS f, lead(feat::DOUBLE[]) OVER (PARTITION BY video_id ORDER BY frame_idx) AS g FROM vf)"""


@query("cosine_similarity", f"WITH {VP}, {_PAIRWISE} SELECT video_id, frame_idx, round(list_cosine_similarity(f, g), 6) AS cosine, list_bool_and(list_transform(f, lambda x: x = 0)) AS is_zero FROM p WHERE g IS NOT NULL")
def cosine_similarity(spark, sf_dir):
    rows = embedding_frames(spark, sf_dir).withColumn("g", F.lead("feat").over(fr.in_order())).where("g is not null")
    return rows.select("video_id", "frame_idx", F.round(vector.cosine(F.col("feat"), F.col("g")), 6).alias("cosine"), vector.is_zero(F.col("feat")).alias("is_zero"))


for _name, _by, _sql in (("lag", 2, "lag(feat, 2, -1)"), ("lead", -3, "lead(feat, 3, -1)")):

    @query(f"shift_{_name}", f"WITH {FP} SELECT video_id, frame_idx, {_sql} OVER ({ORDER}) AS shifted FROM fp")
    def shift(spark, sf_dir, by=_by):
        return fr.shift(event_frames(spark, sf_dir), "shifted", "feat", by, -1.0).select("video_id", "frame_idx", "shifted")


@query("break_on_jump", f"WITH {FP}, {jump_sql('fp', 'j', 'feat', 'jump', 'round(abs(f - mean), 9)', 30.0, 3)} SELECT video_id, frame_idx, dialog AND NOT jump AS dialog FROM j")
def break_on_jump(spark, sf_dir):
    rows = fr.feature_jump(event_frames(spark, sf_dir), "feat", "jump", lambda a, b: F.round(vector.absolute(a, b), 9), 30.0)
    return fr.break_on(rows, "dialog", "jump").select("video_id", "frame_idx", "dialog")


@query("prioritise_flag", f"WITH {FP} SELECT video_id, frame_idx, dialog AND event_type <> 'click' AS dialog FROM fp")
def prioritise_flag(spark, sf_dir):
    rows = event_frames(spark, sf_dir).withColumn("click", F.col("event_type") == "click")
    return fr.prioritise(rows, "dialog", "click").select("video_id", "frame_idx", "dialog")


@query("conjunction_flags", f"WITH {FP} SELECT video_id, frame_idx, dialog AND event_type = 'view' AND value < 80 AS every FROM fp")
def conjunction_flags(spark, sf_dir):
    rows = event_frames(spark, sf_dir).withColumns({"view": F.col("event_type") == "view", "low": F.col("feat") < 80})
    return fr.conjunction(rows, "every", "dialog", "view", "low").select("video_id", "frame_idx", "every")


@query("frame_dump", f"WITH {FP} SELECT video_id, frame_idx, 'frame ' || pts || ': dialog=' || dialog AS line FROM fp")
def frame_dump(spark, sf_dir):
    return subtitles.frame_text(event_frames(spark, sf_dir), ["dialog"])


@query("denoise_in_segments", f"WITH {FP}, {noise_sql('fp', 'clean', 'dialog', True, 3)} SELECT video_id, frame_idx, dialog FROM clean")
def denoise_in_segments(spark, sf_dir):
    """Noise removal with long videos dealt out in segments of 16 frames."""
    return fr.remove_noise_in_segments(event_frames(spark, sf_dir), "dialog", True, 3, 16).select("video_id", "frame_idx", "dialog")


# Scalars


@query(
    "format_timestamp",
    f"""WITH {FP}, t AS (SELECT video_id, frame_idx, pts, (pts // 10000) AS c FROM fp)
SELECT video_id, frame_idx, format('{{:02d}}:{{:02d}}:{{:02d}}.{{:02d}}', (c // 360000) % 24, (c // 6000) % 60, (c // 100) % 60, c % 100) AS clock, pts // 2 AS half FROM t""",
)
def format_time(spark, sf_dir):
    return event_frames(spark, sf_dir).select("video_id", "frame_idx", format_timestamp(F.col("pts")).alias("clock"), midpoint(F.lit(0), F.col("pts")).alias("half"))


@query("ms_to_ticks", "SELECT event_id, (event_id * 90000) // 1000 AS ticks, (event_id * 30000) // 1001000 AS frames FROM events")
def to_ticks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", ms_to_ticks(F.col("event_id"), TimeBase(1, 90_000)).alias("ticks"), div(F.col("event_id") * 30_000, 1_001_000).alias("frames"))


_NEXT = f"{ONE}, n AS (SELECT *, lead(b) OVER w AS nb, lead(e) OVER w AS ne FROM iv WINDOW w AS (PARTITION BY video_id ORDER BY b, seq))"


@query("interval_dist", f'WITH {FP}, {TWO}, n AS (SELECT *, lead(b) OVER w AS nb, lead(e) OVER w AS ne FROM iv WINDOW w AS (PARTITION BY video_id ORDER BY b, seq)) SELECT video_id, seq, CASE WHEN b > nb THEN b - ne ELSE nb - e END AS gap FROM n WHERE nb IS NOT NULL')
def interval_dist(spark, sf_dir):
    return it.neighbours(two(spark, sf_dir)).select("video_id", "seq", "gap")


_PAIRS = f"""{TWO}, pr AS (SELECT a.video_id, a.seq AS seq_a, b.seq AS seq_b, CASE WHEN a.b > b.b THEN a.b - b.e ELSE b.b - a.e END AS gap FROM iv a JOIN iv b ON a.video_id = b.video_id AND a.seq < b.seq)"""


for _name, _test in (("intersects", "gap < 0"), ("touches", "gap = 0")):

    @query(f"interval_{_name}", f"WITH {FP}, {_PAIRS} SELECT video_id, seq_a, seq_b, gap FROM pr WHERE {_test}")
    def interval_pairs(spark, sf_dir, test=_test):
        return it.pairs_within(two(spark, sf_dir), 36_000_000_000).where(test).select("video_id", "seq_a", "seq_b", "gap")


@query("interval_midpoint", f"WITH {FP}, {ONE} SELECT video_id, seq, (b + e) // 2 AS midpoint FROM iv")
def interval_midpoint(spark, sf_dir):
    return one(spark, sf_dir).select("video_id", "seq", midpoint(F.col("begin"), F.col("end")).alias("midpoint"))


@query("interval_point_dist", f"WITH {FP}, {ONE} SELECT video_id, seq, greatest(b - 1704067200000000, 1704067200000000 - e, 0) AS away FROM iv")
def interval_point_dist(spark, sf_dir):
    return one(spark, sf_dir).select("video_id", "seq", iv.gap_to_point(F.col("begin"), F.col("end"), F.lit(1_704_067_200_000_000)).alias("away"))


# Interval operators


for _name, _meet in (("half", 0.5), ("left", 0.0), ("right", 1.0)):

    @query(f"fill_gap_{_name}", f"WITH {FP}, {ONE}, {gap_sql('iv', 'g', 'dialog', TICKS[300], _meet)} {IV} g")
    def fill_gap(spark, sf_dir, meet=_meet):
        return it.fill_gap(one(spark, sf_dir), "dialog", 300, meet, HOURS).select(*IV_COLUMNS)


# Two kinds of events under one label: their intervals touch and overlap, so one looks past the next for a real gap.
_MIXED = f"""{islands("fp", {"click": "event_type = 'click'"}, "jv")}, {islands("fp", {"dialog": "dialog"}, "dv")},
iv AS (SELECT video_id, 'x' AS main_flag, b, e, n_points, row_number() OVER (PARTITION BY video_id ORDER BY b, t, seq) - 1 AS seq FROM (SELECT *, 0 AS t FROM dv UNION ALL SELECT *, 1 AS t FROM jv))"""
#: Each interval in turn: the first later one that begins within reach, after it ends, meets it; both are changed in the list that goes on.
_IN_TURN = f"""WITH RECURSIVE {FP}, {_MIXED},
l AS (SELECT video_id, list({{'b': b, 'e': e, 'n': n_points}} ORDER BY seq) AS xs FROM iv GROUP BY video_id),
turn(video_id, i, xs) AS (
  SELECT video_id, 1, xs FROM l
  UNION ALL
  SELECT video_id, i + 1, CASE WHEN j IS NULL THEN xs ELSE list_transform(xs, lambda x, p: CASE WHEN p = i THEN {{'b': x.b, 'e': m, 'n': x.n}} WHEN p = j THEN {{'b': m, 'e': x.e, 'n': x.n}} ELSE x END) END
  FROM (SELECT *, trunc(xs[i].e::DOUBLE * 0.5 + xs[j].b::DOUBLE * 0.5)::BIGINT AS m FROM (SELECT *, CASE WHEN xs[k].b - xs[i].e <= {TICKS[300]} THEN k END AS j FROM (
    SELECT *, list_filter(range(i + 1, len(xs) + 1), lambda q: xs[q].b > xs[i].e)[1] AS k FROM turn WHERE i <= len(xs))))),
done AS (SELECT video_id, unnest(xs) AS x, unnest(range(len(xs))) AS seq FROM turn WHERE i = len(xs) + 1),
g AS (SELECT video_id, 'x' AS main_flag, x.b AS b, x.e AS e, x.n AS n_points, row_number() OVER (PARTITION BY video_id ORDER BY x.b, seq) - 1 AS seq FROM done)"""


@query("fill_gap_sequential", f"{_IN_TURN} {IV} g")
def fill_gap_sequential(spark, sf_dir):
    mixed = F.row_number().over(Window.partitionBy("video_id").orderBy("begin", F.col("main_flag") == "click", "seq")) - 1
    rows = event_frames(spark, sf_dir).withColumn("click", F.col("event_type") == "click")
    both = it.append(fr.build_intervals(rows, ["dialog"]), fr.build_intervals(rows, ["click"]))
    both = both.withColumn("seq", mixed.cast("long")).withColumn("main_flag", F.lit("x"))
    return it.fill_gap_sequential(both, "x", 300, 0.5, HOURS).select(*IV_COLUMNS)


@query("extend", f"WITH {FP}, {TWO}, {resorted('iv', 's')}, {extend_sql('s', 'x', 'dialog', TICKS[100], TICKS[200])} {IV} x")
def extend(spark, sf_dir):
    return it.extend(it.resort(two(spark, sf_dir)), "dialog", 100, 200, HOURS).select(*IV_COLUMNS)


@query(
    "align_nearest",
    f"""WITH {FP}, {TWO}, r AS (SELECT DISTINCT video_id, unnest([b, e]) AS p FROM iv WHERE main_flag = 'click'),
c AS (SELECT i.video_id, i.seq, min_by(r.p, abs(r.p - i.b)::HUGEINT * 4000000000000000000 + r.p) AS nb, min_by(r.p, abs(r.p - i.e)::HUGEINT * 4000000000000000000 + r.p) AS ne FROM iv i JOIN r USING (video_id) WHERE main_flag = 'dialog' GROUP BY i.video_id, i.seq),
al AS (SELECT i.* REPLACE (CASE WHEN abs(nb - b) <= {TICKS[300]} THEN nb ELSE b END AS b, CASE WHEN abs(ne - e) <= {TICKS[300]} THEN ne ELSE e END AS e) FROM iv i LEFT JOIN c USING (video_id, seq)),
{resorted("al", "s")} {IV} s""",
)
def align_nearest(spark, sf_dir):
    return it.align(two(spark, sf_dir), "dialog", "click", 300, HOURS).select(*IV_COLUMNS)


@query("offset", f'WITH {FP}, {ONE} SELECT video_id, seq, b - 1234567 AS "begin", e - 1234567 AS "end" FROM iv')
def offset(spark, sf_dir):
    return it.offset(one(spark, sf_dir), -1_234_567).select("video_id", "seq", "begin", "end")


@query("remove_predicate", f"WITH {FP}, {TWO} {IV} iv WHERE NOT (n_points > 1 AND main_flag = 'click')")
def remove_predicate(spark, sf_dir):
    return it.remove(two(spark, sf_dir), (F.col("n_points") > 1) & (F.col("main_flag") == "click")).select(*IV_COLUMNS)


@query("denoise", f"WITH {FP}, {ONE} {IV} iv WHERE e - b >= {TICKS[300]}")
def denoise(spark, sf_dir):
    return it.denoise(one(spark, sf_dir), "dialog", 300, HOURS).select(*IV_COLUMNS)


@query("collect_flag", f"WITH {FP}, {TWO} {IV} iv WHERE main_flag = 'click'")
def collect_flag(spark, sf_dir):
    return it.with_flag(two(spark, sf_dir), "click").select(*IV_COLUMNS)


@query("sort_intervals", f"WITH {FP}, {TWO}, {resorted('iv', 's')} {IV} s")
def sort_intervals(spark, sf_dir):
    return it.resort(two(spark, sf_dir)).select(*IV_COLUMNS)


@query(
    "append_intervals",
    f"""WITH {FP}, {ONE}, {islands("fp", {"click": "event_type = 'click'"}, "jv")},
u AS (SELECT *, 0 AS t FROM iv UNION ALL SELECT *, 1 AS t FROM jv)
SELECT video_id, main_flag, b AS "begin", e AS "end", n_points, row_number() OVER (PARTITION BY video_id ORDER BY t, seq) - 1 AS seq FROM u""",
)
def append_intervals(spark, sf_dir):
    clicks = fr.build_intervals(event_frames(spark, sf_dir).withColumn("click", F.col("event_type") == "click"), ["click"])
    return it.append(one(spark, sf_dir), clicks).select(*IV_COLUMNS)


@query("speaker_style_union", f"WITH {FP}, {TWO} SELECT video_id, seq, CASE WHEN main_flag = 'dialog' AND n_points > 2 THEN 'Long' ELSE 'Default' END AS style FROM iv")
def speaker_style_union(spark, sf_dir):
    style = F.when((F.col("main_flag") == "dialog") & (F.col("n_points") > 2), "Long").otherwise(F.col("style"))
    return it.restyled(two(spark, sf_dir), style).select("video_id", "seq", "style")


_NUMBERED = f"{TWO}, nm AS (SELECT *, row_number() OVER (PARTITION BY video_id, main_flag ORDER BY b, seq) - 1 AS number FROM iv)"
_CLOCK = lambda x: f"format('{{:02d}}:{{:02d}}:{{:02d}}.{{:02d}}', ({x} // 3600000000) % 24, ({x} // 60000000) % 60, ({x} // 1000000) % 60, ({x} // 10000) % 100)"


@query("ass_lines", f"WITH {FP}, {_NUMBERED} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY b, seq) - 1 AS ord, 'Dialogue: 0,' || {_CLOCK('b')} || ',' || {_CLOCK('e')} || ',Default,,0,0,0,,Subtitle_' || main_flag || '_' || number AS line FROM nm")
def ass_lines(spark, sf_dir):
    return subtitles.subtitle_lines(two(spark, sf_dir))


@query("midpoints", f"WITH {FP}, {_NUMBERED} SELECT video_id, 'Subtitle_' || main_flag || '_' || number AS name, (b + e) // 2 AS midpoint FROM nm")
def midpoints(spark, sf_dir):
    return it.midpoints(two(spark, sf_dir))


@query("ocr_lines", f"WITH {FP}, {TWO}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY b, seq) - 1 AS ord FROM iv) SELECT video_id, ord, 'Subtitle_' || main_flag || '_' || ord || ',' || n_points || ' frames' AS line FROM o")
def ocr_lines(spark, sf_dir):
    return subtitles.ocr_lines(two(spark, sf_dir).withColumn("text", F.format_string("%d frames", "n_points")))


# Folds and classes


_FOLD_STEP = """list_reduce(list_prepend({'v': []::STRUCT(b BIGINT, e BIGINT, n BIGINT, s DOUBLE)[]}, list_transform(xs, lambda x: {'v': [x]})), lambda acc, x:
  CASE WHEN len(acc.v) = 0 THEN x
    WHEN abs(acc.v[-1].s / acc.v[-1].n - x.v[1].s / x.v[1].n) < 8 THEN {'v': list_append(acc.v[:-2], {'b': least(acc.v[-1].b, x.v[1].b), 'e': greatest(acc.v[-1].e, x.v[1].e), 'n': acc.v[-1].n + x.v[1].n, 's': acc.v[-1].s + x.v[1].s})}
    ELSE {'v': list_append(acc.v, x.v[1])} END).v"""


@query(
    "merge_adjacent",
    f"""WITH {FP}, {islands("fp", {"dialog": "dialog"}, "iv", ", sum(round(value)) AS s", ", s")},
g AS (SELECT video_id, list({{'b': b, 'e': e, 'n': n_points, 's': s::DOUBLE}} ORDER BY b, seq) AS xs FROM iv GROUP BY video_id),
f AS (SELECT video_id, {_FOLD_STEP} AS ys FROM g)
SELECT video_id, unnest(range(len(ys))) AS seq, unnest(list_transform(ys, lambda y: y.b)) AS "begin", unnest(list_transform(ys, lambda y: y.e)) AS "end", unnest(list_transform(ys, lambda y: y.n)) AS n_points FROM f""",
)
def merge_adjacent(spark, sf_dir):
    rows = event_frames(spark, sf_dir).withColumn("v", F.array(F.round("feat")))
    built = fr.build_intervals(rows, ["dialog"], "v", 1)
    mean = lambda x: F.element_at(x["feat_sum"], 1) / x["n_points"]
    return it.merge(it.resort(built), lambda a, b: F.abs(mean(a) - mean(b)) < 8).select("video_id", "seq", "begin", "end", "n_points")


_VECTOR_SUM = ", list_transform(range(1, 65), lambda i: list_sum(list_transform(fs, lambda v: v[i]))) AS s"
_VECTOR_FOLD = """list_reduce(list_prepend({'v': []::STRUCT(b BIGINT, e BIGINT, n BIGINT, s DOUBLE[])[]}, list_transform(xs, lambda x: {'v': [x]})), lambda acc, x:
  CASE WHEN len(acc.v) = 0 THEN x
    WHEN list_distance(list_transform(acc.v[-1].s, lambda c: c / acc.v[-1].n), list_transform(x.v[1].s, lambda c: c / x.v[1].n)) < 1.0 THEN {'v': list_append(acc.v[:-2],
      {'b': least(acc.v[-1].b, x.v[1].b), 'e': greatest(acc.v[-1].e, x.v[1].e), 'n': acc.v[-1].n + x.v[1].n, 's': list_transform(range(1, 65), lambda i: acc.v[-1].s[i] + x.v[1].s[i])})}
    ELSE {'v': list_append(acc.v, x.v[1])} END).v"""


@query(
    "merge_by_feature",
    f"""WITH {VP}, {islands("vf", {"dialog": "dialog"}, "iv", ", list(feat::DOUBLE[] ORDER BY nth) AS fs", _VECTOR_SUM)},
g AS (SELECT video_id, list({{'b': b, 'e': e, 'n': n_points, 's': s}} ORDER BY b, seq) AS xs FROM iv GROUP BY video_id),
f AS (SELECT video_id, {_VECTOR_FOLD} AS ys FROM g)
SELECT video_id, unnest(range(len(ys))) AS seq, unnest(list_transform(ys, lambda y: y.b)) AS "begin", unnest(list_transform(ys, lambda y: y.e)) AS "end", unnest(list_transform(ys, lambda y: y.n)) AS n_points FROM f""",
)
def merge_by_feature(spark, sf_dir):
    built = fr.build_intervals(embedding_frames(spark, sf_dir), ["dialog"], "feat", 64)
    return it.merge(it.resort(built), it.alike_features(1.0)).select("video_id", "seq", "begin", "end", "n_points")


_CENTROIDS = {"east": (1.0, 0.0), "west": (-1.0, 0.0), "north": (0.0, 1.0), "centre": (0.0, 0.0)}
_D = {k: f"(x - {a}) * (x - {a}) + (y - {b}) * (y - {b})" for k, (a, b) in _CENTROIDS.items()}


@query(
    "classify_nearest_centroid",
    f"""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
d AS (SELECT vec_id, unnest([{", ".join(f"{{'d': {d}, 'i': {i}, 'n': '{k}'}}" for i, (k, d) in enumerate(_D.items()))}]) AS c FROM v),
b AS (SELECT vec_id, min(c) AS c FROM d GROUP BY vec_id)
SELECT vec_id, CASE WHEN c.d > 0.2 THEN 'none' ELSE c.n END AS nearest FROM b""",
)
def classify_nearest_centroid(spark, sf_dir):
    x, y = (F.element_at("embedding", i).cast("double") for i in (1, 2))
    return table(spark, sf_dir, "embeddings").select("vec_id", it.nearest_centroid(x, y, _CENTROIDS, 0.2, "none").alias("nearest"))


# Scans


@query("sample_every_n", f"WITH {FP} SELECT video_id, frame_idx, pts FROM fp WHERE frame_idx % 5 = 0")
def sample_every_n(spark, sf_dir):
    return fr.every_nth(event_frames(spark, sf_dir), 5).select("video_id", "frame_idx", "pts")


_AT = 1_704_500_000_000_000


@query(
    "nearest_frame",
    f"""WITH {FP}, c AS (SELECT video_id, frame_idx, pts, row_number() OVER (PARTITION BY video_id ORDER BY abs(pts - {_AT}), pts, frame_idx) AS r FROM fp WHERE pts >= {_AT - 86_400_000_000} AND pts < {_AT + 86_400_000_000})
SELECT video_id, frame_idx, pts FROM c WHERE r = 1""",
)
def nearest_frame(spark, sf_dir):
    return speculative.nearest_frame(event_frames(spark, sf_dir), _AT - 86_400_000_000, _AT, _AT + 86_400_000_000)


@query(
    "keyframe_segments",
    f"""WITH {FP}, l AS (SELECT video_id, max(pts) AS last FROM fp GROUP BY video_id)
SELECT video_id, row_number() OVER w - 1 AS segment, pts AS "begin", coalesce(lead(pts) OVER w, last) AS "end" FROM kf JOIN l USING (video_id) WHERE is_key WINDOW w AS (PARTITION BY video_id ORDER BY pts, frame_idx)""",
)
def keyframe_segments(spark, sf_dir):
    return speculative.key_segments(event_frames(spark, sf_dir))


# Plans over flags that events make


def flagged(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """A strategy's flag columns from events; the vector strategies take embeddings."""
    if key in ("prk", "otl", "bcs", "lcb-mech"):
        rows = embedding_frames(spark, sf_dir)
        f = F.col("feat")
        if key == "lcb-mech":
            return rows.select("video_id", "pts", "frame_idx", "is_key", F.slice(f, 1, 4).alias("DialogTextFeat"), (F.element_at(f, 5) > -0.1).alias("DialogTextMin"), (F.element_at(f, 6) > -0.1).alias("DialogBgColour"))
        return rows.select("video_id", "pts", "frame_idx", "is_key", F.col("dialog").alias("Dialog"), f.alias("DialogFeat"))
    rows, v, kind = event_frames(spark, sf_dir), F.col("feat"), F.col("event_type")
    own = {
        "mr": {"Dialog": v > 40, "Blackscreen": kind == "click", "Whitescreen": v < 15, "CgSub": kind.isin("view", "signup")},
        "mr-s0": {"Blackscreen": kind == "error", "Dialog": v > 30, "DialogContentVal": v / 10, "DialogNameVal": v % 5, "Balloon": kind != "view", "BalloonVal": v / 5, "MeanTextColour": F.array(v, v % 50 + 50, v % 90 + 10, F.lit(0.0))},
        "md": {"HomeDialog": kind == "view", "Dialog": v > 30, "Whitescreen": v < 15, "Blackscreen": kind == "click", "LeftBubble": v > 60, "RightBubble": kind == "signup"},
        "lcb": {"Dialog": v > 20},
        "pkm": {"Dialog": v > 20},
        "bdr": {"Dialog": v > 20, "DialogTextVal": v / 10},
    }[key]
    return rows.select("video_id", "pts", "frame_idx", "is_key", *[c.alias(n) for n, c in own.items()])


MEDIUM = TimeBase(1, 1_000_000)


def _speaker_sql(source: str) -> str:
    """SQL for the speaker nearest to the mean colour of s1, s2, s3 over n_points."""
    return f"""k AS (SELECT *, s1 / n_points AS b_, s2 / n_points AS g_, s3 / n_points AS r_ FROM {source}),
l AS (SELECT *, greatest(b_, g_, r_) AS top, greatest(b_, g_, r_) - least(b_, g_, r_) AS spread FROM k),
h AS (SELECT *, CASE WHEN spread = 0 THEN 0 WHEN top = r_ THEN 60 * (g_ - b_) / spread WHEN top = g_ THEN 120 + 60 * (b_ - r_) / spread ELSE 240 + 60 * (r_ - g_) / spread END AS hue FROM l),
xy AS (SELECT *, spread / top * cos(radians(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END)) AS x, spread / top * sin(radians(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END)) AS y FROM h),
st AS (SELECT *, list_min([{", ".join(f"{{'d': (x - {a}) * (x - {a}) + (y - {b}) * (y - {b}), 'i': {i}, 'n': '{n}'}}" for i, (n, (a, b)) in enumerate(SPEAKERS.items()))}]) AS c FROM xy)"""


def _plan_sql(key: str) -> str | None:
    """SQL for plans of scalar flags, step by step as listed."""
    head = f"WITH {FP}"
    noise = lambda src, steps: _chain(src, [(lambda s, n, a=a: noise_sql(s, n, *a)) for a in steps])
    if key in ("lcb", "pkm"):
        text, last = noise("f0", [("Dialog", True, 10)])
        most, meet = (1000, 0.0) if key == "lcb" else (300, 0.5)
        return f"{head}, f0 AS (SELECT * EXCLUDE (dialog), value > 20 AS Dialog FROM fp), {text}, {islands(last, {'Dialog': 'Dialog'})}, {resorted('iv', 's')}, {gap_sql('s', 'g', 'Dialog', TICKS[most], meet)} {IV} g"
    if key == "bdr":
        return f"{head}, f0 AS (SELECT * EXCLUDE (dialog), value > 20 AS Dialog, value / 10 AS val FROM fp), {jump_sql('f0', 'j', 'val', 'jump', 'abs(f - mean)', 2.0, 3)}, {islands('j', {'Dialog': 'Dialog AND NOT jump'})}, {resorted('iv', 's')}, {gap_sql('s', 'g', 'Dialog', TICKS[500], 0.5)} {IV} g"
    if key == "mr":
        flags = {"Dialog": 300, "Blackscreen": 1200, "Whitescreen": 1200, "CgSub": 1200}
        text, last = noise("f0", [(f, v, n) for f, k in zip(flags, (2, 3, 3, 2), strict=True) for v, n in ((False, k), (True, 10))])
        steps, end = _chain("s", [(lambda s, n, f=f, m=m: gap_sql(s, n, f, TICKS[m], 0.5)) for f, m in flags.items()], "g")
        f0 = "f0 AS (SELECT * EXCLUDE (dialog), value > 40 AS Dialog, event_type = 'click' AS Blackscreen, value < 15 AS Whitescreen, event_type IN ('view', 'signup') AS CgSub FROM fp)"
        return f"{head}, {f0}, {text}, {islands(last, {f: f for f in flags})}, {resorted('iv', 's')}, {steps} {IV} {end}"
    if key == "md":
        text, last = noise("f0", [("HomeDialog", True, 10), ("Dialog", True, 10)])
        f0 = "f0 AS (SELECT * EXCLUDE (dialog), event_type = 'view' AS HomeDialog, value > 30 AS Dialog, value < 15 AS Whitescreen, event_type = 'click' AS Blackscreen, value > 60 AS LeftBubble, event_type = 'signup' AS RightBubble FROM fp)"
        flags = {"HomeDialog": "HomeDialog", "Dialog": "Dialog AND NOT HomeDialog", **{f: f for f in ("Whitescreen", "Blackscreen", "LeftBubble", "RightBubble")}}
        steps = []
        for names, most, meet, front, back in ((("HomeDialog", "Dialog"), 300, 0.0, 300, 0), (("Whitescreen", "Blackscreen"), 2000, 0.5, 400, 400), (("LeftBubble", "RightBubble"), 300, 0.0, 200, 0)):
            for f in names:
                steps.append(lambda s, n, a=(f, TICKS[most], meet): gap_sql(s, n, *a))
                steps.append(lambda s, n, a=(f, TICKS.get(front, 0), TICKS.get(back, 0)): extend_sql(s, n, *a))
        chain, end = _chain("s", steps, "g")
        return f"{head}, {f0}, {text}, {islands(last, flags)}, {resorted('iv', 's')}, {chain} {IV} {end}"
    if key in ("prk", "otl", "bcs", "lcb-mech"):
        # The lists ahead, turned to one list a component and filled up with the default.
        size, window, default = (4, 3, 1.0) if key == "lcb-mech" else (64, 5, 0.0)
        own = "feat[1:4]::DOUBLE[]" if key == "lcb-mech" else "feat::DOUBLE[]"
        ahead = f"h AS (SELECT *, {own} AS f, coalesce(list({own}) OVER ({ORDER} ROWS BETWEEN 1 FOLLOWING AND {window} FOLLOWING), []) AS a FROM vf)"
        turned = f"m AS (SELECT *, list_transform(range(1, {size + 1}), lambda i: list_concat(list_transform(a, lambda v: v[i]), list_transform(range({window} - len(a)), lambda k: {default}::DOUBLE))) AS cs FROM h)"
        means = "q AS (SELECT *, list_transform(cs, lambda c: list_avg(c)) AS mean, list_avg(list_transform(cs, lambda c: list_stddev_pop(c))) AS spread FROM m)"
        if key == "lcb-mech":
            on = "0.5 - list_cosine_similarity(f, mean) / 2 < 0.01 AND feat[5] > -0.1::FLOAT AND feat[6] > -0.1::FLOAT"
            most, least = 500_000, 0
        else:
            on = f"dialog AND NOT (spread <= 0.005 AND list_distance(f, mean) >= {1.1 if key == 'otl' else 0.1})"
            most, least = 300_000, {"prk": 0, "otl": 100_000, "bcs": 300_000}[key]
        kept = f"WHERE e - b >= {least}" if least else ""
        return f"WITH {VP}, {ahead}, {turned}, {means}, z AS (SELECT video_id, pts, frame_idx, {on} AS is_text FROM q), {islands('z', {'Dialog': 'is_text'})}, {resorted('iv', 's')}, {gap_sql('s', 'g', 'Dialog', most, 1.0)} {IV} g {kept}"
    if key == "mr-s0":
        f0 = "f0 AS (SELECT * EXCLUDE (dialog), event_type = 'error' AS Blackscreen, value > 30 AS Dialog, value / 10 AS cval, value % 5 AS nval, event_type <> 'view' AS Balloon, value / 5 AS bval, value AS c1, value % 50 + 50 AS c2, value % 90 + 10 AS c3 FROM fp)"
        broken = lambda flag, jumps: lambda s, n: f"{n} AS (SELECT * REPLACE ({flag} AND NOT ({jumps}) AS {flag}) FROM {s})"
        jump = lambda *a: lambda s, n: jump_sql(s, n, *a)
        quiet = lambda *a: lambda s, n: noise_sql(s, n, *a)
        text, last = _chain("f0", [
            quiet("Blackscreen", False, 3), quiet("Blackscreen", True, 10),
            jump("cval", "jd", "f - mean", 2.0, 3), jump("cval", "ju", "mean - f", 2.0, 5), jump("ju", "juu", "mean - f", 0.5, 3), jump("nval", "nj", "abs(f - mean)", 1.0, 3),
            broken("Dialog", "jd OR juu OR nj"), quiet("Dialog", False, 2), quiet("Dialog", True, 10),
            jump("bval", "bj", "f - mean", 3.0, 3), broken("Balloon", "bj"), quiet("Balloon", False, 2), quiet("Balloon", True, 10),
        ])
        sums = ", s1, s2, s3"
        gaps, end = _chain("s", [(lambda s, n, a=a: gap_sql(s, n, *a, sums)) for a in (("Blackscreen", TICKS[1200], 0.5), ("Dialog", TICKS[500], 1.0), ("Balloon", TICKS[500], 1.0))], "g")
        built = islands(last, {f: f for f in ("Blackscreen", "Dialog", "Balloon")}, "iv", ", sum(c1) AS s1, sum(c2) AS s2, sum(c3) AS s3", sums)
        colour = _speaker_sql(end)
        return f"{head}, {f0}, {text}, {built}, {resorted('iv', 's', sums)}, {gaps}, {colour} SELECT video_id, main_flag, b AS \"begin\", e AS \"end\", n_points, seq, CASE WHEN main_flag = 'Blackscreen' THEN 'Default' WHEN c.d > 0.2 THEN 'Shiranai' ELSE c.n END AS style FROM st"
    return None


def _chain(source: str, steps: list[Callable[[str, str], str]], prefix: str = "c") -> tuple[str, str]:
    """Common table expressions, each on the one before."""
    out, now = [], source
    for i, step in enumerate(steps):
        out.append(step(now, f"{prefix}{i}"))
        now = f"{prefix}{i}"
    return ", ".join(out), now


for _key in KEYS:

    @query(f"plan_{_key.replace('-', '_')}", _plan_sql(_key))
    def run_plan(spark, sf_dir, key=_key):
        vectors = key in ("prk", "otl", "bcs", "lcb-mech")
        params = next(iter(PRESETS[key].values()))
        own = plan(key, params | ({"featureJumpThreshold": 1.1} if key in ("otl", "bcs") else {}))
        out = framewise(flagged(spark, sf_dir, key), own, MEDIUM if vectors else HOURS)
        return out.select(*IV_COLUMNS, *(["style"] if key == "mr-s0" else []))


def _event_looks(spark, sf_dir):
    rows = event_frames(spark, sf_dir).withColumn("f", F.array(F.when(F.col("dialog"), 1.0).otherwise(0.0)))
    return speculative.by_features(rows, "dialog", "f", 0.5, 300, HOURS)


_GROWN = f"WITH RECURSIVE {FP}, {gs.grown_ctes('kf', 'dialog', '[dialog::INT::DOUBLE]', 0.5, TICKS[300])}"
_VECTORS_GROWN = f"WITH RECURSIVE {VP}, kv AS (SELECT *, frame_idx % 12 = 0 AS is_key FROM vf), {gs.grown_ctes('kv', 'dialog', 'feat::DOUBLE[]', 1.3, 1_000_000)}"


@query(
    "speculative_intervals",
    f"""{_GROWN} SELECT video_id, 'dialog' AS main_flag, b AS "begin", e AS "end", 'Default' AS style, n_points, true AS first_main, fp AS ocr_pts, seq, n_frames, n_decoded, n_analysed FROM gr JOIN wk USING (video_id)""",
)
def speculative_intervals(spark, sf_dir):
    return speculative.grown(_event_looks(spark, sf_dir)).drop("feat_sum")


def _held_frames(spark, sf_dir):
    """Events as a video whose picture stays for 48 frames, as a caption does, with a key frame in 24."""
    span = Window.partitionBy("video_id", div(F.col("frame_idx"), 48)).orderBy("frame_idx")
    rows = event_frames(spark, sf_dir).withColumns({"feat": F.first("feat").over(span), "is_key": F.col("frame_idx") % 24 == 0})
    return rows.select("video_id", "pts", "frame_idx", "is_key", "feat")


def _picture_looks(spark, sf_dir, key):
    """Sparse looks at drawn frames: a picture is drawn and analysed only when it is looked at."""
    params = next(iter(PRESETS[key].values()))
    own = plan(key, params)
    look = vision.looks(key, params, own.flags[0], own.feature, image_of)
    return own, speculative.sparse_looks(_held_frames(spark, sf_dir), look, own.flags[0], sparse_threshold(own), 10_000, HOURS)


@query("speculative_pixels")
def speculative_pixels(spark, sf_dir):
    own, looks = _picture_looks(spark, sf_dir, "otl")
    return sparse_plan(looks, own, HOURS).select(*IV_COLUMNS)


@query("framewise_pixels")
def framewise_pixels(spark, sf_dir):
    """The same way frame by frame, to compare with."""
    params = next(iter(PRESETS["otl"].values()))
    return framewise(vision.analyse(_held_frames(spark, sf_dir), "otl", params, image_of=image_of), plan("otl", params), HOURS).select(*IV_COLUMNS)


@query("speculative_pixel_work")
def speculative_pixel_work(spark, sf_dir):
    return speculative.looked_at(_picture_looks(spark, sf_dir, "otl")[1])


def _sparse_sql(key: str) -> str:
    """The steps after growing: gaps filled, or folds around the removal of what is short."""
    if key == "prk":
        return f"{_VECTORS_GROWN}, {resorted('gr', 's')}, {gap_sql('s', 'gp', 'Dialog', 300_000, 1.0)} {IV} gp"
    least = 300 if key == "otl" else next(iter(PRESETS["bcs"].values())).get("iirPassDenoiseMinTime", 300)
    return f"{_VECTORS_GROWN}, {gs.fold_ctes('gr', 'm1', 1.3, 64)}, kept AS (SELECT * FROM m1 WHERE e - b >= {least * 1000}), {gs.fold_ctes('kept', 'm2', 1.3, 64)} {IV} m2"


for _key in ("prk", "otl", "bcs"):

    @query(f"speculative_{_key}", _sparse_sql(_key))
    def run_sparse(spark, sf_dir, key=_key):
        own = replace(plan(key, next(iter(PRESETS[key].values())) | {"featureJumpThreshold": 1.3}), merge_below=1.3)
        return speculative_plan(flagged(spark, sf_dir, key), own, 1000, MEDIUM).select(*IV_COLUMNS)


_WORK = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in ("n_frames", "n_decoded", "n_analysed"))


@query("speculative_work", f"{_GROWN} SELECT {_WORK} FROM wk")
def speculative_work(spark, sf_dir):
    return speculative.looked_at(_event_looks(spark, sf_dir))


@query(
    "speaker_classes",
    f"""WITH {FP}, f0 AS (SELECT * EXCLUDE (dialog), value > 30 AS Dialog, value AS c1, value % 50 + 50 AS c2, value % 90 + 10 AS c3 FROM fp),
{islands("f0", {"Dialog": "Dialog"}, "iv", ", sum(c1) AS s1, sum(c2) AS s2, sum(c3) AS s3", ", s1, s2, s3")}, {_speaker_sql("iv")} SELECT video_id, seq, CASE WHEN c.d > 0.2 THEN 'Shiranai' ELSE c.n END AS style FROM st""",
)
def speaker_classes(spark, sf_dir):
    rows = flagged(spark, sf_dir, "mr-s0")
    colour = F.array(*[F.sum(F.element_at("MeanTextColour", i)) for i in (1, 2, 3)])
    built = fr.build_intervals(rows, ["Dialog"], keep={"colour_sum": colour})
    return classify_speaker(built, ("Dialog",)).select("video_id", "seq", "style")


# Pixels


def _drawable(spark, sf_dir):
    """Events as frames with what draws their pictures."""
    return event_frames(spark, sf_dir).select("video_id", "pts", "frame_idx", "is_key", "feat")


def _flag_names(key: str) -> str:
    return ", ".join(f'"{f.name}"' for f in vision.STRATEGIES[key][1].fields)


_PIXEL_CTES = {"mr": ps.mr_ctes, "md": ps.md_ctes, "pkm": ps.pkm_ctes, "bdr": ps.bdr_ctes, "prk": ps.prk_ctes, "lcb": ps.lcb_ctes, "lcb-mech": ps.mech_ctes}


def in_millionths(feature) -> F.Column:
    """A vector as text that any engine writes alike."""
    return F.array_join(F.transform(feature, lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",")


for _key in KEYS:

    @query(f"pixel_{_key.replace('-', '_')}", ps.flags_of(_key, FP, _flag_names(_key), _PIXEL_CTES[_key](ps.first(_key))) if _key in _PIXEL_CTES else None)
    def run_pixels(spark, sf_dir, key=_key):
        flags = vision.analyse(_drawable(spark, sf_dir), key, next(iter(PRESETS[key].values())), image_of=image_of)
        alike = {"double": lambda c: F.round(c, 6), "array<double>": in_millionths}
        return flags.select(*[alike.get(kind, F.col)(F.col(c) if kind in alike else c).alias(c) for c, kind in flags.dtypes])


def _per_frame(spark, sf_dir, columns: str, run: Callable[[np.ndarray], dict]) -> DataFrame:
    return vision.each_frame(_drawable(spark, sf_dir), ["video_id", "frame_idx"], run, T.StructType.fromDDL(columns), image_of)


def _per_picture_sql(flags: str, ctes: str) -> str:
    return f"WITH {FP}, {ps.pictures_sql()}, {ctes}, sh AS (SELECT video_id, frame_idx, {ps.SHOWN} FROM fp) SELECT video_id, frame_idx, {flags} FROM sh JOIN fl USING (k, n)"


@query("dct_descriptor", _per_picture_sql("feature", f"{ps.resized_ctes('px', 'grey', [0.0, 1.0, 0.0, 1.0])}, {ps.dct_ctes()}, fl AS (SELECT * FROM ft)"))
def dct_descriptor(spark, sf_dir):
    rows = _per_frame(spark, sf_dir, "feature array<double>", lambda x: {"feature": px.dct_feature(px.resized(px.grey(x), 150, 50)).tolist()})
    return rows.withColumn("feature", in_millionths(F.col("feature")))


@query("rgb_sobel", _per_picture_sql("strength, most", ps.sobel_ctes()))
def rgb_sobel(spark, sf_dir):
    rows = _per_frame(spark, sf_dir, "strength double, most int", lambda x: {"strength": float((e := px.edges(x)).mean()), "most": int(e.max())})
    return rows.withColumn("strength", F.round("strength", 6))


@query("component_filter")
def component_filter(spark, sf_dir):
    return _per_frame(spark, sf_dir, "regions int, letter_area int", lambda x: {"regions": len(px.components(m := px.mask(px.grey(x) > 160))[1]) - 1, "letter_area": vision.letters(m)[1]})


@query("pca_features")
def pca_features(spark, sf_dir):
    """One row in 50 trains four components of the embeddings; all rows are projected."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = embedding_frames(spark, sf_dir).withColumn("v", array_to_vector(F.col("feat").cast("array<double>")))
    model = PCA(k=4, inputCol="v", outputCol="p").fit(fr.every_nth(rows, 50))
    return model.transform(rows).select("video_id", "frame_idx", vector_to_array("p").alias("feature"))


_READ = f"'{ps.WIDTH}x{ps.HEIGHT}:' || mean"


@query(
    "interval_texts",
    f"""WITH {FP}, {ONE}, {ps.pictures_sql()}, {ps.MEANS}, sh AS (SELECT video_id, pts, frame_idx, {ps.SHOWN} FROM fp),
rd AS (SELECT video_id, pts, arg_min({_READ}, frame_idx) AS t FROM sh JOIN fl USING (k, n) GROUP BY video_id, pts)
SELECT iv.video_id, seq, t || '@' || t AS text FROM iv JOIN rd ON rd.video_id = iv.video_id AND rd.pts = iv.b""",
)
def interval_texts(spark, sf_dir):
    reader = lambda image, mask: f"{image.shape[1]}x{image.shape[0]}:{int(image.mean())}"
    return recognise.interval_texts(one(spark, sf_dir), _drawable(spark, sf_dir), [reader, reader], image_of=image_of).select("video_id", "seq", "text")


_BOXED = PRESETS["bdr"]["default"] | {"dialogRect": [0.25, 0.75, 0.8, 0.98], "bgMinBrightness": 0, "bgMaxBrightness": 60, "bgMinMeanVal": 100.0, "textMinBrightness": 200, "textMaxBrightness": 255}


@query(
    "pixels_to_subtitles",
    f"""WITH {FP}, {ps.pictures_sql()}, {ps.bdr_ctes(_BOXED)}, sh AS (SELECT video_id, pts, frame_idx, is_key, {ps.SHOWN} FROM kf),
f0 AS (SELECT sh.*, "Dialog", tx AS val FROM sh JOIN fl USING (k, n) JOIN st USING (k, n)), {jump_sql("f0", "j", "val", "jump", "abs(f - mean)", 2.0, 3)},
{islands("j", {"Dialog": '"Dialog" AND NOT jump'})}, {resorted("iv", "s")}, {gap_sql("s", "gp", "Dialog", TICKS[500], 0.5)},
nm AS (SELECT *, row_number() OVER (PARTITION BY video_id, main_flag ORDER BY b, seq) - 1 AS number FROM gp)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY b, seq) - 1 AS ord, 'Dialogue: 0,' || {_CLOCK("b")} || ',' || {_CLOCK("e")} || ',Default,,0,0,0,,Subtitle_' || main_flag || '_' || number AS line FROM nm""",
)
def pixels_to_subtitles(spark, sf_dir):
    """The whole way: drawn frames, their analysis, a plan, and subtitle lines."""
    flags = vision.analyse(_drawable(spark, sf_dir), "bdr", _BOXED, image_of=image_of)
    return subtitles.subtitle_lines(framewise(flags, plan("bdr", _BOXED), HOURS))


# Forms that streams have as well


@query(
    "flag_rates",
    """SELECT user_id AS video_id, epoch_us(time_bucket(INTERVAL 6 HOURS, ts)) AS "begin", count(*) AS frames, round(avg((value > 40)::INT), 9) AS share FROM events GROUP BY ALL""",
)
def flag_rates(spark, sf_dir):
    rates = stream.flag_rates(_clocked(spark, sf_dir), "dialog", "6 hours")
    return rates.select("video_id", F.unix_micros("window.start").alias("begin"), "frames", F.round("share", 9).alias("share"))


@query(
    "flag_sessions",
    """WITH o AS (SELECT user_id AS video_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events WHERE value > 40),
r AS (SELECT *, sum((gap IS NULL OR gap >= 36000000000)::INT) OVER (PARTITION BY video_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT video_id, min(t) AS "begin", max(t) + 36000000000 AS "end", count(*) AS frames FROM r GROUP BY video_id, run""",
)
def flag_sessions(spark, sf_dir):
    found = stream.sessions(_clocked(spark, sf_dir), "dialog", "10 hours")
    return found.select("video_id", F.unix_micros("begin").alias("begin"), F.unix_micros("end").alias("end"), "frames")


def _clocked(spark, sf_dir):
    return event_frames(spark, sf_dir).select("video_id", "dialog", F.timestamp_micros("pts").alias("ts"))
