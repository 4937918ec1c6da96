"""SQL of adaptive sampling: a recursive query whose every step is one look, or one gap closed, of each video."""

from __future__ import annotations

INTERVAL = "STRUCT(b BIGINT, e BIGINT, s DOUBLE[], c BIGINT, fm BOOLEAN, fp BIGINT)"


def _fits(x: str, gated: str, threshold: float, reach: int) -> str:
    near = f"list_distance(list_transform({x}.s, lambda z: z / {x}.c), f[i]) < {threshold}"
    far = f"greatest({x}.b - p[i], p[i] - {x}.e, 0) > {reach}"
    return f"({near} AND NOT ({gated} AND list_bool_and(list_transform(f[i], lambda z: z = 0)) AND {far}))"


def _taken(x: str) -> str:
    total = f"list_transform(range(1, len({x}.s) + 1), lambda z: {x}.s[z] + f[i][z])"
    return f"{{'b': least({x}.b, p[i]), 'e': greatest({x}.e, p[i]), 's': {total}, 'c': {x}.c + 1, 'fm': {x}.fm, 'fp': {x}.fp}}"


def grown_ctes(source: str, flag: str, feature: str, threshold: float, reach: int) -> str:
    """gr(video_id, main_flag, b, e, n_points, s, fp, seq): intervals; wk(video_id, n_frames, n_decoded, n_analysed): their work.

    ``source`` has video_id, pts, frame_idx, is_key, and the expressions ``flag`` and
    ``feature`` (a list). In a state, g holds the intervals, k the gap that is looked
    at, t the key frames seen, and looks the frames.
    """
    new = "{'b': p[i], 'e': p[i], 's': f[i], 'c': 1, 'fm': m[i], 'fp': p[i]}"
    middle = "(g[k].e + (g[k + 1].b - g[k].e) // 2)"
    between = "list_filter(range(1, n + 1), lambda j: p[j] > g[k].e AND p[j] < g[k + 1].b)"
    nearest = f"list_min(list_transform({between}, lambda j: {{'d': abs(p[j] - {middle}), 'j': j}})).j"
    fits = lambda x, gated: _fits(x, gated, threshold, reach)
    return f"""un AS (SELECT video_id, pts, is_key, coalesce({flag}, false) AS m, {feature} AS f FROM {source} QUALIFY row_number() OVER (PARTITION BY video_id, pts ORDER BY frame_idx) = 1),
vi AS (SELECT video_id, list(pts ORDER BY pts) AS p, list(m ORDER BY pts) AS m, list(f ORDER BY pts) AS f, list(is_key ORDER BY pts) AS ky, count(*) AS n FROM un GROUP BY video_id),
wi AS MATERIALIZED (SELECT *, list_sort(list_distinct(list_concat([1, n], list_filter(range(1, n + 1), lambda j: ky[j])))) AS q FROM vi),
grow(video_id, g, k, t, looks) AS (
  SELECT video_id, []::{INTERVAL}[], 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM wi
  UNION ALL
  SELECT video_id,
    CASE WHEN NOT gap AND len(g) > 0 AND {fits("g[len(g)]", "t > 1")} THEN list_append(g[1:len(g) - 1], {_taken("g[len(g)]")})
      WHEN NOT gap THEN list_append(g, {new})
      WHEN i IS NULL AND g[k].e >= g[k + 1].b THEN g
      WHEN i IS NULL THEN list_concat(list_append(g[1:k - 1], {{'b': g[k].b, 'e': g[k + 1].b, 's': g[k].s, 'c': g[k].c, 'fm': g[k].fm, 'fp': g[k].fp}}), g[k + 1:])
      WHEN {fits("g[k]", "true")} THEN list_concat(list_append(g[1:k - 1], {_taken("g[k]")}), g[k + 1:])
      WHEN {fits("g[k + 1]", "true")} THEN list_concat(list_append(g[1:k], {_taken("g[k + 1]")}), g[k + 2:])
      ELSE list_concat(list_append(g[1:k], {new}), g[k + 1:]) END,
    CASE WHEN NOT gap THEN greatest(len(g), 1) WHEN i IS NULL AND g[k].e >= g[k + 1].b THEN k + 1 ELSE k END,
    CASE WHEN gap THEN t ELSE t + 1 END,
    CASE WHEN i IS NULL THEN looks ELSE list_append(looks, i) END
  FROM (SELECT *, CASE WHEN NOT gap THEN q[t + 1] WHEN g[k].e >= g[k + 1].b THEN NULL ELSE {nearest} END AS i
    FROM (SELECT grow.*, wi.* EXCLUDE (video_id), k >= 1 AND k < len(g) AS gap FROM grow JOIN wi USING (video_id)) WHERE gap OR t < len(q))),
fi AS MATERIALIZED (SELECT * FROM grow JOIN wi USING (video_id) WHERE NOT (k >= 1 AND k < len(g)) AND t >= len(q)),
sg AS (SELECT video_id, max(i) - first_key + 1 AS d FROM (SELECT video_id, i, coalesce(list_max(list_filter(range(1, i + 1), lambda j: ky[j])), 1) AS first_key FROM (SELECT video_id, ky, unnest(looks) AS i FROM fi)) GROUP BY video_id, first_key),
wk AS (SELECT video_id, n AS n_frames, d AS n_decoded, len(looks) AS n_analysed FROM fi JOIN (SELECT video_id, sum(d)::BIGINT AS d FROM sg GROUP BY video_id) USING (video_id)),
ui AS (SELECT video_id, unnest(g) AS x, unnest(range(len(g))) AS place FROM fi),
gr AS (SELECT video_id, 'Dialog' AS main_flag, x.b AS b, x.e AS e, x.c AS n_points, x.s AS s, x.fp AS fp, row_number() OVER (PARTITION BY video_id ORDER BY place) - 1 AS seq FROM ui WHERE x.fm)"""


def fold_ctes(source: str, name: str, below: float, size: int) -> str:
    """Folds neighbours whose mean features are nearer than ``below``."""
    kind = "STRUCT(b BIGINT, e BIGINT, n BIGINT, s DOUBLE[])[]"
    last = "acc.v[len(acc.v)]"
    near = f"list_distance(list_transform({last}.s, lambda c: c / {last}.n), list_transform(x.v[1].s, lambda c: c / x.v[1].n)) < {below}"
    both = f"{{'b': least({last}.b, x.v[1].b), 'e': greatest({last}.e, x.v[1].e), 'n': {last}.n + x.v[1].n, 's': list_transform(range(1, {size + 1}), lambda i: {last}.s[i] + x.v[1].s[i])}}"
    step = f"CASE WHEN len(acc.v) = 0 THEN x WHEN {near} THEN {{'v': list_append(acc.v[1:len(acc.v) - 1], {both})}} ELSE {{'v': list_append(acc.v, x.v[1])}} END"
    return f"""{name}_l AS (SELECT video_id, list({{'b': b, 'e': e, 'n': n_points, 's': s}} ORDER BY b, seq) AS xs FROM {source} GROUP BY video_id),
{name}_f AS (SELECT video_id, list_reduce(list_prepend({{'v': []::{kind}}}, list_transform(xs, lambda x: {{'v': [x]}})), lambda acc, x: {step}).v AS ys FROM {name}_l),
{name} AS (SELECT video_id, 'Dialog' AS main_flag, y.b AS b, y.e AS e, y.n AS n_points, y.s AS s, row_number() OVER (PARTITION BY video_id ORDER BY y.b, place) - 1 AS seq FROM (SELECT video_id, unnest(ys) AS y, unnest(range(len(ys))) AS place FROM {name}_f))"""
