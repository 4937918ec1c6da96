"""SQL of the pixel analysis: every picture once, pixel by pixel, then joined to the frames that show it."""

from __future__ import annotations

from cuelark.operators.geometry import Rect
from cuelark.plans.presets import PRESETS
from cuelark.sources.pictures import HEIGHT, KINDS, MOST_BARS, WIDTH, pictures_sql

#: A frame's picture.
SHOWN = f"trunc(value)::BIGINT % {len(KINDS)} AS k, trunc(value)::BIGINT % {MOST_BARS} AS n"
#: Hue in half degrees, saturation and value of each pixel.
HSV = """hv AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM px),
hu AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN (g - b) * 30.0::DOUBLE / d WHEN v = g THEN 60 + (b - r) * 30.0::DOUBLE / d ELSE 120 + (r - g) * 30.0::DOUBLE / d END AS h0 FROM hv),
hs AS MATERIALIZED (SELECT *, round_even(CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END, 0) % 180 AS h, round_even(d * 255.0::DOUBLE / greatest(v, 1), 0) AS s FROM hu)"""


def corners(fractions: list[float]) -> tuple[int, int, int, int]:
    return Rect.source(WIDTH, HEIGHT).part(*fractions).corners


def inside(fractions: list[float]) -> str:
    left, right, top, bottom = corners(fractions)
    return f"x >= {left} AND x < {right} AND y >= {top} AND y < {bottom}"


def share(condition: str, fractions: list[float]) -> str:
    """Mean of the mask of a condition over a rectangle."""
    return f"avg(({condition})::INT) FILTER ({inside(fractions)}) * 255"


def flags_of(key: str, fp: str, flags: str, ctes: str) -> str:
    """A query of frames and the flags of their pictures, from a table ``fl(k, n, ...)``."""
    return f"WITH {fp}, {pictures_sql()}, {ctes}, sh AS (SELECT video_id, pts, frame_idx, is_key, {SHOWN} FROM kf) SELECT video_id, pts, frame_idx, is_key, {flags} FROM sh JOIN fl USING (k, n)"


def first(key: str) -> dict:
    return next(iter(PRESETS[key].values()))


def pkm_ctes(p: dict) -> str:
    box = p["dialogBgRect"]
    return f"""st AS (SELECT k, n, {share("grey > 230", box)} AS bg, {share("grey > 128", box)} AS tx FROM px GROUP BY k, n),
fl AS (SELECT k, n, bg > 170 AND tx > 220 AND tx < 253 AS "Dialog", round(bg, 6) AS "DialogBg", round(tx, 6) AS "DialogText" FROM st)"""


def bdr_ctes(p: dict) -> str:
    within = lambda a, b: share(f"grey BETWEEN {p[a]} AND {p[b]}", p["dialogRect"])
    return f"""st AS (SELECT k, n, {within("bgMinBrightness", "bgMaxBrightness")} AS bg, {within("textMinBrightness", "textMaxBrightness")} AS tx FROM px GROUP BY k, n),
fl AS (SELECT k, n, bg BETWEEN {p["bgMinMeanVal"]} AND {p["bgMaxMeanVal"]} AND tx BETWEEN {p["textMinMeanVal"]} AND {p["textMaxMeanVal"]} AS "Dialog", round(bg, 6) AS "DialogBgVal", round(tx, 6) AS "DialogTextVal" FROM st)"""


def whole(name: str, *parts: str) -> str:
    """A flag of all its parts, and the parts."""
    own = [f'"{name}{x}"' for x in parts]
    return f'{" AND ".join(own)} AS "{name}", {", ".join(own)}'


MR_FLAGS = {"Dialog": ("Bg", "Text", "Outline"), "Blackscreen": ("Bg", "Text"), "Whitescreen": ("Bg", "Text"), "CgSub": ("Contrast", "Border", "Text")}


def mr_ctes(p: dict) -> str:
    left, right, top, bottom = corners(p["cgSubBorderRect"])
    black, white, ground, below = p["blackscreenRect"], p["whitescreenRect"], p["dialogBgRect"], p["cgSubBelowRect"]
    # Rows above and below with reflection at the rectangle's edge; then three columns, 1, 2, 1.
    return f"""{HSV},
b0 AS (SELECT k, n, x, y, coalesce(lead(grey) OVER w, lag(grey) OVER w) - coalesce(lag(grey) OVER w, lead(grey) OVER w) AS dy FROM px WHERE {inside(p["cgSubBorderRect"])} WINDOW w AS (PARTITION BY k, n, x ORDER BY y)),
b1 AS (SELECT k, n, x, y, abs(coalesce(lag(dy) OVER w, lead(dy) OVER w) + 2 * dy + coalesce(lead(dy) OVER w, lag(dy) OVER w)) > 5 AS edge FROM b0 WINDOW w AS (PARTITION BY k, n, y ORDER BY x)),
b2 AS (SELECT k, n, y, x, min(edge::INT) OVER (PARTITION BY k, n, y ORDER BY x ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS line FROM b1),
b3 AS (SELECT k, n, max(m) AS line FROM (SELECT k, n, y, avg(line) * 255 AS m FROM b2 GROUP BY k, n, y) GROUP BY k, n),
st AS (SELECT k, n, {share("s <= 32 AND v >= 160", ground)} AS dbg, {share("grey > 192", ground)} AS dtx, {share("h BETWEEN 10 AND 30 AND s BETWEEN 40 AND 130 AND v BETWEEN 90 AND 190", p["dialogOutlineRect"])} AS dol,
  {share("grey > 80", black)} AS bbg, {share("grey > 160", black)} AS btx, {share("grey > 160", white)} AS wbg, {share("grey <= 160", white)} AS wtx, {share("grey > 160", p["cgSubTextRect"])} AS ctx,
  avg(grey) FILTER ({inside(p["cgSubAboveRect"])}) AS above, avg(CASE WHEN grey > 160 THEN 0 ELSE grey END) FILTER ({inside(below)}) AS below FROM hs GROUP BY k, n),
pt AS (SELECT k, n, dbg > 160 AS "DialogBg", dtx > 192 AND dtx < 254 AS "DialogText", dol > 3 AS "DialogOutline", bbg < 20 AS "BlackscreenBg", btx > 0.1 AND btx < 16 AS "BlackscreenText", wbg > 230 AS "WhitescreenBg", wtx > 0.8 AND wtx < 16 AS "WhitescreenText",
  above - below > 15 AND 1 - below / greatest(above, 1.0) > 0.3 AS "CgSubContrast", line > 200 AS "CgSubBorder", ctx > 0.5 AND ctx < 50 AS "CgSubText" FROM st JOIN b3 USING (k, n)),
fl AS (SELECT k, n, {", ".join(whole(f, *x) for f, x in MR_FLAGS.items())} FROM pt)"""


MD_FLAGS = {"HomeDialog": ("Bg", "Text", "Under"), **{f: ("Bg", "Text") for f in ("Dialog", "Whitescreen", "Blackscreen", "LeftBubble", "RightBubble")}}


def bubble_ctes(name: str, fractions: list[float], from_right: bool) -> str:
    box = Rect.source(WIDTH, HEIGHT).part(*fractions)
    left, _, top, bottom = box.corners
    w, _ = box.size
    fill = "b BETWEEN 203 AND 223 AND g BETWEEN 213 AND 233 AND r BETWEEN 219 AND 239"
    edge, bound = ("max", f"x > {int(w * 0.3)}") if from_right else ("min", f"x < {int(w * 0.7)}")
    good = f"edge < {w * 0.9}" if from_right else f"edge > {w * 0.1} AND edge <> {w - 1}"
    cut = f"trunc({box.left!r}::DOUBLE + {box.right - box.left!r}::DOUBLE * (edge / {w}.0::DOUBLE))"
    columns = f"x + {left} < {cut}" if from_right else f"x + {left} >= {cut}"
    return f"""{name}0 AS MATERIALIZED (SELECT k, n, x - {left} AS x, {fill} AS fill, grey FROM px WHERE {inside(fractions)}),
{name}1 AS (SELECT k, n, {edge}(x) AS edge FROM (SELECT k, n, x FROM {name}0 GROUP BY k, n, x HAVING avg(fill::INT) >= 0.9) WHERE {bound} GROUP BY k, n),
{name}2 AS (SELECT k, n, 255 - avg(fill::INT) * 255 AS bg, avg((grey <= 150)::INT) * 255 AS tx FROM {name}0 JOIN {name}1 USING (k, n) WHERE {good} AND {columns} GROUP BY k, n),
{name} AS (SELECT k, n, bg > 1 AND bg < 70 AS bg, tx > 1 AND tx < 30 AS tx FROM {name}2)"""


def md_ctes(p: dict) -> str:
    home, under, talk, white, black = (p[f"{x}Rect"] for x in ("homeDialog", "underHomeDialog", "dialog", "whitescreen", "blackscreen"))
    strip = lambda box, i: f'{share("grey > 100", box)} AS a{i}, {share("grey > 192", box)} AS c{i}'
    return f"""{bubble_ctes("lb", p["leftBubbleRect"], True)}, {bubble_ctes("rb", p["rightBubbleRect"], False)},
k0 AS (SELECT k, n, x, y, grey, max((grey > 240)::INT) OVER (PARTITION BY k, n, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near FROM px WHERE {inside(black)}),
k1 AS (SELECT k, n, grey, max(near) OVER (PARTITION BY k, n, x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near FROM k0),
k2 AS (SELECT k, n, avg((grey > 100 AND near = 0)::INT) * 255 AS lone FROM k1 GROUP BY k, n),
st AS (SELECT k, n, {strip(home, 1)}, {strip(talk, 2)}, {share("grey > 20", under)} AS ub, stddev_pop(grey) FILTER ({inside(under)}) AS us,
  {share("grey <= 170", white)} AS wb, {share("grey <= 20", white)} AS wt, {share("grey > 10", black)} AS kb, {share("grey > 240", black)} AS kt FROM px GROUP BY k, n),
pt AS (SELECT k, n, a1 > 0.1 AND a1 < 25 AS "HomeDialogBg", c1 > 0.1 AND c1 < 20 AS "HomeDialogText", ub < 1 AND us < 0.01 AS "HomeDialogUnder", a2 > 0.1 AND a2 < 25 AS "DialogBg", c2 > 0.1 AND c2 < 20 AS "DialogText",
  wb < 20 AS "WhitescreenBg", wt > 0.1 AND wt < 8 AS "WhitescreenText", kb < 15 OR lone < 0.1 AS "BlackscreenBg", kt > 0.1 AND kt < 5 AS "BlackscreenText",
  coalesce(lb.bg, false) AS "LeftBubbleBg", coalesce(lb.tx, false) AS "LeftBubbleText", coalesce(rb.bg, false) AS "RightBubbleBg", coalesce(rb.tx, false) AS "RightBubbleText"
  FROM st JOIN k2 USING (k, n) LEFT JOIN lb USING (k, n) LEFT JOIN rb USING (k, n)),
fl AS (SELECT k, n, {", ".join(whole(f, *x) for f, x in MD_FLAGS.items())} FROM pt)"""


def resized_ctes(source: str, value: str, fractions: list[float], width: int = 150, height: int = 50) -> str:
    """rz(k, n, i, j, v): a rectangle of a picture, bilinear, rounded half to even."""
    left, right, top, bottom = corners(fractions)

    def places(name: str, n: int, m: int) -> str:
        at = f"greatest(0, least({n - 1}, (i + 0.5::DOUBLE) * {n} / {m} - 0.5::DOUBLE))"
        low = f"least(trunc({at})::BIGINT, {max(n - 2, 0)})"
        return f"{name} AS (SELECT i, {low} AS a, least({low} + 1, {n - 1}) AS z, {at} - {low} AS f FROM range({m}) t(i))"

    return f"""{places("yy", bottom - top, height)}, {places("xx", right - left, width)},
sr AS MATERIALIZED (SELECT k, n, x - {left} AS x, y - {top} AS y, ({value})::DOUBLE AS v FROM {source} WHERE {inside(fractions)}),
rr AS MATERIALIZED (SELECT l.k, l.n, yy.i, l.x, l.v * (1 - f) + h.v * f AS v FROM yy JOIN sr l ON l.y = yy.a JOIN sr h ON h.y = yy.z AND h.x = l.x AND h.k = l.k AND h.n = l.n),
rz AS MATERIALIZED (SELECT l.k, l.n, l.i, xx.i AS j, least(255, greatest(0, round_even(l.v * (1 - f) + h.v * f, 0))) AS v FROM xx JOIN rr l ON l.x = xx.a JOIN rr h ON h.x = xx.z AND h.i = l.i AND h.k = l.k AND h.n = l.n)"""


def dct_ctes(width: int = 150, height: int = 50, size: int = 8) -> str:
    """ft(k, n, feature): the lowest cosine coefficients of rz, of length 1, in millionths."""
    wave = lambda at, u, n: f"cos(pi() * ({at} + 0.5::DOUBLE) * {u} / {n}) * sqrt(2.0::DOUBLE / {n}) * CASE WHEN {u} = 0 THEN 1 / sqrt(2.0::DOUBLE) ELSE 1 END"
    return f"""d1 AS MATERIALIZED (SELECT k, n, u, j, sum(v * {wave("i", "u", height)}) AS v FROM rz, range({size}) t(u) GROUP BY k, n, u, j),
d2 AS MATERIALIZED (SELECT k, n, u, w, sum(v * {wave("j", "w", width)}) AS v FROM d1, range({size}) t(w) GROUP BY k, n, u, w),
d3 AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY k, n)) AS size FROM d2),
ft AS (SELECT k, n, string_agg(round(CASE WHEN size > 0 THEN v / size ELSE v END * 1000000)::BIGINT::VARCHAR, ',' ORDER BY u, w) AS feature FROM d3 GROUP BY k, n)"""


def prk_ctes(p: dict) -> str:
    lit = "(v >= 240 AND s <= 16 AND h <= 180)"
    return f"""{HSV}, {resized_ctes("hs", f"{lit}::INT * 255", p["dialogRect"])}, {dct_ctes()},
st AS (SELECT k, n, {share(lit, p["dialogRect"])} AS lit FROM hs GROUP BY k, n),
fl AS (SELECT k, n, lit > 1.0 AS "Dialog", feature AS "DialogFeat" FROM st JOIN ft USING (k, n))"""


def mech_ctes(p: dict) -> str:
    """The grown text mask as a greatest over three rows and columns."""
    around = "ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING"
    return f"""m0 AS (SELECT k, n, x, y, grey, max((grey > 128)::INT) OVER (PARTITION BY k, n, y ORDER BY x {around}) AS t FROM px WHERE {inside(p["dialogRect"])}),
m1 AS (SELECT k, n, grey, max(t) OVER (PARTITION BY k, n, x ORDER BY y {around}) AS t FROM m0),
fl AS (SELECT k, n, avg(CASE WHEN t > 0 THEN 0 ELSE grey END) < 10 AS "DialogBgColour", avg((grey > 128)::INT) * 255 > 10 AS "DialogTextMin", '1000000,1000000,1000000,1000000' AS "DialogTextFeat" FROM m1 GROUP BY k, n)"""


def lcb_ctes(p: dict) -> str:
    """Local means over 9 by 9 with repeated edges; an opening by a line of 31; a top hat by a disc of 5, whose first and last rows are one pixel."""
    box = Rect.source(WIDTH, HEIGHT).part(*p["dialogRect"])
    left, right, top, bottom = box.corners
    near = lambda c, lo, hi: f"greatest({lo}, least({hi - 1}, {c}))"
    over = lambda f, v, axis, n: f"{f}({v}) OVER (PARTITION BY k, n, {'y' if axis == 'x' else 'x'} ORDER BY {axis} ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING)"
    side = lambda f, v, n: f"{f}({v}, {n}) OVER (PARTITION BY k, n, x ORDER BY y)"
    disc = lambda f, row, v, none: f"{f}({over('max' if f == 'greatest' else 'min', row, 'y', 1)}, coalesce({side('lag', v, 2)}, {none}), coalesce({side('lead', v, 2)}, {none}))"
    return f"""l0 AS MATERIALIZED (SELECT k, n, x, y, grey, (grey > 128)::INT AS t FROM px WHERE {inside(p["dialogRect"])}),
l1 AS MATERIALIZED (SELECT a.k, a.n, a.x, a.y, sum(b.grey) AS s FROM (SELECT k, n, x, y, {near("x + d", left, right)} AS at FROM l0, range(-4, 5) r(d)) a JOIN l0 b ON b.k = a.k AND b.n = a.n AND b.y = a.y AND b.x = a.at GROUP BY a.k, a.n, a.x, a.y),
l2 AS (SELECT a.k, a.n, a.x, a.y, sum(b.s) AS s FROM (SELECT k, n, x, y, {near("y + d", top, bottom)} AS at FROM l0, range(-4, 5) r(d)) a JOIN l1 b ON b.k = a.k AND b.n = a.n AND b.x = a.x AND b.y = a.at GROUP BY a.k, a.n, a.x, a.y),
l3 AS (SELECT l0.k, l0.n, l0.x, l0.y, t, (grey > round_even(s / 81.0::DOUBLE, 0))::INT AS u FROM l0 JOIN l2 ON l2.k = l0.k AND l2.n = l0.n AND l2.x = l0.x AND l2.y = l0.y),
l4 AS (SELECT k, n, x, y, t, {over("min", "u", "x", 15)} AS u, {over("min", "t", "x", 2)} AS r FROM l3),
l5 AS (SELECT k, n, x, y, t, {over("max", "u", "x", 15)} AS u, {disc("least", "r", "t", 1)} AS o FROM l4),
l6 AS (SELECT k, n, x, y, t, u, o, {over("max", "o", "x", 2)} AS r FROM l5),
l7 AS (SELECT k, n, t, u, {disc("greatest", "r", "o", 0)} AS o FROM l6),
st AS (SELECT k, n, avg(u * 255) / {max(box.area, 1)} AS bg, avg((t - least(o, t)) * 255) / {max(box.area, 1)} AS tx FROM l7 GROUP BY k, n),
fl AS (SELECT k, n, bg > 100e-6 AND tx > 1e-6 AND tx < 120e-6 AS "Dialog", tx > 1e-6 AND tx < 120e-6 AS "DialogText", round(tx, 6) AS "DialogTextVal", bg > 100e-6 AS "DialogBg", round(bg, 6) AS "DialogBgVal" FROM st)"""


def sobel_ctes() -> str:
    """Both derivatives of each colour with reflected borders, saturated and put together step by step."""
    down = {c: f"coalesce(lead({c}) OVER v, lag({c}) OVER v)" for c in "bgr"}
    up = {c: f"coalesce(lag({c}) OVER v, lead({c}) OVER v)" for c in "bgr"}
    columns = ", ".join(f"{up[c]} + 2 * {c} + {down[c]} AS s{c}, {down[c]} - {up[c]} AS d{c}" for c in "bgr")
    right = lambda c: f"coalesce(lead({c}) OVER h, lag({c}) OVER h)"
    left = lambda c: f"coalesce(lag({c}) OVER h, lead({c}) OVER h)"
    one = lambda c: f"least(least(abs({right('s' + c)} - {left('s' + c)}), 255) + least(abs({left('d' + c)} + 2 * d{c} + {right('d' + c)}), 255), 255)"
    both = "least(255, round_even(least(255, round_even(er / 3.0::DOUBLE + eg / 3.0::DOUBLE, 0)) + eb / 3.0::DOUBLE, 0))"
    return f"""e0 AS (SELECT k, n, x, y, {columns} FROM px WINDOW v AS (PARTITION BY k, n, x ORDER BY y)),
e1 AS (SELECT k, n, {", ".join(f"{one(c)} AS e{c}" for c in "bgr")} FROM e0 WINDOW h AS (PARTITION BY k, n, y ORDER BY x)),
fl AS (SELECT k, n, round(avg({both}), 6) AS strength, max({both})::INT AS most FROM e1 GROUP BY k, n)"""


MEANS = "fl AS (SELECT k, n, trunc((sum(b) + sum(g) + sum(r)) / (3.0::DOUBLE * count(*)))::BIGINT AS mean FROM px GROUP BY k, n)"
