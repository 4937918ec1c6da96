"""Pictures drawn from a frame's value, for queries and tests of pixel analysis.

A picture is a ground, boxes, and a row of bars that stand for text. Its kind, and
how many bars it has, come from the value; every kind is made for some flag of some
strategy, which few bars set and none or many do not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

WIDTH, HEIGHT = 192, 108
#: The most bars, and one; a value's whole part modulo this is its number.
MOST_BARS = 13
#: Drawn rows of a batch, about 4 MB.
BATCH_ROWS = 64

Colour = tuple[int, int, int]  # blue, green, red
Box = tuple[int, int, int, int, Colour]  # left, right, top, bottom (not included)


def even(level: int) -> Colour:
    return level, level, level


@dataclass(frozen=True)
class Picture:
    ground: Colour
    boxes: tuple[Box, ...] = ()
    #: The first bar's left and top, a bar's size, the way to the next, its colour and that of its edge.
    left: int = 0
    top: int = 0
    size: tuple[int, int] = (5, 10)
    step: int = 6
    bar: Colour | None = None
    edge: Colour | None = None

    def layers(self, bars: int) -> Iterator[Box]:
        """All boxes, the lowest first."""
        yield 0, WIDTH, 0, HEIGHT, self.ground
        yield from self.boxes
        w, h = self.size
        for i in range(bars if self.bar else 0):
            x = self.left + i * self.step
            if self.edge:
                yield x, x + w, self.top, self.top + h, self.edge
                yield x + 1, x + w - 1, self.top + 1, self.top + h - 1, self.bar
            else:
                yield x, x + w, self.top, self.top + h, self.bar


BUBBLE = (213, 223, 229)
FRAMED = (103, 134, 150)
CAPTION = ((48, 144, 86, 106, (30, 25, 20)),)
KINDS = (
    Picture(even(0), left=60, top=50, bar=even(255)),  # text on black
    Picture(even(230), left=35, top=45, bar=even(10)),  # text on white
    Picture(even(128), ((54, 138, 74, 100, FRAMED), (56, 136, 76, 98, even(250))), 62, 80, bar=even(40)),  # a framed box
    Picture(even(128), ((0, 192, 73, 108, even(40)),), 60, 84, bar=even(255)),  # text below a border
    Picture(even(128), ((40, 152, 76, 108, even(10)),), 50, 90, bar=even(250)),  # a strip
    Picture(even(90), ((20, 68, 12, 32, BUBBLE),), 26, 20, (3, 4), 3, even(60)),  # a bubble at the left
    Picture(even(90), ((124, 172, 12, 32, BUBBLE),), 128, 20, (3, 4), 3, even(60)),  # a bubble at the right
    Picture(even(128), ((4, 188, 78, 106, even(250)),), 20, 90, bar=even(30)),  # a white band
    Picture(even(128), (), 30, 94, bar=even(255)),  # plain white text
    Picture(even(128), CAPTION, 52, 90, bar=even(255), edge=even(0)),  # outlined text in a dark box
    Picture(even(60), ((40, 150, 88, 90, even(110)),), 60, 94, (1, 1), 6, even(255)),  # specks of text under a line
    Picture((60, 90, 30), CAPTION, 52, 90, bar=(40, 220, 240), edge=even(0)),  # outlined coloured text
)


@lru_cache(maxsize=len(KINDS) * MOST_BARS)
def picture(kind: int, bars: int) -> bytes:
    image = np.zeros((HEIGHT, WIDTH, 3), np.uint8)
    for left, right, top, bottom, colour in KINDS[kind].layers(bars):
        image[top:bottom, left:right] = colour
    return image.tobytes()


def drawn(value: float) -> bytes:
    """Row-major BGR bytes of the picture of a value."""
    return picture(int(value) % len(KINDS), int(value) % MOST_BARS)


def drawn_frames(frames: DataFrame) -> DataFrame:
    """Frames with pixels: each has the picture of its ``feat``.

    Rows go on in batches of BATCH_ROWS, however many come at a time: each has 62 KB.
    """

    def run(batches):
        for pdf in (whole[a : a + BATCH_ROWS] for whole in batches for a in range(0, len(whole), BATCH_ROWS)):
            yield pd.DataFrame({"video_id": pdf.video_id, "pts": pdf.pts, "frame_idx": pdf.frame_idx, "is_key": pdf.is_key, "h": HEIGHT, "w": WIDTH, "img": [drawn(v) for v in pdf.feat]})

    slim = frames.select("video_id", "pts", "frame_idx", "is_key", "feat")
    return slim.mapInPandas(run, "video_id long, pts long, frame_idx long, is_key boolean, h int, w int, img binary")


def image_of(pdf: pd.DataFrame):
    """For ``vision.looks`` and ``vision.analyse``: the image of a row is drawn when it is looked at."""
    feat = pdf["feat"].to_numpy()
    return lambda i: np.frombuffer(drawn(feat[i]), np.uint8).reshape(HEIGHT, WIDTH, 3)


def pictures_sql() -> str:
    """SQL for all pixels of all pictures: px(k, n, x, y, b, g, r)."""
    cases = []
    for kind, p in enumerate(KINDS):
        layers = [f"WHEN k = {kind} AND x BETWEEN {x0} AND {x1 - 1} AND y BETWEEN {y0} AND {y1 - 1} THEN {list(c)}" for x0, x1, y0, y1, c in [(0, WIDTH, 0, HEIGHT, p.ground), *p.boxes]]
        if p.bar:
            w, h = p.size
            inside = f"x >= {p.left} AND (x - {p.left}) // {p.step} < n AND y BETWEEN {p.top} AND {p.top + h - 1} AND (x - {p.left}) % {p.step} < {w}"
            layers.append(f"WHEN k = {kind} AND {inside} THEN {list(p.edge or p.bar)}")
            if p.edge:
                layers.append(f"WHEN k = {kind} AND {inside} AND (x - {p.left}) % {p.step} BETWEEN 1 AND {w - 2} AND y BETWEEN {p.top + 1} AND {p.top + h - 2} THEN {list(p.bar)}")
        cases += layers[::-1]
    grid = f"SELECT k, n, x, y FROM range({len(KINDS)}) a(k), range({MOST_BARS}) b(n), range({WIDTH}) c(x), range({HEIGHT}) d(y)"
    return f"""pc AS (SELECT k, n, x, y, CASE {" ".join(cases)} END AS c FROM ({grid})),
px AS MATERIALIZED (SELECT k, n, x, y, c[1] AS b, c[2] AS g, c[3] AS r, (c[1] * 1868 + c[2] * 9617 + c[3] * 4899 + 8192) >> 14 AS grey FROM pc)"""
