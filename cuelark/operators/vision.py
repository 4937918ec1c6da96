"""Per-frame analysis: pixels to the flag columns of a strategy.

Each strategy is one pure function of an image and its parameters, run once a
frame in Arrow batches; its grey and colour views are made once and shared by its
tests. The cheap tests gate the dear ones inside the function, which Spark could
not promise for separate user functions. Thresholds are fixed values of the kinds
of video that a strategy is made for.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelark.functions import pixel as px
from cuelark.operators.geometry import Rect

Flags = dict[str, object]
B, D, V = T.BooleanType(), T.DoubleType(), T.ArrayType(T.DoubleType())
NO_FEATURE = [0.0] * 64


def bright(grey: np.ndarray, over: int) -> float:
    """Mean of the mask of pixels over a brightness."""
    return px.share(grey > over)


def screen(grey: np.ndarray, least_text: float) -> tuple[bool, bool]:
    """Whether a dark screen's ground and text are there."""
    return bright(grey, 80) < 20, least_text < bright(grey, 160) < 16


def named(name: str, **parts: bool) -> Flags:
    """A flag that holds where all its parts do, with the parts."""
    return {name: all(parts.values())} | {name + part: bool(on) for part, on in parts.items()}


# mr


def quest(image: np.ndarray, rect: Callable[[str], Rect]) -> Flags:
    ground = rect("dialogBgRect").cut(image)
    grey, colour = px.grey(ground), px.hsv(ground)
    outline = px.hsv(rect("dialogOutlineRect").cut(image))
    flags = named("Dialog", Bg=px.share(px.within(colour, (0, 0, 160), (255, 32, 255))) > 160, Text=192 < bright(grey, 192) < 254, Outline=px.share(px.within(outline, (10, 40, 90), (30, 130, 190))) > 3)
    dark, text = screen(px.grey(rect("blackscreenRect").cut(image)), 0.1)
    flags |= named("Blackscreen", Bg=dark, Text=text)
    white = px.grey(rect("whitescreenRect").cut(image))
    flags |= named("Whitescreen", Bg=bright(white, 160) > 230, Text=0.8 < px.share(white <= 160) < 16)
    above, below, border, words = (px.grey(rect(f"cgSub{x}Rect").cut(image)) for x in ("Above", "Below", "Border", "Text"))
    before, after = float(above.mean()), float(np.where(below > 160, 0, below).mean())
    edge = px.mask(np.minimum(np.abs(px.sobel(border, 0, 1)), 255) > 5)
    line = px.erode(edge, px.rectangle(20, 1)).mean(1).max()
    flags |= named("CgSub", Contrast=before - after > 15 and 1 - after / max(before, 1.0) > 0.3, Border=line > 200, Text=0.5 < bright(words, 160) < 50)
    return flags


# mr-s0

#: Bounding boxes of a film's letters: width, height and area.
LETTER_SIDE, LETTER_AREA = (3, 30), (20, 400)
BALLOON_SHARE = (0.4, 0.3)


def letters(x: np.ndarray) -> tuple[np.ndarray, int]:
    """The regions of a mask that look like letters, and their area.

    The height's lower bound is a bound on the area, as the published behaviour has it.
    """
    labels, stats = px.components(x)
    _, _, w, h, area = stats.T
    fits = (area > LETTER_AREA[0]) & (area < LETTER_AREA[1]) & (w < LETTER_SIDE[1]) & (h < LETTER_SIDE[1]) & (w > LETTER_SIDE[0]) & (area > LETTER_SIDE[0])
    return px.mask(fits[labels]), int(area[fits].sum())


def shaded_text(image: np.ndarray) -> np.ndarray:
    """Bright letters with a dark shade around them."""
    grey = px.grey(image)
    letter, _ = letters(px.mask((grey > 50) & px.above_local(grey, 7, 3)))
    shade = px.mask((grey <= 40) & ~px.above_local(grey, 7, 6)) & px.dilate(letter, px.ellipse(5, 5))
    return px.closed(shade, px.ellipse(11, 11)) & letter


def mean_colour(image: np.ndarray, where: np.ndarray) -> list[float]:
    """Mean blue, green and red of a mask, and a fourth 0."""
    return [*image[where > 0].mean(0).tolist(), 0.0] if where.any() else [0.0] * 4


def film(image: np.ndarray, rect: Callable[[str], Rect]) -> Flags:
    dark, text = screen(px.grey(rect("blackscreenRect").cut(image)), 0.07)
    flags = named("Blackscreen", Bg=dark, Text=text)
    colour = [0.0] * 4
    box = rect("dialogRect")
    roi = box.cut(image)
    found = shaded_text(roi)
    value = {part: letters(rect(f"dialog{part}Rect").seen_from(box).cut(found))[1] / max(box.area, 1) * 256 for part in ("Name", "Content")}
    dialog = value["Name"] > 1.0 or value["Content"] > 3.0
    if dialog:
        colour = mean_colour(roi, found)
    flags |= {"Dialog": dialog, "DialogNameVal": value["Name"], "DialogContentVal": value["Content"]}
    wide = rect("balloonRect")
    balloon, area = False, 0.0
    grey = px.grey(wide.cut(image))
    shade = px.closed(px.mask((grey <= 40) & ~px.above_local(grey, 13, 33)), px.ellipse(11, 11))
    lit = px.opened(px.mask(grey > 100) & shade, px.ellipse(3, 3))
    blurred = px.saturated(px.box_mean(lit, 301, 101))
    if blurred.size and blurred.max() >= 3:
        y, x = np.unravel_index(int(blurred.argmax()), blurred.shape)
        w, h = wide.size
        spot = []
        for at, n, whole in ((x, w, BALLOON_SHARE[0]), (y, h, BALLOON_SHARE[1])):  # of one shape in corners, too
            low = min(max(at / n - whole / 2, 0), 1 - whole)
            spot += [low, low + whole]
        floating = wide.part(*spot)
        roi = floating.cut(image)
        found = shaded_text(roi)
        area = letters(found)[1] / max(floating.area, 1) * 256
        balloon = area > 2.5
        if balloon:
            colour = mean_colour(roi, found)
    return flags | {"Balloon": balloon, "BalloonVal": float(area), "MeanTextColour": colour}


# md

BUBBLE = ((203, 213, 219), (223, 233, 239))


def strip(grey: np.ndarray) -> dict[str, bool]:
    return {"Bg": 0.1 < bright(grey, 100) < 25, "Text": 0.1 < bright(grey, 192) < 20}


def bubble(image: np.ndarray, box: Rect, from_right: bool) -> dict[str, bool]:
    """A speech bubble at one side: bounded by the outermost column that is nearly all bubble."""
    none = {"Bg": False, "Text": False}
    roi = box.cut(image)
    w, _ = box.size
    full = np.flatnonzero(px.within(roi, *BUBBLE).mean(0) >= 0.9)
    full = full[full > int(w * 0.3)] if from_right else full[full < int(w * 0.7)]
    if not len(full):
        return none
    edge = int(full[-1] if from_right else full[0])
    if (from_right and edge >= w * 0.9) or (not from_right and (edge <= w * 0.1 or edge == w - 1)):
        return none
    inner = (box.part(0, edge / w, 0, 1) if from_right else box.part(edge / w, 1, 0, 1)).cut(image)
    return {"Bg": 1 < 255 - px.share(px.within(inner, *BUBBLE)) < 70, "Text": 1 < px.share(px.grey(inner) <= 150) < 30}


def home_story(image: np.ndarray, rect: Callable[[str], Rect]) -> Flags:
    under = px.grey(rect("underHomeDialogRect").cut(image))
    flags = named("HomeDialog", **strip(px.grey(rect("homeDialogRect").cut(image))), Under=bright(under, 20) < 1 and float(under.std()) < 0.01)
    flags |= named("Dialog", **strip(px.grey(rect("dialogRect").cut(image))))
    white = px.grey(rect("whitescreenRect").cut(image))
    flags |= named("Whitescreen", Bg=px.share(white <= 170) < 20, Text=0.1 < px.share(white <= 20) < 8)
    black = px.grey(rect("blackscreenRect").cut(image))
    around = px.dilate(px.mask(black > 240), px.rectangle(9, 9)) > 0
    flags |= named("Blackscreen", Bg=bright(black, 10) < 15 or px.share((black > 100) & ~around) < 0.1, Text=0.1 < bright(black, 240) < 5)
    flags |= named("LeftBubble", **bubble(image, rect("leftBubbleRect"), True))
    return flags | named("RightBubble", **bubble(image, rect("rightBubbleRect"), False))


# lcb, lcb-mech, pkm, prk, bdr


def company(image: np.ndarray, rect: Callable[[str], Rect]) -> Flags:
    box = rect("dialogRect")
    grey = px.grey(box.cut(image))
    lines = px.opened(px.mask(px.above_local(grey, 9, 0, weighted=False)), px.rectangle(31, 1))
    words = px.top_hat(px.mask(grey > 128), px.ellipse(5, 5))
    ground, text = float(lines.mean()) / max(box.area, 1), float(words.mean()) / max(box.area, 1)
    has_ground, has_text = ground > 100e-6, 1e-6 < text < 120e-6
    return {"Dialog": has_ground and has_text, "DialogText": has_text, "DialogTextVal": text, "DialogBg": has_ground, "DialogBgVal": ground}


def mechanics(image: np.ndarray, rect: Callable[[str], Rect], model: tuple[np.ndarray, np.ndarray] | None = None) -> Flags:
    grey = px.grey(rect("dialogRect").cut(image))
    text = px.dilate(px.mask(grey > 128), px.rectangle(3, 3))
    small = px.resized(grey, 100, 20).astype(np.float64).ravel()
    feature = px.projected(small, *model) if model else np.ones(4)
    return {"DialogBgColour": float(np.where(text > 0, 0, grey).mean()) < 10, "DialogTextMin": bright(grey, 128) > 10, "DialogTextFeat": feature.tolist()}


def handheld(image: np.ndarray, rect: Callable[[str], Rect]) -> Flags:
    grey = px.grey(rect("dialogBgRect").cut(image))
    ground, text = bright(grey, 230), bright(grey, 128)
    return {"Dialog": ground > 170 and 220 < text < 253, "DialogBg": ground, "DialogText": text}


def conte(image: np.ndarray, rect: Callable[[str], Rect]) -> Flags:
    white = px.mask(px.within(px.hsv(rect("dialogRect").cut(image)), (0, 0, 240), (180, 16, 255)))
    return {"Dialog": float(white.mean()) > 1.0, "DialogFeat": px.dct_feature(px.resized(white, 150, 50)).tolist()}


def band_story(image: np.ndarray, rect: Callable[[str], Rect], **p) -> Flags:
    grey = px.grey(rect("dialogRect").cut(image))
    ground = px.share(px.within(grey, p["bgMinBrightness"], p["bgMaxBrightness"]))
    text = px.share(px.within(grey, p["textMinBrightness"], p["textMaxBrightness"]))
    on = p["bgMinMeanVal"] <= ground <= p["bgMaxMeanVal"] and p["textMinMeanVal"] <= text <= p["textMaxMeanVal"]
    return {"Dialog": on, "DialogBgVal": ground, "DialogTextVal": text}


# otl


def outlined_text(roi: np.ndarray, p: dict) -> np.ndarray:
    """Mask of text of given colours inside outlines of given colours.

    Thin specks of the text colour go; both must lie near edges of the picture; text
    counts where outlines close around it. ``fastMode`` asks only that text be near
    an outline. ``textWeightMin`` 0 leaves the text mask as it is.
    """
    colour = px.hsv(roi)
    text, outline = (px.mask(px.within_any(colour, p[k])) for k in ("textHSVRanges", "outlineHSVRanges"))
    slack = p["boundCompensation"]
    if p["textWeightMin"] > 0:
        text = px.strokes_over(text, p["textWeightMin"], p["textWeightMin"] + slack)
    wide = p["textWeightMax"] + slack
    if p.get("fastMode"):
        return px.near(text, outline, wide)
    if p["nestingSuppression"] > 0:
        grown = px.dilate(outline | text, px.ellipse(slack + 1, slack + 1))
        text = text & px.erode(grown, px.ellipse(p["nestingSuppression"], p["nestingSuppression"]))
    edge = px.closed(px.mask(px.edges(roi) > p["sobelThreshold"]), px.ellipse(3, 3))
    ring = px.closed(px.near(outline, edge, p["outlineWeightMax"]), px.ellipse(wide, wide))
    return ring & px.near(text, edge, p["textWeightMax"])


def outlined(image: np.ndarray, rect: Callable[[str], Rect], **p) -> Flags:
    text = outlined_text(rect("dialogRect").cut(image), p)
    on = float(text.mean()) > p["featureThreshold"]
    return {"Dialog": on, "DialogFeat": px.dct_feature(px.resized(text, 150, 50)).tolist() if on else NO_FEATURE}


# bcs

Quad = list[tuple[float, float]]
Detector = Callable[[np.ndarray], list[Quad]]


def text_rows(image: np.ndarray) -> list[Quad]:
    """A stand-in for a text detector: boxes around rows of dense edges. A trained detector goes in its place."""
    strong = px.mask(px.edges(image) > 96)
    joined = px.closed(strong, px.rectangle(2 * max(image.shape[1] // 40, 2) + 1, 5))
    _, stats = px.components(joined)
    boxes = [(x, y, w, h) for x, y, w, h, area in stats[1:].tolist() if w >= 2 * h and area >= 40]
    return [[(x, y), (x + w - 1, y), (x + w - 1, y + h - 1), (x, y + h - 1)] for x, y, w, h in boxes]


def upright_boxes(quads: list[Quad], width: int, height: int, expand: float) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) around quadrangles that lean at most 3 degrees, somewhat larger."""
    out = []
    for (x0, y0), (x1, y1), (x2, y2), (x3, y3) in quads:
        lean = (np.arctan2(y1 - y0, x1 - x0) + np.arctan2(y2 - y3, x2 - x3)) / 2
        if abs(lean) > np.deg2rad(3):
            continue
        xs, ys = [int(v) for v in (x0, x1, x2, x3)], [int(v) for v in (y0, y1, y2, y3)]
        w, h = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
        more = int(h * expand)
        out.append((max(0, min(xs) - more), max(0, min(ys) - more), min(width, w + 2 * more), min(height, h + 2 * more)))
    return out


def box_text(roi: np.ndarray, p: dict) -> np.ndarray:
    """Mask of the colour that most of a box's even regions share, greys counting less.

    Even regions of the picture between edges are grouped by mean colour; a group
    scores by its area, less by how grey it is. Without two regions, or a group
    large enough, nothing is text.
    """
    none = np.zeros(roi.shape[:2], np.uint8)
    labels, stats = px.components(px.mask(px.edges(roi, 1) <= p["sobelThreshold"]))
    flat, which = roi.reshape(-1, 3).astype(np.float64), labels.ravel()
    count = np.bincount(which, minlength=len(stats)).astype(np.float64)
    sums = np.stack([np.bincount(which, flat[:, c], len(stats)) for c in range(3)], 1)
    squares = np.stack([np.bincount(which, flat[:, c] ** 2, len(stats)) for c in range(3)], 1)
    safe = np.maximum(count, 1)[:, None]
    mean = sums / safe
    deviation = np.sqrt(np.maximum(squares / safe - mean**2, 0)).mean(1)
    total = roi.shape[0] * roi.shape[1]
    fits = (count >= max(10, p["minCcAreaRatio"] * total)) & (count <= p["maxCcAreaRatio"] * total) & (deviation < p["maxCcStddev"])
    if fits.sum() < 2:
        return none
    colours, areas = mean[fits], count[fits]
    best, picked = -1.0, None
    group = px.clusters(px.standardised(colours), p["clusterThreshold"])
    for k in range(group.max() + 1):
        own = group == k
        ratio = areas[own].sum() / areas.sum()
        if ratio >= p["minColourAreaRatio"]:
            colour = (colours[own] * areas[own, None]).sum(0) / areas[own].sum()
            vivid = np.abs(colour - colour.mean()).sum() / 340
            score = ratio * (1 - p["maxGreyscalePenalty"] + p["maxGreyscalePenalty"] * vivid)
            if score > best:
                best, picked = score, np.rint(colour)
    if picked is None:
        return none
    found = px.mask(px.within(roi, np.maximum(picked - p["colourTolerance"], 0), np.minimum(picked + p["colourTolerance"], 255)))
    return found if found.mean() > p["minCcFinalMean"] else none


def boxes_of_text(roi: np.ndarray, p: dict, detector: Detector = text_rows) -> np.ndarray:
    """Mask of the text in all boxes that a detector finds, minor boxes left out."""
    boxes = sorted(upright_boxes(detector(roi), roi.shape[1], roi.shape[0], p["boxVerticalExpansion"]), key=lambda b: -b[2] * b[3])
    whole = sum(w * h for _, _, w, h in boxes)
    text = np.zeros(roi.shape[:2], np.uint8)
    for rank, (x, y, w, h) in enumerate(boxes):
        if rank >= p["nonMajorBoxSuppressionMinRank"] and w * h <= p["nonMajorBoxSuppressionMaxRatio"] * whole:
            break
        text[y : y + h, x : x + w] = box_text(roi[y : y + h, x : x + w], p)
    return text


def box_colours(image: np.ndarray, rect: Callable[[str], Rect], detector: Detector = text_rows, **p) -> Flags:
    text = boxes_of_text(rect("dialogRect").cut(image), p, detector)
    value = float(text.mean())
    return {"Dialog": value > p["featureThreshold"], "DialogVal": value, "DialogFeat": px.dct_feature(px.resized(text, 150, 50)).tolist()}


def _flags(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def _booleans(*names: str) -> dict[str, T.DataType]:
    return dict.fromkeys(names, B)


#: Of each strategy the analysis, the columns it makes, and fixed rectangles: a name's parent and fractions of it.
STRATEGIES: dict[str, tuple[Callable, T.StructType, dict[str, tuple[str, tuple[float, float, float, float]]]]] = {
    "mr": (quest, _flags(**_booleans(*[a + b for a, parts in (("Dialog", ("", "Bg", "Text", "Outline")), ("Blackscreen", ("", "Bg", "Text")), ("Whitescreen", ("", "Bg", "Text")), ("CgSub", ("", "Contrast", "Border", "Text"))) for b in parts])), {}),
    "mr-s0": (
        film,
        _flags(**_booleans("Blackscreen", "BlackscreenBg", "BlackscreenText", "Dialog"), DialogNameVal=D, DialogContentVal=D, Balloon=B, BalloonVal=D, MeanTextColour=V),
        {"dialogNameRect": ("dialogRect", (0, 0.5, 0, 0.33)), "dialogContentRect": ("dialogRect", (0, 1, 0.34, 1)), "balloonRect": ("", (0.15, 0.85, 0.05, 0.75))},
    ),
    "md": (home_story, _flags(**_booleans(*[a + b for a, parts in (("HomeDialog", ("", "Bg", "Text", "Under")), *[(x, ("", "Bg", "Text")) for x in ("Dialog", "Whitescreen", "Blackscreen", "LeftBubble", "RightBubble")]) for b in parts])), {}),
    "lcb": (company, _flags(Dialog=B, DialogText=B, DialogTextVal=D, DialogBg=B, DialogBgVal=D), {}),
    "lcb-mech": (mechanics, _flags(DialogBgColour=B, DialogTextMin=B, DialogTextFeat=V), {}),
    "pkm": (handheld, _flags(Dialog=B, DialogBg=D, DialogText=D), {}),
    "prk": (conte, _flags(Dialog=B, DialogFeat=V), {}),
    "bdr": (band_story, _flags(Dialog=B, DialogBgVal=D, DialogTextVal=D), {}),
    "otl": (outlined, _flags(Dialog=B, DialogFeat=V), {}),
    "bcs": (box_colours, _flags(Dialog=B, DialogVal=D, DialogFeat=V), {}),
}


def rectangles(strategy: str, params: dict, width: int, height: int, content: tuple[float, float, float, float] = (0, 1, 0, 1)) -> Callable[[str], Rect]:
    """The strategy's rectangles by name, in pixels of a frame whose content is a part of it."""
    whole = Rect.source(width, height).part(*content)
    fixed = STRATEGIES[strategy][2]

    def of(name: str) -> Rect:
        if name in params:
            return whole.part(*params[name])
        parent, parts = fixed[name]
        return (of(parent) if parent else whole).part(*parts)

    return of


#: Bytes of the pictures that a worker keeps with what was made of them.
KEPT_BYTES = 32 << 20
#: Frames that follow each other go to one task together.
STRETCH = 64


def _pixels(image: np.ndarray) -> bytes:
    """All bytes of an image, the object that holds them if it is of bytes."""
    held = image.base
    while isinstance(held, np.ndarray):
        held = held.base
    return held if isinstance(held, bytes) and len(held) == image.nbytes and image.flags.c_contiguous else image.tobytes()


class ByPicture:
    """A pure function of images that is worked out once for images of the same pixels.

    Pictures that stand still or come back are told by their size and all their
    bytes. The latest pictures of KEPT_BYTES together are kept; a larger one is not.
    A worker that gets it again, with its next task, goes on with what it has kept.
    """

    def __init__(self, run: Callable, name: str | None = None):
        self.run, self.name, self.kept, self.held = run, name or uuid.uuid4().hex, OrderedDict(), 0

    def __reduce__(self):
        return _arrived, (self.name, self.run)

    def __call__(self, image: np.ndarray):
        key = image.shape, _pixels(image)
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        made = self.run(image)
        if image.nbytes <= KEPT_BYTES:
            self.kept[key] = made
            self.held += image.nbytes
            while self.held > KEPT_BYTES:
                (_, old), _ = self.kept.popitem(last=False)
                self.held -= len(old)
        return made


#: The last that came to this process.
_LAST: dict[str, ByPicture] = {}


def _arrived(name: str, run: Callable) -> ByPicture:
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = ByPicture(run, name)
    return _LAST[name]


def _stored(batch: pa.RecordBatch) -> Callable[[int], np.ndarray]:
    """The images of rows that have their pixels, where they lie."""
    h, w, img = batch.column("h").to_pylist(), batch.column("w").to_pylist(), batch.column("img")
    return lambda i: np.frombuffer(img[i].as_buffer(), np.uint8).reshape(h[i], w[i], 3)


def _plain(x: object) -> object:
    return x if isinstance(x, list | int) else x.item() if isinstance(x, np.generic) else float(x)


def _made(batches: Iterator[pa.RecordBatch], of: ByPicture, image_of: Callable | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        image = image_of(batch.to_pandas()) if image_of else _stored(batch)
        rows = [of(image(i)) for i in range(batch.num_rows)]
        different = {id(x): x for x in rows}
        place = {k: i for i, k in enumerate(different)}
        at = pa.array([place[id(x)] for x in rows], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in batch.schema.names else pa.array([_plain(x[f.name]) for x in different.values()], f.type).take(at) for f in schema], schema=schema)


def each_frame(frames: DataFrame, keys: list[str], run: Callable[[np.ndarray], Flags], columns: T.StructType, image_of: Callable | None = None) -> DataFrame:
    """The frames' keys and what a pure function makes of each frame's image.

    ``frames`` has h, w and img (row-major BGR bytes), and frames without pixels are
    left out; they are not shuffled. With ``image_of`` it has what fetches an image
    instead: ``image_of`` gets some rows and gives the function from a row's place to
    its image, so that pixels never leave the worker that reads them, and one image
    is held at a time. Those rows are small and the work on them dear: they are dealt
    out by stretches of a video over a stated number of partitions.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if image_of:
        spark = frames.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        slim = frames.repartition(parts, "video_id", F.call_function("div", F.col("frame_idx"), F.lit(STRETCH)))
    else:
        slim = frames.where("img is not null").select(*keys, "h", "w", "img")
    schema = T.StructType([*[slim.schema[k] for k in keys], *columns.fields])
    return slim.mapInArrow(partial(_made, of=ByPicture(run), image_of=image_of, schema=to_arrow_schema(schema)), schema)


def _one_image(image: np.ndarray, strategy: str, params: dict, content: tuple, values: dict) -> Flags:
    return STRATEGIES[strategy][0](image, rectangles(strategy, params, image.shape[1], image.shape[0], content), **values)


def _known(params: dict) -> dict:
    return {k: v for k, v in params.items() if k != "debugLevel" and not k.startswith(("featureJump", "jumpThresh", "fillGap", "iirPass"))}


def _run(strategy: str, params: dict, content: tuple[float, float, float, float], extra: dict) -> Callable[[np.ndarray], Flags]:
    """The analysis of an image by a strategy with its parameters."""
    known = _known(params)
    values = {k: v for k, v in known.items() if not k.endswith("Rect")} | extra
    return partial(_one_image, strategy=strategy, params=known, content=tuple(content), values=values)


def looks(strategy: str, params: dict, flag: str, feature: str, image_of: Callable, content: tuple[float, float, float, float] = (0, 1, 0, 1), **extra) -> Callable:
    """For ``speculative.sparse_looks``: fetches and analyses one frame of a video at a time.

    ``image_of`` gets the video's rows and gives the function from a row's place to
    its image (h, w, 3).
    """
    run = _run(strategy, params, content, extra)
    found = ByPicture(lambda x: (bool((flags := run(x))[flag]), np.asarray(flags[feature], float)))

    def of(pdf):
        image = image_of(pdf)
        return lambda i: found(image(i))

    return of


def analyse(frames: DataFrame, strategy: str, params: dict, content: tuple[float, float, float, float] = (0, 1, 0, 1), image_of: Callable | None = None, **extra) -> DataFrame:
    """The frames' keys and the strategy's flag columns, from their pixels.

    ``frames`` has video_id, pts, frame_idx, is_key, and h, w and img (row-major BGR
    bytes) or, with ``image_of``, what fetches an image; see ``each_frame``. Frames
    without pixels are left out. ``extra`` goes to the analysis: a detector for
    ``bcs``, a model for ``lcb-mech``; they must be pure functions.
    """
    return each_frame(frames, ["video_id", "pts", "frame_idx", "is_key"], _run(strategy, params, content, extra), STRATEGIES[strategy][1], image_of)
