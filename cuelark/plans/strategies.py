"""Named plans: how a kind of video's frame flags become labelled intervals.

A plan is data: frame operators in order, the flags that intervals are built of,
and interval operators in order, each with its parameters. ``framewise`` turns it
into one lazy DataFrame plan; ``speculative`` grows intervals from sparse looks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelark.functions import vector
from cuelark.functions.timebase import MICROS, TimeBase
from cuelark.operators import frames as fr
from cuelark.operators import intervals as it
from cuelark.operators.speculative import by_features, grown

Step = tuple  # (operator, parameters)


@dataclass(frozen=True)
class Plan:
    key: str
    frame_steps: tuple[Step, ...]
    flags: tuple[str, ...]
    interval_steps: tuple[Step, ...]
    feature: str | None = None
    size: int = 0
    keep: dict[str, Column] = field(default_factory=dict)
    #: Of plans that can grow intervals from sparse looks: the distance that merges, and the steps after.
    merge_below: float | None = None
    sparse_steps: tuple[Step, ...] = ()
    styles: tuple[str, ...] = ()
    ocr: bool = False


def _noise(flag: str, false: int | None, true: int | None) -> list[Step]:
    return [(fr.remove_noise, {"flag": flag, "value": v, "min_length": n}) for v, n in ((False, false), (True, true)) if n]


def _gap(flag: str, most: int, meet: float = 0.5) -> Step:
    return it.fill_gap, {"flag": flag, "max_gap": most, "meet": meet}


def _wider(flag: str, front: int, back: int) -> Step:
    return it.extend, {"flag": flag, "front": front, "back": back}


def _break(flag: str, *jumps: str) -> Step:
    return partial(_break_on, jumps=jumps), {"flag": flag}


def _break_on(df: DataFrame, flag: str, jumps: tuple[str, ...]) -> DataFrame:
    return fr.break_on(df, flag, *jumps)


def _jump(feature: str, dst: str, **how) -> Step:
    return fr.feature_jump, {"feature": feature, "dst": dst, **how}


#: Speakers by the colour of their text, as (saturation * cos hue, saturation * sin hue), and their styles. Fixed values.
SPEAKERS = {
    "Shiro": (0.00, 0.00),
    "Mabayu": (0.13, 0.55),
    "Homura": (-0.05, -0.17),
    "Madoka": (0.27, -0.17),
    "Sayaka": (-0.25, -0.05),
    "Kyoko": (0.40, -0.02),
    "Mami": (0.20, 0.20),
}
STYLE_COLOURS = {
    "Shiro": "00FFFFFF",
    "Shiranai": "00000000",
    "Mabayu": "0038FCCC",
    "Homura": "00FEC5C4",
    "Madoka": "00C699F6",
    "Sayaka": "00F3DD96",
    "Kyoko": "00738EFC",
    "Mami": "0083E1FE",
    "Nagisa": "00DCAFE3",
}
SPEAKER_STYLES = tuple(f"Style: {name},Microsoft YaHei,40,&H{colour},&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,2,2,10,10,100,1" for name, colour in STYLE_COLOURS.items())
FARTHEST_SPEAKER, UNKNOWN_SPEAKER = 0.20, "Shiranai"


def classify_speaker(intervals: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    """Names the style of intervals after the speaker whose colour is nearest to their mean text colour."""
    mean = lambda i: F.element_at("colour_sum", i) / F.col("n_points")
    x, y = it.hue_saturation_point(F.col("_blue"), F.col("_green"), F.col("_red"))
    rows = intervals.withColumns({"_blue": mean(1), "_green": mean(2), "_red": mean(3)}).withColumns({"_x": x, "_y": y})
    near = it.nearest_centroid(F.col("_x"), F.col("_y"), SPEAKERS, FARTHEST_SPEAKER, UNKNOWN_SPEAKER)
    return it.restyled(rows, F.when(F.col("main_flag").isin(*flags), near).otherwise(F.col("style"))).drop("_blue", "_green", "_red", "_x", "_y")


def _md_steps() -> tuple[Step, ...]:
    wide = ((("HomeDialog", "Dialog"), 300, 0.0, 300, 0), (("Whitescreen", "Blackscreen"), 2000, 0.5, 400, 400), (("LeftBubble", "RightBubble"), 300, 0.0, 200, 0))
    return tuple(step for flags, most, meet, front, back in wide for f in flags for step in (_gap(f, most, meet), _wider(f, front, back)))


def _vector_jump(feature: str, dst: str, size: int, **how) -> Step:
    return fr.vector_jump, {"feature": feature, "dst": dst, "size": size, **how}


def _denoise(flag: str, least: int) -> Step:
    return it.denoise, {"flag": flag, "min_time": least}


def _merge(below: float) -> Step:
    return it.merge, {"alike": it.alike_features(below)}


def plan(key: str, params: dict | None = None, size: int = 64) -> Plan:
    """The plan of a strategy with the parameters of a preset; ``size`` is that of vector features."""
    p = params or {}
    if key == "mr":
        flags = ("Dialog", "Blackscreen", "Whitescreen", "CgSub")
        steps = [s for f, n in zip(flags, (2, 3, 3, 2), strict=True) for s in _noise(f, n, 10)]
        return Plan(key, tuple(steps), flags, tuple(_gap(f, n) for f, n in zip(flags, (300, 1200, 1200, 1200), strict=True)))
    if key == "mr-s0":
        steps = [
            *_noise("Blackscreen", 3, 10),
            _jump("DialogContentVal", "DialogContentValJumpDown", distance=vector.falling, least=2.0),
            _jump("DialogContentVal", "DialogContentValJumpUp", distance=vector.rising, least=2.0, window=5),
            _jump("DialogContentValJumpUp", "DialogContentValJumpUpJumpUp", distance=vector.rising, least=0.5),
            _jump("DialogNameVal", "DialogNameValJump", least=1.0),
            _break("Dialog", "DialogContentValJumpDown", "DialogContentValJumpUpJumpUp", "DialogNameValJump"),
            *_noise("Dialog", 2, 10),
            _jump("BalloonVal", "BalloonValJump", distance=vector.falling, least=3.0),
            _break("Balloon", "BalloonValJump"),
            *_noise("Balloon", 2, 10),
        ]
        colour = F.array(*[F.sum(F.element_at("MeanTextColour", i).cast("double")) for i in (1, 2, 3)])
        after = (_gap("Blackscreen", 1200), _gap("Dialog", 500, 1.0), _gap("Balloon", 500, 1.0), (classify_speaker, {"flags": ("Dialog", "Balloon")}))
        return Plan(key, tuple(steps), ("Blackscreen", "Dialog", "Balloon"), after, keep={"colour_sum": colour}, styles=SPEAKER_STYLES)
    if key == "md":
        steps = (*_noise("HomeDialog", None, 10), *_noise("Dialog", None, 10), (fr.prioritise, {"flag": "Dialog", "over": "HomeDialog"}))
        return Plan(key, steps, ("HomeDialog", "Dialog", "Whitescreen", "Blackscreen", "LeftBubble", "RightBubble"), _md_steps())
    if key == "lcb":
        return Plan(key, tuple(_noise("Dialog", None, 10)), ("Dialog",), (_gap("Dialog", 1000, 0.0),))
    if key == "lcb-mech":
        alike = _vector_jump("DialogTextFeat", "DialogTextCont", min(size, 4), distance=vector.half_cosine, least=0.01, window=3, inverse=True, default=1.0)
        every = (partial(_conjunction, flags=("DialogTextCont", "DialogTextMin", "DialogBgColour")), {"dst": "Dialog"})
        return Plan(key, (alike, every), ("Dialog",), (_gap("Dialog", 500, 1.0),))
    if key == "pkm":
        return Plan(key, tuple(_noise("Dialog", 1, 10)), ("Dialog",), (_gap("Dialog", 300),))
    if key == "prk":
        steps = (_vector_jump("DialogFeat", "DialogFeatJump", size, least=0.1, window=5, most_spread=0.005), _break("Dialog", "DialogFeatJump"))
        after = (_gap("Dialog", 300, 1.0),)
        return Plan(key, steps, ("Dialog",), after, "DialogFeat", size, merge_below=0.1, sparse_steps=after)
    if key == "bdr":
        steps = (_jump("DialogTextVal", "DialogTextJump", least=p.get("jumpThreshDist", 2.0)), _break("Dialog", "DialogTextJump"))
        return Plan(key, steps, ("Dialog",), (_gap("Dialog", p.get("fillGapMaxGap", 500), p.get("fillGapMeetPoint", 0.5)),))
    if key in ("otl", "bcs"):
        own = key == "otl"
        below, least = p.get("featureJumpThreshold", 0.1), p.get("iirPassDenoiseMinTime", 300)
        # Framewise, bcs has a fixed threshold; the parameter is for merging. It fills gaps of the length that it takes as noise.
        jump = _vector_jump("DialogFeat", "DialogFeatJump", size, least=below if own else 0.1, window=5, most_spread=p.get("featureJumpStddevThreshold", 0.005) if own else 0.005)
        after = (_gap("Dialog", 300, 1.0), _denoise("Dialog", 100)) if own else (_gap("Dialog", least, 1.0), _denoise("Dialog", least))
        sparse = (_merge(below), _denoise("Dialog", 300 if own else least), _merge(below))
        return Plan(key, (jump, _break("Dialog", "DialogFeatJump")), ("Dialog",), after, "DialogFeat", size, merge_below=below, sparse_steps=sparse, ocr=True)
    raise ValueError(f"no such strategy: {key}")


KEYS = ("mr", "mr-s0", "md", "lcb", "lcb-mech", "pkm", "prk", "bdr", "otl", "bcs")


def _conjunction(df: DataFrame, dst: str, flags: tuple[str, ...]) -> DataFrame:
    return fr.conjunction(df, dst, *flags)


def _through(df: DataFrame, steps: tuple[Step, ...], base: TimeBase) -> DataFrame:
    timed = {it.fill_gap, it.extend, it.denoise, it.align}
    for operator, params in steps:
        df = operator(df, **params, **({"base": base} if operator in timed else {}))
    return df


def framewise(flags: DataFrame, plan: Plan, base: TimeBase = MICROS, every: int = 1) -> DataFrame:
    """Intervals of a plan from its frame flags, one frame in ``every``."""
    seen = fr.every_nth(flags, every) if every > 1 else flags
    built = fr.build_intervals(_through(seen, plan.frame_steps, base), list(plan.flags), plan.feature, plan.size, plan.keep)
    return _through(it.resort(built), plan.interval_steps, base)


def speculative(flags: DataFrame, plan: Plan, empty_gap: int = 1000, base: TimeBase = MICROS) -> DataFrame:
    """Intervals of a plan grown from sparse looks at its frame flags; the plan must allow it."""
    return sparse_plan(by_features(flags, plan.flags[0], plan.feature, sparse_threshold(plan), empty_gap, base), plan, base)


def sparse_threshold(plan: Plan) -> float:
    """The distance below which two looks of a plan are alike."""
    if plan.merge_below is None:
        raise ValueError(f"{plan.key} cannot grow intervals from sparse looks")
    return plan.merge_below


def sparse_plan(looks: DataFrame, plan: Plan, base: TimeBase = MICROS) -> DataFrame:
    """The steps of a plan after its intervals are grown."""
    return _through(it.resort(grown(looks)), plan.sparse_steps, base)
