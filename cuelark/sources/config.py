"""Run configurations: YAML checked against the published ranges, then resolved to a plan."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml

from cuelark.plans.presets import PRESETS
from cuelark.plans.strategies import KEYS, Plan, plan

RATIO = (0.0, 1.0)
#: Numbers with their closed ranges; what is whole is an int.
NUMBERS = {
    "jumpThreshDist": (0.0, None),
    "fillGapMaxGap": (0, None),
    "fillGapMeetPoint": RATIO,
    **dict.fromkeys(("bgMinBrightness", "bgMaxBrightness", "textMinBrightness", "textMaxBrightness"), (0, 255)),
    **dict.fromkeys(("bgMinMeanVal", "bgMaxMeanVal", "textMinMeanVal", "textMaxMeanVal"), (0.0, 255.0)),
    **dict.fromkeys(("textWeightMin", "textWeightMax", "outlineWeightMax", "boundCompensation", "nestingSuppression", "sobelThreshold", "debugLevel", "iirPassDenoiseMinTime", "nonMajorBoxSuppressionMinRank"), (0, None)),
    **dict.fromkeys(("featureThreshold", "featureJumpThreshold", "featureJumpStddevThreshold", "minCcFinalMean", "maxCcStddev", "colourTolerance", "clusterThreshold", "boxVerticalExpansion"), (0.0, None)),
    **dict.fromkeys(("nonMajorBoxSuppressionMaxRatio", "minCcAreaRatio", "maxCcAreaRatio", "minColourAreaRatio", "maxGreyscalePenalty"), RATIO),
}
ENGINES = ("framewise", "speculative")
TOP = {"source", "destination", "contentRect", "enableOpenCL", "strategy", "preset", "engine", "framewise", "speculative", "extraJobs", "ocr", *KEYS}
SPARSE = ("prk", "otl", "bcs")
OCR_ABLE = ("otl", "bcs")
#: Languages of the recognisers may be any text; the rest of the block is fixed.
OCR_KEYS = {"suffix": str, "separator": str, "doPaddle": bool, "paddleLang": str, "doTesseract": bool, "tesseractLang": str}


class ConfigError(ValueError):
    """What is wrong with a configuration, and where."""


@dataclass(frozen=True)
class Run:
    sources: tuple[str, ...]
    destinations: tuple[str, ...]
    strategy: str
    params: dict
    engine: str
    every: int = 1
    empty_gap: int = 0
    content: tuple[float, float, float, float] = (0, 1, 0, 1)
    ocr: dict | None = None
    plan: Plan = field(default=None)


def _number(where: str, value, low, high) -> None:
    whole = isinstance(low, int)
    if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)):
        raise ConfigError(f"{where}: a{' whole' if whole else ''} number is needed")
    if value < low or high is not None and value > high:
        raise ConfigError(f"{where}: {value} is not in {low}..{'' if high is None else high}")


def _rectangle(where: str, value) -> tuple[float, ...]:
    if not isinstance(value, list) or len(value) != 4:
        raise ConfigError(f"{where}: four ratios are needed")
    for x in value:
        _number(where, x, *RATIO)
    if value[0] > value[1] or value[2] > value[3]:
        raise ConfigError(f"{where}: left over right or top over bottom")
    return tuple(value)


def check_params(strategy: str, params: dict) -> None:
    """Raises unless a preset has all parameters of its strategy, each in its range, and no others."""
    known = next(iter(PRESETS[strategy].values()))
    for name in known:
        if name not in params:
            raise ConfigError(f"{strategy}.{name}: missing")
    for name, value in params.items():
        where = f"{strategy}.{name}"
        if name not in known:
            raise ConfigError(f"{where}: unknown")
        if name.endswith("Rect"):
            _rectangle(where, value)
        elif name.endswith("HSVRanges"):
            if not isinstance(value, list) or not value:
                raise ConfigError(f"{where}: a list of ranges is needed")
            for r in value:
                if not isinstance(r, list) or len(r) != 6:
                    raise ConfigError(f"{where}: six numbers are needed")
                for x, top in zip(r, (180, 255, 255) * 2, strict=True):
                    _number(where, x, 0, top)
        elif name == "fastMode":
            if not isinstance(value, bool):
                raise ConfigError(f"{where}: true or false is needed")
        else:
            _number(where, value, *NUMBERS[name])


def parse(text: str) -> Run:
    """A checked run from YAML text; presets that it leaves out are the built-in ones."""
    c = yaml.safe_load(text)
    if not isinstance(c, dict):
        raise ConfigError("a mapping is needed")
    for name in c:
        if name not in TOP:
            raise ConfigError(f"{name}: unknown")
    for name in ("source", "destination", "strategy", "preset", "engine"):
        if name not in c:
            raise ConfigError(f"{name}: missing")
    sources, destinations = ([x] if isinstance(x, str) else x for x in (c["source"], c["destination"]))
    if not isinstance(sources, list) or not isinstance(destinations, list) or len(sources) != len(destinations):
        raise ConfigError("source and destination: as many of one as of the other are needed")
    key, engine = c["strategy"], c["engine"]
    if key not in KEYS:
        raise ConfigError(f"strategy: {key} is none of {', '.join(KEYS)}")
    if engine not in ENGINES:
        raise ConfigError(f"engine: {engine} is none of {', '.join(ENGINES)}")
    if engine == "speculative" and key not in SPARSE:
        raise ConfigError(f"strategy {key} does not run on engine {engine}")
    presets = PRESETS[key] | (c.get(key) or {})
    if c["preset"] not in presets:
        raise ConfigError(f"preset: {key} has no {c['preset']}")
    params = dict(presets[c["preset"]])
    check_params(key, params)
    own = c.get(engine) or {}
    every, gap = own.get("sampleInterval", 1), own.get("emptyGapForceCheck", 0)
    _number("framewise.sampleInterval", every, 1, None)
    _number("speculative.emptyGapForceCheck", gap, 0, None)
    jobs = c.get("extraJobs") or []
    ocr = None
    if "ocr" in jobs:
        if key not in OCR_ABLE:
            raise ConfigError(f"strategy {key} has no text masks for ocr")
        ocr = c.get("ocr") or {}
        for name, kind in OCR_KEYS.items():
            if not isinstance(ocr.get(name), kind):
                raise ConfigError(f"ocr.{name}: missing or of the wrong kind")
    content = _rectangle("contentRect", c["contentRect"]) if "contentRect" in c else (0, 1, 0, 1)
    return Run(tuple(sources), tuple(destinations), key, params, engine, every, gap, content, ocr, plan(key, params))


def load(path: str) -> Run:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())
