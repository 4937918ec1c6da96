"""Parameters of the strategies by preset. Fixed values."""

_QUEST = {
    "dialogOutlineRect": [0.25, 0.75, 0.60, 0.95],
    "dialogBgRect": [0.3125, 0.6797, 0.7264, 0.8784],
    "blackscreenRect": [0.15, 0.85, 0.00, 1.00],
    "whitescreenRect": [0.15, 0.65, 0.00, 1.00],
    "cgSubAboveRect": [0.0, 1.0, 0.60, 0.65],
    "cgSubBorderRect": [0.0, 1.0, 0.65, 0.70],
    "cgSubBelowRect": [0.0, 1.0, 0.70, 0.75],
    "cgSubTextRect": [0.3, 0.7, 0.70, 1.00],
}
_HOME = {
    "homeDialogRect": [0.25, 0.75, 0.74, 0.94],
    "underHomeDialogRect": [0.25, 0.75, 0.94, 1.00],
    "dialogRect": [0.25, 0.75, 0.80, 1.00],
    "whitescreenRect": [0.17, 0.83, 0.30, 0.70],
    "blackscreenRect": [0.17, 0.83, 0.30, 0.70],
    "leftBubbleRect": [0.12, 0.45, 0.15, 0.25],
    "rightBubbleRect": [0.55, 0.88, 0.15, 0.25],
}
_BAND = {
    "dialogRect": [0.06, 0.94, 0.82, 0.96],
    "jumpThreshDist": 2.0,
    "fillGapMaxGap": 500,
    "fillGapMeetPoint": 0.5,
    "bgMinBrightness": 200,
    "bgMaxBrightness": 255,
    "bgMinMeanVal": 200.0,
    "bgMaxMeanVal": 255.0,
    "textMinBrightness": 0,
    "textMaxBrightness": 128,
    "textMinMeanVal": 0.5,
    "textMaxMeanVal": 32.0,
}
_OUTLINE = {
    "dialogRect": [0.00, 1.00, 0.75, 1.00],
    "fastMode": False,
    "textWeightMin": 3,
    "textWeightMax": 25,
    "textHSVRanges": [[0, 0, 240, 180, 16, 255]],
    "outlineWeightMax": 15,
    "outlineHSVRanges": [[0, 0, 0, 180, 255, 16]],
    "boundCompensation": 4,
    "sobelThreshold": 250,
    "nestingSuppression": 0,
    "featureThreshold": 1.0,
    "featureJumpThreshold": 0.1,
    "featureJumpStddevThreshold": 0.005,
    "debugLevel": 0,
}

PRESETS: dict[str, dict[str, dict]] = {
    "mr": {
        "default": _QUEST,
        "narrow": _QUEST
        | {
            "dialogOutlineRect": [0.21, 0.79, 0.60, 0.97],
            "dialogBgRect": [0.27, 0.73, 0.75, 0.90],
            "cgSubAboveRect": [0.0, 1.0, 0.67, 0.72],
            "cgSubBorderRect": [0.0, 1.0, 0.72, 0.77],
            "cgSubBelowRect": [0.0, 1.0, 0.77, 0.82],
            "cgSubTextRect": [0.3, 0.7, 0.77, 1.00],
        },
        "myownpreset": _QUEST,
    },
    "mr-s0": {
        "default": {"dialogRect": [0.35, 0.65, 0.74, 0.93], "blackscreenRect": [0.15, 0.85, 0.00, 1.00]},
        "narrow": {"dialogRect": [0.32, 0.68, 0.76, 0.96], "blackscreenRect": [0.15, 0.85, 0.00, 1.00]},
    },
    "md": {"default": _HOME, "narrow": _HOME | {"whitescreenRect": [0.09, 0.91, 0.30, 0.70]}},
    "lcb": {"default": {"dialogRect": [0.18, 0.82, 0.79, 0.97]}},
    "lcb-mech": {"default": {"dialogRect": [0.30, 0.70, 0.875, 0.915]}},
    "pkm": {"default": {"dialogBgRect": [0.05, 0.95, 0.75, 0.95]}},
    "prk": {"default": {"dialogRect": [0.00, 1.00, 0.86, 1.00]}, "vertical": {"dialogRect": [0.00, 1.00, 0.57, 0.69]}},
    "bdr": {"default": _BAND, "bunaru": _BAND | {"dialogRect": [0.04, 0.96, 0.82, 0.96], "bgMinBrightness": 170}},
    "otl": {
        "yukkurirailways": _OUTLINE,
        "yukkurilocaltrain": _OUTLINE
        | {
            "textWeightMin": 5,
            "textHSVRanges": [[0, 200, 128, 30, 255, 255], [170, 200, 128, 180, 255, 255], [105, 100, 128, 135, 255, 255]],
            "outlineWeightMax": 5,
            "outlineHSVRanges": [[0, 0, 180, 180, 64, 255]],
            "sobelThreshold": 192,
            "nestingSuppression": 9,
        },
        "japantrafficlab": _OUTLINE | {"textWeightMin": 1, "textWeightMax": 19, "textHSVRanges": [[70, 180, 180, 100, 255, 255]], "outlineHSVRanges": [[95, 180, 180, 140, 255, 255]], "sobelThreshold": 100},
        "yorumeron-yukari": _OUTLINE
        | {
            "dialogRect": [0.00, 1.00, 0.80, 1.00],
            "textWeightMin": 1,
            "textWeightMax": 15,
            "textHSVRanges": [[135, 0, 220, 155, 60, 255]],
            "outlineWeightMax": 9,
            "outlineHSVRanges": [[0, 0, 0, 180, 255, 25]],
            "boundCompensation": 2,
            "sobelThreshold": 192,
        },
        "hotelzdm": _OUTLINE
        | {
            "textWeightMin": 5,
            "textHSVRanges": [[0, 200, 100, 10, 255, 180], [170, 200, 100, 180, 255, 180], [25, 100, 100, 55, 200, 200]],
            "outlineWeightMax": 7,
            "outlineHSVRanges": [[0, 0, 200, 180, 32, 255]],
            "boundCompensation": 2,
            "sobelThreshold": 200,
            "nestingSuppression": 5,
        },
        "zundahouse": _OUTLINE
        | {"textWeightMin": 1, "textHSVRanges": [[155, 100, 200, 180, 200, 255], [55, 150, 150, 75, 220, 220]], "outlineHSVRanges": [[0, 0, 240, 180, 64, 255]], "sobelThreshold": 230, "nestingSuppression": 23},
    },
    "bcs": {
        "default": {
            "dialogRect": [0.00, 1.00, 0.75, 1.00],
            "sobelThreshold": 32,
            "featureThreshold": 0.3,
            "featureJumpThreshold": 0.1,
            "boxVerticalExpansion": 0.05,
            "nonMajorBoxSuppressionMaxRatio": 0.2,
            "nonMajorBoxSuppressionMinRank": 1,
            "minCcAreaRatio": 0.0,
            "maxCcAreaRatio": 0.3,
            "minCcFinalMean": 3.0,
            "maxCcStddev": 10,
            "colourTolerance": 30,
            "clusterThreshold": 1,
            "minColourAreaRatio": 0.01,
            "maxGreyscalePenalty": 0.70,
            "iirPassDenoiseMinTime": 300,
            "debugLevel": 0,
        }
    },
}
