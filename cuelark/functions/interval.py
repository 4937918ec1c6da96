"""Scalar functions on intervals [begin, end] in ticks, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelark.functions.timebase import MICROS, TimeBase, format_timestamp


def gap(begin_a: Column, end_a: Column, begin_b: Column, end_b: Column) -> Column:
    """Ticks from the end of the one that begins first to the begin of the other; below 0 they overlap."""
    return F.when(begin_a > begin_b, begin_a - end_b).otherwise(begin_b - end_a)


def gap_to_point(begin: Column, end: Column, point: Column) -> Column:
    """0 inside the closed interval, else the distance to its nearer end."""
    return F.greatest(begin - point, point - end, F.lit(0))


def intersects(*ends: Column) -> Column:
    return gap(*ends) < 0


def touches(*ends: Column) -> Column:
    return gap(*ends) == 0


def name(flag: Column, number: Column) -> Column:
    return F.format_string("Subtitle_%s_%d", flag, number)


def dialogue(begin: Column, end: Column, style: Column, label: Column, base: TimeBase = MICROS) -> Column:
    """A subtitle event line."""
    return F.format_string("Dialogue: 0,%s,%s,%s,,0,0,0,,%s", format_timestamp(begin, base), format_timestamp(end, base), style, label)
