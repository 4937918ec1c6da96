"""Time in integer ticks of a rational time base, as Column builders.

A time base num/den means that a tick lasts num/den seconds. All arithmetic is on
64-bit integers; nothing is rounded but where a result is text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b) -> Column:
    """Integer quotient, truncated toward zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


@dataclass(frozen=True)
class TimeBase:
    """num/den seconds a tick, fps_num/fps_den frames a second."""

    num: int = 1
    den: int = 1_000_000
    fps_num: int = 25
    fps_den: int = 1

    def ticks(self, ms: int) -> int:
        """Milliseconds as ticks, truncated."""
        return ms * self.den // (self.num * 1000) if ms >= 0 else -(-ms * self.den // (self.num * 1000))

    @property
    def unit(self) -> int:
        """Ticks of about one frame."""
        return self.den * self.fps_den // (self.num * self.fps_num)


#: The time base of tables whose timestamps are microseconds.
MICROS = TimeBase()


def ms_to_ticks(ms: Column, base: TimeBase = MICROS) -> Column:
    return div(ms * base.den, base.num * 1000)


def midpoint(begin: Column, end: Column) -> Column:
    return div(begin + end, 2)


def format_timestamp(ticks: Column, base: TimeBase = MICROS) -> Column:
    """HH:MM:SS.cc of a tick count: microseconds half-even, centiseconds cut off, hours modulo 24."""
    if (base.num * 1_000_000) % base.den == 0:
        micros = ticks * (base.num * 1_000_000 // base.den)
    else:
        micros = F.rint(ticks * F.lit(float(base.num)) * 1e6 / F.lit(float(base.den))).cast("long")
    centis = div(micros, 10_000)
    part = lambda unit, most: div(centis, unit) % most
    return F.format_string("%02d:%02d:%02d.%02d", part(360_000, 24), part(6_000, 60), part(100, 60), centis % 100)
