"""Scalar expressions: hashes, growth curves, orbits, a calendar of one's own."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def scaled_stat(base: Column, level: Column, growth: float = 0.5, power: float = 0.6) -> Column:
    """A value that grows with level as base (1 + growth (level - 1) ^ power), rounded half up."""
    return half_up(F.when(level <= 1, base * 1.0).otherwise(base * (1 + growth * F.pow((level - 1).cast("double"), F.lit(power)))))


def noisy_or(a: Column, b: Column) -> Column:
    return a + b - a * b


def code_units(text) -> Column:
    """UTF-16 code units of a text, as numbers."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("bigint"))


def djb2(text: str) -> Column:
    """The 32-bit hash 33 h + c from 5381, as lower-case hexadecimal."""
    h = F.aggregate(code_units(text), F.lit(5381).cast("bigint"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.hex(h))


def hash31(text: str) -> Column:
    """The signed 32-bit hash 31 h + c from 0."""
    h = F.aggregate(code_units(text), F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")


# Gravity, the sun's mass, the astronomical unit.
GRAVITY, SUN, UNIT = 6.67430e-11, 1.989e30, 1.496e11


def year_length(mass: Column, distance: Column) -> Column:
    """Days of 24 hours that a planet at a distance (astronomical units) takes around a star (solar masses)."""
    radius = distance * UNIT
    return 2 * math.pi * F.sqrt(F.pow(radius, F.lit(3.0)) / (GRAVITY * SUN * mass)) / 86400


def habitable_zone(mass: Column) -> Column:
    best = F.sqrt(F.pow(mass, F.lit(3.5)))
    return F.struct((best * 0.95).alias("least"), best.alias("best"), (best * 1.37).alias("most"))


def week_length(days: Column) -> Column:
    return F.when(days < 100, 5).when(days < 400, 7).when(days < 600, 8).otherwise(10)


def orbital_calendar(mass: Column, distance: Column, hours: Column) -> Column:
    """struct(days, fraction, week, months) of a planet whose day has so many hours."""
    days = year_length(mass, distance) * 24 / hours
    whole = F.floor(days)
    return F.struct(whole.alias("days"), (days - whole).alias("fraction"), week_length(whole).alias("week"), F.when(whole <= 100, 10).otherwise(12).alias("months"))


def days_in_month(days: int, year: Column, leap: tuple[int, int, int | None] | None = None) -> Column:
    """leap: (every so many years, days more, unless divisible by)."""
    if leap is None:
        return F.lit(days)
    every, more, unless = leap
    hit = year % every == 0
    if unless:
        hit &= year % unless != 0
    return F.when(hit, days + more).otherwise(days)


class Calendar:
    """months: (days, leap rule or None); weekdays: how many; eras: (first year, last or None, short name)."""

    def __init__(self, months: list[tuple[int, tuple | None]], weekdays: int, eras: list[tuple[int, int | None, str]], year_zero: bool = False):
        self.months, self.weekdays, self.eras, self.year_zero = months, weekdays, eras, year_zero

    def days_in_year(self, year: Column) -> Column:
        return sum((days_in_month(d, year, leap) for d, leap in self.months), F.lit(0))

    def day_of_year(self, year: Column, month: Column, day: Column) -> Column:
        """Days before this one in its year; all three count from zero but the year."""
        before = sum((F.when(month > i, days_in_month(d, year, leap)).otherwise(0) for i, (d, leap) in enumerate(self.months)), F.lit(0))
        return before + day

    def weekday(self, year: Column, month: Column, day: Column) -> Column:
        """Every year begins on the first weekday."""
        return self.day_of_year(year, month, day) % self.weekdays

    def moon_phase(self, month: Column, day: Column, cycle: float, offset: float = 0.0) -> Column:
        """0 to 1; leap days don't count."""
        before = sum((F.when(month > i, d).otherwise(0) for i, (d, _) in enumerate(self.months)), F.lit(0))
        return F.pmod((before + day) / cycle + offset, F.lit(1.0))

    def era(self, year: Column) -> Column:
        out = F.lit(None).cast("string")
        for first, last, name in reversed(self.eras):
            out = F.when((year >= first) & (F.lit(True) if last is None else year <= last), name).otherwise(out)
        return out

    def formatted(self, year: Column) -> Column:
        era = self.era(year)
        return F.when(era.isNull(), year.cast("string")).otherwise(F.concat_ws(" ", F.abs(year).cast("string"), era))

    def turned(self, year: Column, by: int) -> Column:
        """The next (1) or the previous (-1) year; without a year zero it is passed over."""
        new = year + by
        return new if self.year_zero else F.when(new == 0, by).otherwise(new)
