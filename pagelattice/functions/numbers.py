"""Colours, font sizes, units and page shapes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BORDER_COLOR = "B7B7B7"


def rgb(packed: Column) -> Column:
    """Red, green and blue of a packed 24-bit number."""
    part = lambda by: F.shiftright(packed.cast("int"), by).bitwiseAND(F.lit(255))
    return F.struct(part(16).alias("red"), part(8).alias("green"), part(0).alias("blue"))


def hex_of_rgb(c: Column) -> Column:
    return F.format_string("#%02X%02X%02X", c["red"], c["green"], c["blue"])


def hex_of_unit(red: Column, green: Column, blue: Column) -> Column:
    """#RRGGBB of parts from 0 to 1, clamped and rounded half to even; null if a part is."""
    part = lambda c: F.rint(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return F.when(red.isNotNull() & green.isNotNull() & blue.isNotNull(), F.format_string("#%02X%02X%02X", part(red), part(green), part(blue)))


def is_nearly_white(red: Column, green: Column, blue: Column) -> Column:
    return (red >= 0.95) & (green >= 0.95) & (blue >= 0.95)


def border_color(c: Column) -> Column:
    """Six hexadecimal digits in capitals, or the default border colour."""
    v = F.upper(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "^#", ""))
    return F.when(v.rlike("^[0-9A-F]{6}$"), v).otherwise(BORDER_COLOR)


def half_points(size: Column) -> Column:
    return F.greatest(F.floor(F.greatest(size, F.lit(0.5)) * 2 + 0.5), F.lit(1)).cast("int")


def word_font_size(size: Column) -> Column:
    return F.floor(F.greatest(size, F.lit(0.5)) * 2 + 0.5).cast("double") / F.lit(2.0)


def twips(points: Column) -> Column:
    return F.greatest(F.rint(points * 20).cast("int"), F.lit(0))


def orientation(width: Column, height: Column) -> Column:
    largest = F.greatest(width, height, F.lit(1.0))
    return F.when(F.abs(width - height) / largest <= 0.03, "square").when(width > height, "landscape").otherwise("portrait")


def dimension_matches(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1.0), F.greatest(F.abs(a), F.abs(b)) * F.lit(0.002))


def is_bold(flags: Column, font: Column | None = None) -> Column:
    by_flag = flags.bitwiseAND(F.lit(16)) != 0
    return by_flag if font is None else by_flag | F.lower(font).contains("bold")


def is_italic(flags: Column, font: Column) -> Column:
    return (flags.bitwiseAND(F.lit(2)) != 0) | F.lower(font).rlike("italic|oblique")
