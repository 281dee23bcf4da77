"""Colour expressions; channels are 0..255 unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.numeric import clamp, lit


def srgb_to_linear(v: Column) -> Column:
    c = v / 255
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.floor(clamp(F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, lit(1 / 2.4)) * 1.055 - 0.055), 0.0, 1.0) * 255 + 0.5).cast("int")


def rgb_to_hsl(r: Column, g: Column, b: Column) -> Column:
    """h in [0, 1), s and l in [0, 1]."""
    r, g, b = (c / 255 for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2
    hue = F.when(d == 0, lit(0)).when(top == r, F.pmod((g - b) / d, lit(6))).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    sat = F.when(d == 0, lit(0)).otherwise(d / (lit(1) - F.abs(light * 2 - 1)))
    return F.struct(hue.alias("h"), sat.alias("s"), light.alias("l"))


def hsl_to_rgb(h: Column, s: Column, light: Column) -> Column:
    def channel(n: int) -> Column:
        k = F.pmod(h * 12 + n, lit(12))
        v = light - s * F.least(light, lit(1) - light) * F.greatest(F.least(k - 3, lit(9) - k, lit(1)), lit(-1))
        return F.floor(clamp(v, 0.0, 1.0) * 255 + 0.5).cast("int")

    return F.struct(channel(0).alias("r"), channel(8).alias("g"), channel(4).alias("b"))


def clamp_gamut(r: Column, g: Column, b: Column, most_s: float = 0.55, low: float = 0.2, high: float = 0.85) -> Column:
    """Pulls garish, very dark and very light colours in."""
    hsl = rgb_to_hsl(r, g, b)
    return hsl_to_rgb(hsl["h"], F.least(hsl["s"], lit(most_s)), clamp(hsl["l"], low, high))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")) for c in (r, g, b)])


def luma709(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def luma601(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def whiteness(r: Column, g: Column, b: Column, around: Column) -> Column:
    """How far a pixel is lighter than its surroundings, less so the more colour it has."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    sat = F.when(top > 0, (top - low) / top).otherwise(lit(0))
    return F.greatest(luma601(r, g, b) - around, lit(0)) * (lit(1) - sat)


def is_vegetation(r: Column, g: Column, b: Column, excess: float = 20.0, dark: float = 90.0) -> Column:
    """Excess green, or dark with green leading."""
    return (g * 2 - r - b > excess) | ((luma601(r, g, b) < dark) & (g > r) & (g > b))


def in_hsl_box(hsl: Column, h: tuple[float, float], s: tuple[float, float], light: tuple[float, float]) -> Column:
    return hsl["h"].between(*h) & hsl["s"].between(*s) & hsl["l"].between(*light)
