"""Domain rules as expressions; every threshold is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.numeric import clamp, lit, sine_hash


def ladder(value: Column, rungs: list[tuple[float, float]], top: float) -> Column:
    """The height of the first rung whose upper bound exceeds the value."""
    out = lit(top)
    for bound, height in reversed(rungs):
        out = F.when(value < bound, lit(height)).otherwise(out)
    return out


def height_by_precedence(tag: Column, levels: Column, area: Column, rungs: list[tuple[float, float]], top: float, per_level: float, base: float, most: float = 90.0, most_levels: float = 40.0) -> Column:
    """struct(h, src): a sane tag, else storeys, else the area ladder; src says which."""
    by = lambda h, src: F.struct(h.cast("double").alias("h"), F.lit(src).alias("src"))
    return (
        F.when((tag > 0) & (tag <= most), by(tag, "height"))
        .when((levels > 0) & (levels <= most_levels), by(levels * per_level + base, "levels"))
        .otherwise(by(ladder(area, rungs, top), "area"))
    )


def reconcile(a: Column, b: Column, metres: float = 8.0, share: float = 0.45) -> Column:
    """Of two heights: b where they agree, else the taller; the other where one is null."""
    agree = F.abs(a - b) <= F.greatest(lit(metres), F.least(a, b) * share)
    return F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).when(agree, b).otherwise(F.greatest(a, b))


def tree_species(x: Column, z: Column, height: Column, crown: Column, tall: float = 18.0, slim: float = 0.25) -> Column:
    """By shape where it tells, else by a hash of the place."""
    return F.when((height > tall) & (crown < height * slim), "palm").when(height > tall, "eucalyptus").when(sine_hash(x, z) < 0.5, "oak").otherwise("pine")


def crown_shape(height: Column, crown: Column) -> Column:
    """Ellipsoid of a crown: radius and half height, kept in proportion."""
    r = clamp(crown, 0.8, 9.0)
    return F.struct(r.alias("r"), F.least(F.greatest(height * 0.35, r * 0.6), height * 0.48).alias("half"))


def in_box(x: Column, z: Column, x0: float, z0: float, x1: float, z1: float) -> Column:
    return x.between(x0, x1) & z.between(z0, z1)


def near_any(x: Column, z: Column, anchors: list[tuple[float, float]], radius: float) -> Column:
    out = F.lit(False)
    for ax, az in anchors:
        out = out | ((x - ax) * (x - ax) + (z - az) * (z - az) <= radius * radius)
    return out


def admissible(h: Column, n: Column, rim: Column, spread: Column, withheld: Column, least_h: float = 3.0, least_n: int = 400, least_rim: float = 0.99, most_spread: float = 1.2) -> Column:
    """Statistical admission; what is withheld by hand never passes."""
    return F.coalesce((h >= least_h) & (n >= least_n) & (rim >= least_rim) & (spread <= most_spread), F.lit(False)) & ~withheld


def roof_rule(p50: Column, p75: Column, p98: Column, density: Column, base: Column, crown: float = 5.0, flat: float = 2.0, dense: float = 0.85) -> Column:
    """struct(h, rule) from a roof's height percentiles.

    canopy: the top stands far above the body, so it isn't roof. shelf: with a known base, a dense
    flat body under a small top. Else the top itself.
    """
    by = lambda h, rule: F.struct(h.alias("h"), F.lit(rule).alias("rule"))
    return (
        F.when(p98 - p75 > crown, by(p75, "canopy"))
        .when(base.isNotNull() & (p75 - p50 <= flat) & (p98 - p75 > flat) & (density >= dense), by(p75, "shelf"))
        .otherwise(by(p98, "top"))
    )


def slab_rule(p50: Column, p75: Column, p98: Column, crown: float = 5.0, flat: float = 2.0) -> Column:
    """A stepped slab (a far top over an uneven body) has no one height."""
    return F.when((p98 - p75 > crown) & (p75 - p50 > flat), F.lit(None)).when(p98 - p75 > crown, p75).otherwise(p98)
