"""Scalar functions over numbers and coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounds half towards plus infinity, unlike Spark's round: -2.5 gives -2."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale if digits else F.floor(c + 0.5).cast("double")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def to_local(lat: Column, lng: Column, lat0: float, lng0: float, metres: float = 111320.0) -> Column:
    """Equirectangular metres from an origin: x to the east, z to the south, to 0.1 m."""
    k = metres * math.cos(math.radians(lat0))
    return F.struct(half_up((lng - lng0) * k, 1).alias("x"), half_up((lit(lat0) - lat) * metres, 1).alias("z"))


def to_degrees(x: Column, z: Column, lat0: float, lng0: float, metres: float = 111320.0) -> Column:
    k = metres * math.cos(math.radians(lat0))
    return F.struct((lit(lat0) - z / metres).alias("lat"), (x / k + lng0).alias("lng"))


def lit(v: float) -> Column:
    return F.lit(float(v))


def to_mercator(lat: Column, lng: Column) -> Column:
    """Spherical Web Mercator metres."""
    return F.struct((F.radians(lng) * EARTH_RADIUS).alias("mx"), (F.log(F.tan(lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_RADIUS).alias("my"))


def from_mercator(mx: Column, my: Column) -> Column:
    return F.struct(F.degrees(F.atan(F.exp(my / EARTH_RADIUS)) * 2 - lit(math.pi / 2)).alias("lat"), F.degrees(mx / EARTH_RADIUS).alias("lng"))


def to_pixel(lat: Column, lng: Column, zoom: Column, tile: int = 256) -> Column:
    """Pixel coordinates of the zoom level's world map."""
    world = F.pow(lit(2), zoom) * tile
    s = F.sin(F.radians(lat))
    return F.struct(((lng + 180) / 360 * world).alias("px"), ((lit(0.5) - F.log((s + 1) / (lit(1) - s)) / (4 * math.pi)) * world).alias("py"))


def from_pixel(px: Column, py: Column, zoom: Column, tile: int = 256) -> Column:
    world = F.pow(lit(2), zoom) * tile
    return F.struct(F.degrees(F.atan(F.sinh(lit(math.pi) - py / world * (2 * math.pi)))).alias("lat"), (px / world * 360 - 180).alias("lng"))


def metres_per_pixel(lat: Column, zoom: Column, tile: int = 256) -> Column:
    return F.cos(F.radians(lat)) * (2 * math.pi * EARTH_RADIUS) / (F.pow(lit(2), zoom) * tile)


def two_point_affine(px: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """The line through two control points (pixel, coordinate) at px."""
    return lit(a[1]) + (px - a[0]) * ((b[1] - a[1]) / (b[0] - a[0]))


def to_decimetres(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.transform(p, lambda v: F.floor(v * 10 + 0.5).cast("int")))


def from_decimetres(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.transform(p, lambda v: v / 10))


def letterbox(x: Column, z: Column, bounds: tuple[float, float, float, float], width: float, height: float, pad: float = 0.0) -> Column:
    """World to map: one scale for both axes, centred."""
    x0, z0, x1, z1 = bounds
    scale = min((width - 2 * pad) / (x1 - x0), (height - 2 * pad) / (z1 - z0))
    ox, oz = (width - scale * (x1 - x0)) / 2, (height - scale * (z1 - z0)) / 2
    return F.struct(((x - x0) * scale + ox).alias("mx"), ((z - z0) * scale + oz).alias("my"))


def rotate(u: Column, v: Column, theta: Column, cx: Column, cz: Column) -> Column:
    """Template coordinates into the world: turned by theta, moved to (cx, cz)."""
    return F.struct((cx + u * F.cos(theta) - v * F.sin(theta)).alias("x"), (cz + u * F.sin(theta) + v * F.cos(theta)).alias("z"))


def yaw_of(heading: Column) -> Column:
    """Compass heading (clockwise from north) as yaw (anticlockwise) in [0, 360)."""
    return F.pmod(360 - heading, lit(360))


def log_slider(t: Column, low: float, high: float) -> Column:
    """0..1 onto low..high in equal ratios."""
    return lit(low) * F.pow(lit(high / low), t)


def slider_of(v: Column, low: float, high: float) -> Column:
    return F.log(v / low) / math.log(high / low)


def step_speed(v: Column, direction: Column, factor: float, low: float, high: float) -> Column:
    return clamp(v * F.pow(lit(factor), direction), low, high)


def climb_rate(clearance: Column, gain: float, low: float, high: float) -> Column:
    return clamp(clearance * gain, low, high)


def sine_hash(x: Column, z: Column) -> Column:
    """A deterministic value in [0, 1) for a place. The three constants are fixed values of the common shader hash."""
    s = F.sin(x * 12.9898 + z * 78.233) * 43758.5453
    return s - F.floor(s)
