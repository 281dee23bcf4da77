"""Scalar functions over names and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.geometry import vertex_mean


def normalise_name(name: Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower case, & as and, anything but letters and digits as one space, trimmed; without stop words."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "&", " and "), "[^a-z0-9]+", " "))
    return F.array_join(F.filter(F.split(out, " "), lambda t: ~t.isin(*stop)), " ") if stop else out


def tokens(name: Column, expand: dict[str, str] | None = None) -> Column:
    """The words of a normalised name, abbreviations expanded."""
    words = F.filter(F.split(normalise_name(name), " "), lambda t: t != "")
    if not expand:
        return words
    table = F.create_map(*[F.lit(x) for kv in expand.items() for x in kv])
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(table, t), t))


def names_match(a: Column, b: Column, expand: dict[str, str] | None = None) -> Column:
    """Equal but for case, or of equal tokens; false if either is null."""
    return F.coalesce((F.lower(a) == F.lower(b)) | (tokens(a, expand) == tokens(b, expand)), F.lit(False))


def match_parts(name: Column, side: str, expand: dict[str, str] | None = None) -> list[Column]:
    """What names_match compares, as columns of one row, for joins that compare a name with many."""
    return [F.lower(name).alias(f"{side}_lower"), tokens(name, expand).alias(f"{side}_words")]


def parts_match(a: str, b: str) -> Column:
    """names_match of two rows that have match_parts."""
    return F.coalesce((F.col(f"{a}_lower") == F.col(f"{b}_lower")) | (F.col(f"{a}_words") == F.col(f"{b}_words")), F.lit(False))


def name_similarity(a: Column, b: Column, stop: tuple[str, ...] = ()) -> Column:
    """Shared tokens over the shorter token list; by containment where a side has no tokens left."""
    ta, tb = (F.array_distinct(F.filter(F.split(normalise_name(c, stop), " "), lambda t: t != "")) for c in (a, b))
    least = F.least(F.size(ta), F.size(tb))
    contained = F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a))
    return F.when(least > 0, F.size(F.array_intersect(ta, tb)) / least).otherwise(F.when(contained, F.lit(1.0)).otherwise(F.lit(0.0)))


def fix_name(name: Column, renames: dict[str, str], in_box: Column, prefix: str) -> Column:
    """Renames first; a name of digits only gets a prefix inside the box."""
    table = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), F.when(name.rlike(r"^\d+$") & in_box, F.concat(F.lit(prefix), name)), name)


def parse_number(text: Column) -> Column:
    """The number a text begins with, after white space; null without one."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def fingerprint(ordered_keys: Column) -> Column:
    """First 16 hex digits of the SHA-1 of an ordered array of keys."""
    return F.substring(F.sha1(F.array_join(ordered_keys, "").cast("binary")), 1, 16)


def centroid_key(ring: Column) -> Column:
    """`x,z` of the vertex mean in whole decimetres."""
    c = vertex_mean(ring)
    return F.concat_ws(",", F.floor(c["x"] * 10 + 0.5).cast("string"), F.floor(c["z"] * 10 + 0.5).cast("string"))
