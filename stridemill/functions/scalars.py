"""Expressions over maps, paths, labels and row hashes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stridemill.schema import ColumnLike, col


def merge_maps(base: ColumnLike, override: ColumnLike) -> Column:
    """Map union in which the second map wins.

    ``map_concat`` alone rejects duplicate keys unless the session says
    otherwise, so overridden keys are filtered out first.
    """
    base, override = col(base), col(override)
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(override, k))
    return F.map_concat(kept, override)


def file_name(path: ColumnLike) -> Column:
    """Text after the last ``/``."""
    return F.element_at(F.split(col(path), "/"), -1)


def drop_suffix(name: ColumnLike, suffix: str) -> Column:
    name = col(name)
    shorter = F.substr(name, F.lit(1), F.length(name) - len(suffix))
    return F.when(F.endswith(name, F.lit(suffix)), shorter).otherwise(name)


def file_stem(path: ColumnLike) -> Column:
    """File name without its last suffix; a leading dot is part of the name."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def bin_label(y: ColumnLike, bounds: Sequence[float] = (-0.02, 0.02)) -> Column:
    """``y <= low`` -> 0, ``y > high`` -> 2, else 1; NaN -> 1, NULL -> NULL.

    NaN is tested first because Spark orders it above every number.
    """
    y = col(y)
    low, high = bounds
    return (
        F.when(y.isNull(), F.lit(None))
        .when(F.isnan(y), 1)
        .when(y <= low, 0)
        .when(y > high, 2)
        .otherwise(1)
        .cast("int")
    )


def every_n(counter: ColumnLike, n: int, zero_based: bool = False) -> Column:
    """True on every n-th epoch, or with ``zero_based`` on every n-th batch index."""
    if n < 1:
        raise ValueError("n must be at least 1")
    c = col(counter)
    return F.pmod(c + 1 if zero_based else c, F.lit(n)) == 0


def row_hash(ids: Sequence[ColumnLike], *salt: object) -> Column:
    """Hex digest of the id columns and a salt; the pseudo-random order key.

    It depends on the row alone, so a recomputed task gives the same value.
    Colons and backslashes of a value are escaped and NULL is ``\\N``, so
    different ids never give the same text.
    """
    escaped = [
        F.replace(F.replace(col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:")) for c in ids
    ]
    parts = [F.coalesce(p, F.lit("\\N")) for p in escaped] + [F.lit(str(s)) for s in salt]
    return F.md5(F.concat_ws(":", *parts))


def hash_uniform(digest: Column) -> Column:
    """A number in (0, 1) from the first 13 hex digits (52 bits) of a digest."""
    bits = F.conv(F.substr(digest, F.lit(1), F.lit(13)), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def hash_normal(digest: Column) -> Column:
    """A standard normal number from a digest (Box-Muller on two parts of it)."""
    second = F.substr(digest, F.lit(17), F.lit(13))
    radius = F.sqrt(-2 * F.log(hash_uniform(digest)))
    return radius * F.cos(2 * math.pi * hash_uniform(second))
