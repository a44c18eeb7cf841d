"""Expressions that several operators share; all run inside Spark."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounding of Python's round()."""
    return F.bround(x, digits)


def canon_label(label: Column, aliases: dict[str, str]) -> Column:
    """The alias of the trimmed, lower-case label; the label itself where there is none."""
    if not aliases:
        return label
    table = F.create_map(*(F.lit(v) for kv in aliases.items() for v in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(label))), label)


def order_key(seed: int, *ids: Column | str) -> Column:
    """What stands for a seeded shuffle: rows in order of this hash. The same on any engine that has MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *ids))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for 0 / 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def sha256_of(value: object) -> str:
    """Hash of a document: keys sorted, no time stamps put in."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def content_hash(*values: Column | str) -> Column:
    """An aggregate: SHA-256 of the number of rows and of four sums over each row's own SHA-256, so the order of rows and their
    partitions don't count, repeated rows do, and no task sees more than its rows. Values are cast to text."""
    h = F.sha2(F.concat_ws(",", *(F.col(v).cast("string") if isinstance(v, str) else v.cast("string") for v in values)), 256)
    sums = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256)
