"""Text helpers: blanks, one-pass captures, ordered metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\u0001"
# fixed values: Unicode white space
BLANKS = "\t\n\v\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
META_TYPE = "array<struct<key:string,value:string,vtype:string>>"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.trim(c, F.lit(BLANKS))


def captures(c: Column, pattern: str, groups: int) -> Column:
    """All groups of a pattern that matches the whole text, found in one pass, as an array; null without
    a match. A group that took no part is ''."""
    template = SEP.join(f"${i}" for i in range(1, groups + 1))
    return F.when(c.rlike(pattern), F.split(F.regexp_replace(c, pattern, template), SEP, groups))


def pair(key, value: Column, vtype="string") -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(key).alias("key"), value.cast("string").alias("value"), as_col(vtype).alias("vtype"))


def no_pairs() -> Column:
    return F.array().cast(META_TYPE)


def set_pair(meta: Column, item: Column) -> Column:
    """``meta`` with the item's key set: in its old place if it is there, else at the end."""
    return F.when(
        F.exists(meta, lambda m: m["key"] == item["key"]),
        F.transform(meta, lambda m: F.when(m["key"] == item["key"], item).otherwise(m)),
    ).otherwise(F.concat(meta, F.array(item)))


def fold(items: Column, start: Column | None = None) -> Column:
    """Items set one after another, as an ordered dictionary keeps them."""
    return F.aggregate(items, no_pairs() if start is None else start, set_pair)


def value_of(meta: Column, key: str) -> Column:
    """The value of a key, null if it is absent."""
    return F.try_element_at(F.filter(meta, lambda m: m["key"] == key), F.lit(-1))["value"]


def joined(meta: Column) -> Column:
    """``k=v`` pairs joined by blanks in order, without empty values."""
    return F.array_join(F.transform(F.filter(meta, lambda m: m["value"].isNotNull() & (m["value"] != "")), lambda m: F.concat(m["key"], F.lit("="), m["value"])), " ")
