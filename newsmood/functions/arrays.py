"""Column functions over arrays and composite text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subscript(array: Column, index: int) -> Column:
    """1-based subscript; out of range or a NULL array gives NULL."""
    if index < 1:
        return F.get(array, F.lit(-1))
    return F.get(array, F.lit(index - 1))


def one_slice(array: Column, index: int) -> Column:
    """``array[index:index]`` of a two-dimensional array, flattened to its only row's elements."""
    return F.flatten(F.slice(array, index, 1))


def length_or_null(array: Column) -> Column:
    """Length; NULL for an empty array as for a NULL one."""
    return F.nullif(F.when(array.isNotNull(), F.size(array)), F.lit(0))


def parse_composite(text: Column) -> Column:
    """``"(a,b,c)"`` to an array of integers; a part that is no integer gives NULL."""
    return F.transform(F.split(F.regexp_replace(text, "[()]", ""), ","), lambda v: v.try_cast("int"))


def format_composite(counts: Column) -> Column:
    """A counts struct as ``"(n,u,p)"``; NULL fields are left empty."""
    fields = [F.coalesce(counts.getField(f).cast("string"), F.lit("")) for f in ("negative", "neutral", "positive")]
    return F.when(counts.isNotNull(), F.concat(F.lit("("), F.concat_ws(",", *fields), F.lit(")")))
