"""Several strings as one column, for shuffles of wide rows.

Each string of a row takes an offset of its own and is padded, and a shuffle's compression starts
anew at each. One string of all of them is about two thirds as wide, compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Between the parts, and before a mark; ESCAPE alone is NULL.
SEPARATOR, ESCAPE = "\x1f", "\x1b"
MARKS = ((ESCAPE, ESCAPE + "b"), (SEPARATOR, ESCAPE + "a"))

PACKED = "__packed"


def _replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def pack(names: Sequence[str]) -> Column:
    """The named strings as one that `unpack` takes apart, whatever they contain."""
    parts = []
    for name in names:
        text = F.col(name)
        for plain, marked in MARKS:
            text = _replaced(text, plain, marked)
        parts.append(F.coalesce(text, F.lit(ESCAPE)))
    return F.concat_ws(SEPARATOR, *parts)


def unpack(packed: Column | str, position: int) -> Column:
    """The string at `position`, from 0, of a packed column."""
    part = F.substring_index(F.substring_index(packed, SEPARATOR, position + 1), SEPARATOR, -1)
    text = part
    for plain, marked in reversed(MARKS):
        text = _replaced(text, marked, plain)
    return F.when(~F.contains(part, F.lit(ESCAPE)), part).when(part != ESCAPE, text)


def packed_through(df: DataFrame, names: Sequence[str], attach: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`attach(df)`, with the same columns in the same order, for an `attach` that only adds columns
    and reads none of `names`. Those that are strings go through its shuffles as one column.

    Filters and selections behind it do not reach the packed columns' source, so it is for results
    that are read or written whole.
    """
    texts = [c for c in names if c in df.columns and df.schema[c].dataType == StringType()]
    if len(texts) < 2:
        return attach(df)
    rest = [c for c in df.columns if c not in texts]
    attached = attach(df.select(*rest, pack(texts).alias(PACKED)))
    added = [c for c in attached.columns if c not in (*rest, PACKED)]
    own = {c: unpack(PACKED, i).alias(c) for i, c in enumerate(texts)}
    return attached.select(*[own.get(c, c) for c in df.columns], *added)
