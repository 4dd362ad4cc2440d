"""Text expressions that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
#: The same six characters, for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text in order; an empty array where it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def unused(df: DataFrame, name: str) -> str:
    """A name like this that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out, k = f"_{name}", 0
    while out.lower() in taken:
        k += 1
        out = f"_{name}_{k}"
    return out
