"""Flag sets as bits of a long: names to masks, masks to names, tests and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask(names: Sequence[str], flags: Sequence[str]) -> int:
    """The mask of names among flags; an unknown name is an error that lists all of them."""
    if unknown := [n for n in names if n not in flags]:
        raise ValueError(f"unknown flags: {', '.join(unknown)}")
    return sum(1 << flags.index(n) for n in set(names))


def encode(names: Column, flags: Sequence[str]) -> Column:
    """An array of names as a mask; unknown names stop the query."""
    at = F.create_map(*[x for i, n in enumerate(flags) for x in (F.lit(n), F.lit(1 << i).cast("long"))])
    one = lambda n: F.coalesce(F.try_element_at(at, n), F.raise_error(F.concat(F.lit("unknown flag: "), n)).cast("long"))
    return F.aggregate(names, F.lit(0).cast("long"), lambda acc, n: acc.bitwiseOR(one(n)))


def decode(bits: Column, flags: Sequence[str]) -> Column:
    """A mask as an array of names, in the order of flags."""
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(1 << i).cast("long").alias("b")) for i, n in enumerate(flags)])
    return F.transform(F.filter(pairs, lambda p: p["b"].bitwiseAND(bits) != 0), lambda p: p["n"])


def has_all(bits: Column, wanted: Column | int) -> Column:
    w = wanted if isinstance(wanted, Column) else F.lit(wanted).cast("long")
    return bits.bitwiseAND(w) == w


def has_any(bits: Column, wanted: Column | int) -> Column:
    w = wanted if isinstance(wanted, Column) else F.lit(wanted).cast("long")
    return bits.bitwiseAND(w) != 0


def flag_counts(df: DataFrame, bits: str, flags: Sequence[str]) -> DataFrame:
    """(flag, n) of the rows that have each flag: one pass, a sum for each bit, then turned into rows."""
    sums = df.agg(*[F.coalesce(F.sum(has_any(F.col(bits), 1 << i).cast("long")), F.lit(0)).cast("long").alias(f"_{i}") for i in range(len(flags))])
    rows = F.array(*[F.struct(F.lit(n).alias("flag"), F.col(f"_{i}").alias("n")) for i, n in enumerate(flags)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")
