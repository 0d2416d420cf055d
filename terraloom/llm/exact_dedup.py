"""Exact dedup: rows grouped by a 128-bit content hash, texts compared inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
#: A group with over one in so many of all rows is hot. There are fewer such groups than this.
HOT = 1024


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space: bytes are replaced one by one, and the pattern sees only texts that have two spaces in a row."""
    one = text
    for c in "\t\n\x0b\x0c\r":
        one = F.replace(one, F.lit(c), F.lit(" "))
    return F.when(F.contains(one, F.lit("  ")), F.regexp_replace(one, " {2,}", " ")).otherwise(one)


def _numbered(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns named c0, c1, ..., so that none clashes, with key k and digests h (MD5) and s (SHA-256) of the normalised text n."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("k", F.col(names[docs.columns.index(key)])).withColumn("n", normalised(text_or_empty(names[docs.columns.index(text)])))
    # never null, which is said by coalesce: joins then need no filter that would take the digests again
    never = F.lit(b"")
    return rows.withColumn("h", F.coalesce(F.unhex(F.md5("n")), never)).withColumn("s", F.coalesce(F.unhex(F.sha2("n", 256)), never)), names


def _groups(rows: DataFrame) -> DataFrame:
    """(h, s, keep_id, group_size) of rows (k, h, s, n). The text is a key of the first aggregate, so bytes are compared."""
    texts = rows.groupBy("h", "s", "n").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("c"))
    groups = texts.groupBy("h", "s").agg(F.min("k").alias("keep_id"), F.sum("c").alias("group_size"), F.count(F.lit(1)).alias("v"))
    one = F.when(F.col("v") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("long"))
    return groups.select("h", "s", "keep_id", one.alias("group_size"))


def _hot_and_cold(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups of rows, written: fewer than HOT of over one in HOT of all rows, and the others."""
    groups = written(_groups(rows), "text-groups")
    most = max(1, (groups.agg(F.sum("group_size")).first()[0] or 0) // HOT)
    return groups.where(F.col("group_size") > most), groups.where(F.col("group_size") <= most)


def _with_groups(rows: DataFrame, several: bool) -> DataFrame:
    """rows with keep_id and group_size of their group, from a broadcast where it is hot, else by a join;
    with several, null where a group is one row. Hot rows are spread in that join, where they meet nothing."""
    hot, cold = _hot_and_cold(rows)
    hot = hot.select("h", "s", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    cold = (cold.where("group_size > 1") if several else cold).withColumnsRenamed({"h": "spot", "s": "cold_s"})
    met = rows.drop("n").join(F.broadcast(hot), ["h", "s"], "left")
    if several:
        met = met.where(F.col("hot_size").isNull() | F.col("k").eqNullSafe(F.col("hot_id")))
    spot = F.when(F.col("hot_size").isNull(), F.col("h")).otherwise(F.concat("h", F.unhex(F.hex(F.xxhash64("k"))))).alias("own_spot")
    met = met.select("*", spot).join(cold, (F.col("own_spot") == F.col("spot")) & (F.col("s") == F.col("cold_s")), "left")
    return met.withColumns({"keep_id": F.when(F.col("hot_size").isNull(), F.col("keep_id")).otherwise(F.col("hot_id")), "group_size": F.coalesce("hot_size", "group_size")})


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs' rows, all columns, with keep_id, group_size, kept and text_sha256.

    Built-in functions only. Texts are grouped by the MD5 of the normalised text together with the
    text itself, so the aggregate compares bytes; copies collapse before the shuffle, however many
    there are. The groups are then addressed by MD5 and SHA-256: two different texts with the same
    MD5 stay two groups, and if both digests were equal the query would stop with an error. Groups
    of over a 1024th of all rows, fewer than 1024 whatever the input, are broadcast to their rows;
    only the rest are joined by a shuffle, so no task gets a hot group's rows.

    Null text counts as empty; the empty text is a text like any other. Rows that repeat a key are
    rows of their own: each counts in group_size, and those with the smallest key are all kept. A
    null key is kept only where its group has no other. Other columns pass through whatever their
    names, except that columns named as the four results are replaced. An empty table gives an
    empty table.
    """
    rows, names = _numbered(docs, text, key)
    met = _with_groups(rows, several=False)
    given = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in RESULTS]
    return met.select(*given, "keep_id", "group_size", F.col("k").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("s")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the rows that are not kept: docs' columns with docs' values, whatever their names.

    Copies of hot groups go where they are read; the other rows meet the groups of more than one.
    """
    rows, names = _numbered(docs, text, key)
    left = _with_groups(rows, several=True).where(F.col("group_size").isNull() | F.col("k").eqNullSafe(F.col("keep_id")))
    return left.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
