"""Ranks over a whole table, without gathering it in one partition.

A window without PARTITION BY makes Spark move all rows to one task.  Here rows are range-partitioned by the sort keys and, where
these tie, by their place in the input, so that no partition outgrows the others however few keys there are.  A row's number is
its place in its sorted partition, which takes no buffer, and what the partitions before hold.  A rank is the least number of its
key, a dense rank the number of its key among the distinct ones; both are joined to the rows by key.  What is broadcast has a row
for each partition, and the ranks of the keys if they are few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import shared_folder

#: Rows that one task sorts, in bytes of sorted_bytes.
TASK_BYTES = 16 << 20
#: Keys up to which their ranks are broadcast; those of more are joined by sorting.
FEW_KEYS = 100_000
#: Plans of these alone give the same rows in the same order each time.
_PLAIN = {"Project", "Filter", "LogicalRelation"}
#: Types without a fixed width.
_LONG = ("string", "varchar", "char", "binary", "array", "map", "struct")


def sort_key(column: str, desc: bool, nulls_first: bool) -> Column:
    c = F.col(column)
    if desc:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def input_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def sorted_bytes(df: DataFrame) -> int:
    """Bytes that df's rows take in a sort, by their number and the length of their texts: the size of files bounds neither, since
    encodings may leave a byte for hundreds of rows.  Where all columns have a fixed width, Parquet's footers tell the number."""
    long = [F.coalesce(F.octet_length(c if kind == "binary" else F.col(c).cast("string")), F.lit(0)).cast("long") for c, kind in df.dtypes if kind.startswith(_LONG)]
    rows, text = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(reduce(Column.__add__, long, F.lit(0))), F.lit(0))).collect()[0]
    # eight bytes a column, and as much for null bits, length, pointer and prefix
    return rows * 8 * (len(df.columns) + 4) + text


def _plain(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().optimizedPlan()
    below = [plan]
    while below:
        p = below.pop()
        if p.nodeName().split(" ")[0] not in _PLAIN or not p.deterministic():
            return False
        below += [p.children().apply(i) for i in range(p.children().size())]
    return True


def sorted_by_range(df: DataFrame, order: list[Column], unique: bool = False) -> DataFrame:
    """df in order, in partitions of about TASK_BYTES.  Rows that tie are spread by their place; a df without ties needs no place."""
    needed = -(-sorted_bytes(df) // TASK_BYTES)
    if not unique:
        df, order = df.withColumn("u_", F.monotonically_increasing_id()), [*order, F.col("u_")]
    # partitions of a given number are not put together again by adaptive execution
    return df.repartitionByRange(max(needed, df.sparkSession.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order).drop("u_")


def _numbered(df: DataFrame, out: str, keys: list[tuple[str, bool, bool]], unique: bool = False) -> DataFrame:
    """df with a column of row numbers in the order of keys.  Rows that tie keep their order; a df without ties need not have one."""
    order = [sort_key(*k) for k in keys]
    # the partitions are fixed before they are counted: bounds are sampled anew by every plan
    placed = sorted_by_range(df, order, unique).withColumn("m_", F.monotonically_increasing_id()).checkpoint(eager=True)
    # the id has the partition above 33 bits and the place below
    placed = placed.select("*", F.shiftright("m_", 33).alias("p_"), F.col("m_").bitwiseAND((1 << 33) - 1).alias("at_")).drop("m_")
    before = Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("p_").agg(F.count(F.lit(1)).alias("n_")).select("p_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    return placed.join(F.broadcast(starts), "p_").withColumn(out, F.col("start_") + F.col("at_") + 1).drop("p_", "at_", "start_")


def with_rank(df: DataFrame, out: str, function: str, keys: list[tuple[str, bool, bool]], ties: list[tuple[str, bool, bool]] = ()) -> DataFrame:
    """df with a column of row_number, rank or dense_rank over (column, desc, nulls first) keys; ties order row numbers further."""
    shared_folder(df.sparkSession)
    if not _plain(df):
        df = df.checkpoint(eager=True)  # its rows are read more than once, and their places are told from their order
    if function == "row_number":
        return _numbered(df, out, [*keys, *ties])
    columns = list(dict.fromkeys(k[0] for k in keys))
    values = df.select(*columns)
    if function == "dense_rank":
        ranks = _numbered(values.distinct().checkpoint(eager=True), out, keys, unique=True)
    else:
        ranks = _numbered(values, out, keys).groupBy(*columns).agg(F.min(out).alias(out)).checkpoint(eager=True)
    if ranks.count() <= FEW_KEYS:
        ranks = F.broadcast(ranks)
    ranks = ranks.withColumnsRenamed({c: f"r_{c}" for c in columns})
    return df.join(ranks, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in columns))).drop(*(f"r_{c}" for c in columns))
