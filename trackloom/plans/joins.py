"""Joins that choose their way by checked sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from trackloom.plans.stage import staged

#: Rows and bytes up to which a side is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: A key with more left rows than this is hot and is spread over as many tasks as it has such parts.
HOT_ROWS = 2_000_000
#: Most tasks a hot key is spread over.
SALTS = 4_096


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; stops counting beyond them."""
    return df.limit(rows + 1).count() <= rows


def _size(c: Column, kind: DataType) -> Column:
    """Bytes of a value, about; 0 for null."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        if isinstance(inner, (StringType, BinaryType, ArrayType, MapType)):
            return F.coalesce(F.aggregate(c, F.lit(0), lambda a, x: a + _size(x, inner).cast("int")), F.lit(0)) + 8
        each = 8 * (len(inner.fields) if isinstance(inner, StructType) else 1)
        return F.coalesce(F.size(c), F.lit(0)) * each + 8
    if isinstance(kind, StructType):
        return sum((_size(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes; reads at most rows + 1 rows."""
    width = sum((_size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    r = df.limit(rows + 1).select(width.cast("bigint").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).first()
    return r["n"] <= rows and (r["w"] or 0) <= size


def cell_join(left: DataFrame, right: DataFrame, keys: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner equi-join of many rows with few rows a key; both sides should be cheap to read twice.

    A right side within ``broadcast_rows`` rows and BROADCAST_BYTES is broadcast.
    Beyond that both sides are shuffled, whatever size Spark takes it for: it
    doesn't count the rows an explode makes.  Keys with over HOT_ROWS left rows, found
    by one partial aggregation, are spread over up to SALTS salts and their right
    rows repeated as often, so one cell can't fill one task; the table of hot
    keys has at most rows / HOT_ROWS rows and is joined, not collected.
    """
    if small(right, broadcast_rows):
        return left.join(F.broadcast(right), keys)
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select(*keys, F.least(F.ceil(F.col("_n") / HOT_ROWS), F.lit(SALTS)).cast("int").alias("_salts"))
    hot = staged(hot)
    if not hot.limit(1).count():
        return left.join(right.hint("merge"), keys)
    salted = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    repeated = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(repeated.hint("merge"), [*keys, "_salt"]).drop("_salt")
