"""Shared pieces: tables in the shared folder, bounded slices of Arrow batches, two-level ranks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wegloom.plans.shared import Scratch, drop_path, materialize, new_path, shared_dir  # noqa: F401

WORD = rb"[^\x20\x09-\x0D]+"


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts, by one aggregate: size estimates of plans are wrong without statistics of files."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def parts_for(docs: DataFrame, bytes_each: int, column: str = "text") -> int:
    """How many parts of about bytes_each the texts give; the session's number of shuffle partitions at least."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs, column) // bytes_each))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `most` bytes of `column`, one row at least."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's texts; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def two_level_rank(df: DataFrame, key: list[str], order: list[str], buckets: int, name: str) -> DataFrame:
    """Add `name`: the gapless rank from 0 within `key`, without gathering a key in one task.

    Rows of a key are dealt over `buckets` by a hash of the order columns and numbered there; the buckets' counts,
    summed up in bucket order, give each bucket's first rank. The order columns must tell rows of a key apart.
    """
    d = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    w = Window.partitionBy(*key, "_b").orderBy(*order)
    counted = d.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.withColumn("_first", F.coalesce(F.sum("_n").over(up), F.lit(0))).drop("_n")
    on = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in [*key, "_b"]]
    ranked = d.withColumn("_rn", F.row_number().over(w) - 1)
    joined = ranked.alias("_l").join(first.alias("_r"), on)
    return joined.select(*[F.col(f"_l.{c}") for c in df.columns], (F.col("_rn") + F.col("_first")).alias(name))


def empty_if_null(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def schema(**kinds: str) -> T.StructType:
    names = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(k, names[v]) for k, v in kinds.items()])
