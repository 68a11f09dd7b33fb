"""DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casario.session import cut_lineage, scratch_path

# Names of working columns. Columns of the caller never start like this.
K1, K2 = "__llm_k1", "__llm_k2"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds a 128-bit identity of (id, text). Rows that repeat both are one document."""
    return docs.withColumns({
        K1: F.xxhash64(F.col(id_col), F.col(text_col), F.col(id_col).isNull()),
        K2: F.xxhash64(F.lit("second"), F.col(text_col), F.col(id_col), F.col(text_col).isNull()),
    })


def numbered(df: DataFrame, by: str, name: str, order: list[Column] | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... within each value of ``by``, which is not null.

    The rows are written, sorted by ``by`` within each file, so that a row's number is the count of that value in
    the files before plus its place in its own file. With ``order``, which starts with ``by``, the numbers follow that order; without
    it no row moves. Only one row for each file and value is shuffled.
    """
    path = scratch_path(df.sparkSession, "numbered")
    (df.orderBy(*order) if order else df.sortWithinPartitions(by)).write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path).select(
        *df.columns, F.col("_metadata.file_name").alias("__llm_file"), F.col("_metadata.row_index").alias("__llm_row")
    )
    parts = rows.groupBy(by, "__llm_file").agg(F.count("*").alias("n"), F.min("__llm_row").alias("low"))
    before = Window.partitionBy(by).orderBy("__llm_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(parts.select(by, "__llm_file", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("__llm_start")))
    return rows.join(starts, [by, "__llm_file"]).select(*df.columns, (F.col("__llm_start") + F.col("__llm_row")).alias(name))
