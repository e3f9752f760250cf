"""Tables and the layouts that operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix_long(wide: DataFrame, row_id: str = "vec_id", label: str = "label", features: str = "embedding") -> DataFrame:
    """(row_id, label, f, v): one row for each cell of a matrix whose rows are arrays. NaN becomes null."""
    cells = wide.select(F.col(row_id).alias("row_id"), F.col(label).cast("long").alias("label"), F.posexplode(features).alias("f", "v"))
    return cells.select("row_id", "label", F.col("f").cast("long").alias("f"), F.nanvl(F.col("v").cast("double"), F.lit(None).cast("double")).alias("v"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_long(table(spark, sf_dir, "embeddings"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment results with one row for each (dataset, seed, method), derived from orders' lines."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    tier = F.when(F.col("dataset") < "Brand#2", "easy").when(F.col("dataset") < "Brand#4", "medium").otherwise("hard")
    grouped = lines.groupBy(F.col("p_brand").alias("dataset"), F.year("l_shipdate").cast("long").alias("seed"), F.col("l_returnflag").alias("method"))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return grouped.agg(mean("l_discount", "ba"), mean("l_tax", "f1"), mean("l_quantity", "sec"), F.count("*").alias("n")).withColumn("tier", tier)
