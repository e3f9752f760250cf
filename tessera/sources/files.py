"""File sources and sinks: labelled arrays, loose CSV and ARFF tables, pointer stubs, an append-once journal."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows of `features` (array) and `label`; either missing is an error."""
    df = spark.read.parquet(path)
    if lacking := {"features", "label"} - set(df.columns):
        raise ValueError(f"columns are missing: {sorted(lacking)}")
    return df.select(F.col("features").cast("array<double>").alias("features"), F.col("label").cast("long").alias("label"))


def read_loose_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose last column is the label. A first column that only numbers the rows is dropped (its name blank or
    like an index, and its values distinct or a run from 0 or 1), the others become numbers (null where they are none),
    and columns without any number go. Returns features array<double>, label string."""
    df = spark.read.option("header", True).csv(path)
    *names, label = df.columns
    first = names[0]
    if re.fullmatch(r"(_c0|unnamed.*|index|)", first.strip().lower()):
        x = F.expr(f"try_cast(`{first}` as bigint)")
        n, distinct, low, high, known = df.agg(F.count("*"), F.count_distinct(first), F.min(x), F.max(x), F.count(x)).first()
        if distinct == n or (known == n and low in (0, 1) and high - low + 1 == n):
            names = names[1:]
    numbers = df.select(*[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in names], F.col(f"`{label}`").alias("label"))
    counts = numbers.agg(*[F.count(f"`{c}`").alias(c) for c in names]).first()
    kept = [c for c in names if counts[c]]
    return numbers.select(F.array(*[F.col(f"`{c}`") for c in kept]).alias("features"), "label")


def read_dense_arff(spark: SparkSession, path: str) -> DataFrame:
    """A dense ARFF file: the header's attributes name the columns, numeric ones are doubles, `?` is null, comments and
    case are ignored. The attribute called class, or the last, is `label`."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '%')")
    header = lines.where(F.lower("line").rlike("^@attribute")).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()  # one row for each column
    fields = [re.match(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)", r.line, re.IGNORECASE).groups() for r in header]
    names = [n.strip("'\"") for n, _ in fields]
    numeric = [bool(re.match(r"(numeric|real|integer)\b", k.strip(), re.IGNORECASE)) for _, k in fields]
    rows = lines.where(~F.col("line").startswith("@") & ~F.col("line").startswith("{"))
    cells = F.from_csv("line", F.lit(", ".join(f"c{i} string" for i in range(len(names)))), {"quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    target = next((i for i, n in enumerate(names) if n.lower() == "class"), len(names) - 1)
    value = lambda i: F.nullif(F.col(f"r.c{i}"), F.lit("?"))
    cast = [F.expr(f"try_cast(nullif(r.c{i}, '?') as double)").alias(n) if numeric[i] else value(i).alias(n) for i, n in enumerate(names) if i != target]
    return rows.select(cells.alias("r")).select(*cast, value(target).alias("label"))


def pointer_stubs(spark: SparkSession, path: str) -> DataFrame:
    """(file, oid) of files that are no data but small pointers to large-file storage."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), "value")
    stub = (F.col("size") <= 8192) & F.col("value").startswith("version https://git-lfs.github.com/spec/") & F.col("value").rlike(r"oid sha256:[0-9a-f]{64}")
    return t.where(stub).select("file", F.regexp_extract("value", r"oid sha256:([0-9a-f]{64})", 1).alias("oid"))


class Journal:
    """Results committed once under a key: a repeated row is refused, and one that differs under the same key as well."""

    KEY = ("dataset_id", "split_id", "method", "metric", "seed")

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("key", F.sha2(F.to_json(F.struct(*self.KEY)), 256)).withColumn("digest", F.sha2(F.to_json(F.struct(*sorted(self.schema.fieldNames()))), 256))

    def rows(self) -> DataFrame:
        """All committed rows in the order of their keys."""
        stored = T.StructType([*self.schema.fields, T.StructField("key", T.StringType()), T.StructField("digest", T.StringType())])
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).json(self.path).orderBy("key")

    def commit(self, rows: DataFrame) -> int:
        """Append rows; nothing is written if any key is there already or comes twice."""
        new = self._keyed(rows.select(*self.schema.fieldNames()))
        seen = self.rows().select("key", F.col("digest").alias("old"))
        again = new.join(seen, "key").agg(F.count("*").alias("n"), F.count_if(F.col("digest") != F.col("old")).alias("conflicts")).first()
        twice = new.groupBy("key").count().where("count > 1").count()
        if again.n or twice:
            raise ValueError(f"{again.n} rows are committed already ({again.conflicts} with other values), {twice} keys come twice")
        new.write.mode("append").json(self.path)
        return new.count()


def union_shards(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """All shards' rows with the union of their columns; a key in two rows is an error."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if n := out.groupBy(*key).count().where("count > 1").count():
        raise ValueError(f"{n} keys occur more than once")
    return out


def first_alias(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """A heterogeneous table in a fixed schema: each column from the first of its aliases that the table has."""
    have = set(df.columns)
    pick = {name: next((a for a in [name, *names] if a in have), None) for name, names in aliases.items()}
    return df.select(*[(F.col(f"`{a}`") if a else F.lit(None).cast("string")).alias(n) for n, a in pick.items()])


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_rk", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where("_rk = 1").drop("_rk")
