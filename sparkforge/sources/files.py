"""CSV, JSON and Parquet as tables, and CSV as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def truth(v) -> bool:
    return str(v).lower() in ("true", "1", "yes", "on")


def safe(path: str) -> str:
    if ".." in path.replace("\\", "/").split("/"):
        raise ValueError("a path may not climb to its parent folder")
    return path


def share(spark: SparkSession, path: str, options: dict) -> float:
    """The part of the rows that types are inferred from; rows are taken to have 100 bytes."""
    wanted = int(options.get("sample_size", -1))
    if wanted < 0:
        return 1.0
    size = int(str(spark.read.text(path)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1.0, max(1e-6, wanted / max(1.0, size / 100)))


def read(spark: SparkSession, kind: str, path: str, options: dict | None = None) -> DataFrame:
    """CSV: header, delim or sep, quote, escape, nullstr or null, skip, sample_size, auto_detect, all_varchar. JSON: sample_size.

    sample_size: about how many rows types are inferred from, as a share of what Spark holds the input to have; -1 for all.
    """
    o, path = {k.lower(): v for k, v in (options or {}).items()}, safe(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        # An array of objects over lines, or an object on each line.
        first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
        many = bool(first) and first[0][0].lstrip().startswith("[")
        return spark.read.option("multiLine", many).option("samplingRatio", share(spark, path, o)).json(path)
    r = spark.read.option("header", truth(o.get("header", "true"))).option("sep", o.get("delim", o.get("sep", "\t" if path.endswith(".tsv") else ",")))
    r = r.option("quote", o.get("quote", '"')).option("escape", o.get("escape", '"')).option("nullValue", o.get("nullstr", o.get("null", "")))
    r = r.option("samplingRatio", share(spark, path, o)).option("inferSchema", truth(o.get("auto_detect", "true")) and not truth(o.get("all_varchar", "false")))
    if skip := int(o.get("skip", 0)):
        # The lines to skip are the first of each file: ids rise by one inside a file's first block, from its first line on.
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        first = lines.where("b = 0").groupBy(F.col("f").alias("g")).agg(F.min("i").alias("first"))
        rest = lines.join(first, F.col("f") == F.col("g"), "left").where(f"b <> 0 or i - first >= {skip}").select("value")
        strings = getattr(rest._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        return DataFrame(r._jreader.csv(strings), spark)
    return r.csv(path)


def copy_out(df: DataFrame, path: str, header: bool = True, sep: str = ",", null: str = "") -> None:
    df.write.option("header", header).option("sep", sep).option("nullValue", null).option("escape", '"').csv(safe(path))


def copy_in(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",", null: str = "") -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("nullValue", null).option("escape", '"').csv(safe(path))


def bulk_load(df: DataFrame, path: str, order: list[str], partitions: int | None = None) -> None:
    """Range-partitioned and sorted by the order key, so that readers skip row groups by their minimum and maximum."""
    ranges = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranges.sortWithinPartitions(*order).write.parquet(safe(path))
