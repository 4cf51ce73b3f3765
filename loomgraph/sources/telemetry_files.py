"""Run statistics and tags as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """A statistics CSV with header; ``Sum.u64`` comes out as sum_u64, other names stay."""
    raw = spark.read.option("header", True).csv(path)
    for name in raw.columns:
        plain = name.strip()
        raw = raw.withColumnRenamed(name, "sum_u64" if plain == "Sum.u64" else plain.replace(".", "_"))
    return raw.withColumn("sum_u64", raw["sum_u64"].cast("decimal(20,0)")).withColumn("SimTime", raw["SimTime"].cast("long"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("SimTime long, TagName string").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Remote-access trace lines ``OP=..:SRC_PXN=..:...:ADDR=..``, with or without a leading ``@t:``."""
    from pyspark.sql import functions as F

    line = F.regexp_replace("value", r"^@[^:]*:\s*", "")
    fields = F.str_to_map(line, F.lit(":"), F.lit("="))
    m = spark.read.text(path).select(fields.alias("m")).where("m['OP'] is not null")
    numbers = ("SRC_PXN", "SRC_POD", "SRC_CORE", "SRC_THREAD", "DST_PXN")
    addr = F.col("m")["ADDR"]
    return m.select(
        F.col("m")["OP"].alias("op"),
        *[F.col("m")[n].cast("long").alias(n.lower()) for n in numbers],
        F.when(addr.startswith("0x"), F.conv(F.substring(addr, 3, 16), 16, -10)).otherwise(addr).cast("decimal(20,0)").alias("addr"),
    )
