"""Artefacts of many runs: tables with the run id in the path, JSON metrics and manifests, views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Artefact tables of a run and the warehouse tables built from them.
RUN_TABLES = ("signals", "orders", "fills", "positions", "equity", "trades", "risk_rejects", "allocation_log")
WAREHOUSE_TABLES = ("dim_experiments", "dim_runs", "fact_trades", "fact_signals", "fact_equity")


def run_id_from_path(levels_up: int = 1) -> Column:
    """Folder name ``levels_up`` above the file."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - levels_up)


def write_run_table(df: DataFrame, root: str, kind: str, mode: str = "append") -> None:
    """``root/kind/run_id=.../``; rewriting a run replaces only its own folder."""
    if kind not in RUN_TABLES:
        raise ValueError(f"unknown artefact: {kind}")
    df.repartition("run_id").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{kind}")


def read_run_table(spark: SparkSession, root: str, kind: str, run_ids: list[str] | None = None) -> DataFrame:
    if kind not in RUN_TABLES:
        raise ValueError(f"unknown artefact: {kind}")
    df = spark.read.option("mergeSchema", "true").parquet(f"{root}/{kind}").withColumn("run_id", F.col("run_id").cast("string"))
    return df.where(F.col("run_id").isin(*run_ids)) if run_ids is not None else df


def read_run_files(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The one-file-per-run layout ``root/{run}/{kind}.parquet``."""
    df = spark.read.option("mergeSchema", "true").parquet(f"{root}/*/{kind}.parquet")
    return df.withColumn("run_id", run_id_from_path())


def read_run_json(spark: SparkSession, root: str, name: str = "metrics", schema: str | None = None) -> DataFrame:
    """``root/{run}/{name}.json`` documents of all runs."""
    reader = spark.read.option("multiLine", "true")
    if schema:
        reader = reader.schema(schema)
    return reader.json(f"{root}/*/{name}.json").withColumn("run_id", run_id_from_path())


def read_experiments(spark: SparkSession, root: str) -> DataFrame:
    """One row per (experiment, run) from manifests listing ``run_ids``."""
    m = read_run_json(spark, root, "manifest").withColumnRenamed("run_id", "experiment_id")
    return m.select("experiment_id", F.explode("run_ids").alias("run_id"))


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, limit: int | None = None) -> DataFrame:
    """Ad-hoc query over the registered views; all rows unless the caller sets a limit."""
    out = spark.sql(text)
    return out if limit is None else out.limit(limit)


def table_status(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of every table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def write_splits(df: DataFrame, root: str, fmt: str = "parquet") -> None:
    """Data set partitioned by ``split``."""
    writer = df.write.mode("overwrite").partitionBy("split").format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(f"{root}/data")


def read_splits(spark: SparkSession, root: str, schema: str, fmt: str = "parquet", split: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema).format(fmt)
    df = (reader.option("header", "true") if fmt == "csv" else reader).load(f"{root}/data")
    return df.where(F.col("split") == split) if split else df


def dataset_manifest(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row describing a data set: rows, symbols, range, columns and its order-independent hash."""
    from ..operators.joins import attach_one_row
    from ..operators.setops import table_hash

    stats = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
    hashed = table_hash(df.select("symbol", "ts", *features, target)).select(F.col("hash").alias("data_hash"))
    return attach_one_row(stats, hashed).withColumns({"features": F.lit(",".join(features)), "target": F.lit(target)})
