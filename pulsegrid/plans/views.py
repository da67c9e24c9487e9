"""The driver's tables as signals and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pulsegrid.operators.signals import indexed

RATE_HZ = 64.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt to as many tasks as a shuffle has. A table of few megabytes is one task as it is read, however much work its rows are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def sig_embed(spark, sf_dir: str) -> DataFrame:
    """Array form (rid, label, data): each embedding is a record of 64 samples at 64 Hz."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rid"), "label", F.col("embedding").cast("array<double>").alias("data"))


def sig_embed_long(spark, sf_dir: str) -> DataFrame:
    return sig_embed(spark, sf_dir).select("rid", F.posexplode("data").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


def sig_user(spark, sf_dir: str) -> DataFrame:
    """Long form (user_id, i, x): a user's event values in order."""
    return indexed(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


def sig_supp(spark, sf_dir: str) -> DataFrame:
    """Long form (l_suppkey, i, x): a supplier's extended prices in order of their lines."""
    return indexed(read(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"], "l_extendedprice")


def ann_user(spark, sf_dir: str) -> DataFrame:
    """Events (user_id, sample_index, ordinal, symbol, aux_note): a user's events in order, three samples apart."""
    i = F.row_number().over(W.Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return read(spark, sf_dir, "events").select("user_id", (i * 3).cast("long").alias("sample_index"), i.cast("long").alias("ordinal"), F.col("event_type").alias("symbol"), F.col("props").alias("aux_note"))


#: The same views for DuckDB, by name.
DUCK = {
    "sig_embed_long": "SELECT vec_id AS rid, label, (k - 1)::BIGINT AS i, embedding[k]::DOUBLE AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)",
    "sig_user": "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS i, value AS x FROM events",
    "sig_supp": "SELECT l_suppkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1)::BIGINT AS i, l_extendedprice AS x FROM lineitem",
    "ann_user": "SELECT user_id, (3 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1))::BIGINT AS sample_index, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS ordinal, event_type AS symbol, props AS aux_note FROM events",
}


def duck(sql: str, *views: str) -> str:
    """sql with the named views in front of it."""
    return "WITH " + ", ".join(f"{v} AS ({DUCK[v]})" for v in views) + (", " if sql.startswith("+") else " ") + sql.lstrip("+")
