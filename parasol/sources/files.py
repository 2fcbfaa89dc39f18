"""State snapshots, table folders, the seed load and CSV feature files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parasol.functions.numeric import as_col
from parasol.functions.temporal import parse_iso
from parasol.operators.change import latest_per_key
from parasol.operators.documents import nest_worker
from parasol.operators.scoring import seed_risk_level

STATE_SCHEMA = """
 workers array<struct<name:string,pincode:string,plan:string,avg_daily_earning:double>>,
 policies array<struct<user:string,plan:string,status:string>>,
 claims array<struct<claim_id:string,user_id:bigint,amount:double,trigger:string,status:string,created_at:string>>
"""
SHARD_ROWS = 1000


def write_state(workers: DataFrame, policies: DataFrame, claims: DataFrame, path: str) -> None:
    """State objects of at most ``SHARD_ROWS`` records per array, one object per line.

    A shard is a range of record ids, so no object grows with the table.
    """
    def shard(df, key, *fields):
        record = F.struct(*fields)
        return df.select(F.floor(F.col(key) / SHARD_ROWS).alias("shard"), record.alias("r"))

    w = shard(workers, "worker_id", F.col("worker_name").alias("name"), "pincode", "plan", "avg_daily_earning")
    p = shard(policies, "worker_id", F.col("worker_name").alias("user"), "plan", "status")
    c = shard(claims, "claim_sk", "claim_id", F.col("worker_id").alias("user_id"), "amount",
              F.col("trigger_type").alias("trigger"), "status",
              F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    rows = (w.withColumnRenamed("r", "w").unionByName(p.withColumnRenamed("r", "p"), True)
            .unionByName(c.withColumnRenamed("r", "c"), True))
    rows.groupBy("shard").agg(
        F.collect_list("w").alias("workers"), F.collect_list("p").alias("policies"),
        F.collect_list("c").alias("claims")).drop("shard").write.mode("overwrite").json(path)


def read_state(spark: SparkSession, path: str, whole_files: bool = False) -> dict[str, DataFrame]:
    """The three record tables of a state snapshot. ``whole_files`` reads one object per file."""
    state = spark.read.schema(STATE_SCHEMA).option("multiLine", whole_files).json(path)
    return {name: state.selectExpr(f"inline({name})") for name in ("workers", "policies", "claims")}


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def seed_workers(flat: DataFrame, order: str = "worker_id") -> DataFrame:
    """Flat worker records as stored documents; of records with one name the last by ``order`` stays."""
    return nest_worker(latest_per_key(flat, ["worker_name"], [order]))


def seed_claims(flat: DataFrame, homes: DataFrame, loaded_at: Column, id_width: int = 4) -> DataFrame:
    """Flat claim records as documents, back-filled with the worker's pincode.

    ``homes`` holds (name, pincode). Records sharing a claim id collapse to the latest.
    """
    created = parse_iso("created_at", loaded_at)
    score = F.coalesce("fraud_score", F.lit(0)).cast("int")
    rows = flat.join(homes.withColumnRenamed("name", "user"), "user", "left")
    typed = rows.select(
        F.concat(F.lit("CLM-"), F.date_format(created, "yyyyMMdd"), F.lit("-"),
                 F.lpad(as_col("id").cast("string"), id_width, "0")).alias("claim_id"),
        F.col("id").alias("_id"),
        F.col("user").alias("worker_name"), F.coalesce("pincode", F.lit("")).alias("pincode"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"), F.coalesce("reason", F.lit("manual claim")).alias("reason"),
        F.coalesce("trigger", F.lit("manual")).alias("trigger_type"), F.coalesce("status", F.lit("pending")).alias("status"),
        F.when(F.col("fraud_score").isNotNull(), F.struct(
            score.alias("score"), seed_risk_level(score).alias("risk_level"),
            (F.coalesce("status", F.lit("")) == "approved").alias("approved"))).alias("fraud_result"),
        created.alias("created_at"), loaded_at.alias("updated_at"))
    return latest_per_key(typed, ["claim_id"], ["created_at", "_id"]).drop("_id")
