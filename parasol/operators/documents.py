"""Worker and claim documents: nesting, flattening, listing and searching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parasol.constants import DEFAULT_PLAN, PLANS
from parasol.functions.numeric import as_col
from parasol.functions.temporal import iso_text

# Flat worker fields by nested document, with their defaults.
DELIVERY_FIELDS = {
    "total_deliveries": 0,
    "has_delivery_history": False,
    "account_age_days": 90,
    "delivery_consistency": 0.80,
    "avg_daily_earning": 600.0,
}
RISK_FIELDS = {
    "claim_free_weeks": 0,
    "past_claims_count": 0,
    "location_honesty": 0.85,
    "claim_history_score": 1.0,
    "fraudulent_flags": 0,
    "trust_score": None,
}
TOP_FIELDS = {
    "plan": "plus",
    "pan_number": None,
    "pan_verified": False,
    "policy_paused": False,
}


def nest_worker(flat: DataFrame) -> DataFrame:
    """Flat worker rows as stored documents. Absent columns are left out."""
    def present(fields):
        return [c for c in fields if c in flat.columns]

    links = F.filter(F.split(F.coalesce("platforms_csv", F.lit("")), ","), lambda p: p != "")
    return flat.select(
        "worker_id", F.col("worker_name").alias("name"), "pincode", *present(TOP_FIELDS),
        links.alias("platform_links"),
        F.struct(*present(DELIVERY_FIELDS)).alias("delivery_profile"),
        F.struct(*present(RISK_FIELDS)).alias("risk_profile"),
    )


def _or_default(path: str, name: str, default) -> Column:
    value = F.col(path)
    return (value if default is None else F.coalesce(value, F.lit(default))).alias(name)


def flatten_worker(docs: DataFrame) -> DataFrame:
    """Stored documents as flat rows, defaults filled where a field is missing."""
    return docs.select(
        "worker_id", "name", "pincode",
        *[_or_default(c, c, d) for c, d in TOP_FIELDS.items()],
        F.coalesce("platform_links", F.array().cast("array<string>")).alias("platform_links"),
        *[_or_default(f"delivery_profile.{c}", c, d) for c, d in DELIVERY_FIELDS.items()],
        *[_or_default(f"risk_profile.{c}", c, d) for c, d in RISK_FIELDS.items()],
    )


def flatten_claim(docs: DataFrame) -> DataFrame:
    """ISO dates, and the fraud score lifted from the result unless set on top."""
    return docs.select(
        *[c for c in docs.columns if c not in ("fraud_result", "fraud_score", "created_at", "updated_at")],
        F.coalesce("fraud_score", "fraud_result.score").alias("fraud_score"),
        iso_text("created_at").alias("created_at"), iso_text("updated_at").alias("updated_at"),
    )


def with_fields(docs: DataFrame, changes: DataFrame, key: str, stamp: str) -> DataFrame:
    """Apply a wide change table of flat names; null means 'not changed'.

    Flat names land on their nested place, and ``updated_at`` takes ``stamp``.
    """
    fields = [c for c in changes.columns if c not in (key, stamp)]
    change = changes.select(key, F.struct(stamp, *fields).alias("_set"))
    joined = docs.join(change, key, "left")
    hit = F.col("_set").isNotNull()
    out = {c: F.col(c) for c in docs.columns}
    for group, members in (("delivery_profile", DELIVERY_FIELDS), ("risk_profile", RISK_FIELDS)):
        changed = F.col(group)
        for f in fields:
            if f in members:
                changed = changed.withField(f, F.coalesce(f"_set.{f}", f"{group}.{f}"))
        out[group] = F.when(hit, changed).otherwise(F.col(group))
    for f in fields:
        if f in out:
            out[f] = F.coalesce(f"_set.{f}", f)
    out["updated_at"] = F.col(f"_set.{stamp}")
    return joined.select(*[c.alias(n) for n, c in out.items()])


def changes_to_wide(log: DataFrame, key: str, at: str, tie: str, types: dict[str, str]) -> DataFrame:
    """Latest value per (key, field) of a long change log, one column per field."""
    latest = {
        f: F.max_by(F.when(F.col("field") == f, F.col("value")),
                    F.when(F.col("field") == f, F.struct(at, tie))).cast(t).alias(f)
        for f, t in types.items()
    }
    return log.groupBy(key).agg(F.max(at).alias("changed_at"), *latest.values())


def lookup_by(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def newest_per_worker(claims: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` claims of every worker.

    Spark cuts each map task's rows to ``limit`` per worker before the shuffle
    (window group limit), so a hot worker does not land whole in one task.
    """
    w = Window.partitionBy("worker_id").orderBy(F.desc("created_at"), F.desc("claim_sk"))
    return claims.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


def newest_claims(claims: DataFrame, limit: int) -> DataFrame:
    return claims.orderBy(F.desc("created_at"), F.desc("claim_sk")).limit(limit)


def approved_unpaid(claims: DataFrame) -> DataFrame:
    return claims.where((F.col("status") == "approved") & ~F.col("payout_processed"))


def pending_outbox(outbox: DataFrame, limit: int) -> DataFrame:
    return outbox.where(F.col("status") == "pending").orderBy("created_at", "event_id").limit(limit)


def failed_events(outbox: DataFrame, topic: str, limit: int) -> DataFrame:
    failed = outbox.where((F.col("status") == "failed") & (F.col("topic") == topic))
    return failed.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)


def search_workers(workers: DataFrame, text: str, sort_by: str = "trust_score") -> DataFrame:
    hit = (
        F.lower("worker_name").contains(text.lower())
        | F.col("pincode").contains(text)
        | F.coalesce("plan", F.lit("")).contains(text)
    )
    return workers.where(hit).orderBy(F.coalesce(sort_by, F.lit(0.0)).desc(), "worker_id")


def in_ledger(status, which: str) -> Column:
    """Ledger filter: 'approved' is equality; 'pending' and 'rejected' are substrings."""
    s = as_col(status)
    return {
        "all": F.lit(True),
        "approved": s == "approved",
        "pending": s.contains("pending"),
        "rejected": s.contains("rejected"),
    }[which]


def upsert_policies(existing: DataFrame, requests: DataFrame, plans: DataFrame, at) -> DataFrame:
    """One active policy per worker with the tier's price; unknown tiers are priced as plus."""
    tiers = plans.select(
        F.col("plan").alias("tier"), F.col("weekly_premium").alias("new_premium"), F.col("weekly_cap").alias("new_cap"))
    known = F.col("plan").isin([p[0] for p in PLANS])
    priced = requests.withColumn("tier", F.when(known, F.col("plan")).otherwise(DEFAULT_PLAN)).join(tiers, "tier").select(
        "worker_name", F.col("plan").alias("new_plan"), "new_premium", "new_cap")
    return existing.join(priced, "worker_name", "full_outer").select(
        "worker_name",
        F.coalesce("new_plan", "plan").alias("plan"),
        F.when(F.col("new_plan").isNotNull(), "active").otherwise(F.col("status")).alias("status"),
        F.coalesce("new_premium", "weekly_premium").alias("weekly_premium"),
        F.coalesce("new_cap", "weekly_cap").alias("weekly_cap"),
        F.coalesce("created_at", as_col(at)).alias("created_at"),
        F.when(F.col("new_plan").isNotNull(), as_col(at)).otherwise(F.col("updated_at")).alias("updated_at"),
    )
