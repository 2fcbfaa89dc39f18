"""Latest fact per key with a time to live, kept between micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parasol.functions.temporal import micros
from parasol.operators import scans
from parasol.sources.store import BatchTable, empty


class LatestLookup:
    """Answers each probe with the newest fact of its key that has not expired.

    The state is one row per live key: the newest fact so far, unless it had
    expired when the newest fact or probe of the batch came. A batch reads the
    newest state an earlier batch left and writes the whole state anew, so a
    repeated batch gives the same answers and the same state, and what a batch
    reads does not grow with the batches before it.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, fact: str, seconds: int):
        self.key, self.fact, self.ttl = key, fact, seconds * 1_000_000
        self.state = BatchTable(spark, f"{root}/state", f"{key} string, at bigint, fact_id bigint")
        self.answers = BatchTable(spark, f"{root}/answers", f"probe_id bigint, {key} string, fact_id bigint")

    def _before(self, batch_id: int) -> DataFrame:
        last = self.state.newest(before=batch_id)
        return empty(self.state.spark, self.state.schema) if last is None else self.state.read_batch(last)

    def handle(self, probes: DataFrame, facts: DataFrame, batch_id: int) -> None:
        """``probes`` and ``facts`` carry the key, ``ts`` and the id column."""
        fresh = facts.select(self.key, micros("ts").alias("at"), F.col(self.fact).alias("fact_id"))
        known = self._before(batch_id).unionByName(fresh)
        asked = probes.select(self.key, micros("ts").alias("asked"), F.col(self.fact).alias("probe_id"))
        found = scans.last_known(asked, known, [self.key], "asked", "at", "fact_id", ["fact_id"], ttl=self.ttl)
        self.answers.write(found.select("probe_id", self.key, "fact_id"), batch_id)
        newest = known.groupBy(self.key).agg(F.max(F.struct("at", "fact_id")).alias("s")).select(self.key, "s.*")
        now = fresh.select("at").unionAll(asked.select("asked")).agg(F.max("at")).first()[0]  # one number
        self.state.write(newest if now is None else newest.where(F.col("at") >= now - 2 * self.ttl), batch_id)
