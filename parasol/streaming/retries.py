"""Retries across polls: what failed goes to a retry topic that later triggers read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parasol.constants import MAX_RETRIES
from parasol.sources.store import BatchTable, empty

STATE = "attempt int, due_batch bigint"


class RetryJob:
    """Runs events through ``attempt_once`` until done, dead or out of retries, one attempt per trigger at most.

    ``attempt_once`` adds ``error_class`` (null, 'permanent' or 'transient') and ``error``; ``fields`` is the schema of
    an event. An event that fails for the time being goes to the retry topic with its attempts and the batch it is due in,
    ``2 ** attempt`` batches on, ``longest`` at most; read before that it is put back unchanged. A batch files its
    attempts first and derives the retry topic's folder from what it filed, and both are overwritten if it is done
    again, so a replay changes nothing. A batch reads the new events and what the last one put back, no history.
    """

    def __init__(self, spark: SparkSession, root: str, fields: str, attempt_once: Callable[[DataFrame], DataFrame],
                 max_retries: int = MAX_RETRIES, longest: int = 1):
        self.spark, self.attempt_once, self.max_retries, self.longest = spark, attempt_once, max_retries, longest
        self.columns = empty(spark, fields).columns
        self.tried = BatchTable(spark, f"{root}/tried", f"{fields}, {STATE}, outcome string, error string")
        self.again = BatchTable(spark, f"{root}/retry", f"{fields}, {STATE}")
        if not self.again.newest(before=1 << 62):  # so that the topic can be read before anything failed
            empty(spark, self.again.schema).write.mode("overwrite").parquet(f"{root}/retry/batch_id=-1")

    def stream(self, events: DataFrame) -> DataFrame:
        """New events and the retry topic as one stream."""
        back = self.spark.readStream.schema(self.again.schema).parquet(self.again.path).select(self.again.schema.names)
        return events.select(*self.columns, F.lit(0).alias("attempt"), F.lit(0).cast("bigint").alias("due_batch")).unionByName(back)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        tried = self.attempt_once(batch.where(F.col("due_batch") <= batch_id))
        spent = F.col("attempt") >= self.max_retries
        outcome = (F.when(F.col("error_class").isNull(), "done")
                   .when((F.col("error_class") == "permanent") | spent, "dead").otherwise("retry"))
        waiting = batch.where(F.col("due_batch") > batch_id).withColumns({"outcome": F.lit("wait"), "error": F.lit(None).cast("string")})
        names = self.tried.schema.names
        self.tried.write(tried.withColumn("outcome", outcome).select(*names).unionByName(waiting.select(*names)), batch_id)
        filed = self.tried.read_batch(batch_id)
        failed = F.col("outcome") == "retry"
        wait = F.least(F.pow(F.lit(2.0), F.col("attempt")), F.lit(float(self.longest))).cast("bigint")
        due = F.when(failed, F.lit(batch_id) + wait).otherwise(F.col("due_batch"))
        attempt = F.col("attempt") + failed.cast("int")
        self.again.write(filed.where("outcome in ('retry', 'wait')").select(
            *self.columns, attempt.alias("attempt"), due.alias("due_batch")), batch_id)

    def finished(self) -> DataFrame:
        """Events that are done or dead, with their attempts and last error."""
        return self.tried.read().where("outcome in ('done', 'dead')").drop("due_batch")

    def pending(self, batch_id: int) -> DataFrame:
        """What a batch put back."""
        return self.again.read_batch(batch_id)
