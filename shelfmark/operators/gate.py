"""The error gate while an import runs.

``ErrorGate`` counts lines and failures as tasks finish, in accumulators, and cancels the job once too many have failed, so
the rest of a payload that is no good is not read. Accumulators may count a task twice that runs again, so the gate only ends a job
early; the final verdict is that of ``check_error_rate`` over the written rows.

``gate_outcomes`` is the same rule as a table: for payloads of several pieces, after which one each of them stops.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.operators.discards import ABORT_RATE, CHECK_AFTER


class ErrorGate:
    def __init__(self, spark: SparkSession, abort_rate: float = ABORT_RATE, check_after: int = CHECK_AFTER, every: float = 0.2):
        self.context, self.abort_rate, self.check_after, self.every = spark.sparkContext, abort_rate, check_after, every
        self.seen, self.failed = self.context.accumulator(0), self.context.accumulator(0)
        self.tripped = False

    def watched(self, parsed: DataFrame) -> DataFrame:
        """Adapter output, counted as it passes. Only outcome and part go through Python, as Arrow columns."""
        seen, failed = self.seen, self.failed

        def tally(outcome, part):
            import pyarrow.compute as pc

            seen.add(pc.sum(pc.equal(part, 0)).as_py() or 0)
            failed.add(pc.sum(pc.equal(outcome, "failed")).as_py() or 0)
            return outcome

        counted = F.arrow_udf(tally, "string").asNondeterministic()
        return parsed.withColumn("outcome", counted("outcome", "part"))

    def too_many(self) -> bool:
        return self.seen.value >= self.check_after and self.failed.value > self.abort_rate * self.seen.value

    def write(self, parsed: DataFrame, path: str) -> None:
        """Writes watched rows; raises as soon as too many lines have failed, and no later file is read then."""
        group, done = f"gate-{uuid.uuid4().hex}", threading.Event()

        def watch():
            while not done.wait(self.every):
                if self.too_many():
                    self.tripped = True
                    self.context.cancelJobGroup(group)
                    return

        watcher = threading.Thread(target=watch, daemon=True)
        self.context.setJobGroup(group, "import behind an error gate", interruptOnCancel=True)
        watcher.start()
        try:
            parsed.write.mode("overwrite").parquet(path)
        except Exception as e:
            if not self.tripped:
                raise
            raise RuntimeError(f"{self.failed.value} of {self.seen.value} lines failed, more than {self.abort_rate:.2%}; the rest was not read") from e
        finally:
            done.set()
            watcher.join()
            self.context.setLocalProperty("spark.jobGroup.id", None)


def gate_outcomes(
    parsed: DataFrame, payload: str, piece: str, abort_rate: float = ABORT_RATE, check_after: int = CHECK_AFTER
) -> DataFrame:
    """(payload, seen, failed, stopped_after, outcome) by the pieces of payloads in order: counters up to the piece after which
    the payload stops, null where it is read to its end. The outcome is kept, aborted, or empty.

    Pieces are counted map-side, so the running sums see one row for each piece."""
    counts = parsed.groupBy(payload, piece).agg(F.count_if(F.col("part") == 0).alias("_seen"), F.count_if(F.col("outcome") == "failed").alias("_failed"))
    so_far = W.partitionBy(payload).orderBy(piece).rowsBetween(W.unboundedPreceding, 0)
    run = counts.select(payload, piece, F.sum("_seen").over(so_far).alias("seen"), F.sum("_failed").over(so_far).alias("failed"))
    trips = (F.col("seen") >= check_after) & (F.col("failed") > abort_rate * F.col("seen"))
    at = F.struct(piece, "seen", "failed")
    ends = run.groupBy(payload).agg(F.min(F.when(trips, at)).alias("stop"), F.max(at).alias("end"))
    seen, failed = (F.coalesce(F.col(f"stop.{c}"), F.col(f"end.{c}")) for c in ("seen", "failed"))
    bad = F.col("stop").isNotNull() | (failed > abort_rate * seen)
    outcome = F.when(seen == 0, "empty").when(bad, "aborted").otherwise("kept")
    return ends.select(payload, seen.alias("seen"), failed.alias("failed"), F.col(f"stop.{piece}").alias("stopped_after"), outcome.alias("outcome"))
