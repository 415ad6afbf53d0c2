"""Streams of runs and history records: the loop guard and running savings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logcompact.operators.loops import GAP_SECONDS, THRESHOLD, loop_guard
from logcompact.operators.ordered import beside
from logcompact.session import staged
from logcompact.streaming.state import Slots, start, write_batch

SERIES = "key STRING, n BIGINT, ts TIMESTAMP"


def stream_loop_guard(
    runs: DataFrame,
    state: str,
    out: str,
    checkpoint: str,
    gap_seconds: int = GAP_SECONDS,
    threshold: int = THRESHOLD,
    excluded: tuple[str, ...] = (),
    **trigger: object,
) -> StreamingQuery:
    """The loop guard over a stream of runs in time order: (key, run_id, ts, count, loop).

    State is one row per command seen within the gap; older series are dropped.
    """
    series = Slots(f"{state}/series", SERIES)

    def step(batch: DataFrame, batch_id: int) -> None:
        before = series.before(batch.sparkSession, batch_id)
        batch = staged(batch, "runs")
        counted = staged(
            loop_guard(batch, gap_seconds, threshold, excluded, seed=before), "counted"
        )
        write_batch(counted, out, batch_id)
        last = counted.groupBy("key").agg(
            F.max_by("count", F.struct("ts", "run_id")).alias("n"),
            F.max("ts").cast("timestamp").alias("ts"),
        )
        kept = last.unionByName(before.join(beside(last), "key", "left_anti"))
        newest = batch.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
        oldest = F.lit(newest) - F.expr(f"INTERVAL {int(gap_seconds)} SECONDS")
        live = kept if newest is None else kept.where(F.col("ts") >= oldest)
        series.write(live, batch_id)

    return start(runs, step, checkpoint, **trigger)


TOTALS = (
    "cmd STRING, runs BIGINT, total_saved BIGINT, sum_pct DOUBLE, active BIGINT, active_pct DOUBLE, "
    "sum_exec_ms BIGINT, all_exact BOOLEAN, batch_id INT"
)


def stream_history(history: DataFrame, out: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append history records to a table; the file sink's log makes each appear once."""
    writer = history.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_savings(history: DataFrame, out: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Running totals per command: a streaming aggregate that writes the commands of each micro-batch to ``out``.

    Spark keeps the state, one row per command, under the checkpoint; records add up inside tasks before the shuffle, so
    a command may hold most of them.
    """
    active = ~F.coalesce("bypassed", F.lit(False))
    totals = history.groupBy("cmd").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("saved_tokens").alias("total_saved"),
        F.sum("savings_pct").alias("sum_pct"),
        F.count_if(active).alias("active"),
        F.coalesce(F.sum(F.when(active, F.col("savings_pct"))), F.lit(0.0)).alias("active_pct"),
        F.sum("exec_ms").alias("sum_exec_ms"),
        F.bool_and(F.coalesce("exact_tokens", F.lit(False))).alias("all_exact"),
    )

    def step(changed: DataFrame, batch_id: int) -> None:
        write_batch(changed, out, batch_id)

    return start(totals, step, checkpoint, "update", **trigger)


def latest_totals(spark, out: str) -> DataFrame:
    """Running totals per command: the last row that each command got."""
    rows = spark.read.schema(TOTALS).parquet(out)
    last = rows.groupBy("cmd").agg(F.max_by(F.struct("runs", "total_saved", "sum_pct", "sum_exec_ms"), "batch_id").alias("t"))
    return last.select("cmd", "t.*").select(
        "cmd",
        "runs",
        "total_saved",
        (F.floor(F.col("sum_pct") / F.col("runs") * 10 + 0.5) / 10.0).alias("avg_pct"),
        F.expr("sum_exec_ms div runs").alias("avg_exec_ms"),
    )
