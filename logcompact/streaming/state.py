"""State and output of micro-batch jobs as tables in the shared folder.

A stateful step runs as an ordinary distributed job over each micro-batch plus the state the batch
before left behind, so a run or command that holds most of a batch is still cut into chunks. State
lives in two alternating slots: batch n reads the slot of n-1 and overwrites its own, so a batch
that is run again after a failure finds its input untouched. Output goes to one folder per batch,
overwritten on a repeat, which makes every row appear once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Slots:
    """A table with one version per micro-batch, of which the last two are kept."""

    path: str
    schema: str

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.path}/slot={(batch_id - 1) % 2}")

    def write(self, rows: DataFrame, batch_id: int) -> DataFrame:
        slot = f"{self.path}/slot={batch_id % 2}"
        names = [field.split()[0] for field in self.schema.split(", ")]
        rows.select(*names).write.mode("overwrite").parquet(slot)
        return rows.sparkSession.read.schema(self.schema).parquet(slot)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def start(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", **trigger: object
) -> StreamingQuery:
    """Run a step on each micro-batch; by default until the available input is used up."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
