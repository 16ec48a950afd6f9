"""The job queue as a stream: events land as files, micro-batches are the slots, state is kept by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from foliant.operators.jobs import TRANSITIONS


def incoming(spark: SparkSession, folder: str, schema: StructType, slots: int = 0) -> DataFrame:
    """Files that arrive in a folder, at most `slots` a micro-batch; 0: all that are there."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", slots) if slots > 0 else reader).parquet(folder)


def work(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, mode: str = "append") -> StreamingQuery:
    """Run `batch` on each micro-batch. The checkpoint takes up where a crash left off, so nothing is queued again by hand."""
    writer = stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def keep(folder: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes each micro-batch to a folder of its own: a batch that runs again replaces itself."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def latest(spark: SparkSession, folder: str, key: str = "job_id") -> DataFrame:
    """The newest row of each key of what keep() wrote."""
    rows = spark.read.parquet(folder)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(key, "last.*")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for as long as the block lasts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class JobState(StatefulProcessor):
    """One job's status and attempts: the transitions of the job store, event by event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "status string, attempts int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802, ARG002
        status, attempts = self.state.get() if self.state.exists() else (None, 0)
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            before, after = TRANSITIONS.get(r.action, ((), None))
            if after and (status is None if before is None else status in before):
                status, attempts = after, attempts + (r.action == "claim")
        if status is not None:
            self.state.update((status, attempts))
            yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempt_count": [attempts]})

    def close(self) -> None:
        pass


def job_states(events: DataFrame) -> DataFrame:
    """A stream of events (job_id, seq, action) as a stream of each touched job's new state. Needs the RocksDB state store."""
    return events.groupBy("job_id").transformWithStateInPandas(JobState(), "job_id string, status string, attempt_count int", "Update", "none")
