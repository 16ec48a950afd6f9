"""A stream drained over a given table: its result equals the same computation over a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.inputs import read
from foliant.plans.queries_jobs import JOB_LATEST_STATE
from foliant.sources.scratch import shared_folder
from foliant.streaming import queue

ACTIONS = {"signup": "insert", "view": "claim", "purchase": "succeed", "error": "fail", "click": "retry"}


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_job_states(spark: SparkSession, sf_dir: str, slices: int = 3) -> DataFrame:
    """Events land in a folder slice by slice and run through the job state machine with keyed state.

    The stream ends after each slice and takes up again from its checkpoint, as after a restart; each micro-batch
    writes the new states of the jobs it touched, and the last one of each job counts.
    """
    kind = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    log = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), kind[F.col("event_type")].alias("action"))
    folder = scratch(spark)
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        return spark.createDataFrame([], "job_id string, status string, attempt_count int")
    width = (high - low) // slices + 1
    with queue.rocksdb(spark):
        for k in range(slices):
            log.where(F.col("seq").between(low + k * width, low + (k + 1) * width - 1)).write.mode("append").parquet(f"{folder}/landed")
            states = queue.job_states(queue.incoming(spark, f"{folder}/landed", log.schema))
            queue.work(states, queue.keep(f"{folder}/states"), f"{folder}/checkpoint", mode="update").awaitTermination()
    return queue.latest(spark, f"{folder}/states").select("job_id", "status", "attempt_count")


QUERIES = {"stream_job_states": (stream_job_states, JOB_LATEST_STATE)}
