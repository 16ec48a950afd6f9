"""Queries over the job store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import jobs
from foliant.plans.inputs import JOBS, TABLE_ROWS, derived, for_duckdb, read

_JOBS = for_duckdb(JOBS)
_TIME = """CASE status WHEN 'succeeded' THEN coalesce(finished_at, created_at) WHEN 'running' THEN coalesce(started_at, created_at)
 WHEN 'queued' THEN created_at ELSE coalesce(finished_at, started_at, created_at) END"""
_POSITIONS = "SELECT job_id, row_number() OVER (ORDER BY created_at, job_id) AS queue_position, count(*) OVER () AS queue_total FROM jobs WHERE status = 'queued'"


def all_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, JOBS)


def job_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of jobs with `urgent` in their names, as an administrator sees it."""
    every = all_jobs(spark, sf_dir)
    shown = jobs.page(jobs.visible(every, "root", "admin", query="Urgent"), number=3, size=40)
    rows = jobs.api_rows(shown.join(jobs.queue_positions(every), "job_id", "left").withColumn("queue_total", F.coalesce("queue_total", F.lit(0))))
    return rows.drop("failed_pages", "failed_files")


JOB_LIST_PAGE = f"""
WITH jobs AS ({_JOBS}), q AS ({_POSITIONS}),
page AS (SELECT * FROM jobs WHERE lower(original_filename) LIKE '%urgent%' ORDER BY {_TIME} DESC, created_at DESC, job_id DESC LIMIT 40 OFFSET 80)
SELECT job_id, owner_username, original_filename, status, created_at, started_at, finished_at, error_message,
  CASE WHEN status = 'succeeded' THEN '/jobs/' || job_id || '/download' END AS download_url, queue_position, coalesce(queue_total, 0) AS queue_total,
  CASE status WHEN 'succeeded' THEN 100 WHEN 'running' THEN progress_percent END AS progress_percent,
  CASE status WHEN 'succeeded' THEN '已完成' WHEN 'running' THEN progress_note END AS progress_note,
  CASE WHEN status = 'running' THEN progress_pages_done END AS progress_pages_done,
  CASE WHEN status = 'running' THEN progress_pages_total END AS progress_pages_total
FROM page LEFT JOIN q USING (job_id)
"""


def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.status_counts(all_jobs(spark, sf_dir))


JOB_STATUS_COUNTS = f"WITH jobs AS ({_JOBS}) SELECT coalesce(status, 'all') AS status, count(*) AS n FROM jobs GROUP BY GROUPING SETS ((status), ())"


def job_queue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_positions(all_jobs(spark, sf_dir))


JOB_QUEUE_POSITIONS = f"WITH jobs AS ({_JOBS}) {_POSITIONS}"


def job_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each customer's own failed jobs match a name."""
    return jobs.visible(all_jobs(spark, sf_dir), "", "admin", status="failed", query="medium").groupBy("owner_username").agg(F.count("*").alias("n"))


JOB_SEARCH = f"WITH jobs AS ({_JOBS}) SELECT owner_username, count(*) AS n FROM jobs WHERE status = 'failed' AND lower(original_filename) LIKE '%medium%' GROUP BY 1"


def job_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.owners(all_jobs(spark, sf_dir))


JOB_OWNERS = f"WITH jobs AS ({_JOBS}) SELECT DISTINCT owner_username FROM jobs WHERE owner_username <> ''"


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click-stream events as a job log: a user is a job, an event's kind is an action."""
    kind = F.create_map(*[F.lit(x) for pair in (("signup", "insert"), ("view", "claim"), ("purchase", "succeed"), ("error", "fail"), ("click", "retry")) for x in pair])
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("string").alias("at"), kind[F.col("event_type")].alias("action"),
        F.lit("root").alias("owner_username"), F.col("event_type").alias("original_filename"), F.lit("broke").alias("error_message"),
        F.get_json_object("props", "$.k").cast("int").alias("progress_percent"), F.lit(None).cast("string").alias("progress_note"),
        F.lit(None).cast("int").alias("progress_pages_done"), F.lit(None).cast("int").alias("progress_pages_total"), F.col("props").alias("result_extra"),
    )


def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guarded state machine folded over the event log."""
    return jobs.latest_state(events_log(spark, sf_dir)).select("job_id", "status", "attempt_count")


JOB_LATEST_STATE = """
WITH RECURSIVE log AS (
  SELECT CAST(user_id AS VARCHAR) AS job_id, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
fold AS (
  SELECT job_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS status, 0 AS attempt_count FROM (SELECT DISTINCT job_id FROM log)
  UNION ALL
  SELECT f.job_id, l.n,
    CASE WHEN e = 'signup' AND status IS NULL THEN 'queued' WHEN e = 'view' AND status = 'queued' THEN 'running'
         WHEN e = 'purchase' AND status = 'running' THEN 'succeeded' WHEN e = 'error' AND status = 'running' THEN 'failed'
         WHEN e = 'click' AND status IN ('failed', 'cancelled', 'succeeded') THEN 'queued' ELSE status END,
    attempt_count + CASE WHEN e = 'view' AND status = 'queued' THEN 1 ELSE 0 END
  FROM fold f JOIN log l ON l.job_id = f.job_id AND l.n = f.n + 1)
SELECT job_id, status, attempt_count FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC) AS k FROM fold) WHERE k = 1 AND status IS NOT NULL
"""


def job_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return jobs.last_event(log, "user_id", ["ts", "event_id"])


JOB_LAST_EVENT = "SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"


def job_action_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each action on each job answers, to its owner or another user."""
    acts = F.explode(F.array(*[F.lit(a) for a in ("detail", "cancel", "retry", "delete", "download")]))
    rows = all_jobs(spark, sf_dir).select("job_id", "status", (F.col("progress_pages_done") > 2).alias("may_see"), acts.alias("action"))
    return rows.select("job_id", "action", jobs.action_code(F.col("action"), F.col("status"), F.col("may_see")).alias("code"))


JOB_ACTION_MATRIX = f"""
WITH jobs AS ({_JOBS}), acts AS (SELECT unnest(['detail', 'cancel', 'retry', 'delete', 'download']) AS action)
SELECT job_id, action, CASE WHEN NOT progress_pages_done > 2 THEN 403
  WHEN action = 'detail' OR (action = 'cancel' AND status IN ('queued', 'running')) OR (action = 'retry' AND status IN ('failed', 'succeeded'))
    OR (action = 'delete' AND status <> 'running') OR (action = 'download' AND status = 'succeeded') THEN 200
  WHEN action = 'download' THEN 400 ELSE 409 END AS code
FROM jobs, acts
"""


def job_result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed pages out of a result's JSON: numbers, and texts of digits."""
    rows = jobs.api_rows(all_jobs(spark, sf_dir).withColumns({"queue_position": F.lit(None).cast("long"), "queue_total": F.lit(0)}))
    return rows.where("status = 'succeeded'").select("job_id", F.array_join(F.transform("failed_pages", lambda x: x.cast("string")), ",").alias("pages"))


JOB_RESULT_JSON = f"WITH jobs AS ({_JOBS}) SELECT job_id, (CAST(job_id AS BIGINT) % 9) || ',' || (CAST(job_id AS BIGINT) % 4) AS pages FROM jobs WHERE status = 'succeeded'"


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["n", "p", "s", "flag", "qty", "status"]
    return jobs.running_progress(derived(spark, sf_dir, TABLE_ROWS), "key", order).select("key", "n", "p", "s", "percent")


JOB_PROGRESS = f"""
SELECT key, n, p, s, least(99, CAST(round_even(100.0 * count(*) OVER (PARTITION BY key ORDER BY n, p, s, flag, qty, status ROWS UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY key), 0) AS BIGINT)) AS percent
FROM ({for_duckdb(TABLE_ROWS)})
"""


def directory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of directory jobs (an order) over their files (its lines), with the exit code of a batch run."""
    out = jobs.directory_summary(derived(spark, sf_dir, TABLE_ROWS), "key", F.col("flag") == "R", F.col("part"), most=3)
    names = F.array_join(F.transform("failed_items", lambda i: i["file"]), ",")
    return out.select("key", "total_files", "succeeded_files", "failed_files", names.alias("failed_names"), (F.col("failed_files") > 0).cast("int").alias("exit_code"))


DIRECTORY_SUMMARY = f"""
SELECT key, count(*) AS total_files, count(*) FILTER (flag <> 'R') AS succeeded_files, count(*) FILTER (flag = 'R') AS failed_files,
  array_to_string(coalesce(list_slice(list_sort(list(part) FILTER (flag = 'R')), 1, 3), []), ',') AS failed_names,
  CAST(count(*) FILTER (flag = 'R') > 0 AS INT) AS exit_code
FROM ({for_duckdb(TABLE_ROWS)}) GROUP BY key
"""


def batch_download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") * 3).cast("string").alias("job_id"))
    return jobs.download_plan(asked, all_jobs(spark, sf_dir))


BATCH_DOWNLOAD_PLAN = f"""
WITH jobs AS ({_JOBS}), asked AS (SELECT CAST(user_id * 3 AS VARCHAR) AS job_id, min(event_id) AS pos FROM events GROUP BY 1)
SELECT pos, a.job_id, original_filename || '_' || left(a.job_id, 8) AS folder, coalesce(status = 'succeeded', false) AS ready
FROM asked a LEFT JOIN jobs j ON j.job_id = a.job_id
"""

#: Events as a log of every action: what a user's event does follows from both ids; one user in five may delete.
ACTION_LOG = """
SELECT CAST(user_id AS STRING) AS job_id, event_id AS seq, CAST(event_id AS STRING) AS at,
  CASE (event_id * 7 + user_id) % 9 WHEN 0 THEN 'insert' WHEN 1 THEN 'claim' WHEN 2 THEN 'progress' WHEN 3 THEN 'succeed' WHEN 4 THEN 'fail' WHEN 5 THEN 'cancel' WHEN 6 THEN 'retry'
    WHEN 7 THEN 'recover' ELSE CASE WHEN user_id % 5 = 0 THEN 'delete' ELSE 'progress' END END AS action,
  CAST(event_id % 130 - 10 AS INT) AS progress_percent, concat('step ', CAST(event_id % 3 AS STRING)) AS progress_note
FROM <events>
"""


def job_event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after every kind of action: progress, cancellation, recovery after a crash, deletion."""
    log = derived(spark, sf_dir, ACTION_LOG).withColumns({"owner_username": F.lit("u"), "original_filename": F.lit("f"), "error_message": F.lit("broke"), "result_extra": F.lit("{}"), "progress_pages_done": F.lit(1), "progress_pages_total": F.lit(2)})
    return jobs.latest_state(log).select("job_id", "status", "attempt_count", "created_at", "started_at", "finished_at", "error_message", "progress_percent", "progress_note")


JOB_EVENT_STATES = f"""
WITH RECURSIVE log AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM ({for_duckdb(ACTION_LOG)})),
may AS (SELECT * FROM (VALUES ('insert', NULL, 'queued'), ('claim', ['queued'], 'running'), ('succeed', ['running'], 'succeeded'), ('fail', ['running'], 'failed'), ('cancel', ['queued', 'running'], 'cancelled'),
  ('retry', ['failed', 'cancelled', 'succeeded'], 'queued'), ('recover', ['running'], 'queued')) AS t(a, b, s)),
fold AS (
  SELECT job_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS status, 0 AS attempt_count, CAST(NULL AS VARCHAR) AS created_at, CAST(NULL AS VARCHAR) AS started_at, CAST(NULL AS VARCHAR) AS finished_at,
    CAST(NULL AS VARCHAR) AS error_message, CAST(NULL AS INT) AS progress_percent, CAST(NULL AS VARCHAR) AS progress_note, false AS deleted FROM (SELECT DISTINCT job_id FROM log)
  UNION ALL
  SELECT job_id, n, coalesce(s, status), attempt_count + CAST(coalesce(ok AND action = 'claim', false) AS INT),
    CASE WHEN ok AND action IN ('insert', 'retry') THEN t ELSE created_at END,
    CASE WHEN ok AND action = 'claim' THEN t WHEN ok AND action IN ('retry', 'recover') THEN NULL ELSE started_at END,
    CASE WHEN ok AND action IN ('succeed', 'fail', 'cancel') THEN t WHEN ok AND action IN ('retry', 'recover') THEN NULL ELSE finished_at END,
    CASE WHEN ok AND action = 'fail' THEN 'broke' WHEN ok AND action IN ('retry', 'succeed') THEN NULL ELSE error_message END,
    CASE WHEN ok AND action = 'retry' THEN NULL WHEN action = 'progress' THEN greatest(0, least(100, new_percent)) ELSE progress_percent END,
    CASE WHEN ok AND action = 'retry' THEN NULL WHEN action = 'progress' THEN new_note ELSE progress_note END, deleted OR action = 'delete'
  FROM (SELECT f.job_id, l.n, f.status, attempt_count, created_at, started_at, finished_at, error_message, f.progress_percent, f.progress_note, deleted, l.action, l."at" AS t,
          l.progress_percent AS new_percent, l.progress_note AS new_note, m.s, m.s IS NOT NULL AS ok
        FROM fold f JOIN log l ON l.job_id = f.job_id AND l.n = f.n + 1 LEFT JOIN may m ON m.a = l.action AND (CASE WHEN m.b IS NULL THEN f.status IS NULL ELSE list_contains(m.b, f.status) END)))
SELECT job_id, status, attempt_count, created_at, started_at, finished_at, error_message, progress_percent, progress_note
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC) AS k FROM fold) WHERE k = 1 AND status IS NOT NULL AND NOT deleted
"""


def job_failed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed files out of a result's JSON, twenty at most."""
    one = lambda i: F.struct(F.concat(F.lit("f"), i.cast("string")).alias("file"), F.lit("e").alias("error"))
    n = (F.col("job_id").cast("long") % 25).cast("int")
    listed = F.to_json(F.struct(F.transform(F.sequence(F.lit(0), n), one).alias("failed_files")))
    rows = jobs.api_rows(all_jobs(spark, sf_dir).withColumn("result_extra", listed).withColumns({"queue_position": F.lit(None).cast("long"), "queue_total": F.lit(0)}))
    return rows.where("status = 'succeeded'").select("job_id", F.size("failed_files").alias("n"), F.array_join(F.transform("failed_files", lambda f: f["file"]), ",").alias("files"))


JOB_FAILED_FILES = f"""
WITH jobs AS ({_JOBS})
SELECT job_id, CAST(least(20, CAST(job_id AS BIGINT) % 25 + 1) AS INT) AS n, array_to_string(list_transform(range(0, least(20, CAST(job_id AS BIGINT) % 25 + 1)), lambda i: 'f' || i), ',') AS files
FROM jobs WHERE status = 'succeeded'
"""

QUERIES = {
    "job_event_states": (job_event_states, JOB_EVENT_STATES),
    "job_failed_files": (job_failed_files, JOB_FAILED_FILES),
    "job_list_page": (job_list_page, JOB_LIST_PAGE),
    "job_status_counts": (job_status_counts, JOB_STATUS_COUNTS),
    "job_queue_positions": (job_queue_positions, JOB_QUEUE_POSITIONS),
    "job_search": (job_search, JOB_SEARCH),
    "job_owners": (job_owners, JOB_OWNERS),
    "job_latest_state": (job_latest_state, JOB_LATEST_STATE),
    "job_last_event": (job_last_event, JOB_LAST_EVENT),
    "job_action_matrix": (job_action_matrix, JOB_ACTION_MATRIX),
    "job_result_json": (job_result_json, JOB_RESULT_JSON),
    "job_progress": (job_progress, JOB_PROGRESS),
    "directory_summary": (directory_summary, DIRECTORY_SUMMARY),
    "batch_download_plan": (batch_download_plan, BATCH_DOWNLOAD_PLAN),
}
