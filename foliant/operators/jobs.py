"""The job store as an append-only event log, and the queries over its latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.functions.text import let

STATUSES = ("queued", "running", "succeeded", "failed", "cancelled")
#: action: (states that it may leave, state that it leads to)
TRANSITIONS = {
    "insert": (None, "queued"),
    "claim": (("queued",), "running"),
    "succeed": (("running",), "succeeded"),
    "fail": (("running",), "failed"),
    "cancel": (("queued", "running"), "cancelled"),
    "retry": (("failed", "cancelled", "succeeded"), "queued"),
    "recover": (("running",), "queued"),
}
PAGE_LIMIT = 100


#: What is known of a job, by name and type; `deleted` stays once it is true.
STATE = {
    "owner_username": "string", "original_filename": "string", "status": "string", "attempt_count": "int", "created_at": "string", "started_at": "string", "finished_at": "string",
    "error_message": "string", "progress_percent": "int", "progress_note": "string", "progress_pages_done": "int", "progress_pages_total": "int", "result_extra": "string", "deleted": "boolean",
}
_EVENT = ["at", "action", "owner_username", "original_filename", "error_message", "progress_percent", "progress_note", "progress_pages_done", "progress_pages_total", "result_extra"]


def after(status: str | None, action: str) -> str | None:
    """The status that an action leads to; None if it can't happen in this one."""
    before, to = TRANSITIONS.get(action, ((), None))
    return to if (status is None if before is None else status in before) else None


def _step(s: Column, e: Column) -> Column:
    """A job's state after one event."""
    moves = F.create_map(*[F.lit(x) for name, (before, to) in TRANSITIONS.items() for b in (before or ("",)) for x in (f"{b}>{name}", to)])
    moved_to = F.try_element_at(moves, F.concat(F.coalesce(s["status"], F.lit("")), F.lit(">"), F.coalesce(e["action"], F.lit(""))))

    def state(to: Column) -> Column:
        act = e["action"]
        is_ = lambda *names: to.isNotNull() & act.isin(*names)
        given = lambda f: F.when(is_("retry"), None).otherwise(F.when(act == "progress", F.coalesce(e[f], s[f])).otherwise(s[f]))
        out = {
            "owner_username": F.when(is_("insert"), e["owner_username"]).otherwise(s["owner_username"]),
            "original_filename": F.when(is_("insert"), e["original_filename"]).otherwise(s["original_filename"]),
            "status": F.coalesce(to, s["status"]),
            "attempt_count": s["attempt_count"] + is_("claim").cast("int"),
            "created_at": F.when(is_("insert", "retry"), e["at"]).otherwise(s["created_at"]),
            "started_at": F.when(is_("claim"), e["at"]).when(is_("retry", "recover"), None).otherwise(s["started_at"]),
            "finished_at": F.when(is_("succeed", "fail", "cancel"), e["at"]).when(is_("retry", "recover"), None).otherwise(s["finished_at"]),
            "error_message": F.when(is_("fail"), F.left(e["error_message"], F.lit(4000))).when(is_("retry", "succeed"), None).otherwise(s["error_message"]),
            "progress_percent": let(given("progress_percent"), lambda p: F.when(p.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), p)))),
            "progress_note": F.left(given("progress_note"), F.lit(500)),
            "progress_pages_done": given("progress_pages_done"),
            "progress_pages_total": given("progress_pages_total"),
            "result_extra": F.when(is_("succeed"), e["result_extra"]).when(is_("retry"), None).otherwise(s["result_extra"]),
            "deleted": s["deleted"] | F.coalesce(act == "delete", F.lit(False)),
        }
        return F.struct(*[out[k].cast(t).alias(k) for k, t in STATE.items()])

    return let(moved_to, state)


def states(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(job_id, STATE) of every job, deleted ones too, from its event log (JOB_EVENT), folded in order of `seq`.

    before: such a table of earlier events; the log then holds what came after. An action that the state forbids
    changes nothing. Progress fields keep their last given value; a retry clears times, result and error and puts
    the job at the back of the queue.
    """
    # one job's own history: short, whatever the number of jobs
    log = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", *_EVENT))).alias("log"))
    start = F.struct(*[F.lit({"attempt_count": 0, "deleted": False}.get(k)).cast(t).alias(k) for k, t in STATE.items()])
    if before is not None:
        log = log.join(before.select("job_id", F.struct(*STATE).alias("was")), "job_id", "full_outer")
        start = F.coalesce("was", start)
    folded = F.when(F.col("log").isNull(), start).otherwise(F.aggregate("log", start, _step))
    return log.select("job_id", folded.alias("s")).select("job_id", "s.*")


def latest_state(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One row for each job that is there, with what states() says of it."""
    return states(events, before).where("NOT deleted AND status IS NOT NULL").drop("deleted")


def last_event(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest event of each key: max over a struct, so partial sums run before the shuffle."""
    rest = [c for c in events.columns if c != key and c not in order]
    return events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("e")).select(key, "e.*")


def visible(jobs: DataFrame, viewer: str, role: str, owner: str | None = None, status: str | None = None, query: str | None = None) -> DataFrame:
    """Jobs that the viewer may see: admins all or one owner's, others their own; then status and name filters."""
    if role != "admin":
        jobs = jobs.where(F.col("owner_username") == viewer)
    elif owner and owner.strip():
        jobs = jobs.where(F.col("owner_username") == owner.strip())
    if status and status.strip():
        jobs = jobs.where(F.col("status") == status.strip())
    if query and query.strip():
        jobs = jobs.where(F.lower("original_filename").like(f"%{query.strip().lower()}%"))
    return jobs


def effective_time() -> Column:
    """What a job sorts by: when it ended, began or was made, as its status tells."""
    done, begun, made = F.col("finished_at"), F.col("started_at"), F.col("created_at")
    s = F.col("status")
    return F.when(s == "succeeded", F.coalesce(done, made)).when(s == "running", F.coalesce(begun, made)).when(s == "queued", made).otherwise(F.coalesce(done, begun, made))


def page(jobs: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One page in list order. The size is clamped before the offset is taken, so no rows are skipped."""
    size = max(1, min(size, PAGE_LIMIT))
    ordered = jobs.orderBy(effective_time().desc(), F.desc("created_at"), F.desc("job_id"))
    return ordered.offset(max(0, number - 1) * size).limit(size)


def status_counts(jobs: DataFrame) -> DataFrame:
    """(status, n) for each status that isn't blank, and `all`."""
    counted = jobs.where(F.trim(F.coalesce("status", F.lit(""))) != "").groupBy("status").agg(F.count("*").alias("n"))
    total = jobs.agg(F.count("*").alias("n")).select(F.lit("all").alias("status"), "n")
    return counted.union(total)


def queue_positions(jobs: DataFrame, parts: int = 64, sample: int = 4096) -> DataFrame:
    """(job_id, queue_position, queue_total) of queued jobs, by creation, then id.

    Ranked without one partition for all: cut points from a bounded sample put the rows into `parts` ranges, each
    ranges' rows are ranked by themselves, and the ranges' sizes give the offsets. The cuts are constants of the plan,
    so both uses of them agree.
    """
    queued = jobs.where("status = 'queued'").select("job_id", "created_at")
    some = sorted((r.created_at or "", r.job_id) for r in queued.orderBy(F.xxhash64("job_id")).limit(sample).collect())
    cuts = some[:: max(1, len(some) // parts)][1:]
    at = F.struct(F.coalesce("created_at", F.lit("")), F.col("job_id"))
    of = F.size(F.filter(F.array(*[F.struct(F.lit(a), F.lit(b)) for a, b in cuts]), lambda c: c <= at)) if cuts else F.lit(0)
    dealt = queued.withColumn("__part", of)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))  # a row a range
    earlier = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("queue_total"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy("created_at", "job_id"))
    ranked = dealt.withColumn("__rank", own).join(F.broadcast(earlier), "__part")
    return ranked.select("job_id", (F.col("__rank") + F.col("before")).cast("long").alias("queue_position"), F.col("queue_total").cast("long").alias("queue_total"))


def owners(jobs: DataFrame) -> DataFrame:
    return jobs.select("owner_username").where("owner_username IS NOT NULL AND owner_username <> ''").distinct().orderBy("owner_username")


def json_numbers(value: Column) -> Column:
    """Whole numbers of a JSON array, given as numbers or as digits in text; null if there are none."""
    parts = F.from_json(value, "array<string>")
    found = F.filter(F.transform(parts, lambda x: F.when(F.trim(x).rlike("^[0-9]+$"), F.trim(x)).try_cast("int")), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


def api_rows(jobs: DataFrame) -> DataFrame:
    """The public view of jobs (with queue_position, queue_total): progress and result as the status allows."""
    s = F.col("status")
    running, done = s == "running", s == "succeeded"
    only = lambda c: F.when(running, F.col(c))
    extra = F.when(done, F.col("result_extra"))
    files = F.slice(F.from_json(F.get_json_object(extra, "$.failed_files"), "array<struct<file:string,error:string>>"), 1, 20)
    return jobs.select(
        "job_id", "owner_username", "original_filename", "status", "created_at", "started_at", "finished_at", "error_message",
        F.when(done, F.concat(F.lit("/jobs/"), F.col("job_id"), F.lit("/download"))).alias("download_url"),
        F.col("queue_position"), F.coalesce("queue_total", F.lit(0)).cast("long").alias("queue_total"),
        F.when(done, 100).otherwise(only("progress_percent")).alias("progress_percent"),
        F.when(done, "已完成").otherwise(only("progress_note")).alias("progress_note"),
        only("progress_pages_done").alias("progress_pages_done"), only("progress_pages_total").alias("progress_pages_total"),
        json_numbers(F.get_json_object(extra, "$.pdf_vl_failed_pages")).alias("failed_pages"),
        F.when(F.size(files) > 0, files).alias("failed_files"),
    )


def valid_id(raw: Column) -> Column:
    """The job id, if it is 32 lower-case hexadecimal digits; otherwise null."""
    s = text.strip(raw)
    return F.when(s.rlike("^[a-f0-9]{32}$"), s)


def safe_path(raw: Column) -> Column:
    """A relative path with forward slashes; null if it is empty or climbs."""
    s = F.regexp_replace(F.replace(text.strip(raw), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    return F.when((s != "") & ~F.exists(F.split(s, "/"), lambda p: p == ".."), s)


def action_code(action: Column, status: Column, may_see: Column) -> Column:
    """The HTTP code of an action on a job: 404 unknown, 403 not one's own, 409 not now, otherwise 200."""
    allowed = (
        F.when(action == "detail", True)
        .when(action == "cancel", status.isin("queued", "running"))
        .when(action == "retry", status.isin("failed", "cancelled", "succeeded"))
        .when(action == "delete", ~status.isin("running"))
        .when(action == "download", status == "succeeded")
        .otherwise(False)
    )
    return F.when(status.isNull(), 404).when(~may_see, 403).when(~allowed, F.when(action == "download", 400).otherwise(409)).otherwise(200)


def download_plan(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """asked (pos, job_id) without repeats, in order, each with its folder name and whether it can be had."""
    first = asked.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(F.min("pos").alias("pos"))
    joined = first.join(jobs.select("job_id", "status", "original_filename"), "job_id", "left")
    folder = F.concat(text.stem(F.col("original_filename")), F.lit("_"), F.left("job_id", F.lit(8)))
    return joined.select("pos", "job_id", folder.alias("folder"), F.coalesce(F.col("status") == "succeeded", F.lit(False)).alias("ready"))


def running_progress(files: DataFrame, key: str, order: list[str], top: int = 99) -> DataFrame:
    """Each file's share of its job's files so far, in whole percent (ties to even), at most `top`."""
    own = Window.partitionBy(key)
    so_far = F.count("*").over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    share = F.bround(100.0 * so_far / F.count("*").over(own)).cast("long")
    return files.withColumn("percent", F.least(F.lit(top).cast("long"), share))


def directory_summary(files: DataFrame, key: str, failed: Column, name: Column, most: int = 200) -> DataFrame:
    """Counts of a directory job's files, and the first `most` failed ones by name."""
    bad = F.when(failed, F.struct(name.alias("file"), F.lit("failed").alias("error")))
    return files.groupBy(key).agg(
        F.count("*").alias("total_files"),
        F.count(F.when(~failed, 1)).alias("succeeded_files"),
        F.count(F.when(failed, 1)).alias("failed_files"),
        F.slice(F.array_sort(F.collect_list(bad)), 1, most).alias("failed_items"),  # one job's files
    )
