"""The job service: a store that is an event log in Parquet, workspaces, and a runner whose jobs are Spark tags.

Nothing is updated in place. One driver appends; any number of readers fold the log.
"""

from __future__ import annotations

import io
import shutil
import threading
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from pathlib import Path, PurePosixPath
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from foliant import model
from foliant.operators import accounts, jobs
from foliant.sources.files import IMAGE

TERMINAL = ("succeeded", "failed", "cancelled")
BROKEN, INCOMPLETE, TIMED_OUT = "转换进程异常退出", "内部错误：任务记录不完整", "timed out"
#: Jobs whose status a store remembers; beyond it those that have ended are forgotten.
KNOWN = 100_000


def now() -> str:
    """The time as job records hold it: ISO, UTC, whole seconds."""
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


# Workspaces


@dataclass(frozen=True)
class Workspace:
    job_id: str
    input_root: Path
    output_root: Path
    input_entry: Path
    output_entry: Path


def workspace(input_dir: Path, output_dir: Path, name: str, is_directory: bool = False, job_id: str | None = None) -> Workspace:
    """Where a job's files go. The id is drawn once and kept with the job; images are read as documents of one page."""
    own = job_id or uuid.uuid4().hex
    safe = PurePosixPath(name.replace("\\", "/")).name or "upload"
    stem, suffix = PurePosixPath(safe).stem, PurePosixPath(safe).suffix.lower()
    entry = safe if is_directory else f"{stem}.pdf" if suffix in IMAGE else safe
    result = safe if is_directory else f"{stem}.md"
    return Workspace(own, input_dir / own, output_dir / own, input_dir / own / entry, output_dir / own / result)


def remove_workspace(job_id: str, *roots: Path) -> None:
    for root in roots:
        shutil.rmtree(root / job_id, ignore_errors=True)


def ingest(at: Workspace, uploads: Iterable[tuple[str, Iterable[bytes]]], kind: str, limit: int, allowed: Iterable[str] = ()) -> list[Path]:
    """Write uploads (relative path, chunks) below a workspace; anything wrong removes it again and raises ValueError.

    `limit` bounds each file, or for a folder all of them together. allowed: suffixes without dots, none for any.
    """
    written, total, allowed = [], 0, set(allowed)
    try:
        for name, chunks in uploads:
            parts = [p for p in name.replace("\\", "/").split("/") if p]
            if not parts or ".." in parts or name.replace("\\", "/").startswith("/"):
                raise ValueError("path")
            if allowed and PurePosixPath(parts[-1]).suffix.lower().lstrip(".") not in allowed:
                raise ValueError("type")
            to = at.input_root.joinpath(*parts) if kind == "folder" else at.input_root / parts[-1]
            to.parent.mkdir(parents=True, exist_ok=True)
            size = 0
            with to.open("wb") as f:
                for chunk in chunks:
                    size, total = size + len(chunk), total + len(chunk)
                    if (total if kind == "folder" else size) > limit:
                        raise ValueError("size")
                    f.write(chunk)
            written.append(to)
        if not written:
            raise ValueError("empty")
    except ValueError:
        remove_workspace(at.job_id, at.input_root.parent, at.output_root.parent)
        raise
    return written


def zipped(folder: Path, below: str = "") -> bytes:
    """A ZIP file of all files below a folder."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(x for x in folder.rglob("*") if x.is_file()):
            z.write(p, str(PurePosixPath(below, *p.relative_to(folder).parts)))
    return out.getvalue()


# The store


class JobStore:
    """Jobs and users below a folder. Columns that older files lack read as null, so a schema only ever grows.

    Events of one epoch are a table: `events`, `events-1`, and so on. `state-k` is what all epochs before k come to, and
    counts from the moment its writing is complete. So a state costs a snapshot and the epochs since, and a reader
    finds the same before, during and after a compaction. As the only one that appends, a store knows the status of
    the jobs it has looked at without reading again.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.lock, self.last = threading.RLock(), 0
        self.statuses: dict[str, str | None] = {}
        for name, schema in (("events", model.JOB_EVENT), ("users", model.USER)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.root}/{name}")
        self.epoch = max(self.folders()[0])

    # the log: epochs and snapshots

    def folders(self) -> tuple[list[int], list[int]]:
        """The epochs that there are, and those before which a complete snapshot was taken (0: nothing was)."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(at)]
        epochs = [0] + [int(n.removeprefix("events-")) for n in names if n.startswith("events-")]
        taken = [int(n.removeprefix("state-")) for n in names if n.startswith("state-")]
        whole = [k for k in taken if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/state-{k}/_SUCCESS"))]
        return sorted(epochs), [0, *sorted(whole)]

    def table(self, epoch: int) -> str:
        return f"{self.root}/events-{epoch}" if epoch else f"{self.root}/events"

    def parts(self) -> tuple[DataFrame | None, DataFrame]:
        """The newest snapshot, and the events since."""
        epochs, taken = self.folders()
        rows = self.spark.read.schema(model.JOB_EVENT).parquet(*(self.table(k) for k in epochs if k >= taken[-1]))
        schema = "job_id string, " + ", ".join(f"{k} {t}" for k, t in jobs.STATE.items())
        return (self.spark.read.schema(schema).parquet(f"{self.root}/state-{taken[-1]}") if taken[-1] else None), rows

    def compact(self) -> int:
        """Fold what is there into a snapshot and return its epoch; events that come meanwhile belong to the next one.

        What the snapshot before this one was made of is removed; readers that began with that one still find it.
        """
        with self.lock:
            epochs, taken = self.folders()
            self.epoch = self.epoch + 1
            self.spark.createDataFrame([], model.JOB_EVENT).write.mode("append").parquet(self.table(self.epoch))
            before = self.spark.read.parquet(f"{self.root}/state-{taken[-1]}") if taken[-1] else None
            rows = self.spark.read.schema(model.JOB_EVENT).parquet(*(self.table(k) for k in epochs if k >= taken[-1]))
            new = self.epoch
        jobs.states(rows, before).write.mode("overwrite").parquet(f"{self.root}/state-{new}")
        for k in epochs:
            if k < taken[-1]:
                self.remove(self.table(k))
        for k in taken[1:-1]:
            self.remove(f"{self.root}/state-{k}")
        return new

    def remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def append(self, job_id: str, action: str, **fields: object) -> None:
        with self.lock:
            self.last = max(self.last + 1, time.time_ns())
            row = {f.name: None for f in model.JOB_EVENT} | {"job_id": job_id, "seq": self.last, "at": now(), "action": action} | fields
            self.spark.createDataFrame([row], model.JOB_EVENT).coalesce(1).write.mode("append").parquet(self.table(self.epoch))
            if action == "delete":
                self.statuses[job_id] = None
            elif job_id in self.statuses:
                self.statuses[job_id] = jobs.after(self.statuses[job_id], action) or self.statuses[job_id]

    # jobs

    def jobs(self) -> DataFrame:
        before, rows = self.parts()
        return jobs.latest_state(rows, before)

    def get(self, job_id: str) -> Row | None:
        """One job; the id is pushed down to the files of the snapshot and of the events since."""
        own = [t if t is None else t.where(F.col("job_id") == job_id) for t in self.parts()]
        return jobs.latest_state(own[1], own[0]).first()

    def status(self, job_id: str) -> str | None:
        """A job's status, None if there is no such job; read once, and known from then on."""
        with self.lock:
            if job_id not in self.statuses:
                if len(self.statuses) >= KNOWN:
                    self.statuses = {k: v for k, v in self.statuses.items() if v is not None and v not in TERMINAL}
                job = self.get(job_id)
                self.statuses[job_id] = None if job is None else job.status
            return self.statuses[job_id]

    def queued(self) -> list[str]:
        """Ids in queue order. The queue is what one service has not begun yet."""
        return [r.job_id for r in self.jobs().where("status = 'queued'").orderBy("created_at", "job_id").select("job_id").collect()]

    def act(self, job_id: str, action: str, **fields: object) -> bool:
        """Append an action if the job's state lets it happen. Nothing can come between the look and the entry."""
        with self.lock:
            status = self.status(job_id)
            if action in jobs.TRANSITIONS:
                fine = jobs.after(status, action) is not None
            else:
                fine = status in (("queued", *TERMINAL) if action == "delete" else TERMINAL)
            if fine:
                self.append(job_id, action, **fields)
            return fine

    def progress(self, job_id: str, **fields: object) -> None:
        self.append(job_id, "progress", **{f"progress_{k}": v for k, v in fields.items()})

    def recover(self) -> int:
        """Jobs that were running when the service went down are queued again."""
        lost = [r.job_id for r in self.jobs().where("status = 'running'").select("job_id").collect()]
        return sum(self.act(job_id, "recover") for job_id in lost)

    def expire(self, seconds: float) -> list[str]:
        """Jobs that have run for longer than this fail; their work ends at its next look."""
        start = (datetime.now(timezone.utc) - timedelta(seconds=seconds)).isoformat(timespec="seconds")
        late = [r.job_id for r in self.jobs().where((F.col("status") == "running") & (F.col("started_at") < start)).select("job_id").collect()]
        return [job_id for job_id in late if self.act(job_id, "fail", error_message=TIMED_OUT)]

    # users: the newest row of a name counts

    def users(self) -> DataFrame:
        rows = self.spark.read.schema(model.USER).parquet(f"{self.root}/users")
        return jobs.last_event(rows, "username", ["created_at", "id"])

    def add_users(self, rows: list[tuple[str, str, str]]) -> None:
        made = [(time.time_ns(), name, accounts.password_digest(password), role, datetime.now(timezone.utc)) for name, password, role in rows]
        if made:
            self.spark.createDataFrame(made, model.USER).coalesce(1).write.mode("append").parquet(f"{self.root}/users")

    def bootstrap(self, names: Iterable[str], password: str, admin: str) -> None:
        """Users that don't exist yet; the administrator is one of them."""
        wanted = sorted({n.strip() for n in names if n.strip()} | {admin.strip()})
        fresh = {r.username for r in accounts.new_users(self.spark.createDataFrame([(n,) for n in wanted], "username string"), self.users()).collect()}
        self.add_users([(n, password, "admin" if n == admin.strip() else "user") for n in wanted if n in fresh])

    def ensure_admin(self, name: str, password: str) -> None:
        """The administrator with this password, added or renewed."""
        if name.strip():
            self.add_users([(name.strip(), password, "admin")])

    def user(self, name: str) -> Row | None:
        return self.users().where(F.col("username") == name).first()

    def authenticate(self, name: str, password: str) -> Row | None:
        found = self.user(name)
        return found if found and accounts.password_fits(password, found.password_hash) else None

    def usernames(self) -> list[str]:
        return [r.username for r in jobs.owners(self.jobs()).collect()]


# Running jobs


class Cancelled(Exception):
    """Raised within a job that was cancelled meanwhile."""


class Store(Protocol):
    def get(self, job_id: str) -> Row | None: ...
    def status(self, job_id: str) -> str | None: ...
    def act(self, job_id: str, action: str, **fields: object) -> bool: ...
    def progress(self, job_id: str, **fields: object) -> None: ...
    def queued(self) -> list[str]: ...


@dataclass
class Hooks:
    """What a job's work may call: a last change to each page, progress, and whether to stop."""

    page: Callable[[str], str] = lambda body: body
    progress: Callable[[int, int], None] = lambda done, total: None
    cancelled: Callable[[], bool] = lambda: False


def percent(done: int, total: int) -> int:
    """Whole percent; work that is done page by page ends at 98, what follows takes the rest."""
    total = max(1, total)
    done = max(0, min(done, total))
    return 98 if done >= total else round(100 * done / total)


@dataclass
class Runner:
    """Runs queued jobs in order, `slots` at a time. A job's Spark work carries its id as a tag, by which it is cancelled."""

    spark: SparkSession
    store: Store
    work: Callable[[Row, Hooks], dict | None]
    slots: int = 1
    active: dict[str, str] = field(default_factory=dict)

    def hooks(self, job_id: str) -> Hooks:
        def stopped() -> bool:
            return self.store.status(job_id) != "running"

        def progress(done: int, total: int) -> None:
            if stopped():
                raise Cancelled(job_id)
            self.store.progress(job_id, percent=percent(done, total), pages_done=done, pages_total=total)

        return Hooks(progress=progress, cancelled=stopped)

    def run_one(self, job_id: str) -> str | None:
        """Claim and run one job; its last status, or None if another one took it."""
        if not self.store.act(job_id, "claim"):
            return None
        tag = f"job-{job_id}"
        self.active[job_id] = tag
        self.spark.sparkContext.addJobTag(tag)
        try:
            job = self.store.get(job_id)
            if job is None or not job.original_filename:
                self.store.act(job_id, "fail", error_message=INCOMPLETE)
            else:
                found = self.work(job, self.hooks(job_id)) or {}
                self.store.act(job_id, "succeed", **found)
        except Cancelled:
            pass
        except Exception as e:  # noqa: BLE001  a job that breaks must not take the service with it
            self.store.act(job_id, "fail", error_message=str(e) or BROKEN)
        finally:
            self.spark.sparkContext.removeJobTag(tag)
            self.active.pop(job_id, None)
        return self.store.status(job_id)

    def drain(self) -> dict[str, str | None]:
        """Run all that is queued by now."""
        ids = self.store.queued()
        with ThreadPoolExecutor(max(1, self.slots)) as pool:
            return dict(zip(ids, pool.map(self.run_one, ids), strict=True))

    def cancel(self, job_id: str) -> bool:
        """Mark a job as cancelled and end what it runs on the cluster."""
        done = self.store.act(job_id, "cancel")
        if tag := self.active.get(job_id):
            self.spark.sparkContext.cancelJobsWithTag(tag)
        return done

    def wait(self, job_id: str, poll: float = 0.25, most: float = 3600.0) -> Row | None:
        """The job once it has ended, or as it stands after `most` seconds."""
        until = time.monotonic() + most
        while self.store.status(job_id) not in TERMINAL and time.monotonic() < until:
            time.sleep(poll)
        return self.store.get(job_id)
