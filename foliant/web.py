"""The service's routes without a server: a request in, a code and a body out. Any HTTP server can sit in front.

`App.handle` reads the token or the session, checks who may do what, and calls the store and the runner.
"""

from __future__ import annotations

import io
import json
import re
import shutil
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Row

from foliant import config
from foliant.operators import accounts, jobs
from foliant.plans import service

JOB_ID = re.compile("[a-f0-9]{32}")
MOST_DOWNLOADS = 500
BOOTSTRAP_PAGE = 100


class HttpError(Exception):
    def __init__(self, code: int, detail: str) -> None:
        super().__init__(detail)
        self.code, self.detail = code, detail


@dataclass
class Request:
    method: str
    path: str
    query: dict[str, str] = field(default_factory=dict)
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""
    #: (relative path, chunks) of uploaded files.
    files: list[tuple[str, list[bytes]]] = field(default_factory=list)
    session: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class User:
    username: str
    role: str

    @property
    def is_admin(self) -> bool:
        return self.role == "admin"


@dataclass
class App:
    store: service.JobStore
    runner: service.Runner
    settings: config.Settings
    input_dir: Path
    output_dir: Path
    secret: str
    external: bool = False
    #: Of an external login: (username, password) to a user, or None.
    external_login: Callable[[str, str], User | None] | None = None
    token_seconds: int = 8 * 3600
    index: str = "<!doctype html><title>foliant</title>"

    def handle(self, r: Request) -> tuple[int, object]:
        """(code, body): a dict is JSON, bytes a ZIP file, text HTML."""
        for method, pattern, route in ROUTES:
            if method == r.method and (found := re.fullmatch(pattern, r.path)):
                try:
                    return 200, route(self, r, *found.groups())
                except HttpError as e:
                    return e.code, {"detail": e.detail}
        return 404, {"detail": "not found"}

    # who asks

    def user(self, r: Request) -> User:
        """A bearer token goes before the session. An external login's session is trusted, a local one's user is read again."""
        header = r.headers.get("Authorization", "")
        if header.startswith("Bearer ") and (raw := header[7:].strip()):
            found = accounts.token_user(raw, self.secret) if raw.count(".") == 2 else None
            if found is None:
                raise HttpError(401, "the token is not valid or has expired")
            return User(*found)
        name = r.session.get("username")
        if not name:
            raise HttpError(401, "not logged in")
        if self.external and r.session.get("role") in ("admin", "user"):
            return User(name.strip(), r.session["role"])
        row = None if self.external else self.store.user(name)
        if row is None:
            r.session.clear()
            raise HttpError(401, "the session has ended")
        return User(row.username, row.role)

    def job(self, r: Request, raw: str, action: str) -> tuple[User, Row]:
        """The job that a user may act on; the codes are those of jobs.action_code()."""
        user, own = self.user(r), raw.strip()
        if not JOB_ID.fullmatch(own):
            raise HttpError(400, "no job id")
        job = self.store.get(own)
        if job is None:
            raise HttpError(404, "no such job")
        if not (user.is_admin or job.owner_username == user.username):
            raise HttpError(403, "not your job")
        if action == "download" and job.status != "succeeded":
            raise HttpError(400, "the job has no result")
        before = {"cancel": ("queued", "running"), "retry": service.TERMINAL, "delete": ("queued", *service.TERMINAL)}.get(action)
        if before and job.status not in before:
            raise HttpError(409, f"the job is {job.status}")
        return user, job

    # open routes

    def home(self, r: Request) -> str:  # noqa: ARG002
        return self.index

    def health(self, r: Request) -> dict:  # noqa: ARG002
        return {"status": "ok"}

    def public_config(self, r: Request) -> dict:  # noqa: ARG002
        return {"allowed_types": sorted(self.settings.allowed_types), "max_file_size_bytes": self.settings.max_file_size}

    def login(self, r: Request) -> dict:
        asked = json.loads(r.body or b"{}")
        name, password = str(asked.get("username", "")).strip(), str(asked.get("password", ""))
        user = None
        if self.external and self.external_login:
            user = self.external_login(name, password)
        if user is None and (row := self.store.authenticate(name, password)):
            user = User(row.username, row.role)
        if user is None:
            raise HttpError(401, "wrong name or password")
        r.session.update(username=user.username, role=user.role)
        token = accounts.token(user.username, user.role, self.secret, self.token_seconds)
        return {"username": user.username, "role": user.role, "access_token": token, "token_type": "bearer", "expires_in": self.token_seconds}

    def logout(self, r: Request) -> dict:
        r.session.clear()
        return {"message": "ok"}

    # routes of a user

    def me(self, r: Request) -> dict:
        user = self.user(r)
        return {"username": user.username, "role": user.role}

    def listed(self, user: User, owner: str | None, status: str | None, query: str | None, page: int, size: int) -> dict:
        every = self.store.jobs()
        shown = jobs.visible(every, user.username, user.role, owner, status, query)
        rows = jobs.page(shown, page, size).join(jobs.queue_positions(every), "job_id", "left")
        counts = {c.status: c.n for c in jobs.status_counts(jobs.visible(every, user.username, user.role, owner, None, query)).collect()}
        found = jobs.api_rows(rows).collect()  # one page
        order = {x.job_id: k for k, x in enumerate(jobs.page(shown, page, size).select("job_id").collect())}
        items = [x.asDict(True) for x in sorted(found, key=lambda x: order[x.job_id])]
        return {"items": items, "page": page, "page_size": min(size, jobs.PAGE_LIMIT), "total": shown.count(), "counts": counts}

    def job_list(self, r: Request) -> dict:
        user, q = self.user(r), r.query
        page, size = int(q.get("page", 1)), int(q.get("page_size", 20))
        if page < 1 or not 1 <= size <= 500:
            raise HttpError(422, "page or page_size is out of range")
        return self.listed(user, q.get("owner") if user.is_admin else None, q.get("status"), q.get("q"), page, size)

    def bootstrap(self, r: Request) -> dict:
        user = self.user(r)
        return {"user": {"username": user.username, "role": user.role}, "jobs": self.listed(user, None, None, None, 1, BOOTSTRAP_PAGE)}

    def usernames(self, r: Request) -> dict:
        if not self.user(r).is_admin:
            raise HttpError(403, "for administrators")
        return {"usernames": self.store.usernames()}

    def create(self, r: Request) -> dict:
        user, kind = self.user(r), r.query.get("upload_kind", "file")
        name = r.query.get("root_name") or (r.files[0][0] if r.files else "")
        at = service.workspace(self.input_dir, self.output_dir, name, kind == "folder")
        try:
            service.ingest(at, r.files, kind, self.settings.max_file_size, self.settings.allowed_types)
        except ValueError as e:
            raise HttpError(413 if str(e) == "size" else 400, f"upload: {e}") from None
        self.store.append(at.job_id, "insert", owner_username=user.username, original_filename=at.input_entry.name if kind == "folder" else name)
        job = self.store.get(at.job_id)
        return {"job_id": at.job_id, "status": job.status, "created_at": job.created_at}

    def detail(self, r: Request, raw: str) -> dict:
        _, job = self.job(r, raw, "detail")
        every = self.store.jobs()
        row = every.where(every.job_id == job.job_id).join(jobs.queue_positions(every), "job_id", "left")
        return jobs.api_rows(row).first().asDict(True)

    def cancel(self, r: Request, raw: str) -> dict:
        _, job = self.job(r, raw, "cancel")
        self.runner.cancel(job.job_id)
        return {"message": "ok"}

    def retry(self, r: Request, raw: str) -> dict:
        _, job = self.job(r, raw, "retry")
        shutil.rmtree(self.output_dir / job.job_id, ignore_errors=True)
        self.store.act(job.job_id, "retry")
        return {"message": "ok"}

    def delete(self, r: Request, raw: str) -> dict:
        _, job = self.job(r, raw, "delete")
        self.store.append(job.job_id, "delete")
        service.remove_workspace(job.job_id, self.input_dir, self.output_dir)
        return {"message": "ok"}

    def folder(self, job: Row) -> Path:
        at = self.output_dir / job.job_id
        if not at.is_dir():
            raise HttpError(404, "the result is gone")
        return at

    def download(self, r: Request, raw: str) -> bytes:
        _, job = self.job(r, raw, "download")
        return service.zipped(self.folder(job))

    def batch_download(self, r: Request) -> bytes:
        """The results of several jobs, each in a folder of its own; ids asked twice count once."""
        ids = list(dict.fromkeys(str(x).strip() for x in json.loads(r.body or b"{}").get("job_ids") or []))
        self.user(r)
        if not 1 <= len(ids) <= MOST_DOWNLOADS:
            raise HttpError(400, f"1 to {MOST_DOWNLOADS} jobs")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for raw in ids:
                _, job = self.job(r, raw, "download")
                top, own = self.folder(job), f"{Path(job.original_filename).stem or 'result'}_{job.job_id[:8]}"
                for p in sorted(x for x in top.rglob("*") if x.is_file()):
                    z.write(p, f"{own}/{p.relative_to(top).as_posix()}")
        return out.getvalue()

    def convert(self, r: Request) -> dict:
        """One file, waited for: the way of older clients."""
        made = self.create(r)
        self.runner.run_one(made["job_id"])
        job = self.runner.wait(made["job_id"])
        if job is None or job.status != "succeeded":
            raise HttpError(500, (job.error_message if job else None) or "the conversion failed")
        return {"job_id": job.job_id, "filename": f"{Path(job.original_filename).stem}.md", "download_url": f"/download/{job.job_id}"}


_ID = "([^/]+)"
ROUTES: list[tuple[str, str, Callable[..., object]]] = [
    ("GET", "/", App.home),
    ("GET", "/health", App.health),
    ("GET", "/app/config", App.public_config),
    ("POST", "/auth/login", App.login),
    ("POST", "/auth/logout", App.logout),
    ("GET", "/auth/me", App.me),
    ("GET", "/auth/bootstrap", App.bootstrap),
    ("GET", "/auth/users", App.usernames),
    ("POST", "/jobs", App.create),
    ("GET", "/jobs", App.job_list),
    ("POST", "/jobs/batch-download", App.batch_download),
    ("GET", f"/jobs/{_ID}", App.detail),
    ("POST", f"/jobs/{_ID}/cancel", App.cancel),
    ("POST", f"/jobs/{_ID}/retry", App.retry),
    ("DELETE", f"/jobs/{_ID}", App.delete),
    ("GET", f"/jobs/{_ID}/download", App.download),
    ("POST", "/convert", App.convert),
    ("GET", f"/download/{_ID}", App.download),
]
