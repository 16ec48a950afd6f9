import random
import threading

from pyspark.sql import functions as F

from foliant import model
from foliant.operators import jobs
from foliant.plans import service

ACTIONS = [*jobs.TRANSITIONS, "progress", "delete", "nonsense", None]


def history(rng, n_jobs, n):
    rows = []
    for seq in range(n):
        fields = {"owner_username": rng.choice(["ann", "bob"]), "original_filename": f"f{seq}", "error_message": rng.choice([None, "e" * 5000]), "progress_percent": rng.choice([None, -5, 40, 300]), "progress_note": rng.choice([None, "n" * 600]), "progress_pages_done": rng.choice([None, seq]), "progress_pages_total": rng.choice([None, 9]), "result_extra": rng.choice([None, "{}"])}
        action = rng.choice(ACTIONS[:2] + ACTIONS[:-3] + ["nonsense", None]) if rng.random() < 0.97 else "delete"
        rows.append({f.name: None for f in model.JOB_EVENT} | {"job_id": f"j{rng.randrange(n_jobs)}", "seq": seq, "at": f"t{seq:04d}", "action": action} | fields)
    return rows


def slow(rows):
    """Each job's record, changed by one event after another."""
    out = {}
    for e in sorted(rows, key=lambda e: e["seq"]):
        r = out.setdefault(e["job_id"], dict.fromkeys(jobs.STATE) | {"attempt_count": 0, "deleted": False})
        if e["action"] == "delete":
            r["deleted"] = True
        elif e["action"] == "progress":
            r.update({k: e[k] for k in ("progress_percent", "progress_note", "progress_pages_done", "progress_pages_total") if e[k] is not None})
            r["progress_percent"] = None if r["progress_percent"] is None else max(0, min(100, r["progress_percent"]))
            r["progress_note"] = None if r["progress_note"] is None else r["progress_note"][:500]
        elif (to := jobs.after(r["status"], e["action"])) is not None:
            r["status"] = to
            if e["action"] in ("insert", "retry"):
                r["created_at"] = e["at"]
            if e["action"] == "insert":
                r.update(owner_username=e["owner_username"], original_filename=e["original_filename"])
            if e["action"] in ("retry", "recover"):
                r.update(started_at=None, finished_at=None)
            if e["action"] == "retry":
                r.update(dict.fromkeys(("error_message", "result_extra", "progress_percent", "progress_note", "progress_pages_done", "progress_pages_total")))
            if e["action"] == "claim":
                r.update(started_at=e["at"], attempt_count=r["attempt_count"] + 1)
            if e["action"] in ("succeed", "fail", "cancel"):
                r["finished_at"] = e["at"]
            if e["action"] == "fail":
                r["error_message"] = (e["error_message"] or "")[:4000] or None
            if e["action"] == "succeed":
                r.update(error_message=None, result_extra=e["result_extra"])
    return out


def plain(df):
    return {r.job_id: {k: r[k] for k in jobs.STATE} for r in df.collect()}


def test_states_equal_a_record_that_changes(spark):
    rows = history(random.Random(3), 60, 500)
    df = spark.createDataFrame(rows, model.JOB_EVENT)
    want = slow(rows)
    assert plain(jobs.states(df)) == want
    assert {r.status for r in jobs.latest_state(df).collect()} > {"queued", "running"}
    for cut in (0, 1, 250, 500):  # a snapshot and what came since
        early = jobs.states(df.where(F.col("seq") < cut))
        assert plain(jobs.states(df.where(F.col("seq") >= cut), early)) == want
    assert all(jobs.after(s, "claim") == ("running" if s == "queued" else None) for s in (None, *jobs.STATUSES)) and jobs.after(None, "nonsense") is None


def shown(store):
    return sorted((r.job_id, r.status, r.attempt_count, r.progress_percent) for r in store.jobs().collect())


def test_states_are_the_same_before_during_and_after_compaction(spark, tmp_path, monkeypatch):
    store = service.JobStore(spark, str(tmp_path / "store"))
    for k in range(4):
        store.append(f"j{k}", "insert", original_filename="f")
    assert store.act("j0", "claim") and store.act("j1", "cancel") and store.act("j3", "cancel") and store.act("j3", "delete")
    before = shown(store)
    assert [x[:2] for x in before] == [("j0", "running"), ("j1", "cancelled"), ("j2", "queued")]

    real, seen = jobs.states, []

    def halfway(rows, old=None):
        """The fold of a compaction, with an event that comes while it runs."""
        out = real(rows, old)
        if not seen:
            seen.append(True)
            reader = service.JobStore(spark, store.root)
            assert shown(reader) == before
            store.progress("j0", percent=50)
            assert dict((x[0], x[3]) for x in shown(reader))["j0"] == 50
        return out

    monkeypatch.setattr(jobs, "states", halfway)
    assert store.compact() == 1
    monkeypatch.setattr(jobs, "states", real)
    assert seen and shown(store) == [("j0", "running", 1, 50), *before[1:]]
    assert store.get("j0").progress_percent == 50 and store.get("j3") is None and store.get("j1").status == "cancelled"
    assert store.act("j0", "succeed", result_extra="{}") and store.act("j2", "claim")
    assert store.compact() == 2 and store.compact() == 3
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if p.name[:2] in ("ev", "st")) == ["events-2", "events-3", "state-2", "state-3"]
    assert [x[:2] for x in shown(service.JobStore(spark, store.root))] == [("j0", "succeeded"), ("j1", "cancelled"), ("j2", "running")]
    # a compaction that broke off leaves a snapshot that isn't whole: it doesn't count
    (tmp_path / "store" / "state-9").mkdir()
    again = service.JobStore(spark, store.root)
    assert again.act("j2", "fail", error_message="x") and [x[:2] for x in shown(again)][2] == ("j2", "failed")
    assert again.queued() == []


def test_looks_at_a_known_job_start_no_job_of_spark(spark, tmp_path):
    store = service.JobStore(spark, str(tmp_path / "store"))
    store.append("a", "insert", original_filename="f")
    assert store.act("a", "claim") and store.status("a") == "running"
    runner = service.Runner(spark, store, lambda job, hooks: None)
    reads = []
    store.get = lambda job_id: reads.append(job_id)
    assert not runner.hooks("a").cancelled() and store.act("a", "cancel") and runner.hooks("a").cancelled() and not reads
    assert store.status("none") is None and reads == ["none"] and store.status("none") is None and len(reads) == 1


def test_two_claims_at_once_take_a_job_once(spark, tmp_path):
    store = service.JobStore(spark, str(tmp_path / "store"))
    store.append("a", "insert", original_filename="f")
    took = []
    threads = [threading.Thread(target=lambda: took.append(store.act("a", "claim"))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(took) == [False, False, False, True] and store.get("a").attempt_count == 1


def test_a_job_that_runs_too_long_fails(spark, tmp_path, monkeypatch):
    store = service.JobStore(spark, str(tmp_path / "store"))
    for job_id in ("old", "new", "waiting"):
        store.append(job_id, "insert", original_filename="f")
    monkeypatch.setattr(service, "now", lambda: "2020-01-01T00:00:00+00:00")
    assert store.act("old", "claim")
    monkeypatch.undo()
    assert store.act("new", "claim")
    assert store.expire(3600) == ["old"] and store.expire(3600) == []
    assert {r.job_id: (r.status, r.error_message) for r in store.jobs().collect()} == {"old": ("failed", service.TIMED_OUT), "new": ("running", None), "waiting": ("queued", None)}
    assert store.status("old") == "failed" and service.Runner(spark, store, lambda job, hooks: None).hooks("old").cancelled()
