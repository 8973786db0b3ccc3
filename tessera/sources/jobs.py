"""Import jobs: batches that run at once, counts from the batches' own metrics, cancelling by job tag, and a table of what was asked and how far it is."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.sources.sinks import Versions

STATES = ("pending", "processing", "completed", "failed", "cancelled")
TABLE = "number long, source string, state string, total long, processed long, failed long, errors string, began double, ended double, session string"


@dataclass
class Job:
    number: int
    source: str
    state: str = "pending"
    total: int = 0
    processed: int = 0
    failed: int = 0
    errors: list[str] = field(default_factory=list)
    began: float = field(default_factory=time.time)
    ended: float | None = None

    def status(self) -> dict:
        """Counts, percent and the last ten errors."""
        return {"number": self.number, "state": self.state, "total": self.total, "processed": self.processed, "failed": self.failed, "percent": round(100 * self.processed / self.total, 1) if self.total else 0.0, "errors": self.errors[-10:]}


class Jobs:
    """Runs imports; an import is a number of batches, each a function that writes and gives (done, failed).

    run() runs a job's batches one after the other; start() returns at once and runs up to `workers` of them at a time, each as Spark jobs under the job's tag, so
    that cancel() stops those that are running too. With a path, jobs are rows of a versioned table that each change of a job is written to: another session lists
    them, and numbers go on from it. A job whose session has ended stays as it was until stale() marks it.
    """

    def __init__(self, spark: SparkSession | None = None, path: str | None = None, workers: int = 4):
        self.spark, self.workers, self.known = spark, workers, {}
        self.table = Versions(spark, path, "number", tries=20) if path else None
        self._lock, self._running = threading.RLock(), {}
        for job in self._stored():
            self.known[job.number] = job

    def _stored(self) -> list[Job]:
        if self.table is None or not self.table.numbers():
            return []
        return [Job(r.number, r.source, r.state, r.total, r.processed, r.failed, json.loads(r.errors), r.began, r.ended) for r in self.table.read().collect()]  # jobs are few

    def _note(self, job: Job) -> None:
        if self.table is not None:
            row = (job.number, job.source, job.state, job.total, job.processed, job.failed, json.dumps(job.errors[-10:]), job.began, job.ended, self.spark.sparkContext.applicationId)
            self.table.change(self.spark.createDataFrame([row], TABLE).coalesce(1))

    def create(self, source: str, total: int = 0) -> Job:
        with self._lock:
            for job in self._stored():  # what other sessions have made meanwhile
                self.known.setdefault(job.number, job)
            job = Job(max(self.known, default=0) + 1, source, total=total)
            self.known[job.number] = job
            self._note(job)
        return job

    @staticmethod
    def tag(job: Job) -> str:
        return f"import-job-{job.number}"

    def _one(self, job: Job, batch: Callable[[], tuple[int, int]]) -> None:
        """One batch of a job that isn't cancelled; its failure is told by the job, and the others go on."""
        with self._lock:
            if job.state == "cancelled":
                return
        try:
            done, failed = batch()
        except Exception as e:
            with self._lock:
                if job.state != "cancelled":
                    job.errors.append(f"{type(e).__name__}: {str(e)[:500]}")
                    self._note(job)
            return
        with self._lock:
            job.processed += done
            job.failed += failed
            self._note(job)

    def _ended(self, job: Job) -> Job:
        with self._lock:
            if job.state == "processing":
                job.state = "failed" if job.errors and not job.processed else "completed"
            job.ended = time.time()
            self._note(job)
        return job

    def _began(self, job: Job) -> None:
        with self._lock:
            if job.state == "pending":
                job.state = "processing"
                self._note(job)

    def run(self, job: Job, batches: Iterable[Callable[[], tuple[int, int]]]) -> Job:
        self._began(job)
        for batch in batches:
            self._one(job, batch)
        return self._ended(job)

    def start(self, source: str, batches: list[Callable[[], tuple[int, int]]], total: int = 0) -> Job:
        """Creates a job and runs its batches in the background; wait() waits for its end."""
        job = self.create(source, total)
        sc = self.spark.sparkContext

        def tagged(batch):
            sc.addJobTag(self.tag(job))
            try:
                self._one(job, batch)
            finally:
                sc.removeJobTag(self.tag(job))

        def all_of_it():
            self._began(job)
            with ThreadPoolExecutor(self.workers) as pool:  # a pool of the job's own, so jobs never wait for each other's threads
                list(pool.map(inheritable_thread_target(self.spark)(tagged), batches))
            self._ended(job)

        thread = threading.Thread(target=inheritable_thread_target(self.spark)(all_of_it), daemon=True)
        self._running[job.number] = thread
        thread.start()
        return job

    def wait(self, number: int, seconds: float | None = None) -> Job:
        if number in self._running:
            self._running[number].join(seconds)
        return self.known[number]

    def cancel(self, number: int) -> bool:
        """Cancels a job that hasn't ended: no further batch begins, and the running ones' Spark jobs are stopped."""
        with self._lock:
            job = self.known.get(number)
            if job is None or job.state not in ("pending", "processing"):
                return False
            job.state = "cancelled"
        if self.spark is not None:
            self.spark.sparkContext.cancelJobsWithTag(self.tag(job))
        with self._lock:
            self._note(job)  # now that there is room to write
        return True

    def latest(self, n: int = 20) -> list[dict]:
        with self._lock:
            for job in self._stored():
                if job.number not in self._running:
                    self.known[job.number] = job
        return [j.status() for j in sorted(self.known.values(), key=lambda j: -j.number)[:n]]

    def stale(self, hours: float = 1.0) -> list[int]:
        """Marks jobs of other sessions that began more than hours ago and haven't ended as failed; gives their numbers."""
        out = []
        for job in self._stored():
            if job.number not in self._running and job.state in ("pending", "processing") and time.time() - job.began > hours * 3600:
                job.state, job.ended = "failed", time.time()
                job.errors.append("its session ended")
                self.known[job.number] = job
                self._note(job)
                out.append(job.number)
        return out

    def clean(self, hours: float = 24.0, now: float | None = None) -> int:
        """Forgets jobs that ended more than hours ago."""
        now = time.time() if now is None else now
        old = [k for k, j in self.known.items() if j.ended is not None and now - j.ended > hours * 3600]
        for k in old:
            del self.known[k]
        if old and self.table is not None:
            self.table.remove(self.spark.createDataFrame([(k,) for k in old], "number long"))
        return len(old)


def batches_of(rows: DataFrame, write: Callable[[DataFrame], None], number: int, key: str, bad=None) -> list[Callable[[], tuple[int, int]]]:
    """number batches of a table of records by a hash of their key: each writes its rows and tells how many it has written, and how many of them a
    predicate calls bad. The counts are observed while the rows are written, so they cost no job of their own."""

    def one(i: int):
        def run() -> tuple[int, int]:
            seen = Observation()
            own = rows.where(F.pmod(F.xxhash64(key), F.lit(number)) == i)
            write(own.observe(seen, F.count("*").alias("n"), F.count(F.when(F.lit(False) if bad is None else bad, 1)).alias("bad")))
            got = seen.get
            return got["n"] - got["bad"], got["bad"]

        return run

    return [one(i) for i in range(number)]


def throughput(batches: DataFrame) -> DataFrame:
    """One row from (records, memories, failed, seconds): sums, rates, share of successes, batch times."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rate = lambda c: F.coalesce(F.try_divide(F.sum(c), F.sum("seconds")), F.lit(0.0))
    return batches.agg(F.count("*").alias("batches"), s("records").alias("records"), s("memories").alias("memories"), rate("records").alias("records_per_s"), rate("memories").alias("memories_per_s"), F.coalesce(F.try_divide(100.0 * (F.sum("records") - F.sum("failed")), F.sum("records")), F.lit(0.0)).alias("success_pct"), F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("avg_batch_s"), F.max("seconds").alias("max_batch_s"))
