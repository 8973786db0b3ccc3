"""Import jobs: at once, observed, cancelled while they run, and listed by another session."""

import time

from pyspark.sql import functions as F

from tessera.sources import jobs


def test_batches_run_at_once_and_are_observed(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("k"), "id")
    known = jobs.Jobs(spark, str(tmp_path / "jobs"), workers=3)
    n = iter(range(99))
    job = known.start("numbers", jobs.batches_of(rows, lambda d: d.write.parquet(str(tmp_path / f"out{next(n)}")), 5, "k", F.col("id") % 10 == 0), 1000)
    done = known.wait(job.number, 120)
    assert (done.state, done.processed, done.failed, done.errors) == ("completed", 900, 100, [])
    assert spark.read.parquet(str(tmp_path / "out*")).count() == 1000

    def broken():
        raise ValueError("no such file")

    other = known.start("broken", [broken, lambda: (3, 0)], 4)
    assert known.wait(other.number, 60).status() == {"number": 2, "state": "completed", "total": 4, "processed": 3, "failed": 0, "percent": 75.0, "errors": ["ValueError: no such file"]}
    # another session lists them and goes on counting
    later = jobs.Jobs(spark, str(tmp_path / "jobs"))
    assert [(j["number"], j["state"], j["processed"]) for j in later.latest()] == [(2, "completed", 3), (1, "completed", 900)]
    assert later.create("more").number == 3 and [j["number"] for j in known.latest(1)] == [3]
    assert known.stale(-1) == [3] and later.latest(1)[0]["errors"] == ["its session ended"]
    assert later.clean(-1) == 3 and jobs.Jobs(spark, str(tmp_path / "jobs")).latest() == []


def test_cancel_stops_a_running_batch(spark, tmp_path):
    def slow(batches):
        for b in batches:
            time.sleep(60)
            yield b

    known = jobs.Jobs(spark, str(tmp_path / "jobs"), workers=2)
    ran = []

    def batch(i):
        def run():
            ran.append(i)
            return spark.range(4).mapInArrow(slow, "id long").count(), 0

        return run

    job = known.start("slow", [batch(i) for i in range(4)])
    while len(ran) < 2 or not spark.sparkContext.statusTracker().getActiveJobsIds():
        time.sleep(0.2)
    time.sleep(1)
    began = time.time()
    assert known.cancel(job.number) and not known.cancel(job.number)
    assert known.wait(job.number, 40).state == "cancelled" and not known._running[job.number].is_alive()
    assert time.time() - began < 50 and sorted(ran) == [0, 1] and job.processed == 0
    assert spark.range(5).count() == 5  # other jobs go on
    assert jobs.Jobs(spark, str(tmp_path / "jobs")).latest()[0]["state"] == "cancelled"
