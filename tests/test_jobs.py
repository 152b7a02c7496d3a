"""The queue of jobs: offsets, batches that fail and run again, claims, states."""

from __future__ import annotations

import json

from pyspark.errors import StreamingQueryException

from rimflow.streaming import jobs


def submitted(path):
    def poll(first, limit):
        with open(path) as f:
            return [tuple(j) for j in json.load(f) if j[0] >= first][:limit]

    return poll


def test_a_failed_batch_is_claimed_again_and_no_job_twice(spark, tmp_path):
    queue, folder, log = f"{tmp_path}/queue.json", f"file://{tmp_path}/claims", []
    rows = [(n, 100 + n % 7, "analyze" if n % 3 == 0 else "scan", 50 - n) for n in range(12)]  # some jobs are handed in twice
    with open(queue, "w") as f:
        json.dump(rows, f)
    spark.dataSource.register(jobs.job_source("jobs_of_test", submitted(queue), limit=5))
    broken = [1]

    def work(mine, batch):
        log.append((batch, [r["job_id"] for r in mine.collect()]))
        if batch in broken:
            broken.remove(batch)
            raise ValueError("the worker is gone")

    def run():
        q = spark.readStream.format("jobs_of_test").load().writeStream.foreachBatch(jobs.claiming(folder, work)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.processAllAvailable() if not q.isActive else q.awaitTermination(120)

    for _ in range(4):
        try:
            run()
        except StreamingQueryException:
            pass
    assert not broken
    claimed = jobs.claims(spark, folder).collect()
    assert sorted(r["job_id"] for r in claimed) == sorted({j for _, j, *_ in rows})
    again = [ids for b, ids in log if b == 1]
    assert len(again) == 2 and again[0] == again[1]  # the same jobs in the same order
    done = {b: ids for b, ids in log}
    assert sorted(j for ids in done.values() for j in ids) == sorted({j for _, j, *_ in rows})
    first = sorted((r for r in claimed if r["batch"] == 0), key=lambda r: r["place"])
    assert [r["kind"] for r in first] == sorted((r["kind"] for r in first)) and [r["created_at"] for r in first if r["kind"] == "scan"] == sorted(r["created_at"] for r in first if r["kind"] == "scan")


def test_states_follow_their_order(spark):
    rows = [(1, 1, "detecting"), (1, 2, "selecting"), (1, 3, "completed"), (1, 4, "analyzing"), (2, 2, "failed"), (2, 3, "detecting"), (3, 1, "analyzing")]
    got = {r["job_id"]: (r["status"], r["ignored"]) for r in jobs.latest_states(spark.createDataFrame(rows, "job_id long, at long, status string")).collect()}
    assert got == {1: ("analyzing", 1), 2: ("failed", 1), 3: ("uploaded", 1)}
