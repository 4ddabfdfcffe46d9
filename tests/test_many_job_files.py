"""Files of many jobs: made by all tasks, listed in few."""

from __future__ import annotations

from pathlib import Path

from skyquad.sinks import files


def test_files_of_few_bytes_come_from_many_tasks(spark, tmp_path):
    jobs = spark.range(60).selectExpr("CAST(id AS STRING) AS job_id", "'Queued' AS status")
    held = spark.conf.get(files._LISTING) if hasattr(files, "_LISTING") else None
    files.write_jobs(jobs, f"{tmp_path}/jobs")
    files.write_jobs(jobs.filter("job_id < 30").selectExpr("job_id", "'Success' AS status"), f"{tmp_path}/jobs")
    found = {r.job_id: r.status for r in files.read_jobs(spark, f"{tmp_path}/jobs", "status string").collect()}
    assert found == {str(i): "Success" if i < 30 else "Queued" for i in range(60)}
    names = [p.name for p in Path(f"{tmp_path}/jobs").glob("job_id=*/part-*")]
    assert len(names) == 60
    assert len({n.split("-")[1] for n in names}) == 4
    assert held == spark.conf.get(files._LISTING)
