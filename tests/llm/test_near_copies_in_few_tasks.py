"""Each task leaves files, logs and events behind: what components start per shuffle partition is bounded."""

from __future__ import annotations

import random

from skyquad.llm.components import components

PARTS = 16


def tasks_of(spark, run):
    """The result of ``run``, and how many tasks of full stages it took with ``PARTS`` shuffle partitions that stay."""
    held = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    store = spark.sparkContext._jsc.sc().statusStore()
    name = f"tasks-{random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext._jsc.clearJobGroup()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(store.lastStageAttempt(s).numCompleteTasks() for s in stages)


def test_components_of_a_chain_take_few_tasks(spark):
    chain = [(i, i + 1) for i in range(40)]
    edges = spark.createDataFrame(chain, "a long, b long")
    found, tasks = tasks_of(spark, lambda: {tuple(r) for r in components(edges).collect()})
    assert found == {(i, 0) for i in range(1, 41)}
    assert tasks <= 40 * PARTS, tasks
