"""Large groups of near copies: what the joins of the near-dedup stage hand on grows with a group's size."""

from __future__ import annotations

import random

from test_near_copies import brute_kept

from skyquad.llm import near_copies


def group(size):
    """Copies of one text of 300 words, each with four words of its own in other places: few pairs are similar,
    those with places close to each other, and many more are nearly so."""
    rng = random.Random(5)
    texts = {}
    for i in range(size):
        words = [f"w{k}" for k in range(300)]
        for n, at in enumerate(rng.sample(range(300), 4)):
            words[at] = f"own{i}x{n}"
        texts[i] = " ".join(words)
    return texts


def joined_rows(spark, run):
    """The result of ``run``, and the rows that came out of the joins on a shingle with a condition on both components."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    total, runs = 0, store.executionsList(before, store.executionsCount() - before)
    for i in range(runs.size()):
        run_id = runs.apply(i).executionId()
        nodes, values = store.planGraph(run_id).allNodes(), store.executionMetrics(run_id)
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if "Join" not in node.name() or "bit_count" not in node.desc():
                continue
            for m in range(node.metrics().size()):
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return out, total


def test_joined_rows_grow_with_a_group_and_not_with_its_square(spark):
    made = {}
    for size in (200, 800):
        texts = group(size)
        docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
        marks, made[size] = joined_rows(spark, lambda docs=docs: near_copies.near_components(docs).collect())
        assert {r.doc_id for r in marks if r.stays} == brute_kept(texts)
    assert 0 < made[800] < 6 * made[200], made


def test_a_row_meets_a_pivot_once_however_many_shingles_they_share(spark):
    """All texts are similar to each other and share most of their 120 first shingles."""
    rng = random.Random(7)
    texts = {}
    for i in range(150):
        words = [f"w{k}" for k in range(600)]
        for n, at in enumerate(rng.sample(range(600), 3)):
            words[at] = f"own{i}x{n}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    marks, made = joined_rows(spark, lambda: near_copies.near_components(docs).collect())
    assert {r.doc_id for r in marks if r.stays} == brute_kept(texts)
    assert made <= sum(near_copies.PIVOTS) * len(texts), made
