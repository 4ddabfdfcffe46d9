"""Joins of the spelling variants: their tables grow with the vocabulary, so none is broadcast, however small Spark takes it for."""

from __future__ import annotations

from skyquad.llm import spelling


def test_nothing_is_broadcast(spark, monkeypatch):
    plans, stash = [], spelling.stash

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stash(df, name)

    monkeypatch.setattr(spelling, "stash", seen)
    text = " ".join(["colour colours color harbour harbor harbors"] * 3 + ["colour color harbour"] * 9)
    found = spelling.spelling_variants(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), one_in=1 << 40)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(found.collect()) == 6
    assert len([p for p in plans if "Join" in p]) >= 4 and [p for p in plans if "Broadcast" in p] == []
