"""Whole scores of the toxicity operator against the model written out by its definition."""

from __future__ import annotations

import math
import random
from functools import lru_cache

import numpy as np
import pytest

from skyquad.llm import toxicity


def model_by_definition(rows):
    """A function from a text to its score. ``rows``: text, toxic, fold of the training documents."""
    base = sum(y for _, y, _ in rows) / len(rows)
    known = [(set(toxicity._words(t.lower())), y, f) for t, y, f in rows]
    every = set().union(*(w for w, _, _ in known))

    @lru_cache(maxsize=None)
    def rate(feature, size, folds):
        """Of a whole word (size 0) or of a prefix, with that of the next shorter one as its prior."""
        shorter = [n for n in toxicity.PREFIXES if n < size] if size else [n for n in toxicity.PREFIXES if n <= len(feature)]
        prior = rate(feature[: max(shorter)], max(shorter), folds) if shorter else base
        has = [(y, feature in ws if not size else any(w.startswith(feature) for w in ws)) for ws, y, f in known if f in folds]
        return (sum(y for y, h in has if h) + toxicity.STRENGTH * prior) / (sum(h for _, h in has) + toxicity.STRENGTH)

    @lru_cache(maxsize=None)
    def weight(word, folds):
        if word in every:
            r = rate(word, 0, folds)
        else:
            sizes = [n for n in toxicity.PREFIXES if len(word) >= n and any(w.startswith(word[:n]) for w in every)]
            if not sizes:
                return 0.0
            r = rate(word[: max(sizes)], max(sizes), folds)
        return math.log(r / (1 - r)) - math.log(base / (1 - base))

    def scanned(text, folds):
        words, times, values = toxicity._words(text.lower()), {}, []
        for w in words:
            v = weight(w, folds) - toxicity.DRIFT
            if v > 0:
                times[w] = times.get(w, 0) + 1
                v = weight(w, folds) / times[w] - toxicity.DRIFT
            values.append(v)
        sums = np.concatenate([[0.0], np.cumsum(values)])

        def best(lo, hi):
            """The best segment of a stretch, then those of what is left and right of it."""
            top = max(((sums[b] - sums[a], a - b, -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
            if top is None or top[0] <= 1e-9:
                return []
            return best(lo, top[3]) + [top[0]] + best(top[4], hi)

        return len(words), best(0, len(words))

    found = [(y, *scanned(t, (1 - f,))) for t, y, f in rows]
    clean = [(max(n, 1), max(s, default=0.0)) for y, n, s in found if not y]
    n, x = (np.array(c, dtype=float) for c in zip(*clean))
    likelihood = lambda r: len(n) * math.log(r * len(n) / (n * np.exp(-r * x)).sum()) - r * x.sum()
    low, high = 0.05, 20.0
    for _ in range(12):  # ever finer grids
        grid = np.linspace(low, high, 50)
        at = int(np.argmax([likelihood(r) for r in grid]))
        low, high = grid[max(at - 1, 0)], grid[min(at + 1, 49)]
    lam = (low + high) / 2
    scale = len(n) / (n * np.exp(-lam * x)).sum()
    evidence = lambda n, s: sum(max(0.0, lam * v - math.log(max(scale * max(n, 1), 1e-12))) for v in s)
    e = np.array([evidence(n, s) for _, n, s in found])
    y = np.array([y for y, _, _ in found], dtype=float)
    design = np.stack([np.ones(len(e)), e > 0, np.log1p(e) * (e > 0)], axis=1).astype(float)
    w = np.zeros(3)
    for _ in range(20_000):  # the minimum of log loss and a weak ridge, by plain descent
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w -= 0.5 / len(y) * (design.T @ (p - y) + 0.05 * w)
    a, b, c = w[0], w[1], max(w[2], 0.0)

    def score(text):
        got = evidence(*scanned(text or "", (0, 1)))
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + (b + c * math.log1p(got) if got > 0 else 0.0)))))
        return p if got > 0 else min(p, toxicity.NO_EVIDENCE)

    return score


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_by_definition(spark, seed):
    rng = random.Random(seed)
    plain, bad = [f"plain{chr(97 + i % 26)}{i}" for i in range(60)], [f"nasty{i}" for i in range(6)] + ["foul", "fouler"]
    texts, toxic = [], []
    for _ in range(160):
        words = [rng.choice(plain) for _ in range(rng.randint(0, 30))]
        toxic.append(int(rng.random() < 0.3))
        if toxic[-1]:
            at = rng.randrange(len(words) + 1)
            words[at:at] = [rng.choice(bad) for _ in range(rng.randint(1, 6))]
        elif rng.random() < 0.2:
            words.append(rng.choice(bad))
        texts.append(" ".join(words))
    texts += ["nastyunknown plainzz9", "", "foulest " * 9, "NASTY1 nasty2, Foul!"]
    docs = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    rows = [tuple(r) for r in toxicity._training_rows(docs, labels, toxicity.TRAIN_DOCS).collect()]
    assert 90 < len(rows) < 150
    score = model_by_definition(rows)
    found = toxicity.score_documents(docs, labels).collect()
    assert len(found) == len(texts) + 1 and len({round(r.score, 3) for r in found}) > 20
    for r in found:
        want = score(texts[r.doc_id] if r.doc_id < len(texts) else None)
        assert r.score == pytest.approx(want, abs=5e-3), r.doc_id
        assert r.predicted == int(r.score >= 0.5)
