"""Representatives against a plain loop over each content."""

import random

import numpy as np
import pytest
from framewise.operators import clusters


def _plain(content, rows, x, k, starts, seed=42):
    if len(rows) <= k:
        return set(rows)
    found = []
    for s in range(starts):
        c = clusters.drawn(x, k, content, s, seed)
        for _ in range(clusters.ROUNDS):
            label = np.array([min(range(k), key=lambda j: (round(float(((v - c[j]) ** 2).sum()), 9), j)) for v in x])
            new = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
            done = np.abs(new - c).max() <= 1e-9
            cost, c = sum(float(((v - c[j]) ** 2).sum()) for v, j in zip(x, label, strict=True)), new
            if done:
                break
        found.append((round(cost, 9), s, c))
    _, _, c = min(found, key=lambda f: f[:2])
    label = np.array([min(range(k), key=lambda j: (round(float(((v - c[j]) ** 2).sum()), 9), j)) for v in x])
    return {min((r for r, l in zip(rows, label, strict=True) if l == j), key=lambda r: (-round(float(x[rows.index(r)] @ c[j] / max(np.linalg.norm(c[j]), 1e-8)), 9), r)) for j in set(label)}


@pytest.mark.parametrize("dealt", [1, 5])
def test_equals_a_plain_loop(spark, dealt, monkeypatch):
    rng = np.random.default_rng(2)
    sizes = {"a": 90, "b": 40, "c": 3, "d": 12, "e": 30}
    data, row = [], 0
    for content, n in sizes.items():
        middle = rng.standard_normal((5, 6)) * 4
        for i in range(n):
            v = middle[i % 5] + 0.3 * rng.standard_normal(6) if content != "e" else np.ones(6)  # equal vectors
            data.append((content, row, v.astype(np.float32).tolist(), "x"))
            row += 1
    random.Random(1).shuffle(data)
    shots = spark.createDataFrame([*data, ("a", 10_000, None, "x")], "content_id string, row long, v array<float>, part string").repartition(dealt)
    monkeypatch.setattr(clusters, "GROUP_SHOTS", 4_096 if dealt == 1 else 25)  # groups are dealt on the driver's side
    found: dict = {}
    for r in clusters.representatives(shots, 5, starts=3).collect():
        found.setdefault(r.content_id, set()).add(r.row)
    for content in sizes:
        own = sorted((r, v) for c, r, v, _ in data if c == content)
        assert found[content] == _plain(content, [r for r, _ in own], np.array([v for _, v in own], np.float64), 5, 3), content


def test_no_shots(spark):
    assert clusters.representatives(spark.createDataFrame([], "content_id string, row long, v array<float>"), 4).collect() == []
