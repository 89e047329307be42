"""The cut detector against a plain loop over each content's frames."""

import random

import pytest
from framewise.operators import cuts


def _plain(scores, ratio, least, width, gap):
    out, last = [], 0
    for i in range(width, len(scores) - width):
        near = scores[i - width : i] + scores[i + 1 : i + 1 + width]
        mean = sum(near) / len(near)
        times = 255.0 if abs(mean) < 1e-5 else min(255.0, scores[i] / mean)
        if scores[i] >= least and times >= ratio and i - last >= gap:
            out.append(i)
            last = i
    return [0, *out, len(scores)]


@pytest.mark.parametrize("chunk,gap,width", [(16, 15, 2), (64, 5, 3), (4096, 15, 2), (7, 15, 1)])
def test_equals_a_plain_loop(spark, chunk, gap, width):
    rng = random.Random(chunk)
    contents = {"a": [rng.choice([1.0, 2.0, 3.0, 40.0]) for _ in range(700)], "b": [0.0] * 300, "c": [5.0], "d": [0.0, 0.0, 90.0, 0.0, 0.0] * 30, "e": [1.0] * 20 + [50.0] + [1.0] * 400 + [60.0] + [1.0] * 30}
    rows = [(c, i, s, "x") for c, scores in contents.items() for i, s in enumerate(scores)]
    rng.shuffle(rows)
    frames = spark.createDataFrame(rows, "content_id string, frame int, score double, chunk string").repartition(3)
    found = {}
    for r in cuts.scenes(frames, gap=gap, width=width, chunk=chunk).orderBy("scene_id").collect():
        found.setdefault(r.content_id, []).append((r.scene_id, r.start_frame, r.end_frame))
    for c, scores in contents.items():
        edges = _plain(scores, cuts.RATIO, cuts.LEAST, width, gap)
        assert found[c] == [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:]))], c


def test_no_frames(spark):
    assert cuts.scenes(spark.createDataFrame([], "content_id string, frame int, score double")).collect() == []
