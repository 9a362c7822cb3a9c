"""The tracker's index of free candidates against all pairs, tick by tick."""

import math
import random

import pytest

from fieldlark.operators import tracking


def plainly(state, found, now, reach, scale):
    """Entities in their order take the nearest free candidate nearer than ``reach``, the first on a tie."""
    next_id, entities = state or (1, [])
    free, kept = list(range(len(found))), []
    for e in entities:
        d, i = min(((math.hypot(e["x"] - found[i]["x"], e["y"] - found[i]["y"]), i) for i in free), default=(math.inf, -1))
        if d < reach:
            free.remove(i)
            kept.append((e["id"], found[i]["x"], found[i]["y"], e["frames_tracked"] + 1, round(0.7 * max(0.0, 1 - d * scale) + 0.3 * e["stability"], 12)))
    for i in free:
        kept.append((next_id, found[i]["x"], found[i]["y"], 1, 0.5))
        next_id += 1
    return next_id, kept


@pytest.mark.parametrize("reach", [0.4, 1.5, 50.0])
def test_tracker_against_all_pairs(reach):
    rng, state = random.Random(7), None
    for t in range(60):
        # a coarse grid of places, some below zero, so that distances tie
        found = [{"x": rng.randint(-8, 8) / 2, "y": rng.randint(-8, 8) / 2, "radius": 1.0, "activity": rng.random()} for _ in range(rng.choice([0, 1, 8, 40]))]
        want = plainly(state, found, float(t), reach, 0.5)
        state, kept = tracking.track(state, found, float(t), reach, 0.5)
        assert state[0] == want[0]
        assert [(e["id"], e["x"], e["y"], e["frames_tracked"], round(e["stability"], 12)) for e in kept] == want[1]


def test_a_candidate_at_the_reach_is_not_taken():
    state, _ = tracking.track(None, [{"x": 0.0, "y": 0.0, "radius": 1.0, "activity": 1.0}], 0.0, reach=1.5)
    _, kept = tracking.track(state, [{"x": 1.5, "y": 0.0, "radius": 1.0, "activity": 1.0}], 1.0, reach=1.5)
    assert [e["id"] for e in kept] == [2]
