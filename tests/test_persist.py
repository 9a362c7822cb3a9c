"""Fields stepped as strips of cells against the step of one cell."""

import random

from fieldlark.config import ServerConfig
from fieldlark.operators import fusion


def test_strips_against_single_cells(spark):
    rng, c = random.Random(5), ServerConfig()
    rows = []
    for room in ("a", "b", None):
        for t in range(40):
            for i in range(6):
                for j in range(5):
                    if (i + j + t) % 7 or i < 3:  # some cells miss some ticks
                        rows.append((room, t / 4, i, j, rng.choice([0.0, 0.05, 0.3, 1.0]), rng.random()))
    df = spark.createDataFrame(rows, "room string, ts double, i int, j int, value double, confidence double").repartition(3)
    got = {(r.room, r.i, r.j, r.ts): (r.value, r.confidence, r.active) for r in fusion.persist(df, c, ("room", "i", "j")).collect()}
    want, state = {}, {}
    for room, ts, i, j, value, confidence in sorted(rows, key=lambda r: r[1]):
        s = state[room, i, j] = fusion.hold_step(state.get((room, i, j), (0.0, 0, False)), value, c)
        want[room, i, j, ts] = (s[0], confidence, True) if s[2] else (0.0, 0.0, False)
    assert got == want and sum(v[2] for v in want.values()) > 100
    assert fusion.persist(df.where("false").drop("room")).count() == 0
