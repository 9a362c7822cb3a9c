"""Regions labelled tile by tile against a flood fill of the whole grid."""

import random

import numpy as np
import pytest

from fieldlark.operators import cluster

FIELD = "room string, i int, j int, value double"


def flooded(cells, connectivity):
    left, label = set(cells), {}
    for start in sorted(cells):
        if start not in left:
            continue
        left.discard(start)
        todo = [start]
        while todo:
            at = todo.pop()
            label[at] = start
            for a, b in cluster.NEIGHBOURS[connectivity]:
                n = (at[0] + a, at[1] + b)
                if n in left:
                    left.discard(n)
                    todo.append(n)
    return label


def spiral(n):
    """One path of cells from the rim of an n by n grid to its middle, a gap between its turns."""
    cells, i, j, d = [], 0, 0, 0
    free = np.zeros((n, n), dtype=bool)
    step = ((0, 1), (1, 0), (0, -1), (-1, 0))
    inside = lambda a, b: 0 <= a < n and 0 <= b < n
    while True:
        free[i, j] = True
        cells.append((i, j))
        for turn in (0, 1):
            a, b = step[(d + turn) % 4]
            if inside(i + a, j + b) and not free[i + a, j + b] and not (inside(i + 2 * a, j + 2 * b) and free[i + 2 * a, j + 2 * b]):
                i, j, d = i + a, j + b, (d + turn) % 4
                break
        else:
            return cells


@pytest.mark.parametrize("connectivity", [4, 8])
def test_tiles_against_flood_fill(spark, connectivity):
    rng = random.Random(connectivity)
    rooms = {r: {(i, j) for i in range(-7, 40) for j in range(30) if rng.random() < p} for r, p in (("a", 0.62), ("b", 0.4))}
    rows = [(r, i, j, 1.0) for r, cells in rooms.items() for i, j in cells] + [("a", 100, 100, 0.0), ("c", 0, 0, 2.0)]
    got = cluster.label_regions(spark.createDataFrame(rows, FIELD), 0.5, connectivity, ("room",), tile=8).collect()
    want = {(r, *at): first for r, cells in (rooms | {"c": {(0, 0)}}).items() for at, first in flooded(cells, connectivity).items()}
    assert {(r.room, r.i, r.j): tuple(r.label) for r in got} == want and len(got) == len(want)


def test_rounds_do_not_grow_with_a_region(spark, monkeypatch):
    """A spiral through many tiles: the graph of borders settles in few rounds, the path has thousands of cells."""
    cells = spiral(95)
    assert len(cells) > 4000 and set(flooded(set(cells), 4).values()) == {(0, 0)}
    cuts = []
    cut = cluster.Rounds.cut
    monkeypatch.setattr(cluster.Rounds, "cut", lambda self, df: cuts.append(1) or cut(self, df))
    df = spark.createDataFrame([("a", i, j, 1.0) for i, j in cells], FIELD)
    got = cluster.label_regions(df, tile=16).select("label").distinct().collect()
    assert [tuple(r.label) for r in got] == [(0, 0)] and len(cuts) < 50
    cuts.clear()
    assert [tuple(r.label) for r in cluster.label_regions(df, tile=128).select("label").distinct().collect()] == [(0, 0)] and len(cuts) == 2


def test_one_tile():
    cells = spiral(61)
    i, j = (np.array(x) for x in zip(*random.Random(1).sample(cells, len(cells))))
    first = cluster.label_tile(i, j, 4)
    assert set(zip(i[first].tolist(), j[first].tolist())) == {(0, 0)}


def test_no_cells(spark):
    df = spark.createDataFrame([], FIELD)
    assert cluster.label_regions(df).count() == 0 and cluster.count_regions(df).first().n == 0
