import random

import pytest

from vectide.llm import common as C


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in C.components(C.Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    for n in parent:
        assert got.get(n, n) == find(n)


def test_running_totals(spark):
    rows = [(i % 3 if i % 7 else None, i % 5, i, i * 2) for i in range(200)]
    df = C.Scratch(spark, "t").keep(spark.createDataFrame(rows, "g int, c int, i int, v long"), "rows")
    got = C.running_totals(df, ["g"], "c", ["i"], "at", "v").collect()
    assert len(got) == 200
    for g in (0, 1, 2, None):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.c, r.i)):
            assert r["at"] == total
            total += r.v


def test_scratch_follows_the_session(spark):
    assert C.shared_dir(spark) == C.shared_dir(spark)
    s = C.Scratch(spark, "t")
    t = s.keep(spark.range(3), "x")
    assert t.count() == 3
    s.drop(t)


def test_slices():
    assert list(C.by_bytes([b"aa", None, b"bbbb", b"c"], 3)) == [slice(0, 2), slice(2, 3), slice(3, 4)]
    assert list(C.by_bytes([], 3)) == []
