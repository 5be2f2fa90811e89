import heapq
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vectide.llm import sharding as S


def run(spark, rows, **k):
    df = spark.createDataFrame(rows, "doc_id long, text string, size string, shard string")
    return S.lpt_shards(df, **k).collect()


def naive(sizes, n_shards):
    """Loads when each group, largest first, goes to the least-loaded shard."""
    heap = [(0, s) for s in range(n_shards)]
    for size in sorted(sizes, reverse=True):
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, shard))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 25)), max_size=12, unique_by=lambda x: x[0]), st.integers(1, 7))
def test_runs_are_placed_as_single_groups(runs, n_shards):
    runs = sorted(runs, reverse=True)
    took = list(S.schedule(runs, n_shards))
    assert [(size, sum(n)) for size, n in took] == runs
    assert [sum(size * n[s] for size, n in took) for s in range(n_shards)] == naive([size for size, n in runs for _ in range(n)], n_shards)


def loads(got, n_shards):
    out = [0] * n_shards
    for r in got:
        out[r.shard] += r.size
    return out


def test_all_groups_are_scheduled(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 3)
    rows = [(i, f"{i % 300}" + "x" * (i * i % 37), "", "") for i in range(1500)] + [(2000 + i, "hot", "", "") for i in range(700)] + [(3000, "long " * 60000, "", "")]
    got = run(spark, rows, n_shards=5)
    groups = Counter()
    for _, t, *_ in rows:
        groups[t] += len(t) + 1
    assert loads(got, 5) == naive(groups.values(), 5)


@pytest.mark.parametrize("heavy", [1, 4, 8192])
def test_hot_groups_come_by_either_join(spark, monkeypatch, heavy):
    monkeypatch.setattr(S, "HEAVY", heavy)
    rows = [(i, "a" if i % 3 == 0 else f"t{i % 40}", "", "") for i in range(600)] + [(None, "a", "", ""), (0, "a", "", "")]
    got = run(spark, rows, n_shards=3)
    groups = Counter()
    for _, t, *_ in rows:
        groups[t] += len(t) + 1
    assert len(got) == len(rows) and loads(got, 3) == naive(groups.values(), 3)


def test_sizes_groups_and_slots(spark):
    rows = [(i, f"text {i % 60} é" * (i % 7), "x", "y") for i in range(500)] + [(500, None, None, None), (501, "", None, None), (None, "n", None, None), (3, "again", "", ""), (3, "again", "", "")]
    got = run(spark, rows, n_shards=4)
    assert len(got) == len(rows)
    texts = {(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, *_ in rows}
    assert {(r.doc_id, r.text_crc32, r.size) for r in got} == texts
    where, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        where[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for _, t, *_ in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    assert [load[s] for s in range(4)] == naive(groups.values(), 4)


def test_empty_table(spark):
    assert run(spark, []) == []
