import math
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide.llm import mixing as M


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(1, 40), min_size=1, max_size=8))
def test_less_than_one_block_off(parts):
    total = sum(parts.values())
    plan = M.period_schedule(parts)
    assert [s for *_, s in plan] == list(range(total))
    done = Counter()
    for k, j, release, deadline, slot in plan:
        assert j == done[k] and release <= slot < deadline
        done[k] += 1
        for q, p in parts.items():
            assert abs(done[q] - Fraction(p * (slot + 1), total)) < 1
    assert done == parts


def test_shares():
    assert M.shares({"a": 3, "b": 1}, 8) in ({"a": 6, "b": 2}, {"a": 5, "b": 3})
    assert sum(M.shares({str(i): 1e-9 if i else 1 for i in range(20)}, 100).values()) == 100
    assert M.shares({}) == {} and M.shares({"a": 0}) == {}


def mixed(spark, rows, **k):
    return M.mix(spark.createDataFrame(rows, "doc_id long, source string, share string, slot string"), **k).orderBy("position").collect()


@pytest.mark.parametrize("block", [1, 3])
def test_prefixes_keep_the_weights(spark, block):
    rows = [(i, "big" if i % 4 else ("small" if i % 8 else "tiny"), "", "") for i in range(400)] + [(400, None, None, None), (None, "big", None, None), (7, "big", "", ""), (7, "big", "", "")]
    got = mixed(spark, rows, weights={"big": 0.5, "small": 0.3, "tiny": 0.19, "": 0.01}, period=100, block_rows=block)
    assert [r.position for r in got] == list(range(len(rows)))
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    parts = {r.source: r.share for r in got}
    assert sum(parts.values()) == 100
    seen, last = Counter(), defaultdict(set)
    for r in got:
        if not r.in_mix:
            break
        assert r.release <= r.slot < r.deadline
        seen[r.source] += 1
        last[r.slot].add(r.source)
        n = sum(seen.values())
        for k, p in parts.items():
            assert abs(seen[k] - n * p / 100) < block + 1
    assert all(len(s) == 1 for s in last.values()) and sum(seen.values()) > 20


def off(weights, blocks):
    """The furthest that a source is from its weight, in blocks, after any slot of the mix; and the slots of the mix."""
    total = sum(Fraction(str(w)) for w in weights.values())
    target = {k: Fraction(str(w)) / total for k, w in weights.items()}
    done, worst, n = Counter(), 0, 0
    for k, _, release, due, slot, mixed in M.run_schedule(M.whole_weights(weights), blocks):
        assert release <= slot < due
        if mixed:
            assert slot == n
            n += 1
            done[k] += 1
            worst = max(worst, *(abs(done[q] - t * n) for q, t in target.items()))
    return worst, n


@pytest.mark.parametrize("others", [19, 299, 1100])
def test_target_weight_holds_among_many_sources(others):
    weights = {"big": 0.9} | {f"s{i}": 0.1 / others for i in range(others)}
    worst, n = off(weights, {k: 4000 if k == "big" else 400 // others + 1 for k in weights})
    assert worst < 1 and n > 900


def test_target_weight_holds_beyond_a_period():
    counts = {"big": 40_000} | {f"s{i}": 3000 + 97 * i for i in range(19)}
    worst, n = off({k: v**M.TEMPERATURE for k, v in counts.items()}, {k: -(-v // 4) for k, v in counts.items()})
    assert worst < 1 and n > 10 * M.PERIOD


def test_mixed_rows_follow_the_target(spark, monkeypatch):
    monkeypatch.setattr(M, "PART", 50)
    weights = {"big": 0.9, "none": 0.0} | {f"s{i}": 0.1 / 19 for i in range(19)}
    rows = [(i, "big", "", "") for i in range(600)] + [(1000 + i, f"s{i % 19}", "", "") for i in range(76)] + [(9000 + i, "none", "", "") for i in range(5)]
    got = mixed(spark, rows, weights=weights, block_rows=2)
    assert [r.position for r in got] == list(range(len(rows))) and sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert [r.source for r in got[-5:]] == ["none"] * 5
    inside = [r for r in got if r.in_mix]
    assert len(inside) > 300 and got[: len(inside)] == inside
    for n in range(1, len(inside) + 1):
        assert abs(sum(r.source == "big" for r in inside[:n]) - 0.9 * n) <= 2 + 1e-9


def simulated(weights, blocks):
    """(source, block, slot) while all sources have blocks: in each slot the released block of the earliest deadline."""
    total = sum(weights.values())
    done, out, slot = dict.fromkeys(weights, 0), [], 0
    while True:
        released = [(math.ceil(Fraction((done[k] + 1) * total, w)), k) for k, w in weights.items() if Fraction(done[k] * total, w) < slot + 1]
        k = min(released)[1]
        if done[k] == blocks[k]:
            return out
        out.append((k, done[k], slot))
        done[k] += 1
        slot += 1


@pytest.mark.parametrize("blocks", [1 << 18, 40])
def test_query_is_the_simulated_schedule(spark, tmp_path, monkeypatch, blocks):
    monkeypatch.setattr(M, "BLOCKS", blocks)
    rows = [(i, f"s{i % 5}" if i % 3 else "hot", "long " * 9, None) for i in range(400)] + [(1, "s1", None, 3), (1, "s1", None, 3), (None, None, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, position long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = M.query(spark, str(tmp_path)).orderBy("position").collect()
    size = max(4, -(-len(rows) // blocks))
    counts = Counter(r[1] or "" for r in rows)
    names = sorted(counts)
    want = simulated({k: len(names) - i for i, k in enumerate(names)}, {k: -(-n // size) for k, n in counts.items()})
    seen = list(dict.fromkeys((r.source, r.block, r.slot) for r in got if r.in_mix))
    assert seen == want and len(got) == len(rows)
    # the rows of a source come in the order of the hash of their id
    hashes = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64("doc_id")).collect()}
    for k in names:
        own = [r.doc_id for r in got if r.source == k]
        assert own == sorted((r[0] for r in rows if (r[1] or "") == k), key=lambda i: (hashes[i], i or 0))


def test_defaults_and_empty(spark):
    assert mixed(spark, []) == []
    got = mixed(spark, [(i, "a" if i % 3 else "b", "", "") for i in range(90)])
    assert len(got) == 90 and {r.source for r in got[:16]} == {"a", "b"}


def test_plan_has_no_python(spark):
    df = M.mix(spark.createDataFrame([(1, "a")], "doc_id long, source string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
