import random

import pytest

from tests.llm.test_words import plain
from vectide.llm import jaccard as J

SCHEMA = "doc_id long, text string, n long, hid string, root string"


def brute(rows):
    sets, out = {}, {}
    for one, text, *_ in rows:
        w = plain((text or "").encode())
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        sets[one] = s
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            a, b = sets[i], sets[j]
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    for i in ids:
        out[i] = (len(sets[i]), find(i))
    return out


def corpus(seed, n_base=25, copies=8):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(30)]
    rows = []
    for _ in range(n_base):
        base = [r.choice(words) for _ in range(r.randint(1, 90))]
        if r.random() < 0.4:
            base[5:5] = passage
        for _ in range(r.randint(1, copies)):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), " ".join(t), 1, "x", "y"))
    big = [r.choice(words) for _ in range(60)]
    for _ in range(60):  # a chain of copies, few of them alike to each other
        t = list(big)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((len(rows), " ".join(t), 1, "x", "y"))
    rows += [(len(rows), None, None, None, None), (len(rows) + 1, "", 0, "", ""), (len(rows) + 2, " \t\n", 0, "", "")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_all_links_are_found(spark, monkeypatch, seed):
    if seed == 2:  # small limits: many groups, ranges, dealings and rounds
        for name, value in {"GROUP": 3, "DEAL": 4, "OFTEN": (2, 3, 5), "BLOCK_TOKENS": 500, "RANGE_TOKENS": 300, "TRIES": 1, "POOL": 3, "BYTES": 2000}.items():
            monkeypatch.setattr(J, name, value)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_no_early_link_is_needed(spark, monkeypatch):
    monkeypatch.setattr(J, "TRIES", 0)
    rows = corpus(3, 8, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_full_bit_tables_lose_no_set(spark, monkeypatch, tmp_path):
    """Every id passes a full table; copies come before the first of their set, in descending order over several files."""
    import numpy as np

    monkeypatch.setattr(J, "bit_table", lambda df, column, bits: np.full(1 << (bits - 6), -1, np.int64).view(np.uint64))
    rows = corpus(4, 12, 3)
    texts = [r[1] for r in rows if r[1] and r[1].strip()]
    rows += [(1000 * c + i, t, 1, "x", "y") for c in (1, 2, 3) for i, t in enumerate(texts)]
    rows.sort(key=lambda r: -r[0])
    for f in range(3):
        spark.createDataFrame(rows[f::3], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/t/f{f}")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(spark.read.parquet(*(f"{tmp_path}/t/f{f}" for f in range(3)))).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    text = "a b c d e f g h i j"
    rows = [(5, text), (5, text), (None, text), (7, text.upper()), (None, "other words"), (None, None), (9, "a b"), (8, "A  b"), (10, "b a")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 6, 5), (5, 6, 5), (None, 6, 5), (7, 6, 5), (None, 1, None), (None, 0, None), (9, 1, 8), (8, 1, 8), (10, 1, 10)], key=str)


def test_empty_table(spark):
    out = J.jaccard_classes(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


def test_prefixes_share_a_token():
    import itertools

    import numpy as np

    for n in range(1, 12):
        assert J.prefix_length(np.int64(n)) == n - -(-3 * n // 4) + 1
    universe = range(7)
    sets = [s for n in range(1, 7) for s in itertools.combinations(universe, n)]
    for a, b in itertools.combinations(sets, 2):
        x = len({*a} & {*b})
        if 4 * x >= 3 * (len(a) + len(b) - x):
            pa, pb = (set(s[: int(J.prefix_length(np.int64(len(s))))]) for s in (a, b))
            need = -(-3 * (len(a) + len(b)) // 7) - max(-(-3 * len(a) // 4), -(-3 * len(b) // 4)) + 1
            assert len(pa & pb) >= max(1, need)


class _Direct:
    """In place of a frame: gives back the function that its tasks would run."""

    def repartitionById(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def _range(groups, n_ranges=1):
    """The rows of the matrix of groups (class, part, size, tokens)."""
    import numpy as np
    import pyarrow as pa

    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    rows = [(r, p, n, np.sort(np.array(t, np.uint64)).tobytes()) for r, p, n, t in groups]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["root", "part", "n", "prefix"])
    return list(J._matrix(_Direct(), n_ranges)(iter([batch])))


def test_a_token_of_many_groups_takes_bounded_memory():
    """6000 groups share a token: their 18 million pairs are counted piece by piece."""
    import tracemalloc

    rows = _range([(i, 0, 4, [7, 1000 + i]) for i in range(6000)])
    tracemalloc.start()
    n = sum(b.num_rows for b in J._shared(_Direct(), 1, 75)(iter(rows)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 6000 * 5999 // 2
    assert peak < 200e6


@pytest.mark.parametrize("pairs", [1, 40, 1 << 20])
def test_pieces_count_all_that_groups_share(monkeypatch, pairs):
    import pyarrow.compute as pc

    monkeypatch.setattr(J, "PAIRS", pairs)
    monkeypatch.setattr(J, "DENSE", 1 << 30)  # no range rules out a pair
    r = random.Random(5)
    groups = [(r.randrange(-30, 30), part, 40, {r.randrange(60) * 0x9E3779B97F4A7C1 % 2**64 for _ in range(10)}) for part in range(80)]
    groups.sort(key=lambda g: g[:2])
    got = {}
    for k in range(3):
        for b in _range([(*g[:3], list(g[3])) for g in groups], 3):
            own = b.filter(pc.equal(b.column(0), k))
            for x in (row for out in J._shared(_Direct(), 3, 75)(iter([own])) for row in out.to_pylist()):
                key = (x["ra"], x["pa"], x["rb"], x["pb"])
                got[key] = got.get(key, 0) + x["n"]
    want = {(*a[:2], *b[:2]): len(a[3] & b[3]) for a in groups for b in groups if a[0] < b[0] and a[3] & b[3]}
    assert got == want


def test_packed_groups_come_back():
    import numpy as np

    r = np.random.default_rng(1)
    columns = [np.array([-(2**63), -5, 0, 2**63 - 1]), np.arange(4), np.array([1, 7, 30, 2**30]), np.array([1, 9, 30, 2**30 + 1]), np.array([1, 3, 9, 5]), np.zeros(4, np.int64), np.array([1, 2, 1, 3])]
    tokens = r.integers(0, 2**63, 7).astype(np.uint64)
    *back, low = J._unpacked(J._packed(columns, tokens))
    assert all((x == y).all() for x, y in zip(back, columns, strict=True)) and (low == (tokens & np.uint64(0xFFFFFFFF))).all()
