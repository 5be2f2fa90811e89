import numpy as np
import pytest

from vectide.llm import hnsw as H

NAN, INF = float("nan"), float("inf")


def vectors(seed=0, n=1500, dim=24):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 5, dim))
    rows = [base[i % len(base)] + r.normal(size=dim) * r.choice([0.02, 0.15, 0.25]) for i in range(n)]
    crowd = r.normal(size=dim)
    rows += [crowd + r.normal(size=dim) * 0.12 for _ in range(300)]
    return np.array(rows, np.float32)


def brute(v, least=H.SIMILAR):
    u = v.astype(np.float64)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    root = np.arange(len(v))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(v)).min(1))
        if (new == root).all():
            return near, root
        root = new


def test_recall_and_components(spark):
    v = vectors()
    near, root = brute(v)
    df = spark.createDataFrame([(i, x.tolist(), 1, "k") for i, x in enumerate(v)], "vec_id long, embedding array<float>, n_links int, kept string")
    got = {r.vec_id: r for r in H.near_duplicates(df, shard_rows=700).collect()}
    links = np.array([got[i].n_links for i in range(len(v))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.99 * near.sum()
    assert np.mean([got[i].component_id == root[i] for i in range(len(v))]) > 0.995
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_wider_beams_find_a_crowd():
    v = vectors(1)
    unit = H._unit(v.astype(np.float64))
    g = H.Graph(unit)
    beam, recall = g.audited_beam(0.95)
    assert recall >= H.RECALL
    q, hit = g.within(unit[-50:], 0.95, beam)
    true = (unit[-50:] @ unit.T >= 0.95).sum()
    assert len(set(zip(q.tolist(), hit.tolist(), strict=True))) == len(q) and len(q) >= 0.99 * true


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a), (3, a), (3, a), (9, [0.999, 0.01, 0.0]), (7, b), (8, None), (10, [0.0] * 3), (11, [1.0, NAN, 0.0]), (12, [INF, 0.0, 0.0]), (13, [1.0, None, 0.0]), (14, [1.0, 0.0]), (None, a), (15, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in H.near_duplicates(df).collect() if r.vec_id is not None)
    assert got == sorted(
        [(5, 4, 3, False), (3, 4, 3, True), (3, 4, 3, True), (9, 4, 3, False)] + [(i, 0, i, True) for i in (7, 8, 10, 11, 12, 13, 14, 15)]
    )
    [n] = [r for r in H.near_duplicates(df).collect() if r.vec_id is None]
    assert (n.n_links, n.component_id, n.kept) == (4, None, False)


def test_one_vector_in_many_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)] + [(400 + i, [float(np.cos(i)), float(np.sin(i))]) for i in range(6)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in H.near_duplicates(df).collect()}
    assert got[0].n_links >= 399 and got[399].component_id == 0 and sum(r.kept for r in got.values()) < 8


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0])]])
def test_tiny(spark, rows):
    got = H.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [(i, 0, i, True) for i, _ in rows]


def test_forest_keeps_components():
    a, b = np.array([5, 7, 9, 1]), np.array([7, 9, 5, 2])
    x, y = H._forest(a, b)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(2, 1), (7, 5), (9, 5)]


class Blind(H.Graph):
    """Finds nothing but a vector itself unless the beam is wide."""

    def within(self, q, least, beam, own=None):
        near = q @ self.unit.T
        return np.nonzero(near >= (least if beam > self.narrow else 1 - 1e-6))


@pytest.mark.parametrize("pairs", [0, 20, 600])
def test_audit_counts_no_self_hits(pairs):
    r = np.random.default_rng(5)
    v = r.normal(size=(2000, 32))
    v[1000 : 1000 + pairs] = v[:pairs] + r.normal(size=(pairs, 32)) * 0.05
    g = Blind(H._unit(v))
    g.narrow = H.BEAM
    beam, share = g.audited_beam(H.SIMILAR)
    assert beam > H.BEAM and share >= H.RECALL
    g.narrow = H.SAFE_BEAM
    assert g.audited_beam(H.SIMILAR)[0] > H.SAFE_BEAM


def test_audit_asks_other_shards_and_late_nodes():
    r = np.random.default_rng(6)
    v = r.normal(size=(4000, 32))
    g = Blind(H._unit(v))
    late = g.order[-1500:]
    other = H._unit(v[late[:600]] + r.normal(size=(600, 32)) * 0.05)
    g.narrow = H.BEAM
    beam, share = g.audited_beam(H.SIMILAR, others=other)
    assert beam > H.BEAM and share >= H.RECALL
    g.unit[late[:700]] = g.unit[late[700:1400]]  # links of late nodes only
    assert g.audited_beam(H.SIMILAR)[0] > H.BEAM


def test_large_classes_do_not_hide_small_ones():
    r = np.random.default_rng(8)
    v = r.normal(size=(2000, 32))
    v[:500] = v[0] + r.normal(size=(500, 32)) * 0.02
    v[1000:1200] = v[600:800] + r.normal(size=(200, 32)) * 0.05

    class Half(H.Graph):
        """Misses the partner of a pair unless all nodes are compared."""

        def within(self, q, least, beam, own=None):
            a, b = super().within(q, least, beam, own)
            good = np.ones(len(a), bool) if beam >= len(self.unit) else (np.bincount(a, minlength=len(q))[a] > 5) | (b == (own[a] if own is not None else b))
            return a[good], b[good]

    assert Half(H._unit(v)).audited_beam(H.SIMILAR) == (2000, 1.0)


@pytest.mark.parametrize("beam", [48, 4000])
def test_hits_beyond_the_beam_are_found(beam):
    r = np.random.default_rng(9)
    v = r.normal(size=(3000, 32))
    v[:700] = v[0] + r.normal(size=(700, 32)) * 0.02
    g = H.Graph(H._unit(v))
    own = np.arange(3000)
    for start in (own, np.full(3000, -1)):
        a, b = g.within(g.unit[:300], H.SIMILAR, beam, start[:300])
        assert np.array_equal(np.bincount(a, minlength=300), ((g.unit[:300] @ g.unit.T) >= H.SIMILAR).sum(1))
        assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(a)


def test_rare_pairs_are_found(spark):
    r = np.random.default_rng(7)
    v = r.normal(size=(3000, 48))
    v[1500:1530] = v[:30] + r.normal(size=(30, 48)) * 0.2
    near, _ = brute(v)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {x.vec_id: x.n_links for x in H.near_duplicates(df, shard_rows=1000).collect()}
    assert [got[i] for i in range(len(v))] == near.sum(1).tolist()


def test_hits_that_no_link_leads_to():
    """Of 200 pairs the second node is cut off from the graph; the query of the first finds it all the same, at the first beam."""
    import numpy as np

    from vectide.llm import hnsw

    r = np.random.default_rng(7)
    v = r.normal(size=(3000, 32))
    v[200:400] = v[:200] + r.normal(size=(200, 32)) * 0.15
    graph = hnsw.Graph(hnsw._unit(v))
    for links in graph.links:
        links[(links >= 200) & (links < 400)] = -1
    a, b = graph.within(graph.unit[:200], 0.95, hnsw.BEAM, np.arange(200))
    assert len({(x, y) for x, y in zip(a.tolist(), b.tolist()) if y == x + 200}) >= 195
    assert len(set(zip(a.tolist(), b.tolist()))) == len(a)
