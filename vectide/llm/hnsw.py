"""Embedding near-duplicates: a navigable small-world graph per shard, every shard queried, cosine verified."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import Scratch, components, small_batches, table

#: Cosine that links; vectors of a shard; links of a node (twice as many on the lowest level).
SIMILAR, SHARD, LINKS = 0.95, 65536, 12
#: Beam while building, first beam while searching, nodes expanded in a step, queries searched together.
BUILD_BEAM, BEAM, EXPAND, TOGETHER = 48, 48, 4, 256
#: Vectors of a shard, and of all others, that its audit checks by brute force, and the recall that it must reach.
AUDIT, RECALL = 1024, 0.995
#: Links that an audit must rest on, and the first beam where there are fewer.
LEAST_LINKS, SAFE_BEAM = 400, 384
#: Tables of sign codes that offer further nodes to start from, and the most that each offers a query.
TABLES, OFFERED = 16, 8
#: Single precision may be off by so much; verification is in double precision.
SLACK = 1e-5


class Graph:
    """Levels of links over unit vectors. Level 0 holds all nodes, each level above about 1 / LINKS of them."""

    def __init__(self, unit: np.ndarray, seed: int = 1) -> None:
        self.unit = unit
        n = len(unit)
        rng = np.random.default_rng(seed)
        self.order = rng.permutation(n).astype(np.int32)
        level = np.minimum((-np.log(rng.random(n)) / np.log(LINKS)).astype(np.int32), 8)
        if n:
            level[self.order[0]] = max(int(level.max()), 0)
        self.level = level
        self.links = [np.full((n, LINKS * 2 if k == 0 else LINKS), -1, np.int32) for k in range(int(level.max()) + 1 if n else 0)]
        done, step = 1, 1
        while done < n:
            step = min(done, 2048, n - done)
            self._insert(self.order[done : done + step])
            done += step
        self._code()

    def _code(self) -> None:
        """Codes of about four nodes each: on which sides of random planes through the mean a vector lies."""
        n, dim = self.unit.shape
        bits = min(16, max(1, n.bit_length() - 3))
        self.mean = self.unit.mean(0) if n else np.zeros(dim, np.float32)
        self.planes = np.random.default_rng(3).normal(size=(TABLES, dim, bits)).astype(np.float32)
        codes = self._codes(self.unit)
        self.coded = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.codes = np.take_along_axis(codes, self.coded, 1)

    def _codes(self, v: np.ndarray) -> np.ndarray:
        near = v - self.mean
        return np.stack([((near @ p > 0) @ (1 << np.arange(p.shape[1]))).astype(np.uint16) for p in self.planes])

    def _offered(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of similarity ``least`` or more among nodes that share a code; some pairs twice."""
        out: list = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for own, codes, coded in zip(self._codes(q), self.codes, self.coded, strict=True):
            at = np.searchsorted(codes, own)[:, None] + np.arange(OFFERED)
            r, c = np.nonzero(at < np.searchsorted(codes, own, "right")[:, None])
            node = coded[at[r, c]]
            hit = np.einsum("ij,ij->i", q[r], self.unit[node]) >= least
            out.append((r[hit], node[hit]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _insert(self, new: np.ndarray) -> None:
        """Insert nodes together: each finds its neighbours in the graph so far and among the others of the batch."""
        for start in range(0, len(new), TOGETHER):
            batch = new[start : start + TOGETHER]
            at = np.full(len(batch), self.order[0], np.int32)
            found: list = []
            for k in range(len(self.links) - 1, -1, -1):
                inside = self.level[batch] >= k
                ids, sims = self._beam(self.unit[batch], at, k, np.where(inside, BUILD_BEAM, 1).max())
                at = ids[:, 0]
                found.append((k, inside, ids, sims))
            self._found = getattr(self, "_found", []) + [(batch, found)]
        pending, self._found = self._found, []
        for batch, found in pending:
            for k, inside, ids, sims in found:
                if not inside.any():
                    continue
                own = batch[inside]
                mates = new[self.level[new] >= k]
                near = self.unit[own] @ self.unit[mates].T
                near[own[:, None] == mates[None, :]] = -2
                top = min(BUILD_BEAM // 2, len(mates))
                pick = np.argpartition(-near, top - 1, axis=1)[:, :top]
                ids2 = np.concatenate((ids[inside], mates[pick].astype(np.int32)), 1)
                sims2 = np.concatenate((sims[inside], np.take_along_axis(near, pick, 1)), 1)
                chosen = self._diverse(ids2, sims2, LINKS)
                self.links[k][own, :LINKS] = chosen
                a = np.repeat(own, LINKS)
                b = chosen.ravel()
                self._back(k, b[b >= 0], a[b >= 0])

    def _back(self, k: int, target: np.ndarray, source: np.ndarray) -> None:
        """Add links target -> source; where a list is full, the diverse nearest ones stay."""
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        width, most = self.links[k].shape[1], int(min(count.max(), 256))
        for lo in range(0, len(nodes), 512):
            own, f, c = nodes[lo : lo + 512], first[lo : lo + 512], np.minimum(count[lo : lo + 512], most)
            grid = np.full((len(own), most), -1, np.int32)
            col = np.arange(most)[None, :]
            fill = col < c[:, None]
            grid[fill] = source[(f[:, None] + col)[fill]]
            ids = np.concatenate((self.links[k][own], grid), 1)
            sims = np.einsum("ijk,ik->ij", self.unit[np.maximum(ids, 0)], self.unit[own])
            sims[ids < 0] = -2
            self.links[k][own] = self._diverse(ids, sims, width)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the row's node than to any chosen one; then the rest."""
        keep = min(ids.shape[1], 3 * width)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :keep]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        sims = np.where(ids < 0, np.float32(-2), sims)
        same = np.sort(ids, 1)
        if (same[:, 1:] == same[:, :-1]).any():  # a candidate may come twice
            rank = np.argsort(ids, axis=1, kind="stable")
            s = np.take_along_axis(ids, rank, 1)
            twice = np.zeros_like(s, bool)
            twice[:, 1:] = s[:, 1:] == s[:, :-1]
            back = np.zeros_like(twice)
            np.put_along_axis(back, rank, twice, 1)
            sims = np.where(back, np.float32(-2), sims)
        v = self.unit[np.maximum(ids, 0)]
        between = v @ v.transpose(0, 2, 1)
        worst = np.full(ids.shape, -2, np.float32)  # nearest chosen one to each candidate
        chosen = np.zeros(ids.shape, bool)
        for i in range(keep):
            good = (sims[:, i] > -1.5) & (sims[:, i] > worst[:, i]) & (chosen.sum(1) < width)
            chosen[good, i] = True
            worst[good] = np.maximum(worst[good], between[good, i])
        rank = np.where(chosen, 0, np.where(sims > -1.5, 1, 2)) * keep + np.arange(keep)[None, :]
        pick = np.argsort(rank, axis=1)[:, :width]
        out = np.where(np.take_along_axis(sims, pick, 1) > -1.5, np.take_along_axis(ids, pick, 1), -1).astype(np.int32)
        if out.shape[1] < width:
            out = np.concatenate((out, np.full((len(out), width - out.shape[1]), -1, np.int32)), 1)
        return out

    def _beam(self, q: np.ndarray, entry: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search on one level for many queries at once: (ids, similarities), nearest first."""
        links, unit = self.links[k], self.unit
        beam = int(min(beam, len(unit)))
        ids = np.full((len(q), beam), -1, np.int32)
        sims = np.full((len(q), beam), -2, np.float32)
        ids[:, 0] = entry
        sims[:, 0] = np.einsum("ij,ij->i", q, unit[entry])
        opened = ids < 0
        seen, now = self._stamps(len(q))
        seen[np.arange(len(q)), entry] = now
        active = np.arange(len(q))
        expand = EXPAND if beam > 1 else 1
        while len(active):
            closed = ~opened[active]
            order = np.argsort(~closed, axis=1, kind="stable")[:, :expand]  # nearest first among the unopened
            todo = np.take_along_axis(closed, order, 1)
            some = todo.any(1)
            active, order, todo = active[some], order[some], todo[some]
            if not len(active):
                break
            nodes = np.where(todo, np.take_along_axis(ids[active], order, 1), -1)
            rows = np.repeat(active[:, None], order.shape[1], 1)
            opened[rows[todo], order[todo]] = True
            near = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= seen[active[:, None], np.maximum(near, 0)] != now
            r, c = np.nonzero(fresh)
            node = near[r, c]
            seen[active[r], node] = now
            s = np.full(near.shape, -2, np.float32)
            s[r, c] = np.einsum("ij,ij->i", q[active[r]], unit[node])
            worst = sims[active, -1]
            s[s <= worst[:, None]] = -2
            better = (s > -1.5).any(1)
            if better.any():
                a, s, near = active[better], s[better], near[better]
                all_s = np.concatenate((sims[a], s), 1)
                all_i = np.concatenate((ids[a], np.where(s > -1.5, near, -1).astype(np.int32)), 1)
                all_o = np.concatenate((opened[a], s <= -1.5), 1)
                top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
                sims[a], ids[a], opened[a] = (np.take_along_axis(x, top, 1) for x in (all_s, all_i, all_o))
        return ids, sims

    def _stamps(self, rows: int) -> tuple[np.ndarray, int]:
        """A table of queries by nodes in which the number returned stands nowhere yet; cleared once in 255 uses."""
        held = self.__dict__.setdefault("_seen", [np.zeros((0, len(self.unit)), np.uint8), 0])
        if len(held[0]) < rows or held[1] == 255:
            held[:] = [np.zeros((max(rows, len(held[0])), len(self.unit)), np.uint8), 0]
        held[1] += 1
        return held[0], held[1]

    def within(self, q: np.ndarray, least: float, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of similarity ``least`` or more.

        A query that is itself a node (``own``, else -1) starts there, any other descends from the entry node. From the
        hits of its beam, and from nodes that share a sign code with the query and are hits, the search goes on over the
        links of hits to further ones, however many there are: the graph alone leads one in a hundred queries past a lone
        hit, and only beams many times as wide find it. A beam
        that is not narrower than the shard compares all nodes instead.
        """
        out: list = []
        step = max(1, min(TOGETHER, (1 << 24) // (len(self.unit) + 64)))
        for lo in range(0, len(q) if len(self.unit) else 0, step):
            part = q[lo : lo + step]
            if beam >= len(self.unit):
                r, node = np.nonzero(part @ self.unit.T >= least)
                out.append((r + lo, node))
                continue
            at = np.full(len(part), self.order[0], np.int32)
            if own is not None:
                at = np.where(own[lo : lo + step] >= 0, own[lo : lo + step], at).astype(np.int32)
            away = np.flatnonzero(at == self.order[0])
            if len(away):
                for k in range(len(self.links) - 1, 0, -1):
                    at[away] = self._beam(part[away], at[away], k, 1)[0][:, 0]
            ids, sims = self._beam(part, at, 0, beam)
            r, c = np.nonzero(sims >= least)
            r, node = (np.concatenate(x) for x in zip((r, ids[r, c]), self._offered(part, least), strict=True))
            if not len(r):
                continue
            code = np.unique(r * len(self.unit) + node)
            r, node = code // len(self.unit), code % len(self.unit)
            out.append((r + lo, node))
            seen, now = self._stamps(len(part))
            seen[r, node] = now
            todo = [(r, node)]
            while todo:
                r, node = todo.pop()
                if len(r) > 1 << 16:
                    todo.append((r[1 << 16 :], node[1 << 16 :]))
                    r, node = r[: 1 << 16], node[: 1 << 16]
                near = self.links[0][node]
                r, node = np.repeat(r, near.shape[1]), near.ravel()
                new = (node >= 0) & (seen[r, node] != now)
                code = np.unique(r[new].astype(np.int64) * len(self.unit) + node[new])
                r, node = code // len(self.unit), code % len(self.unit)
                seen[r, node] = now
                hit = np.einsum("ij,ij->i", part[r], self.unit[node]) >= least
                if hit.any():
                    out.append((r[hit] + lo, node[hit]))
                    todo.append((r[hit], node[hit]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def audited_beam(self, least: float, recall: float = RECALL, sample: int = AUDIT, others: np.ndarray | None = None) -> tuple[int, float]:
        """The first beam whose hits hold ``recall`` of the links that brute force finds, and the share that it holds.

        Asked are nodes drawn evenly over the order of insertion, whose hits with themselves do not count, and
        ``others``, vectors that are not in the shard. Both the links as a whole and the mean over the vectors that have
        any must reach the share, so that no large class hides the small ones. If the nodes or the others have fewer
        than LEAST_LINKS links, the first beam is SAFE_BEAM, and vectors made at just ``least`` from each drawn node
        must find that node as well. If no beam does, all nodes are compared.
        """
        n = len(self.unit)
        picked = self.order[np.arange(min(sample, n)) * n // max(1, min(sample, n))].astype(np.int64)
        others = self.unit[:0] if others is None else others

        def found(q, own, beam):
            a, b = self.within(q, least, beam, own)
            return np.bincount(a[b != own[a]], minlength=len(q))

        def share(got, true):
            some = true > 0
            return min(got.sum() / true.sum(), (got[some] / true[some]).mean()) if some.any() else 1.0

        sets = [(self.unit[picked], picked)] + [(others, np.full(len(others), -1))] * bool(len(others))
        true = [found(q, own, n) for q, own in sets]
        safe = min(t.sum() for t in true) < LEAST_LINKS
        made = self._apart(picked, min(1.0, least + SLACK)) if safe else None
        beam = SAFE_BEAM if safe else BEAM
        while beam < n:
            reached = min(share(found(q, own, beam), t) for (q, own), t in zip(sets, true, strict=True))
            if safe:
                a, b = self.within(made, least, beam)
                reached = min(reached, (b == picked[a]).sum() / len(picked))
            if reached >= recall:
                return beam, float(reached)
            beam *= 2
        return n, 1.0

    def _apart(self, nodes: np.ndarray, cosine: float) -> np.ndarray:
        """For each node a unit vector at this cosine from it, in a random direction."""
        u = self.unit[nodes].astype(np.float64)
        if u.shape[1] < 2:
            return u.astype(np.float32)
        side = np.random.default_rng(2).normal(size=u.shape)
        side -= (side * u).sum(1, keepdims=True) * u
        side /= np.sqrt((side * side).sum(1, keepdims=True))
        return (cosine * u + np.sqrt(1 - cosine**2) * side).astype(np.float32)

    def save(self, f, **more) -> None:
        raw = io.BytesIO()
        np.savez(raw, unit=self.unit, order=self.order, level=self.level, mean=self.mean, planes=self.planes, codes=self.codes, coded=self.coded, **{f"links{k}": x for k, x in enumerate(self.links)}, **more)
        f.write(raw.getvalue())

    @classmethod
    def load(cls, f) -> tuple["Graph", dict]:
        got = dict(np.load(io.BytesIO(f.read())))
        out = cls.__new__(cls)
        out.unit, out.order, out.level = got.pop("unit"), got.pop("order"), got.pop("level")
        out.mean, out.planes, out.codes, out.coded = (got.pop(k) for k in ("mean", "planes", "codes", "coded"))
        out.links = [got.pop(f"links{k}") for k in range(sum(x.startswith("links") for x in got))]
        return out, got


def _vectors(column) -> np.ndarray:
    import pyarrow as pa

    values = column.flatten()
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _forest(a: np.ndarray, b: np.ndarray):
    """Edges of a spanning forest, each class a star around its smallest node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        nxt = root.copy()
        np.minimum.at(nxt, root[x], low)
        np.minimum.at(nxt, root[y], low)
        nxt = nxt[nxt]
        if (nxt == root).all():
            break
        root = nxt
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = SIMILAR,
    shard_rows: int = SHARD,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Two vectors are linked if their cosine, in double precision, is ``least`` or more. Null and zero vectors and those
    with null or non-finite components link with nothing, nor do vectors of different lengths. Equal vectors become
    one first, so a vector that a third of the rows hold is one node. Each shard of ``shard_rows`` nodes gets its own
    graph, written to the shared folder with a beam that passed a recall audit of real links, of its own nodes and of
    other shards', against brute force; every node is asked of every shard. A task returns counts and a spanning forest of its links, never all pairs.

    Ids are integers. A row with a null id links like any other and passes its links on, but has a null component_id
    and is not kept; rows of one id count as equal rows of one node if their vectors are equal, else the id has a row each and one
    component. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "hnsw")
    small_batches(spark, 2048)
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    good = F.coalesce(
        F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    rows = rows.select("vec_id", F.when(good, F.col("v")).alias("v"), F.xxhash64("v").alias("h"))
    nodes = rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("h").alias("h"))
    nodes = scratch.keep(nodes.select("v", "first", "copies", F.xxhash64("v", "first").alias("node"), F.size("v").alias("dim")), "nodes")
    counts = {r.dim: r.n for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    first_shard, shards = {}, 0
    for dim in sorted(counts):
        first_shard[dim] = shards
        shards += -(-counts[dim] // shard_rows)
    out_dir = scratch.path("graphs")
    if shards:
        key = F.create_map(*(F.lit(x) for d in sorted(counts) for x in (d, first_shard[d])))
        width = F.create_map(*(F.lit(x) for d in sorted(counts) for x in (d, -(-counts[d] // shard_rows))))
        dealt = nodes.withColumn("shard", (key[F.col("dim")] + F.pmod(F.xxhash64("node"), width[F.col("dim")])).cast("int"))
        index = scratch.keep(_build(dealt, shards, out_dir, least, _drawn(nodes, list(counts))), "index")
        paths = [(r.dim, r.path) for r in index.select("dim", "path").collect()]
        parts = max(1, min(sum(counts.values()) // 1024, int(spark.conf.get("spark.sql.shuffle.partitions")) * 8))
        found = scratch.keep(_ask(nodes.repartition(parts, "node"), paths, least), "found")
    else:
        found = spark.createDataFrame([], "node long, links long, other long")
    links = found.filter("links is not null").groupBy(F.col("node").alias("__n")).agg(F.sum("links").alias("links"))
    roots = components(scratch, found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    # a class is named by its smallest id, which is the smallest first id of its nodes
    classed = nodes.select("node", "v", "first", "copies").join(roots.withColumnRenamed("node", "__r"), F.col("node") == F.col("__r"), "left")
    classed = scratch.keep(classed.select("node", "v", "first", "copies", F.coalesce("root", F.col("node")).alias("root")), "classed")
    named = classed.groupBy(F.col("root").alias("__root")).agg(F.min("first").alias("component"))
    known = classed.join(named, F.col("root") == F.col("__root")).join(links, F.col("node") == F.col("__n"), "left")
    known = known.select(F.col("v").alias("__v"), "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0).cast("long"))).alias("n_links"))
    joined = rows.join(known, F.col("v") == F.col("__v"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _drawn(nodes: DataFrame, dims: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the nodes and vectors of AUDIT nodes, drawn by hash from all shards."""
    out = {}
    for dim in dims:
        some = nodes.filter(F.col("dim") == dim).orderBy(F.xxhash64(F.lit("audit"), "node"), "node").limit(AUDIT).select("node", "v").toArrow().combine_chunks()
        v = np.array(some.column("v").to_pylist(), np.float64).reshape(-1, dim)
        out[dim] = some.column("node").to_numpy(), _unit(v)
    return out


def _build(nodes: DataFrame, shards: int, out_dir: str, least: float, drawn: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    shared = nodes.sparkSession.sparkContext.broadcast(drawn)

    def build(batches):
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        shard = held[0].column("shard")[0].as_py()
        v = np.concatenate([_vectors(b.column("v")) for b in held])
        node = np.concatenate([b.column("node").to_numpy() for b in held])
        copies = np.concatenate([b.column("copies").to_numpy() for b in held])
        graph = Graph(_unit(v))
        foreign, unit = shared.value[v.shape[1]]
        beam, recall = graph.audited_beam(least - SLACK, others=unit[~np.isin(foreign, node)])
        path = f"{out_dir}/shard-{shard:06d}.npz"
        with files.writing(path) as f:
            graph.save(f, v=v, node=node, copies=copies, beam=np.int64(beam))
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([v.shape[1]], pa.int32()), pa.array([path]), pa.array([len(v)], pa.int64()), pa.array([beam], pa.int32()), pa.array([recall])],
            ["shard", "dim", "path", "rows", "beam", "recall"],
        )

    dealt = nodes.select("shard", "v", "node", "copies").repartitionById(shards, "shard")
    return dealt.mapInArrow(build, "shard int, dim int, path string, rows long, beam int, recall double")


def _ask(nodes: DataFrame, paths: list[tuple[int, str]], least: float) -> DataFrame:
    """Rows (node, links, -) for each node and shard, and (node, -, other) for a forest of the links of a task."""

    def ask(batches):
        import pyarrow as pa

        def batch(*cols):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if c is not None else pa.nulls(len(cols[0]), pa.int64()) for c in cols], ["node", "links", "other"])

        by_dim: dict[int, list] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == d))
                by_dim.setdefault(d, []).append((own.column("node").to_numpy(), _vectors(own.column("v"))))
        for dim, parts in by_dim.items():
            node, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            unit = _unit(v)
            for d, path in paths:
                if d != dim:
                    continue
                with files.reading(path) as f:
                    graph, more = Graph.load(f)
                links = np.zeros(len(node), np.int64)
                order = np.argsort(more["node"])
                at = np.minimum(np.searchsorted(more["node"], node, sorter=order), len(order) - 1)
                own = np.where(more["node"][order[at]] == node, order[at], -1)
                a, b = [], []
                for lo in range(0, len(node), TOGETHER):
                    q, hit = graph.within(unit[lo : lo + TOGETHER], least - SLACK, int(more["beam"]), own[lo : lo + TOGETHER])
                    q = q + lo
                    for at in range(0, len(q), 1 << 17):
                        x, y = q[at : at + (1 << 17)], hit[at : at + (1 << 17)]
                        other = more["node"][y]
                        sure = (_cosines(v[x], more["v"][y]) >= least) & (other != node[x])
                        np.add.at(links, x[sure], more["copies"][y[sure]])
                        if sure.any():
                            s, t = _forest(node[x[sure]], other[sure])
                            a.append(s)
                            b.append(t)
                yield batch(node, links, None)
                if a:
                    s, t = _forest(np.concatenate(a), np.concatenate(b))
                    yield batch(s, None, t)

    return nodes.select("node", "v", "dim").mapInArrow(ask, "node long, links long, other long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
