import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.llm import quality as Q

SF = "/root/testdata/sf0.01"


def seq(text):
    words = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return [1, *words, 2] if words else []


def discounts(counts):
    by = Counter(counts)
    n1, n2, n3, n4 = (by[k] for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5]
    d.append(2 - 3 * y * n3 / n2 if n2 else d[0])
    d.append(3 - 4 * y * n4 / n3 if n3 else d[1])
    d = [min(max(x, 0.05), m) for x, m in zip(d, (0.95, 1.95, 2.95), strict=True)]
    return lambda c: d[min(c, 3) - 1]


class Brute:
    """Interpolated modified Kneser-Ney of pairs, from dictionaries."""

    def __init__(self, texts):
        self.pairs = Counter(p for t in texts for p in zip(seq(t), seq(t)[1:]))
        self.behind = Counter(b for _, b in self.pairs)
        self.follow = defaultdict(list)
        for (a, _), c in self.pairs.items():
            self.follow[a].append(c)
        self.d2, self.d1 = discounts(self.pairs.values()), discounts(self.behind.values())

        self.total = sum(self.behind.values())
        self.rest = sum(map(self.d1, self.behind.values())) / self.total / (len(self.behind) + 1) if self.behind else 0
        self.follow = {a: (sum(c), sum(map(self.d2, c)) / sum(c)) for a, c in self.follow.items()}

    def p1(self, b):
        c = self.behind.get(b, 0)
        return (c - self.d1(c) if c else 0) / self.total + self.rest

    def p(self, a, b):
        low = self.p1(b)
        if a not in self.follow:
            return low
        total, weight = self.follow[a]
        c = self.pairs.get((a, b), 0)
        return (c - self.d2(c) if c else 0) / total + weight * low

    def perplexity(self, text):
        s = seq(text)
        return math.exp(-sum(math.log(self.p(a, b)) for a, b in zip(s, s[1:], strict=False)) / (len(s) - 1)) if s else None


def held(spark, ids):
    return {r.i for r in spark.createDataFrame([(i,) for i in ids], "i long").filter(F.pmod(F.xxhash64(F.lit("held"), "i"), F.lit(Q.HELD)) == 0).collect()}


@pytest.mark.parametrize(("shard", "block"), [(64 << 20, 1 << 21), (20000, 3000)])
def test_perplexities_equal_brute_force(spark, monkeypatch, shard, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 4000")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows, trusted = docs.collect(), {r.doc_id for r in labels.filter("quality = 1").collect()}
    if shard < 1 << 20:
        rows = rows[:150]
        docs = docs.filter(F.col("doc_id").isin([r.doc_id for r in rows]))
    monkeypatch.setattr(Q, "SHARD_BYTES", shard)
    monkeypatch.setattr(Q, "BLOCK_WORDS", block)
    got = {r.doc_id: r for r in Q.quality(docs.repartition(3), labels.filter("quality = 1").select("doc_id")).collect()}
    back = held(spark, trusted)
    brute = Brute([r.text for r in rows if r.doc_id in trusted - back])
    assert brute.pairs and sum(brute.p(1, b) for b in brute.behind) < 1
    for r in rows:
        assert got[r.doc_id].perplexity == pytest.approx(brute.perplexity(r.text), rel=1e-5)
        assert got[r.doc_id].n_words == max(0, len(seq(r.text)) - 2)
    for lang in {r.lang for r in rows}:
        mine = [r for r in rows if r.lang == lang and r.doc_id in trusted and seq(r.text)]
        own = sorted(got[r.doc_id].perplexity for r in [r for r in mine if r.doc_id in back] or mine)
        if own:
            assert {got[r.doc_id].threshold for r in rows if r.lang == lang} == {own[math.ceil(Q.QUANTILE * len(own)) - 1]}
    assert all(r.kept == (r.perplexity <= r.threshold) for r in got.values() if r.n_words)


def test_probabilities_add_up():
    brute = Brute(["a b c a b d", "b c a", "e a b"])
    for a in (1, b"a", b"never"):
        words = [b for b in brute.behind] + [b"unseen"]
        assert sum(brute.p(a, b) for b in words) == pytest.approx(1)


@pytest.mark.parametrize("step", [1 << 20, 7, 30])
def test_long_texts_in_steps(monkeypatch, step):
    raw = [("Ein Satz\t zwei  ÄÖÜ 123! " * 9).encode(), b"", b" \n ", b"one", b"x" * 50, b" two words "]
    monkeypatch.setattr(Q, "STEP", step)
    got = defaultdict(list)
    for a, b, doc in Q.neighbours(raw, 64):
        for x, y, d in zip(a.tolist(), b.tolist(), doc.tolist(), strict=True):
            got[d].append((x, y))
    monkeypatch.setattr(Q, "STEP", 1 << 20)
    want = defaultdict(list)
    for a, b, doc in Q.neighbours(raw, 64):
        for x, y, d in zip(a.tolist(), b.tolist(), doc.tolist(), strict=True):
            want[d].append((x, y))
    assert got == want and sorted(got) == [0, 3, 4, 5] and [len(got[d]) for d in (0, 3, 4, 5)] == [46, 2, 2, 3]
    assert all(p[0][0] == 1 and p[-1][1] == 2 and all(x[1] == y[0] for x, y in zip(p, p[1:], strict=False)) for p in got.values())


def test_columns_come_back():
    a, b = np.sort(np.random.default_rng(0).integers(0, 1 << 60, 1000)).astype(np.uint64), np.arange(7, dtype="<f4")
    x, y, z = Q.unpack(Q.pack(Q.steps(a), b, np.zeros(0, "<u4")), "<u8", "<f4", "<u4")
    assert np.array_equal(np.cumsum(x), a) and np.array_equal(y, b) and len(z) == 0


def test_junk_is_told_from_prose(spark):
    got = Q.query(spark, "/root/testdata/sf0.1").toPandas().merge(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas(), on="doc_id")
    good, junk = got[got.quality == 1], got[got.quality == 0]
    assert good.kept.mean() > 0.97
    back = good[good.doc_id.isin(held(spark, good.doc_id.tolist()))]
    assert back.kept.mean() > 0.97
    assert junk.perplexity.median() > back.perplexity.median() and junk.kept.mean() < 0.7


def test_odd_rows(spark):
    rows = [(1, "some plain words here", "en", "a"), (2, None, "en", "b"), (3, "", None, "c"), (None, "plain words", "en", "d"), (4, "andere", "de", "e"), (1, "some plain words here", "en", "a"), (5, " \n", "en", ""), (6, "word " * 400000, "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    for trusted in ([(1,), (1,), (None,)], [(1,), (2,), (4,), (99,)], []):
        got = Q.quality(docs, spark.createDataFrame(trusted, "doc_id long")).collect()
        assert len(got) == 8 and {r.n_words for r in got if r.doc_id == 1} == {4} and {r.n_words for r in got if r.doc_id == 6} == {400000}
        assert all((r.perplexity is None) == (not trusted or not r.n_words) for r in got)
        assert {r.kept for r in got if not r.n_words} == {False}
        if trusted:
            assert {r.kept for r in got if r.doc_id == 1} == {True}
            own = [r.perplexity for r in got if r.doc_id == 1]
            assert own[0] == own[1] == pytest.approx(Brute([t or "" for i, t, *_ in rows if i in {x for (x,) in trusted} and i is not None]).perplexity(rows[0][1]), rel=1e-5)
    assert Q.quality(docs.limit(0), spark.createDataFrame([], "doc_id long")).count() == 0
