"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table

#: Labelled rows of each class that the fit may use (those of the smallest hashes), score from which 1 is predicted.
FIT_ROWS, THRESHOLD = 4000, 0.7
#: Lexicon voters, pattern voters, and features of the classifier at most.
LEXICONS, PATTERNS, FEATURES = 8, 32, 1024
#: A term is suspicious or innocent from this log-likelihood ratio on, in so many documents at least.
EVIDENCE, SUPPORT = 16.0, 3
PREFIXES = (4, 5, 6, 7)
#: Log odds that a label gives the label model while it estimates the voters, beside the other voters.
LABEL_ODDS = 8.0
#: Terms that a task counts before it hands the counts on.
HELD_TERMS = 1 << 17
STEP = 1 << 20
#: Insults that vote before any are learnt.
SEED = frozenset("idiot moron stupid loser scum trash pathetic worthless disgusting bastard asshole bitch shit fuck".split())
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """Distinct words, lower-cased; a very long text in steps cut at white space."""
    if len(text) <= STEP:
        return set(_WORD.findall(text.lower()))
    found, at = set(), 0
    while at < len(text):
        end = min(len(text), at + STEP)
        while end < len(text) and not text[end].isspace():
            end += 1
        found.update(_WORD.findall(text[at:end].lower()))
        at = end
    return found


def terms_of(words: set[str]) -> set[str]:
    """Words, and as patterns their prefixes: of one longer word (written with a star) or of several (with two)."""
    out = set(words)
    for n in PREFIXES:
        once: set[str] = set()
        for w in words:
            if len(w) > n:
                head = w[:n] + "*"
                if head in once:
                    out.add(head + "*")
                once.add(head)
        out |= once
    return out


def votes(docs: list[set[str]], lexicons: list[set[str]], patterns: list[str]) -> np.ndarray:
    """Documents by voters: 1 toxic, -1 clean, 0 abstains. Lexicon voters, pattern voters, the seed list, two clean voters."""
    every = set().union(*lexicons, patterns) if lexicons or patterns else set()
    out = np.zeros((len(docs), len(lexicons) + len(patterns) + 3), np.int8)
    for i, terms in enumerate(docs):
        hits = terms & every
        if hits:
            for j, lexicon in enumerate(lexicons):
                out[i, j] = not lexicon.isdisjoint(hits)
            for j, pattern in enumerate(patterns, len(lexicons)):
                out[i, j] = pattern in hits
        out[i, -3] = not SEED.isdisjoint(terms)
        out[i, -2] = 0 if hits else -1
        out[i, -1] = -1 if terms and not hits and SEED.isdisjoint(terms) else 0
    return out


def moments(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strength of each voter, and the correlation of each two, from the votes alone.

    If voters only share the class, their correlations are products of strengths, so a voter's strength follows from
    any two others; the median over all pairs is taken, and voters are held to be better than chance.
    """
    value = v.astype(float)
    sd = value.std(0)
    value = (value - value.mean(0)) / np.where(sd > 0, sd, 1)
    c = value.T @ value / max(len(v), 1)
    m = len(c)
    strength = np.zeros(m)
    for j in range(m):
        others = np.array([k for k in range(m) if k != j and sd[k] > 0], int)
        if sd[j] > 0 and len(others) > 1:
            x, y = np.triu_indices(len(others), 1)
            k, n = others[x], others[y]
            use = np.abs(c[k, n]) > 0.02
            if use.any():
                strength[j] = np.sqrt(np.clip(np.median(c[j, k][use] * c[j, n][use] / c[k, n][use]), 0, 0.98))
    return strength, c


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _within(v: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Correlation of the votes within the classes, by the posterior."""
    value, cov = v.astype(float), 1e-6 * np.eye(v.shape[1])
    for w in (1 - post, post):
        d = value - w @ value / max(w.sum(), 1e-9)
        cov += (d * w[:, None]).T @ d / max(len(v), 1)
    sd = np.sqrt(np.diag(cov))
    return cov / np.outer(sd, sd)


@dataclass
class LabelModel:
    """P(vote | class) of each voter and the correlation of voters beyond the class.

    Where labels are known, they start the fit and are one more voter of fixed strength while the voters' tables are
    estimated, so that the hidden class is the labelled one. posterior() is made of the votes alone.
    """

    prior: float
    table: np.ndarray  # class, voter, vote + 1
    correlation: np.ndarray  # what the class does not explain
    weight: np.ndarray

    @classmethod
    def fit(cls, v: np.ndarray, prior: float, rounds: int = 60, known: np.ndarray | None = None) -> "LabelModel":
        onehot = np.stack([v == k for k in (-1, 0, 1)], 2).astype(float)
        strength, c = moments(v)
        correlation = c - np.outer(strength, strength)
        base = np.log(prior / (1 - prior))
        label = np.zeros(len(v)) if known is None else LABEL_ODDS * (2.0 * known - 1)
        post = None if known is None else _logistic(base + label)
        for _ in range(4):
            # voters that agree beyond what the class explains share their say
            np.fill_diagonal(correlation, 1)
            weight = 1 / (1 + np.clip(correlation - np.eye(len(c)) - 0.1, 0, None).sum(1))
            if post is None:
                post = _logistic(base + v @ (weight * np.log((1 + strength) / (1 - strength))))
            for _ in range(rounds):
                counts = np.einsum("cn,nmk->cmk", np.stack((1 - post, post)), onehot) + 0.1
                out = cls(prior, counts / counts.sum(2, keepdims=True), correlation, weight)
                old, post = post, _logistic(out.odds(v) + label)
                if np.abs(post - old).max() < 1e-6:
                    break
            correlation = _within(v, post)
        return out

    def posterior(self, v: np.ndarray) -> np.ndarray:
        return _logistic(self.odds(v))

    def odds(self, v: np.ndarray) -> np.ndarray:
        ratio = np.log(self.table[1]) - np.log(self.table[0])
        say = ratio[np.arange(v.shape[1])[None, :], v.astype(int) + 1]
        return np.log(self.prior / (1 - self.prior)) + (say * self.weight).sum(1)


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 2e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes weighing the same; accelerated gradient steps."""
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1))
    w, b = np.zeros(x.shape[1]), 0.0
    u, c, t = w.copy(), b, 1.0
    bound = 0.25 * float((weight[:, None] * x * x).sum(0).sum() + 1) + ridge
    bound = min(bound, 0.25 * float((x.sum(1) + 1).max()) + ridge)
    for _ in range(rounds):
        e = weight * (1 / (1 + np.exp(-np.clip(x @ u + c, -30, 30))) - y)
        w2, b2 = u - (x.T @ e + ridge * u) / bound, c - e.sum() / bound
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(id, words, y): distinct words of at most ``rows`` labelled documents of each class whose crc32(id as text) mod 3
    is not 1. Of an id with several texts the one of the smallest hash counts. ``labels`` has the id under ``id_col`` or as doc_id."""
    own = labels.select(F.col(id_col if id_col in labels.columns else "doc_id").alias("__id"), F.col("toxic").cast("int").alias("__y"))
    own = own.filter("__id is not null and __y in (0, 1)").groupBy("__id").agg(F.max("__y").alias("__y"))
    own = own.filter(F.crc32(F.col("__id").cast("string")) % 3 != 1)
    order = [F.xxhash64("__id"), F.col("__id")]
    ones = own.filter("__y = 1").orderBy(*order).limit(rows)
    zeros = own.filter("__y = 0").orderBy(*order).limit(rows)
    picked = F.broadcast(ones.unionByName(zeros))  # 2 * rows ids at most
    texts = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.join(picked, F.col("__doc") == F.col("__id")).select("__id", "text", "__y", F.xxhash64("text").alias("h"))

    def words(batches):
        import pyarrow as pa

        for b in batches:
            found = [sorted(words_of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(found, pa.list_(pa.string())), b.column(2), b.column(3)], ["id", "words", "y", "h"])

    found = texts.mapInArrow(words, "id string, words array<string>, y int, h long")
    return found.groupBy("id").agg(F.min_by("words", "h").alias("words"), F.first("y").alias("y"))


def term_counts(words: DataFrame) -> DataFrame:
    """(term, c1, c0): documents of each class that hold a term; each task adds up its own first."""

    def count(batches):
        import pyarrow as pa

        held: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def out():
            names = sorted({*held[0], *held[1]})
            cols = [names, [held[1][x] for x in names], [held[0][x] for x in names]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["term", "c1", "c0"])

        for b in batches:
            for found, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                held[y].update(terms_of(set(found)))
                if len(held[0]) + len(held[1]) > HELD_TERMS:
                    yield out()
                    held[0].clear()
                    held[1].clear()
        yield out()

    return words.mapInArrow(count, "term string, c1 long, c0 long").groupBy("term").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))


def with_evidence(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """The signed log-likelihood ratio ``g`` of a term's documents in the two classes; positive where class 1 has more."""
    p1, p0, p = F.col("c1") / n1, F.col("c0") / n0, (F.col("c1") + F.col("c0")) / (n1 + n0)

    def ll(k, n, q):
        q = F.least(F.greatest(q, F.lit(1e-12)), F.lit(1 - 1e-12))
        return F.col(k) * F.log(q) + (n - F.col(k)) * F.log1p(-q)

    g = 2 * (ll("c1", n1, p1) + ll("c0", n0, p0) - ll("c1", n1, p) - ll("c0", n0, p))
    return counts.withColumn("g", F.when(p1 >= p0, g).otherwise(-g))


@dataclass
class Terms:
    """Terms of the voters and of the classifier."""

    lexicons: list[set[str]]
    patterns: list[str]
    chosen: list[str]

    def used(self) -> set[str]:
        return {*self.chosen, *self.patterns, *SEED}.union(*self.lexicons)


def mined(words: DataFrame, n1: int, n0: int, scratch: Scratch) -> Terms:
    """The terms that tell the labels apart; at most 2 * FEATURES + PATTERNS of them reach the driver."""
    star = F.col("term").endswith("*")
    told = with_evidence(term_counts(words), n1, n0).filter((F.abs("g") >= EVIDENCE) & ((F.col("g") > 0) | ~star | (F.col("c1") > 0)))
    told = scratch.keep(told, "terms")
    toxic = told.filter((F.col("g") > 0) & (F.col("c1") >= SUPPORT) & (F.col("c1") * n0 >= 4 * F.col("c0") * n1))
    top = lambda df, n: [r.term for r in df.orderBy(F.desc(F.abs("g")), "term").limit(n).select("term").collect()]
    lexicons = [set() for _ in range(LEXICONS)]
    for x in top(toxic.filter(~star), FEATURES):
        lexicons[zlib.crc32(x.encode()) % LEXICONS].add(x)
    innocent = top(told.filter("g < 0"), FEATURES // 8)
    return Terms(lexicons, top(toxic.filter(star), PATTERNS), (top(toxic, FEATURES - len(innocent)) + innocent) or sorted(SEED))


def hits(words: DataFrame, terms: Terms) -> tuple[list[set[str]], np.ndarray]:
    """Of each document, by id, the mined terms that it holds (and the empty term, if it holds any word); the labels."""
    used = sorted(terms.used())
    shared = words.sparkSession.sparkContext.broadcast(used)

    def find(batches):
        import pyarrow as pa

        at = {x: i for i, x in enumerate(shared.value)}
        for b in batches:
            found = [sorted(at[x] for x in terms_of(set(w)) & at.keys()) + [-1] * bool(w) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int16())), b.column(2)], ["id", "hits", "y"])

    got = words.mapInArrow(find, "id string, hits array<smallint>, y int").toArrow().sort_by("id")
    return [{used[i] if i >= 0 else "" for i in x} for x in got.column("hits").to_pylist()], got.column("y").to_numpy()


def fit(docs: list[set[str]], y: np.ndarray, terms: Terms) -> tuple[dict[str, float], float]:
    """Weights of terms and the bias: the classifier learns the posteriors that the label model makes of the votes."""
    v = votes(docs, terms.lexicons, terms.patterns)
    model = LabelModel.fit(v, float(np.clip(y.mean(), 0.02, 0.98)), known=y)
    at = {x: i for i, x in enumerate(terms.chosen)}
    x = np.zeros((len(docs), len(at)), np.float32)
    for i, t in enumerate(docs):
        x[i, [at[z] for z in t if z in at]] = 1
    w, b = fit_linear(x, model.posterior(v))
    return {z: float(k) for z, k in zip(terms.chosen, w, strict=True) if abs(k) > 1e-6}, float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> tuple[dict[str, float], float]:
    """Fit on at most ``rows`` labelled documents of each class, none of them held out.

    Their words stay in a scratch table. The driver gets the mined terms, and for each document which of them it holds:
    2 * rows sets of at most 2 * FEATURES + PATTERNS small numbers, however long the texts are.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    words = scratch.keep(labelled(docs, labels, id_col, text_col, rows), "words")
    n = {r.y: r.n for r in words.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return dict.fromkeys(sorted(SEED), 6.0), -3.0
    terms = mined(words, n[1], n[0], scratch)
    model = fit(*hits(words, terms), terms)
    scratch.drop(words)
    return model


class Scorer:
    def __init__(self, model: tuple[dict[str, float], float]) -> None:
        weights, self.bias = model
        self.words = {k: v for k, v in weights.items() if not k.endswith("*")}
        heads = {k: v for k, v in weights.items() if k.endswith("*")}
        self.prefixes = [(n, {k: v for k, v in heads.items() if len(k.rstrip("*")) == n}) for n in PREFIXES]

    def __call__(self, text: str) -> float:
        found = words_of(text)
        total = self.bias + sum(sorted(self.words[w] for w in found & self.words.keys()))
        for n, table in self.prefixes:
            if table:
                heads = Counter(w[:n] + "*" for w in found if len(w) > n)
                total += sum(sorted(table[h] for h in heads.keys() & table.keys()))
                total += sum(sorted(table[h + "*"] for h, k in heads.items() if k > 1 and h + "*" in table))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def scores(docs: DataFrame, model: tuple[dict[str, float], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score. Only the text enters; a null text is empty and scores the bias."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer(t) for t in b.column(1).to_pylist()], pa.float64())], ["__id", "score"])

    return texts.mapInArrow(score, f"__id {kind}, score double").withColumnRenamed("__id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Many voters (mined lexicons and prefix patterns, a seed list, and voters for clean text) are weighed by a label
    model, which estimates their accuracies and their correlations within a class; a linear classifier on words and
    prefixes learns its posteriors. Labels choose the voters' terms and take part in the estimate of the voters' accuracies; they
    are no part of the posteriors that the classifier learns. Labels of held-out rows (crc32 of the id as text mod 3 = 1) are never read; an id
    with labels of both kinds counts as toxic; null labels are left out. Without labels of both classes the seed list
    alone scores. Of an id with several texts one trains, the same in each run. Null texts are empty and very long ones are read in steps; a null id is not held out; repeated rows are scored alike; other columns are
    ignored; an empty table gives no rows.
    """
    out = scores(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    return out.select(id_col, held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic. Rows are scored where they are read."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    where = docs.columns.index(text_col)

    def keep(batches):
        import pyarrow as pa

        scorer = Scorer(model.value)
        for b in batches:
            yield b.filter(pa.array([scorer(t or "") < THRESHOLD for t in b.column(where).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
