import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_jaccard import brute
from vectide.llm import decontaminate, jaccard, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        nxt = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(P.STAGES) - 1:
            assert nxt.columns == list(P.COLUMNS)
            before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs, nxt))
            assert after.items() <= before.items()
            seen[name] = (before, after)
        docs = nxt
    before, after = seen["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = toxicity.Scorer(toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), labels))
    assert set(after) == {i for i, t in before.items() if score(t) < toxicity.THRESHOLD}
    before, after = seen["ngram_jaccard_join"]
    classes = brute(list(before.items()))
    assert set(after) == {i for i, (n, c) in classes.items() if c == i}
    before, after = seen["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.Index([i for i, _ in items], [t.encode() for _, t in items], decontaminate.WINDOW, decontaminate.AGREE)
    dirty = {i for i, t in before.items() if index.found(*jaccard.hashed([t.encode()], punctuation=True))}
    assert set(after) == set(before) - dirty
    before, after = seen["source_mixing"]
    assert set(after) == set(before)
    assert {r.doc_id for r in docs.collect()} == set(after)


def test_run_and_names(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_binary_output"]
    assert P.run(spark, SF).count() > 0


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, SF).collect()) == [1, 3]


def test_repeated_ids_lose_no_other_text(spark):
    same, other, third = "a b c d e f g", "quite another text of some words", "nothing like the rest at all here"
    rows = [
        (1, same, "en", "s", 13), (1, same, "en", "s", 13), (2, same, "en", "s", 13),
        (5, same, "en", "s", 13), (5, other, "en", "s", 32), (5, other, "de", "s", 32), (5, third, "en", "s", 33), (3, third, "en", "s", 33),
        (None, "one", "en", "s", 3), (None, "two", "en", "s", 3), (None, "two", "en", "s", 3), (None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.repartition(3)):
        got = sorted(((r.doc_id, r.text, r.lang) for r in P.near_duplicates(spark, d, SF).collect()), key=str)
        kept = [(1, same, "en"), (3, third, "en"), (5, other, "de"), (None, "one", "en"), (None, "two", "en"), (None, "two", "en"), (None, None, None)]
        assert got == sorted(kept, key=str)


KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_stages_keep_odd_rows(spark, name):
    """Nulls anywhere, empty and long texts, ties and columns that operators use themselves."""
    stage = dict(P.STAGES)[name]
    rows = [(1, None, "en", "s", 0), (2, "", "en", None, None), (None, None, None, None, None), (3, "plain " * 250000, None, "s", 5), (4, "calm words about the sea and rain", "en", "t", None)]
    docs = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("own") for c in ("score", "component_id", "items", "position", "slot")})
    got = stage(spark, docs, SF)
    assert got.columns == list(P.COLUMNS)
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in spark.createDataFrame(rows, KIND).collect())
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_last_stage_takes_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (None, "", None, None, None), (1, None, "en", "s", 0)], KIND)
    got = P.shards(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"] and {r.n_tokens for r in got} == {1}
    assert P.shards(spark, docs.limit(0), SF).count() == 0


def test_order_of_the_mix_is_that_of_the_shards(spark, tmp_path, monkeypatch):
    """Each source has less than a block more or less than its weight in every run of sequences."""
    monkeypatch.setattr(P.tokenout, "SHARD_SEQS", 4)
    rows = [(i, "word " * 300, "en", "big" if i % 4 else "small", 1500) for i in range(400)]
    docs = spark.createDataFrame(rows, KIND)
    order = [r.doc_id for r in P.mixing.mix(docs).orderBy("position").collect()]
    P.mixture(spark, docs, SF).write.parquet(f"{tmp_path}/mixed")
    got = P.shards(spark, spark.read.parquet(f"{tmp_path}/mixed"), SF).collect()
    assert list(dict.fromkeys(r.doc_id for r in sorted(got, key=lambda r: (r.seq, r["at"])))) == order
    assert max(abs(r.slot - r.seq) for r in got) < 4 and len({r.seq for r in got}) > 20


def test_the_mix_shuffles_texts_once(spark, tmp_path, monkeypatch):
    """A table in files is placed without a join of its texts, in the same order as any other."""
    monkeypatch.setattr(P, "PLACES", 7)
    rows = [(i % 90 if i % 11 else None, f"text {i}", "en", ("a", "b", None)[i % 3], i) for i in range(120)]
    plain = spark.createDataFrame(rows, KIND)
    plain.repartition(3).write.parquet(f"{tmp_path}/docs")
    held = spark.read.parquet(f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = P.mixture(spark, held, SF)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        ids = [r.doc_id for r in got.collect()]
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
        assert ids == [r.doc_id for r in P.mixture(spark, plain, SF).collect()]
        assert P.mixture(spark, held.limit(0), SF).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [1000, 0])
def test_the_mix_runs_no_python(spark, tmp_path, monkeypatch, most):
    """DataFrame operations only, also where ids come in several sources or places are joined."""
    rows = [(i % 150 if i % 13 else None, f"text {i}", "en", ("a", "b", None, "", "c")[i * i % 7 % 5], i) for i in range(400)]
    rows += [(1000 + i, None, None, f"s{i % 40}", None) for i in range(200)]
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{tmp_path}/docs")
    held = spark.read.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(P, "PLACES", most)
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(held), name, lambda *_, **__: pytest.fail("runs Python on the executors"))
    mixed = P.mixture(spark, held, SF)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Arrow", "Python", "Pandas")) and ("Join" in plan) == (most == 0)
    got = mixed.collect()
    assert sorted(map(str, got)) == sorted(map(str, held.collect()))
    first = {}
    for r in P.mixing.mix(held).orderBy("position").collect():
        first.setdefault(r.doc_id, r.position)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=first.get)
