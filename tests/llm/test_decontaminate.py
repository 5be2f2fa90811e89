import itertools
import math
import random
import re

from vectide.llm import decontaminate as D

R = random.Random(11)
WORDS = [f"word{i}" for i in range(900)]


def passage(n):
    return [R.choice(WORDS) for _ in range(n)]


ITEMS = [(1, passage(40)), (2, passage(60)), (3, passage(15)), (4, passage(5))]


def brute(text, items, window=D.WINDOW, agree=D.AGREE):
    """Items of which some window agrees in enough places, over all alignments."""
    w = re.findall(r"[a-z0-9é]+", text.lower())
    out = []
    for one, item in items:
        n = min(window, len(item))
        agree = 1.0 if n < D.SHORT else D.AGREE
        if n and any(sum(a == b for a, b in zip(item[i : i + n], w[j : j + n], strict=False)) >= agree * n for i in range(len(item) - n + 1) for j in range(len(w) - n + 1)):
            out.append(one)
    return out


def docs():
    rows = []
    for i in range(60):
        base = passage(R.randint(0, 120))
        if i % 3 == 0:
            one, item = ITEMS[i % 4 if i % 4 < 3 else 0]
            cut = item if i % 2 else item[: max(15, len(item) - 10)]
            cut = [R.choice(WORDS) if R.random() < 0.08 else x for x in cut]
            base[len(base) // 2 : len(base) // 2] = cut
        sep = [" ", ", ", ".\n", " - "][i % 4]
        rows.append((i, sep.join(base).upper() if i % 5 == 0 else sep.join(base), "x", "y"))
    return rows + [(100, None, "", ""), (101, "", "", ""), (None, " ".join(ITEMS[1][1]), "", ""), (102, " ".join(ITEMS[3][1]), "", "")]


def found(spark, rows, items, **k):
    b = spark.createDataFrame([(i, t if isinstance(t, (str, type(None))) else " ".join(t)) for i, t in items], "item_id long, text string")
    return D.contamination(spark.createDataFrame(rows, "doc_id long, text string, items string, n_words string"), b, **k)


def test_equals_brute_force(spark):
    rows = docs()
    got = {r.doc_id: r["items"] for r in found(spark, rows, ITEMS).collect()}
    want = {i: brute(t or "", ITEMS) for i, t, *_ in rows}
    assert got == want and sum(map(bool, want.values())) > 10


def test_substitutions_within_a_seed(spark):
    item = ITEMS[1][1]
    text = list(item[:24])
    for i in (2, 8, 15, 21):  # no eight words in a row are left
        text[i] = "other"
    [r] = found(spark, [(1, " ".join(text), "", "")], ITEMS).collect()
    assert r["items"] == [2] and r.n_words == 24


def test_seeds_miss_no_choice_of_substitutions():
    for n in range(8, D.WINDOW + 1):
        shifts = [[s + i for i, bit in enumerate(m) if bit == "1"] for m in D.MASKS for s in range(n - len(m) + 1)]
        masks = [sum(1 << i for i in counting) for counting in shifts]
        for gone in itertools.combinations(range(n), n - math.ceil(D.AGREE * n - 1e-9)):
            bits = sum(1 << i for i in gone)
            assert any(not bits & m for m in masks), (n, gone)


def test_blocks_give_the_same_items(spark):
    rows = docs()
    rows += rows[:3]
    whole = sorted(found(spark, rows, ITEMS).collect(), key=str)
    assert sorted(found(spark, rows, ITEMS, block_words=50).collect(), key=str) == whole and len(whole) == len(rows)


def test_short_items_are_found_whole(spark):
    items = [(i, [f"s{i}x{j}" for j in range(i)]) for i in range(1, 8)] + [(11, ["s3x0", "s3x1", "s3x2"]), (12, ["s4x0", "s4x1", "s4x2", "no"])]
    rows = [(i, f"before {' '.join(t)}, after" + " word" * 30 * i, "", "") for i, t in items[:7]] + [(20, "s3x0 s3x1 other s3x2 s5x0 s5x1 s5x2 s5x3", "", "")]
    got = {r.doc_id: (r["items"], r.n_words) for r in found(spark, rows, items).collect()}
    assert got == {i: ([i, 11], 6) if i == 3 else ([i], i) for i in range(1, 8)} | {20: ([], 0)}


def test_clean_keeps_columns_and_clean_rows(spark):
    rows = docs()
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in ITEMS], "item_id long, text string")
    out = D.clean(spark.createDataFrame(rows, "doc_id long, text string, items string, n_words string"), b)
    assert out.columns == ["doc_id", "text", "items", "n_words"]
    assert sorted((r.doc_id or -1) for r in out.collect()) == sorted((i or -1) for i, t, *_ in rows if not brute(t or "", ITEMS))


def test_empty(spark):
    assert found(spark, [], ITEMS).count() == 0
    assert [r["items"] for r in found(spark, [(1, "a b c", "", "")], []).collect()] == [[]]
    assert [r["items"] for r in found(spark, [(1, "a b c", "", "")], [(1, None), (2, ""), (None, "x y")]).collect()] == [[]]
