"""Grouped folds against the best of all assignments, chunks that rejoin, periods against a plain loop."""

import itertools
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from riskloom.operators.folds import assigned, balanced, grouped_folds
from riskloom.operators.spans import CLOSES, DATE, JOINS, PIECE, REACH, chunked, periods

CLASSES = ("low", "medium", "high")


def labelled(spark, groups):
    rows = [(g, c) for g, vector in groups for c, n in zip((*CLASSES, None), vector) for _ in range(n)]
    return spark.createDataFrame(rows, "series string, label string")


def spread(vectors, folds, k):
    """Largest distance of a fold's count from an even share, by class."""
    out = []
    for c in range(3):
        held = [0] * k
        for v, f in zip(vectors, folds):
            held[f] += v[c]
        out.append(max(abs(h - sum(held) / k) for h in held))
    return out


def test_greedy_balance_is_within_one_group_of_the_best():
    random.seed(11)
    for _ in range(30):
        groups = sorted(([random.randint(0, 9) for _ in range(3)] for _ in range(7)), key=sum, reverse=True)
        totals = [sum(g[c] for g in groups) for c in range(3)]
        got = spread(groups, balanced(groups, [[0] * 3 for _ in range(3)], totals), 3)
        best = min(max(spread(groups, f, 3)) for f in itertools.product(range(3), repeat=len(groups)))
        assert max(got) <= best + max(max(g) for g in groups)


def test_groups_stay_whole_and_classes_even(spark):
    random.seed(12)
    groups = [(f"s{i}", [random.randint(0, 6), random.randint(0, 3), random.randint(0, 2), 0]) for i in range(60)] + [(f"one{i}", [1, 0, 0, 0]) for i in range(203)] + [("hot", [150, 60, 30, 0])]
    rows = labelled(spark, groups)
    dealt = grouped_folds(rows, "series", "label", CLASSES)
    got = dealt.collect()
    present = {g for g, v in groups if sum(v)}
    assert len({(r["rep"], r["group"]) for r in got}) == len(got) == 5 * len(present) and {r["fold"] for r in got} == set(range(5))
    out = assigned(rows, "series", dealt)
    assert out.count() == 5 * rows.count()
    held = {g: v for g, v in groups}
    for rep in range(5):
        mine = [(held[r["group"]], r["fold"]) for r in got if r["rep"] == rep and r["group"] != "hot"]
        hot = next(r["fold"] for r in got if r["rep"] == rep and r["group"] == "hot")
        # the hot group fills its fold; the others share what is left within one group
        for c in range(3):
            rest = [sum(v[c] for v, f in mine if f == k) for k in range(5) if k != hot]
            assert max(rest) - min(rest) <= 8
    assert {(r["rep"], r["group"]): r["fold"] for r in got} == {(r["rep"], r["group"]): r["fold"] for r in grouped_folds(rows.repartition(7), "series", "label", CLASSES).collect()}


def test_more_groups_than_the_greedy_balance_takes(spark):
    random.seed(13)
    groups = [(f"s{i}", [random.randint(1, 40), random.randint(0, 20), random.randint(0, 9), 0]) for i in range(400)]
    rows = labelled(spark, groups)
    got = grouped_folds(rows, "series", "label", CLASSES, repeats=2, most=100).collect()
    assert len(got) == 800 and {(r["rep"], r["group"]) for r in got} == {(r, g) for r in range(2) for g, _ in groups}
    held = dict(groups)
    for rep in range(2):
        off = spread([held[r["group"]] for r in got if r["rep"] == rep], [r["fold"] for r in got if r["rep"] == rep], 5)
        assert all(o <= max(v[c] for v in held.values()) for c, o in enumerate(off))


def test_odd_groups(spark):
    rows = labelled(spark, [(None, [2, 0, 1, 1]), ("", [0, 0, 0, 3]), ("a", [1, 0, 0, 0])])
    got = grouped_folds(rows, "series", "label", CLASSES, folds=2, repeats=1)
    assert sorted((r["group"] for r in got.collect()), key=repr) == ["", "a", None] and assigned(rows, "series", got).count() == rows.count()
    assert grouped_folds(rows.limit(0), "series", "label", CLASSES).count() == 0


@pytest.mark.parametrize("budget", [1, 3, 256])
def test_chunks_tile_the_text(spark, budget):
    texts = [None, "", " \n", "one", "  lead and tail \t", "é ü 😀 x\ny", "word " * 5000, "w\x0bx\x85y z", "a\n" * 7, "a\n" * 7]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, chunk int, body int")
    rows = {}
    for r in chunked(docs, budget).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert sorted(rows) == list(range(len(texts)))
    for i, t in enumerate(texts):
        t, cut = t or "", sorted(rows[i], key=lambda r: r["chunk"])
        words = re.findall(PIECE, t)
        assert "".join(r["body"] for r in cut) == t and [r["chunk"] for r in cut] == list(range(max(1, -(-len(words) // budget))))
        assert all(t[r["start"] : r["stop"]] == r["body"] for r in cut) and sum(r["tokens"] for r in cut) == len(words)
        assert [r["first_token"] for r in cut] == list(range(0, max(len(words), 1), budget))


def test_chunks_need_room(spark):
    with pytest.raises(ValueError):
        chunked(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 0)
    assert chunked(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def plain_periods(text):
    """The rule as a loop over positions."""
    at = []
    for m in re.finditer(DATE, text):
        try:
            at.append((date(*map(int, m.groups())), m.start(), m.end()))
        except ValueError:
            pass
    out, i = [], 0
    while i + 1 < len(at):
        between = text[at[i][2] : at[i + 1][1]]
        if len(between) <= REACH and re.search(JOINS, between) and not re.search(CLOSES, between) and at[i + 1][0] > at[i][0]:
            out.append(((at[i + 1][0] - at[i][0]).days, at[i][0], at[i + 1][0]))
            i += 2
        else:
            i += 1
    return out


def test_periods(spark):
    random.seed(14)
    gaps = [" - ", ", ", "-tól ", " től ", "-ig ", " napig - ", " és ", " határidő: ", " – 2023.02.31 ", " 2024.13.01. ", " x" * 60 + "-", " - " + "y" * 78, " - " + "y" * 77, "\n", "TÓL "]
    days = ["2021. 7. 12.", "2021.07.31", "2022-01-05", "2020. 02. 29", "2021.02.29", "2025.1.1", "0000.01.01"]
    texts = [None, "", "no date", "2021.01.01", "2021.01.01 - 2021.01.31 - 2021.02.15"] + ["".join(random.choice(days) + random.choice(gaps) for _ in range(random.randint(1, 7))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", periods(F.col("text")).alias("p")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [tuple(p) for p in r["p"]] == plain_periods(texts[r["i"]] or ""), texts[r["i"]]
    assert sum(len(r["p"]) for r in got) > 100
