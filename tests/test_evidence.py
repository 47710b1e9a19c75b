"""Evidence search, as-of joins and page furniture against plain Python, on odd and skewed input."""

import random
import re
from bisect import bisect_right

from pyspark.sql import functions as F

from riskloom.operators import evidence
from riskloom.operators.furniture import without_furniture

NAMES = "doc_id long, pages array<string>, key string, words int, quote long, at double"


def folded(text):
    return " ".join(re.sub(r"[|#]", " ", re.sub(r"[*_`]", "", text)).split()).lower()


def plain_search(documents, quotes):
    """Every start of every quote in every text, character by character."""
    out = []
    for doc, pages in documents:
        cut = [folded(p or "").split() for p in pages or []]
        starts = [sum(map(len, cut[:i])) for i in range(len(cut))]
        words = [w for p in cut for w in p]
        text, at = " ".join(words), [0]
        for w in words:
            at.append(at[-1] + len(w) + 1)
        for name, quote in quotes:
            whole = folded(quote or "")
            parts = [p for p in map(folded, re.split(r"\s*[\[(]?\s*(?:\.\.\.|…)\s*[\])]?\s*", quote or "")) if p]
            met = [] if not whole else [i for i in range(len(text)) if text.startswith(whole, i)]
            short = len(parts) > 1 and min(map(len, parts)) >= 20 and not met
            if short:
                for i in (i for i in range(len(text)) if text.startswith(parts[0], i)):
                    end = i + len(parts[0])
                    for p in parts[1:]:
                        end = -1 if end < 0 or (k := text.find(p, end, end + 301 + len(p))) < 0 else k + len(p)
                    met += [i] * (end >= 0)
            if len(whole.split()) < 3:  # short ones stand for whole words
                met = [i for i in met if i in at and (i + len(whole) == len(text) or text[i + len(whole)] == " ")]
            for i in met:
                place = bisect_right(at, i) - 1
                out.append((doc, name, short, place, bisect_right(starts, place)))
    return sorted(out, key=str)


def searched(spark, documents, quotes):
    docs = spark.createDataFrame([(i, p, "k", 1, 2, 0.5) for i, p in documents], NAMES)
    asked = spark.createDataFrame([(i, t, 1, [2]) for i, t in quotes], "item_id long, text string, gram int, pieces array<int>")
    return sorted((tuple(r) for r in evidence.search(docs, asked).collect()), key=str)


LONG = "the quick brown fox jumps over the lazy dog and then some more words follow here until nothing is left to say"


def test_search_finds_every_occurrence(spark):
    random.seed(2)
    some = [" ".join(random.choices(["alpha", "beta", "gamma", "delta", "be", "ta"], k=60)) for _ in range(12)]
    documents = [(i, [t[:90], t[90:200], "", None, t[200:]]) for i, t in enumerate(some)]
    documents += [(20, [f"**{LONG.upper()}** | {LONG}", LONG + " " + "x " * 160 + LONG]), (21, []), (22, None), (None, [LONG]), (23, ["", LONG[:40], LONG[40:]]), (24, ["word " * 2000 + LONG])]
    quotes = [(i, some[i % 12][a : a + n]) for i, (a, n) in enumerate((random.randrange(250), random.randrange(1, 60)) for _ in range(40))]
    quotes += [(100, LONG), (101, LONG[5:50]), (102, LONG[:30] + " [...] " + LONG[-30:]), (103, LONG[:30] + "…" + LONG[40:70] + " (…) " + LONG[-24:]), (104, LONG[-30:] + " … " + LONG[:30]), (105, "short … " + LONG), (106, None), (107, ""), (108, "***"), (109, "dog"), (110, "lazy dog"), (111, "azy do"), (112, "azy dog an"), (113, "alpha beta … gamma delta alpha")]
    want = plain_search(documents, quotes)
    assert searched(spark, documents, quotes) == want
    assert {102, 103, 112} <= {r[1] for r in want} and any(r[2] for r in want) and {r[4] for r in want} >= {1, 2}


def test_search_over_nothing(spark):
    assert searched(spark, [], [(1, LONG)]) == [] and searched(spark, [(1, [LONG])], []) == []
    assert searched(spark, [(1, [LONG]), (1, [LONG]), (1, ["other"])], [(5, LONG), (5, LONG)])[0] == (1, 5, False, 0, 1)


def test_no_nested_loop_and_no_product(spark):
    docs = spark.createDataFrame([(1, [LONG])], "doc_id long, pages array<string>")
    plan = evidence.search(docs, spark.createDataFrame([(1, LONG)], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


def test_as_of_with_a_hot_key(spark):
    random.seed(4)
    rows = [(random.choice([1, 1, 1, 2, 3, None]), random.choice([None, *range(300)]), i) for i in range(800)]
    marks = [(random.choice([1, 2, 4, None]), random.choice([None, *range(0, 300, 7)]), m) for m in range(60)]
    left, right = spark.createDataFrame(rows, "k int, at int, _mark int"), spark.createDataFrame(marks, "k int, at int, m int")
    want = []
    for k, at, i in rows:
        before = [(a, m) for q, a, m in marks if q == k and a is not None and at is not None and a <= at]
        want.append((k, at, i, max(before)[1] if before else None))
    for width in (1, 40, 1000):
        got = evidence.as_of(left, right, "k", "at", "m", width)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def plain_furniture(pages):
    """(doc, page, text) rows of distinct pages -> what stays of each."""
    def on_edge(lines):
        at = [i for i, x in enumerate(lines) if x.strip() and not x.strip().startswith("|")]
        return {*at[:3], *at[-3:]}

    key = lambda x: re.sub(r"\d", "#", x.strip())
    out = []
    for doc, page, text in pages:
        own = [(t or "").split("\n") for d, _, t in pages if d == doc]
        seen = [{key(p[i]) for i in on_edge(p)} for p in own]
        gone = lambda x: (n := sum(key(x) in s for s in seen)) >= 2 and n > 0.3 * len(own) or re.match(r"^([-–]?\s*\d{1,4}\s*[-–]?|\d{1,4}\s*/\s*\d{1,4})$", x.strip())
        lines = (text or "").split("\n")
        edge = on_edge(lines)
        left = [x for i, x in enumerate(lines) if not (i in edge and gone(x))]
        out.append((doc, page, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def test_furniture_equals_plain_pages(spark):
    random.seed(6)
    rows = []
    for doc in [1, 2, 3, None]:
        for page in range(1, random.choice([2, 7, 12])):
            body = [random.choice(["text", "", "| a | b |", "3", f"line {random.randrange(3)}", "  Head 12 ", "- 4 -", "5 / 12", "12345"]) for _ in range(random.randrange(9))]
            rows.append((doc, page, "\n".join([f"Call {doc} of 2024", *body, f" page {page} of 12"])))
    rows += [(9, 1, None), (9, 2, ""), (10, 1, "7")]
    got = without_furniture(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, page int, text string, lines string, at int"))
    want = plain_furniture(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want and sum(r[4] for r in want) > 20
    twice = without_furniture(spark.createDataFrame(rows[:3] * 2, "doc_id int, page int, text string"))
    assert sorted(map(tuple, twice.collect()), key=str) == plain_furniture(rows[:3] * 2)
    assert without_furniture(twice.limit(0).select("doc_id", "page", "text")).count() == 0
    assert got.where(F.col("n_removed") < 0).count() == 0
