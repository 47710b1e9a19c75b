"""Version choice against a loop that drops and retries; typed values against Python's own types."""

import json
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from riskloom.operators.domains import FLAG, Domain, violation, violations
from riskloom.operators.versions import checked, chosen, marker, problems

CASES = {
    "palyazat-20230115.pdf": ("date", 20230115), "palyazat-120230115.pdf": ("number", 0), "palyazat-20230231.pdf": ("number", 0), "a-2-sz-mod.pdf": ("number", 2),
    "a_4sz-mod.pdf": ("number", 4), "a-mod2.pdf": ("number", 2), "a-mod-3.pdf": ("number", 3), "a-2mod.pdf": ("number", 2), "a-v9.pdf": ("number", 9), "a_V10.PDF": ("number", 10),
    "a-módosítás.pdf": ("number", 1), "a_módosított_felhívás.pdf": ("number", 1), "módszer.pdf": ("number", 0), "": ("number", 0), None: ("number", 0),
}


def test_markers(spark):
    rows = spark.createDataFrame([(n,) for n in CASES], "name string").select("name", marker(F.col("name")).alias("m")).collect()
    assert {r["name"]: (r["m"]["kind"], int(r["m"]["rank"])) for r in rows} == CASES


def rank(name):
    if d := re.search(r"-(20\d{6})\.", name):
        return "date", int(d[1])
    v = re.search(r"-v(\d+)", unicodedata.normalize("NFC", name))
    return "number", int(v[1]) if v else 0


def retried(group, pin, override):
    """Fates of one call's (id, name, readable): choose, drop what can't be read, choose again."""
    fates, left = {}, list(group)
    while left:
        if pin is not None or override is not None:
            pick, by = next(c for c in left if c[0] == (override if pin is None else pin)), "override" if pin is None else "gold_pin"
        else:
            marks = [rank(n) for _, n, _ in left]
            best = max(marks)
            if len(left) > 1 and (len({k for k, _ in marks}) > 1 or marks.count(best) > 1):
                return fates | {i: ("needs_review", "version_unclear", None) for i, _, _ in left}
            pick, by = left[marks.index(best)], "only" if len(left) == 1 else "version"
        if pick[2]:
            other = "not_the_gold_version" if by == "gold_pin" else "older_version"
            return fates | {i: ("included", None, by) if i == pick[0] else ("excluded", other, None) for i, _, _ in left}
        fates[pick[0]] = ("excluded", "unreadable", None)
        left.remove(pick)
    return fates


def test_choice_equals_dropping_and_retrying(spark):
    draw, groups, pins, overrides = random.Random(3), {}, [], []
    for call in range(400):
        kind = draw.choice(["v", "v", "v", "d", "both"])
        names = [f"a-v{draw.randrange(6)}.pdf" if kind == "v" or kind == "both" and draw.random() < 0.8 else f"a-2024010{draw.randrange(1, 7)}.pdf" for _ in range(draw.randrange(1, 6))]
        groups[call] = [(call * 10 + i, n, draw.random() < 0.5) for i, n in enumerate(names)]
        for config, share in ((pins, 0.1), (overrides, 0.15)):
            if draw.random() < share and (ok := [c[0] for c in groups[call] if c[2]]):
                config.append((call, draw.choice(ok)))
    rows = spark.createDataFrame([(c, *r) for c, g in groups.items() for r in g], "call long, id long, name string, readable boolean")
    config = [spark.createDataFrame(x, "call long, id long") for x in (pins, overrides)]
    got = {r["id"]: (r["fate"], r["reason"], r["chosen_by"]) for r in checked(rows, *config).collect()}
    want = {}
    for c, g in groups.items():
        want |= retried(g, dict(pins).get(c), dict(overrides).get(c))
    assert got == want
    assert len({v for v in want.values()}) == 8


def test_choices_that_are_lost(spark):
    rows = spark.createDataFrame([(1, 10, "a-v1", None), (2, 20, "a", True), (2, 21, "a", True), (3, 30, "a", False), (4, 40, "a", True), (None, 50, None, True)], "call long, id long, name string, readable boolean")
    pins = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (9, 90)], "call long, id long")
    overrides = spark.createDataFrame([(3, 30), (4, 41)], "call long, id long")
    assert {tuple(r) for r in problems(rows, pins, overrides).collect()} == {
        (1, "the pinned version can't be read"), (2, "more than one pin"), (3, "the overriding version can't be read"), (4, "the override is no candidate"), (9, "the pinned version is no candidate")}
    fates = {r["id"]: r["reason"] for r in chosen(rows, pins, overrides).collect()}
    assert fates == {10: "choice_lost", 20: "choice_lost", 21: "choice_lost", 30: "choice_lost", 40: "choice_lost", 50: "call_unknown"}
    with pytest.raises(ValueError, match="2: more than one pin"):
        checked(rows, pins, overrides)
    assert chosen(rows.limit(0), pins, overrides).count() == 0


DOMAINS = {
    "flag": FLAG, "days": Domain(numbers=True, least=0, whole=True, words=("open",)), "share": Domain(numbers=True, least=0, most=100), "months": Domain(numbers=True, over=0),
    "kinds": Domain(members=("a", "b"), needed=False), "at.city": Domain(words=("x",), needed=False),
}


def plain(name, held):
    """Why a JSON value is outside, by Python's types."""
    domain = DOMAINS[name]
    if held is None:
        return "null"
    if type(held) in (int, float) and domain.numbers:
        low = domain.least is not None and held < domain.least or domain.over is not None and held <= domain.over
        return "not whole" if domain.whole and held != math.floor(held) else "too small" if low else "too large" if domain.most is not None and held > domain.most else None
    if isinstance(held, str) and domain.words:
        return None if held in domain.words else "unknown word"
    if isinstance(held, list) and domain.members:
        return "empty list" if not held else None if all(isinstance(m, str) and m in domain.members for m in held) else "unknown member"
    return "wrong type"


def test_every_violation_is_listed(spark):
    values = [0, 1, 2, -1, 0.5, 1.0, 30.01, 100, 101, True, False, "1", "open", "a", "", [], ["a"], ["a", "b", "a"], ["c"], ["a", 1], [None], {}, {"x": 1}, None]
    rows, want = [], set()
    base = {"flag": 1, "days": 3, "share": 1, "months": 1}
    for n, name in enumerate(("flag", "days", "share", "months", "kinds")):
        for i, v in enumerate(values):
            key = n * 100 + i
            rows.append((key, json.dumps(base | {name: v})))
            if why := plain(name, v):
                want.add((key, name, why))
    rows += [(900, None), (901, "{"), (902, "[1]"), (903, "{}"), (904, json.dumps(base | {"at": {"city": "y"}, "b": 1, "a": None})), (905, json.dumps(base)), (905, json.dumps(base)), (None, json.dumps(base))]
    want |= {(900, None, "no record"), (901, None, "broken record"), (902, None, "not an object"), (905, None, "several records")} | {(903, f, "missing") for f in base}
    want |= {(904, "at.city", "unknown word"), (904, "a", "unknown field"), (904, "b", "unknown field")}
    got = violations(spark.createDataFrame(rows, "given long, v string"), "given", "v", DOMAINS).collect()  # names of its own inside
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_numbers_must_be_finite(spark):
    rows = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (2.0,)], "x double").select(F.to_variant_object(F.struct("x")).alias("v"))
    got = rows.select(violation(F.try_variant_get("v", "$.x", "variant"), Domain(numbers=True)).alias("w")).collect()
    assert [r["w"] for r in got] == ["not finite"] * 3 + [None]


def test_large_calls_are_decided_alike(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(call, call * 100 + i, f"a-v{i // 2 if call % 4 == 0 else i}.pdf", draw.random() < 0.4) for call in range(12) for i in range(1 + call)] + [(None, 9999, "a", True)]
    frame = spark.createDataFrame(rows, "call long, id long, name string, readable boolean")
    none = spark.createDataFrame([], "call long, id long")
    want = sorted(map(tuple, chosen(frame, none, none).collect()), key=repr)
    monkeypatch.setattr("riskloom.operators.versions.LARGE", 3)
    monkeypatch.setattr("riskloom.operators.versions.SALTS", 4)
    assert sorted(map(tuple, chosen(frame, none, none).collect()), key=repr) == want and len(want) == len(rows)
