"""Operators 11 to 13 against brute force, and on null, empty, repeated and clashing input."""

import hashlib
import random
import zlib
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import alignment, throttle, topk

DIR = "/root/testdata/sf0.001"
C = throttle.COST


# --- 11: exact top-k search


def plain_search(rows, k):
    """rows: (id, vector); all rows against every query, each by itself."""
    use = [(n, i, [int(np.floor(64 * np.float64(x))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q in use:
        if i is not None and i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for m, j, v in use if m != n)[:k]
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(near, 1)]
    return sorted(out, key=str)


def searched(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, 0, "a", 1.5) for i, v in rows], "vec_id long, embedding array<float>, cell int, query string, score double")
    return sorted((tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0, k).collect()), key=str)


@pytest.mark.parametrize("rows", [16, 8192])
def test_search_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(topk, "QUERIES", 7)  # several blocks and shards
    monkeypatch.setattr(topk, "ROWS", rows)
    random.seed(rows)
    vectors = [[random.choice([0.0, 0.0, 0.0, random.uniform(-1, 1)]) for _ in range(12)] for _ in range(60)]
    data = [(random.randrange(400), random.choice(vectors)) for _ in range(900)]  # repeated ids, ties, equal vectors
    data += [(None, vectors[0]), (20, None), (40, [0.5, None]), (60, [float("nan")]), (80, [float("inf"), 1.0]), (100, []), (120, [1.0]), (140, [3e38, 1e-3])]
    small = [(i, v) for i, v in data if v is None or not any(x and abs(x) > 1e30 for x in v)]
    assert searched(spark, small, 5) == plain_search(small, 5)
    assert len(searched(spark, data, 5)) == len(searched(spark, small, 5)) + 5


def test_search_of_few_rows_and_none(spark):
    rows = [(0, [0.5, -0.5]), (1, [0.25, 0.0]), (20, [0.5, -0.5])]
    assert searched(spark, rows) == [(0, 1, 20, 2048), (0, 2, 1, 512), (20, 1, 0, 2048), (20, 2, 1, 512)]
    assert searched(spark, []) == [] and searched(spark, [(0, [1.0])]) == [] and searched(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_sums_beyond_32_bits(spark):
    rows = [(0, [20_000.0] * 300), (1, [20_000.0] * 300), (2, [-20_000.0] * 300)]
    assert searched(spark, rows) == [(0, 1, 1, 300 * 1_280_000**2), (0, 2, 2, -300 * 1_280_000**2)]


def test_search_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    want = con.sql(topk.ORACLE)
    names = want.columns
    assert sorted(tuple(r[c] for c in names) for r in topk.nearest(spark, DIR).collect()) == sorted(want.fetchall())


# --- 12: cross-tokenizer alignment


def plain_alignment(texts):
    """Whole texts, token by token; no cuts, no memory."""
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    letters = {c: x for x, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]))}
    letters |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(letters.values()))}
    rows = []
    for text in texts:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        from_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        from_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode() if text else None
        if not text or b"".join(from_a) != whole or b"".join(from_b) != whole:
            rows.append((0, 0, [], []))
            continue
        ends = [dict(zip(np.cumsum([len(t) for t in x]).tolist(), range(len(x)))) for x in (from_a, from_b)]
        groups, links, i, j = [], [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            x, y = ends[0][end] + 1, ends[1][end] + 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            links.append((ids_a[x - 1], ids_b[y - 1]))
            i, j = x, y
        rows.append((len(ids_a), len(ids_b), groups, links))
    counts = Counter(p for r in rows for p in r[3])
    most_a, most_b = Counter(), Counter()
    for (x, y), n in counts.items():
        most_a[x], most_b[y] = max(most_a[x], n), max(most_b[y], n)
    return [(n_a, n_b, len(g), len(p), sum(counts[x] == most_b[x[1]] for x in p), sum(counts[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if p else "", sum(counts[x] == most_a[x[0]] for x in p)) for n_a, n_b, g, p in rows]


def aligned(spark, texts):
    df = spark.createDataFrame([(i, t, 1, [2], 3) for i, t in enumerate(texts)], "doc_id long, text string, number int, pairs array<int>, a int").repartition(3)
    return [tuple(r)[1:] for r in sorted(alignment.align(df).collect(), key=lambda r: r["doc_id"])]


def test_alignment_equals_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 40)
    monkeypatch.setattr(alignment, "OUT", 60)
    random.seed(3)
    bits = ["a", "the", "word", "Zürich", "naïve", "'s", " ", " ", " ", " ", "  ", "\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", "日本語", "😀", "é", "▁", "<|endoftext|>", "<s>", "<0x41>", "1234", "...", "\x00", "ﬁ", "don't"]
    texts = ["".join(random.choices(bits, k=random.randint(1, 14))) for _ in range(600)]
    texts += [None, "", " ", "  ", "\n", "▁", " a", "a ", "the the the", "the the the", "x" * 5000, "word " * 3000, "a​ b", "supercalifragilistic"]
    assert aligned(spark, texts) == plain_alignment(texts)


def test_alignment_of_a_given_table(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.documents(spark, DIR).collect()}
    assert [got[r["doc_id"]] for r in rows] == plain_alignment([r["text"] for r in rows])


def test_repeated_and_nameless_documents_count_each(spark):
    df = spark.createDataFrame([(None, "one two"), (7, "one two"), (7, "one two"), (8, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in alignment.align(df).collect()), key=str)
    assert [r[0] for r in got] == [7, 7, 8, None] and got[0][1:] == got[1][1:] == got[3][1:] and got[0][6] == 3 * got[0][4]
    assert got[2][1:] == (0, 0, 0, 0, 0, 0, "", 0)
    assert alignment.align(df.limit(0)).count() == 0


def test_linked_pairs_have_a_bound(spark):
    pair = alignment.load(public_tokenizers.path(alignment.BYTE_BPE), public_tokenizers.path(alignment.PIECE_BPE))
    assert pair.cuts and pair.bound() < 1_000_000
    held = alignment.aligned(spark.read.parquet(f"{DIR}/documents.parquet"), public_tokenizers.path(alignment.BYTE_BPE), public_tokenizers.path(alignment.PIECE_BPE))
    for r in alignment.pair_counts(held).collect():
        x, y = pair.bytes_a[r["a"]], pair.bytes_b[r["b"]]
        assert x.endswith(y) or y.endswith(x)


# --- 13: token-bucket click throttling


def plain_throttle(rows, batches=10, cost=C, burst=12, lateness=throttle.LATENESS):
    """rows: (click_id, ts, arrived_at, client_id) with datetimes, none twice; one batch and one client after another."""
    zero = datetime(1970, 1, 1)
    us = lambda t: (t - zero) // timedelta(microseconds=1)
    rows = [(i, us(t), None if a is None else us(a) // throttle.HOUR, c) for i, t, a, c in rows if t is not None and c is not None]
    hours = [h for _, _, h, _ in rows if h is not None]
    held: dict = {b: [] for b in range(batches)}
    for i, t, h, c in rows:
        b = batches - 1 if h is None else (h - min(hours)) * batches // (max(hours) - min(hours) + 1)
        held[min(batches - 1, b + (zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 0))].append((c, t, i is None, i or 0))
    out, waiting, accounts, largest = [], [], {}, None
    for b in range(batches):
        floor = None if largest is None else largest - lateness
        passed = lambda w: floor is not None and w[1] < floor
        due, late = [w for w in waiting if passed(w)], [w for w in held[b] if passed(w)]
        waiting = [w for w in waiting + held[b] if not passed(w)]
        if b == batches - 1:
            due, waiting = due + waiting, []
        for c, t, none, i in sorted(due):
            credit, last, start, end = accounts.get(c, (burst * cost, t, None, None))
            credit = min(burst * cost, credit + t - last)
            if credit >= cost:
                credit, start, end, said = credit - cost, None, None, "admitted"
            else:
                start, end, said = (t, t + cost - credit, "throttled") if start is None else (start, end, "throttled")
            accounts[c] = credit, t, start, end
            out.append((None if none else i, said, b, credit, start, end))
        out += [(None if none else i, "late", b, None, None, None) for c, t, none, i in late]
        largest = max([w[1] for w in held[b]], default=largest) if largest is None else max([largest, *(w[1] for w in held[b])])
    return sorted(out, key=str)


COLUMNS = ("click_id", "outcome", "batch", "credit_after", "penalty_start_us", "penalty_end_us")


def throttled(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1.0, 9) for r in rows], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, tick string, clock double, batch int").repartition(2)
    return sorted((tuple(r[c] for c in COLUMNS) for r in throttle.throttle(df, **how).collect()), key=str)


def test_throttle_wakes_clients_and_keeps_late_clicks(spark):
    """Many buckets, so that most have no row in most batches; bursts, ties, nulls, an empty batch in the middle."""
    random.seed(5)
    day, rows = datetime(2024, 3, 30), []
    for i in range(260):
        at = day + timedelta(seconds=random.randrange(5 * 86400), microseconds=random.randrange(3) * 333_333)
        at = at if not 1.9 < (at - day).total_seconds() / 86400 < 3.1 else day + timedelta(days=1)  # empty batches, and a burst
        lag = timedelta(seconds=random.choice([1, 2, 60, 9 * 3600, 30 * 3600]))
        rows.append((i, at, at + lag, random.choice([*[1] * 60, *range(2, 60)])))
    rows += rows[:20] + [(None, day, day, 1), (300, None, day, 1), (301, day, None, 1), (302, day, day, None), (303, day + timedelta(days=4), day + timedelta(days=6), 1), (303, day + timedelta(days=4), day + timedelta(days=6), 1)]
    want = plain_throttle(list(dict.fromkeys(rows)))
    assert throttled(spark, rows, bucket=8) == want
    said = Counter(r[1] for r in want)
    assert said["late"] and said["throttled"] and len({r[2] for r in want}) > 5


def test_throttle_of_a_given_table(spark):
    rows = [(r["click_id"], r["ts"], r["arrived_at"], r["client_id"], r["kind"], r["value"], r["props"]) for r in spark.read.parquet(f"{DIR}/clicks.parquet").collect()]
    want = plain_throttle([r[:4] for r in dict.fromkeys(rows)])
    assert sorted((tuple(r[c] for c in COLUMNS) for r in throttle.outcomes(spark, DIR).collect()), key=str) == want


def test_throttle_of_one_click_and_of_none(spark):
    at = datetime(2024, 1, 1)
    assert throttled(spark, [(1, at, at, 5)]) == [(1, "admitted", 9, 11 * C, None, None)]
    assert throttled(spark, []) == []


def test_penalty_lasts_until_a_click_is_affordable():
    accounts: dict = {}
    rows = np.array([[1, t, 0, i] for i, t in enumerate([0, 0, 0, C // 2, C - 1, C, C])], np.int64)
    _, admitted, credit, start, end = throttle.settle(rows, accounts, C, 2)
    assert admitted.tolist() == [True, True, False, False, False, True, False]
    assert [*zip(start[~admitted].tolist(), end[~admitted].tolist())] == [(0, C)] * 3 + [(C, 2 * C)]
    assert credit.tolist() == [C, 0, 0, C // 2, C - 1, 0, 0]
