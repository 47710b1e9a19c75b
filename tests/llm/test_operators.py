"""The ten operators against brute force, and on null, empty, repeated and clashing input."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import bpe, decontaminate, digest, linededup, lm, neardedup, packing, quality, repeats, secrets, simhash, suffix, toxicity
from riskloom.llm.components import components
from riskloom.llm.kernels import chunks

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, at int, fp long"
LONG = "word " * 30_000


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null id and text, empty, white space, long, ties and repeated rows, columns with clashing names."""
    rows = [(None, "alpha beta\ngamma delta"), (1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "alpha beta gamma"), (5, "alpha beta gamma"), (6, "é" * 500), (7, "token = abcdefghijklmnop AKIA" + "A" * 20), (8, "x")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int")


BENCH = [(1, "alpha beta gamma"), (2, None), (3, "")]
OPERATORS = {
    "packing": lambda d, m, b: packing.pack(d, BPE),
    "quality": lambda d, m, b: quality.classify(d, m),
    "lines": lambda d, m, b: linededup.dedup(d),
    "simhash": lambda d, m, b: simhash.near_duplicates(d),
    "leaks": lambda d, m, b: decontaminate.leaks(d, b),
    "clean": lambda d, m, b: decontaminate.clean(d, b),
    "secrets": lambda d, m, b: secrets.scan(d)[0],
    "digest": lambda d, m, b: digest.fingerprints(d),
    "toxicity": lambda d, m, b: toxicity.classify(d, m),
    "repeats": lambda d, m, b: repeats.remove(d),
    "lm": lambda d, m, b: lm.score(d),
    "near": lambda d, m, b: neardedup.dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, odd, labels, name):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = OPERATORS[name](odd, labels, bench)
    n = got.count()
    assert n == 10 or name in ("packing", "leaks", "clean", "near")
    if name in ("clean", "near"):
        assert got.columns == odd.columns
    assert OPERATORS[name](odd.limit(0), labels.limit(0), bench.limit(0)).count() == 0


def test_tokens_equal_tokenizers():
    import pyarrow as pa

    random.seed(1)
    parts = ["a", "s", "re", "ll", "'", " ", "  ", "\n", "1", "é", "'s", " 's", "\r\n", "$", "一", "<|endoftext|>", "\x00", "a\x00b", "½"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(3000)]
    whole, mine = Tokenizer.from_file(BPE), bpe.load(BPE)
    for lo, hi, data, at in chunks(pa.array(texts), 5000):
        ids, n = mine.encode(data, at)
        edge = np.concatenate([[0], np.cumsum(n)])
        for r in range(hi - lo):
            assert ids[edge[r] : edge[r + 1]].tolist() == whole.encode(texts[lo + r], add_special_tokens=False).ids


def test_packing_is_exact_and_tight(spark):
    random.seed(2)
    rows = [(i, " ".join(random.choices(["one", "two", "three"], k=random.choice([1, 40, 40, 40, 300, 2500])))) for i in range(300)]
    got = packing.pack(frame(spark, rows), BPE).toPandas()
    whole = Tokenizer.from_file(BPE)
    ids = {i: [*whole.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}
    for r in got.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length.to_numpy()) - g.length.to_numpy()).all() and g.length.sum() <= 1024
    assert got.length.sum() == sum(map(len, ids.values()))
    assert got.sequence_id.nunique() <= 1.03 * math.ceil(got.length.sum() / 1024) + 1


def test_components(spark):
    random.seed(3)
    links = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in list(root))


def test_simhash_links_every_near_pair(spark):
    random.seed(4)
    base = ["".join(random.choices("abcdefg ", k=400)) for _ in range(20)]
    rows = [(i, (b := random.choice(base))[: random.randint(380, 400)] + random.choice(["", " z", " tail"])) for i in range(200)]
    got = simhash.near_duplicates(frame(spark, rows)).toPandas()
    prints = {i: simhash.fingerprint(t.encode()) & (2**64 - 1) for i, t in rows}
    least = {i: i for i in prints}
    for _ in range(10):
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    least[a] = least[b] = min(least[a], least[b])
    assert dict(zip(got.doc_id, got.component_id)) == least
    assert dict(zip(got.doc_id, got.fingerprint)) == {i: f"{p:016x}" for i, p in prints.items()}


def test_near_dedup_keeps_the_smallest_of_each_group(spark):
    random.seed(5)
    vocab = ["".join(random.choices("abcdefghij", k=6)) for _ in range(3000)]
    rows = []
    for g in range(25):
        text = random.choices(vocab, k=200)
        for c in range(random.choice([1, 2, 6])):
            t = list(text)
            for _ in range(0 if c == 0 else random.randint(0, 2)):
                t[random.randrange(200)] = random.choice(vocab)
            rows.append((g * 10 + c, " ".join(t)))
    kept = {r["doc_id"] for r in neardedup.dedup(frame(spark, rows)).collect()}
    assert kept == {i for i, _ in rows if i % 10 == 0}


@pytest.mark.parametrize("length, gram, width, hot", [(40, 8, 8, 4096), (40, 8, 8, 1), (24, 6, 4, 3)])
def test_repeats_equal_brute_force(spark, length, gram, width, hot):
    random.seed(length + hot)
    base = ["".join(random.choices("abc ", k=random.randint(0, 300))) for _ in range(30)]
    texts = []
    for _ in range(120):
        a, b = random.choice(base), random.choice(base)
        texts.append(a[random.randint(0, len(a)) :][:200] + random.choice(["", "é"]) + b[random.randint(0, len(b)) :])
    texts += [*texts[:4], "ab" * 90]
    raw = [t.encode() for t in texts]
    times = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    got = {r["doc_id"]: r for r in repeats.remove(frame(spark, enumerate(texts)), length, gram, width, hot).collect()}
    for d, t in enumerate(raw):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(t, gone) if not y)
        runs = sum(1 for i, y in enumerate(gone) if y and not (i and gone[i - 1]))
        assert (got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == (sum(gone), runs, hashlib.sha256(kept).hexdigest())


def test_suffix_order():
    random.seed(6)
    for _ in range(2000):
        s = [random.randint(1, 3) for _ in range(random.randint(0, 14))]
        assert suffix.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_secrets_and_ledger(spark):
    rows = [(1, "é password = abcdefghijkl"), (2, "é password = abcdefghijkl"), (3, "token: short"), (4, "AKIA" + "A" * 14 + " " + "0af" * 6)]
    got, ledger = secrets.scan(frame(spark, rows))
    spans = {r["doc_id"]: r["spans"] for r in got.collect()}
    assert spans == {1: "assign:2:25", 2: "assign:2:25", 3: "", 4: "access:0:18,hex:19:37"}
    assert ledger.count() == 3
    again, new = secrets.scan(frame(spark, [*rows, (5, "api_key=ABCDEFGHIJKLMN")]), ledger)
    assert new.count() == 1 and {r["doc_id"]: r["spans"] for r in again.collect()} == spans | {5: "assign:0:22"}


def test_digest_next_and_likeness(spark):
    random.seed(7)
    rows = [(i, "".join(random.choices("abcdefghijklmnop \n", k=random.randint(0, 3000)))) for i in range(40)]
    got = {r["doc_id"]: r for r in digest.fingerprints(frame(spark, rows)).collect()}
    for i, t in rows:
        after = rows[(i + 1) % 40][1]
        half = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert got[i]["near_next"] == digest.likeness(digest._of([t])[0], digest._of([after])[0])
    assert np.mean([got[i]["near_edited"] for i, t in rows if len(t) > 500]) > 0.3 > np.mean([got[i]["near_next"] for i, _ in rows]) + 0.1


def test_leaks_with_paraphrase(spark):
    random.seed(8)
    vocab = ["".join(random.choices("abcdefghij", k=6)) for _ in range(4000)]
    items = [(i, " ".join(random.choices(vocab, k=30))) for i in range(20)]
    rows, want = [], set()
    for d in range(120):
        w = random.choices(vocab, k=150)
        if d < 40:
            p = q = items[d % 20][1].split()
            if d >= 20:
                q = [x if random.random() > 0.15 else random.choice(vocab) for x in q]
            w[50:50] = q
            if sum(a == b for a, b in zip(p, q)) >= 18 and sum(a == b for a, b in zip(p[-10:], q[-10:])) >= 5:  # the rule: item and answer
                want.add((d, d % 20))
        rows.append((d, " ".join(w)))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 30 and got == want


def test_language_model_base_and_normalised(spark):
    rows = [(i, " ".join(random.Random(i).choices(["A", "b", "c", "dd", "e"], k=i))) for i in range(60)]
    got = {r["doc_id"]: r for r in lm.score(frame(spark, rows)).collect()}
    count = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*t.lower().split(), None])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        w = [*t.lower().split(), None]
        assert abs(got[i]["base_score"] - sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w) and got[i]["n_known"] == sum(count[x] > 0 for x in w) and got[i]["train_tokens"] == n
    # every context's probabilities of all outputs, and of a slot's words and the unknown one, add up to 1
    r = np.random.default_rng(1)
    net = lm.Net(r.integers(0, 9, lm.OUTPUTS).astype(float), (r.normal(0, 1, lm._EDGES[-1]), np.ones(0)))
    w = np.concatenate([np.arange(lm.TOP + 1) * lm.SLOTS, np.arange((lm.TOP + 1) * lm.SLOTS, lm.OUTPUTS)])
    for two, one in ((0, 0), (5, 9000)):
        assert abs((10.0 ** net.logs(np.full(len(w), two), np.full(len(w), one), w // lm.SLOTS, w)).sum() - 1) < 1e-4


def test_language_model_learns_context_and_covers_every_word(spark):
    """Against a plain count of the corpus and a brute-force sum over its words: after an even word comes an odd one."""
    rng = random.Random(3)
    vocab = [f"w{i:03d}{'ab'[i % 2]}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(vocab[(k % 2) :: 2]) for k in range(200))) for i in range(300)]
    got = lm.score(frame(spark, rows)).where("held_out").collect()
    assert got and sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 0.05 * sum(r["n_tokens"] for r in got)
    # the chance of a one-word text, over every word that was learnt and one for all others, is at most 1
    words = sorted({x for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for x in t.split()})
    ones = [(10_000 + i, w) for i, w in enumerate(words)]
    held = [(i, w) for i, w in ones if zlib.crc32(str(i).encode()) % 7 == 2]
    part = {r["doc_id"]: r["score"] for r in lm.score(frame(spark, [*rows, *held])).where("doc_id >= 10000").collect()}
    assert len(part) == len(held) and 0 < sum(10**x for x in part.values()) < 1


def test_hashes_tell_words_of_regular_structure_apart(spark):
    """Thue-Morse words and their complements collide under any polynomial modulo 2**64."""
    one = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (3, two), (5, two), (6, "x " + one + " " + two)]
    whole = Tokenizer.from_file(BPE)
    got = packing.pack(frame(spark, rows), BPE).toPandas()
    for i, t in rows:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")
        part = got[got.doc_id == i].sort_values("piece")
        assert part.length.sum() == len(ids) and [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part.start, part.length)] == part.ids_crc32.tolist()
    learn = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in learn for w in [*t.split(), None])
    n, v = sum(count.values()), len(count)
    for r in lm.score(frame(spark, rows)).collect():
        w = [*dict(rows)[r["doc_id"]].split(), None]
        assert abs(r["base_score"] - sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) < 1e-9
    alone = {r["doc_id"]: r["n_removed"] for r in repeats.remove(frame(spark, [(1, one), (3, two)])).collect()}
    raw = [t.encode() for t in (one, two)]
    times = Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    for d, t in zip((1, 3), raw):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if times[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        assert alone[d] == sum(gone)


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, module, label):
    random.seed(9)
    vocab = ["".join(random.choices("abcdefghij", k=5)) for _ in range(500)]
    marks = ["zzbad", "zzworse", "zzworst"]
    rows = [(i, " ".join([*random.choices(vocab, k=60), *(random.choices(marks, k=3 if label == "toxic" else 30) if i % 4 == 0 else [])])) for i in range(500)]
    truth = {i: int((i % 4 == 0) == (label == "toxic")) for i, _ in rows}
    got = module.classify(frame(spark, rows), spark.createDataFrame(list(truth.items()), f"doc_id long, {label} int")).where(F.col("held_out")).collect()
    assert got and np.mean([r["predicted"] == truth[r["doc_id"]] for r in got]) >= 0.95


def test_line_dedup_keeps_the_first_and_shifts(spark):
    block = [f"shared line {i}" for i in range(40)]
    rows = [(1, "\n".join(block)), (2, "\n".join(["new head", "second", *block, "tail"]))]
    got = {r["doc_id"]: r for r in linededup.dedup(frame(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
    assert got[2]["n_removed"] >= 25 and "new head" in got[2]["text"] and "tail" in got[2]["text"]


def _near_pairs(size, jaccard, pairs, rng):
    """Texts (2 i, 2 i + 1) whose five-word shingle sets have this similarity: they share a run of words."""
    out = []
    for _ in range(pairs):
        own = round(size * (1 - jaccard) / 2)  # distinct shingles at each end
        both = [f"w{rng.getrandbits(60)}" for _ in range(size - 2 * own + 4)]
        out += [" ".join(both + [f"x{rng.getrandbits(60)}" for _ in range(own)]), " ".join([f"y{rng.getrandbits(60)}" for _ in range(own)] + both)]
    return out


@pytest.mark.parametrize("size, jaccard", [(10, 0.8), (160, 0.8), (400, 0.85)])
def test_near_dedup_recall_at_its_threshold(spark, size, jaccard):
    rows = list(enumerate(_near_pairs(size, jaccard, 150, random.Random(size))))
    kept = {r["doc_id"] for r in neardedup.dedup(frame(spark, rows)).collect()}
    assert all(i in kept for i, _ in rows[::2])
    assert sum(i not in kept for i, _ in rows[1::2]) >= 0.95 * 150


def test_near_dedup_equals_brute_force_on_chains(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(6):  # edits of edits: members that a leader rejects are similar to each other
        texts = [[f"v{rng.getrandbits(40)}" for _ in range(150)]]
        for _ in range(25):
            t = list(rng.choice(texts[-3:]))
            for _ in range(rng.randint(1, 3)):
                t[rng.randrange(150)] = f"v{rng.getrandbits(40)}"
            texts.append(t)
        rows += [" ".join(t) for t in texts]
    rng.shuffle(rows)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    kept = {r["doc_id"] for r in neardedup.dedup(frame(spark, enumerate(rows))).collect()}
    assert kept == set(root)


def test_near_dedup_keeps_different_texts_with_a_dominating_repeat(spark):
    rng = random.Random(12)
    line = "one two three four five six seven eight nine"
    rows = [(i, " ".join([line] * 200 + [f"u{rng.getrandbits(50)}" for _ in range(1000)])) for i in range(8)]
    assert neardedup.dedup(frame(spark, rows)).count() == 8


def test_leaks_of_long_items(spark):
    rng = random.Random(13)
    vocab = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(6000)]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([70, 130, 200, 500, 1500])]
    rows, want = [], set()
    for d in range(30):
        w = rng.choices(vocab, k=300)
        if d < 10:
            q = items[d % 5][1].split()
            if d >= 5:
                q = [x if rng.random() > 0.15 else rng.choice(vocab) for x in q]
            w[37 + d : 37 + d] = q
            want.add((d, d % 5))
        elif d < 15:
            w[50:50] = items[d % 5][1].split()[: len(items[d % 5][1].split()) // 2]  # half an item isn't a leak
        rows.append((d, " ".join(w)))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == want
    assert all(r["common_words"] == r["item_words"] for (d, _), r in got.items() if d < 5)


def test_leaks_with_answers_outside_the_item(spark):
    rng = random.Random(14)
    vocab = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    answers = [" ".join(f"{rng.choice('klmn')}{rng.getrandbits(40):x}" for _ in range(k)) for k in (1, 4, 60)]
    items = [(i, " ".join(rng.choices(vocab, k=25)), a) for i, a in enumerate(answers)]
    rows = []
    for i, q, a in items:  # question with its answer, with another answer, alone
        for k, tail in enumerate([a, answers[(i + 1) % 3], ""]):
            rows.append((10 * i + k, " ".join([*rng.choices(vocab, k=80), q, tail, *rng.choices(vocab, k=80)])))
    got = {(r["doc_id"], r["item_id"], r["answer_share"]) for r in decontaminate.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string, answer string")).collect()}
    assert got == {(10 * i, i, 1.0) for i in range(3)}


def test_line_dedup_takes_columns_named_like_its_own(spark):
    names = ["mk", "mt", "hash", "pos", "first", "_ld_key", "_ld_marked_key", "_ld_text", "all", "chunk", "n_removed"]
    block = "\n".join(f"shared line {i}" for i in range(40))
    rows = [(i, f"own {i}\n{block}", *range(len(names))) for i in range(6)] + [(None, None, *range(len(names))), (7, "", *range(len(names)))]
    plain = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    want = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in linededup.dedup(plain).collect()), key=repr)
    got = linededup.dedup(docs).collect()
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got), key=repr) == want
    assert sum(r[3] for r in want) > 0 and all(r["mk"] == 0 and r["mt"] == 1 and r["_ld_key"] == 5 for r in got)


def test_labelled_texts_stay_within_their_bytes(spark):
    """Ids in order of their hashes while the bytes fit, the first one always; texts themselves pass no single-partition exchange."""
    sizes = {i: 50 + 37 * i % 100 for i in range(40)}
    docs = spark.createDataFrame([(i, "x" * n) for i, n in sizes.items()] + [(i, "y" * n) for i, n in sizes.items()], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in sizes], "doc_id long, label int")
    order = [r["doc_id"] for r in marks.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    for most, largest in ((40, 900), (10, 10_000), (40, 1)):
        want, total = [], 0
        for k, i in enumerate(order[:most]):
            total += sizes[i]
            if total <= largest or k == 0:
                want.append(i)
        got = quality.bounded(docs, marks, most, largest)
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)
        assert all(len(r["text"]) == sizes[r["doc_id"]] and r["label"] == r["doc_id"] % 2 for r in got.collect())


def test_the_latent_space_is_fitted_on_all_documents(spark, monkeypatch):
    """Against the same steps on a dense matrix of every document's blocks, with many more documents than FIT_DOCS."""
    monkeypatch.setattr(decontaminate, "FIT_DOCS", 4)
    draw = np.random.default_rng(3)
    names = [f"word{i}" for i in range(30)]
    rows = [(i, " ".join(draw.choice(names, 40))) for i in range(60)] + [(60, None), (61, "")]
    items = [" ".join(draw.choice(names, 14)) for _ in range(3)]
    h = decontaminate.Item(0, " ".join(names), None).words
    vocabulary, idf = np.unique(np.array(h, np.uint64)), np.linspace(1, 2, 30).astype(np.float32)
    place = dict(zip(names, np.searchsorted(vocabulary, np.array(h, np.uint64))))

    def bent(texts):
        g = np.zeros((30, 30))
        for t in texts:
            w = [place[x] for x in (t or "").split()]
            for k in range(0, len(w), decontaminate.BLOCK):
                part = w[k : k + decontaminate.BLOCK]
                row = np.bincount(part, minlength=30) * idf
                g += np.outer(row, row) / (idf[part] ** 2).sum()
        return g

    g = 20 * bent(items) + 0.5 * bent([t for _, t in rows])
    want = np.random.default_rng(11).normal(size=(30, 30)).astype(np.float32)
    for _ in range(2):
        want = np.linalg.qr(g @ want + 1e-6 * want)[0].astype(np.float32)
    known = decontaminate.known_blocks(decontaminate.text_or_empty(frame(spark, rows).repartition(3)), vocabulary)
    got = decontaminate.latent(known, 0.5, items, vocabulary, idf)
    assert np.abs(np.abs(got[:, :8]) - np.abs(want[:, :8])).max() < 5e-3
    searches = decontaminate.prepared(frame(spark, rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert [len(s.items) for s in searches] == [3]


def test_the_fit_of_the_latent_space_reads_the_words_once(spark, monkeypatch):
    """Both steps go over the words' pairs, each pair once, not over all blocks again."""
    made = []
    monkeypatch.setattr(decontaminate, "saved", lambda df, name, own=decontaminate.saved: made.append((name, own(df, name))) or made[-1][1])
    texts = ["red blue red", "blue green", None, ""] * 50
    h = np.unique(np.array(decontaminate.Item(0, "red blue green", None).words, np.uint64))
    known = decontaminate.known_blocks(decontaminate.text_or_empty(frame(spark, list(enumerate(texts))).repartition(3)), h)
    decontaminate.latent(known, 1.0, ["red green"], h, np.ones(3, np.float32))
    (name, met), = made
    red, blue, green = (int(np.searchsorted(h, x)) for x in decontaminate.Item(0, "red blue green", None).words)
    assert name == "latent-pairs"
    want = {(red, red): 50 * 4 / 3, (red, blue): 50 * 2 / 3, (blue, red): 50 * 2 / 3, (blue, blue): 50 / 3 + 25, (blue, green): 25, (green, blue): 25, (green, green): 25}
    assert {(r["i"], r["j"]): round(r["g"], 6) for r in met.collect()} == {k: round(v, 6) for k, v in want.items()}


def test_near_dedup_takes_the_links_of_operator_4(spark, monkeypatch):
    """Without any band met, equal and close fingerprints still bring near copies together; the exact check holds them to the similarity."""
    own = neardedup.meetings
    monkeypatch.setattr(neardedup, "meetings", lambda nodes: own(nodes).limit(0))
    draw = np.random.default_rng(8)
    text = list(draw.choice([f"w{i}" for i in range(5000)], 3000))
    near = [" ".join(text[:-1] + [x]) for x in ("one", "two")]
    other = [" ".join(["same nine words stand here again and again now"] * 200 + list(draw.choice([f"v{i}" for i in range(5000)], 400))) for _ in range(2)]
    prints = [simhash.fingerprint(t.encode()) for t in near + other]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.DISTANCE
    rows = [(0, near[0]), (1, near[1]), (2, other[0]), (3, other[1]), (4, None), (5, near[0])]
    assert sorted(r["doc_id"] for r in neardedup.dedup(frame(spark, rows)).collect()) == [0, 2, 3, 4]
