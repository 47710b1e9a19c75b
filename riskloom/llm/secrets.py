"""Operator 6: secret scans over an incremental blob ledger.

Every distinct text (historical version) is a blob addressed by its SHA-256. The ledger has a row
for each blob and rule version scanned so far with what was found; only pairs not in it are
scanned, once each, and findings are joined back to every path (document) that holds the blob.
`scan_with` keeps the ledger as a stored table that every run reads and appends to.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import lean, saved, text_or_empty
from riskloom.llm.kernels import buffers

RULE_VERSION = "base-1+pem-1"
#: Kinds in the order in which they are listed where starts are equal. The first three are the base.
KINDS = ("assign", "access", "hex", "pem")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
PEM = re.compile(rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
LEDGER = "blob binary, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_NONE = hashlib.sha256(b"").hexdigest()


def find(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in order. Bytes are searched: every rule is ASCII."""
    got = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    got += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    got += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    got += [(m.start(), 3, m.end()) for m in PEM.finditer(text)]
    got.sort()
    if got and not text.isascii():
        points, at, to = 0, 0, {}
        for b in sorted({x for s, _, e in got for x in (s, e)}):
            points += len(text[at:b].decode())
            at, to[b] = b, points
        got = [(to[s], k, to[e]) for s, k, e in got]
    return got


def screened(text):
    """True where a text can hold anything a rule finds (a superset, evaluated in the JVM)."""
    low = F.lower(text)
    words = [low.contains(w) for w in ("passw", "secret", "token", "apikey", "api_key")]
    out = text.contains("AKIA") | text.contains("PRIVATE KEY-----") | text.rlike("[0-9a-f]{16}")
    for w in words:
        out = out | w
    return out


def _scan(batches):
    for batch in batches:
        data, at = buffers(batch.column("text"))
        rows = []
        for a, b in zip(at, at[1:]):
            got = find(data[a:b].tobytes())
            said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in got]
            base = ",".join(x for x, (_, k, _) in zip(said, got) if k < 3)
            rows.append([sum(k == i for _, k, _ in got) for i in range(3)] + [hashlib.sha256(base.encode()).hexdigest(), ",".join(said)])
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("blob"), *(pa.array(cols[i], pa.int64()) for i in range(3)), *(pa.array(cols[i], pa.string()) for i in (3, 4))], names=["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def unseen(blobs: DataFrame, ledger: DataFrame, rules: str) -> DataFrame:
    """Blobs that the ledger doesn't have under this rule version."""
    return blobs.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings by document, ledger rows to append); ledger: a table of the LEDGER columns, or none yet.

    Only blob and rule-version pairs that the ledger lacks are scanned. A text without any trace of a
    rule costs no move: it is judged by the screen where it lies, and its blob gets an empty ledger
    row. Null and empty texts have no finding; a null doc_id stays; repeated rows get equal findings;
    rows repeated in the ledger count once; an empty table gives no rows."""
    paths, found, new = _fresh(text_or_empty(docs), ledger, rules)
    return _back(paths, found if ledger is None else found.unionByName(_findings(ledger, rules))), new


def _fresh(docs: DataFrame, ledger: DataFrame | None, rules: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(every path with its blob, findings of blobs the ledger lacks, their ledger rows)."""
    keyed = docs.select("doc_id", "text", F.unhex(F.sha2(F.col("text"), 256)).alias("blob"), screened(F.col("text")).alias("hot"))
    paths = saved(keyed.select("doc_id", "blob", "hot"), "paths")
    blobs = paths.groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"))).alias("at"), F.max("hot").alias("hot"))
    blobs = blobs.select("blob", F.col("at.doc_id").alias("holder"), "hot")
    if ledger is not None:
        blobs = unseen(blobs, ledger, rules)
    hot = keyed.where("hot").select("doc_id", "text", "blob").join(blobs.where("hot").select(F.col("blob").alias("b"), "holder"), (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("holder")))
    found = hot.select("blob", "text").mapInArrow(lean(_scan), "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    found = saved(found.dropDuplicates(["blob"]), "findings")
    new = blobs.join(found, "blob", "left").select("blob", F.lit(rules).alias("rules"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")), F.coalesce("base_sha256", F.lit(_NONE)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
    return paths, found, new


def _findings(ledger: DataFrame, rules: str) -> DataFrame:
    return ledger.where((F.col("rules") == rules) & (F.col("spans") != "")).drop("rules").dropDuplicates(["blob"])


def _back(paths: DataFrame, found: DataFrame) -> DataFrame:
    """Findings of each path's blob; a blob without any is nowhere in `found`."""
    back = paths.join(found, "blob", "left")
    return back.select("doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")), F.coalesce("base_sha256", F.lit(_NONE)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def scan_with(path: str, docs: DataFrame, rules: str = RULE_VERSION) -> DataFrame:
    """Findings by document, out of the ledger stored at `path` (a Parquet table, begun if missing):
    what it lacks is scanned and appended first. One writer at a time."""
    spark = docs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    begun = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    paths, _, new = _fresh(text_or_empty(docs), spark.read.schema(LEDGER).parquet(path) if begun else None, rules)
    new.write.mode("append").parquet(path)
    return _back(paths, _findings(spark.read.schema(LEDGER).parquet(path), rules))
