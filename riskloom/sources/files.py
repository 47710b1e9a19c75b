"""File sources and sinks: logs, archives, databases, PDFs, gold sets, settings; reports, tables, caches.

Paths are read and written through Spark and Hadoop's file systems, so they may lie in any store.
"""

from __future__ import annotations

import io
import json
import os
import sqlite3
import zipfile
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Folder of an archive, name column, mark of a cell without points, and the points allowed.
FOLDER, NAME, NOT_SCORED = "data/raw_pdfs/", "Felhívás", "-"
FACTORS = ("fin_form", "tam_osszeg", "konzorcium", "bead_napok", "max_tam_int", "eloleg", "idotartam", "tam_tevekenyseg", "egysz_elszam", "biztositek")
ALLOWED = {f: (0, 1, 2, 3) for f in FACTORS} | {"fin_form": (1, 2, 3), "konzorcium": (0, 3), "egysz_elszam": (0, 3), "biztositek": (0, 3), "tam_tevekenyseg": (0, 2, 3)}


class InvalidInput(ValueError):
    """Every problem of an input, in one message."""


def csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file with a header, all strings; a byte order mark belongs to no column."""
    df = spark.read.csv(path, header=True, sep=sep, encoding="UTF-8", multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.toDF(*(c.lstrip("\ufeff").rstrip("\r") for c in df.columns)).na.fill("")


def _raise(problems: list[str], what: str) -> None:
    if problems:
        raise InvalidInput(f"{what}:\n  " + "\n  ".join(sorted(set(problems))))


def downloads(spark: SparkSession, log: str) -> DataFrame:
    """The scrape log's downloaded files, by the last part of their path whichever slash it has."""
    name = F.element_at(F.split(F.translate("file_path", "\\", "/"), "/"), -1)
    return csv(spark, log).where("outcome = 'downloaded'").select(F.lit("scraped").alias("source"), F.col("doc_title").alias("original_name"), F.concat(F.lit("raw_pdfs/"), name).alias("location"), F.col("tender_code").alias("raw_call_code"), F.col("program").alias("programme"), F.nullif("tender_status", F.lit("")).alias("tender_status"))


def archived(spark: SparkSession, path: str, codes: dict[str, str], folder: str = FOLDER) -> DataFrame:
    """Members of a ZIP archive under a folder, with their content and call code; each needs a code."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                held = zipfile.ZipFile(io.BytesIO(content))
                for member in sorted(held.namelist()):
                    if member.startswith(folder) and not member.endswith("/"):
                        yield pa.RecordBatch.from_arrays([pa.array([PurePosixPath(member).name]), pa.array([f"{PurePosixPath(name).name}:{member}"]), pa.array([held.read(member)], pa.binary())], names=["original_name", "location", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "original_name string, location string, content binary")
    known = spark.createDataFrame([*codes.items()], "name string, raw_call_code string")
    missing = files.join(known, F.col("original_name") == F.col("name"), "left_anti")
    _raise([f"no call code for {r['original_name']}" for r in missing.select("original_name").collect()], "the import settings lack call codes")
    return files.join(known, F.col("original_name") == F.col("name")).select(F.lit("manual").alias("source"), "original_name", "location", "raw_call_code", "content")


def provenance(spark: SparkSession, database: str) -> DataFrame:
    """(sha256, url, downloaded) of an SQLite database, opened read-only; the last row of a hash wins."""
    with sqlite3.connect(f"{Path(database).resolve().as_uri()}?mode=ro", uri=True) as db:
        rows = {h: (h, url, when) for h, url, when in db.execute("select file_hash, source_url, download_date from documents")}
    db.close()
    return spark.createDataFrame([*rows.values()], "sha256 string, url string, downloaded string")


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Files with their hash, id (its first 16 digits) and whether they begin as PDFs do."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sha = F.sha2("content", 256)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), sha.alias("sha256"), F.substring(sha, 1, 16).alias("doc_id"), (F.substring("content", 1, 4) == F.lit("%PDF").cast("binary")).alias("is_pdf"), "length", "content")


def conflicts(files: DataFrame) -> DataFrame:
    """Names that stand for several contents (name, sha256)."""
    return files.groupBy("name").agg(F.countDistinct("sha256").alias("contents")).where("contents > 1")


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(name, factor, points) of the experts' file; null where not scored. Every problem is listed."""
    df = csv(spark, path, ";")
    if df.columns != [NAME, *FACTORS]:
        raise InvalidInput(f"unexpected columns: {df.columns}")
    long = df.select(F.trim(NAME).alias("name"), F.explode(F.map_from_arrays(F.array(*map(F.lit, FACTORS)), F.array(*(F.trim(f) for f in FACTORS)))).alias("factor", "cell"))
    allowed = spark.createDataFrame([(f, str(p)) for f, ps in ALLOWED.items() for p in ps], "factor string, cell string")
    bad = long.where(F.col("cell") != NOT_SCORED).join(allowed, ["factor", "cell"], "left_anti")
    twice = long.groupBy("name", "factor").count().where("count > 1").select("name").distinct()
    _raise([f"{r['name']} / {r['factor']}: {r['cell']!r} is not an allowed number of points" for r in bad.collect()] + [f"{r['name']}: appears twice" for r in twice.collect()], "invalid gold file")
    return long.select("name", "factor", F.expr("try_cast(nullif(cell, '-') as int)").alias("points"))


def baseline(spark: SparkSession, path: str, names: DataFrame, renamed: dict[str, str], strict: bool = True) -> DataFrame:
    """(name, factor, status, points) of earlier results (felhivas, factor, regex); an empty cell found nothing.

    names: the gold set's (name). With `strict` every odd row is an error, else it is left out."""
    df = csv(spark, path)
    if lacking := [c for c in ("felhivas", "factor", "regex") if c not in df.columns]:
        raise InvalidInput(f"missing columns {lacking}")
    old = spark.createDataFrame([*renamed.items()], "old string, new string")
    rows = df.select(F.trim("felhivas").alias("old"), F.trim("factor").alias("factor"), F.trim("regex").alias("cell")).join(old, "old", "left").select(F.coalesce("new", "old").alias("name"), "factor", "cell", F.expr("try_cast(cell as double)").alias("p"))
    known = names.select("name").distinct().withColumn("known", F.lit(True))
    ok = (F.col("cell") == "") | (F.col("p").isin(0.0, 1.0, 2.0, 3.0) & F.col("p").isNotNull())
    rows = rows.join(known, "name", "left").withColumn("problem", F.when(F.col("known").isNull(), F.lit("not a call of the gold set")).when(~F.col("factor").isin(*FACTORS), F.lit("unknown factor")).when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("not a number of points: "), "cell")))
    if strict:
        _raise([f"{r['name']} / {r['factor']}: {r['problem']}" for r in rows.where("problem is not null").collect()], "invalid baseline")
    return rows.where("problem is null").select("name", "factor", F.when(F.col("cell") == "", "not_found").otherwise("found").alias("status"), F.col("p").cast("int").alias("points"))


def settings(path: str) -> dict:
    """A settings file (JSON, or YAML where a reader is installed): `data_root` is needed, lies beside the
    file if relative, and RISKLOOM_DATA_ROOT overrides it."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        out = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise InvalidInput("only JSON settings can be read here") from e
        out = yaml.safe_load(text)
    root = os.environ.get("RISKLOOM_DATA_ROOT") or (out or {}).get("data_root")
    if not root:
        raise InvalidInput("data_root is missing")
    return out | {"data_root": str((Path(path).resolve().parent / root).resolve())}


def import_settings(path: str, doc_types: tuple[str, ...] = ("main_call", "product_description", "other")) -> dict[str, dict]:
    """Codes of manual files, overrides of types and versions, and pins of gold names."""
    out = {k: {} for k in ("manual_files", "doc_type_overrides", "version_overrides", "gold_pins")} | json.loads(Path(path).read_text(encoding="utf-8"))
    _raise([f"{d}: {t!r} is no document type" for d, t in out["doc_type_overrides"].items() if t not in doc_types], "invalid import settings")
    return out


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str, encoding: str = "utf-8") -> str:
    """Write a file once: beside its place first, then under its name; never over another."""
    at, store = _store(spark, path)
    if store.exists(at):
        raise FileExistsError(path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    out = store.create(part, True)
    out.write(bytearray(text.encode(encoding)))
    out.close()
    if not store.rename(part, at):
        raise FileExistsError(path)
    return path


def write_json(spark: SparkSession, path: str, value) -> str:
    return write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def remove(spark: SparkSession, path: str) -> None:
    """Take back what a failed run wrote."""
    at, store = _store(spark, path)
    store.delete(at, True)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """A folder of CSV parts with headers; it must be new."""
    df.write.mode("errorifexists").csv(path, header=True, sep=sep, encoding="UTF-8")


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _store(spark, path)
    return store.exists(at)


def cached(wanted: DataFrame, path: str, keys: list[str], make) -> DataFrame:
    """Rows of `wanted` (its keys) out of a Parquet cache; `make` computes those it lacks, which are appended.
    A key that is there is never written again; of two writers at once either's row is taken."""
    spark = wanted.sparkSession
    asked = wanted.dropDuplicates(keys)
    todo = asked.join(spark.read.parquet(path), keys, "left_anti") if exists(spark, path) else asked
    make(todo).write.mode("append").parquet(path)
    return wanted.select(*keys).distinct().join(spark.read.parquet(path).dropDuplicates(keys), keys)


def logged(wanted: DataFrame, path: str, keys: list[str], make) -> DataFrame:
    """The same over a log of JSON lines that a stopped run goes on from."""
    spark = wanted.sparkSession
    todo = wanted.join(spark.read.json(path), keys, "left_anti") if exists(spark, path) else wanted
    make(todo).write.mode("append").json(path)
    return spark.read.json(path)


def markdown_table(df: DataFrame, most: int = 500) -> str:
    """A report table of at most `most` rows."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    rows = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in df.limit(most).collect())]
    return "\n".join(f"| {' | '.join(r)} |" for r in rows) + "\n"


def er_diagram(tables: dict[str, list[tuple[str, str]]], references: list[tuple[str, str]]) -> str:
    """A Mermaid entity diagram of tables (name -> (column, type)) and their references (child, parent)."""
    body = [f"  {t} {{\n" + "".join(f"    {kind} {c}\n" for c, kind in cols) + "  }" for t, cols in tables.items()]
    return "\n".join(["erDiagram", *body, *(f"  {b} ||--o{{ {a} : has" for a, b in references)]) + "\n"


def data_flow(edges: list[tuple[str, str]]) -> str:
    return "\n".join(["flowchart LR", *(f"  {a} --> {b}" for a, b in edges)]) + "\n"


def dashboard(title: str, payload: dict) -> str:
    """One HTML page that carries its payload and lists it."""
    data = json.dumps(payload, ensure_ascii=False, sort_keys=True).replace("</", "<\\/")
    show = "for(const [k,v] of Object.entries(JSON.parse(document.getElementById('data').textContent))){const h=document.createElement('h2');h.textContent=k;const p=document.createElement('pre');p.textContent=JSON.stringify(v,null,1);document.body.append(h,p)}"
    return f'<!doctype html><meta charset="utf-8"><title>{title}</title><body><h1>{title}</h1><script type="application/json" id="data">{data}</script><script>{show}</script></body>\n'
