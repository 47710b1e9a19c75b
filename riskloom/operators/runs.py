"""Runs and lineage: append-only events, published partitions, checks of what a run reads.

A run's state is its latest event; its rows are a partition that appears whole when it is published, so a
reader never sees half of one. Nothing is updated in place.
"""

from __future__ import annotations

import hashlib
import json
import secrets
import subprocess
from collections.abc import Callable, Iterable, Mapping
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.files import exists, remove

# Stages in the order in which they run.
STAGES = ("C1", "C2", "L1", "L2", "L3", "M1", "M2", "E1", "E2", "E3", "E4")
EVENTS = "run_id string, stage string, status string, at timestamp, seq long, code_version string, config_json string, config_hash string, report_path string, error string"
EDGES = "run_id string, input_run_id string"


class RunError(ValueError):
    """A run that can't be used as asked."""


def new_run_id(stage: str) -> str:
    if stage not in STAGES:
        raise RunError(f"unknown stage {stage!r}")
    return f"{stage}-{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{secrets.token_hex(3)}"


def canonical(values: Mapping) -> str:
    return json.dumps(values, sort_keys=True, ensure_ascii=False, default=str)


def code_version(folder: str = ".") -> str:
    """The commit that runs, marked where files were changed since."""

    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True, timeout=10).stdout.strip()

    try:
        return git("rev-parse", "HEAD") + ("-dirty" if git("status", "--porcelain") else "")
    except (OSError, subprocess.SubprocessError):
        return "unknown"


class Runs:
    """Runs under a root folder: `events`, `inputs`, and one folder a table with a partition a run."""

    def __init__(self, spark: SparkSession, root: str, version: str | None = None):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version or code_version()

    def _rows(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        return self._rows("events", EVENTS)

    def _add(self, run_id: str, stage: str, status: str, config: str | None = None, report: str | None = None, error: str | None = None) -> None:
        seq = self.events().where(F.col("run_id") == run_id).count()
        hashed = None if config is None else hashlib.sha256(config.encode()).hexdigest()
        row = (run_id, stage, status, datetime.now(timezone.utc), seq, self.version, config, hashed, report, error)
        self.spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").parquet(f"{self.root}/events")

    def states(self) -> DataFrame:
        """One row a run: its latest status, the rest from where it was said last."""
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
        return self.events().groupBy("run_id", "stage").agg(F.max_by("status", "seq").alias("status"), F.min("at").alias("started_at"), F.max("at").alias("changed_at"), last("config_json"), last("config_hash"), last("report_path"), F.max_by("error", "seq").alias("error"), F.sum((F.col("status") == "resumed").cast("int")).alias("resumes"))

    def get(self, run_id: str):
        return self.states().where(F.col("run_id") == run_id).first()

    def start(self, stage: str, config: Mapping, inputs: Iterable[str] = ()) -> str:
        run_id = new_run_id(stage)
        if edges := [(run_id, i) for i in inputs]:
            self.spark.createDataFrame(edges, EDGES).coalesce(1).write.mode("append").parquet(f"{self.root}/inputs")
        self._add(run_id, stage, "running", canonical(config))
        return run_id

    def complete(self, run_id: str, report: str | None = None) -> None:
        self._add(run_id, self._known(run_id)["stage"], "complete", report=report)

    def fail(self, run_id: str, error: str) -> None:
        self._add(run_id, self._known(run_id)["stage"], "failed", error=error)

    def resume(self, run_id: str, stage: str) -> None:
        row = self.get(run_id)
        if row is None or row["stage"] != stage or row["status"] == "complete":
            raise RunError(f"run {run_id} is not an unfinished {stage} run")
        self._add(run_id, stage, "resumed")

    def _known(self, run_id: str):
        row = self.get(run_id)
        if row is None:
            raise RunError(f"run {run_id} does not exist")
        return row

    def inputs(self, run_id: str) -> list[str]:
        return [r[0] for r in self._rows("inputs", EDGES).where(F.col("run_id") == run_id).select("input_run_id").distinct().orderBy("input_run_id").collect()]

    def code_versions(self, run_id: str) -> list[str]:
        """What the run started with, then one for each time it went on."""
        return [r[0] for r in self.events().where((F.col("run_id") == run_id) & F.col("status").isin("running", "resumed")).orderBy("seq").select("code_version").collect()]

    def require_complete(self, run_id: str, stage: str) -> None:
        row = self._known(run_id)
        if row["stage"] != stage:
            raise RunError(f"run {run_id} is a {row['stage']} run, not {stage}")
        if row["status"] != "complete":
            raise RunError(f"run {run_id} is {row['status']}, not complete")

    def input_of(self, run_id: str, stage: str) -> str:
        """The one run of a stage among a run's inputs, at whatever distance."""
        states = {r["run_id"]: r["stage"] for r in self.states().select("run_id", "stage").collect()}  # a row a run
        parents: dict[str, set[str]] = {}
        for r in self._rows("inputs", EDGES).collect():
            parents.setdefault(r["run_id"], set()).add(r["input_run_id"])
        seen, step = set(), {run_id}
        while step := {p for r in step for p in parents.get(r, ())} - seen:
            seen |= step
        found = sorted(r for r in seen if states.get(r) == stage)
        if len(found) != 1:
            raise RunError(f"run {run_id} reads {len(found)} {stage} runs: {found}")
        return found[0]

    def publish(self, run_id: str, table: str, rows: DataFrame, key: list[str] | None = None) -> None:
        """Write a run's rows beside the table, check their key, then make them its partition by one rename."""
        staged, place = f"{self.root}/_staged/{run_id}/{table}", f"{self.root}/{table}/run_id={run_id}"
        if exists(self.spark, place):
            raise RunError(f"{table} already has run {run_id}")
        rows.write.mode("overwrite").parquet(staged)
        if key and (twice := self.spark.read.parquet(staged).groupBy(*key).count().where("count > 1").first()):
            remove(self.spark, staged)
            raise RunError(f"{table}: several rows for {twice.asDict()}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        store = path(place).getFileSystem(self.spark._jsc.hadoopConfiguration())
        store.mkdirs(path(f"{self.root}/{table}"))
        if not store.rename(path(staged), path(place)):
            raise RunError(f"{table}: run {run_id} can't be published")

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        """A table's rows, of one run (its partition alone is read); columns added later are null before."""
        df = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{table}")
        return df if run_id is None else df.where(F.col("run_id") == run_id)

    def newest_with(self, table: str, column: str, wanted: DataFrame) -> str | None:
        """The newest complete run whose rows hold every wanted value (division)."""
        many = wanted.select(column).distinct().count()
        held = self.read(table).join(wanted.select(column).distinct(), column, "left_semi").groupBy("run_id").agg(F.countDistinct(column).alias("n")).where(F.col("n") == many)
        row = held.join(self.states().where("status = 'complete'"), "run_id").orderBy(F.desc("started_at"), F.desc("run_id")).select("run_id").first()
        return row[0] if row else None

    def catalogue(self) -> dict[str, list[tuple[str, str]]]:
        """Tables with their columns and types, as stored."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        store = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in store.listStatus(path(self.root)) if s.isDirectory() and not s.getPath().getName().startswith("_"))
        return {n: self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{n}").dtypes for n in names}

    @contextmanager
    def stage(self, stage: str, config: Mapping, inputs: Iterable[str] = ()):
        """A run that is complete where its body ends, failed where it raises; what it staged is then removed."""
        run_id = self.start(stage, config, inputs)
        try:
            yield run_id
        except Exception as e:
            remove(self.spark, f"{self.root}/_staged/{run_id}")
            self.fail(run_id, f"{type(e).__name__}: {e}")
            raise
        self.complete(run_id)


def run_all(runs: Runs, bodies: Mapping[str, Callable], config: Mapping, order: Iterable[str] = ("C1", "C2", "L1", "L2", "L3", "E1", "L2", "L3", "M1", "M2", "E2", "E4", "E3")) -> dict[str, str]:
    """Run stages in order, a body gets (run id, latest run of each stage, config); what E1 returns joins the
    config, so that the second L2 prefers the sources that it suggests."""
    done, config = {}, dict(config)
    for stage in order:
        with runs.stage(stage, config, done.values()) as run_id:
            said = bodies[stage](run_id, dict(done), config) if stage in bodies else None
        done[stage] = run_id
        if stage == "E1" and said:
            config["preferences"] = said
    return done


def one_source(observations: DataFrame, reserved: Iterable[str] = ("manual", "old baseline")) -> str:
    """The only source of a run's observations."""
    found = [r[0] for r in observations.select("source").distinct().limit(3).collect()]
    if len(found) != 1:
        raise RunError(f"one source expected, found {sorted(found)}")
    if found[0] in reserved:
        raise RunError(f"the name {found[0]!r} is reserved")
    return found[0]


def preferences_text(preferences: Mapping[str, str], run_id: str) -> str:
    """Suggested preferences as a section of the settings."""
    head = f"# Preferred sources suggested by run {run_id}: the higher agreement with the experts, regex on a tie.\n"
    return head + "consolidate:\n  preferred_source:\n" + "".join(f"    {k}: {v}\n" for k, v in preferences.items()) + f"  preferences_from_run: {run_id}\n"


def estimate(texts: DataFrame, characters_per_token: float, answer_tokens: int, price_in: float, price_out: float, batch: bool = False):
    """(documents, tokens in, tokens out, cost) of asking a model about every text, before any is sent."""
    half = 2 if batch else 1
    row = texts.agg(F.count(F.lit(1)), F.sum(F.ceil(F.length("text") / characters_per_token))).first()
    n, tokens = int(row[0]), int(row[1] or 0)
    return n, tokens, n * answer_tokens, (tokens * price_in + n * answer_tokens * price_out) / 1e6 / half


def required(rows: DataFrame, problem: str, columns: list[str], most: int = 20) -> None:
    """Raise with a list where a table of violations isn't empty."""
    found = rows.select(*columns).limit(most + 1).collect()
    if found:
        raise RunError(f"{problem}: " + "; ".join(str(tuple(r)) for r in found[:most]) + (" ..." if len(found) > most else ""))
