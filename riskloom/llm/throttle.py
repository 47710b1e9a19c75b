"""Operator 13: token buckets that throttle clicks, as a stateful stream on a clock of batch numbers.

Clicks are cut into batches by their arrival and fed to one streaming query that is started anew for
each batch on one checkpoint. Event time is a clock of batch numbers, an hour a batch, with a watermark on
it: it carries event-time timers, which wake clients whose clicks wait although they send no new ones. A
tick in every batch moves the clock, so empty batches count too; a batch's clock is the watermark of the
next one, whose rows are processed before its timers. What is settled is decided by W, the largest click
time of all earlier batches less the lateness, in exact microseconds; it goes to the processor of each
start beside the clock, so that no watermark ever drops a late click.

Clients are grouped: a key of the state is a bucket of clients with about BUCKET clicks altogether, so
that a state call serves many clients, and a task packs what it reads by bucket before the shuffle. A
bucket keeps its clients' accounts as one value and its waiting clicks by days and arrival, so that
settling holds one slice of one bucket. A client stays in one bucket: its credit follows from its clicks
one after another, and a client with a third of all clicks is one task's work.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskloom.llm.base import discard, fold, lean, scratch_root, table

HOUR = 3_600_000_000
BATCHES, COST, BURST, LATENESS = 10, 300 * 1_000_000, 12, 6 * HOUR
#: Clicks of a bucket of clients over the whole input; length of a slice of waiting clicks.
BUCKET, SLICE = 1 << 14, 96 * HOUR
#: Clicks that a task packs at once, and that go out of a bucket at once.
PACK, OUT = 1 << 16, 1 << 14
EVENTS = "click_id long, named boolean, client_id long, ts_us long, step int, bucket long, tick boolean"
PACKED = "bucket long, clock timestamp, held binary"
OUTCOMES = "click_id long, client_id long, ts_us long, outcome string, batch int, credit_after long, penalty_start_us long, penalty_end_us long"
NONE = -(1 << 63)
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONF = {"spark.sql.streaming.stateStore.providerClass": _ROCKS, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
#: Every start opens stores of its own: they take no disk in advance, and those of ended starts are closed soon.
_CONF |= {"spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false", "spark.sql.streaming.stateStore.maintenanceInterval": "5s"}


def micros(df: DataFrame, name: str):
    """Epoch microseconds; a timestamp without a zone is UTC, whatever the session's zone."""
    c = F.col(name)
    return F.unix_micros(F.concat(c.cast("string"), F.lit("+00:00")).cast("timestamp")) if dict(df.dtypes)[name] == "timestamp_ntz" else F.unix_micros(c.cast("timestamp"))


def clock(batch: int) -> int:
    """The clock in milliseconds while a batch is fed."""
    return (batch + 1) * 3_600_000


def packed(rows: DataFrame) -> DataFrame:
    """A row for each bucket of what a task reads: its clicks as (client, ts, unnamed, id), and the batch's clock."""

    def tables(waiting):
        whole = pa.Table.from_batches(waiting)
        bucket, step, tick = (whole.column(c).to_numpy() for c in ("bucket", "step", "tick"))
        clicks = np.stack([whole.column("client_id").to_numpy(), whole.column("ts_us").to_numpy(), ~whole.column("named").to_numpy(), whole.column("click_id").to_numpy()], axis=1).astype(np.int64)
        order = np.lexsort((step, bucket))
        bucket, step, clicks, tick = bucket[order], step[order], clicks[order], tick[order]
        edge = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(step, prepend=step[:1]) != 0))
        held = [clicks[lo:hi][~tick[lo:hi]].tobytes() for lo, hi in zip(edge, [*edge[1:], len(bucket)])]
        at = pa.array([clock(k) * 1000 for k in step[edge].tolist()], pa.timestamp("us", "UTC"))
        return pa.RecordBatch.from_arrays([pa.array(bucket[edge]), at, pa.array(held, pa.binary())], names=["bucket", "clock", "held"])

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
            if n >= PACK:
                yield tables(waiting)
                waiting, n = [], 0
        if waiting:
            yield tables(waiting)

    return rows.mapInArrow(lean(run), PACKED)


def settle(rows: np.ndarray, accounts: dict[int, list[int]], cost: int, burst: int) -> tuple[np.ndarray, ...]:
    """Settle clicks (client, ts, unnamed, id) in order; accounts: client -> [credit, last ts, penalty's start, its end].

    Gives the clicks as they were settled, whether each is admitted, its credit after, and the penalty's start and end."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    said, credits, starts, ends, full, client = [], [], [], [], burst * cost, None
    account: list[int] = []
    for who, ts in zip(rows[:, 0].tolist(), rows[:, 1].tolist()):
        if who != client:
            client = who
            if (account := accounts.get(who)) is None:
                account = accounts[who] = [full, ts, NONE, NONE]
        credit = account[0] + ts - account[1]
        if credit > full:
            credit = full
        account[1] = ts
        if admitted := credit >= cost:
            credit -= cost
            account[2] = account[3] = NONE
        elif account[2] == NONE:
            account[2], account[3] = ts, ts + cost - credit
        account[0] = credit
        said.append(admitted), credits.append(credit), starts.append(account[2]), ends.append(account[3])
    return rows, np.array(said, bool), np.array(credits, np.int64), np.array(starts, np.int64), np.array(ends, np.int64)


class Throttle(StatefulProcessor):
    """One start's processor: settles what waits before `floor` (everything if `last`), for the clients of a bucket."""

    def __init__(self, batch: int, floor: int | None, last: bool, cost: int, burst: int):
        self.batch, self.last, self.cost, self.burst = batch, last, cost, burst
        self.floor = NONE if floor is None else floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accounts = handle.getValueState("accounts", "held binary")
        self.waiting = handle.getMapState("waiting", "slice long, step int, part int", "held binary")

    def handleInputRows(self, key, rows, timerValues):
        part, kept = 0, False
        for frame in rows:
            clicks = np.frombuffer(b"".join(frame["held"]), np.int64).reshape(-1, 4)
            late = clicks[:, 1] < self.floor
            if late.any():
                n = int(late.sum())
                yield self._table(clicks[late], np.full(n, "late", object), np.zeros(n, np.int64), None, None)
            clicks = clicks[~late]
            slices = clicks[:, 1] // SLICE
            for s in np.unique(slices).tolist():
                self.waiting.updateValue((s, self.batch, part), (clicks[slices == s].tobytes(),))
                kept = True
            part += 1
        if self.batch:
            self.handle.deleteTimer(clock(self.batch - 1) - 1)  # settled here, no need to be woken
        yield from self._due(kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._due(False)

    def close(self) -> None:
        pass

    def _due(self, waits: bool):
        """Settle what is due, slice by slice, and ask to be woken at the next batch while anything waits."""
        keys = sorted(tuple(k) for k in self.waiting.keys()) if self.last or self.floor != NONE else []
        due = [k for k in keys if self.last or k[0] * SLICE < self.floor]
        waits |= len(keys) > len(due)
        accounts = self._accounts() if due else {}
        done, n = [], 0
        for s in dict.fromkeys(k[0] for k in due):
            ripe = []
            for k in (k for k in due if k[0] == s):
                rows = np.frombuffer(self.waiting.getValue(k)[0], np.int64).reshape(-1, 4)
                ready = np.ones(len(rows), bool) if self.last else rows[:, 1] < self.floor
                ripe.append(rows[ready])
                if ready.all():
                    self.waiting.removeKey(k)
                else:
                    waits = True
                    if ready.any():
                        self.waiting.updateValue(k, (rows[~ready].tobytes(),))
            done.append(settle(np.concatenate(ripe), accounts, self.cost, self.burst))
            n += len(done[-1][0])
            if n >= OUT:
                yield self._settled(done)
                done, n = [], 0
        if n:
            yield self._settled(done)
        if due:
            self.accounts.update((np.array([[c, *a] for c, a in accounts.items()], np.int64).tobytes(),))
        if waits and not self.last:
            self.handle.registerTimer(clock(self.batch) - 1)

    def _accounts(self) -> dict[int, list[int]]:
        held = self.accounts.get()
        return {c: a for c, *a in np.frombuffer(held[0], np.int64).reshape(-1, 5).tolist()} if held else {}

    def _settled(self, done: list[tuple]) -> pd.DataFrame:
        rows, said, credit, start, end = (np.concatenate(x) for x in zip(*done))
        return self._table(rows, np.where(said, "admitted", "throttled").astype(object), credit, start, end)

    def _table(self, rows, outcome, credit, start, end) -> pd.DataFrame:
        late, stopped = outcome == "late", outcome == "throttled"
        some = lambda values, none: pd.arrays.IntegerArray(np.array(values, np.int64) if values is not None else np.zeros(len(rows), np.int64), none)
        return pd.DataFrame({
            "click_id": some(rows[:, 3], rows[:, 2] != 0), "client_id": rows[:, 0], "ts_us": rows[:, 1], "outcome": outcome, "batch": np.full(len(rows), self.batch, np.int32),
            "credit_after": some(credit, late), "penalty_start_us": some(start, ~stopped), "penalty_end_us": some(end, ~stopped),
        })


def batched(clicks: DataFrame, batches: int = BATCHES, bucket: int = BUCKET) -> DataFrame:
    """Distinct clicks with a time and a client, each with its step (batch) and its bucket of clients."""
    kept = clicks.where(F.col("ts").isNotNull() & F.col("client_id").isNotNull())
    hour = F.expr("(us - pmod(us, 3600000000)) div 3600000000")
    lo, hi, n = kept.select(micros(kept, "arrived_at").alias("us")).select(hour.alias("h")).agg(F.min("h"), F.max("h"), F.count(F.lit(1))).first()
    lo, hi, buckets = lo or 0, hi or 0, max(1, -(-n // bucket))
    once = kept.distinct()
    shifted = (fold("click_id", 7) == 0).cast("int")
    rows = once.select(F.col("click_id").cast("long").alias("click_id"), F.col("client_id").cast("long").alias("client_id"), micros(once, "ts").alias("ts_us"), micros(once, "arrived_at").alias("us"), shifted.alias("shift"))
    step = F.coalesce(F.expr(f"(h - {lo}) * {batches} div ({hi} - {lo} + 1)"), F.lit(batches - 1))
    rows = rows.withColumn("h", hour).withColumn("step", F.least(step + F.col("shift"), F.lit(batches - 1)).cast("int"))
    return rows.select(F.coalesce("click_id", F.lit(0)).alias("click_id"), F.col("click_id").isNotNull().alias("named"), "client_id", "ts_us", "step", F.pmod(F.xxhash64("client_id"), F.lit(buckets)).alias("bucket"))


def _move(spark, old: str, new: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(new).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path(new).getParent())
    if not store.rename(path(old), path(new)):
        raise OSError(f"{old} can't be moved to {new}")


def throttle(clicks: DataFrame, batches: int = BATCHES, cost: int = COST, burst: int = BURST, lateness: int = LATENESS, bucket: int = BUCKET) -> DataFrame:
    """Every distinct click's outcome: click_id, client_id, ts_us, outcome (admitted, throttled or late), batch,
    credit_after, penalty_start_us, penalty_end_us.

    clicks: click_id, ts, arrived_at, client_id (integers and timestamps), any other columns, which only
    tell rows apart. A click costs `cost` microseconds of credit; a client's credit grows with time up to
    `burst` times that. Rows without ts or client_id are left out; rows equal in every column count once. A null
    arrived_at stands in the last batch; a null click_id counts as the empty text for the shift, and is
    settled after the others of its time. Clicks equal in time and id settle in either order. An empty table
    gives no rows. The result is read from files of the shared folder."""
    spark = clicks.sparkSession
    root = f"{scratch_root(spark)}/throttle-{uuid.uuid4().hex}"
    rows = batched(clicks, batches, bucket)
    ticks = spark.range(batches).select(F.lit(0).cast("long").alias("click_id"), F.lit(True).alias("named"), F.lit(0).cast("long").alias("client_id"), F.lit(0).cast("long").alias("ts_us"), F.col("id").cast("int").alias("step"), F.lit(0).cast("long").alias("bucket"), F.lit(True).alias("tick"))
    fed = rows.withColumn("tick", F.lit(False)).unionByName(ticks).withColumn("fed", F.col("step"))
    fed.write.partitionBy("fed").parquet(f"{root}/cut")
    whole = spark.read.schema(f"{EVENTS}, fed int").parquet(f"{root}/cut")
    largest = {r["step"]: r["most"] for r in whole.where(~F.col("tick")).groupBy("step").agg(F.max("ts_us").alias("most")).collect()}  # at most `batches` rows
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        for batch in range(batches):
            earlier = [largest[b] for b in range(batch) if b in largest]
            processor = Throttle(batch, max(earlier) - lateness if earlier else None, batch == batches - 1, cost, burst)
            _move(spark, f"{root}/cut/fed={batch}", f"{root}/fed/{batch}")  # the stream's folder gets this batch's files
            stream = packed(spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{root}/fed")).withWatermark("clock", "0 seconds")
            out = stream.groupBy("bucket").transformWithStateInPandas(processor, OUTCOMES, "Append", "EventTime")
            out.writeStream.format("parquet").outputMode("append").option("path", f"{root}/outcomes").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for name in ("cut", "fed", "state"):
        whole.saved_at = f"{root}/{name}"
        discard(whole)
    return spark.read.schema(OUTCOMES).parquet(f"{root}/outcomes")


def outcomes(spark, sf_dir: str) -> DataFrame:
    return throttle(table(spark, sf_dir, "clicks")).select("click_id", "outcome", "batch", "credit_after", "penalty_start_us", "penalty_end_us")
