"""Stages of a record stream: routing, stacking, accumulating, gating and late-data counts, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tessera.plans.scratch import scratch_path


class Feed:
    """A table as a stream of files in a given order: each file is shown to the stream when those before it are done.

    Spark orders files by modification time, which says little when parallel tasks write them; here only one new file is there at a time.
    """

    def __init__(self, df: DataFrame, order: str, parts: int, clock: bool = False) -> None:
        """clock: adds a column _clock at START, and a last row at CLOSE, of which all else is null."""
        self.spark = df.sparkSession
        df = df.withColumn("_clock", F.timestamp_seconds(F.lit(START))) if clock else df
        self.shown, ranges = scratch_path(self.spark, "stream"), scratch_path(self.spark, "ranges")
        df.repartitionByRange(parts, order).sortWithinPartitions(order).write.parquet(ranges)
        self.files = self.listed(ranges)
        if clock:
            close = scratch_path(self.spark, "close")
            last = self.spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name != "_clock" else F.timestamp_seconds(F.lit(CLOSE)).alias("_clock") for f in df.schema))
            last.coalesce(1).write.parquet(close)
            self.files += self.listed(close)
        self.path(self.shown).getFileSystem(self.conf()).mkdirs(self.path(self.shown))
        self.stream = self.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(self.shown)

    def conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def listed(self, folder: str) -> list[str]:
        """The folder's files by the number of the range that each holds."""
        found = self.path(folder).getFileSystem(self.conf()).listStatus(self.path(folder))
        names = [f.getPath().toString() for f in found]
        return sorted((n for n in names if "/part-" in n), key=lambda n: int(n.rsplit("/part-", 1)[1].split("-")[0]))

    def show(self, file: str) -> None:
        if not self.path(file).getFileSystem(self.conf()).rename(self.path(file), self.path(f"{self.shown}/{file.rsplit('/', 1)[1]}")):
            raise OSError(f"{file} can't be moved to {self.shown}")


#: Seconds on a stream's clock: of all rows, of the timers of open keys, and of the closing row. HELD is how far the watermark stays behind.
START, TIMER, CLOSE, HELD = 7200, 10800, 36000, "1 hour"


def replay(df: DataFrame, order: str, parts: int, clock: bool = False) -> Feed:
    """df as a stream of files in that order, one file a micro-batch; to be run by drained()."""
    return Feed(df, order, parts, clock)


def append_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to its own folder, so that a batch that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def drained(stream: DataFrame, feed: Feed, mode: str = "append") -> DataFrame:
    """Runs a stream over its feed, file by file, and returns all that it wrote, with the batch that wrote it."""
    spark: SparkSession = stream.sparkSession
    out, checkpoint = scratch_path(spark, "sink"), scratch_path(spark, "progress")
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(append_sink(out)).start()
    try:
        for file in feed.files:
            feed.show(file)
            run.processAllAvailable()
    finally:
        run.stop()
    return spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in stream.dtypes)}, batch int").parquet(out)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of an update-mode sink, the last state of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (*keys, "batch"))), "batch").alias("_v")).select(*keys, "_v.*")


def reject_route(stream: DataFrame, kind: str, routes: dict[str, str]) -> DataFrame:
    """Adds the route of each kind; kinds without one go."""
    mapping = F.create_map(*(F.lit(x) for pair in routes.items() for x in pair))
    return stream.withColumn("route", F.try_element_at(mapping, F.col(kind))).where("route is not null")


def stack(stream: DataFrame, key: str, slot: str, value: str, expected: int) -> DataFrame:
    """(key, slots, total) once all expected slots of a key are in; repeated slots are ignored."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slots, values = (list(x) for x in state.get) if state.exists else ([], [])
        if len(slots) >= expected:
            return
        for pdf in batches:
            for s, v in zip(pdf[slot], pdf[value], strict=True):
                if s not in slots:
                    slots.append(int(s))
                    values.append(float(v))
        state.update((slots, values))
        if len(slots) >= expected:
            yield pd.DataFrame({"key": [keys[0]], "slots": [len(slots)], "total": [sum(v for _, v in sorted(zip(slots, values, strict=True)))]})

    return stream.select(F.col(key).cast("long").alias(key), F.col(slot).cast("long").alias(slot), F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(step, "key long, slots long, total double", "slots array<long>, vals array<double>", "append", "NoTimeout")


def accumulate(stream: DataFrame, key: str, cell: str, value: str, order: str, end: str) -> DataFrame:
    """(key, cell, value): buffers a measurement's records and emits its grid (a later record wins) when its end flag arrives, or at the stream's close.

    Records that come after their measurement's grid change nothing more: at the close, a row without cell says how many
    they were. The stream has the clock of replay(): its closing row moves the watermark past the timers of all keys.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *buffers, closed, late = state.get if state.exists else ([], [], [], False, 0)
        cells, values, orders = (list(x) for x in buffers)
        done = state.hasTimedOut
        for pdf in batches:
            if closed:
                late += len(pdf)
                continue
            cells += pdf[cell].tolist()
            values += pdf[value].tolist()
            orders += pdf[order].tolist()
            done |= bool(pdf[end].any())
        emit = done and not closed
        if state.hasTimedOut:
            state.remove()
            if late:
                yield pd.DataFrame({"key": [keys[0]], "cell": pd.array([None], "Int64"), "value": [float(late)]})
        else:
            state.update(([], [], [], True, late) if closed or done else (cells, values, orders, False, 0))
            state.setTimeoutTimestamp(TIMER * 1000)
        if emit:
            grid = pd.DataFrame({"cell": cells, "value": values, "order": orders}).sort_values("order").groupby("cell", as_index=False).last()
            yield pd.DataFrame({"key": keys[0], "cell": grid["cell"], "value": grid["value"]})

    rows = stream.withWatermark("_clock", HELD).where(F.col("_clock") < F.timestamp_seconds(F.lit(CLOSE)))
    rows = rows.select("_clock", F.col(key).cast("long").alias(key), F.col(cell).cast("long").alias(cell), F.col(value).cast("double").alias(value), F.col(order).cast("long").alias(order), F.col(end).alias(end))
    return rows.groupBy(key).applyInPandasWithState(step, "key long, cell long, value double", "cells array<long>, vals array<double>, orders array<long>, closed boolean, late long", "append", "EventTimeTimeout")


def gate_population(stream: DataFrame, gates: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Running Gaussian-weighted mean per key and gate against a fixed gate table."""
    pairs = stream.join(F.broadcast(gates), F.abs(F.col(value) - F.col("centroid")) < F.col("tolerance"))  # few gates
    w = F.exp(-F.pow(F.col(value) - F.col("centroid"), F.lit(2)) / (2 * F.pow(F.col("tolerance"), F.lit(2))))
    return pairs.groupBy(*keys, "gate").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("value"), F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, ts: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts per window and kind, emitted once the watermark has passed the window."""
    counted = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), kind, "n")


def chain(df: DataFrame, stages: list[tuple[Callable[..., DataFrame], dict]]) -> DataFrame:
    """Folds an ordered list of (operator, properties) over df."""
    for stage, properties in stages:
        df = df.transform(stage, **properties)
    return df


def slices(stream: DataFrame, key: str, values: str, size: int) -> DataFrame:
    """(key, slice, values): one row for each run of size values of a record, its header repeated; works on streams as on tables."""
    n = F.ceil(F.size(values) / size)
    cut = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.slice(values, i * size + 1, size))
    return stream.where(F.size(values) > 0).select(key, F.posexplode(cut).alias("slice", "values"))


def register(spark: SparkSession, name: str, fn: Callable[[pd.Series], float], returns: str) -> None:
    """Makes a function of a whole series callable by name from SQL, as an aggregate."""

    def grouped(values: pd.Series) -> float:
        return fn(values)

    spark.udf.register(name, F.pandas_udf(grouped, returns))


def register_table(spark: SparkSession, name: str, handler: type) -> None:
    """Makes a table function's class (see MaskCells) callable by name from SQL."""
    spark.udtf.register(name, F.udtf(handler, returnType=handler.RETURNS))


class MaskCells:
    """(place, bit) of each character of a mask line."""

    RETURNS = "place int, bit int"

    def eval(self, line: str):
        for place, c in enumerate(line or ""):
            yield place, int(c != "-")
