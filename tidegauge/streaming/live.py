"""Live forms of the sequential and window operators on Structured Streaming.

Stateful operators keep a bounded state per key (detector fields, or block sums of the last window). Rows of a key are
put in event order inside a micro-batch; the size of a batch is the source's own limit (files or offsets per trigger).
A replay of a whole table goes through ``run_replay``: slices in event order, one per micro-batch, each read by all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.core.session import row_budget, scratch_path
from tidegauge.functions import blocks as bl
from tidegauge.functions import sequential as seq
from tidegauge.operators.vectors import Pca


def stream_parquet(spark: SparkSession, folder: str, name: str, bytes_per_trigger: int | None = None) -> DataFrame:
    """A parquet table (one file or a directory of part files) as a stream, with the schema of the files present.

    Without ``bytes_per_trigger`` all files present form one micro-batch. Operators that need event order take a table by
    ``run_replay`` instead; others may take it in smaller pieces.
    """
    path = f"{folder}/{name}.parquet"
    now = spark.read.parquet(path)
    reader = spark.readStream.schema(now.schema)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    if any(not f.rstrip("/").endswith(f"/{name}.parquet") for f in now.inputFiles()):
        return reader.parquet(path)  # a directory
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


BATCH_KEY, BATCH_ROWS = "spark.tidegauge.stream.batchRows", 500_000
KEY_ROWS = 64  # rows that a key has in a slice on average, at least: each slice costs a trip to the state store for every key in it
STORE_KEY, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_replay(
    rows: DataFrame, key: str, order: list[str], build: Callable[[DataFrame], DataFrame], most: int | None = None, folder: str | None = None
) -> tuple[DataFrame, str]:
    """A table run through a live operator in event order: slices of about ``most`` rows, one micro-batch each.

    Unless told, a slice has the default number of rows or KEY_ROWS for each key, whichever is more, so that the calls of the operator (keys times
    slices) grow no faster than the rows, however many keys there are; no task holds more than one key's rows of a slice.

    The rows are cut into ranges of ``order`` once. Slice after slice is added to the folder that the stream watches, and the query goes on from
    its progress until it has read it; so the order of slices needs no file times and holds in any store. Inside a slice the
    files are split by the hash of the key: all tasks read at once, and only the rows of one key need to be in order, which the operator sees to.
    """
    spark = rows.sparkSession
    total = rows.count()
    if not most:
        most = row_budget(spark, BATCH_KEY, 0) or max(BATCH_ROWS, KEY_ROWS * rows.select(key).distinct().count())
    base = folder or scratch_path(spark, "live")
    by = [F.col(c).asc_nulls_last() for c in order]
    count = max(1, -(-total // most))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if count > 1:
        cut = rows.repartitionByRange(count, *by).withColumn("_slice", F.spark_partition_id())
        cut.write.partitionBy("_slice").parquet(f"{base}/slices")
        held = spark.read.schema(cut.schema).parquet(f"{base}/slices")
    table = None
    for i in range(count):
        part = held.where(F.col("_slice") == i).drop("_slice") if count > 1 else rows
        part.repartition(tasks, key).write.mode("append").parquet(f"{base}/feed")
        table, _ = run_to_table(build(spark.readStream.schema(rows.schema).parquet(f"{base}/feed")), spark, base)
    return table, base


class DetectorState(StatefulProcessor):
    """One detector per key. State: one value with the counters, the numbers of the detector (for a window method with its window, whose size is
    bounded) and the place of the newest row in its own types. With ``ttl`` milliseconds the state of a key that stays silent for so long goes."""

    def __init__(self, method: str, params: seq.Params, kinds: list[str], ttl: int | None = None):
        self.method, self.params, self.kinds, self.ttl = method, params, kinds, ttl
        self.order = [f"p{i}" for i in range(len(kinds))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        places = ", ".join(f"p{i} {kind}" for i, kind in enumerate(self.kinds))
        self.seen = handle.getValueState("seen", f"n bigint, alarms bigint, late bigint, numbers array<double>, {places}", self.ttl)

    def _in_order(self, batches: list[pd.DataFrame]) -> pd.DataFrame:
        """Rows of a key sorted by their places, nulls last; a few plain arrays are sorted without pandas, as there are many small chunks."""
        chunk = batches[0] if len(batches) == 1 else pd.concat(batches)
        places = [chunk[c].to_numpy() for c in reversed(self.order)]
        if all(p.dtype.kind in "iu" or (p.dtype.kind == "M" and not np.isnat(p).any()) for p in places):
            by = np.lexsort(places)
            return chunk if (by[1:] > by[:-1]).all() else chunk.iloc[by]
        return chunk.sort_values(self.order)

    def _first_late(self, chunk: pd.DataFrame, place: list) -> bool:
        for name, last in zip(self.order, place):
            value = chunk[name].iat[0]
            if last is None or pd.isna(value):
                return False
            if isinstance(value, pd.Timestamp):
                last = pd.Timestamp(last)
                last = last.tz_localize(value.tz) if value.tz is not None and last.tz is None else last
            if value != last:
                return bool(value < last)
        return False

    def _late(self, chunk: pd.DataFrame, place: tuple) -> int:
        """Rows that stand before the newest place of earlier micro-batches, compared column by column."""
        before, same = np.zeros(len(chunk), bool), np.ones(len(chunk), bool)
        for name, last in zip(self.order, place):
            if last is None:
                break
            values = chunk[name]
            last = pd.Timestamp(last) if pd.api.types.is_datetime64_any_dtype(values) else last
            if isinstance(last, pd.Timestamp) and values.dt.tz is not None and last.tz is None:
                last = last.tz_localize(values.dt.tz)
            before |= same & (values < last).to_numpy()
            same &= (values == last).to_numpy()
        return int(before.sum())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        chunk = self._in_order(list(rows))
        n, alarms, late, state, place = 0, 0, 0, None, None
        if (seen := self.seen.get()) is not None:  # each call is a trip to the store: one to read, one to write
            n, alarms, late, numbers, *place = seen
            if self._first_late(chunk, place):  # rows are in order, so where the first is not late none is
                late += self._late(chunk, tuple(place))
            state = [float(x) for x in numbers]
        at, state = bl.trace(self.method, self.params, chunk["x"].to_numpy(np.float64), state)
        newest = [_plain(chunk[c].iat[-1]) for c in self.order]
        if place and late and self._late(chunk.iloc[[-1]], tuple(place)):
            newest = place
        self.seen.update((n + len(chunk), alarms + len(at), late, [float(x) for x in state], *newest))
        if at:
            yield pd.DataFrame({"key": [key[0]] * len(at), "at": [n + a for a in at], "alarm_no": range(alarms + 1, alarms + len(at) + 1), "late": late})

    def close(self) -> None:
        pass


def _plain(value):
    if pd.isna(value):
        return None
    return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value.item() if hasattr(value, "item") else value


def detector_alarms(
    events: DataFrame, key: str, order: list[str], value: Column, method: str, params: seq.Params | None = None, ttl: int | None = None
) -> DataFrame:
    """Alarm rows (key, at, alarm_no, late) of any of the seven methods: position of each alarm in the key's stream, reset after each.

    Rows are read in event order inside a micro-batch, all of a key's rows at once. Rows that come after a later row of an earlier micro-batch are read
    when they come; ``late`` counts those so far, so a reordered input cannot pass for an ordered one. ``ttl`` (milliseconds) is for streams that
    run on: a bounded run of it needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off, else batches without data never end.
    """
    events.sparkSession.conf.set(STORE_KEY, STORE)  # the state store that typed states need
    kinds = [events.schema[c].dataType.simpleString() for c in order]
    rows = events.select(F.col(key).alias("key"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(order)], value.cast("double").alias("x"))
    out = f"key {events.schema[key].dataType.simpleString()}, at bigint, alarm_no bigint, late bigint"
    processor = DetectorState(method, seq.settings(method, params), kinds, ttl)
    alarms = rows.groupBy("key").transformWithStateInPandas(processor, out, "append", "processingTime" if ttl else "none")
    return alarms.withColumnRenamed("key", key)


def window_scores(
    vectors: DataFrame, key: str, order: str, stream: str, model: Pca, eps: float, size: int, stride: int
) -> DataFrame:
    """Mahalanobis score of the last ``size`` vectors at endpoints size, size+stride, ... of each key.

    State: block sums of the window (size/stride vectors of d numbers) and the open block.
    """
    if size % stride:
        raise ValueError("the live form needs a stride that divides the window size")
    blocks, d = size // stride, len(model.mean)
    mean, basis, inv = model.mean, model.components.T.copy(), 1.0 / (model.variances + eps)
    rows = vectors.select(key, order, stream)
    key_type = rows.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, flat = state.get if state.exists else (0, [])
        ring = list(np.asarray(flat, dtype=np.float64).reshape(-1, d))
        chunk = pd.concat(list(batches)).sort_values(order)
        out = []
        for v in chunk[stream]:
            if n % stride == 0:
                ring = ring[-(blocks - 1):] if blocks > 1 else []
                ring.append(np.zeros(d))
            ring[-1] = ring[-1] + np.asarray(v, dtype=np.float64)
            n += 1
            if n >= size and n % stride == 0:
                z = (np.sum(ring, axis=0) / size - mean) @ basis
                out.append((k[0], n, float(np.sqrt(max((z * z * inv).sum(), 0.0)))))
        state.update((n, [float(x) for x in np.concatenate(ring)]))
        if out:
            yield pd.DataFrame(out, columns=[key, "endpoint", "score"])

    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {key_type}, endpoint bigint, score double", "n bigint, ring array<double>", "append", GroupStateTimeout.NoTimeout
    )


def joined_streams(streams: dict[str, DataFrame], uid: str, time: str, carry: list[str], wait: str) -> DataFrame:
    """Rows of several vector streams met by uid: (uid, time, carry, one column per stream).

    Each side waits for the others for ``wait`` of event time, so what a join buffers is bounded by the rows of that span.
    """
    out = None
    for name, df in streams.items():
        one = df.select(F.col(uid).alias(f"_uid_{name}"), F.col(time).alias(f"_time_{name}"), name, *(carry if out is None else [])).withWatermark(f"_time_{name}", wait)
        if out is None:
            first, out = name, one
            continue
        near = F.expr(f"`_time_{name}` BETWEEN `_time_{first}` - INTERVAL {wait} AND `_time_{first}` + INTERVAL {wait}")
        out = out.join(one, (F.col(f"_uid_{first}") == F.col(f"_uid_{name}")) & near)
    return out.select(F.col(f"_uid_{first}").alias(uid), F.col(f"_time_{first}").alias(time), *carry, *streams)


class FusedWindows(StatefulProcessor):
    """Scores of the last ``size`` vectors of every stream at each ``stride``, divided by the streams' thresholds and fused.

    State of a key: the rows read, and a list of block sums (size / stride of them) over the vectors of all streams side by side.
    """

    def __init__(self, models: dict[str, Pca], limits: dict[str, float], eps: float, size: int, stride: int):
        if size % stride:
            raise ValueError("the live form needs a stride that divides the window size")
        self.size, self.stride = size, stride
        self.parts, lo = [], 0
        for name, m in models.items():
            hi = lo + len(m.mean)
            self.parts.append((name, lo, hi, m.mean, m.components.T.copy(), 1.0 / (m.variances + eps), max(limits[name], 1e-12)))
            lo = hi

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getValueState("rows", "n bigint")
        self.sums = handle.getListState("sums", "block array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        chunk = pd.concat(list(rows)).sort_values("uid")
        n, ring = 0, []
        if self.rows.exists():
            n, ring = int(self.rows.get()[0]), [np.asarray(x[0], dtype=np.float64) for x in self.sums.get()]
        x = np.hstack([np.stack(list(chunk[name])).astype(np.float64) for name, *_ in self.parts])
        cuts = np.arange(self.stride - n % self.stride, len(x), self.stride)
        out = []
        for block in np.split(x, cuts):
            if not len(block):
                continue
            if n % self.stride == 0:
                ring = [*ring[max(0, len(ring) - self.size // self.stride + 1) :], np.zeros(x.shape[1])]
            ring[-1] = ring[-1] + block.sum(axis=0)
            n += len(block)
            if n >= self.size and n % self.stride == 0:
                mean = np.sum(ring, axis=0) / self.size
                norms = []
                for _, lo, hi, centre, basis, inverse, limit in self.parts:
                    z = (mean[lo:hi] - centre) @ basis
                    norms.append(float(np.sqrt(max((z * z * inverse).sum(), 0.0))) / limit)
                out.append((key[0], n, max(norms), float(np.mean(norms)), sum(v > 1 for v in norms), max(norms) > 1))
        self.rows.update((n,))
        self.sums.put([([float(v) for v in b],) for b in ring])
        if out:
            yield pd.DataFrame(out, columns=["key", "endpoint", "max_norm", "mean_norm", "votes", "alarm"])

    def close(self) -> None:
        pass


def fused_alarms(rows: DataFrame, key: str, uid: str, models: dict[str, Pca], limits: dict[str, float], eps: float, size: int, stride: int) -> DataFrame:
    """(key, endpoint, max_norm, mean_norm, votes, alarm) of joined streams; vectors of a key are read in the order of ``uid`` inside a micro-batch."""
    rows.sparkSession.conf.set(STORE_KEY, STORE)
    plain = rows.select(F.col(key).alias("key"), F.col(uid).alias("uid"), *models)
    out = f"key {rows.schema[key].dataType.simpleString()}, endpoint bigint, max_norm double, mean_norm double, votes bigint, alarm boolean"
    scored = plain.groupBy("key").transformWithStateInPandas(FusedWindows(models, limits, eps, size, stride), out, "append", "none")
    return scored.withColumnRenamed("key", key)


def error_counts(events: DataFrame, time: str, error: Column, length: str, slide: str | None = None) -> DataFrame:
    """Rows and errors per event-time window of a batch."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return timed.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(error.cast("int")).alias("errors")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "errors"
    )


def error_rate(
    events: DataFrame, spark: SparkSession, time: str, error: Column, length: str, slide: str | None = None, folder: str | None = None
) -> tuple[DataFrame, str]:
    """Event-time error rate per window, complete whatever the order of arrival.

    Counts add up, so every micro-batch stores its own counts per window under its number (a repeated batch overwrites
    them) and the table of rates is their sum. No row is too late, the last window is there, and no state is kept.
    """
    base = folder or scratch_path(spark, "live")

    def put(batch: DataFrame, number: int) -> None:
        error_counts(batch, time, error, length, slide).write.mode("overwrite").parquet(f"{base}/counts/batch={number}")

    events.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    schema = error_counts(spark.createDataFrame([], events.schema), time, error, length, slide).schema
    try:
        parts = spark.read.schema(schema).parquet(f"{base}/counts")
    except AnalysisException:  # no batch, no folder
        parts = spark.createDataFrame([], schema)
    return parts.groupBy("start", "end").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors")), base


def level_cut(reference: DataFrame, keys: list[str], value: str, level: float) -> DataFrame:
    """Smallest reference value whose empirical level reaches ``level``: x is at or above the level iff x >= cut."""
    from tidegauge.operators.signals import ecdf_levels

    steps = ecdf_levels(reference, reference, keys, value)
    return steps.where(F.col("level") >= level).groupBy(*keys).agg(F.min(value).alias("cut"))


def binarize_live(events: DataFrame, cuts: DataFrame, value: str) -> DataFrame:
    """Stream joined to the one-row table of cuts; new rows become 0/1 events without a look-up of the distribution."""
    return events.join(F.broadcast(cuts)).withColumn("event", (F.col(value) >= F.col("cut")).cast("int"))  # one row


def unseen(events: DataFrame, uid: str, time: str | None = None, late: str | None = None) -> DataFrame:
    """Each uid once. The key store holds every uid, so no order of arrival loses a row.

    With ``late``, uids are kept for that long behind the newest ``time`` only: the store stays small, but rows that come
    later than this are dropped; only for sources that promise an order.
    """
    if late is None:
        return events.dropDuplicates([uid])
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([uid])


def run_to_table(stream: DataFrame, spark: SparkSession, folder: str | None = None) -> tuple[DataFrame, str]:
    """Process what is available into a parquet table with an exactly-once file sink; the same folder resumes."""
    base = folder or scratch_path(spark, "live")
    q = (
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out"), base
