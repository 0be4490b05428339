"""Events of trajectories found on streams: the last row of each trajectory is kept in keyed state, bucket by bucket, so crossings between micro-batches count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import QuernError
from ..shared import ship

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets by hash of the trajectory, each one key of the state; the column that says whose a row is.
BUCKETS, WHO = 512, "__who"


class Events(StatefulProcessor):
    """The trajectories of one bucket together: rows are put in order, held while earlier ones may still come, then compared with the row before.

    A row is an event where `hits` says so of the value before and its own. Without `delay` rows of a trajectory come
    in order; an earlier one fails the stream. With it rows wait until the watermark has passed them, and rows that come
    behind the watermark take no part, as everywhere in Spark. What is kept of a bucket (the place and value of each trajectory's last
    row) is one packed table: a call costs the same few trips to the state store for one trajectory or thousands.
    """

    def __init__(self, order: str, value: str, kind: str, row: T.StructType, time: str | None):
        self.order, self.value, self.kind, self.row, self.time = order, value, kind, row, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "data binary")
        if self.time:
            self.waiting = handle.getListState("waiting", self.row)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows), ignore_index=True)
        # Columns come in order, but those that are no Python names come renamed.
        new.columns = self.row.names
        if not self.time:
            yield self.judged(new)
            return
        self.waiting.appendList([tuple(_plain(x) for x in r) for r in new.itertuples(index=False)])
        yield from self.released(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.time:
            yield from self.released(timerValues)

    def released(self, timers) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([tuple(r) for r in self.waiting.get()], columns=self.row.names)
        if not len(held):
            return
        mark = timers.getCurrentWatermarkInMs()
        at = pd.to_datetime(held[self.time]).astype("datetime64[us]").astype("int64") // 1000
        done = (at <= mark).to_numpy()
        rest = held[~done]
        if len(rest):
            self.waiting.put([tuple(_plain(x) for x in r) for r in rest.itertuples(index=False)])
            self.handle.registerTimer(int(at[~done].min()))
        else:
            self.waiting.clear()
        if done.any():
            yield self.judged(held[done])

    def judged(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([WHO, self.order], kind="stable").reset_index(drop=True)
        who = rows[WHO].to_numpy()
        starts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        ends = np.append(starts[1:], len(rows)) - 1
        last = _unpacked(self.last.get()[0]) if self.last.exists() else {}
        value = pd.to_numeric(rows[self.value]).to_numpy(dtype=float, na_value=np.nan)
        missing = rows[self.value].isna().to_numpy()
        previous = np.append(np.nan, value[:-1])
        at = rows[self.order]
        for i, j, first, final in zip(starts, ends, at.iloc[starts], at.iloc[ends], strict=True):
            place, before = last.get(who[i], (None, None))
            first = _plain(first)
            if place is not None and first < place:
                raise QuernError("out_of_order", f"a row at {first} came after one at {place}; give a delay")
            previous[i] = np.nan if before is None else before
            last[who[i]] = (_plain(final), None if missing[j] else float(value[j]))
        self.last.update((_packed(last),))
        return rows[hits(previous, value, self.kind)][self.row.names]

    def close(self) -> None:
        pass


def _packed(last: dict) -> bytes:
    """Of trajectories the place and value of the last row, as one Arrow stream."""
    table = pa.table({"who": pa.array(list(last), pa.string()), "at": pa.array([x for x, _ in last.values()]), "value": pa.array([x for _, x in last.values()], pa.float64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict:
    who, at, value = (c.to_pylist() for c in pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all().columns)
    return dict(zip(who, zip(at, value, strict=True), strict=True))


def _plain(x):
    """A value as Python has it: what states keep."""
    if x is None or x is pd.NaT or isinstance(x, float) and np.isnan(x):
        return None
    return x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if isinstance(x, np.generic) else x


def hits(before: np.ndarray, now: np.ndarray, kind: str) -> np.ndarray:
    """Where a value has become zero or changed sign (up, down, all), or a condition has become true (true); a missing value before or now is none."""
    with np.errstate(invalid="ignore"):
        if kind == "true":
            return (now > 0) & ~(before > 0)
        up, down = (before < 0) & (now >= 0), (before > 0) & (now <= 0)
    return {"up": up, "down": down, "all": up | down}[kind]


def _who(schema: T.StructType, by: list[str]) -> Column:
    """A trajectory's key as text: the same text where grouping by the columns puts rows together, and only there."""

    def text(name: str) -> Column:
        kind, x = schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            # Both zeros are one key.
            return (x + F.lit(0.0)).cast("string")
        if isinstance(kind, T.TimestampType):
            return F.unix_micros(x).cast("string")
        if isinstance(kind, T.BinaryType):
            return F.hex(x)
        return F.to_json(x, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}) if isinstance(kind, (T.ArrayType, T.StructType)) else x.cast("string")

    return F.to_json(F.array(*[text(b) for b in by]))


def _events(stream: DataFrame, by: list[str], order: str, value: Column, kind: str, time: str | None, delay: str | None, buckets: int) -> DataFrame:
    spark = stream.sparkSession
    if (time is None) != (delay is None):
        raise QuernError("delay", "a delay is told on a column of times")
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ship(spark)
    own, col = stream.columns, lambda name: F.col(f"`{name}`")
    # pandas has longs beside nulls as doubles, which hold 53 bits, and takes NaN for null: null longs go as 0, and one text says what was null (1) or NaN (2).
    kinds = {f.name: f.dataType for f in stream.schema if isinstance(f.dataType, (T.LongType, T.FloatType, T.DoubleType)) and f.name != order}
    longs, numbers = [n for n, k in kinds.items() if isinstance(k, T.LongType)], list(kinds)
    odd = F.concat(F.lit(""), *[F.when(col(n).isNull(), "1").when(F.lit(False) if n in longs else F.isnan(col(n)), "2").otherwise("0") for n in numbers])
    sign = lambda n: F.substring("__odd", numbers.index(n) + 1, 1)
    rows = (stream if time is None else stream.withWatermark(time, delay)).withColumns({"__value": value.cast("double"), WHO: _who(stream.schema, by), "__odd": odd})
    rows = rows.select(*[F.coalesce(col(n), F.lit(0).cast("long")).alias(n) if n in longs else col(n) for n in own], "__value", WHO, "__odd", F.pmod(F.xxhash64(WHO), F.lit(buckets)).cast("int").alias("__bucket"))
    found = rows.groupBy("__bucket").transformWithStateInPandas(Events(order, "__value", kind, rows.schema, time), rows.schema, "Append", "None" if time is None else "EventTime")
    return found.select(*[F.when(sign(n) == "0", col(n)).when(sign(n) == "2", F.lit(None if n in longs else float("nan")).cast(kinds[n])).alias(n) if n in kinds else col(n) for n in own])


def crossings(stream: DataFrame, by: list[str], order: str, value: str, direction: str = "all", time: str | None = None, delay: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows of a stream at which a trajectory's value has changed sign since its row before, in whatever micro-batch that came.

    The same rows as refresh.crossings() finds over the stored whole. With `time` and `delay` rows may come late by so much.
    A micro-batch reads and writes the last rows of all trajectories in the buckets that it touches; a checkpoint holds for one number of `buckets`.
    """
    if direction not in ("all", "up", "down"):
        raise QuernError("crossing", direction)
    return _events(stream, by, order, F.col(value), direction, time, delay, buckets)


def became_true(stream: DataFrame, by: list[str], order: str, condition: Column, time: str | None = None, delay: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows of a stream at which a condition holds and did not on the trajectory's row before; null counts as false."""
    return _events(stream, by, order, F.coalesce(condition, F.lit(False)), "true", time, delay, buckets)


def append_now(found: DataFrame, out: str, checkpoint: str) -> None:
    """All that a stream has so far, appended to a folder of Parquet files; a run that begins again from the checkpoint writes nothing twice."""
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
