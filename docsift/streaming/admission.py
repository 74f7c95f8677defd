"""Sliding-window admission and windowed metrics, as batch folds and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window


def admit(times: list[float], window: float, most: int) -> list[bool]:
    """A request is let in if fewer than `most` let in ones lie within the window before it; refused ones don't count."""
    held: list[float] = []
    out = []
    for t in times:
        held = [x for x in held if x > t - window]
        out.append(len(held) < most)
        if out[-1]:
            held.append(t)
    return out


def admitted(df: DataFrame, key: str, ts: str, order: str, window: float, most: int) -> DataFrame:
    """Batch: df with `admitted`. Each key's rows are streamed in order through a fold that holds at most `most` times.

    Rows are dealt by key and sorted within the partitions, so a key of any size needs no more memory than others.
    """
    columns = df.columns
    schema = df.withColumn("admitted", F.lit(True)).schema
    dealt = df.withColumn("__t", F.col(ts).cast("timestamp").cast("double")).repartition(key).sortWithinPartitions(key, "__t", order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = object(), []
        for b in batches:
            out = []
            for k, t in zip(b[key], b["__t"], strict=True):
                if k != now:
                    now, held = k, []
                held = [x for x in held if x > t - window]
                out.append(len(held) < most)
                if out[-1]:
                    held.append(t)
            yield b[columns].assign(admitted=out)

    return dealt.mapInPandas(run, schema)


def responses(df: DataFrame, skip: Column, key: str, ts: str, order: str, window: float, most: int) -> DataFrame:
    """df with status and retry_after: requests on the skip list are never counted, refused ones get 429 and the window's seconds."""
    free = df.where(skip).select("*", F.lit(200).alias("status"), F.lit(None).cast("int").alias("retry_after"))
    held = admitted(df.where(~skip), key, ts, order, window, most)
    refused = ~F.col("admitted")
    return free.unionByName(held.select(*df.columns, F.when(refused, 429).otherwise(200).alias("status"), F.when(refused, int(window)).alias("retry_after")))


class Admission(StatefulProcessor):
    """The same as state of a stream: the times let in, by key. Old ones leave as new ones come."""

    def __init__(self, window: float, most: int):
        self.window, self.most = window, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [x[0] for x in self.held.get()]
        full = pd.concat(list(rows)).sort_values(["t", "event_id"])
        out = []
        for t in full["t"]:
            held = [x for x in held if x > t - self.window]
            out.append(len(held) < self.most)
            if out[-1]:
                held.append(t)
        self.held.put([(x,) for x in held]) if held else self.held.clear()
        yield pd.DataFrame({"event_id": full["event_id"], "user_id": key[0], "admitted": out})

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, window: float, most: int) -> DataFrame:
    """events (event_id, user_id, t: seconds) as a stream to (event_id, user_id, admitted)."""
    return events.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Admission(window, most), outputStructType="event_id long, user_id long, admitted boolean", outputMode="Append", timeMode="None")


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and kind; as a stream, late rows are dropped after the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", gap) if e.isStreaming else e
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def retained(df: DataFrame, ts: str, kind: str, ages: dict[str, str], as_of: Column) -> DataFrame:
    """Rows younger than their kind's age (an interval's text); kinds without one stay."""
    limit = F.lit(None).cast("timestamp")
    for k, age in ages.items():
        limit = F.when(F.col(kind) == k, as_of - F.expr(f"INTERVAL {age}")).otherwise(limit)
    return df.where(limit.isNull() | (F.col(ts).cast("timestamp") >= limit))


def last_rows(df: DataFrame, by: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
