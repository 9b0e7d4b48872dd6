"""The progress log as a stream: windowed counts with late data, first occurrences, and running sequence checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files_at_a_time: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(path)


def windowed_counts(events: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each kind in each window; those later than `late` are left out."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, window).alias("w"), kind).agg(F.count("*").alias("n_events")).select("w.start", "w.end", kind, "n_events")


def first_occurrences(events: DataFrame, keys: list[str], at: str, late: str = "2 hours") -> DataFrame:
    """Each key once, as far back as the watermark reaches."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def sequence_breaks(events: DataFrame, key: str, number: str) -> DataFrame:
    """key, expected, found for each event whose number is not the one after its key's last, from 1; the state is one number a key."""

    def check(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        breaks = []
        for n in sorted(x for frame in frames for x in frame[number].tolist()):
            if n != last + 1:
                breaks.append((group[0], last + 1, n))
            last = max(last, n)
        state.update((last,))
        yield pd.DataFrame(breaks, columns=[key, "expected", "found"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(check, f"{key} {kind}, expected long, found long", "last long", "append", GroupStateTimeout.NoTimeout)
