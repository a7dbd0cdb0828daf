"""Quality of a stream per tumbling event-time window, and a stream without repeated events.

Both keep state by key until the watermark has passed: rows may come out of
order by ``delay``; later ones are dropped, and what is kept is bounded by the
windows (or events) of that time. State lives in the checkpoint's store, so a
restart goes on where the last run ended.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Watched:
    """A column whose quality is followed: any value, or numbers within bounds."""

    name: str
    least: float | None = None
    most: float | None = None

    def invalid(self) -> Column:
        tests = [F.lit(False)]
        if self.least is not None:
            tests.append(F.col(self.name) < self.least)
        if self.most is not None:
            tests.append(F.col(self.name) > self.most)
        out = tests[0]
        for test in tests[1:]:
            out = out | test
        return F.coalesce(out, F.lit(False))


def window_quality(stream: DataFrame, time: str, width: str, delay: str, watched: Sequence[Watched], group: Sequence[str] = ()) -> DataFrame:
    """One row per window, group and watched column: rows, nulls, invalid values, completeness, validity, mean, least and most.

    Windows and groups are aggregated before the shuffle; all columns share one
    state row. Rows without a time belong to no window and are dropped.
    """
    facts = []
    for i, w in enumerate(watched):
        number = F.col(w.name).try_cast("double")
        facts += [F.count(F.col(w.name)).alias(f"n{i}"), F.count_if(w.invalid()).alias(f"bad{i}"), F.avg(number).alias(f"mean{i}"), F.min(number).alias(f"least{i}"), F.max(number).alias(f"most{i}")]
    kept = stream.where(F.col(time).isNotNull()).withWatermark(time, delay)
    counted = kept.groupBy(F.window(time, width).alias("window"), *group).agg(F.count(F.lit(1)).alias("rows"), *facts)
    share = lambda part, whole: F.round(100 * part / whole, 4)
    entries = [
        F.struct(
            F.lit(w.name).alias("column"),
            F.col("rows"),
            (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
            F.col(f"bad{i}").alias("invalid"),
            share(F.col(f"n{i}"), F.col("rows")).alias("completeness"),
            F.when(F.col(f"n{i}") > 0, share(F.col(f"n{i}") - F.col(f"bad{i}"), F.col(f"n{i}"))).alias("validity"),
            F.round(f"mean{i}", 4).alias("mean"),
            F.col(f"least{i}").alias("least"),
            F.col(f"most{i}").alias("most"),
        )
        for i, w in enumerate(watched)
    ]
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *group, F.inline(F.array(*entries)))


def without_repeats(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; repeats whose time is at most ``delay`` away are dropped, however many batches apart they come.

    The state of a key is dropped when the watermark passes its time plus
    ``delay``. Rows older than the watermark are dropped like repeats.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def collected(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what the stream yields to a table until all there is has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
