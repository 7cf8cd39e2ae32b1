"""Window means over a stream of samples: the batch operators' sums, kept as state.

Beyond the batch workflow, which has no streams: annual and window means are sums and counts, so they
can be kept up to date as samples arrive, with a watermark on their arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.temporal import window_of


def streaming_window_means(samples: DataFrame, start: int, width: int, arrived: str = "arrived", delay: str = "1 hour", every: str = "10 minutes") -> DataFrame:
    """(arrival window, pid, window_id, total, samples) of a stream with pid, time, value and an arrival time.

    Each arrival window's sums come once it is behind the watermark; their sum over arrival windows
    (``merged_means``) gives the means.
    """
    rows = samples.where("time is not null and value is not null and not isnan(value)").withWatermark(arrived, delay)
    return rows.groupBy(F.window(arrived, every).alias("arrival"), "pid", window_of(F.col("time"), start, width).alias("window_id")).agg(F.sum("value").alias("total"), F.count("value").alias("samples"))


def merged_means(parts: DataFrame) -> DataFrame:
    """(pid, window_id, value) of the sums that a stream has written."""
    return parts.groupBy("pid", "window_id").agg((F.sum("total") / F.sum("samples")).alias("value"))
