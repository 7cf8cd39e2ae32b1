"""Deduplication of series: exact copies, and copies that differ by rounding, with an audit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(obs: DataFrame) -> DataFrame:
    """(pid, digest, n, start, end): times rounded half-even to 6 places, values to 10, in the order of time."""
    one = F.struct(F.bround("time", 6).alias("t"), F.bround("value", 10).alias("v"))
    rows = obs.groupBy("pid").agg(F.array_sort(F.collect_list(one)).alias("s"), F.min("time").alias("start"), F.max("time").alias("end"))
    return rows.select("pid", F.sha2(F.to_json("s"), 256).alias("digest"), F.size("s").alias("n"), "start", "end", "s")


def completeness(df: DataFrame, excluded: tuple[str, ...]) -> Column:
    """How many of the other columns have a value."""
    return sum((F.col(c).isNotNull().cast("int") for c in df.columns if c not in excluded), F.lit(0))


def exact_groups(records: DataFrame, obs: DataFrame) -> DataFrame:
    """(pid, digest, n, start, end, group_size, keep_pid): copies share a digest; the most complete row stays, then one with a url, then the smallest pid.

    records: pid, quality (columns filled), has_url, seq. Series without samples have the digest of an
    empty series, as all such are alike.
    """
    facts = records.select("pid", "quality", "has_url", "seq").join(canonical(obs).drop("s"), "pid", "left")
    facts = facts.withColumns({"digest": F.coalesce("digest", F.sha2(F.lit("[]"), 256)), "n": F.coalesce("n", F.lit(0))})
    by = Window.partitionBy("digest")
    best = by.orderBy(F.desc("quality"), F.desc("has_url"), "pid")
    keep = F.first("pid").over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return facts.withColumns({"group_size": F.count(F.lit(1)).over(by), "keep_pid": keep})


def equivalent(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two vectors differ by no more than rounding: both the largest and the root mean square difference are tiny against their spread."""
    if a.shape != b.shape or not a.size:
        return False
    scale = max(a.std(), b.std(), 1.0)
    gap = np.abs(a - b)
    return bool(gap.max() <= 1e-4 * scale and np.sqrt((gap * gap).mean()) <= 5e-5 * scale)


def near_groups(records: DataFrame, obs: DataFrame) -> DataFrame:
    """(pid, leader, leader_seq, keep_pid, members): clusters of series that share times, kind and place and differ by rounding.

    Within a key, in source order, a series joins the first leader it is equivalent to, else leads
    itself. A key's group holds series with the same rounded times at one place, which bounds it.
    records: pid, seq, quality, has_url, archive, proxy, variable, lat, lon.
    """
    vectors = obs.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct(F.bround("time", 6).alias("t"), F.col("value").alias("v")))).alias("s"))
    vectors = vectors.select("pid", F.sha2(F.to_json(F.transform("s", lambda x: x["t"])), 256).alias("times"), F.transform("s", lambda x: x["v"]).alias("values"))
    text = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(f"k_{c}")
    place = lambda c: F.coalesce(F.bround(c, 4).cast("string"), F.lit("")).alias(f"k_{c}")
    rows = records.join(vectors, "pid").select("pid", "seq", "quality", "has_url", "times", text("archive"), text("proxy"), text("variable"), place("lat"), place("lon"), "values")

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq", kind="stable").reset_index(drop=True)
        leaders: list[int] = []
        of = []
        arrays = [np.asarray(v, dtype=float) for v in group["values"]]
        for k, v in enumerate(arrays):
            found = next((x for x in leaders if equivalent(arrays[x], v)), k)
            if found == k:
                leaders.append(k)
            of.append(found)
        group["cluster"] = of
        rank = group.sort_values(["quality", "has_url", "pid"], ascending=[False, False, True]).groupby("cluster")["pid"].first()
        size = group.groupby("cluster")["pid"].size()
        lead = group.loc[of].reset_index(drop=True)
        return pd.DataFrame({"pid": group["pid"], "leader": lead["pid"], "leader_seq": lead["seq"], "keep_pid": group["cluster"].map(rank), "members": group["cluster"].map(size)})

    keys = ["times", "k_archive", "k_proxy", "k_variable", "k_lat", "k_lon"]
    return rows.groupBy(*keys).applyInPandas(cluster, "pid string, leader string, leader_seq long, keep_pid string, members long")


def deduplicate(records: DataFrame, obs: DataFrame, near: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records kept, in source order; dropped (pid, keep_pid, group_id, reason); groups (group_id, keep_pid, members, reason))."""
    exact = exact_groups(records, obs)
    number = F.dense_rank().over(Window.orderBy("digest"))
    groups = exact.where("group_size > 1").withColumn("group_id", F.concat(F.lit("exact_"), F.lpad(number.cast("string"), 4, "0")))
    dropped = groups.where("pid != keep_pid").select("pid", "keep_pid", "group_id", F.lit("exact").alias("reason"))
    listed = groups.groupBy("group_id", "keep_pid").agg(F.array_sort(F.collect_list("pid")).alias("members")).withColumn("reason", F.lit("exact"))
    kept = records.join(dropped.select("pid"), "pid", "left_anti")
    if near:
        start = listed.count()
        found = near_groups(kept, obs).where("members > 1")
        number = F.dense_rank().over(Window.orderBy("leader_seq")) + start
        found = found.withColumn("group_id", F.concat(F.lit("near_"), F.lpad(number.cast("string"), 4, "0")))
        more = found.where("pid != keep_pid").select("pid", "keep_pid", "group_id", F.lit("rounding-equivalent").alias("reason"))
        listed = listed.unionByName(found.groupBy("group_id", "keep_pid").agg(F.array_sort(F.collect_list("pid")).alias("members")).withColumn("reason", F.lit("rounding-equivalent")))
        dropped = dropped.unionByName(more)
        kept = kept.join(more.select("pid"), "pid", "left_anti")
    return kept.orderBy("seq"), dropped, listed
