"""Metrics stored by dimension, rebuilt or refreshed where rows have changed."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import slug
from ..functions.aggregates import aggregate_sql
from ..functions.predicates import named
from ..model import Metric, Source

STATE = "metric_id string, version string, watermark timestamp_ntz, refreshed_at timestamp_ntz"


def grouped(df: DataFrame, metric: Metric, source: Source) -> DataFrame:
    """The metric by its stored dimensions, columns named by dimension id."""
    dims = [named(source.dimension(d).column).alias(d) for d in metric.materialized]
    value = F.expr(aggregate_sql(metric)).alias(metric.id)
    return df.groupBy(*dims).agg(value) if dims else df.agg(value)


def same(a: DataFrame, b: DataFrame, names: tuple[str, ...], prefix: str):
    """Equality of the named columns of a with the prefixed ones of b, nulls equal to nulls."""
    on = F.lit(True)
    for i, n in enumerate(names):
        on = on & a["`" + n.replace("`", "``") + "`"].eqNullSafe(b[f"{prefix}{i}"])
    return on


def merged(old: DataFrame, df: DataFrame, metric: Metric, source: Source, since: datetime) -> DataFrame:
    """`old` with the groups recomputed that have rows newer than `since`.

    Changed groups are found from recent rows alone; only their rows are aggregated again. Null dimension values are groups
    like others.
    """
    names = metric.materialized
    columns = [source.dimension(d).column for d in names]
    changed = df.where(named(metric.watermark_column).cast("timestamp_ntz") > F.lit(since)).select(*[named(c).alias(f"_k{i}") for i, c in enumerate(columns)]).distinct()
    rows = df.join(changed, same(df, changed, tuple(columns), "_k"), "left_semi")
    kept = old.join(changed, same(old, changed, names, "_k"), "left_anti")
    return kept.unionByName(grouped(rows, metric, source))


class MaterializedStore:
    """Stored metrics under a folder: each refresh writes a new version; a row in the state log then points to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._current: dict[str, tuple[str, datetime | None]] = {}
        self._load()

    def _load(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_state")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if fs.exists(path):
            for r in self.spark.read.schema(STATE).parquet(str(path)).orderBy("refreshed_at").collect():
                self._current[r["metric_id"]] = (r["version"], r["watermark"])

    def read(self, metric_id: str) -> DataFrame | None:
        if metric_id not in self._current:
            return None
        return self.spark.read.parquet(f"{self.folder}/{slug(metric_id)}/{self._current[metric_id][0]}")

    def watermark(self, metric_id: str) -> datetime | None:
        return self._current.get(metric_id, (None, None))[1]

    def refresh(self, metric: Metric, source: Source, df: DataFrame, now: datetime) -> DataFrame:
        """Rebuilds a metric, or merges what is newer than its watermark less the grace for late rows."""
        old, mark = self.read(metric.id), self.watermark(metric.id)
        newest = None
        if metric.watermark_column:
            # Before the groups are read: a row that arrives between the two scans is then newer than the mark, and read again.
            newest = df.agg(F.max(named(metric.watermark_column).cast("timestamp_ntz")).alias("m")).first()["m"]
        if metric.materialized_strategy == "incremental" and old is not None and mark is not None:
            out = merged(old, df, metric, source, mark - timedelta(seconds=metric.late_arrival_grace_seconds or 0))
        else:
            out = grouped(df, metric, source)
        version = uuid.uuid4().hex
        out.write.parquet(f"{self.folder}/{slug(metric.id)}/{version}")
        if metric.watermark_column:
            mark = max([x for x in (mark, newest) if x is not None], default=None)
        self.spark.createDataFrame([(metric.id, version, mark, now)], STATE).coalesce(1).write.mode("append").parquet(f"{self.folder}/_state")
        self._current[metric.id] = (version, mark)
        return self.read(metric.id)
