"""Append-only logs. A row is on disk once append returns; rows of many small files are gathered into Parquet."""

from __future__ import annotations

import json
import threading
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import Files

AUDIT = (
    "query_id string, user_id string, role_id string, nl_prompt string, generated_sql string, status string, deny_reason string, "
    "row_count bigint, duration_ms bigint, created_at timestamp_ntz, is_break_glass boolean, metric_versions string"
)
RUNS = "run_id string, rule_id string, rule_kind string, passed boolean, observed_value string, ran_at timestamp_ntz"


class AppendLog:
    """Rows of one schema, whose first column names a row. Without a path they stay on the driver (for tests and short sessions).

    Each row becomes a small JSON file, written without a job. Every `batch` rows, the files are gathered into a Parquet file
    and removed. A row that is in both, since a process ended between the two, is read once. Logs are read again by
    whoever opens the path later, in this process or another.
    """

    def __init__(self, spark: SparkSession, schema: str, path: str | None = None, batch: int = 500):
        self.spark, self.schema, self.path, self.batch = spark, schema, path, batch
        self.names = [c.split()[0] for c in schema.split(", ")]
        self._held: list[tuple] = []
        self._files = Files(spark, path) if path else None
        self._since = 0
        self._lock = threading.Lock()

    def append(self, **row) -> None:
        with self._lock:
            if self._files is None:
                self._held.append(tuple(row.get(n) for n in self.names))
                return
            plain = {n: v.isoformat() if isinstance(v, datetime) else v for n in self.names if (v := row.get(n)) is not None}
            self._files.put(f"new/{uuid.uuid4().hex}.json", json.dumps(plain) + "\n")
            self._since += 1
            if self._since >= self.batch:
                self._gather()

    def gather(self) -> None:
        """Puts the rows of small files into one Parquet file."""
        with self._lock:
            if self._files is not None:
                self._gather()

    def _gather(self) -> None:
        self._since = 0
        names = self._files.names("new")
        if names:
            paths = [f"{self.path}/new/{n}" for n in names]
            self._without_gathered(self.spark.read.schema(self.schema).json(paths)).coalesce(1).write.mode("append").parquet(f"{self.path}/rows")
            for n in names:
                self._files.remove(f"new/{n}")

    def _gathered(self) -> DataFrame | None:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows") if self._files.names("rows") else None

    def _without_gathered(self, rows: DataFrame) -> DataFrame:
        gathered = self._gathered()
        return rows if gathered is None else rows.join(gathered.select(self.names[0]), self.names[0], "left_anti").select(*self.names)

    def rows(self) -> list[dict]:
        """The rows, on the driver; for short logs."""
        return [r.asDict() for r in self.df().collect()]

    def df(self) -> DataFrame:
        """All rows."""
        with self._lock:
            if self._files is None:
                return self.spark.createDataFrame(self._held, self.schema)
            gathered = self._gathered()
            if not self._files.names("new"):
                return self.spark.createDataFrame([], self.schema) if gathered is None else gathered
            new = self._without_gathered(self.spark.read.schema(self.schema).json(f"{self.path}/new"))
            return new if gathered is None else gathered.unionByName(new)
