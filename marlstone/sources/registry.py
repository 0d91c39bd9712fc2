"""Sources by id, their data versions, and the comparison of declared with live columns."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import slug
from ..functions.predicates import named
from ..model import Source, SourceError
from .files import Files


class SourceRegistry:
    """Loads a source as a DataFrame. Nothing is read but what the plan needs; no job runs here, but for CSV type inference."""

    def __init__(self, spark: SparkSession, sources: Mapping[str, Source], folder: str | None = None):
        self.spark = spark
        self.sources = sources
        # Touches are kept in the folder, so that other processes see them.
        self._touched = Files(spark, folder) if folder else None
        self.tokens: dict[str, str] = {}
        self._frames: dict[str, tuple] = {}

    def source(self, source_id: str) -> Source:
        if source_id not in self.sources:
            raise SourceError(f"unknown source {source_id!r}")
        return self.sources[source_id]

    def load(self, source_id: str) -> DataFrame:
        """The source as it is now. A file source's DataFrame is kept while its files stay the same, which saves reading their footers."""
        s = self.source(source_id)
        if s.type in ("table", "sql_view", "jdbc"):
            return self._read(s)
        key = (s, self.version(source_id)) if not s.options else None
        known = self._frames.get(source_id)
        if key is None or known is None or known[0] != key:
            known = (key, self._read(s))
            self._frames[source_id] = known
        return known[1]

    def _read(self, s: Source) -> DataFrame:
        if s.type == "jdbc":
            # uri is the table; url, user, partitionColumn and the like are options.
            return self.spark.read.format("jdbc").options(**s.options).option("dbtable", s.uri).load()
        if s.type in ("parquet", "orc", "json"):
            return self.spark.read.format(s.type).options(**s.options).load(s.uri)
        if s.type == "csv":
            reader = self.spark.read.option("header", True).options(**s.options)
            declared = self._csv_schema(s)
            return reader.schema(declared).csv(s.uri) if declared else reader.option("inferSchema", True).csv(s.uri)
        return self.spark.table(s.uri)

    def _csv_schema(self, s: Source) -> str | None:
        """A schema from declared types, in the file's own column order; None where a type is not one of Spark's."""
        if not s.columns:
            return None
        types = {c.name: spark_type(c.type) for c in s.columns}
        header = self.spark.read.option("header", True).options(**s.options).csv(s.uri).columns
        if not all(types.get(h) for h in header):
            return None
        return ", ".join("`" + h.replace("`", "``") + "` " + types[h] for h in header)

    def version(self, source_id: str) -> str:
        """A token that changes when the data may have: the newest file's time and size, or the last touch of a table."""
        s = self.source(source_id)
        if s.type in ("table", "sql_view", "jdbc"):
            known = self._touched.get(slug(source_id)) if self._touched else self.tokens.get(source_id)
            return known or "0"
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(s.uri)
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path):
            return "missing"
        status = fs.getFileStatus(path)
        if not status.isDirectory():
            return f"{status.getModificationTime()}:{status.getLen()}"
        newest, size, files = status.getModificationTime(), 0, fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            newest, size = max(newest, f.getModificationTime()), size + f.getLen()
        return f"{newest}:{size}"

    def touch(self, source_id: str) -> str:
        """Says that a table's or view's data changed; files say so themselves."""
        s = self.source(source_id)
        if s.type in ("table", "sql_view", "jdbc"):
            self.tokens[source_id] = uuid.uuid4().hex
            if self._touched:
                self._touched.put(slug(source_id), self.tokens[source_id], overwrite=True)
        return self.version(source_id)


# Type names that other engines use, and Spark's.
_TYPES = {"varchar": "string", "text": "string", "double": "double", "real": "float", "integer": "int", "hugeint": "decimal(38,0)", "timestamp": "timestamp_ntz", "datetime": "timestamp_ntz", "bool": "boolean", "long": "bigint"}
_OWN = ("string", "bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp_ntz", "binary")


def spark_type(declared: str) -> str | None:
    """Spark's name of a declared type; None for one it does not know."""
    t = re.sub(r"\s+", "", declared.lower())
    if re.fullmatch(r"(decimal|numeric)\(\d+,\d+\)", t):
        return t.replace("numeric", "decimal")
    t = _TYPES.get(t, t)
    return t if t in _OWN else None


@dataclass(frozen=True)
class Drift:
    source: str
    kind: str
    column: str | None = None
    detail: str = ""


def drift(registry: SourceRegistry, source_id: str) -> list[Drift]:
    """How the declared columns differ from the live schema; reads no rows."""
    s = registry.source(source_id)
    try:
        live = dict(registry.load(source_id).dtypes)
    except Exception as e:  # whatever keeps the source from being read is the finding
        return [Drift(source_id, "unreachable", None, str(e).splitlines()[0])]
    out = [Drift(source_id, "missing_in_source", c.name) for c in s.columns if c.name not in live]
    out += [Drift(source_id, "missing_in_config", c) for c in live if c not in s.column_names]
    for c in s.columns:
        if c.name in live and (spark_type(c.type) or c.type.lower()) != live[c.name]:
            out.append(Drift(source_id, "type_mismatch", c.name, f"declared {c.type}, found {live[c.name]}"))
    return out


def example_values(registry: SourceRegistry, source_id: str, most: int = 20, keep: int = 10) -> dict[str, tuple[str, ...]]:
    """Examples for columns that may show them and have at most `most` distinct values: the first `keep` in order.

    public columns show examples unless told not to; others only if told to; pii and restricted never.
    """
    s = registry.source(source_id)
    df = registry.load(source_id)
    shown = [c for c in s.columns if c.name in df.columns and c.sensitivity not in ("pii", "restricted") and (c.expose_examples or (c.sensitivity == "public" and c.expose_examples is not False))]
    out = {}
    for c in shown:
        values = df.select(named(c.name).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct().limit(most + 1).collect()
        if 0 < len(values) <= most:
            out[c.name] = tuple(sorted(r["v"] for r in values)[:keep])
    return out
