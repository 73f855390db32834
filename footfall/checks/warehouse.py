"""Sessions, events and rollups of the sample tables, written once per application to the shared scratch folder.

Reports read these stored tables, as they would in production; the queries that build them recompute
everything from the source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.measures import viewport_bucket
from footfall.operators import rollup
from footfall.operators.sessions import build_sessions, describe_sessions, flag_returning, sessionize
from footfall.runtime import scratch_dir, stored
from footfall.sources import sample
from footfall.sources.tables import append_events, append_sessions

#: Columns of the sample that neither sessions nor events are made of; they need not be dealt with the payloads.
SPENT = ["event_id", "user_id", "k", "value", "pv"]

_built: dict[tuple[str, str], "Warehouse"] = {}


def linked_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize(sample.hits(spark, sf_dir), sample.TIMEOUT)


def session_rows(linked: DataFrame) -> DataFrame:
    with_viewport = linked.withColumn("viewport", viewport_bucket("vw"))
    return flag_returning(describe_sessions(build_sessions(with_viewport)))


class Warehouse:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.root = scratch_dir(spark, "warehouse")
        self._tables: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _raw(self, name: str) -> DataFrame:
        if name not in self._tables:
            linked = stored(linked_payloads(self.spark, self.sf_dir).drop(*SPENT), "linked")
            append_sessions(session_rows(linked), f"{self.root}/sessions")
            append_events(
                sample.event_rows(linked, sample.fx_rates(self.spark, self.sf_dir)), f"{self.root}/events"
            )
            for t in ("sessions", "events"):
                self._tables[t] = self._read(t)
        return self._tables[name]

    @property
    def sessions(self) -> DataFrame:
        return self._raw("sessions")

    @property
    def events(self) -> DataFrame:
        return self._raw("events")

    def daily(self, name: str) -> DataFrame:
        if name not in self._tables:
            if name == "heatmap_daily":
                df = rollup.heatmap_daily(sample.heat_clicks(self.spark, self.sf_dir))
            elif name == "crawler_daily":
                df = rollup.crawler_daily(rollup.crawler_hits(sample.requests(self.spark, self.sf_dir), "SiteAudit/"))
            else:
                df = rollup.rollup(self.sessions, self.events, None, sample.TZ)[name]
            df.hint("rebalance", F.col("day")).write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/{name}")
            self._tables[name] = self._read(name)
        return self._tables[name]


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = Warehouse(spark, sf_dir)
    return _built[key]


def plain(df: DataFrame) -> DataFrame:
    """Times as text, money as double, flags as 0/1, so results compare across engines."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string")
        elif kind == "decimal":
            c = c.cast("double")
        elif kind in ("boolean", "integer", "short", "byte"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


