"""Beacon log reader, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions.times import let

MAX_BODY = 16384
MAX_DEPTH = 8


def _too_deep(body: Column) -> Column:
    """Whether JSON is nested deeper than allowed: peel off innermost brackets once per level, see what is left."""
    text = F.regexp_replace(F.regexp_replace(body, r"(?s)\\.", ""), r'"[^"]*+"', "")
    marks = F.regexp_replace(text, r"[^\[\]{}]", "")
    for _ in range(MAX_DEPTH):
        marks = F.regexp_replace(marks, r"\[\]|\{\}", "")
    return marks != ""


def read_hits(spark: SparkSession, path: str, streaming: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits, rejects) from JSON lines of request facts plus the raw ``body`` text.

    Bodies over 16384 bytes are rejected as too_large; text that is no JSON object, or is nested deeper
    than 8, as malformed. Rejects keep the line's id and received_at with the reason.
    """
    reader = spark.readStream if streaming else spark.read
    lines = reader.schema(schemas.HIT_LINE).json(path)
    return split_bodies(lines)


def _verdict(body: Column) -> Column:
    """Why a body is rejected, NULL for a usable one."""
    text = F.trim(body)
    object_like = text.rlike(r"(?s)^\{.*\}$") & F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")
    return (
        F.when(F.octet_length(body) > MAX_BODY, "too_large")
        .when(~F.coalesce(object_like, F.lit(False)), "malformed")
        .when(_too_deep(text), "malformed")
    )


def split_bodies(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    reason = let(F.coalesce("body", F.lit("")), _verdict)
    tagged = lines.withColumn("reason", reason)
    parsed = tagged.where(F.col("reason").isNull()).withColumn("p", F.from_json("body", schemas.PAYLOAD))
    hits = parsed.select(F.col("id").alias("payload_id"), "p.*", *schemas.columns(schemas.REQUEST))
    rejects = tagged.where(F.col("reason").isNotNull()).select("id", "received_at", "reason")
    return hits, rejects

