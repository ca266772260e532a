"""Frontend calls from raw calls: routes, features, injections, and what couldn't be resolved."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.routes import feature, frontend_url

APP_DIR = "src/app"


@dataclass
class FrontendScan:
    calls: DataFrame
    unparsed: DataFrame
    uninjected: DataFrame


def complete(high: DataFrame, low: DataFrame, app_dir: str = APP_DIR) -> FrontendScan:
    """high: TypeScript calls (file, line, httpMethod, rawUrl, injectedBy, is_component); low: jQuery calls (file, line, httpMethod, rawUrl, reason)."""
    none = F.array().cast("array<string>")
    one = high.select("file", "line", "httpMethod", "rawUrl", "injectedBy", "is_component", F.lit(None).cast("string").alias("reason"), F.lit("high").alias("confidence"))
    two = low.select("file", "line", "httpMethod", "rawUrl", none.alias("injectedBy"), F.lit(True).alias("is_component"), "reason", F.lit("low").alias("confidence"))
    rows = one.unionByName(two).withColumn("u", frontend_url("rawUrl"))
    good = F.col("reason").isNull() & F.col("u.route").isNotNull()
    shown = rows.where(good).select(
        F.concat(F.lit("fe:"), "file", F.lit(":"), F.col("line").cast("string")).alias("id"), "file", "line", F.upper("httpMethod").alias("httpMethod"), "rawUrl", F.col("u.route").alias("route"),
        feature(F.col("file"), app_dir).alias("feature"), "confidence", "injectedBy", F.col("u.dropped").alias("baseUrlDropped"), "is_component",
    )
    unparsed = rows.where(~good).select("file", "line", "httpMethod", "rawUrl", F.coalesce("reason", F.lit("no route")).alias("reason"))
    uninjected = shown.where((F.size("injectedBy") == 0) & (F.col("confidence") == "high") & ~F.col("is_component")).select("id", "file", "line")
    return FrontendScan(shown.drop("is_component"), unparsed, uninjected)


def in_order(calls: DataFrame) -> DataFrame:
    """Calls by file and line, numbered within each file: seq orders a file's calls, which is all that first-row rules need."""
    return calls.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy("line", "rawUrl")).cast("long")).orderBy("file", "line")
