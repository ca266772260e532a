"""A search index: which symbols, routes, features and tickets hold a token, written once with the tables.

Rows are dealt to buckets by their token's hash, a folder each, so a search reads the buckets of its own tokens and
tokenizes nothing but its query and what it has found. A frequent token is a long run of rows in one bucket's files,
which tasks split; no row holds a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import display_name, name_tokens, tokenize
from tessera.operators.impact import first_rows
from tessera.operators.link import Factored

#: Folders that tokens are dealt to.
BUCKETS = 64
#: What a token was found in.
NAME, ROUTE, FEATURE, CALL, TICKET = "name", "route", "feature", "call", "ticket"


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def postings(index) -> DataFrame:
    """(kind, id, reason, place, token) of all that a search looks at; of a ticket's rows id is the ticket.

    Of factored links the calls' features are held, not those of every linked endpoint; a search looks up their links.
    """
    symbols, points = first_rows(index.symbols), first_rows(index.entry_points)
    rows = lambda df, kind, id_, reason, place, tokens: df.select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), reason.alias("reason"), place.alias("place"), F.explode(tokens).alias("token"))
    shown = display_name(F.col("name"), F.col("containingType"), F.col("id"))
    calls = first_rows(index.frontend_calls).where("feature is not null").select(F.col("id").alias("frontendId"), "feature")
    feature, kind, of = calls, CALL, "frontendId"
    if not isinstance(index.api_links, Factored):
        feature, kind, of = index.api_links.join(calls, "frontendId"), FEATURE, "backendId"
    parts = [
        rows(symbols, NAME, "id", F.concat(F.lit("name "), shown), F.lit("4:"), name_tokens(shown)),
        rows(points.where("route is not null"), ROUTE, "id", F.concat(F.lit("route "), "route"), F.concat(F.lit("2:"), "route"), tokenize(F.col("route"))),
        rows(feature, kind, of, F.concat(F.lit("feature "), "feature"), F.concat(F.lit("3:"), "frontendId"), tokenize(F.col("feature"))),
        rows(index.tickets.where("message is not null"), TICKET, "ticket", F.lit(""), F.lit(""), tokenize(F.col("message"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def write_postings(index, path: str, buckets: int = BUCKETS) -> None:
    """Replaces the search index in a folder."""
    found = postings(index).withColumn("bucket", bucket_of(F.col("token"), buckets))
    found.repartition("bucket", F.xxhash64("id") % 8).sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(path)


def found_tokens(spark: SparkSession, path: str, tokens: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(kind, id, reason, place, n): how many of the tokens each entry holds; only their buckets are read."""
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(tokens)], "token string")
    wanted = sorted({r[0] for r in asked.select(bucket_of(F.col("token"), buckets)).collect()})  # a query's own tokens
    rows = spark.read.parquet(path).where(F.col("bucket").isin(wanted) & F.col("token").isin(tokens))
    return rows.select("kind", "id", "reason", "place", "token").distinct().groupBy("kind", "id", "reason", "place").agg(F.count("*").alias("n"))
