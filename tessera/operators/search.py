"""Ranked search for symbols, by name and by free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import display_name, find_score, kind_rank, name_tokens, round2, ticket_named, tokenize, tokens_of, type_member
from tessera.operators.impact import first_rows
from tessera.operators.link import Factored
from tessera.sources import postings

FIND_LIMIT, WHERE_LIMIT, REASONS, SALTS = 20, 10, 5, 64
#: Weights of the three sources of free-text hits.
TICKET_WEIGHT, ROUTE_WEIGHT, NAME_WEIGHT = 3.0, 2.0, 1.0


def find(symbols: DataFrame, query: str, limit: int | None = FIND_LIMIT) -> DataFrame:
    """(id, kind, display, project, file, line, score): the best symbols for a name."""
    shown = display_name(F.col("name"), F.col("containingType"), F.col("id"))
    hits = symbols.withColumn("display", shown).withColumn("score", find_score(F.col("display"), F.col("name"), query)).where("score is not null")
    out = hits.select("id", "kind", "display", "project", "file", "line", "score").orderBy(F.desc("score"), "id")
    return out if limit is None else out.limit(limit)


def overlap(query: list[str], tokens) -> "F.Column":
    """The query's tokens that occur, in the query's order."""
    return F.array_intersect(F.array(*(F.lit(q) for q in query)).cast("array<string>"), tokens)


def leaders(hits: DataFrame, *by: str) -> DataFrame:
    """The REASONS best hits of each group, of which the first stands for all of the group by its `hits`.

    hits: score, reason, place, and hits where a row stands for several or none; hits of equal score keep their place.
    """
    order = [F.desc("score"), "place"]
    counted = hits if "hits" in hits.columns else hits.withColumn("hits", F.lit(1).cast("long"))
    # the best of each of SALTS parts first, so that a group with very many hits isn't sorted in one task
    part, whole = Window.partitionBy(*by, "salt"), Window.partitionBy(*by)
    out = counted.where("score > 0").withColumn("salt", F.pmod(F.xxhash64("reason", "place"), F.lit(SALTS)))
    for window in (part, whole):
        out = out.withColumn("n", F.row_number().over(window.orderBy(*order))).withColumn("of", F.sum("hits").over(window)).where(F.col("n") <= REASONS)
        out = out.withColumn("hits", F.when(F.col("n") == 1, F.col("of")).otherwise(0)).drop("of")
    return out.drop("salt")


def combined(hits: DataFrame) -> DataFrame:
    """(id, score, reasons, more): the best hit plus log2 of their number, and the REASONS best reasons.

    hits: id and what leaders() asks for.
    """
    return leaders(hits, "id").groupBy("id").agg(
        round2(F.max("score") + F.log2(F.sum("hits").cast("double"))).alias("score"),
        F.transform(F.array_sort(F.collect_list(F.struct("n", "reason"))), lambda x: x.reason).alias("reasons"),
        F.greatest(F.sum("hits") - REASONS, F.lit(0)).cast("int").alias("more"),
    )


def ticket_hits(tickets: DataFrame, symbols: DataFrame, query: str, tokens: list[str]) -> DataFrame:
    """A hit for each symbol in a file of a ticket that the query names or overlaps; twice as good where the message has the whole name."""
    t = tickets.withColumn("words", tokenize(F.coalesce("message", F.lit("")))).withColumn("named", ticket_named(query)("ticket"))
    t = t.withColumn("base", F.lit(TICKET_WEIGHT) * F.when(F.col("named"), F.lit(1.0)).otherwise(F.size(overlap(tokens, F.col("words"))) / F.lit(float(len(tokens)))))
    files = t.where("base > 0").select("ticket", "words", "base", F.explode(F.array_distinct("files")).alias("file"))
    names = symbols.select("id", "file", tokenize(F.col("name")).alias("own"))
    whole = (F.size("own") > 0) & (F.size(F.array_except("own", "words")) == 0)
    return files.join(names, "file").select("id", (F.col("base") * F.when(whole, 2.0).otherwise(1.0)).alias("score"), F.concat(F.lit("ticket "), "ticket").alias("reason"), F.concat(F.lit("1:"), "ticket").alias("place"))


def route_hits(entries: DataFrame, links: DataFrame | Factored, calls: DataFrame, tokens: list[str]) -> DataFrame:
    """Hits of entry points by their route, and those for the links by the features of their calls."""
    score = lambda c: F.lit(ROUTE_WEIGHT) * F.size(overlap(tokens, tokenize(F.coalesce(c, F.lit(""))))) / F.lit(float(len(tokens)))
    routes = entries.where("route is not null").select("id", score("route").alias("score"), F.concat(F.lit("route "), "route").alias("reason"), F.concat(F.lit("2:"), "route").alias("place"), F.lit(1).cast("long").alias("hits"))
    found = first_rows(calls).select(F.col("id").alias("frontendId"), score("feature").alias("score"), F.concat(F.lit("feature "), "feature").alias("reason"), F.concat(F.lit("3:"), "id").alias("place"))
    return routes.union(feature_hits(links, found))


def feature_hits(links: DataFrame | Factored, found: DataFrame) -> DataFrame:
    """Hits of endpoints for their links: one each, or of factored links the best, which stand for all.

    found: frontendId, score, reason, place. Endpoints of a class have the same hits, so these are ranked by shape and by class.
    """
    row = ["id", "score", "reason", "place", "hits"]
    if not isinstance(links, Factored):
        return links.join(found, "frontendId").select(F.col("backendId").alias("id"), "score", "reason", "place", F.lit(1).cast("long").alias("hits"))
    by_shape = leaders(links.calls.select("shape", "frontendId").join(found, "frontendId"), "shape").drop("n", "frontendId")
    by_class = leaders(links.matches.select("shape", "class").join(by_shape, "shape"), "class")
    return links.endpoints.join(by_class, "class").select(*row)


def plain_hits(hits: DataFrame) -> DataFrame:
    return hits.withColumn("hits", F.lit(1).cast("long"))


def name_hits(symbols: DataFrame, tokens: list[str]) -> DataFrame:
    shown = display_name(F.col("name"), F.col("containingType"), F.col("id"))
    score = F.lit(NAME_WEIGHT) * F.size(overlap(tokens, name_tokens(shown))) / F.lit(float(len(tokens)))
    return symbols.select("id", score.alias("score"), F.concat(F.lit("name "), shown).alias("reason"), F.lit("4:").alias("place"))


def indexed_hits(index, path: str, symbols: DataFrame, query: str, tokens: list[str]) -> DataFrame:
    """The hits of where() by a search index: only what its tickets and calls lead to is looked at more closely."""
    found = postings.found_tokens(symbols.sparkSession, path, tokens)
    weight = F.when(F.col("kind") == postings.NAME, NAME_WEIGHT).otherwise(ROUTE_WEIGHT)
    scored = found.withColumn("score", weight * F.col("n") / F.lit(float(len(tokens))))
    own = scored.where(F.col("kind").isin(postings.NAME, postings.ROUTE, postings.FEATURE)).select("id", "score", "reason", "place")
    features = feature_hits(index.api_links, scored.where(F.col("kind") == postings.CALL).select(F.col("id").alias("frontendId"), "score", "reason", "place"))
    met = found.where(F.col("kind") == postings.TICKET).select(F.col("id").alias("ticket"))
    named = index.tickets.where(ticket_named(query)("ticket")).select("ticket")
    return plain_hits(ticket_hits(index.tickets.join(met.union(named).distinct(), "ticket", "left_semi"), symbols, query, tokens).union(own)).union(features)


def where(index, query: str, limit: int | None = WHERE_LIMIT, path: str | None = None) -> DataFrame:
    """The symbols that a free text speaks of, with score and reasons; none for a query without tokens. path: the index's search index, if one was written."""
    symbols = first_rows(index.symbols)
    points = first_rows(index.entry_points)
    tokens = tokens_of(query)
    if not tokens:
        hits = symbols.select("id", F.lit(0.0).alias("score"), F.lit("").alias("reason"), F.lit("").alias("place")).limit(0)
    elif path:
        hits = indexed_hits(index, path, symbols, query, tokens)
    else:
        hits = plain_hits(ticket_hits(index.tickets, symbols, query, tokens).union(name_hits(symbols, tokens))).union(route_hits(points, index.api_links, index.frontend_calls, tokens))
    entry = points.select("id").withColumn("is_entry", F.lit(True))
    out = combined(hits).join(symbols.select("id", "kind", "name", "containingType", "project", "file", "line"), "id").join(entry, "id", "left")
    out = out.withColumn("is_entry", F.coalesce("is_entry", F.lit(False))).withColumn("display", display_name(F.col("name"), F.col("containingType"), F.col("id")))
    out = out.orderBy(F.desc("score"), F.desc("is_entry"), kind_rank(F.col("kind")), "id").drop("name", "containingType")
    return out if limit is None else out.limit(limit)


def resolve_symbol(symbols: DataFrame, query: str, candidates: int = 5, near: int = 3) -> tuple[str, list[str]]:
    """('found', [id]), ('ambiguous', at most `candidates` ids) or ('unknown', near matches)."""
    import re

    if re.match(r"(?s)^[A-Z]:.", query):
        hit = symbols.where(F.col("id") == query).select("id").limit(1).collect()
        if hit:
            return "found", [query]
        tail = type_member_text(query)
        return "unknown", [r["id"] for r in find(symbols, tail, near).collect()]
    # the leaders: an ordered limit, then those that tie with the first
    ranked = find(symbols, query, candidates + 1).collect()
    top = [r for r in ranked if r["score"] == ranked[0]["score"]]
    if not top:
        words = [w for w in re.split(r"\W+", query) if w]
        return "unknown", [r["id"] for r in find(symbols, words[-1], near).collect()] if words else []
    return ("found", [top[0]["id"]]) if len(top) == 1 else ("ambiguous", [r["id"] for r in top[:candidates]])


def type_member_text(doc_id: str) -> str:
    """type_member of one text."""
    bare = (doc_id[2:] if len(doc_id) > 2 and doc_id[1] == ":" else doc_id).split("(")[0]
    return ".".join(bare.split(".")[-2:])


__all__ = ["combined", "find", "name_hits", "overlap", "resolve_symbol", "route_hits", "ticket_hits", "type_member", "where"]
