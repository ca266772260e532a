"""Change history: tickets, files that change together, renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import round2, ticket_ids
from tessera.lineage import cut

#: Files above which a commit is noise; times that a pair must change together; commits probed for tickets.
MAX_FILES, MIN_TOGETHER, PROBE = 100, 3, 200
# The extensions that count.
EXTENSIONS = [".cs", ".cshtml", ".razor", ".ts", ".js", ".html", ".sql", ".json", ".config"]


def allowed(path: Column) -> Column:
    """Whether the path's extension counts, in any case."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(EXTENSIONS)


def rebased(path: Column, prefix: str | None) -> Column:
    """A repository path relative to the solution's folder; outside it, upwards first."""
    if not prefix:
        return path
    p = prefix.strip("/") + "/"
    return F.when(F.lower(F.left(path, F.lit(len(p)))) == p.lower(), F.substring(path, len(p) + 1, 1 << 30)).otherwise(F.concat(F.lit("../" * p.count("/")), path))


def commit_files(commits: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """(seq, file): the distinct files that count of each commit that isn't noise; the noise limit is of all its files."""
    return commits.where(F.size("files") <= max_files).select("seq", F.explode(F.array_distinct("files")).alias("file")).where(allowed(F.col("file")))


def file_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("file").agg(F.count("*").cast("int").alias("total"))


def pair_counts(commits: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """(fileA, fileB, together) of the files of commits that aren't noise; a file's pair with itself counts its commits.

    A commit's files are one array of at most max_files, so pairs are made in place, without a join, and counted
    before the only shuffle that follows them.
    """
    wanted = F.array_sort(F.array_distinct(F.filter("files", allowed)))
    baskets = commits.where(F.size("files") <= max_files).select(wanted.alias("f")).where(F.size("f") > 0)
    pairs = F.transform("f", lambda x, i: F.transform(F.slice(F.col("f"), i + 1, F.size("f")), lambda y: F.struct(x.alias("fileA"), y.alias("fileB"))))
    return baskets.select(F.explode(F.flatten(pairs)).alias("p")).groupBy("p.fileA", "p.fileB").agg(F.count("*").cast("int").alias("together"))


def strengths(counts: DataFrame, min_together: int = MIN_TOGETHER) -> DataFrame:
    """(fileA, fileB, together, totalA, totalB, strength) of the pairs counted often enough; totals are files' pairs with themselves."""
    kept = cut(counts.where((F.col("fileA") == F.col("fileB")) | (F.col("together") >= min_together)), "pairs")
    totals = kept.where("fileA = fileB").select(F.col("fileA").alias("file"), F.col("together").alias("total"))
    found = kept.where("fileA <> fileB")
    out = found.join(totals.select(F.col("file").alias("fileA"), F.col("total").alias("totalA")), "fileA").join(totals.select(F.col("file").alias("fileB"), F.col("total").alias("totalB")), "fileB")
    strength = round2(F.col("together").cast("double") / F.least("totalA", "totalB"))
    return out.select("fileA", "fileB", "together", "totalA", "totalB", strength.alias("strength"))


def co_change(commits: DataFrame, min_together: int = MIN_TOGETHER, max_files: int = MAX_FILES) -> DataFrame:
    """(fileA, fileB, together, totalA, totalB, strength): pairs of files that change together often enough, from one pass over the commits."""
    return strengths(pair_counts(commits, max_files), min_together)


def ranked_co_change(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("strength"), "fileA", "fileB")


def tickets(commits: DataFrame, pattern: str, max_files: int = MAX_FILES) -> DataFrame:
    """(ticket, commits, date, message, files): commits in log order, files sorted, date and message of the newest commit (least seq)."""
    kept = commits.where(F.size("files") <= max_files).withColumn("files", F.filter("files", allowed)).where(F.size("files") > 0)
    named = kept.withColumn("ticket", F.explode(ticket_ids(F.col("message"), F.col("body"), pattern)))
    # a file counts once a ticket before any array is made, so that a hot ticket gathers its files, not its commits' lists
    files = named.select("ticket", F.explode("files").alias("file")).distinct().groupBy("ticket").agg(F.array_sort(F.collect_list("file")).alias("files"))
    own = named.groupBy("ticket").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "hash"))), lambda x: x.hash).alias("commits"),
        F.min_by("date", "seq").alias("date"),
        F.min_by("message", "seq").alias("message"),
    )
    return own.join(files, "ticket")


def pattern_matches(commits: DataFrame, pattern: str, probe: int = PROBE) -> bool:
    """Whether any of the newest commits names a ticket."""
    return not commits.orderBy("seq").limit(probe).where(F.size(ticket_ids(F.col("message"), F.col("body"), pattern)) > 0).isEmpty()


def looks_like_pull_requests(found: DataFrame) -> DataFrame:
    """One row: tickets, those that are a pull request's number by their message, and whether that is most of at least five."""
    digits = F.col("ticket").rlike(r"^#?\d+$")
    number = F.regexp_replace("ticket", "^#", "")
    hit = digits & (F.contains("message", F.concat(F.lit("(#"), number, F.lit(")"))) | F.contains(F.lower("message"), F.concat(F.lit("pull request #"), number)))
    return found.agg(F.count("*").alias("tickets"), F.count_if(hit).alias("pr_like")).withColumn("warn", (F.col("tickets") >= 5) & (F.col("pr_like") * 2 > F.col("tickets")))


def time_blocks(moves: DataFrame, blocks: int) -> list[int]:
    """Cuts of the moves' times into about that many blocks of like size; a bounded list."""
    shares = [i / blocks for i in range(1, blocks)]
    found = moves.agg(F.percentile_approx("at", shares, 20 * blocks)).first()[0]
    return sorted(set(found or []))


def latest(probes: DataFrame, moves: DataFrame, cuts: list[int]) -> DataFrame:
    """probes (path, at, *) with `move`, the last of moves (path, at, move) at the same path before `at`; null without one.

    An as-of lookup by blocks of time: each block of a path is ordered alone, and takes what came last before it from
    the path's earlier blocks, of which there are as many as cuts at most. So a path with most of the moves is no group.
    """
    block = F.lit(len(cuts))
    for i, c in reversed(list(enumerate(cuts))):
        block = F.when(F.col("at") < c, F.lit(i)).otherwise(block)
    if len(cuts) > 32:  # a nest of this depth isn't compiled any more
        block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("at")))
    told = moves.groupBy("path", "at").agg(F.max("move").alias("move")).withColumn("block", block)
    ends = cut(told.groupBy("path", "block").agg(F.max(F.struct("at", "move")).alias("x")), "ends")
    asked = probes.withColumn("block", block)
    # a block that is asked for takes the last end of an earlier one
    open_ = asked.select("path", "block").distinct().withColumn("x", F.lit(None).cast(ends.schema["x"].dataType))
    before = Window.partitionBy("path").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.union(open_).withColumn("carried", F.last("x", ignorenulls=True).over(before)).where("x is null").select("path", "block", F.col("carried.move").alias("carried"))
    own = [c for c in probes.columns if c not in ("path", "at")]
    none = F.lit(None).cast(told.schema["move"].dataType).alias("move")
    rows = told.select("path", "block", "at", "move", *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in own)).union(asked.select("path", "block", "at", none, *own))
    within = Window.partitionBy("path", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    looked = rows.withColumn("found", F.last("move", ignorenulls=True).over(within)).where("move is null")
    return looked.join(carried, ["path", "block"], "left").select("path", "at", *own, F.coalesce("found", "carried").alias("move"))


def resolve_renames(paths: DataFrame, renames: DataFrame, blocks: int = 64) -> DataFrame:
    """paths (seq, path) with `now`, the path's name today; seq counts from the newest commit.

    renames: seq, old, new. A path is what its latest rename in a newer commit made of it, and so on. Every rename's
    next one is looked up once; then each round doubles how far a rename sees, so hops take the logarithm of their
    number in rounds. Of a path's several renames in one commit the one to the greatest name counts; a rename or a path
    without a commit or a name is left out, or keeps its name.
    """
    known = renames.where("seq is not null and old is not null and new is not null").groupBy("old", F.col("seq").cast("bigint").alias("at")).agg(F.max("new").alias("new"))
    moves = cut(known.withColumn("id", F.monotonically_increasing_id()), "moves")
    cuts = time_blocks(moves, blocks)
    events = moves.select(F.col("old").alias("path"), "at", F.struct("id", "new").alias("move"))
    ahead = latest(moves.select(F.col("new").alias("path"), "at", "id"), events, cuts)
    far = cut(ahead.join(moves.select("id", F.col("new").alias("name")), "id").select("id", "name", F.col("move.id").alias("next"), F.col("move.new").alias("next_name")), "hops")
    far = far.select("id", F.coalesce("next_name", "name").alias("name"), "next")
    # what sees to the end of its chain is settled: it takes no part in further rounds, where its null would be one hot key
    while not (waiting := far.where("next is not null")).isEmpty():
        more = far.select(F.col("id").alias("next"), F.col("name").alias("later"), F.col("next").alias("after"))
        met = waiting.join(more, "next").select("id", F.col("later").alias("name"), F.col("after").alias("next"))
        far = far.where("next is null").union(cut(met, "hops"))
    asked = paths.select(F.col("seq").cast("bigint").alias("at"), "path").distinct()
    whole = asked.where("at is not null and path is not null")
    first = latest(whole, events, cuts).select(F.col("at").alias("seq"), "path", F.col("move.id").alias("id"))
    now = cut(first.where("id is not null").join(far.select("id", "name"), "id").select(F.col("seq").alias("__seq"), F.col("path").alias("__path"), F.col("name").alias("__now")), "names")
    joined = paths.join(now, (F.col("seq") == F.col("__seq")) & (F.col("path") == F.col("__path")), "left")
    return joined.select(*paths.columns, F.coalesce("__now", "path").alias("now"))


def unjoinable(found: DataFrame, symbols: DataFrame) -> bool:
    """Whether no ticket's file is a symbol's: the two tables don't share a path space."""
    files = found.select(F.explode("files").alias("file"))
    return files.join(symbols.select("file"), "file", "left_semi").isEmpty()
