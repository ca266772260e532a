"""Chat formatting with linked tool calls, wholly as DataFrame expressions.

Calls and results are linked by a hash join on conversation and call identifier, ordered topologically by the calls
that their arguments refer to, validated against the tools' schemas and serialised as canonical JSON (keys sorted,
no white space), one record for each call, so a conversation of any length is never gathered in one task.

Order: level 0 refers to nothing; a call's level is one more than the largest of those it refers to. Within a
conversation records follow each other by level, turn and identifier. Calls on a cycle, or after one, have no level.
Calls that refer to one other each are jumped over by pointer doubling, so a chain takes the logarithm of its length
in rounds; what is left, calls that refer to several, takes one round for each of them that follow one another.

Defined cases: of calls or results that repeat an identifier in a conversation the first by turn (then by content)
counts; rows without a conversation or call identifier are left out; calls without result and results without call
are kept as 'unanswered' and 'orphan'; arguments that are no JSON object are invalid and serialised as null;
objects that name a key twice, or hold a number beyond a double's range, count as no JSON; a number is an integer if its
value is whole, however written. Numbers are serialised by value: whole ones by their digits alone; fractions of up to
15 digits, or written with an exponent, as the shortest text that gives the same double; longer fractions by all their
digits; beyond 38 digits, and with an exponent beyond the digits it tells, a number is that of the nearest double;
references to unknown calls make a call invalid and are not waited for; tools without a schema are 'unknown_tool';
null and empty texts are empty contents; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

#: A tool's schema: the type and need of each argument. Types as JSON names.
Schema = Mapping[str, Mapping[str, tuple[str, bool]]]
#: Fields of all schemas at most, so that they may be broadcast.
MAX_FIELDS = 20_000


#: A JSON number, and a cheap sign that a text may hold one beyond a double's range.
NUMBER, MAY_BE_HUGE = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", r"[eE]\+?0*[1-9][0-9]{2}|[0-9]{100}"


def canonical_number(text: Column) -> Column:
    """A JSON number by its value: 1.0 and 1e0 are 1."""
    value = text.try_cast("double")
    plain = ~text.rlike("[eE]")
    # digits of a number written without exponent are all told: a zero fraction goes
    cropped = F.regexp_replace(text, r"\.?0+$", "")
    told = F.when(text.contains("."), F.when(cropped.isin("-0", "-", ""), "0").otherwise(cropped)).otherwise(text)
    small = (value == F.rint(value)) & (F.abs(value) < 1e18)
    # d.ddde+xx of a whole double: its digits, then zeros
    shown = value.cast("string")
    part = lambda i: F.regexp_extract(shown, r"^(-?)([0-9]+)\.([0-9]+)E([0-9]+)$", i)
    digits = F.concat(part(2), F.regexp_replace(part(3), "0+$", ""))
    long = F.concat(part(1), F.rpad(digits, part(4).try_cast("int") + 1, "0"))
    return (
        F.when(text.rlike(r"^(0|-?[1-9][0-9]*)$") | value.isNull(), text).when(small & (~plain | ~told.contains(".")), value.cast("decimal(38,0)").cast("string")).when(plain & ~told.contains("."), told)
        .when(plain & (F.length(F.regexp_replace(told, "^-?0*\\.?0*|\\.", "")) > 15), told).when((value == F.rint(value)) & shown.rlike("E[0-9]+$"), long).otherwise(shown)
    )


def outside_strings(json: Column) -> tuple[Column, Column]:
    """JSON with escaped backslashes and quotes put aside as control characters, which it never holds as they are, and its parts between quotes: those at even places are outside of strings."""
    bare = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    return bare, F.split(bare, '"')


def canonical_numbers(record: Column) -> Column:
    """Valid compact JSON with each number outside of its strings in canonical form."""
    shown = lambda p: F.array_join(F.flatten(F.zip_with(F.split(p, NUMBER), F.regexp_extract_all(p, F.lit(NUMBER), F.lit(0)), lambda a, n: F.array(a, F.coalesce(canonical_number(n), F.lit(""))))), "")
    parts = F.transform(outside_strings(record)[1], lambda p, i: F.when((i % 2 == 0) & p.rlike(r"[0-9][.eE]|-0"), shown(p)).otherwise(p))
    whole = F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.when(record.rlike(r"[0-9][.eE]|-0"), whole).otherwise(record)


def parsed_json(text: Column) -> Column:
    """The text as a variant; null if it is no JSON or holds a number that no double does."""
    huge = lambda p: F.exists(F.regexp_extract_all(p, F.lit(NUMBER), F.lit(0)), lambda n: F.abs(n.try_cast("double")) == float("inf"))
    bare, parts = outside_strings(text)
    found = F.exists(F.transform(parts, lambda p, i: (i % 2 == 0) & huge(p)), lambda x: x)
    return F.when(~F.coalesce(text.rlike(MAY_BE_HUGE) & found, F.lit(False)), F.try_parse_json(text))


def schema_table(spark: SparkSession, schemas: Schema) -> DataFrame:
    rows = [(tool, field, kind, required) for tool, fields in schemas.items() for field, (kind, required) in fields.items()]
    if len(rows) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields")
    return spark.createDataFrame(rows, "name string, field string, kind string, required boolean")


def first_by_turn(df: DataFrame, rest: list[str]) -> DataFrame:
    """The first row of each (conv_id, call_id), combined before the shuffle."""
    cols = ["turn", *rest]
    return df.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct(*cols)).alias("x")).select("conv_id", "call_id", *(F.col(f"x.{c}").alias(c) for c in cols))


def chains(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, anchor, far) of calls that refer to one other: the first call down the chain that doesn't, and how far it is.

    Each round doubles how far a call sees; those that still see another such call when a chain of all would have ended are on a cycle or lead to one, and are left out.
    """
    hops = materialise(edges.where("refs = 1").select("conv_id", "call_id", F.col("needs").alias("anchor"), F.lit(1).cast("long").alias("far")), "hops")
    for _ in range(hops.count().bit_length() + 1):
        ahead = hops.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("far").alias("more"))
        met = hops.join(ahead, ["conv_id", "anchor"], "left")
        hops = materialise(met.select("conv_id", "call_id", F.coalesce("next", "anchor").alias("anchor"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moved")), "hops")
        if hops.where("moved").isEmpty():
            break
    single = hops.select("conv_id", F.col("call_id").alias("anchor"))
    return materialise(hops.join(single, ["conv_id", "anchor"], "left_anti").select("conv_id", "call_id", "anchor", "far"), "chains")


def levels(calls: DataFrame, references: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that can be ordered; references: (conv_id, call_id, needs) among calls."""
    key = ["conv_id", "call_id"]
    edges = materialise(references.withColumn("refs", F.count("*").over(Window.partitionBy(*key))), "references")
    chain = chains(edges)
    # calls that refer to several, each over the chains that begin at those
    down = chain.select("conv_id", F.col("call_id").alias("needs"), "anchor", "far")
    several = materialise(edges.where("refs > 1").join(down, ["conv_id", "needs"], "left").select(*key, F.coalesce("anchor", "needs").alias("anchor"), (F.coalesce("far", F.lit(0)) + 1).alias("far")), "several")
    newest = known = materialise(calls.join(edges, key, "left_anti").select(*key, F.lit(0).cast("long").alias("level")), "levels")
    waiting = materialise(several.groupBy(*key).agg(F.count("*").alias("open")).withColumn("level", F.lit(0).cast("long")), "waiting")
    rounds = 0
    while not newest.isEmpty() and not waiting.isEmpty():
        met = several.join(newest.select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("below")), ["conv_id", "anchor"]).groupBy(*key).agg(F.count("*").alias("met"), F.max(F.col("below") + F.col("far")).alias("most"))
        joined = waiting.join(met, key, "left")
        left = materialise(joined.select(*key, (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), F.greatest("level", F.coalesce("most", F.lit(0))).alias("level")), "waiting")
        newest, waiting, rounds = left.where("open = 0").select(*key, "level"), left.where("open > 0"), rounds + 1
        known = known.union(newest)
        if rounds % 16 == 0:
            known = materialise(known, "levels")  # a plan of few tables
    above = chain.join(known.select("conv_id", F.col("call_id").alias("anchor"), "level"), ["conv_id", "anchor"])
    return known.union(above.select(*key, F.col("level") + F.col("far"))).withColumn("level", F.col("level").cast("int"))


def checked(calls: DataFrame, schemas: Schema) -> DataFrame:
    """(conv_id, call_id, problems): the arguments that don't fit the tool's schema, sorted, for calls with any."""
    spark = calls.sparkSession
    table = F.broadcast(schema_table(spark, schemas))
    fields = {tool: sorted(f) for tool, f in schemas.items()}
    parsed = calls.select("conv_id", "call_id", "name", parsed_json(F.col("arguments")).alias("v"))
    kind_of = F.schema_of_variant(F.col("value"))
    amount = F.try_variant_get(F.col("value"), "$", "double")
    kind = (
        F.when(kind_of == "BIGINT", "integer").when(kind_of.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.when(amount == F.rint(amount), "integer").otherwise("number")).when(kind_of == "STRING", "string")
        .when(kind_of == "BOOLEAN", "boolean").when(kind_of.startswith("OBJECT"), "object").when(kind_of.startswith("ARRAY"), "array").otherwise("null")
    )
    # the fields that any schema names, each read by its path; what else an object holds is found by its keys
    names = sorted({f for fs in fields.values() for f in fs})
    wanted = table.alias("s")
    value = F.lit(None).cast("variant")
    for n in names:
        value = F.when(F.col("field") == n, F.try_variant_get("v", "$['" + n.replace("'", "\\'") + "']", "variant")).otherwise(value)
    given = parsed.join(wanted, "name").withColumn("value", value).withColumn("kind_given", F.when(F.col("value").isNull(), None).otherwise(kind))
    wrong = F.when(F.col("kind_given").isNull() & F.col("required"), F.concat(F.lit("missing:"), "field")).when(
        F.col("kind_given").isNotNull() & (F.col("kind_given") != F.col("kind")) & ~((F.col("kind") == "number") & (F.col("kind_given") == "integer")), F.concat(F.lit("type:"), "field")
    )
    by_field = given.withColumn("problem", wrong).where("problem is not null").select("conv_id", "call_id", "problem")
    allowed = F.create_map(*(x for tool, fs in fields.items() for x in (F.lit(tool), F.array(*(F.lit(f) for f in fs)) if fs else F.array().cast("array<string>")))) if fields else F.lit(None).cast("map<string,array<string>>")
    shape = parsed.withColumn("is_object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))).withColumn("allowed", F.try_element_at(allowed, F.col("name")))
    not_object = shape.where("not is_object").select("conv_id", "call_id", F.lit("not_object").alias("problem"))
    no_tool = shape.where("allowed is null").select("conv_id", "call_id", F.lit("unknown_tool").alias("problem"))
    keys = F.json_object_keys(F.to_json("v"))
    extra = shape.where("is_object and allowed is not null").withColumn("key", F.explode(F.array_except(keys, "allowed"))).select("conv_id", "call_id", F.concat(F.lit("extra:"), "key").alias("problem"))
    return by_field.union(not_object).union(no_tool).union(extra).groupBy("conv_id", "call_id").agg(F.array_join(F.array_sort(F.collect_set("problem")), ",").alias("problems"))


def linked(calls: DataFrame, results: DataFrame, schemas: Schema) -> DataFrame:
    """One row for each call and each orphan result.

    calls: conv_id, turn, call_id, name, arguments (JSON text), needs (array of call identifiers);
    results: conv_id, turn, call_id, content. Output: conv_id, call_id, turn, result_turn, name, status, level,
    problems (null where valid) and record (canonical JSON).
    """
    one = materialise(first_by_turn(calls, ["name", "arguments", "needs"]), "calls")
    two = first_by_turn(results, ["content"]).withColumnRenamed("turn", "result_turn")
    refs = one.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("needs")).where("needs is not null")
    targets = one.select("conv_id", F.col("call_id").alias("needs"))
    real = refs.join(targets, ["conv_id", "needs"], "left_semi").select("conv_id", "call_id", "needs")
    unknown = refs.join(targets, ["conv_id", "needs"], "left_anti").groupBy("conv_id", "call_id").agg(F.concat_ws(",", F.array_sort(F.collect_set(F.concat(F.lit("reference:"), "needs")))).alias("unknown"))
    key = ["conv_id", "call_id"]
    joined = one.withColumn("is_call", F.lit(True)).join(two.withColumn("is_result", F.lit(True)), key, "full_outer").join(levels(one, real), key, "left").join(checked(one, schemas), key, "left").join(unknown, key, "left")
    status = F.when(F.col("is_call").isNull(), "orphan").when(F.col("is_result").isNull(), "unanswered").otherwise("linked")
    problems = F.concat_ws(",", "problems", "unknown")
    arguments = parsed_json(F.col("arguments"))
    as_object = F.when(F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False)), canonical_numbers(F.to_json(arguments))).otherwise("null")
    text = lambda c: F.coalesce(F.expr(f"regexp_extract(to_json(named_struct('x', {c})), '(?s)^.\"x\":(.*).$', 1)"), F.lit("null"))
    part = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    field = lambda name, c: part(name, F.when(F.col(c).isNull(), "null").otherwise(text(c)))
    record = F.concat(F.lit("{"), F.concat_ws(",", part("arguments", as_object), field("id", "call_id"), field("name", "name"), field("result", "content")), F.lit("}"))
    return joined.select(*key, "turn", "result_turn", "name", status.alias("status"), "level", F.when(problems != "", problems).alias("problems"), record.alias("record"))
