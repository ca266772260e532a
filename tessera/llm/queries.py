"""The registered queries of this subpackage: one for each operator, applied to its whole table."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, bpe, collocations, fingerprint, license_scan, line_dedup, media, minhash_dedup, quality, source_mix, token_counts, tool_calls, toxicity
from tessera.llm.common import table
from tessera.llm.ordering import with_next


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public licenses that each document states."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


#: The tools that assistant turns stand for, and the schema of their arguments.
TOOLS = {
    "search": {"text": ("string", True), "words": ("integer", True), "after": ("array", False)},
    "summarise": {"text": ("string", True), "words": ("integer", False), "after": ("array", True)},
    "translate": {"text": ("string", True), "words": ("string", False), "after": ("array", False)},
}


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool calls: an assistant's turn is a call whose arguments hold its text and refer to the turn at half its number; the turn that follows is its result."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name_of = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    half = F.floor(F.col("turn") / 2)
    names = F.array(*(F.lit(t) for t in TOOLS))
    calls = turns.where("role = 'assistant'").select(
        "conv_id",
        "turn",
        name_of(F.col("turn")).alias("call_id"),
        F.get(names, F.pmod(F.octet_length(F.coalesce("text", F.lit(""))), F.lit(len(TOOLS)))).alias("name"),
        F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("words"), F.array(name_of(half)).alias("after"))).alias("arguments"),
        F.array(name_of(half)).alias("needs"),
    )
    results = turns.where("role = 'user' and turn > 0").select("conv_id", "turn", name_of(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    out = tool_calls.linked(calls, results, TOOLS)
    return out.select("conv_id", "call_id", F.coalesce("turn", "result_turn").alias("turn"), "name", "status", "level", "problems", F.sha2(F.col("record").cast("binary"), 256).alias("record_sha256"))


OP2_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, 'call_' || turn AS call_id, ['search', 'summarise', 'translate'][strlen(coalesce(text, '')) % 3 + 1] AS name,
         coalesce(text, '') AS text, len(string_split(coalesce(text, ''), ' ')) AS words, turn // 2 AS half
  FROM conversations WHERE role = 'assistant'
), results AS (
  SELECT conv_id, turn AS result_turn, 'call_' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'user' AND turn > 0
), ordered AS (
  SELECT c.conv_id, c.call_id, c.turn, 0 AS level FROM calls c LEFT JOIN calls d ON c.conv_id = d.conv_id AND c.half = d.turn WHERE d.turn IS NULL
  UNION ALL
  SELECT c.conv_id, c.call_id, c.turn, o.level + 1 FROM calls c JOIN ordered o ON c.conv_id = o.conv_id AND c.half = o.turn
), problems AS (
  SELECT c.conv_id, c.call_id,
    concat_ws(',', CASE WHEN c.name = 'translate' THEN 'type:words' END, CASE WHEN d.turn IS NULL THEN 'reference:call_' || c.half END) AS problems
  FROM calls c LEFT JOIN calls d ON c.conv_id = d.conv_id AND c.half = d.turn
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.result_turn) AS turn, c.name,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  o.level, nullif(p.problems, '') AS problems,
  sha256('{"arguments":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '{"after":["call_' || c.half || '"],"text":' || to_json(c.text) || ',"words":' || c.words || '}' END
    || ',"id":' || to_json(coalesce(c.call_id, r.call_id)) || ',"name":' || coalesce(to_json(c.name)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}') AS record_sha256
FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
LEFT JOIN ordered o ON c.conv_id = o.conv_id AND c.call_id = o.call_id
LEFT JOIN problems p ON c.conv_id = p.conv_id AND c.call_id = p.call_id
"""


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near duplicates; the least id of a group is kept."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS w
  FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words
), parts AS (
  SELECT doc_id, unnest(s) AS shingle, len(s) AS n FROM shingled
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both
  FROM parts a JOIN parts b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT s.doc_id, len(s.s) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM shingled s JOIN least l USING (doc_id)
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the long lines that five or more documents share, but for the last of those."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def target_weight(source: str) -> int:
    """The target weight of a source: 1 to 9 by its name, as a mixing recipe would list it."""
    return 1 + zlib.crc32(source.encode()) % 9


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mix that gives sources shares by their target weights while they last."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return source_mix.mixed(docs, target_weight)


def op6_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight towards text labelled good, and whether the sample has it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.resampled(docs, table(spark, sf_dir, "labels"), keep_text=False)


def op7_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by its nearest labelled examples; a quarter of the ids is held out from learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    labels = table(spark, sf_dir, "labels").where(~held_out)
    return toxicity.scores(docs, labels).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored in an ISO media container, probed and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("payload"))
    stored = media.store(docs.withColumn("n_bytes", F.octet_length("payload").cast("long")))
    back = media.read_back(media.probe(stored))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.to_json("info").alias("feature"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text encoded and decoded again."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text, whose second half comes from the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    half = F.expr("cast(n_chars div 2 as int)")
    edited = (
        with_next(docs, "doc_id", "text", "next_text")
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - half).cast("int")), F.left("next_text", half)))
        .withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    )
    sketched = fingerprint.with_fingerprints(edited, {"text": "own", "edited": "other", "next_text": "following"}, drop=True)
    return fingerprint.compare(sketched, {"edited": ("own", "other"), "next": ("own", "following")}).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("own")).alias("fingerprint"),
        F.lower(F.hex("other")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "contained_edited",
        F.col("distinct_own").alias("n_distinct"),
    )


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and whether it is beyond 512."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two vocabularies, aligned, with the strength of its links over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.alignments(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words come together more often than by chance."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM worded, (SELECT unnest(range(1, 6)) AS k)
), f AS (
  SELECT lang, k, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 100
), cuts AS (
  SELECT lang, phrase, k, a, w, unnest(range(1, k)) AS j FROM candidates
), scored AS (
  SELECT c.lang, c.phrase, c.a, t.n, c.j, x.a AS l, y.a AS r, (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN totals t ON c.lang = t.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')
), best AS (
  SELECT lang, phrase, a, l, r, n, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM candidates q WHERE q.lang = b.lang AND q.phrase <> b.phrase AND 100 * q.a >= 100 * b.a AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


QUERIES = {"op1_license_scan": op1_license_scan, "op2_tool_calls": op2_tool_calls, "op5_source_mix": op5_source_mix, "op6_quality_resample": op6_quality_resample, "op7_toxicity_knn": op7_toxicity_knn, "op3_minhash_dedup": op3_minhash_dedup, "op4_line_dedup": op4_line_dedup, "op8_media_columns": op8_media_columns, "op9_bpe": op9_bpe, "op10_fingerprint": op10_fingerprint, "op11_token_counts": op11_token_counts, "op12_alignment": op12_alignment, "op13_collocations": op13_collocations}
ORACLES: dict[str, str] = {"op1_license_scan": license_scan.oracle_sql(), "op2_tool_calls": OP2_SQL, "op3_minhash_dedup": OP3_SQL, "op4_line_dedup": OP4_SQL, "op13_collocations": OP13_SQL}
