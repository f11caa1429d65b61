"""The registered queries of the text operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fim, langid, mixing, quality, repair, secret_scan, sentencepiece_bpe, sharding, simhash, toxicity, vptree
from ._training import remainder

TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(of: int, value: int):
    return F.coalesce(remainder(F.col("doc_id"), of) == value, F.lit(False)).alias("held_out")


def _predicted(cut: float):
    return (F.col("score") >= cut).cast("int").alias("predicted")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(texts(spark, sf_dir))


def op2_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vptree.search(vectors, F.col("vec_id") % 20 == 0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.fit_on_tables(docs, table(spark, sf_dir, "labels")), keep_text=False)
    return scored.select("doc_id", _held_out(toxicity.HELD_OUT_OF, toxicity.HELD_OUT), "score", _predicted(toxicity.CUT), "passages")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(rows)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = langid.label(docs.select("doc_id", "text"), langid.fit_on_tables(docs), keep_text=False)
    return labelled.select("doc_id", _held_out(langid.HELD_OUT_OF, langid.HELD_OUT), "lang_pred", "score", "switches")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_bpe.tokens(texts(spark, sf_dir), tokenizer_path(), keep_text=False, keep_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(texts(spark, sf_dir), keep_text=False)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "span_scores")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    scored = quality.score(docs, quality.fit_on_tables(docs, table(spark, sf_dir, "labels")), keep_text=False)
    return scored.select("doc_id", _held_out(quality.HELD_OUT_OF, 0), "score", _predicted(quality.CUT))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(texts(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(texts(spark, sf_dir))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.digests(repair.damage(rows), rows)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_sharding, op2_vantage_point_search, op3_decontamination, op4_toxicity, op5_chat_formatting, op6_language_id,
            op7_sentencepiece, op8_secret_scans, op9_quality, op10_simhash_near_dedup, op11_fill_in_middle, op12_source_mix,
            op13_conversation_repair, pipeline,
        )
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM d CROSS JOIN sizes, unnest(range(1, greatest(len(w) - k + 2, 1))) AS t(i)),
hits AS (SELECT doc_id, item_id, i, win.k FROM grams JOIN win USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM hits, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(s, ',' ORDER BY s)) AS h
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, coalesce(named.h, sha256('')) AS items_sha256,
  coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_ESCAPED = "len(replace(replace({0}, '\\', '\\\\'), '<', '\\<'))"
OP5_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(6 + 6 + 8 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars,
  false AS rewrites_history
FROM c GROUP BY conv_id
"""

_DRAW = "CAST('0x' || substr(h, {0}, 8) AS BIGINT)"
_UNITS = r"CASE WHEN {0} = 0 THEN '' ELSE array_to_string(u[1:{0}], '') END"
OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
cut AS (
  SELECT *, len(u) AS n, {_DRAW.format(1)} % (len(u) + 1) AS a, {_DRAW.format(9)} % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_DRAW.format(17)} % 100 >= 100 THEN 'plain'
      WHEN {_DRAW.format(25)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
part AS (
  SELECT *, {_UNITS.format("least(a, b)")} AS p, {_UNITS.format("greatest(a, b)")} AS pm FROM cut),
made AS (SELECT *, substr(pm, length(p) + 1) AS m, substr(t, length(pm) + 1) AS s FROM part)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM made
"""

# Best (cost, audit) up to each row at each state (0 nothing, 1 behind system, 2 user, 3 assistant) as nine digits and the audit,
# so that the least string is the cheapest and then the least audit. A row is kept, rerolled or deleted; up to two rows are
# inserted before it.
_NONE = "'999999999'"
_PLUS = "CASE WHEN {0} >= " + _NONE + " THEN " + _NONE + " ELSE lpad(CAST(CAST(substr({0}, 1, 9) AS INTEGER) + {1} AS VARCHAR), 9, '0') || substr({0}, 10) || '{2}' END"


def _plus(state: str, cost: object, letter: str) -> str:
    return _PLUS.format(state, cost, letter)


def _kept(state: str, initial: str, reroled: bool) -> str:
    keep = f"CASE WHEN f NOT IN (1, 2) AND i = '{initial}' THEN {_plus(state, 'x', 'K')} ELSE {_NONE} END"
    return keep if not reroled else f"least({keep}, CASE WHEN f NOT IN (1, 2) THEN {_plus(state, '(2 + x)', 'R')} ELSE {_NONE} END)"


OP13_SQL = rf"""
WITH RECURSIVE dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
      for c in string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')])),
      lambda s, c: CASE WHEN c >= 0 THEN xor(s, c) WHEN s % 2 = 1 THEN xor(s // 2, CAST(3988292384 AS BIGINT)) ELSE s // 2 END)) % 20 AS k
  FROM conversations),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM dealt, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS t(copy) WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS seen
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM rows_) AS a),
r AS (
  SELECT *, substr(role, 1, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN seen > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS f
  FROM placed),
every AS (SELECT DISTINCT conv_id FROM conversations),
best AS (
  SELECT conv_id, 0 AS p, '000000000' AS s0, {_NONE} AS s1, {_NONE} AS s2, {_NONE} AS s3 FROM every
  UNION ALL
  SELECT conv_id, p + 1,
    {_plus("s0", 3, "D")} AS s0,
    least({_plus("s1", 3, "D")}, {_kept("s0", "s", False)}) AS s1,
    least({_plus("i2", 3, "D")}, {_kept("s0", "u", True)}, {_kept("s1", "u", True)}, {_kept("i3", "u", True)}) AS s2,
    least({_plus("i3", 3, "D")}, {_kept("i2", "a", True)}) AS s3
  FROM (
    SELECT *, least(s3, {_plus("i2", 2, "I")}) AS i3 FROM (
      SELECT best.*, r.f, r.i, CASE WHEN r.f = 3 THEN 1 ELSE 0 END AS x,
        least(s2, {_plus("s0", 2, "I")}, {_plus("s1", 2, "I")}, {_plus("s3", 2, "I")}) AS i2
      FROM best JOIN r ON best.conv_id IS NOT DISTINCT FROM r.conv_id AND r.p = best.p + 1) AS a) AS b),
ended AS (
  SELECT conv_id, least(s0, s3, {_plus("i2", 2, "I")}) AS e
  FROM (SELECT *, least(s2, {_plus("s1", 2, "I")}) AS i2 FROM best)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) = 1),
plan AS (SELECT conv_id, CAST(substr(e, 1, 9) AS BIGINT) AS cost, substr(e, 10) AS audit FROM ended),
letters AS (
  SELECT conv_id, j, substr(audit, j, 1) AS c, length(translate(substr(audit, 1, j), 'I', '')) AS p, length(translate(substr(audit, 1, j), 'D', '')) AS q
  FROM plan, unnest(range(1, length(audit) + 1)) AS t(j)),
edits AS (
  SELECT l.*, r.role, r.text, max(CASE WHEN c = 'K' AND q = 1 AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS sys
  FROM letters AS l LEFT JOIN r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.p = r.p AND c <> 'I'),
mended AS (
  SELECT conv_id, string_agg(CASE WHEN c = 'K' THEN role WHEN (q - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN c = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole
  FROM edits WHERE c <> 'D' GROUP BY conv_id),
pairs AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY p) || i AS two FROM r),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank,
    count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY conv_id)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM every LEFT JOIN plan ON every.conv_id IS NOT DISTINCT FROM plan.conv_id LEFT JOIN told ON every.conv_id IS NOT DISTINCT FROM told.conv_id
LEFT JOIN mended ON every.conv_id IS NOT DISTINCT FROM mended.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force, exact round trips or held-out rows."""
    return {"op3_decontamination": OP3_SQL, "op5_chat_formatting": OP5_SQL, "op11_fill_in_middle": OP11_SQL, "op13_conversation_repair": OP13_SQL}
