"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_search, bpe, chat, langid, main_text, mixing, periodic_runs, phrases, sharding, simhash, token_store, url_filter, vector_tree
from .common import table

#: Fixed values of the URL query's contract: (verdict, host, path).
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Fixed values of the chat query's contract: one more conversation.
EXTRA_CHAT = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


#: Vocabulary of the two token queries; a file that the machine's tokenizer package provides.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_binary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors by sign codes of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    codes = vectors.select(F.col("vec_id").alias("id"), binary_search.sign_code(F.col("embedding")).alias("code"))
    return binary_search.search(codes, F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.contract_groups(table(spark, sf_dir, "documents"))


def op4_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tree.search(table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document at least once, and no source more than four times over."""
    return mixing.mix(table(spark, sf_dir, "documents"), repetition=4.0)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CHAT, "conv_id long, turn long, role string, text string")
    return chat.digest_chats(chat.format_chats(turns.unionByName(extra)))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.pages_text(table(spark, sf_dir, "pages"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least six words and four periods in every text, after the contract's rewriting of some."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = docs.select("doc_id", periodic_runs.planted(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic_runs.digests(periodic_runs.find_runs(texts))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_bpe": op2_bpe,
    "op3_simhash": op3_simhash,
    "op4_vector_tree": op4_vector_tree,
    "op5_sharding": op5_sharding,
    "op6_binary_search": op6_binary_search,
    "op7_token_store": op7_token_store,
    "op8_mixing": op8_mixing,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_url_filter": op10_url_filter,
    "op11_phrases": op11_phrases,
    "op12_main_text": op12_main_text,
    "op13_periodic_runs": op13_periodic_runs,
}

#: All other rows ranked by the number of components whose signs differ.
_OP6_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
), d AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    min(len(list_filter(range(1, greatest(len(a.s), len(b.s)) + 1), lambda i: coalesce(a.s[i], false) <> coalesce(b.s[i], false))))::INTEGER AS distance
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM d
)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""

#: Each row's own share of the formatted length: its text with escapes, and what goes before and after it.
_OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), p AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t
), f AS (
  SELECT *,
    length(replace(replace(text, '\', '\b'), '<', '\l'))
      + CASE WHEN before = role THEN length('<next>')
             ELSE length('<turn >') + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + length('</turn>') + 1 END AS n
  FROM p
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

#: All runs of one to four words counted, then the same joins.
_OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), n AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) AS s(k)
), f AS (
  SELECT lang, k AS m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1
), cut AS (
  SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM c JOIN (VALUES (1), (2), (3)) AS s(k) ON k < c.m
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:c.m], ' ')
), lowest AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covers AS (
  SELECT lang, array_to_string(ws[i:i + n - 1], ' ') AS phrase, max(a) AS longer
  FROM c JOIN (VALUES (2), (3)) AS s(n) ON n < m JOIN (VALUES (1), (2), (3)) AS t(i) ON i + n - 1 <= m GROUP BY ALL
), ranked AS (
  SELECT x.*, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.phrase) AS rank
  FROM lowest x LEFT JOIN covers v ON v.lang = x.lang AND v.phrase = x.phrase
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op6_binary_search": _OP6_SQL, "op9_chat_formatting": _OP9_SQL, "op11_phrases": _OP11_SQL}
