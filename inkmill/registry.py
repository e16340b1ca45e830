"""Registered queries of the library's own operators on the given tables, with SQL equivalents.

``documents`` stand for texts, ``benchmark`` for search queries, ``embeddings`` for chunk vectors
(their label as document), ``conversations`` for claims and ordered excerpts, ``events`` for judge
scores (type as strategy, user as author, day as event) and ``labels`` for two raters.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html, links, names, prompts, tokens
from .functions import text as cleaning
from .functions.header import parse_header
from .operators import agreement, chunking, claims, documents, evaluation, retrieval
from .schemas import EVENTS, events
from .shared import small_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)  # many of them have Python steps
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return register


# ---------------------------------------------------------------- chunks and words

_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_SPANS_SQL = """
WITH RECURSIVE s AS (
  SELECT doc_id, text, length(text) AS n, 0 AS start, NULL::BIGINT AS stop FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, text, n, CASE WHEN e - {overlap} < n - {overlap} THEN e - {overlap} ELSE n END, e FROM (
    SELECT *, CASE WHEN start + {size} < n THEN coalesce(
        start + {step} + length(w) - nullif(strpos(reverse(w), chr(10) || chr(10)), 0) + 1,
        start + {step} + length(w) - nullif(strpos(reverse(w), ' .'), 0) + 1, start + {size}) ELSE start + {size} END AS e
    FROM (SELECT *, substring(text, start + {step} + 1, {overlap}) AS w FROM s) WHERE start < n)
), spans AS (
  SELECT doc_id, text, stop, lag(start) OVER (PARTITION BY doc_id ORDER BY start, stop) AS start FROM s
), cut AS (
  SELECT doc_id, start AS start_char, stop AS end_char, {strip} AS text FROM spans WHERE stop IS NOT NULL
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_char) {plus})::INTEGER AS {number}, text,
  start_char::INTEGER AS start_char, end_char::INTEGER AS end_char
FROM cut WHERE text <> ''
"""


def _spans_sql(size: int, overlap: int, number: str, plus: str) -> str:
    strip = _STRIP.format("substring(text, start + 1, stop - start)")
    return _SPANS_SQL.format(size=size, overlap=overlap, step=size - overlap, number=number, plus=plus, strip=strip)


@query(_spans_sql(4000, 800, "chunk_id", "- 1"))
def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), content="text")


@query(_spans_sql(8000, 1000, "batch_num", ""))
def batch_documents(spark, sf_dir):
    return chunking.batch_documents(table(spark, sf_dir, "documents"), 8000, 1000, content="text")


#: Words of a column as lists; DuckDB's own word boundary knows ASCII only.
_TOKENS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]+'))"


@query(
    "SELECT doc_id, len(t)::INTEGER AS n_tokens, len(list_distinct(t))::INTEGER AS n_distinct FROM (SELECT doc_id, "
    + _TOKENS.format("text")
    + " AS t FROM documents)"
)
def token_stats(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", tokens.tokenize(F.col("text")).alias("t"))
    return words.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query("SELECT lang, count(*) AS documents, sum(length(text) // 4)::BIGINT AS tokens, sum((length(text) // 4) * 4)::BIGINT AS chars FROM documents GROUP BY lang")
def token_estimate(spark, sf_dir):
    n = tokens.estimate_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum(n).alias("tokens"), F.sum(tokens.estimate_chars(n)).alias("chars"))


# ---------------------------------------------------------------- retrieval

_BM25 = (
    "WITH units AS (SELECT doc_id, lang, " + _TOKENS.format("text") + " AS t FROM documents), "
    "queries AS (SELECT item_id AS query_id, <only> AS wanted, " + _TOKENS.format("text") + " AS t FROM benchmark), "
    """
tf AS (SELECT doc_id, lang, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc_id, lang, t, unnest(t) AS term FROM units) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM units),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, wanted, term, count(*) AS qf FROM (SELECT query_id, wanted, unnest(t) AS term FROM queries) GROUP BY ALL),
hits AS (SELECT query_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN q USING (term) JOIN idf USING (term), st WHERE <where> GROUP BY ALL HAVING score > 0),
keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hits)
"""
)


def _bm25_sql(only: str = "NULL", where: str = "true") -> str:
    return _BM25.replace("<only>", only).replace("<where>", where)


_LANGS = "['en', 'fr', 'de', 'es'][(item_id % 4)::INTEGER + 1]"
_TOP = "SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM keyword WHERE rank <= 15"


def _keyword(spark, sf_dir, only=None):
    index = retrieval.keyword_index(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ("doc_id",))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return index, asked


@query(_bm25_sql() + _TOP)
def bm25_topk(spark, sf_dir):
    index, asked = _keyword(spark, sf_dir)
    return retrieval.keyword_search(index, asked).withColumn("score", F.round("score", 6))


@query(_bm25_sql(_LANGS, "lang = wanted") + _TOP)
def bm25_filtered(spark, sf_dir):
    """Each query within one language's documents, with statistics of all documents."""
    units = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    index = retrieval.keyword_index(units, ("doc_id", "lang"))
    lang = F.get(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("item_id") % 4).cast("int"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), lang.alias("wanted"))
    hits = retrieval.keyword_search(index, asked, only=("wanted", "lang"))
    return hits.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def _segments(spark):
    from .operators.blockmax import SegmentedIndex
    from .shared import new_folder

    return SegmentedIndex(spark, new_folder(spark, "segments"), "doc_id long, lang string")


def _segment_hits(index, spark, sf_dir, only=None):
    lang = F.get(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("item_id") % 4).cast("int"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), lang.alias("wanted"))
    return index.search(asked, only=only).hits.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(_bm25_sql() + _TOP)
def bm25_block_max(spark, sf_dir):
    """As ``bm25_topk``, over an index in blocks of which most are not scored."""
    index = _segments(spark)
    index.append(table(spark, sf_dir, "documents"))
    return _segment_hits(index, spark, sf_dir)


@query(_bm25_sql(_LANGS, "lang = wanted") + _TOP)
def bm25_appended(spark, sf_dir):
    """As ``bm25_filtered``, over an index to which three parts of the table are appended, one of them twice by
    name, and of which two segments are merged."""
    index, docs = _segments(spark), table(spark, sf_dir, "documents")
    some, others = F.coalesce(F.col("source") == "web", F.lit(False)), F.coalesce(F.col("lang") == "en", F.lit(False))
    index.append(docs.filter(some), batch="web")
    index.append(docs.filter(~some & others), batch="en")
    index.compact()
    index.append(docs.filter(~some & ~others), batch="rest")
    index.append(docs.filter(~some & ~others), batch="rest")
    return _segment_hits(index, spark, sf_dir, only=("wanted", "lang"))


_VECTOR_SQL = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, CASE WHEN list_dot_product(e, e) > 0 THEN list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) ELSE e END AS e FROM v),
d AS (SELECT q.vec_id AS query_id, q.label AS wanted, u.vec_id, u.label, list_dot_product(q.e, u.e) AS score FROM u AS q, u WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {key}) AS rank FROM d)
"""


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"), "embedding")


@query(_VECTOR_SQL.format(key="vec_id") + "SELECT query_id, vec_id, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 15")
def vector_topk(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    return retrieval.vector_search(rows, asked, ("vec_id",)).withColumn("score", F.round("score", 6))


@query(_VECTOR_SQL.format(key="vec_id") + "SELECT query_id, vec_id, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 15")
def vector_cells(spark, sf_dir):
    """As ``vector_topk``, by cells that are met only where their bounds reach the k-th hit."""
    from .operators import cells

    rows, asked = _vectors(spark, sf_dir)
    return cells.cell_search(rows, asked, ("vec_id",)).hits.withColumn("score", F.round("score", 6))


@query(
    _VECTOR_SQL.format(key="vec_id, label")
    + """SELECT query_id, vec_id, rank::INTEGER AS rank, score FROM (
  SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, round(score, 6) AS score FROM r WHERE rank <= 45 AND label = wanted)
WHERE rank <= 15"""
)
def vector_postfilter(spark, sf_dir):
    """The nearest 45 of all vectors, of which those of the query's own label are kept, at most 15."""
    rows, asked = _vectors(spark, sf_dir)
    hits = retrieval.vector_search(rows, asked, ("vec_id", "label"), only=("wanted", "label"))
    return hits.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(
    _bm25_sql()
    + """, u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
vector AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
  SELECT b.item_id AS query_id, u.vec_id AS doc_id, list_dot_product(q.e, u.e) AS score FROM benchmark b JOIN u AS q ON q.vec_id = b.item_id, u)),
both_lists AS (SELECT query_id, doc_id, v.rank AS vr, k.rank AS kr, coalesce(0.5 / (60 + v.rank), 0) + coalesce(0.5 / (60 + k.rank), 0) AS score
  FROM (SELECT * FROM vector WHERE rank <= 15) v FULL JOIN (SELECT * FROM keyword WHERE rank <= 15) k USING (query_id, doc_id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vr NULLS LAST, kr NULLS LAST, doc_id) AS rank FROM both_lists)
SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM fused WHERE rank <= 5"""
)
def hybrid_rrf(spark, sf_dir):
    """Keyword hits over documents fused with vector hits; a unit's vector is the one of its number, a
    query's that of its own number."""
    index, asked = _keyword(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = asked.join(vectors.withColumnRenamed("doc_id", "query_id"), "query_id", "left")
    return retrieval.hybrid_search(index, vectors, asked).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- cleaning

_W = r"[\p{L}\p{N}\p{M}_]"
_CLEAN = [
    (r' " ', " "), (r' "\s*$', ""), (r'^\s*" ', ""), (r" - ", " "), (r"-([^-\s]{1,200}?)-", r"\1"), (r"\s-([A-Z])", r" \1"), (r"([a-z])-\s", r"\1 "),
    (r"([.!?])-\s", r"\1 "), (r"([a-z])-([A-Z])", r"\1 \2"), (r"([a-z])-([a-z]{2,})([^\p{L}\p{N}\p{M}_]|$)", r"\1 \2\3"), (r"\s-([a-zA-Z])", r" \1"),
    (r"([a-zA-Z])-\s", r"\1 "), (r"\(-", "("), (r"-\)", ")"), (r"\.-\)", ".)"), (r"-([;:,.!?])", r"\1"), (r"''s-;", "''s;"),
]


def _clean_sql(column: str) -> str:
    out = column
    for old, new in [("â€œ", '"'), ("â€", '"'), ("â", "—"), ("Ã©", "é"), ("Ã¨", "è"), ("Ã ", "à"), ("Ã", "í"), ("—", "-"), ("–", "-")]:
        out = f"replace({out}, '{old}', '{new}')"
    for old, new in _CLEAN:
        out = f"regexp_replace({out}, '{old}', '{new}', 'g')"
    for old, new in [("chr(13) || chr(10)", "' '"), ("chr(13)", "' '"), ("chr(10)", "' '"), ("'\\\"'", "'\"'"), ("'\\'''", "''''"), ("'\\'", "''")]:
        out = f"replace({out}, {old}, {new})"
    return f"regexp_replace({out}, '  +', ' ', 'g')"


@query(f"SELECT doc_id, {_clean_sql('text')} AS clean, length(text) - length({_clean_sql('text')}) AS removed_chars FROM documents")
def clean_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", cleaning.fix_encoding(F.col("text")).alias("clean"))
    return documents.cleaning_delta(docs, "text", "clean").select("doc_id", "clean", "removed_chars")


@query(r"SELECT doc_id, " + _STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')") + " AS text FROM documents")
def normalize_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.normalize_field(F.col("text")).alias("text"))


@query(
    r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^\p{L}\p{N}\p{M}_\s-]', '', 'g'), '\s+', '_', 'g') AS slug, "
    r"p_partkey || '_' || regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^\p{L}\p{N}\p{M}_\s-]', '', 'g'), '\s+', '_', 'g') || '.md' AS file, "
    r"left(replace(trim(regexp_replace(p_name || ' #' || p_brand, '[^\p{L}\p{N} _-]', '', 'g')), ' ', '_'), 12) AS safe FROM part"
)
def slugs(spark, sf_dir):
    name = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        links.event_slug(name).alias("slug"),
        links.event_filename(F.col("p_partkey").cast("string"), name).alias("file"),
        links.safe_filename(F.concat("p_name", F.lit(" #"), "p_brand"), 12).alias("safe"),
    )


_WORDS = r"regexp_extract_all(s_name || ' ' || chr((65 + s_suppkey % 26)::INTEGER) || 'ark', '[A-Za-z]+')"


@query(
    f"""WITH w AS (SELECT s_suppkey, {_WORDS} AS w FROM supplier),
n AS (SELECT s_suppkey, upper(left(w[1], 1)) || lower(substring(w[1], 2)) AS a, upper(left(w[-1], 1)) || lower(substring(w[-1], 2)) AS b FROM w)
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN b || ' ' || a WHEN 1 THEN b || ' ' || a WHEN 2 THEN b || ' ' || a || ' Jr.' WHEN 3 THEN 'Baron ' || b || ' ' || a
  WHEN 4 THEN b || ' ' || a || ', ' || a || ' ' || b ELSE a END AS name FROM n"""
)
def name_normalize(spark, sf_dir):
    """Names made of suppliers' words in the forms that name lists use."""
    w = F.regexp_extract_all(F.concat(F.col("s_name"), F.lit(" "), F.char(F.lit(65) + F.col("s_suppkey") % 26), F.lit("ark")), F.lit("[A-Za-z]+"), F.lit(0))
    a, b = F.initcap(F.lower(F.element_at(w, 1))), F.initcap(F.lower(F.element_at(w, -1)))
    k = F.col("s_suppkey") % 6
    raw = (
        F.when(k == 0, F.concat(a, F.lit(",\n "), b, F.lit(", 1809-1865"))).when(k == 1, F.concat(a, F.lit(", "), b, F.lit(" (X Y)")))
        .when(k == 2, F.concat(a, F.lit(", "), b, F.lit(", Jr."))).when(k == 3, F.concat(a, F.lit(", "), b, F.lit(", Baron")))
        .when(k == 4, F.concat_ws(", ", a, b, b, a)).otherwise(a)
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", names.normalize_name(raw).alias("name"))


@query(
    """SELECT o_orderkey, 'Clerk to Buyer, ' || strftime(o_orderdate, '%A, %B %-d, %Y') AS title, strftime(o_orderdate, '%B %-d, %Y') AS date,
  'Clerk' AS sender, 'Buyer' AS recipient, 'Boston, Mass.' AS place, 'Letter' AS document_type FROM orders"""
)
def header_parse(spark, sf_dir):
    """Headers written around the orders' dates, and what is read from them."""
    day = F.date_format("o_orderdate", "EEEE, MMMM d, yyyy")
    content = F.concat(
        F.lit("General Correspondence. 1833-1916: Clerk to Buyer, "), day, F.lit(" Abraham Lincoln Papers\n\nBoston Mass. "), F.date_format("o_orderdate", "MMM d"), F.lit("\n")
    )
    h = table(spark, sf_dir, "orders").select("o_orderkey", parse_header(content).alias("h"))
    return h.select("o_orderkey", "h.title", "h.date", F.col("h.from").alias("sender"), F.col("h.to").alias("recipient"), "h.place", "h.document_type")


@query(
    """WITH u AS (SELECT page_id, rtrim(replace(replace(replace(url, '/en/', '/item/'), '/fr/', '/resource/'), '/de/', '/exhibits/'), '/') AS u FROM pages)
SELECT page_id, CASE WHEN contains(u, '/item/') THEN 'item' WHEN contains(u, '/resource/') THEN 'resource' WHEN contains(u, '/exhibits/') THEN 'exhibits' ELSE 'unknown' END AS url_type,
  CASE WHEN contains(u, '/item/') THEN split_part(string_split(u, '/item/')[-1], '/', 1)
       WHEN contains(u, '/resource/') THEN replace(split_part(string_split(u, '/resource/')[-1], '/', 1), '.', '_')
       WHEN contains(u, '/exhibits/') THEN 'exhibits_' || replace(string_split(u, '/')[-1], '.html', '') ELSE 'unknown' END AS id FROM u"""
)
def link_parts(spark, sf_dir):
    """Kinds and ids of page URLs, their language parts renamed to those of an archive."""
    url = F.col("url")
    for old, new in (("/en/", "/item/"), ("/fr/", "/resource/"), ("/de/", "/exhibits/")):
        url = F.replace(url, F.lit(old), F.lit(new))
    return documents.with_link_parts(table(spark, sf_dir, "pages").select("page_id", url.alias("url"))).select("page_id", "url_type", "id")


@query()
def html_extract(spark, sf_dir):
    """Headings and main text of every page; a test holds it against a parsed fixture."""
    return table(spark, sf_dir, "pages").select("page_id", html.page_text("html").alias("p")).select("page_id", "p.title", "p.content")


@query()
def xml_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.clean_xml_text(F.col("html")).alias("text"))


# ---------------------------------------------------------------- documents


@query(
    """SELECT 'gutenberg_' || doc_id AS id, text, 'gutenberg' AS source FROM documents WHERE source IN ('src0', 'src1')
UNION ALL SELECT 'loc_' || doc_id, text, 'loc' FROM documents WHERE source NOT IN ('src0', 'src1')"""
)
def union_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    books = F.col("source").isin("src0", "src1")
    one = lambda rows, prefix: rows.select(F.concat(F.lit(prefix), "doc_id").alias("id"), "text")
    return documents.combine(one(docs.filter(books), "gutenberg_"), one(docs.filter(~books), "loc_"))


@query("SELECT lang, count(*) AS entries, sum(length(text))::BIGINT AS chars, (sum(length(text)) // count(*))::BIGINT AS average_chars FROM documents GROUP BY lang")
def dataset_report(spark, sf_dir):
    return documents.report(table(spark, sf_dir, "documents"), "lang", "text")


@query("SELECT CASE WHEN n_chars > 4000 THEN 'batched' ELSE 'direct' END AS path, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def route_by_type(spark, sf_dir):
    books, others = documents.route(table(spark, sf_dir, "documents"), F.col("n_chars") > 4000)
    both = books.withColumn("path", F.lit("batched")).unionByName(others.withColumn("path", F.lit("direct")))
    return both.groupBy("path").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("SELECT 'doc_' || (row_number() OVER (ORDER BY doc_id) - 1) AS id, doc_id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'd' || doc_id, doc_id FROM documents WHERE doc_id % 3 <> 0")
def default_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("d"), "doc_id")).alias("id"), "doc_id")
    return documents.with_default_id(docs, "doc_", "doc_id")


# ---------------------------------------------------------------- claims and prompts

_TURNS_SQL = """
WITH t AS (SELECT conv_id AS event, turn, role, string_split(text, chr(10)) AS claims FROM conversations WHERE text <> ''),
p AS (SELECT event, flatten(list(claims ORDER BY turn)) AS claims FROM t WHERE role = 'user' GROUP BY event),
a AS (SELECT event, role AS author, flatten(list(claims ORDER BY turn)) AS claims, arg_min(left(claims[1], 20), turn) AS doc_title, min(turn) AS doc_id FROM t WHERE role <> 'user' GROUP BY ALL)
"""


def _extractions(spark, sf_dir):
    """Conversations as extractions: a conversation is an event, a role an author, lines are claims."""
    t = table(spark, sf_dir, "conversations").filter("text <> ''")
    lines = F.split("text", "\n", -1)
    rows = t.select(
        F.col("conv_id").alias("event"), F.col("role").alias("author"), lines.alias("claims"), F.col("turn").alias("doc_ord"),
        F.substring(F.get(lines, F.lit(0)), 1, 20).alias("document_title"), F.col("turn").cast("string").alias("document_id"),
    )
    return claims.primary_claims(rows.filter("author = 'user'")), claims.author_claims(rows.filter("author <> 'user'"))


@query(_TURNS_SQL + "SELECT event, author, array_to_string(claims, chr(10)) AS claims, doc_title, doc_id::VARCHAR AS doc_id FROM a")
def claims_by_author(spark, sf_dir):
    _, authors = _extractions(spark, sf_dir)
    return authors.withColumn("claims", F.array_join("claims", "\n"))


@query(
    _TURNS_SQL
    + "SELECT event, author, array_to_string(p.claims, chr(10)) AS primary_claims, array_to_string(a.claims, chr(10)) AS author_claims, doc_title || ' (' || doc_id || ')' AS doc_info FROM p JOIN a USING (event)"
)
def comparison_pairs(spark, sf_dir):
    pairs = claims.comparison_pairs(*_extractions(spark, sf_dir))
    return pairs.withColumn("primary_claims", F.array_join("primary_claims", "\n")).withColumn("author_claims", F.array_join("author_claims", "\n"))


@query(
    _TURNS_SQL
    + """SELECT event, coalesce(len(p.claims), 0)::INTEGER AS primary_claims, coalesce(n, 0) AS authors, coalesce(c, 0)::BIGINT AS author_claims
FROM p FULL JOIN (SELECT event, count(*) AS n, sum(len(claims)) AS c FROM a GROUP BY event) USING (event)"""
)
def event_claim_counts(spark, sf_dir):
    return claims.event_counts(*_extractions(spark, sf_dir))


@query(
    """SELECT conv_id AS document_id, count(*) FILTER (WHERE text LIKE '%' || chr(10) || '%') AS events_with_claims,
  coalesce(sum(len(string_split(text, chr(10))) - 1), 0)::BIGINT AS claims FROM conversations GROUP BY conv_id"""
)
def document_claim_counts(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))).alias("claims"))
    return claims.document_counts(rows)


@query(
    """WITH e AS (SELECT conv_id, turn, string_agg(x || chr(10) || chr(10), '' ORDER BY i) AS body FROM (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations WHERE role = 'assistant') WHERE x <> '' GROUP BY ALL),
s AS (SELECT conv_id, string_agg(chr(10) || '## CHUNK ' || turn || chr(10) || body, '' ORDER BY turn) AS body FROM e GROUP BY conv_id)
SELECT c.conv_id, CASE WHEN body IS NULL THEN 'No information found.' ELSE '# INTERMEDIATE EXTRACTION' || chr(10) || chr(10) || '# EVENT: conversation_' || c.conv_id || chr(10) || chr(10)
  || '# BOOK: Book ' || c.conv_id || chr(10) || chr(10) || '# AUTHOR: assistant' || chr(10) || chr(10) || body || chr(10) || '# END' END AS text
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id)"""
)
def intermediate_assembly(spark, sf_dir):
    from .operators import extraction

    turns = table(spark, sf_dir, "conversations")
    pairs = turns.select("conv_id").distinct().select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("Conversation "), "conv_id").alias("event"), F.concat(F.lit("Book "), "conv_id").alias("title"), F.lit("assistant").alias("author")
    )
    found = turns.filter("role = 'assistant'").select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("Conversation "), "conv_id").alias("event"), F.col("turn").alias("batch_num"), F.split("text", "\n", -1).alias("excerpts")
    )
    return extraction.assemble(pairs, found).select(F.col("doc_id").alias("conv_id"), "text")


@query(
    """WITH c AS (SELECT conv_id, string_agg('- ' || text, chr(10) ORDER BY turn) AS b,
  string_agg('[Passage ' || i || ']:' || chr(10) || left(text, 100), chr(10) || chr(10) ORDER BY turn) AS p
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY conv_id)
SELECT conv_id, 'Conversation {' || conv_id || '}' || chr(10) || b AS prompt, p AS passages FROM c"""
)
def prompt_render(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("texts")
    )
    prompt = prompts.render("Conversation {{{id}}}\n{claims}", id=F.col("conv_id"), claims=prompts.bullets(F.col("texts")))
    return rows.select("conv_id", prompt.alias("prompt"), prompts.passages(F.col("texts"), 100).alias("passages"))


@query(
    r"""WITH e AS (SELECT i AS event_ord, ['Election Night 1860', 'Fort Sumter Decision', 'Gettysburg Address', 'Second Inaugural Address', 'Ford''s Theatre Assassination'][i + 1] AS event FROM range(5) t(i)),
x AS (SELECT doc_id, event_ord, event FROM documents, e)
SELECT x.doc_id, event, coalesce(quality = 1, false) AS labelled, CASE WHEN quality IS NULL THEN 'Not mentioned' ELSE 'tone ' || toxic END AS tone,
  regexp_replace(regexp_replace(lower(event), '[^a-z0-9_\s-]', '', 'g'), '\s+', '_', 'g') AS slug
FROM x LEFT JOIN labels l ON l.doc_id = x.doc_id AND (l.doc_id % 5) = event_ord"""
)
def event_cross_default(spark, sf_dir):
    """Every document with every event; what no extraction gave has defaults."""
    crossed = table(spark, sf_dir, "documents").select("doc_id").crossJoin(F.broadcast(events(spark)))
    given = table(spark, sf_dir, "labels").withColumn("event_ord", (F.col("doc_id") % 5).cast("int"))
    joined = crossed.join(given, ["doc_id", "event_ord"], "left")
    return joined.select(
        "doc_id", "event", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("labelled"),
        F.when(F.col("quality").isNull(), "Not mentioned").otherwise(F.concat(F.lit("tone "), "toxic")).alias("tone"), "slug",
    )


# ---------------------------------------------------------------- evaluation

_TYPES = ["click", "error", "purchase", "signup", "view"]
_RUNS_SQL = "WITH r AS (SELECT date_trunc('week', ts)::DATE::VARCHAR AS event, user_id AS author, event_type AS prompt_type, value AS score FROM events)"
_CONSISTENCY_SQL = (
    _RUNS_SQL
    + """, c AS (SELECT event, author, prompt_type, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS min, max(score) AS max,
  round(max(score) - min(score), 6) AS range, count(score) AS valid_runs, count(*) FILTER (WHERE score IS NULL) AS errors FROM r GROUP BY ALL)"""
)


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.trunc("ts", "week").cast("string").alias("event"), F.col("user_id").alias("author"), F.col("event_type").alias("prompt_type"), F.col("value").alias("score"), F.col("event_id").alias("run")
    )


@query(
    "SELECT event_type AS prompt_type, round(avg(value), 6) AS mean_score, round(stddev_samp(value), 6) AS std_dev, min(value) AS min_score, max(value) AS max_score FROM events GROUP BY event_type"
)
def strategy_summary(spark, sf_dir):
    return evaluation.strategy_summary(_runs(spark, sf_dir))


_WIDE_SQL = (
    _RUNS_SQL
    + ", w AS (SELECT event, author, "
    + ", ".join(f"round(avg(score) FILTER (WHERE prompt_type = '{t}'), 5) AS {t}_score" for t in ("click", "error", "view"))
    + " FROM r GROUP BY ALL)"
)


@query(
    _WIDE_SQL
    + """, v AS (SELECT *, (0.0 + click_score + error_score + view_score) / 3 AS avg_score FROM w WHERE click_score IS NOT NULL AND error_score IS NOT NULL AND view_score IS NOT NULL),
a AS (SELECT author, round_even(round(avg(avg_score) * 100, 6), 0) / 100 AS avg_score, round_even(round(stddev_samp(avg_score) * 100, 6), 0) / 100 AS std_dev, count(*) AS events_compared,
  round_even(round(avg(click_score) * 100, 6), 0) / 100 AS click_mean, round_even(round(avg(error_score) * 100, 6), 0) / 100 AS error_mean, round_even(round(avg(view_score) * 100, 6), 0) / 100 AS view_mean FROM v GROUP BY author)
SELECT *, row_number() OVER (ORDER BY avg_score DESC, author)::INTEGER AS rank FROM a"""
)
def author_ranking(spark, sf_dir):
    strategies = ["click", "error", "view"]
    means = _runs(spark, sf_dir).groupBy("event", "author", "prompt_type").agg(F.round(F.avg("score"), 5).alias("score"))
    return evaluation.author_ranking(evaluation.widen(means, strategies), strategies)


@query(_CONSISTENCY_SQL + "SELECT * FROM c")
def self_consistency(spark, sf_dir):
    return evaluation.self_consistency(_runs(spark, sf_dir))


@query(_RUNS_SQL.replace("value AS score", "value AS score, event_id AS run") + " SELECT event, author, prompt_type, array_to_string(list(score ORDER BY run), ',') AS scores FROM r WHERE score IS NOT NULL GROUP BY ALL")
def run_scores(spark, sf_dir):
    return evaluation.run_scores(_runs(spark, sf_dir)).withColumn("scores", F.array_join("scores", ","))


@query(
    _CONSISTENCY_SQL
    + """, m AS (SELECT prompt_type, round(avg(std), 6) AS mean_std FROM c WHERE std IS NOT NULL GROUP BY prompt_type)
SELECT prompt_type, mean_std, (SELECT round(avg(std), 6) FROM c WHERE std IS NOT NULL) AS overall_mean_std FROM m ORDER BY mean_std, prompt_type LIMIT 1"""
)
def least_variance(spark, sf_dir):
    return evaluation.least_variance(evaluation.self_consistency(_runs(spark, sf_dir)))


@query(
    _CONSISTENCY_SQL
    + """SELECT event, author, round_even(round(max(range) * 10, 6), 0) / 10 AS max_range, round_even(round(avg(range) * 10, 6), 0) / 10 AS avg_range, count(*) AS num_strategies,
  string_agg(prompt_type, ', ' ORDER BY range DESC, prompt_type) AS strategies FROM c WHERE range > 20 GROUP BY event, author"""
)
def problem_pairs(spark, sf_dir):
    return evaluation.problem_pairs(evaluation.self_consistency(_runs(spark, sf_dir)))


@query(
    _CONSISTENCY_SQL + "SELECT event, " + ", ".join(f"round(avg(range) FILTER (WHERE prompt_type = '{t}'), 6) AS {t}" for t in _TYPES) + " FROM c GROUP BY event"
)
def range_pivot(spark, sf_dir):
    return evaluation.range_pivot(evaluation.self_consistency(_runs(spark, sf_dir)), _TYPES)


@query(
    _CONSISTENCY_SQL
    + """SELECT CASE WHEN mean >= 90 THEN 'consistent' WHEN mean >= 70 THEN 'mostly' WHEN mean >= 50 THEN 'partly' ELSE 'contradictory' END AS band,
  CASE WHEN std < 5 THEN 'high' WHEN std < 15 THEN 'medium' ELSE 'low' END AS reliability, count(*) AS pairs FROM c GROUP BY ALL"""
)
def score_bands(spark, sf_dir):
    c = evaluation.self_consistency(_runs(spark, sf_dir))
    return c.groupBy(evaluation.score_band(F.col("mean")).alias("band"), evaluation.reliability(F.col("std")).alias("reliability")).agg(F.count("*").alias("pairs"))


@query(
    """WITH b AS (SELECT event_type AS strategy, (user_id % 2 = 0)::INTEGER AS human, coalesce(value >= 70, false)::INTEGER AS judge FROM events),
c AS (SELECT strategy, count(*) FILTER (WHERE human = 0 AND judge = 0) AS tn, count(*) FILTER (WHERE human = 0 AND judge = 1) AS fp,
  count(*) FILTER (WHERE human = 1 AND judge = 0) AS fn, count(*) FILTER (WHERE human = 1 AND judge = 1) AS tp FROM b GROUP BY strategy),
k AS (SELECT *, (tp + tn)::DOUBLE / (tn + fp + fn + tp) AS po, ((tp + fn)::DOUBLE * (tp + fp) + (tn + fp)::DOUBLE * (tn + fn)) / ((tn + fp + fn + tp)::DOUBLE * (tn + fp + fn + tp)) AS pe FROM c)
SELECT strategy, tn, fp, fn, tp, round(po, 9) AS agreement, round((po - pe) / nullif(1 - pe, 0), 9) AS kappa FROM k"""
)
def binarize_confusion_kappa(spark, sf_dir):
    rated = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("strategy"), (F.col("user_id") % 2 == 0).cast("int").alias("human"), agreement.reaches(F.col("value")).alias("judge")
    )
    return agreement.agreement(rated, ["strategy"])


@query(
    """WITH c AS (SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
  count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp FROM labels),
k AS (SELECT *, (tp + tn)::DOUBLE / (tn + fp + fn + tp) AS po, ((tp + fn)::DOUBLE * (tp + fp) + (tn + fp)::DOUBLE * (tn + fn)) / ((tn + fp + fn + tp)::DOUBLE * (tn + fp + fn + tp)) AS pe FROM c)
SELECT tn, fp, fn, tp, round(po, 9) AS agreement, round((po - pe) / nullif(1 - pe, 0), 9) AS kappa FROM k"""
)
def rater_agreement(spark, sf_dir):
    """The two label columns as two raters."""
    return agreement.agreement(table(spark, sf_dir, "labels"), [], "quality", "toxic")


@query(
    """SELECT lang, source, CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE '' END AS level,
  count(*) FILTER (WHERE quality = 1) AS consistent, count(*) FILTER (WHERE quality <> 1) AS not_consistent
FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))"""
)
def label_rollup(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return agreement.label_rollup(joined, ["lang", "source"], F.col("quality") == 1)


@query(
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT least(floor((value - lo) / (hi - lo) * 10), 9)::INTEGER AS bin, lo, hi FROM events, e WHERE value IS NOT NULL)
SELECT bin, round(lo + (hi - lo) / 10 * bin, 6) AS low, round(lo + (hi - lo) / 10 * (bin + 1), 6) AS high, count(*) AS n FROM b GROUP BY bin, lo, hi"""
)
def histogram(spark, sf_dir):
    return evaluation.histogram(table(spark, sf_dir, "events"), "value")


@query(
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT event_type, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, min(value) AS whisker_low, max(value) AS whisker_high
FROM events JOIN q USING (event_type) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY event_type"""
)
def boxplot(spark, sf_dir):
    return evaluation.box_plot(table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT event_type, count(*) AS events, count(*) FILTER (WHERE json_extract(props, '$.k') IS NULL) AS without_k, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    """Replies read as semi-structured values; what cannot be read counts as missing."""
    from .functions import payload

    k = F.try_variant_get(payload.parse(F.col("props")), "$.k", "bigint")
    rows = table(spark, sf_dir, "events").select("event_type", k.alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(F.col("k").isNull()).alias("without_k"), F.sum("k").alias("k"))


@query(
    """WITH l AS (SELECT doc_id, min(quality)::BIGINT AS quality FROM labels GROUP BY doc_id)
SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN l USING (doc_id)"""
)
def label_join(spark, sf_dir):
    """All documents with their first label, and those that have none."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    found, missing = agreement.match_labels(table(spark, sf_dir, "documents").select("doc_id"), labels, ["doc_id"], "quality")
    return found.select("doc_id", "quality").withColumn("matched", F.lit(True)).unionByName(
        missing.withColumn("quality", F.lit(None).cast("long")).withColumn("matched", F.lit(False))
    )


@query(
    """WITH n AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS size FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, len(embedding)::INTEGER AS components, round(embedding[1]::DOUBLE / size, 6) AS first, round(list_max(embedding)::DOUBLE / size, 6) AS largest FROM n"""
)
def vector_index(spark, sf_dir):
    """A vector index built of one part of the table, appended to with the whole, and loaded again."""
    from .shared import new_folder
    from .sources import files

    path, vectors = new_folder(spark, "vectors"), table(spark, sf_dir, "embeddings")
    files.save_vectors(vectors.filter("label IS NULL OR label < 5"), path, ("vec_id",))
    files.save_vectors(vectors, path, ("vec_id",), append=True)
    v = F.col("embedding")
    return files.load_vectors(spark, path).select(
        "vec_id", F.size(v).alias("components"), F.round(F.get(v, F.lit(0)), 6).alias("first"), F.round(F.array_max(v), 6).alias("largest")
    )


@query(
    """SELECT 'doc_' || doc_id AS id, CASE WHEN lang = 'fr' THEN 'Unknown' ELSE 'Title ' || doc_id END AS title,
  CASE WHEN n_chars > 4000 THEN 'Book' WHEN lang = 'de' THEN 'Speech' ELSE 'Letter' END AS document_type,
  CASE WHEN source <> 'web' THEN source WHEN n_chars > 4000 THEN 'Unknown Author' ELSE 'Abraham Lincoln' END AS author, length(text) AS chars
FROM documents"""
)
def hybrid_defaults(spark, sf_dir):
    """Documents of which some lack a title, a type or a sender, with what the retrieval job takes instead."""
    kind = F.when(F.col("n_chars") > 4000, "Book").when(F.col("lang") == "de", "Speech")
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("id"), F.when(F.col("lang") != "fr", F.concat(F.lit("Title "), "doc_id")).alias("title"), kind.alias("document_type"),
        F.when(F.col("source") != "web", F.col("source")).alias("from"), F.col("text").alias("content"),
    )
    return documents.for_hybrid(docs).select("id", "title", "document_type", "author", F.length("content").cast("long").alias("chars"))


#: Replies about pages: their fields are strings, lists or missing, by the page's number.
_ITEM = """
SELECT page_id, to_json(named_struct(
  'item', named_struct(
    'title', CASE page_id % 3 WHEN 0 THEN concat('Abraham Lincoln to Clerk ', page_id, ', at ', url) WHEN 1 THEN concat('Inaugural of ', url) ELSE concat('Page ', page_id) END,
    'type', if(page_id % 4 = 0, 'Letter', null), 'original_format', if(page_id % 4 = 1, array('Manuscript', 'Print'), null),
    'contributor_names', array(concat('Name ', page_id % 7), 'Other')),
  'resources', array(
    named_struct('pdf', if(page_id % 5 = 0, concat(url, '.pdf'), null), 'fulltext_file', if(page_id % 2 = 0, concat(url, '.xml'), null),
      'files', array(array(named_struct('url', concat(url, '/a.jpg'), 'mimetype', 'x'), named_struct('url', concat(url, '/b'), 'mimetype', 'image/tiff'), named_struct('url', concat(url, '/C.PDF'), 'mimetype', 'y')))))
)) AS body FROM {pages}
"""


@query(
    """WITH p AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'Abraham Lincoln to Clerk ' || page_id || ', at ' || url WHEN 1 THEN 'Inaugural of ' || url ELSE 'Page ' || page_id END AS title FROM pages)
SELECT page_id, title, CASE WHEN page_id % 4 = 0 THEN 'Letter' WHEN page_id % 4 = 1 THEN 'Manuscript'
    WHEN contains(lower(title), 'letter') THEN 'Letter' WHEN contains(lower(title), 'speech') OR contains(lower(title), 'address') OR contains(lower(title), 'inaugural') THEN 'Speech' ELSE 'Document' END AS document_type,
  CASE WHEN page_id % 3 = 0 THEN 'Abraham Lincoln' ELSE 'Name ' || (page_id % 7) END AS sender,
  CASE WHEN page_id % 3 = 0 THEN 'Clerk ' || page_id END AS recipient,
  CASE WHEN page_id % 5 = 0 THEN url || '.pdf' ELSE url || '/C.PDF' END AS pdf_url, url || '/a.jpg|' || url || '/b' AS image_urls,
  CASE WHEN page_id % 2 = 0 THEN url || '.xml' END AS fulltext_url
FROM p"""
)
def payload_fields(spark, sf_dir):
    """Fields of archive replies, made of pages: values that are strings, lists or missing."""
    from .functions import payload

    rows = spark.sql(_ITEM, pages=table(spark, sf_dir, "pages")).withColumn("v", payload.parse(F.col("body")))
    v, m = F.col("v"), payload.metadata(F.col("v"))
    return rows.select(
        "page_id", m["title"].alias("title"), payload.document_type(v).alias("document_type"), m["from"].alias("sender"), m["to"].alias("recipient"),
        payload.pdf_url(v).alias("pdf_url"), F.array_join(payload.image_urls(v), "|").alias("image_urls"), payload.fulltext_url(v).alias("fulltext_url"),
    )


@query(
    """WITH d AS (SELECT lang, length(text)::BIGINT AS reply, sha256(text) AS h FROM documents)
SELECT lang, count(*) AS documents, count(DISTINCT h) AS prompts, sum(reply)::BIGINT AS chars, 0::BIGINT AS asked_again FROM d GROUP BY lang"""
)
def reply_ledger(spark, sf_dir):
    """Every document's text asked once, by way of a ledger: those of one source first, then all, then all again."""
    from .shared import new_folder
    from .sources.ledger import ReplyLedger

    ledger = ReplyLedger(spark, new_folder(spark, "ledger"), wave=100_000)
    ask = ledger.completer(_Length(), "length")
    rows = table(spark, sf_dir, "documents").select("lang", "source", F.coalesce("text", F.lit("")).alias("prompt"))
    ask(rows.filter("source = 'web'"))
    replied = ask(rows)
    paid = ledger.table.read().count()
    ask(rows)
    again = ledger.table.read().count() - paid
    return replied.groupBy("lang").agg(
        F.count("*").alias("documents"), F.count_distinct("prompt").alias("prompts"), F.sum(F.col("reply").cast("long")).alias("chars"), F.lit(again).cast("long").alias("asked_again")
    )


class _Length:
    """A model that replies with the length of its prompt."""

    def complete(self, prompt, temperature=None):
        return str(len(prompt))


@query("SELECT count(DISTINCT p_type)::BIGINT AS events, count(*)::BIGINT AS pairs FROM part")
def pair_events(spark, sf_dir):
    """Distinct events among pairs, with parts for pairs."""
    return claims.events_in_pairs(table(spark, sf_dir, "part").select(F.col("p_type").alias("event")))


# ---------------------------------------------------------------- models, jobs and streams


def _books(spark, sf_dir):
    """Documents as the extraction pipelines take them; long ones count as books."""
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("n_chars") > 4000, "Book").otherwise("Letter")
    return docs.select(
        F.concat(F.lit("doc_"), "doc_id").alias("id"), F.concat(F.lit("Title "), "doc_id").alias("title"), kind.alias("document_type"),
        F.col("source").alias("from"), F.col("text").alias("content"),
    )


#: Words of the synthetic texts that stand for the events.
_HINTS = dict(zip(EVENTS, (["of"], ["thand"], ["que"], ["und"], ["bobo"]), strict=True))


@query()
def extract_batched(spark, sf_dir):
    """Records of all documents: long ones by batches in two stages, the others directly."""
    from .models import KeywordCompleter
    from .plans import jobs

    return jobs.batched_pipeline(spark, _books(spark, sf_dir), KeywordCompleter(_HINTS))


@query()
def extract_hybrid(spark, sf_dir):
    """Records of all documents: long ones by hybrid retrieval for each event, the others directly."""
    from .models import HashingEmbedder, KeywordCompleter
    from .plans import jobs

    return jobs.hybrid_pipeline(spark, _books(spark, sf_dir), KeywordCompleter(_HINTS), HashingEmbedder())


@query()
def embed_documents(spark, sf_dir):
    from .models import HashingEmbedder, embed_with

    return table(spark, sf_dir, "documents").select("doc_id", embed_with(HashingEmbedder(), F.col("text")).alias("embedding"))


@query()
def judge_pairs(spark, sf_dir):
    """Scores of every comparison pair under every strategy, by word overlap."""
    from .models import OverlapJudge, judge

    work = evaluation.work_plan(claims.comparison_pairs(*_extractions(spark, sf_dir)), spark)
    return judge(work, OverlapJudge()).select("event", "author", "prompt_type", "run", "score", "error")


@query("SELECT doc_id, lang, len(t)::INTEGER AS n_tokens FROM (SELECT doc_id, lang, " + _TOKENS.format("text") + " AS t FROM documents)")
def stream_ingest(spark, sf_dir):
    """The documents read as a stream of files, worked on in micro-batches, and read back."""
    from .shared import new_folder
    from .streaming import ingest

    path = f"{sf_dir.rstrip('/')}/documents.parquet"
    folder = new_folder(spark, "stream")
    # a pattern, since a stream's plain path has to be a folder and small tables are one file
    stream = ingest.documents_stream(spark, path.removesuffix(".parquet") + "[.]parquet", spark.read.parquet(path).schema)
    work = lambda batch: batch.select("doc_id", "lang", F.size(tokens.tokenize(F.col("text"))).alias("n_tokens"))
    ingest.extract_incrementally(stream, work, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema("doc_id long, lang string, n_tokens int").parquet(f"{folder}/out/batch=*")
