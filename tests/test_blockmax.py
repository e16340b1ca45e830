"""Block-max search over segments against scoring everything."""

import random

import pytest

from inkmill import registry
from inkmill.operators import retrieval
from inkmill.operators.blockmax import SegmentedIndex

from .oracle import connect, same


@pytest.mark.parametrize("name", ["bm25_block_max", "bm25_appended"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), connect(sf_dir).sql(registry.ORACLE_SQL[name]))


def test_most_postings_are_not_scored(spark, sf_dir, tmp_path):
    """Queries of two rarer words and four of any kind, over units of which each has many common words."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    units = [(i, " ".join(rng.choices(words, weights, k=rng.randint(5, 120)))) for i in range(3000)]
    queries = [(i, " ".join(rng.choices(words, weights, k=4) + rng.choices(words[100:], k=2))) for i in range(40)] + [(98, "zz"), (99, "")]
    docs = spark.createDataFrame(units, "id long, text string")
    asked = spark.createDataFrame(queries, "query_id long, query string")
    index = SegmentedIndex(spark, str(tmp_path / "i"), "id long", bucket=4)
    for lo in (0, 1000, 2000):
        assert index.append(docs.filter(f"id >= {lo} AND id < {lo + 1000}"), batch=str(lo)) == 1000
    found = index.search(asked, 10)
    want = retrieval.keyword_search(retrieval.keyword_index(docs, ("id",)), asked, 10)
    key = lambda rows: sorted((r.query_id, r.id, r["rank"], round(r.score, 9)) for r in rows.collect())
    assert key(found.hits) == key(want)
    total, scored = found.counts.selectExpr("sum(postings)", "sum(scored)").first()
    print(f"{scored} of {total} postings scored")
    assert scored < total / 2
    assert index.compact() == 3 and len(index.table.snapshot().parts) == 1 and index.append(docs.limit(3), batch="1000") == 0
    assert key(index.search(asked, 10).hits) == key(want)


def test_small_and_odd_sets(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a a c", "y"), (3, None, "x"), (4, "a", "y"), (None, "a b b", None)], "id long, text string, tag string")
    index = SegmentedIndex(spark, str(tmp_path / "i"), "id long, tag string", bucket=2)
    asked = spark.createDataFrame([(1, "a b b", "x"), (2, "c a", "y"), (3, None, "x"), (4, "nothing", None)], "query_id long, query string, want string")
    assert index.search(asked).hits.count() == 0
    index.append(docs.limit(0))
    index.append(docs)
    plain = retrieval.keyword_index(docs, ("id", "tag"))
    key = lambda rows: sorted((str(r.query_id), str(r.id), r["rank"], round(r.score, 9)) for r in rows.collect())
    for only in (None, ("want", "tag")):
        assert key(index.search(asked, 3, only).hits) == key(retrieval.keyword_search(plain, asked, 3, only))


def test_merging_with_an_empty_segment_writes_nothing(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "i"), "id long")
    docs = spark.createDataFrame([(i, f"a b w{i}") for i in range(20)], "id long, text string")
    assert index.append(docs.limit(0), batch="none") == 0 and index.append(docs, batch="all") == 20
    before = {p["folder"] for p in index.table.snapshot().parts}
    assert index.compact() == 2
    (part,) = index.table.snapshot().parts
    assert part["folder"] in before and part["units"] == 20 and sorted(part["batches"]) == ["all", "none"]
    assert index.append(docs, batch="none") == index.append(docs, batch="all") == 0


def test_blocks_of_a_frequent_word_are_few(spark, tmp_path):
    """Blocks grow with buckets of a thousand units, not with postings; merged ones are no smaller and find the same."""
    index = SegmentedIndex(spark, str(tmp_path / "i"), "id long, tag string")
    docs = spark.range(4000).selectExpr("id", "if(id % 3 = 0, 'x', 'y') AS tag", "concat('the word ', id % 700, if(id % 5 = 0, ' of of', ' no no')) AS text")
    asked = spark.createDataFrame([(1, "the 7 of", "x"), (2, "699 no", "y")], "query_id long, query string, want string")
    plain = retrieval.keyword_index(docs, ("id", "tag"))
    key = lambda rows: sorted((r.query_id, r.id, r.tag, r["rank"], round(r.score, 9)) for r in rows.collect())
    want = key(retrieval.keyword_search(plain, asked, 5, ("want", "tag")))
    for lo in (0, 2000):
        index.append(docs.filter(f"id >= {lo} AND id < {lo + 2000}"))
    for _ in range(2):
        blocks = index.table.read().filter("term = 'the'").selectExpr("count(*) AS blocks", "sum(n) AS postings").first()
        assert blocks.postings == 4000 and blocks.blocks <= 4
        assert key(index.search(asked, 5, ("want", "tag")).hits) == want
        index.compact()
