"""Sharding, chat formatting and URL filters: DataFrame operations against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inkmill.llm import chat, queries, sharding, url_filter

from ..oracle import connect, same


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"\w*(?:Python|Pandas|Arrow)\w*", plan)


# ---------------------------------------------------------------- sharding


def check_shards(rows, docs, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for s, rs in by.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    wanted = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in docs)
    assert sorted((r["size"], r.text_crc32) for r in rows) == wanted
    total, largest = sum(w[0] for w in wanted), max(w[0] for w in wanted)
    for s in range(shards):
        assert abs(sum(r["size"] for r in by[s]) - total / shards) <= 2 * (0.0005 * total / shards) + largest + 1


@pytest.mark.parametrize(
    "docs",
    [
        [(i, "x" * (i % 50)) for i in range(500)],
        [(i, "the same text") for i in range(300)] + [(i, f"other {i}") for i in range(300, 500)],
        [(1, "one row again and again")] * 400,
        [(None, None)] * 50 + [(i, None) for i in range(50)] + [(7, "é" * 3000)],
        [(1, "only")],
    ],
    ids=["many", "copies", "repeated rows", "nulls", "one"],
)
def test_shards(spark, docs):
    df = spark.createDataFrame([(*d, 0, "k") for d in docs], "doc_id long, text string, k1 int, bucket string")
    rows = sharding.shard_by_bytes(df, shards=4, buckets_per_shard=4).collect()
    check_shards(rows, docs, 4)
    again = sharding.shard_by_bytes(df, shards=4, buckets_per_shard=4).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_shards_of_nothing(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sharding_query(spark, sf_dir):
    out = queries.op5_sharding(spark, sf_dir)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_shards(out.collect(), docs, 16)
    assert not python_nodes(out)
    assert out.filter("law <> 'bytes' OR grown_shard IS NOT NULL").count() == 0
    rows = out.collect()
    mean = sum(r["size"] for r in rows) / 16
    carried = [r for r in rows if r["size"] > sharding.CARRIED * mean]
    assert len(carried) <= 256
    # ranges of one order: a text lies in several shards only where one of the 15 splitters cuts its copies
    shards_of = defaultdict(set)
    for r in rows:
        if r["size"] <= sharding.CARRIED * mean:
            shards_of[r.text_crc32, r["size"]].add(r.shard)
    assert sum(len(x) - 1 for x in shards_of.values()) <= 15
    for s in range(16):
        assert abs(sum(r["size"] for r in rows if r.shard == s) - mean) <= sharding.CARRIED * mean


@pytest.mark.parametrize("sf,share", [("0.01", 0.05), ("0.1", 0.01)])
def test_shards_are_ranges_of_one_order(spark, sf_dir, sf, share):
    """Few rows are carried, and copies of a text share a shard but at the splitters."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', sf)}/documents.parquet")
    rows = sharding.shard_by_bytes(docs).select("shard", "size", "text_crc32").collect()
    mean = sum(r["size"] for r in rows) / 16
    carried = [r for r in rows if r["size"] > sharding.CARRIED * mean]
    texts = defaultdict(set)
    for r in rows:
        if r["size"] <= sharding.CARRIED * mean:
            texts[r.text_crc32, r["size"]].add(r.shard)
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(16)]
    print(f"sf{sf}: {len(carried)} of {len(rows)} rows carried, shards {min(sizes) / mean:.4f} to {max(sizes) / mean:.4f} of the mean")
    assert len(carried) < share * len(rows) and sum(len(x) - 1 for x in texts.values()) <= 15


def test_shards_beside_large_documents(spark):
    """A few texts as large as a shard, one of twice its size, and many small ones."""
    docs = [(i, "x" * (30 + i % 40)) for i in range(3000)] + [(5000 + i, "y" * 20_000) for i in range(3)] + [(6000, "z" * 100_000)]
    rows = sharding.shard_by_bytes(spark.createDataFrame(docs, "doc_id long, text string"), shards=5, buckets_per_shard=4).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.shard] += r["size"]
    rest = sorted(sizes.values())
    assert len(rest) == 5 and rest[-1] == 100_001 and rest[3] - rest[0] <= 200


# ---------------------------------------------------------------- chats

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "user", "again <next> </turn>\n"), (1, 2, "assistant", "\\b \\l <turn x>"), (1, 3, "assistant", ""), (1, 4, "user", None),
    (2, 0, None, None), (3, None, "a>b<c\\", "é😀"), (3, 5, "assistant", "x"), (3, 5, "assistant", "x"), (3, 5, "assistant", "w"), (None, 1, "assistant", "n"),
    (4, 0, "assistant", "long " * 20000),
]


def told(turns):
    chats = defaultdict(list)
    for c, t, role, text in turns:
        chats[c].append(((t is not None, t or 0), role or "", text or ""))
    out = {}
    for c, ts in chats.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        every = "".join(f"{r}\n{x}\n" for _, r, x in ts)
        out[c] = (len(ts), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chats_read_back(spark):
    df = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, formatted string, ts int")
    formatted = chat.format_chats(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest_chats(formatted).collect()}
    assert got == told(TURNS)
    one = {r.conv_id: r for r in formatted.collect()}
    assert one[1].formatted == (
        "<turn user>hi<next>again \\lnext> \\l/turn>\n</turn>\n<turn assistant>\\bb \\bl \\lturn x><next></turn>\n<turn user></turn>\n"
    )
    assert [one[1].formatted[s.start : s.start + s.length] for s in one[1].loss_spans] == ["\\bb \\bl \\lturn x>", ""]
    assert not python_nodes(chat.digest_chats(formatted))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_spans_of_a_very_long_conversation(spark):
    """More turns than a chunk of chunks holds; each span is where its text is."""
    turns = [(1, i, "assistant" if i % 3 else "user", f"t{i}<" * (i % 4)) for i in range(4500)]
    row = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).first()
    texts = [t.replace("<", "\\l") for _, _, role, t in turns if role == "assistant"]
    assert [row.formatted[s.start : s.start + s.length] for s in row.loss_spans] == texts


def test_chat_query(spark, sf_dir):
    same(queries.op9_chat_formatting(spark, sf_dir), connect(sf_dir).sql(queries.ORACLE_SQL["op9_chat_formatting"]))


# ---------------------------------------------------------------- URLs

URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x?y=1#z", "http://example.net", "http://example.net/", "http://net/x", "http://xnet/x", "http://a.org/fr/", "http://a.org/fr",
    "http://org/fr/x", "HTTP://B.EXAMPLE.COM/de/1", "http://badexample.com/de/", "ftp://u:p@h.net:80/p?q", "http://É.net/", "x://y://z.net/", "http://a.net?x/en/", "http://www.example.net/EN/", "://net/", "http:///x",
] + [f"http://s{i}.example.{t}/{l}/{i}" for i in range(60) for t in ("net", "com", "org") for l in ("en", "fr", "de")]


def python_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.DOTALL).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_and_verdicts(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*URLS, URLS[3]])], "page_id long, url string, host string")
    out = url_filter.judge(df, queries.URL_RULES)
    rows = out.collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule, verdict = python_rule([*URLS, URLS[3]][r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.block_score >= 0.5 else "allow"))
    assert not python_nodes(out)


def test_trees_learn_from_labels(spark):
    rows = [(i, f"http://h{i}.com/{'a/b/c/d?x=1&y=2&z=3' if i % 2 else 'page'}{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labelled = url_filter.lexical_features(
        df.withColumn("host", url_filter.url_host(F.col("url"))).withColumn("path", url_filter.url_path(F.col("url")))
    ).withColumn("blocked", (F.col("page_id") % 2).cast("double"))
    from inkmill.llm.common import Scratch

    model = url_filter.fit(labelled.filter("page_id < 300"), Scratch(spark, "t"))
    held = model.block_score(labelled.filter("page_id >= 300"))
    assert held.filter((F.col("block_score") >= 0.5) == (F.col("blocked") == 1)).count() == 100


def test_without_labels_urls_are_allowed(spark):
    df = spark.createDataFrame([(1, "http://x.com/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge(df, queries.URL_RULES).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_a_rare_class_is_always_among_the_trees_rows(spark):
    from inkmill.llm.common import Scratch

    often = [(i, "https://www.site.org/fr/same") for i in range(1000)]
    rows = [(i, f"https://www.site{i}.org/fr/a{i}") for i in range(1000, 3000)] + [(i, f"http://x{i}.net/{i}?q=1") for i in range(3000, 3003)]
    rows += [(i, f"https://other{i}.example/{i}") for i in range(4000, 4010)]
    df = spark.createDataFrame(often + rows, "page_id long, url string")
    got = url_filter.judge(df, queries.URL_RULES, max_rows=40).collect()
    assert len(got) == len(often) + len(rows)
    scores = {r.page_id: r.block_score for r in got}
    assert min(scores[i] for i in range(3000, 3003)) > scores[1500] > 0
    hits = url_filter.match_rule(F.col("host"), F.col("path"), queries.URL_RULES)
    parsed = df.select("page_id", "url", url_filter.url_host(F.col("url")).alias("host"), url_filter.url_path(F.col("url")).alias("path"))
    features = url_filter.lexical_features(parsed).withColumn("blocked", (hits["verdict"] == "block").cast("double"))
    rarity = {r.suffix: r.suffix_rarity for r in url_filter.fit(features, Scratch(spark, "t")).suffixes.collect()}
    assert rarity == {"org": 0.0, "net": 3.0, "example": 2.0}


def test_url_query(spark):
    """The registered query on its whole table: rules by plain Python, and verdicts that are no
    matter of the suffix."""
    out = queries.op10_url_filter(spark, "/root/testdata/sf0.01")
    assert not python_nodes(out)
    rows = {r.page_id: r for r in out.collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()
    assert len(rows) == len(pages)
    by_suffix, right, judged = defaultdict(set), 0, 0
    for page in pages:
        r = rows[page.page_id]
        host, path, rule, verdict = python_rule(page.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        method = "block" if r.block_score >= 0.5 else "allow"
        assert r.verdict == (verdict or method)
        by_suffix[host.rsplit(".", 1)[-1]].add(method)
        if verdict and r.held_out:
            judged, right = judged + 1, right + (verdict == method)
    assert any(len(v) == 2 for v in by_suffix.values())
    assert judged and right / judged >= 0.5


def test_urls_with_clashing_columns_and_long_ones(spark):
    names = ["path", "suffix", "blocked", "hit", "block_score", "held_out", "suffix_rarity", "mean_length", "weight"]
    rows = [(1, "http://x.net/" + "a/" * 20000, *names), (None, None, *names), (1, "http://y.org/fr/?q", *names), (2, "no scheme", *names)]
    df = spark.createDataFrame(rows, f"page_id long, url string, {', '.join(n + ' string' for n in names)}")
    got = url_filter.judge(df, queries.URL_RULES).collect()
    assert sorted((r.page_id or 0, r.host, len(r.path), r.verdict) for r in got) == [
        (0, "", 0, "allow"), (1, "x.net", 40001, "block"), (1, "y.org", 4, "allow"), (2, "", 0, "allow")
    ]
