"""Main text: pages of the given tables, new layouts, and odd markup."""

import html as html_lib
import random
import re

import numpy as np
import pytest

from inkmill.llm import main_text, queries
from inkmill.llm.common import Scratch
from inkmill.llm.main_text import Page, features, labels

HTML = [
    "<p>a<p>b <b>c<br>d</b></p> tail",
    "<ul><li>x<li>y <a href='>'>z</a></ul><table><tr><td>1<td>2<tr><td>3</table>",
    "<script>var t='</p><p>no</p>';</script><style>p{}</style><p>&lt;b&gt; &amp;&nbsp;&eacute;</p><!-- <p>no</p> --><textarea><p>no</p></textarea>",
    "<p>1 < 2 and a<b</p><p class=unquoted id=\"x>y\">q</p></div></p><!DOCTYPE html><![CDATA[x]]><p>end",
    "text only", "", "<p", "<!-- open", "<script>open", "<a href='open>x</a>", "</p></b>x", "<head><title>T</title><body>shown",
]
WANT = [
    ["a", "b c d", "tail"], ["x", "y z", "1", "2", "3"], ["<b> & é"], ["1 < 2 and a", "q", "end"], ["text only"], [], [], [], [], ["x"], ["x"], ["shown"],
]


@pytest.mark.parametrize("i", range(len(HTML)))
def test_blocks_of_markup(i):
    got = [t for _, t in Page(HTML[i]).blocks]
    assert got == WANT[i]
    assert features(Page(HTML[i])).shape == (len(Page(HTML[i]).tag), len(main_text.FEATURES)) and np.isfinite(features(Page(HTML[i]))).all()


def article(html):
    """Texts of the article of a page of the given tables, by its markup alone."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    return "\n\n".join(t for t in (" ".join(html_lib.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts) if t)


def test_query_gives_the_articles(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.QUERIES["op12_main_text"](spark, sf_dir).collect()
    assert rows[0].__fields__ == ["page_id", "url", "text", "n_chars"] and len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return main_text.fit(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark, "test"))


def test_layouts_not_learned_from(spark, sf_dir, model):
    """Texts by their length, over new layouts of pages that the trees did not see."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet").collect()]
    right = total = whole = 0
    for i, h in enumerate(pages):
        p = Page(h)
        texts = [t for n, t in p.blocks if labels(p)[n] == 1]
        q = Page(main_text.layout(texts[0][:200], texts[1:60] or texts, random.Random(-1 - i)))
        y, state = labels(q), main_text.decode(q, model.log_odds(features(q)))
        wrong = sum(len(t) for n, t in q.blocks if (y[n] == 1) != (state[n] == main_text._IN))
        size = sum(len(t) for _, t in q.blocks)
        right, total, whole = right + size - wrong, total + size, whole + (wrong == 0)
    print(f"characters {right / total:.4f}, pages {whole / len(pages):.3f}")
    assert right / total > 0.98 and whole / len(pages) > 0.75


PROSE = "The harbour was quiet in the morning, and the boats that had come in at night lay side by side. Nobody spoke of the storm."


@pytest.mark.parametrize("wrap", ['<article>{}</article>', '<main><div class="row">{}</div></main>', '<div id="main-content">{}</div>', '<div class="post">{}</div>'])
def test_what_stands_around_an_article(model, wrap):
    text = "".join(f"<p>{PROSE} {i}</p>" for i in range(5))
    page = (
        '<html><head><title>x</title></head><body><div class="cookie-notice"><p>We use cookies to make this site better for you.</p><button>OK</button></div>'
        '<header><a href="/">Site name</a></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
        + wrap.format(f"<h1>Quiet harbour</h1>{text}")
        + '<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/1">One story</a></li><li><a href="/2">Another</a></li></ul></aside>'
        '<div class="ad">Buy two boats and pay for one.</div>'
        '<section id="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I was there, and it was not quiet at all, if I may say so.</p></div></section>'
        '<form class="newsletter"><label>Your mail</label><input name="m"><button>Go</button></form><footer><p>&copy; 2020 Site</p></footer></body></html>'
    )
    p = Page(page)
    got = main_text.main_text(p, model.log_odds(features(p)))
    assert got == "\n\n".join(["Quiet harbour"] + [f"{PROSE} {i}" for i in range(5)])


def test_nothing_is_in_below_what_is_out():
    rng = np.random.default_rng(3)
    for seed in range(60):
        p = Page(main_text.layout("A title", [PROSE] * 5, random.Random(seed)))
        odds = rng.normal(0, 3, len(p.tag))
        state = main_text.decode(p, odds)
        for i in range(1, len(state)):
            up = state[p.parent[i]]
            assert state[i] <= up if up == main_text._OUT else up != main_text._IN or state[i] != main_text._MIXED


def test_trees_score_as_the_model_they_come_from(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    df = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y, strict=True)], "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=6, maxDepth=3, seed=1).fit(df)
    want = [r.rawPrediction[1] for r in model.transform(df).collect()]
    got = main_text.Trees(model).log_odds(np.array([r.features.toArray() for r in df.collect()])) / 2
    assert np.allclose(got, want)


def test_odd_rows(spark, tmp_path):
    body = "<article><h1>T</h1>" + "".join(f"<p>{PROSE} {i}</p>" for i in range(30)) + "</article><footer>&copy; us</footer>"
    long = "<article>" + f"<p>{PROSE}</p>" * 20000 + "</article>"
    deep = "<div>" * 30000 + body
    rows = [(1, "u", None), (1, "u", ""), (None, None, body), (None, None, body), (2, "v", long), (3, "w", deep), (4, "x", "<p" * 50000), (5, "y", "<a href='" * 20000), (6, "z", "<nav><a href='#'>a</a></nav>")]
    spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op12_main_text"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = "\n\n".join(["T"] + [f"{PROSE} {i}" for i in range(30)])
    assert [r.text for r in got if r.page_id is None] == [want, want]
    assert {r.page_id: r.n_chars for r in got if r.page_id in (1, 4, 6)} == {1: 0, 4: 0, 6: 0}
    assert [r.text.count(PROSE) for r in got if r.page_id == 2] == [20000]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert main_text.pages_text(empty).count() == 0
