import pytest
from pyspark.sql import functions as F

from inkmill.functions import header, html, links, names, payload, prompts, text, tokens, vectors


def one(spark, value, f, ddl="string"):
    return spark.createDataFrame([(value,)], f"x {ddl}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("a â€œquotedâ€ word", 'a "quoted" word'),
        ("donâ€™t", 'don"™t'),
        ("cafÃ© dÃ©jÃ  vu Ã", "café déjà vu í"),
        ("war—and peace", "war and peace"),
        ("Yes - no", "Yes no"),
        ("a -quoted- word", "a quoted word"),
        ("said -Hello there", "said Hello there"),
        ("re-elect", "re elect"),
        ("ninety-Nine", "ninety Nine"),
        ("(-x-)", "(x)"),
        ("line\r\nbreak\rand\nmore", "line break and more"),
        ('back\\"slash\\', 'back"slash'),
        ("two   spaces", "two spaces"),
        ('end " ', "end "),
        ("‘curly’ stays", "‘curly’ stays"),
        ("", ""),
        (None, None),
    ],
)
def test_fix_encoding(spark, raw, clean):
    assert one(spark, raw, text.fix_encoding) == clean


def test_strict_profile_straightens_quotes(spark):
    assert one(spark, "“donâ€™t” …", lambda c: text.fix_encoding(c, strict=True)) == '"don\'t" …'


def test_white_space(spark):
    assert sorted(text.WHITESPACE) == [chr(i) for i in range(0x110000) if chr(i).isspace()]
    assert one(spark, "　 a\n\t b ", text.normalize_field) == "a b"
    assert one(spark, None, text.normalize_field) is None


@pytest.mark.parametrize(
    "raw, name",
    [
        ("Browne, Francis F. (Francis Fisher)", "Francis F. Browne"),
        ("Morse, John T., Jr. (John Torrey)", "John T. Morse Jr."),
        ("Hay, John, Nicolay, John G. (John George)", "John Hay, John G. Nicolay"),
        ("Ketcham, Henry", "Henry Ketcham"),
        ("Charnwood, Godfrey Rathbone Benson, Baron", "Baron Godfrey Rathbone Benson Charnwood"),
        ("Lincoln, Abraham, 1809-1865", "Abraham Lincoln"),
        ("Abraham\nLincoln", "Abraham Lincoln"),
        ("Smith, Jr.", "Smith"),
        ("A, b c, D, E", "b c, D, E A"),
        ("", ""),
        (None, None),
    ],
)
def test_names(spark, raw, name):
    assert one(spark, raw, names.normalize_name) == name


@pytest.mark.parametrize(
    "url, kind, key",
    [
        ("https://www.loc.gov/item/mal0440500/", "item", "mal0440500"),
        ("https://www.loc.gov/resource/mal.0882800/?sp=1", "resource", "mal_0882800"),
        ("https://www.loc.gov/exhibits/gettysburg-address/ext/trans-nicolay-copy.html", "exhibits", "exhibits_trans-nicolay-copy"),
        ("https://example.org/x", "unknown", "unknown"),
    ],
)
def test_links(spark, url, kind, key):
    assert one(spark, url, links.url_type) == kind
    assert one(spark, url, links.archive_id) == key


def test_slugs_and_file_names(spark):
    assert one(spark, "Ford's Theatre  Assassination", links.event_slug) == "fords_theatre_assassination"
    assert one(spark, " Life of A. Lincoln: 1! ", lambda c: links.safe_filename(c, 10)) == "Life_of_A_"
    assert one(spark, "x" * 31, links.shown) == "x" * 30 + "..."
    assert one(spark, "http://a/b.JPG", links.image_extension) == ".jpg"


def test_tokens(spark):
    assert one(spark, "Café foo_bar Fort-Sumter's 1861", tokens.tokenize) == ["fort", "sumter", "s", "1861"]
    assert one(spark, "abcdefg", tokens.estimate_tokens) == 1


def test_header(spark):
    raw = "General Correspondence. 1833-1916: Elihu Hall to Abraham\n Lincoln, Saturday, March 18, 1865 Abraham Lincoln Papers\nWheeling W. Va. March 18\nbody"
    h = one(spark, raw, header.parse_header)
    assert (h["title"], h["date"]) == ("Elihu Hall to Abraham Lincoln, Saturday, March 18, 1865", "March 18, 1865")
    assert (h["from"], h["place"], h["document_type"]) == ("Elihu Hall", "Wheeling, W. Va.", "Letter")
    speech = one(spark, "My fellow citizens, of all places", header.parse_header)
    assert (speech["document_type"], speech["from"], speech["to"]) == ("Speech", "Abraham Lincoln", None)
    assert one(spark, "Annual Report of 1861\n\nx", header.parse_header)["document_type"] == "Report"
    signed = one(spark, "To the President & all\nwords\nYours truly\nA. Hall\n", header.parse_header)
    assert (signed["from"], signed["to"]) == ("A. Hall", "Abraham Lincoln")
    assert one(spark, "x", header.parse_header)["document_type"] == "Document"
    assert one(spark, "On Boston, March 4, 1865", header.parse_header)["place"] == "Boston"
    assert one(spark, "Lincoln Ill. March 4", header.parse_header)["place"] is None


def test_payload(spark):
    raw = """{"item":{"title":"Letter from Abraham Lincoln to A. Smith, May 1","type":["x","y"],"date":["1860"],"contributor_names":["C"],"location":"here"},
    "resources":[{"files":[[{"url":"a.jpg"},{"url":"b.PDF","mimetype":"image/x"}]],"fulltext_file":"t.xml"}],"resource":{"image":"i.gif"}}"""
    get = lambda f, r=raw: one(spark, r, lambda c: f(payload.parse(c)))
    assert get(payload.document_type) == "x"
    assert get(payload.metadata).asDict() == {"title": "Letter from Abraham Lincoln to A. Smith, May 1", "date": "1860", "from": "Abraham Lincoln", "to": "A. Smith", "place": "here"}
    assert get(payload.pdf_url) == "b.PDF"
    assert get(payload.image_urls) == ["a.jpg", "b.PDF", "i.gif"]
    assert get(payload.fulltext_url) == "t.xml"
    assert get(payload.document_type, '{"item":{"title":"Inaugural words"}}') == "Speech"
    assert get(payload.document_type, "no json") == "Document"
    assert get(payload.metadata, '{"item":{"contributor_names":["C"]}}')["from"] == "C"
    formats = [{"type": "text/plain", "url": "a"}, {"type": "text/plain; charset=utf-8", "url": "b"}]
    assert one(spark, formats, payload.book_text_url, "array<struct<type:string,url:string>>") == "b"


def test_html(spark):
    page = "<title>T</title><body><h1> A &amp; <b>b</b></h1><p>out</p><div class='x content'><p>one <i>two</i></p><p> </p><pre>x</pre></div><article><p>no</p></article></body>"
    p = one(spark, page, html.page_text)
    assert (p["title"], p["content"]) == ("A &b", "onetwo\n\nx")
    assert one(spark, None, html.page_text)["title"] is None
    assert one(spark, "<a>x</a>&lt;y&gt;\n z", html.xml_text) == "x <y> z"


def test_prompts(spark):
    assert one(spark, "{y}", lambda c: prompts.render("a {x} {{k}} {n}", x=c, n=F.lit(None))) == "a {y} {k} None"
    assert one(spark, ["p", None, "q"], prompts.bullets, "array<string>") == "- p\n- q"
    assert one(spark, ["abc", "d"], lambda c: prompts.passages(c, 2), "array<string>") == "[Passage 1]:\nab\n\n[Passage 2]:\nd"
    assert one(spark, 'take ["a","b"] or ["c"]', prompts.reply_array) == ["a", "b"]
    assert one(spark, "none", prompts.reply_array) is None


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], vectors.normalize, "array<double>") == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], vectors.normalize, "array<double>") == [0.0, 0.0]
