"""Downloads that are resumed, and the two fetch jobs down to the data sets made of their files."""

import json
import os
import time

from inkmill.plans import jobs
from inkmill.schemas import ARCHIVE_META, BOOK_META
from inkmill.sources import files
from inkmill.sources.download import Downloads


class Stored:
    """Replies by URL; notes each request."""

    def __init__(self, folder, replies):
        self.folder, self.replies = str(folder), replies

    def __call__(self, url):
        fd = os.open(f"{self.folder}/requests", os.O_CREAT | os.O_APPEND | os.O_WRONLY)
        os.write(fd, f"{url} {time.monotonic()}\n".encode())
        os.close(fd)
        return self.replies[url]

    def requests(self):
        return [(x.split(" ")[0], float(x.split(" ")[1])) for x in open(f"{self.folder}/requests").read().splitlines()]


def test_no_url_is_fetched_twice(spark, tmp_path):
    replies = {f"http://h{i % 3}/{i}": bytes([i, 255, 0]) for i in range(12)}
    stored = Stored(tmp_path, {u: b for u, b in replies.items() if not u.endswith("/7")})
    urls = spark.createDataFrame([(u,) for u in replies] * 2 + [(None,)], "url string")
    got = {r.url: (bytes(r.body) if r.body is not None else None, r.error is None) for r in Downloads(spark, str(tmp_path / "d"), stored, pause=0.05, wave=5).get(urls).collect()}
    assert got == {u: (b, True) for u, b in replies.items() if not u.endswith("/7")} | {"http://h1/7": (None, False)}
    by_host = {}
    for u, t in sorted(stored.requests(), key=lambda x: x[1]):
        by_host.setdefault(u.split("/")[2], []).append(t)
    assert len(stored.requests()) == 12
    stored.replies = replies
    again = Downloads(spark, str(tmp_path / "d"), stored)
    assert {r.url: bytes(r.body) for r in again.get(urls).collect()} == replies
    assert [u for u, _ in stored.requests()[12:]] == ["http://h1/7"]


def test_requests_to_a_host_are_paced(spark, tmp_path):
    stored = Stored(tmp_path, {f"http://one/{i}": "x" for i in range(5)})
    Downloads(spark, str(tmp_path / "d"), stored, pause=0.2).get(spark.createDataFrame([(u,) for u in stored.replies], "url string")).collect()
    times = sorted(t for _, t in stored.requests())
    assert all(b - a >= 0.19 for a, b in zip(times, times[1:], strict=False))


def test_books_to_data_set(spark, tmp_path):
    raw, base = str(tmp_path / "raw"), "http://b/books"
    listed = {"results": [
        {"id": 7, "title": "A Life: of L", "authors": [{"name": "Ketcham, Henry"}], "formats": {"text/plain; charset=utf-8": "http://b/7.txt"}},
        {"id": 8, "title": "Lost", "authors": [], "formats": {"text/plain": "http://b/8.txt"}}, {"id": 9, "title": "Pictures", "authors": [], "formats": {"image/png": "x"}}]}
    stored = Stored(tmp_path, {f"{base}?ids=7,8,9": json.dumps(listed), "http://b/7.txt": "one\ntwö".encode()})
    rows = {r.id: (r.name, r.error is None) for r in jobs.fetch_books(spark, [7, 8, 9], raw, stored, base).collect()}
    assert rows == {7: ("7_A_Life_of_L.txt", True), 8: (None, False), 9: (None, False)}
    assert (tmp_path / "raw/gutenberg/7_A_Life_of_L.txt").read_text() == "one\ntwö"
    assert sorted(os.listdir(tmp_path / "raw/gutenberg"))[0] != "" and len([n for n in os.listdir(tmp_path / "raw/gutenberg") if not n.startswith(".")]) == 2
    meta = files.read_metadata(spark, f"{raw}/gutenberg/_metadata.json", BOOK_META).collect()
    assert [(m.id, m.title, m.authors, m.reference) for m in meta][0] == (7, "A Life: of L", "Ketcham, Henry", f"{base}/7/") and len(meta) == 3
    jobs.build_dataset(spark, raw, str(tmp_path / "p"), archive=False)
    assert [(d.id, d.content) for d in jobs.combine_dataset(spark, str(tmp_path / "p")).collect()] == [("gutenberg_7", "one twö")]


def test_archive_to_data_set(spark, tmp_path):
    raw, h = str(tmp_path / "raw"), "http://a"
    item = {"item": {"title": "Abraham Lincoln to Truman Smith, November", "type": "Letter", "contributor_names": ["L"], "date": "1860"},
            "resources": [{"pdf": f"{h}/x.pdf", "fulltext_file": f"{h}/x.xml"}]}
    picture = {"item": {"title": "Plate", "genre": ["Print"]}, "resources": [{"files": [[{"url": f"{h}/p.JPG", "mimetype": "image/jpeg"}, {"url": f"{h}/q.tif", "mimetype": "image/tiff"}]]}]}
    page = "<html><body><h1>Address</h1><div id='content'><p>Four score</p><p>and seven</p></div></body></html>"
    urls = [f"{h}/item/m1/", f"{h}/resource/m.2/", f"{h}/exhibits/g/trans.html", f"{h}/item/gone/"]
    stored = Stored(tmp_path, {f"{h}/item/m1/?fo=json": json.dumps(item), f"{h}/resource/m.2/?fo=json": json.dumps(picture), urls[2]: page,
                               f"{h}/x.pdf": b"%PDF\xff\x00", f"{h}/x.xml": "<p>My dear &amp; Sir</p>", f"{h}/p.JPG": b"\xff\xd8"})
    for _ in range(2):
        rows = jobs.fetch_archive(spark, urls, raw, stored, pause=0).collect()
        assert [(r.id, r.files, r.document_type, r.url_type) for r in rows] == [
            ("m1", ["m1_Abraham_Lincoln_to_Truman_Smith_November.pdf", "m1_Abraham_Lincoln_to_Truman_Smith_November.txt"], "Letter", "item"),
            ("m_2", ["m_2_Plate.jpg"], "Print", "resource"), ("exhibits_trans", ["exhibits_trans_Address.txt"], "Speech", "exhibits"), ("gone", [], "Document", "item"),
        ]
    counts = [u for u, _ in stored.requests()]
    assert all(counts.count(u) == 1 for u in stored.replies) and counts.count(f"{h}/item/gone/?fo=json") == 2
    folder = tmp_path / "raw/loc"
    assert (folder / rows[0].files[0]).read_bytes() == b"%PDF\xff\x00" and (folder / rows[0].files[1]).read_text() == "My dear & Sir"
    assert (folder / "m_2_Plate.jpg").read_bytes() == b"\xff\xd8"
    assert (folder / "exhibits_trans_Address.txt").read_text() == "Four score\n\nand seven"
    meta = files.read_metadata(spark, f"{raw}/loc/_metadata.json", ARCHIVE_META).collect()
    assert [m.id for m in meta] == [r.id for r in rows] and meta[0].date == "1860" and meta[3].title == "gone"
    jobs.build_dataset(spark, raw, str(tmp_path / "p"), books=False)
    docs = {d.id: (d.document_type, d.content) for d in jobs.combine_dataset(spark, str(tmp_path / "p")).collect()}
    assert set(docs) == {"loc_m1", "loc_exhibits_trans"} and docs["loc_m1"][1] == "My dear & Sir"
