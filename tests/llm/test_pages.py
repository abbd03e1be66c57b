"""HTML wrappers, URL lists and archives."""

import hashlib
import struct

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from check import compare
from streakline.llm import html, urls, warc
from streakline.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>"
    "<header>Top</header><nav><ul><li>a<li>b</ul></nav><div class='cookie-notice'>We use</div><article><h1>Head&nbsp;line</h1>"
    "<p>One <b>two</b>th<i>ree</i>,\n  &lt;four&gt;<br>five<p>Next<!-- no --> <a href='x>y'>link</a></p>"
    "<div class=\"ad\">Buy</div><form>Name <input name=q></form>{more}</article>"
    "<section id='comments'><p>First!</p></section><aside>Side</aside><footer>&copy;</footer></body></html>"
)
TEXT = "Head line\n\nOne twothree, <four> five\n\nNext link"


def test_main_text(spark):
    rows = [(f"http://h.org/{i}", PAGE.replace("{more}", "<p>More</p>" * i)) for i in range(4)]
    rows += [("http://h.org/x", None), (None, ""), ("rel", "plain < text"), ("http://o.org/", "<div><p>Only</p><p>this")]
    got = {r.page_id: r for r in html.extract_articles(pages(spark, rows).withColumns({"host": F.lit(1), "slots": F.lit(2)})).collect()}
    for i in range(4):
        assert got[i].text == TEXT + "\n\nMore" * i and got[i].n_chars == len(got[i].text)
    assert got[4].text == got[5].text == "" and got[6].text == "plain < text" and got[7].text == "Only\n\nthis"
    assert html.extract_articles(pages(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["<", "<a", "<a href='", "</", "<!--", "<script>", "<p><p><p>", "</p></x>", "<b" * 20_000, "<p>x" * 5_000, "<div>" * 3_000 + "deep"])
def test_broken_markup_ends(text):
    tree = html.page_tree(text) if "<div>" not in text else None
    assert tree is None or html.as_expression(tree) is not None
    assert isinstance(html.main_text(text, {()}), str)


def test_pages_of_any_depth(spark):
    deep = ["<div>" * 3_000 + "deep", "<b>" * 4_000 + "<p>x</p><p>y", "<font>z" * 1_500]
    rows = [(f"http://h.org/{i}", h) for i, h in enumerate([*deep, "<p>flat</p>"])]
    got = {r.page_id: r.text for r in html.extract_articles(pages(spark, rows)).collect()}
    assert got == {0: "deep", 1: "x\n\ny", 2: "z" * 1_500, 3: "flat"}
    tree = html.page_tree("<div>" * 50_000 + "x")
    assert html.unpacked(html.json.loads(html.packed(tree))) is not None
    assert html.as_expression(html.align(tree, tree)) == "<div>" * 50_000 + "#" + "</>" * 50_000


def test_alignment_makes_optional_and_repeated_groups():
    one = html.page_tree("<ul><li>a</li></ul><p>x</p>")
    two = html.page_tree("<ul><li>a</li><li>b</li><li>c</li></ul><h2>n</h2><p>y</p>")
    both = html.align(one, two)
    assert html.as_expression(both) == "<ul>(<li>#</>)+</>(<h2>#</>)?<p>#</>"
    assert html.as_expression(html.align(two, one)) == html.as_expression(both)
    pairs = html.page_tree("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd><dt>e</dt><dd>f</dd></dl>")
    assert html.as_expression(pairs) == "<dl>(<dt>#</>)+(<dd>#</>)+</>"


def test_a_wrapper_covers_every_slot_of_its_pages(spark):
    rows = spark.read.parquet(f"{SF_DIR}/pages.parquet").select(urls.url_host(F.col("url")).alias("host"), "html")
    found = {r.host: r.wrapper for r in html.infer_wrappers(rows).collect()}
    for r in rows.collect():
        slots = set(html.slot_paths(html.json.loads(found[r.host])))
        assert set(html.slot_paths(html.page_tree(r.html))) <= slots


def test_trees_of_a_host_are_merged_in_rounds(spark, monkeypatch):
    own = html._merged

    def bounded(trees):
        assert len(trees) <= 12
        return own(trees)

    monkeypatch.setattr(html, "_merged", bounded)
    monkeypatch.setattr(html, "TREES", 3)
    rows = [("a", "".join(f"<{n}>x</{n}>" for k, n in enumerate(("h1", "h2", "h3", "h4", "h5", "h6")) if i >> k & 1)) for i in range(1, 64)]
    df = spark.createDataFrame([*rows, ("b", "<p>x")], "host string, html string")
    found = {r.host: html.json.loads(r.wrapper) for r in html.infer_wrappers(df).collect()}
    assert set(found) == {"a", "b"} and set(html.slot_paths(found["a"])) == {(f"h{k}",) for k in range(1, 7)}
    assert html.infer_wrappers(df.limit(0)).count() == 0


def test_each_page_has_its_best_region(spark):
    rows = [
        ("http://h.org/1", "<nav>n</nav><article><p>One</p></article>"),
        ("http://h.org/2", "<nav>n</nav><main><p>Two <i>a</i> <i>b</i></p></main><div>x</div>"),
        ("http://h.org/3", "<div class=content><p>Three</p><aside>no</aside></div><div>x</div>"),
        ("http://h.org/4", "<div><p>Four</p></div><footer>no</footer>"),
        (None, "<article>Five</article>"),
        ("six", "<div>Six</div>"),
        ("http://h.org/7", "<article> <nav>n</nav></article><main>Seven</main>"),
    ]
    got = {r.page_id: r.text for r in html.extract_articles(pages(spark, rows)).collect()}
    assert got == {0: "One", 1: "Two a b", 2: "Three", 3: "Four", 4: "Five", 5: "Six", 6: "Seven"}


def test_texts_of_the_wrapper_are_left_out(spark):
    box = "<div class=x1><p>Follow <b>us</b></p></div>"
    rows = [("http://h.org/" + str(i), f"<nav>n</nav><article><h1>Head {i}</h1>{box}<p>Text {i}.</p><p>Same in half {i % 2}</p></article>") for i in range(12)]
    rows += [("http://h.org/main", "<main><p>Other layout</p></main>"), ("http://h.org/0", rows[0][1])]
    rows += [("http://few.org/" + str(i), f"<article><h1>Head {i}</h1>{box}</article>") for i in range(html.ALIKE - 1)]
    rows += [("http://same.org/" + str(i), f"<nav>{i}</nav><article><p>All of it</p></article>") for i in range(20)]
    got = {r.page_id: r.text for r in html.extract_articles(pages(spark, rows)).collect()}
    for i in range(12):
        assert got[i] == f"Head {i}\n\nText {i}.\n\nSame in half {i % 2}"
    assert got[12] == "Other layout" and got[13] == got[0]
    assert all(got[14 + i] == f"Head {i}\n\nFollow us" for i in range(html.ALIKE - 1))
    assert all(got[i] == "All of it" for i in range(14 + html.ALIKE - 1, len(rows)))


def test_articles_of_the_sample(spark):
    import re
    from html import unescape

    rows = {r.page_id: r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in QUERIES["op6_html_wrapper"](spark, SF_DIR).collect():
        inner = re.search(r"<article>(.*?)</article>", rows[r.page_id], re.S).group(1)
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_url_list_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF_DIR}/pages.parquet'")
    good, text = compare(spark, con, SF_DIR, "op9_url_list", QUERIES["op9_url_list"], ORACLE["op9_url_list"])
    assert good, text


def test_intervals_and_keys(spark):
    entries = spark.createDataFrame(
        [("B.org", "x", "add", "2024-01-01"), ("b.org", "y", "add", "2024-02-01"), ("b.org", "y", "remove", "2024-03-01"), ("b.org/p", "z", "add", "2024-02-10"), ("b.org/p", "z", "remove", "2024-02-10"), ("", "n", "add", "2024-01-01"), (None, "n", "add", "2024-01-01"), ("c.org", None, "add", None), ("c.org", None, "odd", "2024-01-01")],
        "pattern string, reason string, action string, listed_on string",
    ).withColumn("listed_on", F.col("listed_on").cast("date"))
    captures = spark.createDataFrame(
        [(1, "http://b.org/p/q", "2024-01-31"), (2, "https://u:p@X.B.org:80/?q", "2024-02-29"), (3, "http://b.org/", "2024-03-01"), (4, "http://b.org", "2023-12-31"), (5, None, "2024-01-05"), (6, "b.org/p", "2024-01-05"), (7, "http://b.org", None), (8, "http://bb.org", "2024-01-05"), (1, "http://b.org/p/q", "2024-01-31")],
        "page_id long, url string, fetched_on string",
    ).withColumn("fetched_on", F.col("fetched_on").cast("date"))
    got = urls.blocked_captures(captures.withColumns({"hit": F.lit(1), "pattern": F.lit(2), "n_active": F.lit(3)}), entries).collect()
    blocked = sorted((r.page_id, r.blocked_by, r.blocked_reason, r.n_active) for r in got if r.blocked_by)
    assert len(got) == 9 and blocked == [(1, "b.org", "x", 1), (1, "b.org", "x", 1), (2, "b.org", "y", 1)]
    assert urls.blocked_captures(captures, entries.limit(0)).where("n_active > 0").count() == 0
    assert urls.blocked_captures(captures.limit(0), entries).count() == 0


def listed(spark, patterns, captured):
    """{page_id: (blocked_by, n_active)} of captures under a list of patterns that are always active."""
    day = F.lit("2024-01-01").cast("date")
    entries = spark.createDataFrame([(p,) for p in patterns], "pattern string").select(
        "pattern", F.lit("r").alias("reason"), F.lit("add").alias("action"), day.alias("listed_on")
    )
    captures = spark.createDataFrame(list(enumerate(captured)), "page_id long, url string").withColumn("fetched_on", day)
    return {r.page_id: (r.blocked_by, r.n_active) for r in urls.blocked_captures(captures, entries).collect()}


def test_deep_patterns_and_top_domains(spark):
    deep = "h.org/" + "/".join("abcdefghij")
    domain = ".".join("abcdefghijkl")
    got = listed(spark, [deep, "h.org/a/b/c/d/e", domain, "net"], [f"http://{deep}/k?x", "http://h.org/a/b/c/d/ee", f"http://z.y.{domain}/", "http://a.net", "http://net.org/net"])
    assert got == {0: (deep, 2), 1: (None, 0), 2: (domain, 1), 3: ("net", 1), 4: (None, 0)}


def test_upper_case_paths(spark):
    got = listed(spark, ["H.org/News", "h.org/Old/b", "UP.org"], ["http://h.ORG/News/1", "http://h.org/news/1", "http://h.org/Old/b", "http://up.org/X"])
    assert got == {0: ("h.org/News", 1), 1: (None, 0), 2: ("h.org/Old/b", 1), 3: ("up.org", 1)}


def test_archives_round_trip(spark):
    body = "<p>" + "x" * 200 + "</p>"
    rows = [("http://a.org/ b\r\n%41é", body), ("u", body), (None, None), ("v", ""), ("w", "short"), ("w", "short"), ("z", "é" * 300_000)]
    table = pages(spark, rows).unionByName(spark.createDataFrame([(None, "n", body), (0, "a", body)], "page_id long, url string, html string"))
    read = warc.read_archives(warc.write_archives(table.withColumn("digest", F.lit(1)))).collect()
    assert len(read) == 9 and all(r.problem is None for r in read)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.url) for r in read), key=str)
    assert (0, "response", None, "http://a.org/ b\r\n%41é") in got and (0, "response", None, "a") in got
    assert (1, "revisit", 0, "u") in got and (None, "revisit", 0, "n") in got and (2, "response", None, None) in got
    for r in read:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
        else:
            assert r.payload is None and r.payload_bytes == len(body)
    assert warc.archived_pages(pages(spark, [])).count() == 0


def test_archives_roll_over_and_have_dictionaries(monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3_000)
    records = [warc.record_bytes(i, f"http://a/{i}", f"<html><body><p>page number {i * 7919} of the same kind</p></body></html>".encode() * 3, "d", None) for i in range(600)]
    made = list(warc.archives_of(records))
    assert len(made) > 1 and [r for a in made for r in warc.frames(a)] == records
    assert struct.unpack_from("<I", made[0])[0] == warc.DICTIONARY_FRAME


def test_broken_archives_are_reported(spark):
    good = warc.record_bytes(1, "u", b"x" * 50, hashlib.sha256(b"x" * 50).hexdigest(), None)
    squeeze = zstandard.ZstdCompressor().compress
    raw = zstandard.ZstdCompressionDict(b"some raw dictionary content " * 20, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    skip = struct.pack("<II", warc.DICTIONARY_FRAME, len(raw.as_bytes())) + raw.as_bytes()
    cases = {
        "whole": squeeze(good) + struct.pack("<II", 0x184D2A50, 3) + b"abc" + squeeze(good),
        "raw": skip + zstandard.ZstdCompressor(dict_data=raw).compress(good),
        "cut": squeeze(good)[:-5],
        "length": squeeze(good.replace(b"Content-Length: ", b"Content-Length: 1")),
        "digest": squeeze(good.replace(b"xxxx\r\n\r\n", b"xxxy\r\n\r\n")),
        "header": squeeze(good.replace(b"WARC-Date", b"WARC-Dote")),
        "version": squeeze(b"HTTP" + good),
        "noise": b"\x00\x01\x02\x03\x04\x05",
        "empty": b"",
        "none": None,
    }
    df = spark.createDataFrame(list(cases.items()), "archive string, content binary")
    got = {}
    for r in warc.read_archives(df).collect():
        got.setdefault(r.archive, []).append(r.problem)
    assert got["whole"] == [None, None] and got["raw"] == [None] and "empty" not in got and "none" not in got
    assert all(len(got[k]) == 1 and got[k][0] for k in ("cut", "length", "digest", "header", "version", "noise"))
