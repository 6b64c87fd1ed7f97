"""Extraction from written pages, from broken ones and from a site with a template."""

from collections import Counter

from cuelight.llm import html_extract as h
from cuelight.llm import queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy</div>
<article><h1>Head &amp; tail</h1><p>One <b>two</b>three<br>four &copy;  five</p><ul><li>x<li>y</ul><div class="share-bar">Share</div>
<p>a &lt; b &#233; &am</p><section class="comments"><p>First!</p></section></article><aside>Side</aside>
<div id="cookieNotice">We use cookies</div><form><p>Mail</p></form><footer>&copy; foot</footer></body></html>"""


def _text(source):
    return h.text_of(h.parse(source)[1])


def test_written_page():
    assert _text(PAGE) == "Head & tail One twothree four © five x y a < b é &am"


def test_broken_pages():
    assert _text(None) == _text("") == _text("<") .replace("<", "") == ""
    assert _text("plain  text\n here") == "plain text here"
    assert _text("<article><p><b>one<br><p>two</p>three &quo") == "one two three &quo"
    assert _text("<article><p>one</p><p>two</p") == "one two"
    assert _text("<article><p>a<b>c</i>d</b></p></article></div><footer>f") == "acd"
    assert _text("<p>x</p><script>if (a<b) '</p>'") == "x"
    assert _text("<article>" + "<div>" * 5000 + "deep") == "deep"
    assert _text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert len(_text("<article><p>" + "word " * 200000)) == 999999


def test_site_template(spark):
    rows = []
    for i in range(20):
        rows.append((i, f"http://a.com/{i}", f"<body><div class='x1'><span>Top stories of the day</span></div><p>Only here {i}</p><div><p>same tail</p></div></body>"))
        rows.append((100 + i, f"http://b.com/{i}", f"<body><div>bar</div><article><p>copied words</p><p>own {i}</p><div>Read also: <a>more</a></div></article></body>"))
    rows += [(None, None, None), (7, "http://c.com", "<p>alone"), (7, "http://c.com", "<p>alone")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = [tuple(r) for r in h.extract_text(df).collect()]
    want = [(i, f"http://a.com/{i}", f"Only here {i}", len(f"Only here {i}")) for i in range(20)]
    want += [(100 + i, f"http://b.com/{i}", f"copied words own {i}", len(f"copied words own {i}")) for i in range(20)]
    want += [(None, None, "", 0), (7, "http://c.com", "alone", 5), (7, "http://c.com", "alone", 5)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert h.extract_text(df.limit(0)).count() == 0


def _texts(spark, rows):
    got = h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r.page_id: r.text for r in got}


def test_copies_without_article(spark):
    story = "<div id='c'><p>A long story that three pages of the site tell.</p><p>It ends here.</p></div>"
    rows = [(i, f"http://d.com/{i}", f"<body>{story}</body>") for i in range(3)]
    rows += [(10 + i, f"http://e.com/{i}", f"<body><span>No. {i}</span>{story}</body>") for i in range(3)]
    rows += [(20 + i, f"http://f.com/{i}", f"<body><h1>Head {i}</h1>{story}</body>") for i in range(3)]
    rows += [(30 + i, f"http://g.com/{i}", f"<body><div>{'copied without any tag ' * 5}</div><p>{i}</p></body>") for i in range(3)]
    rows += [(40 + i, f"http://h.com/{i}", f"<body><p>Words of page {i % 2}, and more</p><div><p>shared by two</p></div></body>") for i in range(6)]
    story = "A long story that three pages of the site tell. It ends here."
    want = {i: story for i in range(3)} | {10 + i: f"No. {i} {story}" for i in range(3)} | {20 + i: f"Head {i} {story}" for i in range(3)}
    want |= {30 + i: f"{'copied without any tag ' * 5}{i}" for i in range(3)}
    want |= {40 + i: f"Words of page {i % 2}, and more shared by two" for i in range(6)}
    assert _texts(spark, rows) == want


def test_template_beside_copies(spark):
    rows = [(i, f"http://k.com/{i}", f"<body><p>Own words of the page {max(0, i - 30)}</p><div><p>Same notice</p></div></body>") for i in range(36)]
    assert _texts(spark, rows) == {i: f"Own words of the page {max(0, i - 30)}" for i in range(36)}


def test_template_inside_article(spark):
    own = "<p>Copied passage.</p><p>Page {0} tells something of its own, in a few words, and then some more words.</p>"
    parts = ("<div class='x9'><p>Notice to readers</p></div>", "<ul><li>One link</li><li>Two links</li></ul>", "<dl><dt>a</dt><dd>b</dd></dl>", "<table><tr><td>c</td></tr></table>")
    rows = [(i, f"http://m.com/{i}", f"<article>{own.format(i)}{parts[i % 4]}</article><div>{i}</div>") for i in range(16)]
    rows += [(100 + i, f"http://n.com/{i}", f"<main>{own.format(i)}{parts[0] if i < h.MANY_PAGES else ''}</main>") for i in range(12 * h.MANY_PAGES)]
    story = "<div><p>A story.</p><ul><li>With a list</li></ul></div>"
    rows += [(2000 + i, f"http://o.com/{i}", f"<article>{story}</article><p>{i}</p>") for i in range(9)]
    text = "Copied passage. Page {0} tells something of its own, in a few words, and then some more words."
    want = {i: text.format(i) for i in range(16)} | {100 + i: text.format(i) for i in range(12 * h.MANY_PAGES)} | {2000 + i: "A story. With a list" for i in range(9)}
    assert _texts(spark, rows) == want


def _articles(folder):
    import html as entities
    import re

    import pyarrow.parquet as pq

    out = {}
    for p in pq.read_table(f"{folder}/pages.parquet").to_pylist():
        body = p["html"].split("<article>", 1)[1].split("</article>")[0]
        out[p["page_id"]] = " ".join(entities.unescape(re.sub(r"<[^>]*>?", " ", body)).split())
    return out


def test_recurrence_alone(spark, monkeypatch):
    """Without any list of names, slots that recur on a host go and the article stays."""
    folder = "/root/testdata/sf0.01"
    pages, want = spark.read.parquet(f"{folder}/pages.parquet"), _articles(folder)
    left = {r.page_id: r.text for r in h.extract_text(pages, lists=False).collect()}
    whole = {r.page_id: h.text_of(h.parse(r.html, False)[1], frozenset(), False) for r in pages.collect()}
    on_host = Counter(r.url.split("/")[2].lower() for r in pages.collect())
    often = [r.page_id for r in pages.collect() if on_host[r.url.split("/")[2].lower()] >= 2 * h.LEAST_PAGES]  # enough pages for evidence
    assert len(often) > 100
    changed, same = sum(left[k] != whole[k] for k in often), sum(left[k] == want[k] for k in often)
    assert changed == len(often) and same > 0.95 * len(often)
    assert all(want[k] in left[k] for k in want)
    monkeypatch.setattr(h, "BROADCAST_TEMPLATES", -1)
    assert {r.page_id: r.text for r in h.extract_text(pages, lists=False).collect()} == left


def test_slots_beside_the_main_one(spark):
    rows = []
    for i in range(8):
        menu = "".join(f"<li><a>w{i}{j}</a></li>" for j in range(i + 1))
        rows.append((i, f"http://a.com/{i}", f"<body><div class='q1 top'><ul>{menu}</ul></div><div class=z{i}><div class=lead><p>Lead {i}</p></div><div class=story><p>Much longer story number {i}, told in many words.</p><div class=box>inside {i}</div></div></div><div class=tail>other {i}</div></body>"))
    want = {i: f"Lead {i} Much longer story number {i}, told in many words. inside {i}" for i in range(8)}
    assert _texts(spark, rows) == want
    assert _texts(spark, rows[:2])[0].startswith("w00 Lead 0")  # two pages are no evidence


def test_many_articles_and_end_tags():
    page = "<article>" * 3000 + "x" + "</b>" * 20000 + "<p>y" * 3000
    assert _text(page).split() == ["x"] + ["y"] * 3000
    assert _text("<article>a</article>" * 20000).split() == ["a"] * 20000


def test_whole_table(spark, sf_dir):
    import html as entities
    import re

    import pyarrow.parquet as pq

    got = {r.page_id: r for r in queries.op7_html(spark, sf_dir).collect()}
    pages = pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()
    assert len(got) == len(pages)
    for p in pages:
        body = p["html"].split("<article>", 1)[1].split("</article>")[0]
        want = " ".join(entities.unescape(re.sub(r"<[^>]*>?", " ", body)).split())
        assert got[p["page_id"]].text == want
        assert got[p["page_id"]].n_chars == len(want)
