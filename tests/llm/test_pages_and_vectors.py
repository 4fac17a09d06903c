import hashlib

import numpy as np
import pytest

from linkweave.llm import html, vafile, warc
from linkweave.session import ship_code


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    ship_code(spark)
    body = "<p>" + "word " * 40
    rows = [(k, f"http://x/{k}", f"{body}{k % 7}") for k in range(30)]
    rows += [(90, "u\r\nEvil: 1", "short"), (91, None, "short"), (92, "", None), (93, "x", "é" * 60)]
    rows += [(None, "n", body + "3"), (None, "n", body + "never"), (5, "again", body + "5")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and h in first and first[h] != i
        want.append(
            (i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None)
        )
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(map(str, found)) == sorted(map(str, want))
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest
    assert warc.round_trip(pages.where("false")).count() == 0


def test_archive_starts_with_its_dictionary():
    records = [warc.record(k, "u", b"payload %d" % k * 30, "00", None, "d") for k in range(50)]
    data = warc.archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    assert len(warc.records(data)) == 50


def _brute_top(good, k=20):
    """Every row but the query's own, by whole numbers; scores beyond 64 bits cut to them."""
    want = []
    for at, (q, a) in enumerate(good):
        if q % 20:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a, b, strict=True)), i)
            for n, (i, b) in enumerate(good) if n != at and len(a) == len(b)
        )
        want += [(q, r + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, i) in enumerate(scored[:k])]
    return want


def test_large_components_and_repeated_ids(spark, monkeypatch):
    ship_code(spark)
    monkeypatch.setattr(vafile, "TILE", 20)
    rng = np.random.default_rng(4)
    v = [(k, [float(x) for x in rng.normal(size=2)]) for k in range(60)]
    v += [(100, [5e6, 0.0]), (120, [0.0, 1.0]), (101, [2.0**53 + 2, -1.0]), (140, [-1e300, 3.0]), (141, [1e300, 1.0])]
    v += [(142, [1e301, -1.0]), (143, [1.7e308, 0.5]), (160, [1e10, -1e10]), (144, [-1e302, 0.0])]
    v += [(20, [1.0, 1.0]), (20, [-1.0, 0.5]), (20, [-1.0, 0.5]), (7, [5e6, 0.0]), (7, [5e6, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vafile.top_k(df).collect()]
    good = [(i, vafile.whole(e, 64)) for i, e in v]
    assert sorted(got) == sorted(_brute_top(good))
    assert {(20, 1, 143, 2**63 - 1), (20, 2, 142, 2**63 - 1)} <= set(got)  # ranked by the exact score, not by the cut one


def test_order_of_scores_beyond_64_bits():
    scores = [-(10**40), -(10**39) - 1, -(10**39), -(1 << 63) - 1]
    up = [1 << 63, 10**30, 10**30 + 1, 10**300]
    assert [vafile.beyond(s) for s in (5, -(1 << 63), (1 << 63) - 1)] == [None] * 3
    for part in (scores, up):
        keys = [vafile.beyond(s) for s in part]
        assert keys == sorted(keys)


@pytest.mark.parametrize("tile,rows", [(16_384, 256), (40, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, tile, rows):
    ship_code(spark)
    rng = np.random.default_rng(3)
    v = [(int(k), [float(x) for x in rng.normal(size=6).round(1)]) for k in range(150)]
    v += [(200 + k, v[20][1]) for k in range(30)]  # ties
    v += [(20, v[20][1]), (400, None), (401, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6)]
    v += [(403, [float("inf")] * 6), (None, [1.0] * 6), (440, [1.0, 2.0]), (441, [0.5, 1.0]), (460, [])]
    df = spark.createDataFrame([(*r, 1, 2) for r in v], "vec_id long, embedding array<float>, tile int, score int")
    monkeypatch.setattr(vafile, "TILE", tile)
    monkeypatch.setattr(vafile, "ROWS", rows)
    got = [tuple(r) for r in vafile.top_k(df).collect()]
    good = [
        (i, [vafile.whole([np.float32(x)], 64)[0] for x in e])
        for i, e in v
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)
    ]
    assert sorted(got) == sorted(_brute_top(good))
    assert vafile.top_k(df.where("false")).count() == 0


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
    <body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></ul></nav><div class="ad">Buy</div>
    <article><h1>Title</h1><p>First, with a <b>bold</b> word &amp; more&nbsp;text.<br><p>Second
      line.<div class="reader-comments"><p>Nice one, really, I say!</p></div><p>Short.</article>
    <aside>Side</aside><form><p>Mail</p></form><footer>&copy; F</footer>"""
    assert html.main_text(page) == "Title First, with a bold word & more text. Second line. Short."
    assert html.main_text(None) == "" and html.main_text("  ") == "" and html.main_text("<script>x</script>") == ""
    assert html.main_text("<p>a<p>b 1 < 2 <b>bo</b>ld<br>x") == "a b 1 < 2 bold x"
    assert html.main_text("plain &lt;text") == "plain <text"
    loose = (
        '<div id="menu"><a href=#>x</a></div><div class="content"><h2>Head</h2><p>'
        + "One, two, three and some more words. " * 5
        + '</p><p>Next part.</p></div><div class="sidebar"><p>Beside, it, all</p></div><p'
    )
    text = html.main_text(loose)
    assert text.startswith("Head One, two") and text.endswith("Next part.") and "Beside" not in text
    deep = "<div>" * 20_000 + "<p>down, here</p>"
    assert html.main_text(deep) == "down, here"


def test_main_text_is_whole():
    said = "One, two, three and some more words of the {} part, which goes on. "
    part = lambda name, n=3: f"<p>{(said * n).format(*[name] * n)}</p>"
    flat = lambda *names: " ".join((said * 3).format(*[x] * 3).strip() for x in names)
    menu = '<div class="menu"><a href=#>x</a></div><div><a href=#>More of this</a> <a href=#>and that</a></div>'
    # nested wrappers without an article, equal parts
    rows = "".join(f'<div class="row"><div class="col">{part(x)}</div></div>' for x in "abc")
    assert html.main_text(f'{menu}<div class="content">{rows}</div>') == flat(*"abc")
    bare = "".join(f"<div><div>{part(x)}</div></div>" for x in "abc")
    assert html.main_text(f"{menu}<div>{bare}</div>") == flat(*"abc")
    # a short last row of the same kind
    end = '<div class="row"><div class="col"><p>The end.</p></div></div>'
    assert html.main_text(f'{menu}<div class="content">{rows}{end}</div>') == flat(*"abc") + " The end."
    # bare text and inline elements beside the best container, links by themselves not
    beside = f'<div>Lead <b>in</b> <a href=#>w</a>.<div>{part("a")}{part("b")}</div>A <em>last</em> word.<hr><a href=#>next</a></div>'
    assert html.main_text(menu + beside) == f"Lead in w. {flat('a', 'b')} A last word."
    # articles: two, one beside a longer text without the tag, one that is a small teaser
    two = f"<article>{part('a')}{part('b')}</article><article>{part('c')}</article>"
    assert html.main_text(f"<main>{menu}{two}</main>") == flat(*"abc")
    assert html.main_text(f"<article>{part('a')}</article><article><p>Short end.</p></article>") == flat("a") + " Short end."
    long = "".join(part(x) for x in "abcdefgh")
    teaser = "<article><a href=#>Another story to read</a></article>"
    assert html.main_text(f"<div><div>{long}</div>{teaser}</div>") == flat(*"abcdefgh")
    assert html.main_text(f"<div><article>{part('a')}</article><div>{part('b')}</div></div>") == flat("a", "b")


PROSE = "Two long sentences, with commas, and with words enough to be prose of their own, you see. " * 3


@pytest.mark.parametrize("name", ["has-sidebar", "content no-sidebar", "long-form", "entry-content with-comments",
                                  "article-comments-open", "post-share-wrapper", "widget", "search", "ad-free"])
def test_layout_names_take_no_article_out(name):
    said = " ".join((PROSE * 2).split())
    for attribute in ("class", "id"):
        page = f'<div {attribute}="{name}"><p>{PROSE}</p><p>{PROSE}</p></div>'
        assert html.main_text(page) == said
        assert html.main_text(f'<ul class="menu"><li><a href=#>x</a></ul>{page}') == said


def test_furniture_goes_by_name():
    said = " ".join(PROSE.split())
    article = f"<article><h1>Head</h1><p>{PROSE}</p></article>"
    for name in ("sidebar", "sidebar-left", "cookie-notice", "newsletter", "reader-comments", "comment-list", "ad-slot"):
        beside = f'<div class="{name}"><h3>Other</h3><p>{PROSE * 4}</p></div>'
        assert html.main_text(article + beside) == "Head " + said, name
        assert html.main_text(article.replace("</article>", beside + "</article>")) == "Head " + said, name
    for name in ("discussion", "search"):
        part = f'<section id="{name}"><h2>Part</h2><p>{PROSE}</p></section>'
        assert html.main_text(article.replace("</article>", part + "</article>")) == f"Head {said} Part {said}"
    links = '<div class="post-share-wrapper"><a href=#>One network</a> <a href=#>Another</a></div>'
    assert html.main_text(article.replace("</article>", links + "</article>")) == "Head " + said
    assert html.main_text(f'<div class="comments"><p>{PROSE}</p></div>') == ""


def test_attributes_are_read_as_browsers_do():
    assert html.main_text("<article><p title=it's>One first.</p><p>Don't two.</p></article>") == "One first. Don't two."
    text = html.main_text('<article><p>See <a href="x"">link</a> here.</p><p class="y" title="a > b">Next.</p></article>')
    assert text == "See link here. Next."
    assert html.main_text(f'<div data-class="sidebar" title=\'class="ad"\'><p>{PROSE}</p></div>') == " ".join(PROSE.split())
    assert html.main_text("<p hidden>No</p><p aria-hidden=true>No</p><p style='display: none'>No</p><p>Yes") == "Yes"


def test_long_and_deep_pages():
    many = "".join(f"<p>{PROSE}</p>" for _ in range(5000))
    assert len(html.main_text(f"<article>{many}</article>")) == 5000 * len(PROSE) - 1
    for skipped in ("", " hidden"):
        deep = f"<div{skipped}>" * 30_000 + "<p>down, here</p>" + "</div>" * 30_000 + f"<p>{PROSE}</p>"
        assert html.main_text(deep).endswith(PROSE.strip())


def test_extract_keeps_every_page(spark):
    ship_code(spark)
    rows = [(1, "u", "<p>Hello, you</p>", 7), (1, "u", "<p>Hello, you</p>", 7), (None, None, None, None), (2, "v", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(map(str, (tuple(r) for r in html.extract(pages).collect())))
    want = [(1, "u", "Hello, you", 10)] * 2 + [(None, None, "", 0), (2, "v", "", 0)]
    assert got == sorted(map(str, want))
    assert html.extract(pages.where("false")).count() == 0
