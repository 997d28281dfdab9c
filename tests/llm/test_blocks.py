import html
import re

import numpy as np
import pytest

from logsift.llm import blocks as H
from logsift.llm import queries as Q

from llm_data import SF_MID, SF_SMALL


def article_text(page):
    """What the small table's pages have as their article, cut out by hand (a page may break off)."""
    a, e = page.find("<article>"), page.find("</article>")
    if a < 0:
        return ""
    body = re.sub(r"<[^>]*\Z", "", page[a + 9 : e if e >= 0 else None])
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", s)).split()) for s in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(p for p in parts if p)


@pytest.fixture(scope="module")
def model(spark):
    return H.learn(spark.read.parquet(f"{SF_MID}/pages.parquet"))


def test_query_gives_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    rows = Q.op5_blocks(spark, SF_SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))
    assert np.mean([r.text == article_text(pages[r.page_id].html) for r in rows]) > 0.95


def test_pages_not_learnt_from(spark, model):
    texts = H.extract(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").limit(600), model=model).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()}
    assert np.mean([r.main_text == article_text(pages[r.row.page_id]) for r in texts]) > 0.98


def test_other_layouts_of_unseen_texts(spark, model):
    draw = np.random.default_rng(123)
    pages = [H.blocks(r.html) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").limit(200).collect()]
    main = [[b.text for b in p if "<article>" in b.path] for p in pages]
    other = [b.text for p in pages for b in p if "<article>" not in b.path]
    laid = [H.lay_out(m[:20], other, draw) for m in main if m]
    p = model.probabilities([H.vectors(b) for b, _ in laid])
    assert np.mean(np.concatenate([(x >= 0.5) == (y > 0.5) for x, (_, y) in zip(p, laid, strict=True)])) > 0.98


def test_a_page_by_hand(model):
    page = """<html><head><title>T</title></head><body><header><h1>The Daily</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies, accept them please.</p></div>
    <main><article><h1>A title &amp; more</h1><p>First paragraph of the article, with <b>bold</b> and a <a href="x">link</a> in it.
    <p>Second paragraph&nbsp;of the article &#8212; it goes on for a while.</p><div class="ad">Buy this now.</div><p>Third paragraph, the last one.</p></article></main>
    <aside class="sidebar"><p>Other stories that you may like.</p></aside><form class="newsletter"><p>Sign up for our letter.</p></form>
    <section class="comments"><div class="comment"><p>I think that this is a fine article.</p></div></section><footer><p>&copy; 2024 The Daily</p></footer><script>var x = "<p>no</p>";</script></body></html>"""
    got = H.blocks(page)
    text = H.main_text(got, model.probabilities([H.vectors(got)])[0])
    assert text == "A title & more\nFirst paragraph of the article, with bold and a link in it.\nSecond paragraph of the article — it goes on for a while.\nThird paragraph, the last one."


@pytest.mark.parametrize("page,want", [
    ("", []), ("  \n ", []), ("plain text", ["plain text"]), ("<p>a<br>b", ["a b"]), ("<p>a &lt; b &amp;&#65;</p>", ["a < b &A"]),
    ("<p>cut off <b cla", ["cut off"]), ("<script>if (a<b) '<p>x</p>'", []), ("<!-- <p>x</p> --><p>y", ["y"]), ("a < b", ["a < b"]),
    ('<p title="a>b">c</p>', ["c"]), ("<ul><li>1<li>2</ul>3", ["1", "2", "3"]), ("<STYLE>p{}</STYLE><P>x</P>", ["x"]), ("</p></div>x", ["x"]), ("<p>a<!-- cut", ["a"])])
def test_blocks(page, want):
    assert [b.text for b in H.blocks(page)] == want


def test_gradients():
    draw = np.random.default_rng(2)
    m = H.Labeller(draw)
    pages = [draw.standard_normal((n, H.DIM)).astype(np.float32) * 0.3 for n in (5, 3, 1)]
    labels = [(draw.random(len(p)) < 0.5).astype(np.float32) for p in pages]
    _, grads = m.step(pages, labels)
    for w, g in zip(m.weights(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = w[at].copy(), 1e-2
        w[at] = old + e
        up = m.step(pages, labels)[0]
        w[at] = old - e
        down = m.step(pages, labels)[0]
        w[at] = old
        assert g[at] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=2e-4)


def test_odd_rows(spark, model):
    long = "<article>" + "<p>Word after word in a paragraph that is one of many.</p>" * 20_000 + "</article>"
    rows = [(1, None, "a", "x"), (2, "", "b", "x"), (None, "<article><p>Some text of an article here.</p></article>", None, "x"), (4, long, "d", "x"), (4, long, "d", "x"), (5, "\x00\x01 <<<>>> </", "e", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, row string")
    got = H.extract(df, model=model).collect()
    assert len(got) == len(rows)
    by = {r.row.page_id: r for r in got}
    assert by[1].main_text == by[2].main_text == "" and by[1].n_chars == 0 and by[1].row.row == "x"
    assert by[4].main_text.count("\n") == 19_999
    assert by[None].main_text == "Some text of an article here."
    assert H.extract(df.limit(0)).collect() == [] and len(H.extract(df.limit(2)).collect()) == 2


def long_page(k):
    parts = "".join(f"<p>Paragraph {i} of the long article {k}, with words{(i * 7 + k) % 50} that follow others.</p>" for i in range(450))
    return f'<html><body><nav><ul><li><a href="/">Home {k}</a></li></ul></nav><article><h1>Title {k}</h1>{parts}</article><footer><p>Imprint {k}</p></footer></body></html>'


def test_tables_of_long_pages_are_learnt_from(spark, monkeypatch):
    rows = [(k, long_page(k)) for k in range(12)]
    assert all(len(h) > 1 << 15 for _, h in rows)
    df = spark.createDataFrame(rows, "page_id long, html string")
    seen = []
    monkeypatch.setattr(H, "fit", lambda pages: seen.append(pages))
    H.learn(df)
    assert sorted(seen[0]) == sorted(h for _, h in rows)
    # the bytes of all pages together are bounded, but some pages are always there
    assert len(H.sample_of(df, sample_bytes=6 * len(rows[0][1]))) in (5, 6)
    assert len(H.sample_of(df, sample_bytes=1)) == H.LEAST


def test_copies_count_once(spark, monkeypatch):
    pages = [f"<p>Page {k}.</p>" for k in range(60)]
    df = spark.createDataFrame([(h,) for h in pages], "html string")
    first = H.sample_of(df)  # in the order of the hashes
    copies = spark.createDataFrame([(h,) for h in [*pages, *[first[0]] * 150, *[first[1]] * 120, "", None]], "html string")
    seen = []
    monkeypatch.setattr(H, "fit", lambda pages: seen.append(pages))
    H.learn(copies.repartition(5))
    assert seen[0] == first and sorted(first) == sorted(pages)


def test_figures_of_a_block_cover_all_of_it(spark):
    """Capitals and digits behind any length of other text count; a share is over all characters."""
    shares = lambda text: H.vectors([H.Block(("<p>",), "p", text, 0.0)])[0, H.PATH_DIM + H.WORD_DIM + 3 : H.PATH_DIM + H.WORD_DIM + 5].tolist()
    for n in (100, 200, 201, 5000):
        assert shares("a " * (n // 2) + "B" * n + "7" * 2 * n) == pytest.approx([n / (n // 2 * 2 + 3 * n), 2 * n / (n // 2 * 2 + 3 * n)])
    bad = spark.sql("SELECT 1L AS page_id, cast(X'3C703E61FF62' AS string) AS html")
    assert H.blocks("<p>a\ufffdb") and H.extract(bad).first().n_chars in (0, 3)
