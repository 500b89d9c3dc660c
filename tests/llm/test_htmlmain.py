"""Main text of small pages of known structure."""

import pytest

from plenum.llm import htmlmain


def page(body: str) -> str:
    return (
        "<html><head><title>t</title><style>p {}</style></head><body><header>Site name</header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        f"<div class='main'><article class='post'><h1>A title</h1>{body}</article><section class='comments'><p>First!</p></section></div>"
        "<aside>Related stories</aside><script>var x = 1;</script><footer>All rights reserved</footer></body></html>"
    )


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        (1, "http://a.com/1", page("<p>Fish &amp;\n chips</p><p>are <b>good</b>&nbsp;food.</p>")),
        (2, "http://a.com/2", page("<p>" + "Another long paragraph of the same host. " * 50 + "</p>")),
        (3, "no host", page("<p>Text of a page without a host.</p>")),
        (4, "http://a.com/4", None),
        (5, "http://a.com/5", ""),
        (1, "http://a.com/1", page("<p>Fish &amp;\n chips</p><p>are <b>good</b>&nbsp;food.</p>")),
    ]
    frame = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    return htmlmain.extract_main(frame).collect()


def test_articles_only(found):
    texts = {r["page_id"]: r["text"] for r in found}
    assert texts[1] == "A title Fish & chips are good food."
    assert texts[2] == "A title " + ("Another long paragraph of the same host. " * 50).strip()
    assert texts[3] == "A title Text of a page without a host."


def test_every_row_once_and_lengths(found):
    assert sorted(r["page_id"] for r in found) == [1, 1, 2, 3, 4, 5]
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert {r["text"] for r in found if r["page_id"] > 3} == {""}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmlmain.extract_main(empty).count() == 0


LONG = "A sentence of the story that goes on for a while. " * 8
SHAPES = {
    "layout named like a part": ('<div class="layout sidebar-right"><article><p>Kept text.</p></article><div class="sidebar"><p>Not this.</p></div></div>', "Kept text."),
    "title in the article's header": ('<article><div class="entry-header"><h1>Title</h1></div><header><p>Lead.</p></header><p>Body.</p></article>', "Title Lead. Body."),
    "words of a class inside other names": ('<article><p class="lead search-result">First.</p><p>Second.</p></article>', "First. Second."),
    "list of sources": ('<article><p>See:</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></article>', "See: One Two Three"),
    "article around comments and adverts": (
        '<article><p>Body.</p><div class="comment-list"><p>First!</p></div><div id="ad-slot-3">Buy</div><div class="share">Tell</div><form>Name</form></article>', "Body."),
    "subjects named like parts": (
        '<article><div class="social-issues"><p>One.</p></div><div class="promoted-text"><p>Two.</p></div><p class="related-work">Three.</p><ul class="menu-of-the-day"><li>Four.</li></ul><p>Let <math><mi>x</mi></math> be.</p></article>',
        "One. Two. Three. Four. Let x be.",
    ),
    "compounds of parts": ('<article><p>Body.</p><div class="related-posts">More</div><div class="ad-slot-top">Buy</div><div class="social-share-buttons">Tell</div><div id="menu-left">Go</div></article>', "Body."),
    "everything in a wrapper named like a dialog": ('<div class="modal"><div class="content"><p>Body text here.</p></div><nav>Menu</nav></div>', "Body text here."),
    "article in parts": (f'<div class="wrap"><article><p>{LONG}</p></article><article><p>Second part.</p></article></div>', f"{LONG}Second part."),
    "broken markup": ("<article><p>One <b>two<p>three</i></div></section> four &lt; &#233; &bogus; <", "One two three four < é &bogus; <"),
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_shapes(name):
    body, want = SHAPES[name]
    html = f"<html><body><header>Site</header><nav><a href=/>Home</a></nav>{body}<footer>Rights</footer></body></html>" if name != "broken markup" else body
    assert htmlmain.page_text(html, None) == want


def test_the_vote_corrects_a_page(spark):
    """A short story under a long thread: the page's own best container is the thread, the host's other pages tell where the story is."""
    shape = "<html><body><div class='upper'><p>{}</p></div><div class='lower'><p>{}</p></div></body></html>"
    rows = [(i, f"https://one.org/{i}", shape.format(LONG + str(i), "Short talk.")) for i in range(6)] + [(6, "https://one.org/6", shape.format("A short story.", LONG * 3))]
    rows += [(7, "https://two.org/7", shape.format("A short story.", LONG * 3))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in htmlmain.extract_main(frame).collect()}
    assert found[6] == "A short story." and found[7] == (LONG * 3).strip() and found[3] == f"{LONG}3"
    assert htmlmain.page_text(rows[6][2], None) == found[7]


def test_a_host_path_that_holds_a_part_only(spark):
    whole = "<html><body><main><div class='part'><p>{}</p></div>{}</main></body></html>"
    rows = [(i, f"https://one.org/{i}", whole.format(LONG * 3 + str(i), "")) for i in range(5)] + [(9, "https://one.org/9", whole.format("Start.", f"<div class='rest'><p>{LONG}</p></div>"))]
    found = {r.page_id: r.text for r in htmlmain.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[9] == f"Start. {LONG}".strip()


def test_ties_and_very_long_pages():
    tie = "<html><body><div class='a'><p>Same size.</p></div><div class='b'><p>Equal size</p></div></body></html>"
    assert htmlmain.page_text(tie, None) == htmlmain.page_text(tie, None) != ""
    rows = "".join(f"<tr><td class='ad'>x{i}</td><td>cell {i}</td></tr>" for i in range(30_000))
    text = htmlmain.page_text(f"<html><body><article><table>{rows}</table></article></body></html>", None)
    assert text.startswith("cell 0 cell 1 cell 2") and text.endswith("cell 29999") and "x1" not in text
    assert htmlmain.page_text("<div>" * 20_000 + "deep" + "</div>" * 20_000, None) == "deep"
