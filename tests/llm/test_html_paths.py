import pytest

from latticework.llm import html_paths
from latticework.llm.html_paths import extracted, main_text

CASES = [
    ("", ""),
    (None, ""),
    ("plain < text &amp; more", "plain < text & more"),
    ("<p>a<p", "a"),
    ("<nav><ul><li><a href='/a'>A</a></li></ul></nav><article><h1>Head</h1><p><b>First  line,\n here.<br><p>Of.</article><footer>&copy; x</footer>",
     "Head\nFirst line, here.\nOf."),
    ("<header><h1>Site</h1></header><main><h2>Ti&amp;t</h2><p>One&nbsp;two <a href=x>link</a>.</p><script>var t='</p>';</script>"
     "<div class=comments><p>nice post, really!</p></div><form>Name <input></form></main><aside>more</aside><div id='cookie-notice'>We use cookies.</div>",
     "Ti&t\nOne two link."),
    ("<div class='menu'><a>home</a></div><div><p>A long paragraph, with words, and stops. Another one here.</p>"
     "<p>Second one, quite long too, with text.</p></div>",
     "A long paragraph, with words, and stops. Another one here.\nSecond one, quite long too, with text."),
    ("<article><p>kept text, one.</p><!-- gone --><style>p{}</style><p title='a>b'>two</p></article>", "kept text, one.\ntwo"),
    ("<article><p>cut &am", "cut &am"),
    # main with its own text around a teaser article, parts of one text, a short teaser beside the article
    ("<main><p>One long paragraph, with words and stops. And more.</p><article><p>Short teaser.</p></article><p>A second one, again with words, and stops.</p></main>",
     "One long paragraph, with words and stops. And more.\nShort teaser.\nA second one, again with words, and stops."),
    ("<article><p>Part one, with text. And more of it.</p></article><article><p>Part two, as long, with text. And more.</p></article>",
     "Part one, with text. And more of it.\nPart two, as long, with text. And more."),
    ("<article><p>The text itself, long, with stops. It goes on, and on, and on.</p><p>And on, with more of it, here.</p></article><article>Teaser</article>",
     "The text itself, long, with stops. It goes on, and on, and on.\nAnd on, with more of it, here."),
    # names of furniture within an article: sections with text stay, lists of links go
    ("<article><div class='section-header'><h2>Head, and words.</h2></div><p>A long text here, with stops. And so on, for a while.</p>"
     "<section class='related-work'><p>Others did it, too. We compare, at length, with them here.</p></section><div class='related'><a>x</a> <a>y</a></div></article>",
     "Head, and words.\nA long text here, with stops. And so on, for a while.\nOthers did it, too. We compare, at length, with them here."),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_cases(page, text):
    assert main_text(page) == text


def test_table(spark):
    rows = [(i, None if i % 2 else "u", page, "mine") for i, (page, _) in enumerate(CASES)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extracted(pages).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted((i, t, len(t)) for i, (_, t) in enumerate(CASES) for _ in range(2))
    assert extracted(pages.limit(0)).count() == 0
    deep = "<div>" * 3000 + "<p>deep text, here.</p>"
    assert main_text(deep) == "deep text, here."


def test_path_ratios_decide(monkeypatch):
    """With every path weighed alike the choices that rest on the ratios come out otherwise."""
    cases = [page for page, text in CASES[-4:] if page]
    monkeypatch.setattr(html_paths, "fused_weights", lambda nodes: [1.0] * len(nodes))
    assert sum(main_text(page) != text for page, text in CASES if page in cases) >= 2


def test_very_long_page():
    words = " ".join(f"w{i}, and more." for i in range(60_000))
    page = f"<nav><a>home</a></nav><article><p>{words}</p><p>{words}</p></article>"
    assert main_text(page) == f"{words}\n{words}"
