import pytest

from fellgate.llm import html_extract
from fellgate.llm.html_extract import main_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<html><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Title</h1><p>One,  two\n three.<br>four<p>Five&nbsp;six.</article><footer>f</footer>", "Title\nOne, two three. four\nFive six."),
        ("<body><div class='header'>Site</div><div id=content><h2>T</h2><p>Some long text here, with commas. And more text.<p>Second paragraph, long enough too.</p></div><div class=sidebar>x y</div><div class=comments><p>Reader says, hi there. Long comment text, ok.</p></div></body>", "T\nSome long text here, with commas. And more text.\nSecond paragraph, long enough too."),
        ("<article><p>One.<!-- c --><script>x<y</script><p>Two<aside>no</aside><form>no</form></article>", "One.\nTwo"),
        ("<article><p>Kept.<!-- rest <p>gone", "Kept."),
        ("<main><ul><li>a, one.<li>b, two.</ul><table><tr><td>c</td><td>d</td></table></main>", "a, one.\nb, two.\nc\nd"),
        ("<article><div class='ad'>buy</div><p>Text, here.</p><div class='cookie-notice'>ok?</div></article>", "Text, here."),
    ],
)
def test_pages(page, text):
    assert html_extract.main_text(page) == text


def test_long_pages_are_fast():
    assert html_extract.main_text("<a <b " * 20000) is not None
    assert html_extract.main_text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"


def test_table(spark):
    rows = [(1, "u", "<p>a</p>", "t"), (2, None, None, "t"), (None, "v", "", "t"), (1, "u", "<p>a</p>", "t")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [html_row(1, "u", "a"), html_row(2, None, ""), html_row(None, "v", ""), html_row(1, "u", "a")]))


def html_row(page, url, text):
    from pyspark.sql import Row

    return Row(page_id=page, url=url, text=text, n_chars=len(text))


ARTICLE = "<h1>Title</h1><p>Some long text here, with commas. And more text.</p><p>A second paragraph, long enough too.</p>"


@pytest.mark.parametrize(
    "page",
    [
        "<body class='has-sidebar'><article>{}</article></body>",
        "<body class=sidebar><article>{}</article></body>",
        "<body><main id='page-with-comments'>{}</main></body>",
        "<body><article class='post no-comments'>{}</article></body>",
        "<body><article class='comments'>{}</article></body>",
        "<body><div class='content-with-widget'>{}</div></body>",
        "<body><form action=x><div>{}</div></form></body>",
        "<body><div class=widget>{}</div><p>x</p></body>",
        "<body><article>{}</article><div class='comments'><p>" + "Much longer, a comment. " * 30 + "</p></div></body>",
        "<body><article>{}<article class=comment><p>A reader, who says so.</p></article><div class='share-buttons'>a, b</div></article></body>",
    ],
)
def test_marks_do_not_drop_the_page(page):
    want = "Title\nSome long text here, with commas. And more text.\nA second paragraph, long enough too."
    got = html_extract.main_text(page.format(ARTICLE))
    assert got.removesuffix("\nx") == want


LONG = "Some long text here, with commas, of a page. And more of it, for a while."


@pytest.mark.parametrize(
    "page",
    [
        f"<main><h1>{LONG}</h1><p>{LONG}</p><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article></main>",
        f"<main><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><article><p>{LONG}</p><p>{LONG}</p></article></main>",
        f"<body><article><p>{LONG}</p><p>{LONG}</p></article><article><p>{LONG}</p></article><div><p>{LONG}</p><p>{LONG}</p></div></body>",
    ],
)
def test_all_content_blocks_are_kept(page):
    assert html_extract.main_text(page) == "\n".join([LONG] * 5)


def test_a_headline_above_the_article_is_kept():
    assert html_extract.main_text(f"<main><h1>headline</h1><p>lead</p><article><p>{LONG}</p><p>{LONG}</p></article></main>") == f"headline\nlead\n{LONG}\n{LONG}"


def plain_content(rows):
    """Tag-path ratios once more, in plain loops: rows of (path, text, linked characters)."""
    by_path = {}
    for path, text, linked in rows:
        by_path.setdefault(path, []).append((len(text), sum(text.count(c) for c in ".,;:!?。，！？、…"), linked))
    mean = {p: (sum(a for a, _, _ in x) / len(x), sum(b for _, b, _ in x) / len(x), sum(c for _, _, c in x) / max(1, sum(a for a, _, _ in x))) for p, x in by_path.items()}
    n, weights = len(rows), (1, 2, 3, 2, 1)

    def smooth(k, i):
        return sum(w * mean[rows[min(n - 1, max(0, i + d))][0]][k] for w, d in zip(weights, range(-2, 3))) / 9

    sums = dict.fromkeys(by_path, 0.0)
    for i, (path, _, _) in enumerate(rows):
        sums[path] += smooth(0, i) * (1 + smooth(1, i)) * max(0, 1 - mean[path][2])
    score = {p: sums[p] / len(by_path[p]) for p in by_path}
    every = [score[p] for p, _, _ in rows]
    return [x for x in every], min(sum(score.values()) / len(score), 0.5 * max(every))


def test_path_ratios_against_a_plain_version():
    import random

    from fellgate.llm.html_extract import _content, _Node

    rng = random.Random(7)
    for _ in range(300):
        rows = [(rng.randint(0, 5), "".join(rng.choice("ab ,.!") for _ in range(rng.randint(1, 90))), 0) for _ in range(rng.randint(1, 40))]
        rows = [(p, t, rng.randint(0, len(t)) if p == 3 else 0) for p, t, _ in rows]
        score, threshold = plain_content(rows)
        got = _content([(_Node("div", p, None, 0, 0), t, k) for p, t, k in rows])
        assert all(g == (s >= threshold) for g, s in zip(got, score) if abs(s - threshold) > 1e-9 * threshold)


def test_time_and_memory_follow_the_page():
    import time
    import tracemalloc

    for page in ("<div>" * 100_000, "<ul><li>" * 50_000, "<blockquote>" * 100_000, '<div class="ad"><p>x y z.' * 30_000, "<div><li>a</li>" * 30_000, "<p><table><td>" * 30_000, "</ul>" * 100_000):
        began = time.perf_counter()
        main_text(page + "<p>the end of it all, at last.")
        assert time.perf_counter() - began < 4
    tracemalloc.start()
    main_text("<div>" * 100_000 + "text")
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_class_words_do_not_empty_an_article():
    body = "<p>First paragraph, with a number of words in it.</p><p>Second paragraph; it goes on for a while.</p>"
    want = "First paragraph, with a number of words in it.\nSecond paragraph; it goes on for a while."
    for open_, close in (('<body class="has-sidebar">', "</body>"), ('<div id="content" class="post no-sidebar comments-open">', "</div>"), ('<body class="login-enabled nav-fixed">', "</body>"), ('<main id="page-with-comments">', "</main>"), ("<form>", "</form>"), ('<div class="share-price">', "</div>")):
        assert main_text(open_ + body + close) == want, open_


def test_no_pages(spark):
    from fellgate.llm import html_extract

    schema = "page_id long, url string, html string, text string, n_chars string"
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(1, None, None, "t", "c"), (1, None, None, "t", "c"), (None, "u", "", "t", "c")], schema)
    assert sorted(map(tuple, html_extract.extract(rows).collect()), key=str) == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", "", 0)], key=str)
