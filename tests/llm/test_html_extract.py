import random

import pytest

from credence.llm.html_extract import dives, extract, extract_pages, lines, regions

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; U</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>'
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy this now.</div>'
    "<article><h1>Head &lt;one&gt;</h1><p><b>First  para\ngraph.<br><p>Second &amp;&amp; third.</p><p>x</p></article><footer>&copy; me</footer>"
)


def test_article_without_end_tags():
    assert extract(PAGE) == "Head <one>\n\nFirst para graph.\n\nSecond && third.\n\nx"


def test_parts_inside_the_article_that_are_none():
    page = (
        "<body><header>Site</header><main><article><header><h1>Title</h1></header><p>One.</p><div class='cookie-notice'>We use cookies</div>"
        "<aside>More</aside><form><label>Mail</label><input name=q><button>Go</button></form><p>Two <em>em</em>phasis.</p>"
        "<section id=comments><h2>Comments</h2><p>I disagree strongly with all of this.</p></section></article><div class=sidebar>Side</div></main><footer>F</footer></body>"
    )
    assert extract(page) == "Title\n\nOne.\n\nTwo emphasis."


def test_page_without_marks_is_found_by_density():
    body = "".join(f"<p>{'Long sentence with many words in it, number %d. ' % i * 4}</p>" for i in range(4))
    page = f"<body><div><a href=x>One</a> <a href=y>Two</a> <a href=z>Three</a></div><div>Login</div><h2>Title of it</h2>{body}<p>End.</p><div><a href=q>next</a></div></body>"
    got = extract(page).split("\n\n")
    assert len(got) >= 5 and got[-1] == "End." and "Three" not in "".join(got)
    assert got[-2].startswith("Long sentence")


def test_surge_and_dive():
    assert regions([0, 5, 90, 0, 80, 0, 0, 0, 0, 2], 80) == [(1, 5)]
    assert regions([], 1) == [] and regions([0, 0], 1) == []
    assert regions([3, 0, 0, 0, 4], 1) == [(0, 1), (4, 5)]


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), ("<script>x</script>", ""), ("a<br>b", "a b"), ("<p>5 < 6 &am &amp &nbsp;x</p>", "5 < 6 &am & x"),
        ("<p>unclosed <a href='x>y'>link", "unclosed link"), ("<p>a<p title=\"it's\">b</p>", "a\n\nb"),
    ],
)
def test_odd_markup(html, want):
    assert extract(html) == want


def test_long_page_in_linear_time():
    assert extract("<article>" + "<p>word</p>" * 20_000 + "</article>").count("word") == 20_000
    assert len(lines("<div>" * 3000 + "x")) == 1


def test_rows(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", PAGE, "other"), (1, "u", PAGE, "other"), (2, None, None, None), (None, "v", "", None)]
    got = extract_pages(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect())
    assert [f[0] for f in found] == [0, 1, 1, 2] and found[3][1:] == ("", 0) and found[1][2] == len(extract(PAGE))
    assert extract_pages(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize(
    "start, end",
    [
        ('<body class="single has-sidebar"><p>', "</p>"), ('<body class="no-sidebar"><article><p>', "</p></article>"), ('<html class="menu"><body class="search"><p>', "</p>"),
        ('<body><div id="content" class="with-sidebar"><p>', "</p></div>"), ('<body><article class="post comment-open"><p>', "</p></article>"),
        ('<body><main class="widget"><p>', "</p></main>"), ('<body><div class="page widget"><p>', "</p></div>"),
    ],
)
def test_class_words_around_the_whole_article_drop_nothing(start, end):
    text = "The whole article stands here, with a good many words in it, and none of them goes."
    assert extract(f"{start}{text}{end}") == text
    assert extract(f'<body><article><p>{text}</p></article><article class="comment"><p>I disagree.</p></article>') == text


def test_class_words_are_ignored_where_nothing_else_has_weight():
    text = "The whole article stands here, with a good many words in it, and none of them goes."
    assert extract(f'<body><p><a href=x>Home page</a></p><div class="page widget"><p>{text}</p></div>') == text


def test_article_is_the_container_with_most_text_not_the_strongest_mark():
    body = "\n\n".join(f"Paragraph {i} of the article, which is long enough to weigh more than a card." for i in range(5))
    inner = "".join(f"<p>{p}</p>" for p in body.split("\n\n"))
    card = "<article><h3>Another story</h3><p>Read it.</p></article>"
    for start, end in (("<main>", "</main>"), ("<div class=content>", "</div>"), ("<div class=article>", "</div>")):
        assert extract(f"<body>{start}{inner}{end}{card}</body>") == body
        assert extract(f"<body><div>{card}</div>{start}{inner}{end}</body>") == body
    assert extract(f"<body><div class=article>{inner}</div><main><p>Short.</p></main></body>") == body
    # A stronger mark inside a weaker one still narrows it, and one that is but a part of it loses nothing.
    assert extract(f"<body><main><p>Site news</p><article>{inner}</article></main></body>") == body
    assert extract(f"<body><main>{inner}{card}</main></body>") == body + "\n\nAnother story\n\nRead it."


def test_paragraphs_after_an_advert_in_an_unmarked_article_stay():
    body = [f"Paragraph {i} of a long article, with enough words in it to be a surge of its own on any page." for i in range(20)]
    advert = "<div class=ad><p>Buy</p><p>this</p><p>now</p><p>please</p></div>"
    links = "".join(f"<p><a href=/{i}>Another page {i}</a></p>" for i in range(4))
    last = ["A last one, short of a fifth of the others.", "The end."]
    for between in (advert, links):
        page = "".join(f"<p>{p}</p>" for p in body) + between + f"<p>{last[0]}</p>" + between + f"<p>{last[1]}</p>"
        assert extract(f"<body><div>{page}</div></body>") == "\n\n".join(body + last)


def brute_dives(weights, window=3):
    """Lines in a whole window of lines without weight."""
    inside = set()
    for i in range(len(weights) - window + 1):
        if not any(weights[i : i + window]):
            inside |= set(range(i, i + window))
    return [k in inside and any(weights) for k in range(len(weights))]


def brute_regions(weights, threshold, window=3):
    """Surge: first line with weight whose window reaches the threshold. Dive: next line whose window is empty."""
    out, i, n = [], 0, len(weights)
    while i < n:
        if weights[i] and sum(weights[i : i + window]) >= threshold:
            end = next((j for j in range(i + 1, n) if not sum(weights[j : j + window])), n)
            out.append((i, end))
            i = end + 1
        else:
            i += 1
    return out


def test_surges_and_dives_equal_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        weights = [rng.choice([0, 0, 0, 5, 40, 200]) for _ in range(rng.randint(0, 25))]
        assert dives(weights) == brute_dives(weights)
        for threshold in (1, 30, 210):
            assert regions(weights, threshold) == brute_regions(weights, threshold)


def test_windows_cut_runs_of_links_out_of_a_marked_article():
    links = "".join(f"<p><a href=/{i}>Another story {i}</a></p>" for i in range(3))
    page = f"<body><article><h1><a href=/>Headline</a></h1><p>One paragraph.</p><p><a href=/x>A lone link</a></p><p>Two.</p>{links}<p>Three.</p></article></body>"
    assert extract(page) == "Headline\n\nOne paragraph.\n\nA lone link\n\nTwo.\n\nThree."
    assert extract(page.replace(links, links[: len(links) // 3 * 2])).count("Another") == 2
    assert extract(f"<body><article>{links}</article></body>").count("Another story") == 3


def test_words_of_another_sense_beside_class_words_drop_nothing():
    for tag in ('div class="social-science"', 'section id="search-for-life"', 'div class="menu-of-the-day-recipes"'):
        assert extract(f"<body><article><p>Intro.</p><{tag}><p>The text.</p></{tag.split()[0]}></article></body>") == "Intro.\n\nThe text."
    for name in ("share-buttons", "related-posts", "ad-slot-3", "cookie-banner", "newsletter-signup"):
        assert extract(f'<body><article><p>Intro.</p><div class="{name}"><p>Not this.</p></div></article></body>') == "Intro."


def test_forms_that_hold_the_article():
    inner = "<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>One paragraph of it.</p><p>Another one.</p><form><label>Mail</label> Sign up here</form></article>"
    want = "Title\n\nOne paragraph of it.\n\nAnother one."
    assert extract(f'<body><form id="aspnetForm" action="x">{inner}</form></body>') == want
    body = "".join(f"<p>{'Plain sentence number %d of the article. ' % i * 3}</p>" for i in range(5))
    got = extract(f"<body><form id=f><div><a href=x>One</a></div>{body}</form><form><p>Write to us</p></form></body>").split("\n\n")
    assert len(got) == 5 and all(x.startswith("Plain sentence") for x in got)


def test_ids_of_headings_and_sections_are_anchors():
    page = (
        '<article><h1>Title</h1><h2 id="legal">Legal</h2><p>Text a.</p><h2 id="Advertising">Advertising</h2><p>Text b.</p><h3 id="search">Search</h3><p>Text c.</p>'
        '<section id="navigation"><p>How ships find their way.</p></section><section id="comments"><p>I disagree.</p></section></article>'
    )
    assert extract(page) == "Title\n\nLegal\n\nText a.\n\nAdvertising\n\nText b.\n\nSearch\n\nText c.\n\nHow ships find their way."


def test_lists_of_links_that_a_heading_leads_stay():
    sources = "<ul>" + "".join(f"<li><a href={i}>Source {i}</a></li>" for i in range(4)) + "</ul>"
    assert extract(f"<article><h1>T</h1><p>Text.</p><h2>Sources</h2>{sources}</article>").endswith("Sources\n\nSource 0\n\nSource 1\n\nSource 2\n\nSource 3")
    assert extract(f"<article><h1>T</h1><p>Text.</p>{sources}<p>End.</p></article>") == "T\n\nText.\n\nEnd."


def test_a_line_of_links_within_an_unmarked_article_stays():
    long = "<p>" + "Many words make a sentence of some length. " * 4 + "</p>"
    got = extract(f"<body>{long}<p><a href=x>Read the whole report of the commission here</a></p>{long}<div><a href=q>next</a></div></body>").split("\n\n")
    assert len(got) == 3 and got[1].startswith("Read the whole report")
