"""Words within names propose and hosts decide; dropped parts of a line; reading time of broken pages."""

import time

from textloom.llm import html_text

FILLER = "Some longer sentence of the article that goes on. "


def page(body):
    return f"<html><body>{body}</body></html>"


def test_words_within_names_stay_in_an_article():
    for inner in ("<div class='notice-board'><p>Kept line.</p></div>", "<section class='comment-on-policy'><p>Kept line.</p></section>"):
        assert html_text.main_text(page(f"<div class='content'><p>{FILLER}</p>{inner}</div>")) == f"{FILLER.strip()}\nKept line."
    for inner in ("<ul class='social-causes'><li>Kept line.</li></ul>", "<div class='promotion-history'><p>Kept line.</p></div>"):
        assert html_text.main_text(page(f"<article><p>{FILLER}</p>{inner}</article>")) == f"{FILLER.strip()}\nKept line."
    # names that are nothing but such words go
    for name in ("site-footer", "cookie-banner", "post-comments", "AdBox", "related-posts", "share_buttons", "main-nav"):
        assert html_text.main_text(page(f"<article><p>{FILLER}</p><div class='{name}'><p>Gone line.</p></div></article>")) == FILLER.strip(), name


def test_hosts_decide_on_words_within_names(spark):
    """What stands on several pages of a host goes, what one page has of its own stays."""
    rows = []
    for k in range(20):
        tool = "<div class='share-with-friends'><p>Send this to your friends.</p></div>" if k % 5 == 0 else ""
        own = "<div class='notice-board'><p>The board of this town says more.</p></div>" if k == 7 else ""
        rows.append((k, f"http://w.example/{k}", page(f"<div class='story{k}'><h1>Head {k}</h1><p>{FILLER * 2}</p>{tool}{own}</div>")))
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(20):
        assert got[k] == f"Head {k}\n{(FILLER * 2).strip()}" + ("\nThe board of this town says more." if k == 7 else "")


def test_dropped_parts_of_a_line():
    for part in ("<script>x</script>", "<svg><text>x</text></svg>", "<button>x<div>y</div></button>", "<math><mi>x</mi></math>", "<span class='ad'>x</span>", "<select><option>x</select>", "<span hidden>x<b>y</b></span>"):
        assert html_text.main_text(page(f"<article><p>one {part} two</p><p>three</p></article>")) == "one two\nthree", part
    assert html_text.main_text(page("<article><p>one <b class='popular'>bold</b> two</p></article>")) == "one bold two"
    assert html_text.main_text(page("<article><p>one<script>x</script>two</p></article>")) == "onetwo"


def test_broken_pages_are_read_in_linear_time():
    for n in (8_000, 64_000):
        began = time.monotonic()
        for source in ("<p><button>" + "<div>" * n + "<section>" * n, "<p>" + "<table>" * n + "</p>" * n, "<b>" + "<div>" * n + "</b>" * n, "<ul>" + "<li><table><tr><td>" * n, "<div class=widget>" * n + "x"):
            html_text.main_text(source)
        took = time.monotonic() - began
    assert took < 40
