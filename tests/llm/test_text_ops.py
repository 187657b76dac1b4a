"""op1, op4, op5: text operators against brute force and hand-made cases."""

import hashlib
import time

import brute
from cases import HARD
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import decontaminate, html_text, pii, queries
from textloom.llm.automaton import SuffixAutomaton


def test_decontaminate_query(spark, sf_dir, sample):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.decontaminate(sample, items)
    got = queries.op1_decontaminate(spark, sf_dir).collect()
    assert len(got) == len(sample)
    assert all(tuple(r)[1:6] == want[r["doc_id"]] and 0 <= r["n_cut"] <= r["n_hit"] for r in got) and any(r["contaminated"] for r in got)


ITEMS = [(1, "One two three FOUR five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short item"), (3, None), (4, ""), (5, "--"), (None, "short item"), (2, "other part"), (10, "same text here with several words")]


def test_decontaminate_hard(spark, hard, docs_of):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    more = docs_of([(50, "x one-two three four five six seven eight nine ten eleven twelve thirteen y"), (51, "a SHORT  item, other part " + "z " * 100), (52, "two three four five six seven eight nine ten eleven twelve thirteen"), (None, "short item")], clash=True)
    rows = [*HARD, *((r["doc_id"], r["text"]) for r in more.collect())]
    want = brute.decontaminate(enumerate(t for _, t in rows), [i for i in ITEMS if i[0] is not None])
    expected = sorted(((d, *want[k]) for k, (d, _) in enumerate(rows)), key=str)
    both = hard.unionByName(more)
    for block in (10**6, 5, 2):  # repeated and missing doc_ids have their own rows, with any number of blocks
        got = decontaminate.contamination(both, bench, block_words=block).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), decontaminate.digest(r["items"]), r["contaminated"]) for r in got), key=str) == expected
    clean = sorted(((d, t) for k, (d, t) in enumerate(rows) if not want[k][4]), key=str)
    for block in (10**6, 5):
        left = decontaminate.decontaminated(both, bench, block_words=block)
        assert left.columns == both.columns and sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == clean
    left = [r["doc_id"] for r in decontaminate.decontaminated(hard.unionByName(more), bench).collect()]
    assert 50 not in left and 51 in left and 52 in left and 1 in left and 4 not in left


def test_decontaminate_empty(spark, hard, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, none).count() == 0
    assert decontaminate.contamination(hard, none).filter("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.decontaminated(hard, none).count() == len(HARD)


def test_spans_are_cut(spark, docs_of):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string")
    body = "Keep this, " + " ".join(f"W{k}" for k in range(20)) + "! And " + "that " * 500
    for block in (10**6, 13):
        cut = lambda rows, share: decontaminate.decontaminated(docs_of(rows), bench, longest=13, share=share, block_words=block)  # noqa: B023, E731
        assert {r["doc_id"]: r["text"] for r in cut({1: body, 2: "clean", 3: None}, 0.5).collect()} == {1: "Keep this, ! And " + "that " * 500, 2: "clean", 3: None}
        assert [r["doc_id"] for r in cut({1: body[:60], 2: "clean"}, 0.01).collect()] == [2]


def test_long_items_are_cut_into_blocks(spark):
    item = [b"a%d" % (k % 50) for k in range(400)]
    bench = spark.createDataFrame([(1, " ".join(w.decode() for w in item)), (2, "line\nfeed")], "item_id long, text string")
    blocks = list(decontaminate.item_blocks(bench, 60))
    assert max(sum(map(len, b.values())) for b in blocks) <= 60 + 12
    windows = {tuple(p[k : k + 13]) for b in blocks for (i, _), p in b.items() if i == "1" for k in range(len(p) - 12)}
    assert windows == {tuple(item[k : k + 13]) for k in range(388)}


def test_repeated_words_are_linear():
    began = time.monotonic()
    sam = SuffixAutomaton({("1", 1): [b"w"] * 100_000, ("2", 2): [b"w"] * 3}, 13)
    spans, items = decontaminate.find_hits([b"w"] * 100_000, sam)
    assert spans == [(0, 100_000)] and len(items) == 2 and time.monotonic() - began < 10


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=7), max_size=4), st.text("abc", max_size=14), st.integers(2, 4))
def test_automaton(items, doc, width):
    words = lambda s: [c.encode() for c in s]
    sam = SuffixAutomaton({str(k): words(s) for k, s in enumerate(items) if s}, width)
    spans, found = decontaminate.find_hits(words(doc), sam)
    hit, want = set(), set()
    for k, s in enumerate(items):
        for i in range(max(1, len(s) - width + 1) if s else 0):
            w = s[i : i + width]
            for j in range(len(doc) - len(w) + 1):
                if doc[j : j + len(w)] == w:
                    hit |= set(range(j, j + len(w)))
                    want.add(str(k))
    assert {x for a, b in spans for x in range(a, b)} == hit and {sam.items[k] for k in found} == want


NASTY = [
    "a@b.c_d@e.f g@h i@j.k.l- x.@y.z", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4 1 1", "+1 (968) 555-9369. +49 30 12345 678 +1 2 +12345678901234567", "é😀 a@b.co 😀 10.0.0.1",
    "a" * 3000 + "@" + "b." * 3000, "1" * 5000, "+" + "1-" * 3000, "@@..++", None, "",
]


def test_pii_base(spark, docs_of, sample):
    rows = [*sample[:120], *((10_000 + k, t) for k, t in enumerate(NASTY)), *((20_000 + k, t) for k, (_, t) in enumerate(HARD))]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.personal_data(docs_of(rows, clash=True)).collect()}
    for d, t in rows:
        assert [s for s in got[d] if s[0] in ("email", "ip", "card", "phone")] == brute.base_spans(t), (d, t)


def test_pii_query(spark, sf_dir, sample):
    want = {}
    for d, t in sample:
        s = brute.base_spans(t)
        want[d] = (*(sum(x[0] == k for x in s) for k in ("email", "ip", "card", "phone")), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())
    got = queries.op4_personal_data(spark, sf_dir)
    assert {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got.collect()} == want
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_pii_checksums_and_context(docs_of):
    texts = {1: "IBAN GB82 WEST 1234 5698 7654 32 ok", 2: "GB82 WEST 1234 5698 7654 33", 3: "her SSN is 123-45-6789", 4: "part 123-45-6789", 5: "DE89370400440532013000"}
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.personal_data(docs_of(texts)).collect()}
    assert "iban" in got[1] and "iban" not in got[2] and got[3] == ["ssn"] and got[4] == [] and "iban" in got[5]
    shown = {r["doc_id"]: r["text"] for r in pii.masked(docs_of({1: "mail a@b.co now", 2: None, 3: "plain"})).collect()}
    assert shown == {1: "mail <EMAIL> now", 2: "", 3: "plain"}
    assert pii.personal_data(docs_of({})).count() == 0


def test_pii_context_decides(docs_of):
    """A word on either side lifts a proposal over the threshold; another match of the kind ends the context."""
    hexed, key = "04dbebab91ab85687d33eeaaf9ac699e1188f962", f"{97 - 1850578006084 % 97:02d}"
    texts = {
        1: f'token = "{hexed}"', 2: f"commit {hexed} is fine", 3: f"{hexed} (api key)", 4: "AKIA" + "ABCD1234" * 2, 5: "tel 030 1234567", 6: "nr 030 1234567", 7: "030 1234567 phone", 8: "DNI 12345678Z", 9: "DNI 12345678A", 10: "12345678Z",
        11: f"1 85 05 78 006 084 {key}", 12: f"1 85 05 78 006 084 {(int(key) + 1) % 97:02d}", 13: "mail a@b.co", 14: "x a@b.co", 15: "ssn 123-45-6789, 123-45-6788",
    }
    got = {r["doc_id"]: [(s["kind"], s["score"]) for s in r["spans"]] for r in pii.personal_data(docs_of(texts)).collect()}
    assert got == {1: [("secret", 0.7)], 2: [], 3: [("secret", 0.7)], 4: [("secret", 0.6)], 5: [("tel", 0.6)], 6: [], 7: [("tel", 0.6)], 8: [("dni", 0.7)], 9: [], 10: [], 11: [("nir", 0.5)], 12: [], 13: [("email", 1.0)], 14: [("email", 0.6)], 15: [("ssn", 0.6)]}


def test_pii_many_matches(docs_of):
    """Places stay right over several levels of blocks, in time that grows with the text."""
    for n in (0, 1, 63, 64, 65, 4097):
        text = "é".join(f" u{k}@x.io 1.2.3.{k % 300}" for k in range(n))
        found = pii.personal_data(docs_of({1: text})).first()["spans"]
        assert [(s["kind"], s["start"], s["end"]) for s in found] == brute.base_spans(text)
    began = time.monotonic()
    assert len(pii.personal_data(docs_of({1: "a@b.co " * 200_000})).first()["spans"]) == 200_000
    assert time.monotonic() - began < 60


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body>{body}</body></html>"


CASES = [
    (page("<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title &amp; more</h1><p><b>One<br><p>Two&nbsp;words  here</p></article><footer>&copy; f</footer>"), "Title & more\nOne\nTwo words here"),
    (page("<header>Site</header><div class='cookie-notice'>We use cookies</div><div id='main'><p>Body text one is long enough.</p><p>Body text two &lt;b&gt;.</p></div><div class='sidebar'><p>side</p></div><div class='comments'><p>nice post</p></div>"), "Body text one is long enough.\nBody text two <b>."),
    (page("<main><p>Alpha<form><input value=x><label>Name</label></form><p>Beta<aside>related</aside><section id='comments'><p>reader</p></section></main>"), "Alpha\nBeta"),
    (page("<div class='ad'>Buy</div><div class='wrap'><div class='post'><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>x\n y</pre></div></div><div role='dialog'>d</div><p hidden>h</p>"), "a\nb\nc\nd\nx y"),
    ("", ""), (None, ""), ("just text & more", "just text & more"), ("<p>unclosed <i>tag", "unclosed tag"), ("<div", ""), ("a < b and c > d", "a < b and c > d"), ("<!-- <p>x</p> --><p>y</p><![CDATA[z]]>", "y\nz"),
]


FILLER = "Some longer sentence of the article that goes on. "
MORE = [
    (page(f"<div class='topnav'><a href=a>Home</a> <a href=b>News</a></div><div class='content has-sidebar'><h1>Head</h1><p>{FILLER}</p><div class='share-buttons'>Share</div></div><div class='mainmenu'>x</div>"), f"Head\n{FILLER.strip()}"),
    (page(f"<article><header class='entry-header'><h1>Head</h1></header><div class='entry-content'><p>{FILLER}</p></div><footer class='entry-footer'>tags</footer></article><section id='comments'><article class='comment'><p>reader says</p></article></section>"), f"Head\n{FILLER.strip()}"),
    (page(f"<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><h2>Head</h2><p>{FILLER}<p>{FILLER}<form>search<input></form>"), f"Head\n{FILLER.strip()}\n{FILLER.strip()}"),
    (page(f"<div id=wrapper><div id=header>Site</div><div role=main><blockquote>{FILLER}</blockquote><p>See <a href=x>this link</a>.</p></div><div class='cookieconsent'>c</div><div id=footer>f</div></div>"), f"{FILLER.strip()}\nSee this link ."),
    (page(f"<div class='AdBanner'>buy</div><table><tr><td class=sidebar>s</td><td class=body><p>{FILLER}</p></td></tr></table><noscript>n</noscript><template>t</template>"), FILLER.strip()),
]


def test_other_layouts():
    for source, want in MORE:
        assert html_text.main_text(source).replace("link.", "link .") == want, source


def test_salted_hosts(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"http://h{k % 2}.x/", CASES[0][0]) for k in range(6)] + [(9, None, None)], "page_id long, url string, html string")
    want = {tuple(r) for r in html_text.main_texts(df).collect()}
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in html_text.main_texts(df).collect()} == want and len(want) == 7


def test_main_text_cases():
    for source, want in CASES:
        assert html_text.main_text(source) == want, source


def test_consensus(spark):
    """A page whose own best guess is wrong follows its host."""
    good = "<div class='c12'><p>" + "article words " * 30 + "</p></div><div class='x'><p>short</p></div>"
    odd = "<div class='c7'><p>brief article</p></div><div class='x'><p>" + "junk words " * 30 + "</p></div>"
    rows = [(k, f"https://a.example/{k}", page(good)) for k in range(5)] + [(9, "https://A.example:80/9", page(odd)), (10, None, page(odd)), (11, "bad url", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(df.withColumn("text", df["url"]).withColumn("paths", df["url"])).collect()}
    assert got[9] == "brief article" and got[0].startswith("article words") and got[10].startswith("junk") and got[11] == ""
    assert html_text.main_texts(df.limit(0)).count() == 0


LINKS = "<h1>Links of the week</h1><p>Some lines about what was read.</p><ul><li><a href=1>The first paper</a></li><li><a href=2>The second paper</a></li></ul>"


def test_links_and_weak_words_in_the_article():
    """What only may be a menu or a notice stays where it stands in the article."""
    assert html_text.main_text(page(f"<div class='content'>{LINKS}</div>")).endswith("The first paper\nThe second paper")
    assert html_text.main_text(page(f"<div>{LINKS}</div>")).endswith("The first paper\nThe second paper")
    assert html_text.main_text(page(f"<div class='content'><p>{FILLER}</p><div class='search-results'><p>A found line.</p></div><div class='tags'><a href=1>one</a> <a href=2>two</a></div></div>")) == f"{FILLER.strip()}\nA found line."
    assert html_text.main_text(page(f"<div class=post><h1>Title</h1><p>intro</p><div class=body><p>{FILLER * 9}</p></div></div>")).startswith("Title\nintro\n")


def test_hosts_decide(spark):
    """On a host with pages enough, what repeats over them goes and what doesn't stays; copies of a page count once."""
    def body(k):
        menu = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul>"
        own = f"<ul><li><a href=/{k}>Paper {k}</a></li></ul>"
        slot = f"<div class='promo'><p>Offer number {k} of the shop is only here.</p></div>" if k != 4 else "<div class='feedback'><p>What readers of this one page sent in.</p></div>"
        return page(f"<div class='c{k}'>{menu}<h1>Head {k}</h1><p>{FILLER * 3} {k}</p>{own}{slot}</div>{menu}")

    want = {k: f"Head {k}\n{(FILLER * 3).strip()} {k}\nPaper {k}" + ("\nWhat readers of this one page sent in." if k == 4 else "") for k in range(6)}
    rows = [(k, f"http://h.example/{k}", body(k)) for k in range(6)] + [(100 + k, f"http://h.example/copy{k}", body(5)) for k in range(20)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: got[k] for k in range(6)} == want and all(got[100 + k] == want[5] for k in range(20))


def plain_extractor(source):
    """An extractor of its own for well-formed pages: the standard library's parser, a set of tags and class words to skip."""
    from html.parser import HTMLParser

    skip_tags, skip_words = {"nav", "footer", "aside", "form", "script", "style", "head"}, {"ad", "sidebar", "comments", "cookie", "share"}
    blocks = {"p", "div", "h1", "h2", "li", "ul", "td", "tr", "table", "article", "section", "blockquote", "br-"}

    class Reader(HTMLParser):
        out, words, skipping, stack = [""], None, 0, ()

        def handle_starttag(self, tag, attrs):
            if tag in ("br", "img", "input", "meta", "hr"):
                self.out[-1] += " "
                return
            bad = tag in skip_tags or bool(skip_words & set((dict(attrs).get("class") or "").split()))
            self.stack = (*self.stack, bad)
            if tag in blocks:
                self.out.append("")

        def handle_endtag(self, tag):
            self.stack = self.stack[:-1]
            if tag in blocks:
                self.out.append("")

        def handle_data(self, data):
            if not any(self.stack):
                self.out[-1] += data

    reader = Reader()
    reader.out = [""]
    reader.feed(source)
    return "\n".join(b for b in (" ".join(x.split()) for x in reader.out) if b)


LAYOUTS = [
    "<nav><ul><li><a href=1>Home</a></li></ul></nav><div class='wrap'><div class='post'><h1>{t}</h1><p>{a}</p><p>{b}</p></div><div class='sidebar'><p>{c}</p></div></div><footer>f</footer>",
    "<div class='cookie'>We use {c}</div><main><section><h2>{t}</h2><p>{a} <b>{c}</b></p><blockquote>{b}</blockquote></section></main><div class='comments'><p>{c}</p></div>",
    "<div id='outer'><div class='ad'>{c}</div><table><tr><td><p>{a}</p><ul><li>{t}</li><li>{b}</li></ul></td></tr></table></div>",
    "<article><h1>{t}</h1><div class='share'>{c}</div><p>{a}</p><section><p>{b}</p></section><form>{c}</form></article><aside>{c}</aside>",
    "<div class='content'><h1>{t}</h1><p>{a}<br>{b}</p><ul><li><a href='2'>{t}</a></li></ul></div>",
]


def test_layouts_against_another_extractor(spark, sample):
    texts = [" ".join(t.split())[:400].replace("<", " ").replace("&", "and") for _, t in sample if t and len(t) > 500][:25]
    rows, want = [], {}
    for h, layout in enumerate(LAYOUTS):
        for k in range(5):
            t, a, b, c = (texts[(h * 5 + k + j) % len(texts)] for j in range(4))
            source = page(layout.format(t=t[:40], a=a, b=b[:300], c=c[:30]))
            rows.append((h * 10 + k, f"https://host{h}.example/{k}", source))
            want[h * 10 + k] = plain_extractor(source)
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_deep_and_long_pages():
    began = time.monotonic()
    assert html_text.main_text("<div>" * 100_000 + "<p>deep text</p>") == "deep text"
    assert html_text.main_text("<div><b>" * 50_000 + "<p>x</b></i></p>" * 1000 + "end").endswith("end")
    assert html_text.main_text("<article>" + "<p>a line</p>" * 100_000 + "</article>").count("\n") == 99_999
    assert html_text.main_text("<ul>" + "<li><a href=1>x</a>" * 50_000 + "</ul><p>text</p>") == "text"
    assert time.monotonic() - began < 30


def test_pages_without_or_with_one_id(spark):
    rows = [(None, None, "<p>a</p>"), (None, "http://x.y/", None), (7, "http://x.y/", "<p>b</p>"), (7, "http://x.y/", "<p>b</p>"), (7, "", "")]
    got = sorted(r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == ["", "", "a", "b", "b"]


def test_main_text_query(spark, sf_dir):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op5_main_text(spark, sf_dir).collect():
        inner = re.search(r"(?s)<article>(.*)</article>", pages[r["page_id"]])[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a'>", "</div>", "<b>", "<br>", "<", ">", "&am", "&lt;", "<!--", "-->", "<script>", "</script>", "<td>", "x", " ", "<li>", "\"", "<a href='", "é"]), max_size=25))
def test_reader_never_fails(parts):
    html_text.main_text("".join(parts), html_text.Host(("div.a", "html>body"), plenty=True))
