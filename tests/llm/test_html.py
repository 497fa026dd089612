"""Main text: hand-made pages, a plain reader of generated ones, and templates of hosts without articles."""

import html
import random
import re
import time

import pytest

from quirelight.llm.html_extract import Page, article_slots, extract_main_text, nested


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ('<body><header><h1>Site</h1></header><div id="sidebar">x</div><div>Real <i>te</i>xt<div class="comments"><p>c1<p>c2</div></div><p>a<br>b &lt;c&gt; 1 < 2', "Real text\na b <c> 1 < 2"),
        ('<article><header><h1>T</h1></header><p>x<aside>no</aside><p>y<section class="comments"><article class="comment">z</article></section><form>f</form></article><script>var a="<p>no"</script>', "T\nx\ny"),
        ('<p class="cookie-notice">n<p>yes<ul><li>a<li>b</ul>tail <span class="ad">buy</span> on', "yes\na\nb\ntail on"),
        ('<article><p>one <a href="x>y">two</a></p>text<ul class="share"><li>no</ul>tail</article>', "one two\ntext\ntail"),
        ("<main><p>a&nbsp;&amp;\n b</p></main><p>no", "a & b"),
        ("<p>cut <b", "cut"),
        ("<p>kept<!-- <p>no</p>", "kept"),
        ("<p>kept<script>if (a</b) {}", "kept"),
        ("just text", "just text"),
    ],
)
def test_pages(page, text):
    assert Page(page).main_text(frozenset()) == text


def test_classes_nest():
    token = lambda t, around, vector, support: {"token": t, "around": around, "vector": vector, "support": support}
    found = nested([token(1, 0, 5, 9), token(2, 1, 5, 9), token(3, 2, 7, 6), token(4, 3, 8, 6), token(5, 99, 9, 9)])
    assert found == [1, 2, 3, 4]


def test_templates_of_a_host(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, want = [], {}
    for i in range(40):
        own = [" ".join(word() for _ in range(6)) for _ in range(rng.randint(1, 5))]
        body = "".join(f"<p>{html.escape(t)}</p>" for t in own)
        rows.append((i, f"http://Plain.example/{i}", f'<body><div class="top"><p>All the news</p><p>Since 1900</p></div><div class="x">{body}</div><p>Imprint here</p></body>', "h"))
        want[i] = "\n".join(own)
    for i in range(40, 80):  # copies of one page with an article keep it
        rows.append((i, "http://copies.example/", "<nav>m</nav><article><h1>A</h1><p>Same text.</p></article>", "h"))
        want[i] = "A\nSame text."
    rows += [(None, None, None, "h"), (90, "no url", "", "h")]
    want |= {None: "", 90: ""}
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(6)
    got = {r.id: r.text for r in extract_main_text(df).collect()}
    assert got == want
    assert extract_main_text(df.limit(0)).count() == 0


def test_generated_pages(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(50):
        words = lambda n: " ".join(rng.choice(["a", "&", "<b", "é", "x;", "&amp"]) for _ in range(n))
        paragraphs = [words(rng.randint(1, 9)) for _ in range(4)]
        body = "".join(f"<p>{html.escape(p)}" + rng.choice(["</p>", "<br>", "\n"]) for p in paragraphs)
        rows.append((i, f"https://g.example/{i}", f'<html><head><title>t</title></head><body><nav><a href="/">n</a></nav><article>{body}</article><footer>f</footer>'))
        want[i] = "\n".join(re.sub(r"\s+", " ", p).strip() for p in paragraphs)
    got = {r.id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_templates_inside_articles(spark):
    box = '<div class="zz"><p>Read more with us</p></div>'
    rows, want = [], {}
    for i in range(60):  # one host, four layouts of a quarter each, none on 30 % of it
        own = f"Own text {i}"
        rows.append((i, f"http://four.example/{i}", f'<html><body class="t{i % 4}"><article><h1>{own}</h1>{box}<p>Desk {i % 4}</p><p>{own}</p></article></body></html>'))
        want[i] = f"{own}\n{own}"
    for i in range(60, 100):  # no article, layouts of an eighth
        rows.append((i, f"http://plain.example/{i}", f'<html><body class="t{i % 8}"><div class="top"><p>Paper {i % 8}</p></div><p>Own {i}</p></body></html>'))
        want[i] = f"Own {i}"
    for i in range(100, 120):  # equal pages say nothing about a template, nor do twice as many take one away
        rows.append((i, f"http://plain.example/{i}", "<html><body><div class='u'><p>Same page</p></div></body></html>"))
        want[i] = "Same page"
    for i in range(200, 212):
        text = f'<html><body><div class="top"><p>The site</p></div><p>Own {i}</p></body></html>'
        rows += [(i, "http://twice.example/", text)] * 2
        want[i] = f"Own {i}"
    found = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert len(found) == len(rows) and {r.id: r.text for r in found} == want


def test_slots_without_names(spark):
    """Menu, teaser and foot have names that say nothing; only the slots tell them from the article."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for i in range(30):
        title, own = text(4), [text(rng.randint(12, 40)) for _ in range(rng.randint(1, 6))]
        menu = "".join(f'<li><a href="/{k}">{text(2)}</a></li>' for k in range(8))
        body = "".join(f"<p>{p}</p>" for p in own)
        for host, frame in (("bare", f'<div class="k1"><h1>{title}</h1><div class="k2">{body}</div></div>'), ("named", f"<article><p>{title}</p><div>{body}</div></article>")):
            html = f'<html><body><div class="k0"><ul>{menu}</ul></div><div class="k3"><p>{text(6)}</p></div>{frame}<div class="k4">{text(5)}</div></body></html>'
            rows.append((len(rows), f"http://{host}.example/{i}", html, "t", 1))
            want[len(rows) - 1] = "\n".join([title, *own])
    rows.append((900, "http://bare.example/again", rows[0][2], "t", 1))  # a copy of a page
    want[900] = want[0]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, template int").repartition(3)
    assert {r.id: r.text for r in extract_main_text(df).collect()} == want
    # without a template, the bare pages hold all
    assert all(Page(r[2]).main_text(frozenset()) != want[r[0]] for r in rows if "bare" in r[1])


def test_a_long_page(spark):
    own = [f"line {k} of it" for k in range(20_000)]
    html = "<nav>m</nav><article>" + "".join(f"<p>{t}</p>" for t in own) + "</article>"
    rows = [(1, "http://x.example/", html), (1, "http://x.example/", html)]
    found = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in found] == ["\n".join(own)] * 2


def test_deep_nesting_is_read_in_linear_time():
    began = time.perf_counter()
    for raw in ("<div>x" * 100_000, "<div><h1>x" * 50_000, "<div>" * 100_000 + "</p></span></b>" * 30_000, "<p>a</div>" * 100_000):
        page = Page(raw)
        page.main_text(set(), {page.elements[-1][0]})
    assert time.perf_counter() - began < 20
    tokens = [{"token": k + 1, "around": k, "vector": 7, "support": 3, "kind": 0, "chars": 5, "around_chars": 6, "most": 1, "traits": 0} for k in range(30_000)]
    tokens += [{**t, "token": -t["token"], "around": t["token"], "kind": 1, "vector": 100 + t["token"]} for t in tokens]
    kept = set(nested(tokens))
    assert len(kept) == 60_000
    article_slots(tokens, kept)
    assert time.perf_counter() - began < 30
