"""Goldens of the page operators."""

import re

import pytest
from pyspark.sql import functions as F

from pageframe.functions import text as T
from pageframe.operators import main_content as C
from pageframe.operators import markdown as M
from pageframe.operators import metadata as D
from pageframe.operators import sanitize as S
from pageframe.operators import tokens as TK
from pageframe.plans import pages as P

MARKDOWN = {
    "<h1>A</h1><h3>B</h3>": "# A\n\n### B",
    "<p>a<p>b": "a\n\nb",
    "<ul><li>a<li>b <ol><li>c</li><li>d</li></ol></li><li>e</li></ul>":
        "-   a\n-   b\n    1.  c\n    2.  d\n-   e",
    "<ol><li>x</li></ol><p>t</p><ol><li>y</li></ol>": "1.  x\n\nt\n\n1.  y",
    "<ul><li><p>a</p><p>b</p></li></ul>": "-   a\n\n    b",
    "<pre><code>x = 1\n  *y*</code></pre>": "```\nx = 1\n  *y*\n```",
    "<p>use <code>a*b</code> now</p>": "use `a*b` now",
    "<blockquote><p>q1</p><p>q2</p></blockquote>": "> q1\n>\n> q2",
    "<p><em>a</em> <strong>b</strong> <i>c</i> <b>d</b></p>": "*a* **b** *c* **d**",
    "<p>a <b> b </b>c</p>": "a **b** c",
    "<p><b></b>x<em> </em>y</p>": "x y",
    "<p><b>open<p>next": "**open**\n\n**next**",  # as a parser opens it again
    "<p>x</b> y</p>": "x y",
    '<p><a href="/z">t</a></p>': "[t](https://ex.com/z)",
    "<p><a>t</a></p>": "t",
    "<p>a<br>b</p><hr><p>c</p>": "a\nb\n\n* * *\n\nc",
    "<table><tr><th>h</th></tr><tr><td> a<br>b </td><td></td></tr></table>": "h |\n\n a b |   |",
    "<p>x</p><img src=a><picture><source></picture>": "x",
    "<p>*a* _b_ [c] `d` \\</p><p># h</p><p>1. n</p><p>- m</p><p>&gt; q</p>":
        "\\*a\\* \\_b\\_ \\[c\\] \\`d\\` \\\\\n\n\\# h\n\n1\\. n\n\n\\- m\n\n\\> q",
    "<p>a &amp; b &lt; &#65; &#x42; &copy; &nope; &</p>": "a & b < A B © &nope; &",
    "<div>m1</div><div>m2</div>": "m1m2",
    "<title>T</title><p>x</p>": "T\n\nx",
    '<p title="a > b">x</p>': "x",
    "<script>var t='</p>';</script><!-- <p>no</p> --><p>x</p><style>p{}</style>": "x",
    "<p>1 < 2</p>": "1 < 2",
    "": "",
}


def test_markdown_goldens(pages):
    htmls = list(MARKDOWN)
    out = M.to_markdown(S.sanitized_tokens(TK.page_tokens(pages(*htmls), carry=F.lit(1))))
    got = {htmls[r["page_id"]]: r["markdown"] for r in out.collect()}
    for html, want in MARKDOWN.items():
        assert got[html] == want, html


DROPPED = {
    "<p>a</p><nav><ul><li>x<li>y</ul></nav><p>b</p>": "<p>a</p><p>b</p>",
    '<div class="left-sidebar"><div>x</div></div><p>b</p>': "<p>b</p>",
    '<div class="ad">kept</div>': "kept",
    '<p class="thread-x">gone</p><p>b</p>': "<p>b</p>",
    '<div role="banner">x</div><div aria-live>y</div><div role="main">z</div>': "z",
    '<span class="share">x<p>b</p>': "",  # never closed: it holds the rest
    "<aside>x<p>to the end": "",
    '<p id="ad-1">x</p>y': "y",
    "<figure><img><figcaption>A <i>c</i></figcaption></figure><figure><img></figure>z": "<p>A <i>c</i></p>z",
    '<p style="x" class="c">a <a href="b" target="t">l</a> <span>s</span></p>':
        '<p>a <a href="https://ex.com/d/b">l</a> s</p>',
    '<p title="class=share">stays</p>': "<p>stays</p>",
    "<form><input><p>x</p></form>y": "y",
}


def test_sanitize_goldens(pages):
    htmls = list(DROPPED)
    out = S.sanitized_html(TK.page_tokens(pages(*htmls)))
    got = {r["page_id"]: r["html"] for r in out.collect()}
    for i, (html, want) in enumerate(DROPPED.items()):
        assert got.get(i, "") == want, html


def test_consent_is_optional(pages):
    html = '<p>a</p><div class="gdpr-box">we use cookies</div>'
    kept = P.extract_pages(pages(html), only_main=False).head()["markdown"]
    gone = P.extract_pages(pages(html), only_main=False, consent=True).head()["markdown"]
    assert "cookies" in kept and "cookies" not in gone


def test_main_content_beats_boilerplate(pages):
    body = "<p>" + "word, " * 60 + "</p>"
    html = (
        "<body><div class='x'><p>menu, a, b</p></div><article>" + body * 3 + "</article>"
        "<div><p>foot, note</p></div></body>"
    )
    out = P.extract_pages(pages(html, "<p>no container</p>")).orderBy("page_id").collect()
    assert "menu" not in out[0]["markdown"] and "foot" not in out[0]["markdown"]
    assert out[1]["markdown"] == "no container"


def test_nested_containers_spread_at_most_five_levels(pages):
    deep = "<body>" + "<div>" * 40 + "<p>text</p>" * 3 + "</div>" * 40 + "</body>"
    runs = M.text_runs(M.annotate(S.sanitized_tokens(TK.page_tokens(pages(deep)))))
    row = C.main_content(runs).head()
    assert row["n_runs"] == 3 and row["main_score"] == 3 * 60


def test_metadata(pages):
    html = (
        '<html lang="de"><head><title> A\n &amp; B </title><meta name="Description" content="one">'
        '<meta name="description" content="two"><meta property="og:locale" content="en">'
        '<meta name=author content="X"><meta content="name=none" itemprop="keywords">'
        '<link rel="canonical" href="/c"><link rel="shortcut icon" href="i.ico"></head></html>'
    )
    m = D.page_metadata(pages(html, "<p>x</p>")).orderBy("page_id").collect()
    first = m[0]["metadata"]
    assert (first["title"], first["description"], first["language"]) == ("A & B", "two", "de")
    assert (first["author"], first["keywords"]) == ("X", "name=none")
    assert (first["canonicalURL"], first["favicon"]) == ("/c", "https://ex.com/d/i.ico")
    assert (m[1]["metadata"]["title"], m[1]["metadata"]["statusCode"]) == ("", 200)


def test_links_are_unique_and_ordered(pages):
    html = '<a href="/b">1</a><a href=/a>2</a><a href="/b">3</a><a href="mailto:x@y">4</a><a name="n">5</a>'
    out = D.link_edges(pages(html)).orderBy("link_pos").collect()
    assert [(r["link_pos"], r["link"]) for r in out] == [(0, "https://ex.com/b"), (1, "https://ex.com/a")]


def test_formats(pages):
    df = pages("<article><p>hello</p></article>")
    assert "html" not in P.extract_pages(df).columns
    full = P.extract_pages(df, P.ALL_FORMATS)
    assert P.select_formats(full, ["links"]).columns == ["page_id", "url", "markdown", "links", "metadata"]
    row = P.select_formats(full, F.array(F.lit("html"))).head()
    assert row["html"] == "<p>hello</p>" and row["rawHtml"] is None and row["markdown"] == "hello"


def test_excerpt_when_no_description(pages):
    row = P.extract_pages(pages("<article><h1>t</h1><p>First <b>one</b>.</p><p>x</p></article>")).head()
    assert row["metadata"]["description"] == "First one."


def test_text_rules(ask):
    assert ask(T.normalize_md, ["a  \r\n\n\n\nb "]) == ["a\n\nb"]
    assert ask(lambda c: T.truncate_md(c, 4), ["0123456789", "0123"]) == ["0123\n\n[…truncated]", "0123"]
    assert ask(lambda c: T.truncate_md(c, 0), ["0123456789"]) == ["0123456789"]
    noisy = ["a \n\n\n b\t\n", "\n\n", "x"]
    once = ask(T.normalize_md, noisy)
    assert ask(T.normalize_md, once) == once


def test_one_exchange(pages):
    plan = P.extract_pages(pages("<p>x</p>"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(page_id", plan)) == 1
    assert "SinglePartition" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("n", [3000])
def test_large_page_is_whole(pages, n):
    html = "<article>" + "".join(f"<p>line {i}, x</p>" for i in range(n)) + "</article>"
    md = P.extract_pages(pages(html)).head()["markdown"]
    assert md.count("\n\n") == n - 1 and md.endswith(f"line {n - 1}, x")
