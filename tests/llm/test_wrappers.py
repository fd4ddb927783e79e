"""HTML extraction: wrappers against planted templates, a plain reader and their definitions."""

import html as entities
import itertools
import json
import random
import re

import pytest

from roadloom.llm import wrappers as W

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def words(r, n):
    return " ".join("".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 9))) for _ in range(n))


def plain(html):
    """The article's text of the synthetic pages by pattern."""
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"<br>|</?p>|</?h1>", body))
    return " ".join(b for b in blocks if b)


def blog(r):
    """(html, main text): an article in an article element, with a list, quotes and comments below it."""
    title, paras = words(r, 6), [words(r, r.randint(5, 40)) for _ in range(r.randint(1, 6))]
    quote, items = words(r, 8), [words(r, 4) for _ in range(r.randint(2, 5))]
    body, main = [], [title]
    for k, p in enumerate(paras):
        body.append(f"<p>{p[:10]}<em>{p[10:]}</em></p>")
        main.append(p)
        if k == 1:
            body.append(f"<blockquote><p>{quote}</p></blockquote>")
            main.append(quote)
        if k == 2:
            body.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
            main += items
    comments = "".join(f'<li class="comment"><p>{words(r, 12)}</p></li>' for _ in range(r.randint(0, 4)))
    page = f"""<!doctype html><html><head><title>{title}</title><script>if (a < b) document.write("<p>no</p>")</script></head>
    <body class="single sidebar-right"><header id="masthead"><a href="/">Site</a><nav class=menu><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav></header>
    <div id="cookie-notice">We use cookies &amp; more.</div><div class="wrap"><article class="post"><header class="entry-header"><h1>{title}</h1><span class="meta">by</span></header>
    {"".join(body)}<div class="share-buttons"><a>Share</a></div></article>
    <section id="comments"><h2>Comments</h2><ol>{comments}</ol><form><p>Leave a reply<textarea>x</textarea></form></section></div>
    <aside><h3>Popular</h3><p>{words(r, 9)}</aside><footer><p>&copy; 2020</footer></body></html>"""
    return page, " ".join(main)


def plain_divs(r):
    """No roles and no article: the main part is known by its text."""
    title, paras = words(r, 6), [words(r, r.randint(30, 60)) for _ in range(r.randint(2, 6))]
    menu = "".join(f"<li><a href='/{k}'>{words(r, 1)}</a></li>" for k in range(r.randint(3, 7)))
    page = f"<html><body><div><ul>{menu}</ul></div><div><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paras) + "<address>Follow us for more</address></div><div><ul><li><a href=x>Imprint</a></ul></div></body></html>"
    return page, " ".join([title, *paras])


def test_templates(spark):
    r, rows, want = random.Random(3), [], {}
    for n, (host, make, count) in enumerate((("blog.example.com", blog, 60), ("divs.example.com", plain_divs, 12), ("one.example.com", blog, 1))):
        for k in range(count):
            page, text = make(r)
            rows.append((1000 * n + k, f"https://u@{host}:80/{k}?x=1", page))
            want[1000 * n + k] = text
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    got = {x.page_id: x for x in W.extract(pages).collect()}
    assert {k: v.text for k, v in got.items()} == want and all(v.n_chars == len(v.text) for v in got.values())
    seen = dict(spark.createDataFrame(W.learn(pages).collect()).collect())
    assert sorted(seen) == ["blog.example.com", "divs.example.com", "one.example.com"]
    shown = W.render(json.loads(seen["blog.example.com"]))
    assert "( <p> # </p> )+" in shown and "<blockquote>" in shown and "( <li.comment>" in shown


def test_all_pages_of_the_table(spark):
    rows = W.query(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text) for r in rows)


def test_join_of_masks_gives_the_same(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = W.expressions(pages)
    table = W.masks(found, W.infer(found))
    a, b = W._joined(pages, table), W.extract(pages)
    assert a.columns == b.columns and sorted(a.collect()) == sorted(b.collect())


def test_many_expressions_are_folded_in_rounds(spark):
    """More expressions than one group folds: the wrapper covers all, whatever the order of rows."""
    r, rows, tags = random.Random(1), [], ["h2", "p", "ul", "pre", "blockquote", "table", "dl"]
    for k in range(300):
        body = "".join({"ul": "<ul><li>{0}</ul>", "table": "<table><tr><td>{0}</table>", "dl": "<dl><dt>{0}<dd>{0}</dl>"}.get(t, "<" + t + ">{0}</" + t + ">").format(words(r, 5)) for t in (r.choice(tags) for _ in range(r.randint(1, 9))))
        rows.append((k, "http://a.example/x", f"<html><body><nav><a href=x>menu</a></nav><main>{body}</main><footer>f</footer></body></html>"))
    one = spark.createDataFrame(rows, PAGES).repartition(4)
    two = spark.createDataFrame(rows[::-1], PAGES).repartition(7)
    assert W.expressions(one).count() > W.FAN_IN * 2
    assert W.learn(one).collect() == W.learn(two).collect()
    got = {x.page_id: x.text for x in W.extract(one).collect()}
    want = {k: " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", re.search("<main>(.*)</main>", h)[1])).split()) for k, _, h in rows}
    assert got == want


def test_alignment_against_brute_force():
    r = random.Random(0)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 8))] for _ in range(2))
        best = max(len(x) for n in range(len(a) + 1) for x in itertools.combinations(a, n) if subsequence(x, b))
        got = W.common(a, b)
        assert len(got) == best and all(a[i] == b[j] for i, j in got)
        assert all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:], strict=False))


def subsequence(x, b):
    it = iter(b)
    return all(c in it for c in x)


def test_expressions_match_what_they_came_from():
    """The inferred expression, as a regular expression over keys, accepts every sequence that it was inferred from."""
    r = random.Random(5)
    for _ in range(200):
        kinds, pages = "abcd"[: r.randint(1, 4)], []
        for _ in range(r.randint(1, 6)):
            pages.append([r.choice(kinds) for _ in range(r.randint(0, 7))])
        exprs = [W.expression([[k, 0, []] for k in p]) for p in pages]
        out = exprs[0]
        for e in exprs[1:]:
            out = W.align(out, e, True)
        for p, e in zip(pages, exprs, strict=True):
            assert re.fullmatch(pattern(e), "".join(p)), (p, W.render(e))
            assert re.fullmatch(pattern(out), "".join(p)), (p, W.render(out), pages)


def pattern(items):
    return "".join("(?:" + (pattern(c) if k == "" else k) + ")" + ("", "?", "+", "*")[q] for k, q, c in items)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a &amp; b &lt;c&gt; &#233; &eacute; &nbsp;x", "a & b <c> é é x"),
        ("<p>one<p>two<br>three<b>four</b>", "one two threefour"),
        ("<article><p>in</p></article><p>out</p>", "in"),
        ("1 < 2 <3 and a<b", "1 < 2 <3 and a"),
        ("<p title='a > b'>x</p><p class=\"y>z\">w", "x w"),
        ("<p>a<!-- <p>no</p> -->b<!-->c<?php x ?>d<![CDATA[e]]>f", "abcdf"),
        ("<script>x</script ><style>y</style><p>z</p><script>never ends <p>no", "z"),
        ("<p>a<span class='ad'>buy</span>b", "a b"),
        ("<div hidden>x</div><div style='display: none'>y</div><p>z</p>", "z"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t d u e"),
        ("", ""),
        (None, ""),
        ("   \n ", ""),
        ("<nav>menu</nav><footer>f</footer>", ""),
        ("<p>end tag is cut off</p", "end tag is cut off"),
        ("<article><header><h1>T</h1><p>by me</p></header><p>x</p><footer>f</footer></article>", "T x"),
    ],
)
def test_reading(html, text):
    items, _, _, runs = W._page(html)
    assert W.main_text(items, runs, None) == text


def test_deep_and_long_pages():
    n = 3000
    items, _, _, runs = W._page("<div>" * n + "deep" + "</div>" * n + "<p>after</p>")
    assert W.main_text(items, runs, None) == "deep after"
    items, _, _, runs = W._page("<article>" + "<p>x</p>" * 50_000 + "</article>")
    assert W.main_text(items, runs, None) == " ".join("x" * 50_000) and W.render(items) == "<article> ( <p> # </p> )+ </article>"
    items, _, _, runs = W._page("<article>" + "".join(f"<h{1 + k % 6}>x</h{1 + k % 6}><p>y</p>" * (1 + k % 3) for k in range(5000)) + "</article>")
    assert len(W.main_text(items, runs, None)) == 2 * len(runs) - 1
    assert W._page("<a href='" * 20_000)[3] == []


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, host string, shape_id string, mask string, page string"
    rows = [(1, None, None, "mine", 1, "h", "s", "m", "p"), (None, "nonsense", "<p>x</p>", "mine", 1, "h", "s", "m", "p"), (2, "http://a/", "<p>y</p>", None, None, None, None, None, None)]
    rows += [(2, "http://a/", "<p>y</p>", None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, schema).repartition(3)
    got = W.extract(pages)
    assert got.columns == ["page_id", "url", "html", "host", "shape_id", "mask", "page", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars, r.host or "") for r in got.collect()) == [(0, "x", 1, "h"), (1, "", 0, "h"), (2, "y", 1, ""), (2, "y", 1, "")]
    found = W.expressions(pages)
    assert sorted(map(str, W._joined(pages, W.masks(found, W.infer(found))).collect())) == sorted(map(str, got.collect()))
    empty = spark.createDataFrame([], schema)
    assert W.extract(empty).count() == 0 and W.learn(empty).count() == 0
