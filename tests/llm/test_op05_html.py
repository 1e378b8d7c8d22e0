import html
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from gneiss.llm import op05_html as H

NAV = '<nav class="x"><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav>'


def page(body):
    return f"<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{NAV}<p>{body}</p><footer>All &copy;</footer></body></html>"


def pages(spark, rows, schema="page_id long, url string, html string"):
    return spark.createDataFrame(rows, schema)


def test_templates_go_and_text_stays(spark):
    rows = [(i, f"http://A.example/{i}", page(f"Story {i} &amp; more")) for i in range(10)] + [(100, "http://b.example/", page("Other"))]
    got = {r.page_id: (r.text, r.removed) for r in H.extract_text(pages(spark, rows)).collect()}
    assert all(got[i] == (f"Story {i} & more", 2) for i in range(10))  # navigation and footer
    assert got[100] == ("Home\nB\nOther\nAll ©", 0)


def test_templates_of_few_pages_go_on_large_hosts(spark):
    # 150 kinds of navigation on 4 pages each, below 2% of the host's 603 pages, and one on 3 pages
    kinds = [i // 4 for i in range(600)] + [999] * 3
    rows = [(i, "http://a.example/", f"<html><body><nav><a>Menu {k}</a></nav><p>Story {i}</p></body></html>") for i, k in enumerate(kinds)]
    got = {r.page_id: (r.text, r.removed) for r in H.extract_text(pages(spark, rows + rows[:1])).collect()}
    assert all(got[i] == ((f"Story {i}", 1) if k < 999 else (f"Menu 999\nStory {i}", 0)) for i, k in enumerate(kinds))


def brute(rows, p=H.TemplateParams()):
    n = defaultdict(Counter)
    for host, source in rows:
        n[host].update(H.subtrees(source or ""))
    return {(h, s, c) for h in n for s, c in n[h].items() if c >= p.min_pages}


def test_counts_equal_brute_force(spark):
    rows = [(i % 50, f"http://h{i % 3}/", page(f"S {i % 7}")) for i in range(60)] + [(None, None, page("x"))] * 5 + [(1, "broken", None)]
    want = brute([(f"h{i % 3}", page(f"S {i % 7}")) for i in range(60)] + [("", page("x"))] * 5 + [("", None)])
    assert {tuple(r) for r in H.templates(pages(spark, rows)).collect()} == want


def test_edges(spark):
    rows = [(1, "u", None, 1), (2, "u", "", 2), (None, None, "plain", 3), (4, "u", "<p>a<p>b</div>c<br/>d<!-- x", 4), (5, "u", "x" * 200_000, 5)]
    got = H.extract_text(pages(spark, rows, "page_id long, url string, html string, text int"))
    assert got.columns == ["page_id", "url", "text", "_text", "removed"]
    text = {r.page_id: r._text for r in got.collect()}
    assert text == {1: None, 2: "", None: "plain", 4: "a\nbc\nd", 5: "x" * 200_000}
    assert H.extract_text(pages(spark, [])).count() == 0


def test_parser():
    elements, _ = H.parse("<div><p>a</p><P >a</p></div>")
    assert len({h for h, *_ in elements}) == 2  # both paragraphs are equal
    assert H.extract("<ul><li>a<li>b<ul><li>c</ul></ul><pre>x  y</pre>", frozenset())[0] == "a\nb\nc\nx y"
    assert H.extract("<style>p{}</style><textarea><b></textarea>t", frozenset())[0] == "<b>t"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert H.extract(deep, frozenset())[0] == "x"


def test_hosts(spark):
    urls = ["http://A.b:80/x", "https://u@h.c?q", "ftp://x", "rel/y", None, ""]
    x = pages(spark, [(i, u, "") for i, u in enumerate(urls)]).orderBy("page_id").select(H.host("url"))
    assert [r[0] for r in x.collect()] == ["a.b", "h.c", "x", "", "", ""]


class Tree(HTMLParser):
    """A page as nested lists [tag, attributes, children], by the standard library."""

    def __init__(self, source):
        super().__init__(convert_charrefs=False)
        self.root = ["", (), []]
        self.stack = [self.root]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, tuple(sorted((k, v or "") for k, v in attrs)), []]
        self.stack[-1][2].append(node)
        if tag not in ("br", "img"):
            self.stack.append(node)

    def handle_endtag(self, tag):
        assert self.stack.pop()[0] == tag

    def handle_data(self, data):
        self.stack[-1][2].append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


SILENT, INLINE = ("script", "style", "head"), ("a", "b", "span", "img")


def canonical(node):
    parts, run = [], ""
    for c in [*node[2], None]:
        if isinstance(c, str):
            run += c
            continue
        if run:
            parts.append(" ".join(run.split()))
            run = ""
        if c is not None:
            parts.append(canonical(c))
    return (node[0], node[1], tuple(parts))


def visible(node, silent=False):
    silent = silent or node[0] in SILENT
    return any(visible(c, silent) if isinstance(c, list) else bool(c.strip()) and not silent for c in node[2])


def below(node):
    for c in node[2]:
        if isinstance(c, list):
            yield c
            yield from below(c)


def text_of(node, known, removed, silent=False):
    silent = silent or node[0] in SILENT
    out = []
    for c in node[2]:
        if isinstance(c, str):
            out.append("" if silent else "".join(" " if x.isspace() else x for x in html.unescape(c)))
        elif canonical(c) in known and visible(c):
            removed.append(1)
            out.append("" if c[0] in INLINE else "\n")
        else:
            edge = "" if c[0] in INLINE or c[0] in ("script", "style", "head") else "\n"
            out += [edge, text_of(c, known, removed, silent), edge]
    return "".join(out)


def random_element(r, depth):
    tag = str(r.choice(["div", "p", "span", "b", "a", "section", "h2", "td"]))
    attrs = "".join(f' {k}={q}{v}{q}' for k, v, q in [("class", "x>y", '"'), ("ID", "it's", '"'), ("href", "/a", "'")] if r.random() < 0.3)
    inner = ["".join(r.choice(["word ", "Тест ", "a&amp;b ", "&#233;t&eacute; ", "x\n\t y "], r.integers(0, 4)))]
    if depth and tag not in ("p", "h2"):
        for _ in range(r.integers(0, 4)):
            inner += [random_element(r, depth - 1), str(r.choice(["", " tail ", "<!-- note --><br>", "<script>if (a<b) x='</p>';</script>"]))]
    return f"<{tag}{attrs}>{''.join(inner)}</{tag}>"


def test_extraction_equals_an_independent_parser(spark):
    r = np.random.default_rng(6)
    shared = [random_element(r, 2) for _ in range(8)]
    rows = []
    for i in range(80):
        parts = [shared[k] for k in r.integers(0, 8, 3)] + [random_element(r, 2) for _ in range(3)]
        rows.append((i, f"http://h{i % 4 if i < 60 else 0}.example/{i}", f"<!DOCTYPE html><html><head><title>T{i}</title></head><body>" + "".join(str(x) for x in r.permutation(parts)) + "</body></html>"))
    trees = {i: Tree(source).root for i, _, source in rows}
    n = defaultdict(Counter)
    for i, url, _ in rows:
        n[url.split("/")[2]].update({canonical(e) for e in below(trees[i]) if visible(e)})
    got = {x.page_id: (x.text, x.removed) for x in H.extract_text(pages(spark, rows)).collect()}
    for i, url, _ in rows:
        removed = []
        text = text_of(trees[i], {c for c, k in n[url.split("/")[2]].items() if k >= 4}, removed)
        lines = (" ".join(x.split()) for x in text.split("\n"))
        assert got[i] == ("\n".join(x for x in lines if x), len(removed)), rows[i]
    assert sum(n for _, n in got.values()) > 100


BROKEN = {
    "open tags": "<a ", "open quotes": '<a "', "quotes and an end": "<a b=\"<c d='", "stray ends": "</b>", "ends of others": "<i></b>", "declarations": "<!", "comments": "<!--", "scripts": "<script>",
    "nests": "<div>", "lists": "<li><ul>", "angles": "<<<>", "paragraphs": "<p><b>", "spaces": "<a" + " " * 50, "attributes": "<a x=", "mixed quotes": "<a \"'",
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_linear_time(name):
    for tail in ("", ">", "'>", '">', "\"'>"):
        source = BROKEN[name] * (1_000_000 // len(BROKEN[name])) + tail
        began = time.process_time()
        H.parse(source)
        assert time.process_time() - began < 15


def test_stray_ends_in_deep_nests():
    began = time.process_time()
    H.parse("<div>" * 100_000 + "</b>" * 100_000 + "x")
    assert time.process_time() - began < 15


def test_tags_that_never_end_are_text():
    assert H.extract("a <b c", frozenset())[0] == "a <b c" and H.extract('a <b "c> d <i>e</i>', frozenset())[0] == 'a <b "c> d e'
    assert H.extract("x <a title='>'>y</a> z", frozenset())[0] == "x y z" and H.extract("1 <2 > 3", frozenset())[0] == "1 <2 > 3"
