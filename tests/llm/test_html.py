import random
import re
import time
from html.parser import HTMLParser

import pytest

from tallyspark.llm import html as html_module
from tallyspark.llm.html import BLOCK, IMPLIED, Node, Together, matches, render, render_pages, selector_of

CASES = [
    (None, ""),
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    ("<h1>Head</h1><p>a <b>b</b>c<br>d</p>", "Head\n\na bc\nd"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>x</li><li value=7>y</li><li>z</ol>", "3. x\n7. y\n8. z"),
    ("<table><tr><th>name<th>n<tr><td>a<td>10<tr><td>longer<td>7</table>", "name    n\na       10\nlonger  7"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table>stray<tr><td>x</table>", "stray\n\nx"),
    ("<pre>a  b\n  c\n</pre>d", "a  b\n  c\n\nd"),
    ("<p hidden>no</p><p style='display: none'>no</p>yes", "yes"),
    ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span></div>", "yes"),
    ("<style>.ad, #x{display:none} p.q{visibility:hidden}</style><p class='big ad'>no<p id=x>no<p class=q>no<p class=r>yes", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<script>var t='</p>';</script><title>t</title><!-- c -->x<noscript>n</noscript>", "x"),
    ("a &amp; b &lt;c&gt; caf&eacute; &#8364;", "a & b <c> café €"),
    ("1 < 2 <3", "1 < 2 <3"),
    ("<a title='>'>x</a><b data-a=don't>y</b>", "xy"),
    ("<p>a<p", "a"),
    ("</p></div>x</span>", "x"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<p>a<b hidden>no<p>no</b>yes", "a\n\nyes"),
    ("<textarea>typed &amp; kept</textarea><input type=hidden value=no><input value=ok>", "typed & kept\nok"),
    ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in  out"),
    ("x<script>never ends", "x"),
    ("<table><colgroup><col><tr><td>x</td></tr></table>", "x"),
    ("<table><colgroup><col><td>x</table>", "x"),
    ("<table><colgroup><tbody><tr><td>x</table>", "x"),
    ("<table><colgroup>stray<tr><td>x</table>", "stray\n\nx"),
    ("<table><colgroup><p>stray</p><tr><td>x</table>", "stray\n\nx"),
    ("<table><caption>c<tr><td>a<td>b<tr><td>longer<td>d</table>", "c\na       b\nlonger  d"),
    ("<map><p>t</p><area></map>", "t"),
    ("a<br><br>b<br>c", "a\n\nb\nc"),
    ("<pre>a  b<br>c   d</pre>", "a  b\nc   d"),
    ("<span style='display:block'>a</span><span style='display:block'>b</span>c", "a\nb\nc"),
    ("a<div style='display:inline'>b</div>c", "abc"),
    ("<input placeholder=ph><input placeholder=no value=v><textarea placeholder=pt></textarea>", "ph v\npt"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_cases(html, text):
    assert render(html) == text


class Visible(HTMLParser):
    """Brute force: every text outside elements that aren't shown, in order."""

    HIDDEN = ("script", "style", "title", "template", "datalist", "audio", "video", "canvas", "object")

    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.HIDDEN

    def handle_endtag(self, tag):
        self.skip -= tag in self.HIDDEN and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_all_words_stay():
    rng = random.Random(4)
    raw = {"xmp", "listing", "details", "dialog"}  # their text is taken otherwise
    shown = sorted((BLOCK | set(IMPLIED) | {"map", "span", "b", "i", "a", "table", "tr", "td", "p"} - {"html"}) - raw - {"colgroup", "rp", "html"}) + ["col", "area", "br", "wbr", "hr", "colgroup"] * 3
    for _ in range(600):
        parts = []
        for k in range(rng.randint(1, 40)):
            tag = rng.choice(shown)
            word = f" w{k} " if rng.random() < 0.5 else f" w{k}&amp; "
            if rng.random() < 0.1:
                tag = rng.choice(Visible.HIDDEN)
                parts.append(f"<{tag}> hidden{k} </{tag}>{word}")
            else:
                parts.append(rng.choice([f"<{tag}>", f"</{tag}>", word, f"<{tag}>{word}"]))
        html = "".join(parts)
        brute = Visible()
        brute.feed(html)
        brute.close()
        strip = lambda t: sorted(re.findall(r"w\d+&?|hidden", t))
        assert strip(render(html)) == strip(" ".join(brute.out)), html


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "x", "<ul><li>" * 20_000 + "x", "<table><tr><td>" * 20_000 + "x", "<p><b>" * 50_000 + "x", "</p>" * 100_000 + "x", "<" * 100_000 + "x", "<a b='" * 20_000 + "x", "<!--" * 50_000, "<table>" + "<tr><td>x<td>y" * 20_000, "&" * 100_000 + "x", "<td colspan=1000 rowspan=60000>x" * 3000])
def test_hostile_pages(html):
    began = time.time()
    render(html)
    assert time.time() - began < 5


def test_pages(spark):
    rows = [(1, "u", "<p>a"), (None, None, "<p>b"), (3, "u", None), (1, "u", "<p>a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as text")
    got = sorted(((r.page_id, r.text) for r in render_pages(pages).collect()), key=str)
    assert got == sorted([(1, "a"), (None, "b"), (3, ""), (1, "a")], key=str)
    assert render_pages(pages.limit(0)).collect() == []


STYLED = [
    ("@media print{.a{display:none}}", "<p class=a>x", "x"),
    ("@media (max-width: 600px){.a{display:none}}", "<p class=a>x", "x"),
    ("@media screen and (min-width:600px){.a{display:none}}", "<p class=a>x", ""),
    ("@media not print{.a{display:none}}", "<p class=a>x", ""),
    ("@import 'a;b'; @font-face{src:url(x)} .a{display:none}", "<p class=a>x", ""),
    (".a{display:none}.a{display:block}", "<p class=a>x", "x"),
    (".a{display:none}p{display:block}", "<p class=a>x", ""),
    (".a{display:none!important}#b{display:block}", "<p class=a id=b>x", ""),
    ("/* .a{display:none} */", "<p class=a>x", "x"),
    (".a{visibility:hidden}.b{visibility:visible}", "<div class=a>no<span class=b>x</span></div>", "x"),
    (".a{display:none;color:red", "<p class=a>x", ""),
    ("," .join(f".c{i}" for i in range(300)) + ",.a{display:none}", "<p class=a>x", ""),
    (".a{display:block}", "<p hidden class=a>x", "x"),
    (".a .b{display:none}", "<div class=a><p>x<p class=b>no</div><p class=b>y", "x\n\ny"),
    (".a > .b{display:none}", "<div class=a><i><b class=b>x</b></i><b class=b>no</b></div>", "x"),
    (".a>.b .c>i{display:none}", "<div class=a><p class=b><u><b class=c><i>no</i></b></u></p></div>", ""),
    (".a>.b .c>i{display:none}", "<div class=a><u><p class=b><b class=c><i>x</i></b></p></u></div>", "x"),
    ("div.a.b#c{display:none}", "<div class='b a' id=c>no</div><div class=a id=c>x", "x"),
    (".a.b{display:none}.a{display:block}", "<p class='a b'>no<p class=a>x", "x"),
    ("[data-off]{display:none}", "<p data-off>no<p data-of=1>x", "x"),
    ("p[data-x='a b' i]{display:none}p[href^=ht]{visibility:hidden}", "<p data-x='A B'>no<p data-x=a>x<p href=http>no", "x"),
    ("[class~=a],[lang|=en],[title$=z],[title*='q']{display:none}", "<p class='b a'>no<p lang=en-us>no<p title=xyz>no<p title=aqb>no<p title=a>x", "x"),
    ("body .a{display:none}html>body>.b{display:none}", "<p class=a>no<p class=b>no<p>x", "x"),
    ("html.js .a{display:none}", "<html class=js><body><p class=a>no<p>x", "x"),
    (".a + .b{display:none}.a:hover{display:none}.a::before{display:none}", "<p class=a>x<p class=b>y", "x\n\ny"),
    ("* .a{display:none}", "<p class=a>no", ""),
    (".a .b{display:none}.b{display:block}", "<div class=a><p class=b>no</div><p class=b>x", "x"),
    (".a .b{display:block}.b{display:none}", "<div class=a><p class=b>x</div><p class=b>no", "x"),
    (".a .a .a{display:none}", "<div class=a>1<div class=a>2<div class=a>no</div></div></div>", "1\n2"),
    (".a{display:block}", "<b class=a>x</b>y", "x\ny"),
    ("@media print{.a .b{display:none}}", "<p class=a><b class=b>x", "x"),
    (".a[x='}']{display:none}.b{display:none}", "<p class=b>no<p>x", "x"),
]


@pytest.mark.parametrize("css,body,text", STYLED)
def test_style_sheets(css, body, text):
    assert render(f"<style>{css}</style>{body}") == text


def test_print_sheet_svg_and_math():
    assert render("<style media=print>.a{display:none}</style><p class=a>x") == "x"
    assert render("<svg><title>t</title><defs><text>no</text></defs><path d='M0'/><text>Jan</text><text>Feb</text></svg>") == "Jan Feb"
    assert render("<math><mi>a</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>") == "a=1"


@pytest.mark.parametrize("css", ['"\\' * 50_000, "/*" * 50_000, "{" * 100_000, "@media x{" * 30_000, ".a{display:none}" * 20_000, "(" * 50_000 + "{", "".join(f".x{i} .a{{display:none}}" for i in range(20_000)), ".a" * 50_000 + "{display:none}", ".a " * 50_000 + "{display:none}", "[a=" * 50_000 + "{display:none}", ".a>" * 300 + ".a{display:none}"])
def test_hostile_sheets(css):
    began = time.time()
    render(f"<style>{css}</style>" + "<b class=a>x" * 5000)
    assert time.time() - began < 5


def test_selectors_against_trying_every_ancestor():
    def plain(parts, children, path):
        """Whether the last element fits the first part, and some ancestor that the combinator allows fits the rest."""
        if not path or not parts[0].fits(path[-1]):
            return False
        if len(parts) == 1:
            return True
        return any(plain(parts[1:], children[1:], path[:n]) for n in ([len(path) - 1] if children[0] else range(len(path))))

    rng = random.Random(8)
    seen = set()
    for _ in range(4000):
        path = [Node(rng.choice("ab"), {"class": rng.choice(["x", "y", "x y"])}) for _ in range(rng.randint(1, 9))]
        text = rng.choice(["a", ".x"])
        for _ in range(rng.randint(0, 5)):
            text += rng.choice([" ", ">", " > "]) + rng.choice(["a", "b", ".x", ".y", "a.x", "*"])
        parts, children, _, _ = selector_of(text)
        want = plain(parts, children, path)
        assert matches(parts, children, path) == want, (text, [(n.tag, n.attributes) for n in path])
        seen.add((want, len(parts)))
    assert len(seen) == 12


def test_selectors_beyond_the_places_tried_one_by_one(monkeypatch):
    css = ".a .b{display:none} .a > .c{visibility:hidden} .a > .c .d{visibility:visible} i[x=q] b{display:none} .e .b{display:inline}"
    body = "".join("<div class=a><p><span class=b>no</span> yes<p class=e><span class=b>shown</span></div><div class=a><div class=c>no<u class=d>seen</u></div></div><i x=q><b>no</b>r</i><i x=z><b>s</b></i>" for _ in range(3))
    want = render(f"<style>{css}</style>{body}")
    assert "no" not in want.split() and want.split().count("shown") == 3
    for looks in (0, 1, 7, 40):
        monkeypatch.setattr(html_module, "LOOKS", looks)
        assert render(f"<style>{css}</style>{body}") == want
    monkeypatch.undo()
    page = "<style>" + "".join(f".x{i} .a{{color:red;display:inline}}" for i in range(2000)) + ".y .a{display:none}</style><div class=y>" + "".join("<p><b class=a>hidden</b>s</p>" for _ in range(1500)) + "</div>"
    assert "hidden" not in render(page)


def test_selectors_together_against_one_by_one():
    rng = random.Random(4)
    rules = []
    for k in range(60):
        text = rng.choice(["a", ".x", "*", "[class~=y]"])
        for _ in range(rng.randint(0, 4)):
            text += rng.choice([" ", ">"]) + rng.choice(["a", "b", ".x", ".y", "a.x", "*", "#i", "b[id]"])
        parts, children, _, _ = selector_of(text)
        rules.append(((k,), parts, children))
    for n in (1, 7, 60):
        some = rng.sample(rules, n)
        together = Together(some)
        path = []
        for _ in range(3000):
            del path[rng.randint(0, len(path)) :]
            path.append(Node(rng.choice("ab"), {"class": rng.choice(["x", "y", "x y"]), **({"id": "i"} if rng.random() < 0.2 else {})}))
            assert together.best(path) == max((r for r, parts, children in some if matches(parts, children, path)), default=None)
