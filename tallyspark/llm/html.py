"""Layout-aware HTML rendering: a tree builder with implied tags, visibility rules, and a text layout.

The tree builder closes what HTML lets authors leave open (paragraphs, list items, table parts, options), inserts row
groups and rows, ends captions and column groups where something else begins, moves text that stands directly in a table
in front of it, and ignores end tags of nothing. Hidden are
the elements that browsers don't show, those with `hidden`, closed details and dialogs, hidden inputs, and what inline
styles or rules of the page's own style elements hide by display or visibility; selectors may join tags, classes, ids and
attribute tests by descendant and child combinators. Importance, specificity and order decide between declarations,
visibility is inherited, and media rules count if they hold on a screen of `SCREEN` pixels. Rules with sibling combinators,
pseudo-classes or pseudo-elements aren't judged.
The layout puts blank lines around paragraphs, headings, lists and tables, starts a line at each other block (and at what a
style makes a block), marks and indents list items, keeps white space in preformatted text, and aligns the cells of a
table's columns. A second line break in a row leaves a blank line.

Everything is iterative, and nesting is cut at `DEPTH` as browsers do, so hostile pages need linear time and memory.

Rows: a null or empty html renders as the empty text; null ids and repeated rows stay; very long pages are rendered
whole; an empty table gives no rows; only page_id and html are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from html import unescape
from unicodedata import east_asian_width

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches

#: Open elements beyond which the innermost is closed before another opens.
DEPTH = 256
#: Columns to which cells are padded, and the widest padding of one.
COLUMNS, PAD = 64, 60
#: Width and height of the screen that media rules are judged by.
SCREEN = {"width": 1280, "height": 800}
#: Places of one page at which selectors of several parts are tried one by one; beyond that, all are matched together.
LOOKS = 2_000_000
#: List levels that indent.
INDENTS = 16

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style title template noscript noembed noframes iframe object audio video canvas datalist base link meta param source track area col colgroup rp".split())
#: Not shown inside svg and math.
FOREIGN_UNSEEN = frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient annotation annotation-xml".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset menu dir hr listing xmp".split())
BLOCK = PARAGRAPH | frozenset("address article aside body caption center dd details dialog div dt figcaption footer form header hgroup html legend li main nav optgroup option search section select summary tbody td tfoot th thead tr".split())
CLOSES_P = BLOCK - frozenset("option optgroup select td th tr tbody thead tfoot caption html body legend".split())
SCOPE = frozenset("table td th caption html body button object template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr".split())
INLINE_FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())

#: Blocks that a style can make inline, and the values of display by which it does, or makes something a block.
PLAIN_BLOCK = frozenset("p div section article aside header footer main nav address form hgroup h1 h2 h3 h4 h5 h6 figure figcaption center search".split())
INLINE_DISPLAY = frozenset("inline inline-block inline-flex inline-grid inline-table contents ruby".split())
BLOCK_DISPLAY = frozenset("block flex grid list-item table flow-root".split())

#: A start tag of the key closes open elements of the first set, up to an element of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "colgroup": ({"caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
IMPLIED |= {"thead": IMPLIED["tbody"], "tfoot": IMPLIED["tbody"]}

TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>|[!?/][^>]*+(?:>|\Z)|/?[a-zA-Z][^>]*+\Z)""", re.S)
TELLING = re.compile(r"hidden|style|class|id|span|start|value|open|type|reversed|media|placeholder", re.I).search
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
ASKING = re.compile(r"<style[^<]*\[", re.I).search
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
SPACES = re.compile(r"[ \t\n\r\f]+")
NAME = r"(?:[a-zA-Z_]|-[a-zA-Z_-]|[^\x00-\x7f])(?:[\w-]|[^\x00-\x7f])*+"
COMPOUND = re.compile(rf"""({NAME}|\*)?((?:[.#]{NAME}|\[\s*{NAME}\s*(?:[~|^$*]?=\s*(?:"[^"]*"|'[^']*'|{NAME}|\d+)\s*[is]?\s*)?\])*+)""")
CONDITION = re.compile(rf"""([.#])({NAME})|\[\s*({NAME})\s*(?:([~|^$*]?)(=)\s*(?:"([^"]*)"|'([^']*)'|([\w-]+))\s*([is]?)\s*)?\]""")
COMBINATOR = re.compile(r"\s*(>)\s*|\s+")
CSS_NOISE = re.compile(r"""/\*.*?(?:\*/|\Z)|=\s*+("[^"\\\n{};,\]]*+"|'[^'\\\n{};,\]]*+')|"(?:[^"\\\n]|\\.)*+["\n]?|'(?:[^'\\\n]|\\.)*+['\n]?|<!--|-->""", re.S)
CSS_MARK = re.compile(r"[{};]")
FEATURE = re.compile(r"\(\s*(min|max)-(width|height)\s*:\s*([\d.]+)(px|em|rem)\s*\)")


def declarations(style: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a block of declarations: (important, value); a later one wins unless less important."""
    out: dict[str, tuple[bool, str]] = {}
    for part in style.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name in ("display", "visibility") and value:
            value, mark, rest = value.partition("!")
            important = bool(mark) and rest.strip() == "important"
            value = value.strip()
            if value not in ("inherit", "unset", "revert") and (name == "display" or value in ("visible", "hidden", "collapse", "initial")) and important >= out.get(name, (False, ""))[0]:
                out[name] = (important, value)
    return out


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds on the screen; features other than its size count as not given."""

    def holds(query: str) -> bool:
        words = query.replace("only ", "").strip()
        negated = words.startswith("not ")
        kind, *features = re.split(r"\s+and\s+", words[4:].strip() if negated else words)
        if not kind.startswith("("):
            if kind not in ("all", "screen", ""):
                return negated
        else:
            features = [kind, *features]
        for feature in features:
            m = FEATURE.fullmatch(feature.strip())
            try:
                size = float(m[3]) * (1 if m[4] == "px" else 16) if m else None
            except ValueError:
                size = None
            if size is None:
                return False
            if not (SCREEN[m[2]] >= size if m[1] == "min" else SCREEN[m[2]] <= size):
                return negated
        return not negated

    return any(holds(q) for q in media.lower().split(","))


def applies(at_rule: str) -> bool:
    """Whether the rules in an at-rule's block count."""
    name, _, rest = at_rule.lower().replace("(", " (", 1).partition(" ")
    if name == "@media":
        return on_screen(rest)
    return name == "@layer" or name == "@supports" and not rest.strip().startswith("not")


class Compound:
    """One part of a selector: a tag and conditions on one element."""

    __slots__ = ("conditions", "tag")

    def __init__(self, tag: str, conditions: list[tuple[str, str, str, str]]):
        self.tag, self.conditions = tag, conditions

    def fits(self, node: Node) -> bool:
        if self.tag and self.tag != node.tag:
            return False
        own = node.attributes or {}
        for name, test, value, case in self.conditions:
            given = own.get(name)
            if given is None:
                return False
            if case == "i":
                given, value = given.lower(), value.lower()
            if not HOLDS[test](given, value):
                return False
        return True


HOLDS = {
    "has": lambda given, value: True,
    "": lambda given, value: given == value,
    "~": lambda given, value: value in given.split(),
    "|": lambda given, value: given == value or given.startswith(value + "-"),
    "^": lambda given, value: bool(value) and given.startswith(value),
    "$": lambda given, value: bool(value) and given.endswith(value),
    "*": lambda given, value: bool(value) and value in given,
}


def selector_of(text: str) -> tuple[list[Compound], list[bool], tuple[int, int, int], str] | None:
    """A selector's parts from right to left, whether each is the parent of the one before, its specificity, and the name
    (#id, .class, tag or *) that an element must have to match its last part; None if it isn't judged."""
    parts, children, weight, at = [], [], [0, 0, 0], 0
    key = "*"
    while True:
        m = COMPOUND.match(text, at)
        if m.end() == at:
            return None
        tag = "" if m[1] in (None, "*") else m[1].lower()
        weight[2] += bool(tag)
        conditions, key = [], tag or "*"
        for mark, name, attribute, test, equal, *values, case in CONDITION.findall(m[2]):
            weight[0 if mark == "#" else 1] += 1
            if mark:
                conditions.append(("id" if mark == "#" else "class", "" if mark == "#" else "~", name, ""))
                key = mark + name if mark == "#" or key[0] != "#" else key
            else:
                conditions.append((attribute.lower(), test if equal else "has", "".join(values), case))
        parts.append(Compound(tag, conditions))
        at = m.end()
        if at == len(text):
            return parts[::-1], children[::-1], tuple(weight), key
        m = COMBINATOR.match(text, at)
        if m is None or m.end() == len(text):
            return None
        children.append(bool(m[1]))
        at = m.end()


def matches(parts: list[Compound], children: list[bool], path: list[Node]) -> bool:
    """Whether the last element of `path` matches, its ancestors being the others. Chains of child parts are kept
    together; each chain takes the nearest place above the one before, which leaves the most for the rest."""
    at, k, first = len(path) - 1, 0, True
    while k < len(parts):
        last = k
        while last < len(children) and children[last]:
            last += 1
        while at - (last - k) >= 0 and not all(parts[k + i].fits(path[at - i]) for i in range(last - k + 1)):
            if first:
                return False
            at -= 1
        at -= last - k + 1
        if at < -1:
            return False
        k, first = last + 1, False
    return True


class Together:
    """All of a page's selectors matched at once, by a bit for each of their parts: the parts that an element ends a match
    of, and those that its ancestors do. `ranked` are (rank, parts, children), of which the highest rank that matches is
    found. Elements come in document order, so only the states of a path are held."""

    #: Kinds of elements whose fitting parts are kept.
    KEPT = 500

    def __init__(self, ranked: list[tuple]):
        self.ranks, self.places, self.path, self.kept = {}, {}, [], {}
        starts, child, below, ends = [], [], [], []
        at = 0
        for rank, parts, children in sorted(ranked, key=lambda r: r[0]):
            for k, part in enumerate(reversed(parts)):
                (starts if k == 0 else child if children[len(children) - k] else below).append(at)
                told = next((mark + v for name, mark in (("id", "#"), ("class", ".")) for n, test, v, case in part.conditions if n == name and not case and test == ("" if mark == "#" else "~")), part.tag or "*")
                self.places.setdefault(told, {}).setdefault((part.tag, *part.conditions), (part, []))[1].append(at)
                at += 1
            ends.append(at - 1)
            self.ranks[at - 1] = rank
        self.size = at // 8 + 1
        self.starts, self.child, self.below, self.ends = map(self.bits, (starts, child, below, ends))

    def bits(self, places: list[int]) -> int:
        held = bytearray(self.size)
        for at in places:
            held[at >> 3] |= 1 << (at & 7)
        return int.from_bytes(held, "little")

    def fitting(self, node: Node) -> int:
        own = node.attributes or {}
        kind = node.tag, tuple(own.items())
        if kind not in self.kept:
            if len(self.kept) >= self.KEPT:
                self.kept.clear()
            names = {"*", node.tag, "#" + own.get("id", ""), *("." + c for c in own.get("class", "").split())}
            self.kept[kind] = self.bits([at for name in names for part, places in self.places.get(name, {}).values() if part.fits(node) for at in places])
        return self.kept[kind]

    def best(self, path: list[Node]) -> tuple | None:
        held = self.path
        while held and not (len(held) <= len(path) and held[-1][0] is path[len(held) - 1]):
            held.pop()
        for node in path[len(held) :]:
            _, parent, above = held[-1] if held else (None, 0, 0)
            own = self.fitting(node) & (self.starts | above << 1 & self.below | parent << 1 & self.child)
            held.append((node, own, above | own))
        found = held[-1][1] & self.ends
        return self.ranks[found.bit_length() - 1] if found else None


class Node:
    __slots__ = ("attributes", "children", "foreign", "tag")

    def __init__(self, tag: str, attributes: dict | None = None):
        self.tag, self.attributes, self.children, self.foreign = tag, attributes, [], False


def attributes_of(text: str, every: bool) -> dict | None:
    """The attributes of a start tag, if one of them can matter; with `every`, style sheets may ask for any."""
    if not text or not every and not TELLING(text):
        return None
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape("".join(values)))
    return out


class Tree:
    """Builds the tree of one page; `styles` has what its style elements declare by tag, class or id alone, `longer` what they
    declare by other selectors, under the rarest name that an element must have."""

    def __init__(self, html: str):
        self.root = Node("html")
        self.stack, self.open, self.styles, self.longer = [self.root], {"html": 1}, {}, {}
        self.order, self.looks, self.together = 0, LOOKS, None
        self.every = bool(ASKING(html))
        self.build(html)

    def push(self, node: Node) -> None:
        while len(self.stack) >= DEPTH:
            self.pop()
        self.stack[-1].children.append(node)
        self.stack.append(node)
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def pop(self) -> Node:
        node = self.stack.pop()
        self.open[node.tag] -= 1
        return node

    def close(self, tags, until) -> None:
        """Close the outermost open element of `tags` inside the nearest of `until`, with what is in it."""
        if not any(self.open.get(t) for t in tags):
            return
        found = 0
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in until:
                break
            if tag in tags:
                found = i
        if found:
            again = [n for n in self.stack[found + 1 :] if n.tag in INLINE_FORMAT and n.attributes] if "p" in tags else []
            while len(self.stack) > found:
                self.pop()
            for node in again:  # formatting goes on after a paragraph, and so does its hiding
                self.push(Node(node.tag, node.attributes))

    def start(self, tag: str, attributes: dict | None) -> None:
        if tag in ("html", "body"):
            if tag == "html" and attributes:
                self.root.attributes = attributes | (self.root.attributes or {})
            if tag == "html" or self.open.get("body"):
                return
            while len(self.stack) > 1:
                self.pop()
        elif self.open.get("head") and tag not in UNSEEN:
            while self.open["head"]:
                self.pop()
        if self.stack[-1].tag == "colgroup" and tag not in ("col", "colgroup", "template"):
            self.pop()
        if tag in CLOSES_P:
            self.close(("p",), SCOPE)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop()
        if tag in IMPLIED:
            tags, until = IMPLIED[tag]
            self.close(tags, until | {"table"})
        if tag in ("td", "th", "tr") and self.open.get("table"):
            if self.stack[-1].tag == "table":
                self.push(Node("tbody"))
            if tag != "tr" and self.stack[-1].tag in ("tbody", "thead", "tfoot"):
                self.push(Node("tr"))
        node = Node(tag, attributes)
        node.foreign = bool(self.open.get("svg") or self.open.get("math"))
        if tag in VOID:
            self.stack[-1].children.append(node)
        else:
            self.push(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.stack[-1].children.append(Node("br"))
        if tag in ("html", "body") or not self.open.get(tag):
            return
        stops = {"html"} if tag == "table" else SCOPE - {tag}
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i].tag in stops and tag not in TABLE_PARTS:
                return

    def text(self, text: str) -> None:
        if self.stack[-1].tag == "colgroup" and text.strip():
            self.pop()
        parent = self.stack[-1]
        if parent.tag in TABLE_PARTS:
            if not text.strip():
                return
            at = max(i for i, n in enumerate(self.stack) if n.tag == "table") if self.open.get("table") else 0
            if at:
                siblings = self.stack[at - 1].children
                siblings.insert(len(siblings) - 1, text)
                return
        if self.open.get("head") and text.strip():
            while self.open["head"]:
                self.pop()
            parent = self.stack[-1]
        parent.children.append(text)

    def build(self, html: str) -> None:
        at, search = 0, TAG.search
        while True:
            m = search(html, at)
            stop = m.start() if m else len(html)
            if stop > at:
                text = html[at:stop]
                self.text(unescape(text) if "&" in text else text)
            if m is None:
                return
            at, tag = m.end(), m[2]
            if not tag:
                continue
            tag = tag.lower()
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, attributes_of(m[3], self.every))
            if m[3].endswith("/") and tag not in VOID and (tag in ("svg", "math") or self.stack[-1].foreign):
                self.pop()
                continue
            if tag in RAW:
                raw = RAW_END[tag].search(html, at)
                body = html[at : raw.start() if raw else len(html)]
                if tag == "style":
                    if on_screen((self.stack[-1].attributes or {}).get("media", "")):
                        self.rules(body)
                elif tag in ("textarea", "xmp"):
                    self.stack[-1].children.append(unescape(body) if tag == "textarea" else body)
                self.pop()
                at = len(html) if raw is None else (html.find(">", raw.end()) + 1 or len(html))

    def rules(self, css: str) -> None:
        css = CSS_NOISE.sub(lambda m: m[0] if m[1] else '""' if m[0][0] in "\"'=" else "", css)
        at, blocks = 0, []  # open blocks: (selectors, or None of an at-rule; whether its content counts)
        for m in CSS_MARK.finditer(css):
            mark, head = m[0], css[at : m.start()].strip()
            counts = blocks[-1][1] if blocks else True
            if mark == "{":
                at_rule = head.startswith("@")
                blocks.append((None, counts and applies(head)) if at_rule else (head, counts and not (blocks and blocks[-1][0] is not None)))
            elif mark == ";" and blocks and blocks[-1][0] is not None:
                continue
            elif mark == "}" and blocks:
                selectors, counts = blocks.pop()
                if selectors is not None and counts:
                    self.declare(selectors, head)
            at = m.end()
        if blocks and blocks[-1][0] is not None and blocks[-1][1]:  # the sheet ends inside a rule
            self.declare(blocks[-1][0], css[at:])

    def declare(self, selectors: str, body: str) -> None:
        found = declarations(body)
        if not found:
            return
        self.order += 1
        for selector in map(str.strip, selectors.split(",")):
            judged = selector_of(selector)
            if judged is None:
                continue
            parts, children, weight, key = judged
            if len(parts) == 1 and len(parts[0].conditions) + bool(parts[0].tag) == (key != "*"):  # told by its name alone
                own = self.styles.setdefault(key, {})
                for what, (important, value) in found.items():
                    own[what] = max(own.get(what, ((),)), ((important, weight, self.order), value))
            else:
                self.longer.setdefault(key, {})[selector] = (parts, children, self.longer.get(key, {}).get(selector, (0, 0, {}))[2])
                own = self.longer[key][selector][2]
                for what, (important, value) in found.items():
                    own[what] = max(own.get(what, ((),)), ((important, weight, self.order), value))

    def matched_together(self) -> dict[str, Together]:
        """By what they declare, the selectors that aren't told by a name alone."""
        if self.together is None:
            every = [rule for own in self.longer.values() for rule in own.values()]
            self.together = {what: Together([(ranks[what], parts, children) for parts, children, ranks in every if what in ranks]) for what in ("display", "visibility")}
        return self.together

    def shown(self, node: Node, parent_shown: bool, path: list[Node]) -> tuple[bool | None, str | None]:
        """Whether a node's own text shows, which what is in it inherits (None if nothing in it does), and its display as
        styles state it. `path` ends with the node and has its ancestors before."""
        tag, attributes = node.tag, node.attributes
        if tag in UNSEEN or node.foreign and tag in FOREIGN_UNSEEN:
            return None, None
        best: dict[str, tuple] = {}
        if self.styles or self.longer:
            names = ["*", tag]
            if attributes:
                names += ["." + c for c in attributes.get("class", "").split()] + (["#" + attributes["id"]] if attributes.get("id") else [])
            for name in names:
                for what, ranked in self.styles.get(name, {}).items():
                    best[what] = max(best.get(what, ((),)), ranked)
                for parts, children, ranks in self.longer.get(name, {}).values():
                    if self.looks <= 0:
                        break
                    self.looks -= len(path) if len(parts) > 1 else 1
                    if any(ranked > best.get(what, ((),)) for what, ranked in ranks.items()) and matches(parts, children, path):
                        for what, ranked in ranks.items():
                            best[what] = max(best.get(what, ((),)), ranked)
            if self.looks <= 0:
                for what, all_of in self.matched_together().items():
                    best[what] = max(best.get(what, ((),)), all_of.best(path) or ((),))
                best = {what: ranked for what, ranked in best.items() if ranked != ((),)}
        if attributes and attributes.get("style"):
            for what, (important, value) in declarations(CSS_NOISE.sub("", attributes["style"])).items():
                best[what] = max(best.get(what, ((),)), ((important, (2, 0, 0), 0), value))
        display = best["display"][1] if "display" in best else None
        attributes = attributes or {}
        if tag == "input" and attributes.get("type", "").lower() == "hidden" or display == "none":
            return None, None
        if display is None and ("hidden" in attributes or tag == "dialog" and "open" not in attributes):
            return None, None
        return best["visibility"][1] in ("visible", "initial") if "visibility" in best else parent_shown, display


def width(text: str) -> int:
    return len(text) if text.isascii() else len(text) + sum(east_asian_width(c) in "WF" for c in text)


def number(attributes: dict | None, name: str, default: int, most: int) -> int:
    value = (attributes or {}).get(name, "").strip()
    return min(int(value), most) if value.isascii() and value.isdigit() and len(value) < 10 else default


class Flow:
    """Lines laid out so far, the inline text of the next one, and the blank lines that must come before it."""

    __slots__ = ("blank", "inline", "lines")

    def __init__(self):
        self.lines, self.inline, self.blank = [], [], 0

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = 0
        self.lines.append(line)

    def flush(self) -> None:
        if self.inline:
            line = SPACES.sub(" ", "".join(self.inline)).strip(" ")
            self.inline = []
            if line:
                self.put(line)

    def line_break(self) -> None:
        """The end of a line, or a blank line where none has begun."""
        before = len(self.lines)
        self.flush()
        if len(self.lines) == before:
            self.blank = 1

    def block(self, blank: int) -> None:
        self.flush()
        self.blank |= blank

    def take(self, lines: list[str]) -> None:
        if lines:
            self.put(lines[0])
            self.lines.extend(lines[1:])


class Grid:
    """The cells of one table; rows may span."""

    def __init__(self):
        self.rows: list[list[tuple[int, list[str], bool]]] = []
        self.taken: dict[int, int] = {}  # column -> rows for which a cell above still stands in it

    def row(self) -> None:
        self.rows.append([])
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}
        self.at = 0

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        while self.at in self.taken:
            self.at += 1
        self.rows[-1].append((self.at, lines, columns == 1))
        if rows > 1:
            self.taken.update({c: rows for c in range(self.at, min(self.at + columns, COLUMNS))})
        self.at += columns

    def lines(self) -> list[str]:
        wide: dict[int, int] = {}
        for row in self.rows:
            for column, lines, single in row:
                if single and column < COLUMNS:
                    wide[column] = max(wide.get(column, 0), min(PAD, max(map(width, lines), default=0)))
        starts, total = {}, 0
        for column in range(min(COLUMNS, max(wide, default=-1) + 1) + 1):
            starts[column] = total
            total += wide.get(column, 0) + (2 if wide.get(column) else 0)
        out = []
        for row in self.rows:
            for k in range(max((len(lines) for _, lines, _ in row), default=0)):
                parts, at = [], 0
                for column, lines, _ in row:
                    if k >= len(lines) or not lines[k]:
                        continue
                    gap = max(starts.get(column, 0) - at, 2 if at else 0)
                    parts += [" " * gap, lines[k]]
                    at += gap + width(lines[k])
                out.append("".join(parts).rstrip(" "))
        return out


def render(html: str | None) -> str:
    """All visible text of a page."""
    if not html:
        return ""
    tree = Tree(html)
    flows, grids, lists = [Flow()], [], []
    preformatted = 0
    path: list[Node] = []  # of the element at hand, its ancestors and itself
    todo: list = [(tree.root, True, False)]  # (node or text, shown, whether it ends here); where it ends, whether it is a block
    while todo:
        node, shown, leaving = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not shown:
                pass
            elif preformatted:
                first, *more = node.expandtabs(8).replace("\r\n", "\n").split("\n")
                flow.inline.append(first)
                for line in more:
                    flow.put("".join(flow.inline).rstrip())
                    flow.inline = [line]
            else:
                flow.inline.append(node)
            continue
        tag, attributes = node.tag, node.attributes
        if not leaving:
            path.append(node)
            shown, display = tree.shown(node, shown, path)
            if shown is None or tag in VOID:
                path.pop()
            if shown is None:
                continue
            block = tag in BLOCK and (tag not in PLAIN_BLOCK or display not in INLINE_DISPLAY) or display in BLOCK_DISPLAY
            if tag == "br":
                if shown and preformatted:
                    flow.put("".join(flow.inline).rstrip())
                    flow.inline = []
                elif shown:
                    flow.line_break()
            elif tag == "hr":
                flow.block(1)
            elif tag == "wbr" or tag == "img" or tag == "embed":
                pass
            elif tag == "input":
                given, kind = attributes or {}, (attributes or {}).get("type", "text").lower()
                text = given.get("value") or kind not in ("submit", "button", "reset") and given.get("placeholder")
                if shown and text and kind in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                    flow.inline.append(f" {text} ")
            else:
                if block:
                    if preformatted and flow.inline:
                        flow.put("".join(flow.inline).rstrip())
                        flow.inline = []
                    nested = tag in ("ul", "ol") and lists and lists[-1][2]
                    flow.block(1 if tag in PARAGRAPH and not nested else 0)
                if tag in ("ul", "ol", "menu", "dir"):
                    lists.append([tag == "ol", number(attributes, "start", 1, 10**6), False])
                elif tag == "li":
                    if lists:
                        lists[-1][2] = True
                    flows.append(Flow())
                elif tag in ("dd", "blockquote", "td", "th", "caption"):
                    flows.append(Flow())
                elif tag == "text" and node.foreign:
                    flow.inline.append(" ")
                elif tag == "table":
                    grids.append(Grid())
                elif tag == "tr" and grids:
                    grids[-1].row()
                elif tag in ("pre", "listing", "xmp", "textarea"):
                    if not preformatted:
                        flow.flush()
                    preformatted += 1
                todo.append((node, block, True))
                children = node.children
                if tag == "html" and not any(isinstance(c, Node) and c.tag == "body" for c in children):
                    path.append(Node("body"))  # implied
                if tag == "textarea" and not any(children) and (attributes or {}).get("placeholder"):
                    children = [attributes["placeholder"]]
                if tag == "details" and "open" not in (attributes or {}):
                    children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
                todo.extend((c, shown, False) for c in reversed(children))
            continue
        path.pop()
        block = shown
        if tag in ("pre", "listing", "xmp", "textarea"):
            preformatted -= 1
            text = "".join(flow.inline).rstrip()
            flow.inline = []
            if text:
                flow.put(text)
        if tag == "text" and node.foreign:
            flow.inline.append(" ")
        if tag in ("li", "dd", "blockquote", "td", "th", "caption"):
            flow.flush()
            lines = flows.pop().lines
            outer = flows[-1]
            if tag == "li":
                mark, deep = "- ", len(lists) <= INDENTS
                if lists and lists[-1][0]:
                    value = number(attributes, "value", lists[-1][1], 10**6)
                    mark, lists[-1][1] = f"{value}. ", value + 1
                outer.take([(mark if k == 0 else " " * len(mark) if deep and line else "") + line for k, line in enumerate(lines)])
            elif tag in ("td", "th") and grids:
                grids[-1].cell(lines, max(1, number(attributes, "colspan", 1, COLUMNS)), max(1, number(attributes, "rowspan", 1, 10**4)))
            elif tag in ("dd", "blockquote"):
                outer.take(["  " + line if line and len(flows) <= INDENTS else line for line in lines])
            else:
                outer.take(lines)
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.flush()
            lists.pop()
        elif tag == "table":
            flow.flush()
            flow.take(grids.pop().lines())
        if block:
            nested = tag in ("ul", "ol") and lists and lists[-1][2]
            flows[-1].block(1 if tag in PARAGRAPH and not nested else 0)
    flows[-1].flush()
    return "\n".join(flows[-1].lines)


def render_pages(pages: DataFrame) -> DataFrame:
    """page_id, text of every page."""
    small_batches(pages.sparkSession)

    def make():
        return lambda columns: {"page_id": columns["page_id"], "text": [render(h) for h in columns["html"].to_pylist()]}

    return map_rows(pages.select(F.col("page_id").cast("long"), "html"), "page_id long, text string", make)
