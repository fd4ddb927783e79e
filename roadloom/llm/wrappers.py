"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page is read as a stream of block tags and text runs, with implied end tags added so that it is balanced; scripts,
styles and comments are no tokens, and tags inside a line (links apart) belong to the text. A tag's key is its name with
the role words of its class, id and role. Within a page, neighbours with equal keys are aligned and become a *repeated*
item, sequences of up to MAX_PERIOD keys that repeat a repeated group, and text becomes a *slot*: the page's expression.
The distinct expressions of a host are then aligned iteratively, in a tree of rounds: a longest common subsequence of
keys pairs the items of two expressions, paired items are aligned inside, what only one side has becomes *optional*, and
new neighbours with equal keys repeated. A level of more than MAX_ITEMS items becomes one repeated group with each key
once. The result is the host's *wrapper*. Slots carry the number of pages and of characters, those of links, and a digest
of their text as long as all pages have the same there.

The wrapper decides which slots are main text: those of its articles (else of its main part, of parts that say they are
content, else of the deepest part that holds MOST of the text outside links), without menus, headers, footers, sidebars,
notices, adverts, forms and comments, lists of links, and text blocks that are the same on all of SAME_PAGES or more
pages while others change; of a header inside the article its headings stay. Each expression is aligned with the wrapper
once, which gives a mask over its slots; a page is cut by the mask of its expression. Where no slot of a page is main
text by the host's wrapper, its own expression decides.

Defined results: a null html counts as empty and gives the empty text; a null url is the host of no name; rows that
repeat a page have equal results; text is decoded once, white space (Unicode's) inside a block becomes one space, blocks
are joined by one space; a tag without end drops what follows it, as browsers do; elements nested deeper than MAX_DEPTH
are read as text of their ancestor; pages of any length are read whole; of equally long alignments the one found from
the end is taken, so results don't depend on the order of rows; an empty table gives no rows; columns of `pages` named as
a result are replaced by it, all others stay untouched.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import attach, cut, grouped, map_arrow, session

MAX_PERIOD, MAX_ITEMS, MAX_DEPTH = 6, 64, 64
MOST, SAME_PAGES, LINKED = 0.7, 5, 0.8
#: Expressions folded by one group of a round; entries of a task's table of expressions before it is handed on.
FAN_IN, HELD = 32, 2_000
#: Wrappers that a task keeps parsed.
HOSTS = 256
#: Largest table of masks, in bytes, that is broadcast; beyond it pages are joined with it.
BROADCAST_BYTES = 16 << 20

# Element names by how HTML treats them, and role words of class names.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html label legend"
    " li main menu nav object ol optgroup option p pre search section select summary svg table tbody td tfoot th thead tr ul video audio canvas".split()
)
SKIPPED = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ENDS_P = BLOCKS - frozenset("button label option optgroup object svg video audio canvas select".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog button select label fieldset svg head object video audio canvas".split())
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar sidenav menu menubar nav navbar"
    " navigation breadcrumb breadcrumbs pagination pager footer contentinfo masthead header topbar toolbar comment comments commentlist disqus reply replies respond discussion share sharing"
    " social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets complementary search dialog form copyright hidden".split()
)
CONTENT = frozenset("article articlebody content main post entry story body text prose".split())
CLOSES = {  # an open element that a start tag ends, and the element at which the search for it stops
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?>=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""")
_ATTR = re.compile(r"""(?:^|[\s/"'])(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
OPTIONAL, REPEATED = 1, 2
# An item is [key, quantifier, content]: a slot's key is "#" and its content [pages, chars, chars of links, digest, runs];
# an element's content is its items; a group has the key "" and items.


def roles(attributes: str) -> frozenset:
    out = set()
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            out.add("hidden")
        elif name in ("class", "id", "role"):
            words = {w.lower() for w in _WORD.findall(value)}
            out |= words & (BOILER | CONTENT)
        elif name == "itemprop" and value.lower() == "articlebody":
            out.add("articlebody")
    return frozenset(out)


@lru_cache(4096)
def _opened(name: str, attributes: str) -> str:
    """The key of a start tag; the empty text if it opens no item."""
    role = roles(attributes) if attributes else frozenset()
    if name in VOID or name not in BLOCKS and not role & BOILER:
        return ""
    return ".".join([name, *sorted(role)])


class _Reader:
    """The balanced token tree under construction and its text runs."""

    def __init__(self):
        self.root: list = ["", 0, []]
        self.stack, self.runs, self.pieces, self.linked, self.link, self.deep = [self.root], [], [], 0, False, Counter()

    def text(self, raw: str) -> None:
        self.pieces.append(unescape(raw) if "&" in raw else raw)
        if self.link:
            self.linked += len(" ".join(self.pieces[-1].split()))

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces.clear()
            if text:
                digest = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest())
                self.stack[-1][2].append(["#", 0, [1, len(text), min(self.linked, len(text)), digest, [len(self.runs)]]])
                self.runs.append(text)
        self.linked = 0

    def find(self, names, stops) -> int:
        """Where in the stack the nearest open element of these names is; 0 if none is or a stop is nearer."""
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0].partition(".")[0]
            if tag in names:
                return i
            if tag in stops:
                return 0
        return 0

    def close(self, i: int) -> None:
        if i:
            self.flush()
            del self.stack[i:]

    def start(self, name: str, attributes: str) -> None:
        if name == "a":
            self.link = True
        elif name in ("br", "hr"):
            self.pieces.append(" ")
        elif k := _opened(name, attributes):
            self.flush()
            if name in ENDS_P:
                self.close(self.find(("p",), ("table", "td", "th", "button", "object")))
            if name in HEADINGS and self.stack[-1][0].partition(".")[0] in HEADINGS:
                self.close(len(self.stack) - 1)
            while name in CLOSES and (i := self.find(*CLOSES[name])):
                self.close(i)
            if name == "svg" and attributes.endswith("/"):
                return
            if len(self.stack) > MAX_DEPTH:
                self.deep[name] += 1
                return
            item = [k, 0, []]
            self.stack[-1][2].append(item)
            self.stack.append(item)

    def end(self, name: str) -> None:
        if name == "a":
            self.link = False
        elif self.deep[name]:
            self.flush()
            self.deep[name] -= 1
        else:
            self.close(self.find((name,), ("table",) if name in ("tr", "tbody", "thead", "tfoot") else () if name == "table" else ("table", "td", "th")))


def read(html: str) -> tuple[list, list[str]]:
    """(items of the balanced token tree, text runs in page order); a slot's runs are the numbers of its text runs."""
    page, pos, size = _Reader(), 0, len(html)
    while pos < size:
        lt = html.find("<", pos)
        if lt != pos:
            page.text(html[pos : lt if lt >= 0 else size])
        if lt < 0:
            break
        head = html[lt + 1 : lt + 3]
        if m := _TAG.match(html, lt):
            pos, name = m.end(), m[1].lower()
            if head[0] == "/":
                page.end(name)
            elif name in SKIPPED:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
                pos = end.end() if end else size
            else:
                page.start(name, m[2])
        elif re.match("/?[a-zA-Z]", head):  # a tag without end
            break
        elif html.startswith("<!--", lt):
            end = lt + 4 if html.startswith((">", "->"), lt + 4) else html.find("-->", lt + 4)
            pos = html.index(">", end) + 1 if end >= 0 else size
        elif head[:1] in ("!", "?", "/") and head:
            pos = html.find(">", lt) + 1 or size
        else:
            page.text("<")
            pos = lt + 1
    page.flush()
    return page.root[2], page.runs


# Alignment.


def key(item: list) -> str:
    return item[0] or "(" + " ".join(key(x) for x in item[2]) + ")"


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence, by bit vectors: one row of bits an entry of b."""
    masks: dict[str, int] = {}
    for i, k in enumerate(a):
        masks[k] = masks.get(k, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, []
    for k in b:
        u = v & masks.get(k, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> i - 1 & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1] >> i - 1 & 1:
                i -= 1
                out.append((i, j))
    return out[::-1]


def inside(item: list) -> set[str]:
    """Keys of the elements below an item."""
    out = set()
    for x in item[2]:
        if x[0] != "#":
            out |= inside(x) | {x[0]}
    return out


def alike(a: list, b: list) -> bool:
    """Whether two items of one key are the same part. Plain containers are if half of the smaller's keys are in the larger."""
    if a[0] not in ("div", "section"):
        return True
    x, y = inside(a), inside(b)
    return x == y or 2 * len(x & y) >= min(len(x), len(y)) > 0


def united(a: list, b: list, pages: bool) -> list:
    """One item for two of equal key. `pages`: they come from different pages, whose numbers add up."""
    if a[0] == "#":
        (p, c, m, d, r), (q, e, n, f, s) = a[2], b[2]
        return ["#", a[1] | b[1], [p + q if pages else max(p, q), c + e, m + n, d if d == f else None, r + s]]
    if a[0] == "":
        return ["", a[1] | b[1], [united(x, y, pages) for x, y in zip(a[2], b[2], strict=True)]]
    return [a[0], a[1] | b[1], align(a[2], b[2], pages)]


def align(a: list, b: list, pages: bool) -> list:
    """The expression that covers both sequences of items."""
    if len(a) == len(b) == 1 and a[0][0] == b[0][0] == "#":
        return [united(a[0], b[0], pages)]
    out, i, j = [], 0, 0
    for x, y in [*((x, y) for x, y in common([key(x) for x in a], [key(x) for x in b]) if alike(a[x], b[y])), (len(a), len(b))]:
        out += [[k, q | OPTIONAL, c] for k, q, c in a[i:x]]
        out += [[k, q | OPTIONAL, c] for k, q, c in b[j:y]]
        if x < len(a):
            out.append(united(a[x], b[y], pages))
        i, j = x + 1, y + 1
    return squash(out)


def squash(items: list) -> list:
    """Neighbours, and short sequences, of equal keys become repeated."""
    for period in range(1, MAX_PERIOD + 1):
        if len(items) < 2:
            break
        out, keys = [], []
        for x in items:
            out.append(x)
            keys.append(key(x))
            while True:
                if period > 1 and len(out) > period and out[-period - 1][0] == "" and keys[-period - 1] == "(" + " ".join(keys[-period:]) + ")":
                    group = ["", 0, out[-period:]]  # one more turn of the group before it
                    merged = united(out[-period - 1], group, False)
                elif len(out) >= 2 * period and keys[-period:] == keys[-2 * period : -period] and all(alike(x, y) for x, y in zip(out[-period:], out[-2 * period : -period], strict=True)):
                    if period == 1:
                        merged = united(out[-2], out[-1], False)
                    else:
                        merged = united(["", REPEATED, out[-2 * period : -period]], ["", 0, out[-period:]], False)
                    del out[-2 * period : -period], keys[-2 * period : -period]
                    out[-period:], keys[-period:] = [merged], [""]
                    merged[1] |= REPEATED
                    keys[-1] = key(merged)
                    continue
                else:
                    break
                out[-period - 1 :], keys[-period - 1 :] = [merged], [key(merged)]
                merged[1] |= REPEATED
        items = out
    if len(items) > MAX_ITEMS:
        by: dict[str, list] = {}
        for x in items:
            for y in x[2] if x[0] == "" else [x]:
                y = [y[0], y[1] | OPTIONAL, y[2]]
                by[key(y)] = united(by[key(y)], y, False) if key(y) in by else y
        items = [["", REPEATED, list(by.values())]] if len(by) > 1 else list(by.values())
    return items


def expression(items: list) -> list:
    """A page's own expression: its tree with repeats collapsed from the leaves up."""
    return squash([x if x[0] == "#" else [x[0], x[1], expression(x[2])] for x in items])


def shape(items: list) -> list:
    """An expression without what its slots hold."""
    return [[k, q, None if k == "#" else shape(c)] for k, q, c in items]


def slots(items: list) -> list:
    out = []
    for x in items:
        out += [x] if x[0] == "#" else slots(x[2])
    return out


def render(items: list) -> str:
    """The expression as text: <tag> ... </tag>, # for a slot, ( ) for groups, ? + * for quantifiers."""
    out = []
    for k, q, c in items:
        body = "#" if k == "#" else render(c) if k == "" else f"<{k}> {render(c)} </{k}>".replace("  ", " ")
        mark = ("", "?", "+", "*")[q]
        out.append(f"( {body} ){mark}" if mark and k != "#" else body + mark)
    return " ".join(out)


# What is main text.


def _parts(item: list) -> tuple[str, set[str]]:
    tag, *words = item[0].split(".")
    return tag, set(words)


def _holds(item: list, tags: frozenset) -> bool:
    return item[0] != "#" and any(x[0].partition(".")[0] in tags or _holds(x, tags) for x in item[2])


_ARTICLES = frozenset({"article", "main"})


def _boiler(item: list) -> bool:
    if item[0] in ("#", ""):
        return False
    tag, words = _parts(item)
    if tag in ("html", "body", "main"):
        return False
    return (tag in BOILER_TAGS or bool(words & BOILER)) and not _holds(item, _ARTICLES)


def _mass(item: list) -> tuple[int, int]:
    """Characters and those of links, outside boilerplate."""
    if item[0] == "#":
        return item[2][1], item[2][2]
    if _boiler(item):
        return 0, 0
    got = [_mass(x) for x in item[2]]
    return sum(x for x, _ in got), sum(x for _, x in got)


def _find(items: list, test) -> list:
    """The outermost items outside boilerplate that pass."""
    out = []
    for x in items:
        if x[0] != "#" and not _boiler(x):
            out += [x] if test(x) else _find(x[2], test)
    return out


def regions(items: list) -> list:
    tests = (
        lambda x: _parts(x)[0] == "article",
        lambda x: _parts(x)[0] == "main" or "main" in _parts(x)[1] and _parts(x)[0] != "body",
        lambda x: bool(_parts(x)[1] & CONTENT) and _parts(x)[0] not in ("html", "body"),
    )
    for test in tests:
        found = _find(items, test)
        if any(_mass(x)[0] for x in found):
            return found
    at = ["", 0, items]
    while True:
        weigh = [(c - 2 * m, i) for i, x in enumerate(at[2]) if x[0] != "#" for c, m in [_mass(x)]]
        chars, links = _mass(at)
        best, i = max(weigh, default=(0, 0))
        if best <= 0 or best < MOST * (chars - 2 * links) or not any(x[0] not in ("#", "p") and x[0].partition(".")[0] not in HEADINGS for x in at[2][i][2]):
            return [at]
        at = at[2][i]


def decide(items: list) -> dict[int, bool]:
    """id(slot or element) -> main text. An element's value, and the page's under 0, hold for what stands below and isn't in the wrapper."""
    out: dict[int, bool] = {}
    main = regions(items)
    mine = {id(x) for x in main}
    varied = any(x[2][3] is None and x[2][0] >= SAME_PAGES for r in main for x in slots([r]))

    def walk(item, state, heading):
        if item[0] == "#":
            same = varied and state and not heading and item[2][3] is not None and item[2][0] >= SAME_PAGES
            out[id(item)] = state and not same
            return
        tag, words = _parts(item)
        if id(item) in mine:
            state = True
        elif state and item[0] and _boiler(item):
            state = None if tag == "header" or words & BOILER <= {"header"} and words & BOILER else False  # None: headings alone
        elif tag in HEADINGS and state is None:
            state = True
        elif state and tag in ("ul", "ol", "dl", "table", "div", "section", "dir") and (m := _mass(item))[1] > LINKED * m[0]:
            state = False
        out[id(item)] = bool(state)
        for x in item[2]:
            walk(x, state if x[0] != "#" else bool(state), heading or tag in HEADINGS)

    out[0] = any(r[2] is items for r in main)  # the page as a whole
    for x in items:
        walk(x, out[0], False)
    return out


def mask(items: list, wrapper: list, chosen: dict[int, bool]) -> list[bool]:
    """For each slot of an expression: is it main text by the wrapper?"""
    out = []

    def unknown(x, state):
        if x[0] == "#":
            out.append(state)
        else:
            for y in x[2]:
                unknown(y, state and not _boiler(x))

    def walk(mine, theirs, state):
        at = {i: j for i, j in common([key(x) for x in mine], [key(x) for x in theirs]) if alike(mine[i], theirs[j])}
        spare = {}  # a group with each key once takes what its turns are
        for t in theirs:
            if t[0] == "" and t[1] & REPEATED:
                spare |= {key(x): x for x in t[2]}
        for i, x in enumerate(mine):
            y = theirs[at[i]] if i in at else spare.get(key(x))
            if y is None:
                y = next((t for t in theirs if key(t) == key(x)), None)
            if y is None:
                if x[0] == "":
                    walk(x[2], [*theirs, *spare.values()], state)
                else:
                    unknown(x, state)
            elif x[0] == "#":
                out.append(chosen[id(y)])
            else:
                walk(x[2], y[2], chosen[id(y)])

    walk(items, wrapper, chosen[0])
    return out


def own_mask(items: list) -> list[bool]:
    chosen = decide(items)
    return [chosen[id(x)] for x in slots(items)]


# Spark jobs.


def host_of(url):
    """Column: the url's host in lower case, the empty text where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _dump(items: list) -> str:
    return json.dumps(items, separators=(",", ":"))


def _page(html: str | None) -> tuple[list, str, str, list[str]]:
    items, runs = read(html or "")
    items = expression(items)
    text = _dump(shape(items))
    return items, hashlib.sha256(text.encode()).hexdigest()[:32], text, runs


def expressions(pages: DataFrame) -> DataFrame:
    """(host, shape_id, shape, slots): the distinct expressions of each host with what their slots hold over all pages.

    Tasks add up the pages of an expression before rows are shuffled, so a host or expression of very many pages is no
    hot key."""

    def make():
        held: dict[tuple, list] = {}

        def rows():
            out = {"host": [], "shape_id": [], "shape": [], "slot": [], "pages": [], "chars": [], "links": [], "digest": []}
            for (host, at), (text, stats) in held.items():
                for i, (p, c, m, d) in enumerate(stats or [[0, 0, 0, None]]):
                    for k, v in zip(out, (host, at, text if i == 0 else None, i if stats else None, p, c, m, d), strict=True):
                        out[k].append(v)
            held.clear()
            return out

        def each(b):
            for host, html in zip(b.column("host"), b.column("html"), strict=True):
                items, at, text, _ = _page(html.as_py())
                stats = [x[2][:4] for x in slots(items)]
                k = (host.as_py(), at)
                if k in held:
                    for mine, new in zip(held[k][1], stats, strict=True):
                        mine[:] = [mine[0] + new[0], mine[1] + new[1], mine[2] + new[2], mine[3] if mine[3] == new[3] else None]
                else:
                    held[k] = [text, stats]
                if len(held) >= HELD:
                    yield rows()

        each.close = lambda: [rows()] if held else []
        return each

    schema = "host string, shape_id string, shape string, slot int, pages long, chars long, links long, digest long"
    parts = map_arrow(pages.select(host_of(pages["url"]).alias("host"), pages["html"]), make, schema)
    same = F.when((F.count("*") == F.count("digest")) & (F.min("digest") == F.max("digest")), F.min("digest"))
    each = parts.groupBy("host", "shape_id", "slot").agg(F.max("shape").alias("shape"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), same.alias("digest"))
    entry = F.when(F.col("slot").isNotNull(), F.struct("slot", "pages", "chars", "links", "digest"))
    return each.groupBy("host", "shape_id").agg(F.max("shape").alias("shape"), F.sort_array(F.collect_list(entry)).alias("slots"))


def _filled(text: str, stats: list) -> list:
    items = json.loads(text)
    for x, s in zip(slots(items), stats, strict=True):
        x[2] = [s["pages"], s["chars"], s["links"], s["digest"], []]
    return items


def infer(found: DataFrame) -> DataFrame:
    """(host, wrapper): expressions of a host are aligned FAN_IN at a time, in order of a digest, until one is left."""
    counts = found.groupBy("host").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 1
    rounds = 1
    while FAN_IN**rounds < most:
        rounds += 1

    @F.arrow_udf("string")
    def fill(texts: pa.Array, stats: pa.Array) -> pa.Array:
        return pa.array([_dump(_filled(t.as_py(), s.as_py())) for t, s in zip(texts, stats, strict=True)], pa.string())

    at = found.select("host", "shape_id", fill("shape", "slots").alias("wrapper"), F.conv(F.substring("shape_id", 1, 12), 16, 10).cast("long").alias("code"))

    def fold(g):
        order = sorted(range(len(g["shape_id"])), key=lambda i: g["shape_id"][i])
        out = None
        for i in order:
            new = json.loads(g["wrapper"][i])
            out = new if out is None else align(out, new, True)
        return {"host": g["host"][:1], "shape_id": [g["shape_id"][order[0]]], "wrapper": [_dump(out)], "code": [min(g["code"])], "bucket": g["bucket"][:1]}

    for r in range(rounds - 1, -1, -1):  # buckets of a host: FAN_IN ** r at most, as many as its expressions need
        at = at.join(counts, "host").withColumn("bucket", F.col("code") % F.greatest(F.lit(1), F.least(F.lit(FAN_IN**r), F.ceil(F.col("n") / FAN_IN ** (rounds - r))).cast("long"))).drop("n") if r else at.withColumn("bucket", F.lit(0).cast("long"))
        at = grouped(at, ["host", "bucket"], fold, "host string, shape_id string, wrapper string, code long, bucket long").drop("bucket")
        if r:
            at = cut(at)
    return at.select("host", "wrapper")


def masks(found: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, shape_id, mask): a character for each slot of an expression, 1 where it is main text."""

    def make():
        known: dict = {}

        def each(b):
            out = {"host": [], "shape_id": [], "mask": []}
            for row in b.to_pylist():
                if row["host"] not in known:
                    if len(known) >= HOSTS:
                        known.clear()
                    wrapper = json.loads(row["wrapper"])
                    known[row["host"]] = wrapper, decide(wrapper)
                items = _filled(row["shape"], row["slots"])
                keep = mask(items, *known[row["host"]])
                if not any(k and s[2][1] for k, s in zip(keep, slots(items), strict=True)):
                    keep = own_mask(items)
                for k, v in zip(out, (row["host"], row["shape_id"], "".join("01"[k] for k in keep)), strict=True):
                    out[k].append(v)
            return out

        return each

    return map_arrow(found.join(wrappers, "host"), make, "host string, shape_id string, mask string")


def learn(pages: DataFrame) -> DataFrame:
    """(host, wrapper): each host's wrapper as JSON; `render(json.loads(wrapper))` shows it as a regular expression."""
    return infer(expressions(pages))


def main_text(items: list, runs: list[str], keep: str | None) -> str:
    """The text runs of the slots that a mask keeps, in page order; without a mask the page's own expression decides."""
    flags = [c == "1" for c in keep] if keep is not None else own_mask(items)
    chosen = sorted(r for x, k in zip(slots(items), flags, strict=True) if k for r in x[2][4])
    return " ".join(runs[r] for r in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """All columns of `pages`, the main text of each page and its length in code points."""
    spark = session(pages)
    found = cut(expressions(pages))
    table = cut(masks(found, infer(found)))
    size = table.agg(F.sum(F.length("host") + F.length("shape_id") + F.length("mask") + 100)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({(r.host, r.shape_id): r.mask for r in table.collect()})

        @F.arrow_udf("text string, n_chars long")
        def main(hosts: pa.Array, htmls: pa.Array) -> pa.Array:
            out = []
            for host, html in zip(hosts, htmls, strict=True):
                items, at, _, runs = _page(html.as_py())
                out.append(main_text(items, runs, shared.value.get((host.as_py(), at))))
            return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["text", "n_chars"])

        return attach(pages, main(host_of(pages["url"]), pages["html"]), ["text", "n_chars"])
    return _joined(pages, table)


#: Copies of a mask among which the pages of one expression are dealt when they are joined.
SALTS = 64


def _joined(pages: DataFrame, table: DataFrame) -> DataFrame:
    """`extract` by a join, for tables of masks of any size."""

    @F.arrow_udf("string")
    def shape_of(htmls: pa.Array) -> pa.Array:
        return pa.array([_page(x.as_py())[1] for x in htmls], pa.string())

    @F.arrow_udf("text string, n_chars long")
    def main(htmls: pa.Array, keeps: pa.Array) -> pa.Array:
        pages = [_page(h.as_py()) for h in htmls]
        out = [main_text(items, runs, k.as_py()) for (items, _, _, runs), k in zip(pages, keeps, strict=True)]
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["text", "n_chars"])

    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = pages.select(F.struct(*(pages[f"`{c}`"] for c in pages.columns)).alias("page"), host_of(pages["url"]).alias("host"), shape_of(pages["html"]).alias("shape_id"))
    mine = mine.withColumn("salt", F.pmod(F.xxhash64("page.html", "page.url"), F.lit(SALTS)).cast("int"))
    rows = mine.join(salted, ["host", "shape_id", "salt"], "left")
    found = rows.select("page", main(F.col("page.html"), F.col("mask")).alias("main"))
    names = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return found.select(*(F.col(f"page.`{c}`") for c in names), "main.text", "main.n_chars")


def query(spark, sf_dir: str) -> DataFrame:
    """Main text of every page from its whole html."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
