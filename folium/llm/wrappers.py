"""Operator 2: main text of web pages by union-free regular-expression inference.

Pages of one host come from few templates. A template is inferred as a wrapper: a regular expression
without unions, made of elements, text slots (#), optional (?) and repeated (+) groups.

1. *Strings.* A page's token stream (tags and texts, comments and raw content skipped) is read into elements
   and blocks of text. A text that stands in one kind of element on TEMPLATE_SHARE of a host's pages, three
   different ones at least, is a constant of its template; all other texts are slots. Pages count as different
   by their longest block, so copies of one article make no constants; headings are none either.
2. *Alignment.* Each page becomes a wrapper in which neighbours that repeat, alone or in groups of any length,
   are repeated groups. Wrappers of one host are aligned, again and again: equal elements and equal constants
   match, elements are aligned inside, a mismatch makes what only one side has optional. Slots add up how much
   text and link text they hold. Every task merges the wrappers of the hosts it meets before the shuffle, so a
   host costs a task one row however many pages it has, and a hot host makes no task larger. A list of more
   than WIDTH items becomes one repeated group of optional items, so a wrapper is bounded by its labels; of
   labels beyond WIDTH in one list, those on most pages stay. Elements deeper than DEPTH stand side by side.
3. The host's wrapper tells which elements hold the article: article or main elements, else the element
   that keeps most of the text on the way down from the body, with all that is beside the way but links
   and texts that are the same on all pages.
4. Each page is read along its host's wrapper. Slots that are menus, headers, footers, sidebars, notices,
   adverts, forms, scripts, styles or comments, by element, role, class or id, or that are mostly links,
   give no text. Inside article and main elements, names that an article's own sections may have (DOUBTFUL hints,
   and hints beside words of other kinds: "market-share") count only where the host's wrapper confirms them: links,
   or the same text on all of its pages; and list
   items of links stay, unless their list is the same on all pages. The wrapper's constants give no text, be
   they in the article or not. What is left becomes one line a block.

Defined results: null or empty html gives an empty text. A url without a host, or null, is a host of its
own, "". Unclosed and stray tags are closed as browsers do for blocks; broken references stay as text.
Repeated rows give repeated results. Other columns are not read. White space is what str.split() splits at.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime as R

TEXTS = "page_id long, url string, text string, n_chars long"
BROADCAST_BYTES, SALTS, LINKED = 8 << 20, 16, 0.6
WIDTH, DEPTH, TEMPLATE_SHARE = 128, 100, 0.8

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Kinds of HTML elements (fixed values of the language).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title xmp noembed noframes svg object audio video canvas select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes, if it is the innermost open block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"}}
#: Elements that never hold an article's text.
APART = frozenset("head nav footer aside form dialog menu button fieldset legend".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words in class or id names that mark what is not the article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsor promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar sidebar aside rail widget widgets "
    "header masthead topbar footer colophon copyright legal cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup login share sharing social related recommended recommendations "
    "comment comments commentlist discussion disqus reply replies respond feedback hidden".split()
)
#: Those that an article's own sections, headings and paragraphs may have too; inside articles the host's wrapper decides.
DOUBTFUL = frozenset("banner promotion navigation aside rail header masthead topbar footer colophon copyright legal notice notices alert related recommended recommendations discussion reply respond feedback".split())
#: Words that names of page furniture are made of besides hints; any other word may make a name an article's own ("market-share").
FURNITURE = frozenset(
    "area bar block body bottom box btn button buttons col column container content count desktop element entry fixed float form group head icon icons "
    "inline inner item items js large left line link links list main mobile module new outer page panel post right row section site slot small static "
    "sticky text thread title tool tools top unit view wrap wrapper zone".split()
)
NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
MAIN = ("article", "main")
#: Elements of running text, which don't lead to an article; pages that make a text a constant of the host.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW, CONSTANT_PAGES = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split()), 3


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def furniture(name: str) -> bool:
    """Whether a class or id names what is never an article's own: a hint that isn't doubtful, and nothing but hints and FURNITURE beside it."""
    parts = {x.lower() for x in NAME_PARTS.findall(name)}
    return bool(parts & (HINTS - DOUBTFUL)) and parts <= HINTS | FURNITURE


class Element:
    """An element of a page: its label, whether hints set it apart, and what it holds: elements and blocks.

    The label of an element inside an article whose hints an article's own parts may have ends with "!"; its host's wrapper decides.
    """

    __slots__ = ("label", "name", "tag", "apart", "inside", "items")

    def __init__(self, tag: str, attributes: str = "", inside: bool = False):
        doubtful = False
        self.name, self.tag, self.items, self.apart, self.inside, names = tag, tag, [], tag in APART, inside, ""
        if attributes and tag not in ("html", "body", "article", "main"):
            for name, *values in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name in ("class", "id"):
                    names += f".{value}"
                    hints = HINTS.intersection(x.lower() for x in NAME_PARTS.findall(value))
                    if inside and hints and not any(map(furniture, value.split())):
                        doubtful = True
                    else:
                        self.apart |= bool(hints)
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in ROLES):
                    self.apart = True
                elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    self.apart = True
                elif name == "role" and value.lower() in MAIN:
                    self.tag = "main"
        elif attributes and tag in MAIN:
            for name, *values in ATTRIBUTE.findall(attributes):
                if name.lower() in ("class", "id") and not {"comment", "comments", "reply", "related", "promo", "ad", "sponsored"}.isdisjoint(x.lower() for x in NAME_PARTS.findall("".join(values))):
                    self.apart = True
        self.label = self.tag + re.sub(r"\d+", "0", names) + "!" * doubtful


class Block:
    """A run of text inside a block: its pieces, and how many characters are in links."""

    __slots__ = ("pieces", "linked")

    def __init__(self):
        self.pieces, self.linked = [], 0

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.pieces)).split())


def read(page: str) -> Element:
    """The page's elements and text blocks. Inline elements don't end a block; a line break is white space."""
    top = Element("#page")
    stack, block, links, at, end, opened = [top], None, 0, 0, len(page), Counter()

    def put(x: Element | Block) -> None:
        """x into the innermost open element; below DEPTH into a copy of that, beside what came before."""
        to = stack[-1]
        if len(stack) > DEPTH:
            if isinstance(x, Block):
                to = Element(to.name)
                to.label, to.tag, to.apart, to.inside = stack[-1].label, stack[-1].tag, stack[-1].apart, stack[-1].inside
                stack[DEPTH - 1].items.append(to)
                to.items.append(x)
            else:
                x.apart |= to.apart
            return
        to.items.append(x)

    def close(i: int) -> None:
        for x in stack[i:]:
            opened[x.name] -= 1
        del stack[i:]

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if page[m.start()] == "<" and at - m.start() > 1:
                continue  # a comment or declaration
            if block is None:
                if m[0].isspace():
                    continue
                block = Block()
                put(block)
            block.pieces.append(m[0])
            if links:
                block.linked += len(m[0])
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW and not closing:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
            if block is not None:
                block.pieces.append(" ") if tag not in ("noscript", "script", "style", "template") else None
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            if block is not None:
                block.pieces.append(" ")
            continue
        if tag not in BLOCK:
            continue
        block = None
        if closing:
            if opened[tag]:
                i = len(stack) - 1
                while stack[i].name != tag:
                    i -= 1
                close(i)
                links = 0
            continue
        if stack[-1].name == "p":
            close(len(stack) - 1)
        if stack[-1].name in CLOSES.get(tag, ()):
            close(len(stack) - 1)
            if tag == "tr" and stack[-1].name == "tr":
                close(len(stack) - 1)
        if tag in ("html", "hr") or (tag == "body" and opened["body"]):
            continue
        e = Element(tag, attributes, stack[-1].inside or stack[-1].tag in MAIN)
        put(e)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(e)
            opened[tag] += 1
    return top


# --- wrappers: [label, optional, repeated, text characters, link characters, items, seen]; a slot's label is "#".
# seen: the number of pages, and hashes of the text and of the text with digits as 0, each null where pages differ.


def seen(text: str) -> list:
    return [1, R.xxhash.xxh3_64_intdigest(text), R.xxhash.xxh3_64_intdigest(re.sub(r"\d+", "0", text))]


def string_key(e: Element, text: str) -> int:
    """What stands for a text in this kind of element."""
    return R.xxhash.xxh3_64_intdigest(f"{e.label}\0{text}") >> 1


def strings(e: Element) -> Iterator[tuple[int, str]]:
    """The key and the text of each block that may be a constant."""
    for x in e.items:
        if not isinstance(x, Block):
            if not x.apart:
                yield from strings(x)
        elif e.tag not in HEADINGS and (text := x.text()):
            yield string_key(e, text), text


def wrapper_of(e: Element, constants: frozenset = frozenset()) -> list:
    """The wrapper of one page's element."""
    items = []
    for x in e.items:
        if not isinstance(x, Block):
            if not x.apart:
                items.append(wrapper_of(x, constants))
            continue
        text = x.text()
        fixed = constants and e.tag not in HEADINGS and string_key(e, text) in constants
        label = "#" if not fixed else f'"{text}"' if len(text) <= 60 else f'"{text[:60]}... {R.xxhash.xxh3_64_hexdigest(text)}"'
        items.append([label, False, False, sum(map(len, x.pieces)), x.linked, [], seen(text)])
    return [e.label, False, False, 0, 0, bounded(folded(items)), [1, 0, 0]]


def labels(items: list) -> list[str]:
    return [x[0] for x in items]


def folded(items: list) -> list:
    """items with neighbouring repetitions, of one item or a group, made into repeated ones."""
    unit = 1
    while unit == 1 or 2 * unit <= len(items) <= WIDTH:
        out, i, names = [], 0, labels(items)
        while i < len(items):
            group, n = items[i : i + unit], 1
            while len(group) == unit and names[i + n * unit : i + (n + 1) * unit] == names[i : i + unit]:
                n += 1
            if n == 1:
                out.append(items[i])
                i += 1
                continue
            for k in range(1, n):
                group = [merged(a, b, along) for a, b in zip(group, items[i + k * unit : i + (k + 1) * unit], strict=True)]
            if unit == 1:
                group[0][2] = True
                out.append(group[0])
            else:
                out.append([f"({' '.join(labels(group))})", False, True, 0, 0, group, [1, 0, 0]])
            i += n * unit
        items, unit = out, unit + 1
    return items


def bounded(items: list) -> list:
    """items, or where they are more than WIDTH, one repeated group of optional items, each label once."""
    if len(items) <= WIDTH:
        return items
    inner: dict[str, list] = {}
    for x in plain(items):
        inner[x[0]] = merged(inner[x[0]], x, along) if x[0] in inner else [x[0], True, *x[2:]]
    if len(inner) > WIDTH:
        most = sorted(inner, key=lambda k: -inner[k][6][0])[:WIDTH]
        inner = {k: v for k, v in inner.items() if k in set(most)}
    return [["(*)", False, True, 0, 0, list(inner.values()), [1, 0, 0]]]


def across(x: list, y: list) -> list:
    """What is seen in a slot on the pages of x and on those of y."""
    return [x[0] + y[0], *(a if a == b else None for a, b in zip(x[1:], y[1:], strict=True))]


def along(x: list, y: list) -> list:
    """What is seen in a repeated slot: the texts of x, then those of y, of the same pages."""
    return [max(x[0], y[0]), *(None if a is None or b is None else (a * 1000003 ^ b) & 0xFFFFFFFFFFFFFFFF for a, b in zip(x[1:], y[1:], strict=True))]


def merged(a: list, b: list, both: Callable = across) -> list:
    """The wrapper that matches what a matches and what b matches; both have one label."""
    return [a[0], a[1] or b[1], a[2] or b[2], a[3] + b[3], a[4] + b[4], aligned(a[5], b[5], both), both(a[6], b[6])]


def aligned(a: list, b: list, both: Callable = across) -> list:
    """A longest common alignment of two item lists; what only one side has becomes optional."""
    if labels(a) == labels(b):
        return [merged(x, y, both) for x, y in zip(a, b, strict=True)]
    if ["(*)"] in (labels(a), labels(b)):
        return bounded_union(a, b, both)
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(merged(a[i], b[j], both))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], True, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], True, *b[j][2:]])
            j += 1
    return bounded(folded(out))


def bounded_union(a: list, b: list, both: Callable) -> list:
    """The group of all labels in two lists one of which is such a group."""
    inner = {x[0]: x for x in plain(a)}
    for x in plain(b):
        inner[x[0]] = merged(inner[x[0]], x, both) if x[0] in inner else x
    if len(inner) > WIDTH:
        most = set(sorted(inner, key=lambda k: -inner[k][6][0])[:WIDTH])
        inner = {k: v for k, v in inner.items() if k in most}
    return [["(*)", False, True, 0, 0, [[x[0], True, *x[2:]] for x in inner.values()], [1, 0, 0]]]


def expression(w: list) -> str:
    """The wrapper as a regular expression."""
    inside = " ".join(map(expression, w[5]))
    body = w[0] if w[0][0] in '#"' and w[0] != "#page" else inside if w[0][0] == "(" else f"<{w[0]}>{inside}</>"
    mark = "+" if w[2] and not w[1] else "*" if w[2] else "?" if w[1] else ""
    return f"({body}){mark}" if mark else body


def mass(w: list) -> int:
    """Text outside links in all slots below."""
    return (0 if w[0][0] == '"' else max(0, w[3] - w[4])) + sum(map(mass, w[5]))


def plain(items: list) -> Iterator[list]:
    """Items, with those of groups in place of the groups."""
    for x in items:
        if x[0][0] == "(":
            yield from plain(x[5])
        else:
            yield x


def has_main(w: list) -> bool:
    return w[0].split(".", 1)[0] in MAIN or any(map(has_main, w[5]))


def slots(w: list) -> Iterator[list]:
    if w[0][0] == '"' or w[0] == "#":
        yield w
    for x in w[5]:
        yield from slots(x)


def constant(w: list, kind: int) -> bool:
    """Whether all texts below are the same on the host's pages, as far as hashes of this kind tell; few pages tell nothing."""
    return all(s[6][0] >= CONSTANT_PAGES and s[6][kind] is not None for s in slots(w))


def set_apart(w: list) -> bool:
    """Whether an element beside the article is none of it: links, or the same on all pages (in containers, up to numbers)."""
    every = list(slots(w))
    return bool(every) and (sum(s[4] for s in every) > LINKED * sum(s[3] for s in every) or constant(w, 1 if tag_of(w) in FLOW else 2))


def refused(w: list) -> list[str]:
    """Labels inside articles, of lists and of elements with doubtful hints, that the wrapper sets apart wherever they are."""
    found: dict[str, bool] = {}

    def look(x: list) -> None:
        if x[0][-1] == "!":
            found[x[0]] = found.get(x[0], True) and set_apart(x)
        elif tag_of(x) in ("ul", "ol"):
            found[x[0]] = found.get(x[0], True) and bool(x[5]) and constant(x, 1)
        for y in x[5]:
            look(y)

    look(w)
    return sorted(k for k, v in found.items() if v)


def tag_of(w: list) -> str:
    return w[0].split(".", 1)[0]


def content_of(w: list, constants: frozenset = frozenset()) -> dict:
    """path_of(), and the constants."""
    return path_of(w) | {"constants": sorted(constants)}


def path_of(w: list) -> dict:
    """What a reader needs of a wrapper: the labels that lead to the article, and at each step those beside it that are none of it."""
    if has_main(w):
        return {"main": True, "path": [], "beside": [], "refused": refused(w)}
    path, beside, node = [], [], w
    while True:
        total = mass(node)
        items = list(plain(node[5]))
        inner = [x for x in items if x[0][0] not in '#"' and tag_of(x) not in FLOW]
        heavy = [x for x in inner if total and mass(x) >= 0.6 * total]
        if len(heavy) != 1:
            # Where even the article is the same everywhere, the pages are copies and tell nothing.
            return {"main": False, "path": path, "beside": [] if constant(node, 1) else beside, "refused": []}
        node = heavy[0]
        kept = {x[0] for x in items if not set_apart(x)}
        path.append(node[0])
        beside.append(sorted({x[0] for x in items} - kept - {node[0]}))


def article_blocks(top: Element, content: dict) -> list[str]:
    """The texts of the article's blocks, in page order."""
    out: list[str] = []
    constants = content["constants"] if isinstance(content["constants"], frozenset) else frozenset(content["constants"])

    def walk(e: Element, inside: bool, path: list, headings: bool = False) -> None:
        for x in e.items:
            if isinstance(x, Block):
                if inside and not headings and (t := x.text()) and not (x.linked > LINKED * sum(map(len, x.pieces)) and e.tag in (("#page", "body") if content["main"] else ("li", "#page", "body"))):
                    if not constants or e.tag in HEADINGS or string_key(e, t) not in constants:
                        out.append(t)
            elif x.apart or x.label in content["refused"]:
                continue
            elif x.tag == "header":
                if inside:  # of an article's own header, the headings stay
                    walk(x, True, [], True)
            elif headings and x.tag in HEADINGS:
                walk(x, True, [])
            elif content["main"]:
                walk(x, inside or x.tag in MAIN, [], headings)
            elif path:
                at = len(content["path"]) - len(path)
                if x.label == path[0] or x.tag == "body":
                    walk(x, True, path[1:] if x.label == path[0] else path, headings)
                elif not content["beside"] or x.label not in content["beside"][at]:
                    walk(x, True, [], headings)
            else:
                walk(x, True, [], headings)

    walk(top, not content["main"], content["path"])
    return out


def extract(page: str, content: dict) -> str:
    """A page's main text, read along its host's wrapper; along its own where that finds nothing."""
    if not page:
        return ""
    top = read(page)
    found = article_blocks(top, content)
    if not found:
        found = article_blocks(top, path_of(wrapper_of(top)) | {"constants": content["constants"]})
    return "\n".join(found)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, key, page: the strings of each host's pages, 0 for all of a page; a page is its longest block."""
    for b in batches:
        rows = set()
        for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            if page:
                host, found = host_of(url), list(strings(read(page)))
                longest = R.xxhash.xxh3_64_intdigest(max((t for _, t in found), key=lambda t: (len(t), t), default="")) >> 1
                rows.update((host, k, longest) for k in {0, *(k for k, _ in found)})
        rows = sorted(rows)
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["host", "key", "page"])


def template_strings(pages: DataFrame) -> DataFrame:
    """host, constants: the keys of the strings on TEMPLATE_SHARE of the host's pages, CONSTANT_PAGES different ones at least."""
    count = pages.mapInArrow(_strings, "host string, key long, page long").distinct().groupBy("host", "key").count().where(F.col("count") >= CONSTANT_PAGES)
    count = R.checkpointed(count)  # else the filters below would be pushed under it, and all pages read twice
    every = count.where("key = 0").select("host", F.col("count").alias("pages"))
    fixed = count.where("key <> 0").join(every, "host").where(F.col("count") >= TEMPLATE_SHARE * F.col("pages"))
    return fixed.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("constants"))  # at most a page's strings / TEMPLATE_SHARE


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list] = {}
    fixed: dict[str, frozenset] = {}
    for b in batches:
        for host, page, constants in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("constants").to_pylist(), strict=True):
            if page:
                if host not in fixed:
                    fixed[host] = frozenset(constants or ())
                w = wrapper_of(read(page), fixed[host])
                known[host] = merged(known[host], w) if host in known else w
    if known:
        yield pa.record_batch([pa.array(list(known)), pa.array([json.dumps([w, sorted(fixed[h])]) for h, w in known.items()])], names=["host", "wrapper"])


def _merge(table: pa.Table) -> pa.Table:
    parts = sorted(table.column("wrapper").to_pylist())
    w, constants = json.loads(parts[0])
    for x in parts[1:]:
        w = merged(w, json.loads(x)[0])
    return pa.table({"host": [table.column("host")[0].as_py()], "wrapper": [json.dumps(w)], "expression": [expression(w)], "content": [json.dumps(content_of(w, frozenset(constants)))]})


def _hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("host", pa.array(list(map(host_of, b.column("url").to_pylist())), pa.string()))


def with_host(pages: DataFrame, found: DataFrame, size: Column, broadcast_bytes: int) -> DataFrame:
    """pages (page_id, url, html) with their host's row of found (host, ...).

    found is broadcast up to that many bytes; beyond them a host's pages are dealt out by salt too.
    """
    hosted = pages.mapInArrow(_hosts, "page_id long, url string, html string, host string")
    if (found.agg(F.sum(F.length("host") + size)).first()[0] or 0) <= broadcast_bytes:
        return hosted.join(F.broadcast(found), "host", "left")
    salted = found.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    return hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def plain_pages(pages: DataFrame) -> DataFrame:
    R.attach(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def infer_wrappers(pages: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """host, wrapper (JSON), expression, content (what extract() needs) of all hosts of pages (page_id, url, html)."""
    pages = plain_pages(pages)
    fixed = R.checkpointed(template_strings(pages))
    found = with_host(pages, fixed, 8 * F.size("constants"), broadcast_bytes).mapInArrow(_infer, "host string, wrapper string")
    return found.groupBy("host").applyInArrow(_merge, "host string, wrapper string, expression string, content string")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    default = json.dumps({"main": True, "path": [], "beside": [], "refused": [], "constants": []})
    contents: dict[str, dict] = {}
    for b in batches:
        out = []
        for page, content in zip(b.column("html").to_pylist(), b.column("content").to_pylist(), strict=True):
            content = content or default
            if content not in contents:
                contents[content] = json.loads(content)
                contents[content]["constants"] = frozenset(contents[content]["constants"])
            out.append(extract(page or "", contents[content]))
        yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    pages = plain_pages(pages)
    found = R.checkpointed(infer_wrappers(pages, broadcast_bytes=broadcast_bytes).select("host", "content"))
    return with_host(pages, found, F.length("content"), broadcast_bytes).mapInArrow(_extract, TEXTS)
