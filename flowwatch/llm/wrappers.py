"""Main text of pages by inferred wrappers: union-free regular expressions per host.

A page becomes a tree of elements and text; siblings in tandem fold into repeated groups.
Two token streams of one host align level by level: what only one of them has becomes
optional, runs of differing length are repeated groups already, texts that differ become
slots, texts that agree stay literal. The pages of a batch merge to one wrapper per host
before any shuffle, the batches' wrappers in a salted round and then per host, so a host
with a third of all pages sends one small wrapper per batch. Every page then walks its
host's wrapper: what the wrapper's element path says is main text is taken.

Main are the headings and slots below `article`, in pages without one those below `main`,
else the slots of the body. A literal counts as one that never changes, and is left out, if
it stands on pages of SEVERAL different main texts and on half of the host's pages at least.
Below article and main that takes MANY, as a few pages may be versions of one article, and
only whole blocks are left out, no words are cut out of one. Main text is without
navigation, page headers, footers, sidebars, adverts, notices, forms, comments, scripts
and styles, told by element, role and whole classes and ids. An element that holds most of
the articles (or of main) is never passed over, nor is a form or a container told by class
only, unless of comments, that holds most of the text. Character references are
decoded, white space in a block is one space, blocks are joined by a line break.

What pages of one template share names a wrapper's elements: ids that tell no kind of block and
classes with numbers are no part of it, so headings with their own ids are one repeated
group and a wrapper grows with the template, not with the pages. The wrappers are broadcast
once to each worker only below a checked size, else joined by a shuffle.

Defined cases: null or empty html gives an empty text; broken markup is closed as
browsers do (an open p ends at a block, an unknown end is ignored, a cut end closes all);
elements nested deeper than DEEPEST count as children of that level and their end tags
close nothing else, no text is lost; a
null url is a host of its own; repeated rows each give a row; an empty table gives an
empty one; other columns stay unread.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.llm.common import arrow_map, keep, ship

DEEPEST = 60
TABLE, REACH = 250_000, 64  # cells of an alignment table; how far a partner may be without one
SEVERAL, MANY = 3, 8  # different pages that hold a fixed text; the same below article and main
EMPTY: list = ["", 0, 0, [], "", 0, []]
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LARGEST_GROUP = 4
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|title|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>"
    r"|([^<]+)|(<[a-zA-Z/!?][^>]*\Z)|(<)",
    re.S | re.I,
)
#: One attribute after the other, so that no value is taken for an attribute.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|[\"'=/]")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An element that opens ends an open element of these names, up to the nearest barrier.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
DROP_TAGS = frozenset("nav footer aside form head button select menu dialog".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement adslot banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies "
    "complementary copyright dialog disqus footer login masthead menu modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promoted related replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe toolbar widget".split()
)
#: What a block is, if it is the last word of its class (`post-comments`, `google-ad`), but for words of layout.
HEADS = frozenset(
    "ad ads advert adverts advertisement adslot breadcrumb breadcrumbs comment comments disqus footer masthead nav navbar navigation "
    "newsletter pagination replies respond sidebar signup sponsor sponsored subscribe toolbar".split()
)
LAYOUT_WORDS = frozenset(
    "area body bottom box block card col column container content group holder inner item items left list lists main outer panel "
    "region right row section slot thread top unit wrap wrapper zone".split()
)
#: A class with one of these says what is around an element, not what it is: `has-sidebar`.
AROUND = frozenset("has have no not non with without show hide enable enabled disable disabled allow allows".split())
#: What readers say may be longer than the text.
TALK = frozenset("comment comments disqus replies respond".split())
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Element:
    __slots__ = ("tag", "key", "name", "kids", "deep", "mass")

    def __init__(self, tag: str, key: str):
        self.tag, self.key, self.kids = tag, key, []
        self.name = general(key)  # what pages of one template share
        self.deep: dict[str, int] = {}  # open elements below the deepest level, by name
        self.mass = (0, 0, 0)  # characters of text: all, in articles, in main


def parse(page: str | None) -> Element:
    """Tree of elements and text, for any input."""
    root = Element("", "")
    stack = [root]
    for m in TOKEN.finditer(page or ""):
        text = m.group(8) or m.group(10)
        if text:
            kids = stack[-1].kids
            if kids and isinstance(kids[-1], str):
                kids[-1] += text
            else:
                kids.append(text)
            continue
        tag = (m.group(3) or m.group(6) or "").lower()
        if not tag:
            continue
        if m.group(2) or m.group(5):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].deep.get(tag):
                    del stack[i + 1 :]
                    stack[i].deep[tag] -= 1
                    if tag in BLOCK:  # the text that follows is another block
                        stack[i].kids.append(Element(tag, tag))
                    break
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in ("article", "main"):
            for i in range(1, len(stack)):  # an unclosed menu does not hold the article
                if stack[i].tag in ("nav", "header", "footer", "aside", "form"):
                    del stack[i:]
                    break
        if tag in ENDS:
            ends, barrier = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in barrier:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
                    break
        key = tag
        if attributes := (m.group(4) or m.group(7)):
            found = {}
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                if name.lower() in ("class", "id", "role"):
                    found.setdefault(name.lower(), a or b or c)
            if found:
                key += "".join(f" {n}={re.sub(r'[0-9]+', '0', found[n])}" for n in sorted(found))
        node = Element(tag, key)
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        # below the deepest level only what decides on main text holds its text, and not without end
        if len(stack) <= DEEPEST or len(stack) <= DEEPEST + 8 and (tag in ("article", "main") or dropped(key, tag, False)):
            stack.append(node)
        else:
            stack[-1].deep[tag] = stack[-1].deep.get(tag, 0) + 1
    return root


def weigh(node: Element) -> tuple[int, int, int]:
    """Sets the mass of an element and of all below it."""
    size = article = main = 0
    for kid in node.kids:
        if isinstance(kid, str):
            size += len(kid) - kid.count(" ")
        else:
            s, a, m = weigh(kid)
            size, article, main = size + s, article + a, main + m
    node.mass = (size, size if node.tag == "article" else article, size if node.tag == "main" or "role=main" in node.key else main)
    return node.mass


# A wrapper node: [key, optional, repeated, kids, literal, pages, prints]; text has the key
# "#", a group "(". Of a literal, pages counts those that hold it, and prints are the smallest
# MANY hashes of their main texts, so copies of one page count as one there.


def wrapper(node: Element, mark: str = "") -> list:
    """Wrapper of one page's element; `mark` is the hash of the page's main text."""
    kids: list = []
    for kid in node.kids:
        if isinstance(kid, str):
            text = " ".join(kid.split())
            if text:
                kids.append(["#", 0, 0, [], xxhash.xxh64_hexdigest(text), 1, [mark]])
        else:
            kids.append(wrapper(kid, mark))
    return [node.name, 0, 0, fold(kids), "", 0, []]


@lru_cache(1 << 14)
def general(key: str) -> str:
    """A key without what differs from page to page of one template: ids that name no kind of
    block, and classes with numbers."""
    tag, _, rest = key.partition(" ")
    out = tag
    for name, value in re.findall(r"(class|id|role)=((?:(?! class=| id=| role=).)*)", rest, re.S):
        kept = [t for t in value.split() if "0" not in t]
        if name == "id":
            kept = [t for t in kept if any(w in DROP_WORDS for w in spelled(t))]
        if kept:
            out += f" {name}={' '.join(kept)}"
    return out


def names(nodes: list) -> tuple:
    return tuple(n[0] if n[0] != "(" else ("(", names(n[3])) for n in nodes)


def fold(nodes: list) -> list:
    """Tandem repeats become repeated nodes and groups."""
    out: list = []
    for node in nodes:
        out.append(node)
        again = True
        while again:
            again = False
            for size in range(1, LARGEST_GROUP + 1):
                if len(out) > size and out[-size - 1][0] == "(" and len(out[-size - 1][3]) == size and names(out[-size - 1][3]) == names(out[-size:]):
                    group = out[-size - 1]
                    group[3] = [merge(a, b, True) for a, b in zip(group[3], out[-size:], strict=True)]
                    del out[-size:]
                    again = True
                    break
                if len(out) >= 2 * size and names(out[-size:]) == names(out[-2 * size : -size]):
                    both = [merge(a, b, True) for a, b in zip(out[-2 * size : -size], out[-size:], strict=True)]
                    del out[-2 * size :]
                    if size == 1:
                        both[0][2] = 1
                        out += both
                    else:
                        out.append(["(", 0, 1, both, "", 0, []])
                    again = True
                    break
    return out


def merge(a: list, b: list, same: bool = False) -> list:
    """The wrapper of two nodes of one key; of the same pages, or of different ones."""
    kids = align(a[3], b[3], same) if a[3] or b[3] else []
    if not a[4] or a[4] != b[4]:
        return [a[0], a[1] | b[1], a[2] | b[2], kids, "", 0, []]
    pages = max(a[5], b[5]) if same else a[5] + b[5]
    return [a[0], a[1] | b[1], a[2] | b[2], kids, a[4], pages, sorted({*a[6], *b[6]})[:MANY]]


def align(a: list, b: list, same: bool = False) -> list:
    """Longest common subsequence of keys; what only one side has becomes optional."""
    x, y = names(a), names(b)
    if x == y:
        return [merge(p, q, same) for p, q in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for p, q in common(x, y):
        out += [[k[0], 1, *k[2:]] for k in a[i:p] + b[j:q]]
        out.append(merge(a[p], b[q], same))
        i, j = p + 1, q + 1
    return fold(out + [[k[0], 1, *k[2:]] for k in a[i:] + b[j:]])


def common(x: tuple, y: tuple) -> list[tuple[int, int]]:
    """Places of a common subsequence: the longest one for streams of up to TABLE cells, else
    the longest one of what occurs once on either side, and between these again; a stretch
    without such an anchor takes each token's next partner. Space and time stay near-linear."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and x[i] == y[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and x[n - 1] == y[m - 1]:
            n, m = n - 1, m - 1
            found.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= TABLE:
            found += longest(x, y, i, n, j, m)
        elif anchors := unique_anchors(x, y, i, n, j, m):
            for p, q in [*anchors, (n, m)]:
                todo.append((i, p, j, q))
                i, j = p + 1, q + 1
            found += anchors
        else:
            found += next_partners(x, y, i, n, j, m)
    return sorted(found)


def next_partners(x: tuple, y: tuple, i: int, n: int, j: int, m: int) -> list[tuple[int, int]]:
    where: dict = {}
    for q in range(m - 1, j - 1, -1):
        where.setdefault(y[q], []).append(q)
    found = []
    for p in range(i, n):
        ahead = where.get(x[p], [])
        while ahead and ahead[-1] < j:
            ahead.pop()
        if ahead and ahead[-1] - j <= REACH:  # a partner far away would cost all between
            found.append((p, ahead[-1]))
            j = ahead[-1] + 1
    return found


def unique_anchors(x: tuple, y: tuple, i: int, n: int, j: int, m: int) -> list[tuple[int, int]]:
    """The longest rising run of tokens that occur once on either side."""
    left, right = Counter(x[i:n]), Counter(y[j:m])
    at = {y[q]: q for q in range(j, m) if right[y[q]] == 1}
    pairs = [(p, at[x[p]]) for p in range(i, n) if left[x[p]] == 1 and x[p] in at]
    ends: list[int] = []
    tops: list[int] = []
    back: list[int] = []
    for k, (_, q) in enumerate(pairs):
        place = bisect_left(ends, q)
        back.append(tops[place - 1] if place else -1)
        ends[place : place + 1] = [q]
        tops[place : place + 1] = [k]
    out = []
    k = tops[-1] if tops else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def longest(x: tuple, y: tuple, i: int, n: int, j: int, m: int) -> list[tuple[int, int]]:
    """The longest common subsequence of two short stretches."""
    x, y, left, right = x[i:n], y[j:m], i, j
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    found, i, j = [], 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            found.append((left + i, right + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


@lru_cache(1 << 14)
def dropped(key: str, tag: str, inside: bool) -> bool:
    """Whether an element of this key is no main text. Headers of an article are.

    A class or id counts where all its words do: `sidebar` and `cookieNotice`, not
    `related-work`; that of a block also where its head does: `post-comments`, `google-ad`
    and `comment-list`, not `has-sidebar`. A notice in an article may belong to it."""
    if tag in DROP_TAGS or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for ordered in tokens(key):
        words = frozenset(ordered)
        if tag in BLOCK and heads(ordered):
            return True
        if words <= DROP_WORDS and not (inside and words <= {"notice", "notices"}) or not inside and words == {"header"}:
            return True
    return False


def heads(words: tuple[str, ...]) -> bool:
    """Whether the last word that is none of layout names what is no main text."""
    if AROUND & {*words}:
        return False
    for word in reversed(words):
        if word not in LAYOUT_WORDS:
            return word in HEADS
    return False


@lru_cache(1 << 14)
def spelled(token: str) -> tuple[str, ...]:
    """The words of one class or id in small letters; `commentlist` is comment and list."""
    out: list[str] = []
    for word in _WORDS.findall(token):
        word = word.lower()
        cut = next((k for k in range(2, len(word) - 1) if word not in DROP_WORDS and word[:k] in HEADS and word[k:] in LAYOUT_WORDS), 0)
        out += [word[:cut], word[cut:]] if cut else [word]
    return tuple(out)


def tokens(key: str) -> list[tuple[str, ...]]:
    """The words of each class, id and role of a key; numbers count for nothing."""
    values = re.findall(r"(?:class|id|role)=((?:(?! class=| id=| role=).)*)", key.partition(" ")[2], re.S)
    return [words for v in values for t in v.split() if (words := spelled(t))]


@lru_cache(1 << 14)
def layout(key: str, tag: str) -> bool:
    """Whether a dropped element may be a mere container, if most of the text is in it."""
    return (tag == "form" or tag not in DROP_TAGS and tag != "header") and not any(TALK & {*w} for w in tokens(key))


def expression(node: list) -> str:
    """A wrapper as a regular expression over tags and text slots."""
    if node[0] == "#":
        out = f"'{node[4]}'" if node[4] else "#TEXT"
    elif node[0] == "(":
        out = "".join(map(expression, node[3]))
    else:
        out = f"<{node[0]}>" + "".join(map(expression, node[3]))
    if node[1] or node[2]:
        out = f"({out})" + ("*" if node[1] and node[2] else "?" if node[1] else "+")
    return out


class Reader:
    """Reads pages by the wrapper of their host."""

    def __init__(self, root: list, pages: int):
        self.root, self.pages = root, pages
        self.children: dict[int, dict] = {}

    def fixed(self, slot: list, different: int) -> bool:
        """Whether a text never changes on the host: it stands on so many different pages
        and on half of all pages at least."""
        return bool(slot[4]) and len(slot[6]) >= different and 2 * slot[5] >= self.pages

    def below(self, node: list) -> dict:
        """Children of a wrapper node by key, groups opened, those of one key as one; under
        "#" the hashes of the texts fixed in a body, and under "" of those fixed below article
        and main. Made once per node."""
        found = self.children.get(id(node))
        if found is None:
            found = self.children[id(node)] = {"#": set(), "": set()}
            todo = list(reversed(node[3]))
            while todo:
                kid = todo.pop()
                if kid[0] == "(":
                    todo += reversed(kid[3])
                elif kid[0] == "#":
                    for name, different in (("#", SEVERAL), ("", MANY)):
                        if self.fixed(kid, different):
                            found[name].add(kid[4])
                elif kid[0] in found:
                    found[kid[0]] = [*kid[:3], found[kid[0]][3] + kid[3], *kid[4:]]
                else:
                    found[kid[0]] = kid
        return found

    def text(self, page: Element) -> str:
        weigh(page)
        for place in ("article", "main", ""):
            blocks: list[str] = []
            if self._walk(page, self.root, not place, place, blocks, ["", ""], page):
                break
        return "\n".join(blocks)

    def _walk(self, page: Element, node: list, inside: bool, place: str, blocks: list[str], line: list[str], whole: Element, head: bool = False) -> bool:
        """Blocks of main text in page order; whether the place was there at all. `whole` is
        the place, or the page outside of it; `head` is in a heading. In a line, the second
        part waits for text that changes."""
        below, found = self.below(node), inside
        texts = below["" if place else "#"]
        for kid in page.kids:
            if isinstance(kid, str):
                if inside:
                    fixed = texts and xxhash.xxh64_hexdigest(" ".join(kid.split())) in texts
                    if fixed and place and not head:
                        line[1] += kid  # shown only where its block has other text
                    elif fixed and not place:
                        continue
                    elif kid.strip():
                        line[0], line[1] = line[0] + line[1] + kid, ""
                    else:
                        line[1] += kid
                continue
            if kid.tag == "br":
                line[1] += " "
                continue
            deeper = below.get(kid.name) or EMPTY
            in_drop, out_drop = dropped(kid.key, kid.tag, True), dropped(kid.key, kid.tag, False)
            if (in_drop if inside and place else out_drop) and not holds(kid, whole, inside, place):
                if kid.tag in BLOCK:
                    flush(blocks, line)
                continue
            opens = bool(place) and not inside and (kid.tag == place or place == "main" and "role=main" in kid.key)
            if kid.tag in BLOCK or opens:
                flush(blocks, line)
            found |= self._walk(kid, deeper, inside or opens, place, blocks, line, kid if opens else whole, head or kid.tag in HEADINGS)
            if kid.tag in BLOCK or opens:
                flush(blocks, line)
        if node is self.root:
            flush(blocks, line)
        return found


def holds(kid: Element, whole: Element, inside: bool, place: str) -> bool:
    """Whether an element has most of what is sought: the text of the place, or, outside of
    it, the places themselves. Such an element isn't dropped for its name."""
    part = 0 if inside else 1 if place == "article" else 2
    return 2 * kid.mass[part] > whole.mass[part] and (not inside or layout(kid.key, kid.tag))


def flush(blocks: list[str], line: list[str]) -> None:
    # what follows the last text that changes is a part of its block
    text = " ".join(entities.unescape(line[0] + line[1] if line[0] else "").split())
    if text:
        blocks.append(text)
    line[0] = line[1] = ""


def host(url: str) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m.group(1).lower() if m else ""


def host_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: int = 32) -> DataFrame:
    """(host, pages, wrapper, expression): one wrapper per host."""
    ship(pages.sparkSession)

    def of_batch(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        found: dict[str, list] = {}
        plain = Reader(EMPTY, 0)
        for url, page in zip(batch.column(0), batch.column(1), strict=True):
            tree = parse(page.as_py())
            mark = xxhash.xxh64_hexdigest(plain.text(tree))
            name, root = host(url.as_py()), wrapper(tree, mark)
            if name in found:
                found[name] = [found[name][0] + 1, merge(found[name][1], root)]
            else:
                found[name] = [1, root]
        yield rows(found)

    def rows(found: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()),
             pa.array([json.dumps(v[1]) for v in found.values()], pa.string())], names=["host", "pages", "wrapper"],
        )

    def united(group: pa.Table) -> pa.Table:
        parts = sorted(group.column("wrapper").to_pylist())
        root = json.loads(parts[0])
        for part in parts[1:]:
            root = merge(root, json.loads(part))
        name = group.column("host")[0].as_py()
        return pa.Table.from_batches([rows({name: [sum(group.column("pages").to_pylist()), root]})])

    kind = "host string, pages long, wrapper string"
    per_batch = arrow_map(pages.select(url_col, html_col), of_batch, kind)
    return (
        per_batch.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).groupBy("host", "salt").applyInArrow(united, kind)
        .groupBy("host").applyInArrow(united, kind)
    )


def main_texts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bound: int = 16 << 20
) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    wrappers = keep(host_wrappers(pages, url_col, html_col), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"),
    )
    if size <= bound:  # every wrapper goes once to each worker
        found = {r["host"]: (r["wrapper"], r["pages"]) for r in wrappers.collect()}
        shared = pages.sparkSession.sparkContext.broadcast(found)
        joined = rows.select("id", "url", "html", "host")
    else:
        shared = None
        joined = rows.join(wrappers.select("host", "wrapper", F.col("pages").alias("n_pages")), "host", "left")
        joined = joined.select("id", "url", "html", "host", "wrapper", "n_pages")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        readers: dict[str, Reader] = {}
        for batch in batches:
            texts = []
            for i, (page, name) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                key = name.as_py()
                if key not in readers:
                    if len(readers) >= 256:  # wrappers that stay open
                        readers.clear()
                    root, n = shared.value.get(key, (None, 0)) if shared else (batch.column(4)[i].as_py(), batch.column(5)[i].as_py())
                    readers[key] = Reader(json.loads(root or json.dumps(EMPTY)), n or 0)
                texts.append(readers[key].text(parse(page.as_py())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    out = joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
