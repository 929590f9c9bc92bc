"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page is read as a tree of elements and texts. The pages of a host are aligned one after the other: children that
match merge, neighbours of one kind fold into a repeated group, children that do not match become optional, a text that
is equal on all pages stays a constant, one that differs becomes a slot. A task aligns the pages of its batches, then
wrappers meet in groups of bounded size until a host has one. The wrapper shows where the host keeps its article: an
article or main element, or else the smallest place that holds all slots which at least half of its pages fill, links
apart. A page's text is what stands there, without what the host puts around its articles and the parts that are menus,
notices and the like.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Set
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
# The elements of HTML by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - set("body head html td th tr tbody tfoot thead caption dd dt li".split())
AGAIN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Elements of parts other than the article.
OTHER = set("nav footer aside form script style noscript template iframe button select textarea input object svg head dialog menu title".split())
#: Words that tell of such a part wherever they stand in a class, id or role, and those that do if all other words of the name are theirs or say nothing.
SURE = set("nav navbar navigation breadcrumb breadcrumbs footer sidebar advert advertisement adverts sponsored cookie cookies gdpr comment comments disqus newsletter popup modal pagination pager contentinfo".split())
PERHAPS = set("menu aside ad ads banner promo promotion sponsor sponsors consent notice notices respond replies share sharing social related recommended subscribe signup overlay toolbar widget complementary search form alert".split())
SAYS_NOTHING = set(
    "0 area articles bar block bottom box button buttons center col container content fixed float frame google group header icon icons inner item items js label left links link list media message module news outer panel policy posts row right section site slot space sticky stories text title top unit widget wrap wrapper zone".split()
)
#: Of these the words for what is never the article's own, wherever it stands: readers' comments, adverts, requests.
STRANGE = set("ad ads advert advertisement adverts sponsor sponsored sponsors promo promotion share sharing comment comments disqus respond replies cookie cookies gdpr consent newsletter subscribe signup popup modal overlay".split())
SITE_HEADER = set("header masthead topbar".split())
ARTICLE_WORDS = set("article post entry content story main".split())
#: Elements that can be the place of an article; text of all others counts for the place around them.
PLACES = set("#root html body div section center form fieldset details dialog td article main".split())
#: Elements nested deeper stand side by side at this depth, as in browsers.
DEEPEST = 200
#: Wrappers that meet in one group; hosts whose wrappers a task holds at a time; how far apart equal elements are looked for; texts of a folded constant.
FAN_IN, HOSTS, AHEAD, CONSTANTS = 64, 2000, 64, 64


class Node:
    __slots__ = ("tag", "words", "name", "children", "parent")

    def __init__(self, tag: str, words: frozenset[str], parent: Node | None):
        self.tag, self.words, self.children, self.parent = tag, words, [], parent
        self.name = " ".join(sorted(words)) if words else ""


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the > of a tag stands that goes on at a place, past quoted values; -1 if it never ends."""
    while m := STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at, before = m.end(), m.start() - 1
        while page[before].isspace():
            before -= 1
        if page[before] == "=" and at <= last[m[0]]:
            at = page.find(m[0], at) + 1
    return -1


def parse(page: str) -> Node:
    """The tree of a page, in one pass whose time is in proportion to its length, with the end tags that HTML lets
    authors leave out; text stands as str children. A tag that never ends is no text."""
    root = Node("#root", frozenset(), None)
    now, count = [root], Counter()  # open elements, and how many of each tag
    last = {x: page.rfind(x) for x in ('"', "'", "-->")}
    start = at = 0
    n = len(page)

    def add(text: str) -> None:
        if len(now) <= DEEPEST:
            now[-1].children.append(text)
        else:
            deep = Node(now[-1].tag, now[-1].words, now[DEEPEST - 1])
            deep.children.append(text)
            now[DEEPEST - 1].children.append(deep)

    while (at := page.find("<", at)) >= 0:
        m = NAME.match(page, at + 1) or page.startswith("/", at + 1) and NAME.match(page, at + 2)
        if not m and page[at + 1 : at + 2] not in ("!", "?"):
            at += 1
            continue
        if at > start:
            add(page[start:at])
        if not m:
            if page.startswith("<!--", at):
                at = page.find("-->", at + 4) + 3 if at + 4 <= last["-->"] else n
            else:
                at = page.find(">", at) + 1 or n
            start = at
            continue
        end, opens, tag = _tag_end(page, m.end(), last), page[at + 1] != "/", m[0].lower()
        start = at = end + 1 or n
        if end < 0:
            break
        if not opens:
            if count[tag]:
                while now[-1].tag != tag:
                    count[now.pop().tag] -= 1
                count[now.pop().tag] -= 1
            elif tag == "p" and len(now) <= DEEPEST:
                now[-1].children.append(Node("p", frozenset(), now[-1]))
            continue
        closing, stop = AGAIN.get(tag, {"p"} if tag in CLOSES_P else ()), WITHIN.get(tag, BLOCK - {"p"})
        if any(count[c] for c in closing):
            for i in range(len(now) - 1, max(0, len(now) - 1 - DEEPEST), -1):
                if now[i].tag in closing:
                    for x in now[i:]:
                        count[x.tag] -= 1
                    del now[i:]
                    break
                if now[i].tag in stop:
                    break
        attributes = page[m.end() : end].strip(" /")
        new = Node(tag, frozenset(w for a in ATTRIBUTE.finditer(attributes) for w in _words(a)) if attributes else frozenset(), now[min(len(now), DEEPEST) - 1])
        if len(now) <= DEEPEST:
            now[-1].children.append(new)
        if tag in VOID:
            continue
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            start = at = over.end() if over else n
            continue
        now.append(new)
        count[tag] += 1
    if start < n:
        add(page[start:])
    return root


def _words(attribute: re.Match) -> list[str]:
    """The words of a class, id or role; #other if a name tells of another part than the article, #strange if it does even
    inside one, #hidden if nothing shows.

    Numbers that tell pages apart do not count, nor do other ids than those that name a part.
    """
    name, value = attribute[1].lower(), attribute[2] or attribute[3] or attribute[4] or ""
    if name in ("hidden", "aria-hidden", "style"):
        return ["#hidden"] if (name == "hidden" or value.strip().lower() == "true" or re.search(r"display\s*:\s*none", value, re.I)) and value.lower() != "false" else []
    out = []
    for whole in value.split():
        parts = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"\d{2,}", "0", re.sub(r"([a-z])([A-Z])", r"\1-\2", whole).lower())) if w]
        if SURE.intersection(parts) or PERHAPS.intersection(parts) and all(w in PERHAPS or w in SAYS_NOTHING for w in parts):
            out.append("#other")
            if STRANGE.intersection(parts) and all(w in STRANGE or w in SURE or w in PERHAPS or w in SAYS_NOTHING or w in ARTICLE_WORDS for w in parts):
                out.append("#strange")
        out.extend(parts if name != "id" else [w for w in parts if w in ARTICLE_WORDS or w in SITE_HEADER])
    return out


def other(node: Node) -> bool:
    """Whether the markup itself says that this is no part of an article."""
    if node.tag in OTHER or "#hidden" in node.words:
        return True
    if node.tag == "header" or node.words & SITE_HEADER:
        p = node.parent
        while p is not None and p.tag not in ("article", "main"):
            p = p.parent
        return p is None
    return node.tag not in ("html", "body", "article", "main") and "#other" in node.words


# A wrapper is [tag, words, quantifier, children]: the quantifier is "" (once), "?" (optional), "+" or "*" (repeated).
# A text has the tag "#" and, in place of words, its digest while it is a constant (or those of a group), nothing once it is a slot.


def _kind(w: list) -> tuple:
    return (w[0], w[1] if w[0] != "#" else "")


def skeleton(node: Node) -> list:
    out: list[list] = []
    for c in node.children:
        if isinstance(c, str) and not (c := " ".join(html.unescape(c).split())):
            continue
        new = ["#", str(digest(c)), "", []] if isinstance(c, str) else skeleton(c)
        if out and _kind(out[-1]) == _kind(new):
            out[-1] = merged(out[-1], new, "+" if out[-1][2] in ("", "+") else "*", True)
        else:
            out.append(new)
    return [node.tag, node.name, "", out]


def aligned(x: list, y: list) -> list[tuple[int, int]]:
    """Places at which two sequences agree, in the order of both, in time in proportion to their lengths.

    What both begin and end with is met first. Between, what stands once in each parts them, the longest chain of these
    in one order; in the gaps the next equal item no further than AHEAD away is taken.
    """
    n, m = len(x), len(y)
    low = 0
    while low < n and low < m and x[low] == y[low]:
        low += 1
    high = 0
    while high < n - low and high < m - low and x[n - 1 - high] == y[m - 1 - high]:
        high += 1
    out = [(i, i) for i in range(low)]
    if low + high < min(n, m):
        inner_x, inner_y = x[low : n - high], y[low : m - high]
        times_x, times_y = Counter(inner_x), Counter(inner_y)
        at = {k: j for j, k in enumerate(inner_y) if times_y[k] == 1}
        once = [(i, at[k]) for i, k in enumerate(inner_x) if times_x[k] == 1 and k in at]
        ends: list[int] = []  # the last place of the chains of each length, and what each item stands behind
        chain, before = [], []
        for i, j in once:
            size = bisect_left(ends, j)
            before.append(chain[size - 1] if size else -1)
            ends[size : size + 1] = [j]
            chain[size : size + 1] = [len(before) - 1]
        anchors, k = [], chain[-1] if chain else -1
        while k >= 0:
            anchors.append(once[k])
            k = before[k]
        i = j = 0
        for p, q in [*reversed(anchors), (len(inner_x), len(inner_y))]:
            while i < p and j < q:
                near = next(((i + d - e, j + e) for d in range(AHEAD) for e in range(d + 1) if i + d - e < p and j + e < q and inner_x[i + d - e] == inner_y[j + e]), None)
                if near is None:
                    i, j = i + AHEAD // 2, j + AHEAD // 2
                    continue
                out.append((low + near[0], low + near[1]))
                i, j = near[0] + 1, near[1] + 1
            if p < len(inner_x):
                out.append((low + p, low + q))
            i, j = p + 1, q + 1
    return [*out, *((n - k, m - k) for k in range(high, 0, -1))]


def merged(a: list, b: list, quantifier: str | None = None, fold: bool = False) -> list:
    """Two wrappers of one element as one: a mismatch of texts becomes a slot, one among its children an optional group.

    Neighbours that fold into one group are no mismatch: their constants stay a set of constants, up to CONSTANTS.
    """
    if quantifier is None:
        some, many = "?" in (a[2], b[2]) or "*" in (a[2], b[2]), bool({"+", "*"} & {a[2], b[2]})
        quantifier = ("*" if some else "+") if many else ("?" if some else "")
    x, y = a[3], b[3]
    if a[0] == "#":
        both = set(a[1].split()) | set(b[1].split()) if fold and a[1] and b[1] else ()
        return ["#", a[1] if a[1] == b[1] else " ".join(sorted(both)) if len(both) <= CONSTANTS else "", quantifier, []]
    if x == y:
        return [a[0], a[1], quantifier, x]
    out: list[list] = []

    def add(new: list) -> None:
        if out and _kind(out[-1]) == _kind(new):
            out[-1] = merged(out[-1], new, "*" if {out[-1][2], new[2]} <= {"?", "*"} else "+", True)
        else:
            out.append(new)

    i = j = 0
    for p, q in [*aligned([_kind(w) for w in x], [_kind(w) for w in y]), (len(x), len(y))]:
        for w in (*x[i:p], *y[j:q]):
            add([w[0], w[1], {"": "?", "+": "*"}.get(w[2], w[2]), w[3]])
        if p < len(x):
            add(merged(x[p], y[q], None, fold))
        i, j = p + 1, q + 1
    return [a[0], a[1], quantifier, out]


def step(tag: str, name: str) -> str:
    """An element in a path as a key."""
    return f"/{tag} {name}"


def amounts(root: Node, template: Set[int] = frozenset()) -> dict[str, int]:
    """Characters of the text that stands directly in the elements of a page, by path, other parts, links and texts of the template left out."""
    out: dict[str, int] = {}
    stack: list[tuple[Node, str]] = [(root, "")]
    while stack:
        node, key = stack.pop()
        key += step(node.tag, node.name)
        size = 0
        for c in node.children:
            if isinstance(c, str):
                if not template or digest(" ".join(html.unescape(c).split())) not in template:
                    size += len(c.strip())
            elif c.tag != "a" and not other(c):
                stack.append((c, key))
        if size:
            out[key] = out.get(key, 0) + size
    return out


def by_name(tag: str, words: set[str] | frozenset[str]) -> int:
    """How surely an element is an article by its name: 3 article, 2 main, 1 a class or id that says so, else 0."""
    return 3 if tag == "article" else 2 if tag == "main" else 1 if words & ARTICLE_WORDS and tag in PLACES and tag != "body" else 0


def article_path(wrapper: list, filled: dict[str, tuple[int, int]] | None = None, pages: int = 1) -> list[list[str]]:
    """The steps (tag, words) from the root to where the host keeps its article; none: the whole page.

    An article element comes first, then main, then an element whose class or id says so, then any, if it holds half
    of the text at least; of these the deepest that holds all that the largest one holds. Text counts by the characters
    of each path and the pages that fill it (filled; without it, each text is one): what fewer than half of the host's
    pages have does not count, nor do constants of a host with several pages, so the wrapper's slots decide. No place is
    inside a repeated group, as the group is read whole.
    """
    found: list[list] = []  # rank, text, path

    def walk(w: list, path: list, key: str, repeated: bool) -> int:
        words = set(w[1].split())
        if w[0] in OTHER or "#hidden" in words or "#other" in words and w[0] not in ("html", "body", "article", "main"):
            return 0
        path, key, repeated = [*path, [w[0], w[1]]], key + step(w[0], w[1]), repeated or w[2] in ("+", "*")
        rank = by_name(w[0], words)
        place = w[0] in PLACES and not repeated and (w[0] != "td" or any(c[0] in BLOCK for c in w[3]))
        me = [rank, 0, path]
        if rank or place or not found:
            found.append(me)
        texts = [c for c in w[3] if c[0] == "#"]
        if texts and (pages < 2 or any(not c[1] for c in texts)):
            size, times = (len(texts), pages) if filled is None else filled.get(key, (0, 0))
            me[1] = size if 2 * times >= pages else 0
        me[1] += sum(walk(c, path, key, repeated) for c in w[3] if c[0] != "#")
        return me[1]

    total = walk(wrapper, [], "", False)
    for rank in (3, 2, 1, 0):
        of = [f for f in found if f[0] == rank or not rank]
        most = max((f[1] for f in of), default=0)
        if most and (2 * most >= total or not rank):
            return max((f for f in of if f[1] == most), key=lambda f: len(f[2]))[2][1:]
    return []


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def extract(page: str, path: list[list[str]], template: Set[int] = frozenset()) -> str:
    """The text of the places in a page that the path leads to.

    A page of another make than its host's is read by its own best place: one that has no such place, or, where no name
    says that the place is an article, most of whose text stands elsewhere. template has the digests of blocks that the
    host's pages share. Without such a name, those of them that stand before or behind all other blocks are left out:
    they are what the host puts around its articles. In an article none are.
    """
    root = parse(page)

    def at(path: list[list[str]]) -> list[Node]:
        places = [root]
        for tag, name in path:
            places = [c for p in places for c in p.children if isinstance(c, Node) and c.tag == tag and c.name == name]
        return places

    says = lambda path: bool(path) and by_name(path[-1][0], frozenset(path[-1][1].split())) > 0
    places = at(path)
    if not places or path and not says(path):
        filled = amounts(root, template)
        inside = sum(len(b) for b in blocks(places) if digest(b) not in template)
        if not places or 2 * inside < sum(filled.values()):
            path = article_path(skeleton(root), {k: (n, 1) for k, n in filled.items()})
            places = at(path)
    named = says(path)
    found = blocks(places, named, template)
    if template and not named:
        own = [i for i, b in enumerate(found) if digest(b) not in template]
        found = found[own[0] : own[-1] + 1] if own else found
    return "\n\n".join(found)


#: Elements whose text leads elsewhere or is part of a form.
AWAY = {"a", *OTHER}


def speaks(node: Node, template: Set[int]) -> bool:
    """Whether a part of an article that is named like another part says something: text that is neither a link, nor of a form, nor shared by the host's pages."""
    stack = list(node.children)
    said = False
    while stack and not said:
        c = stack.pop()
        if isinstance(c, str):
            said = bool(html.unescape(c).strip())
        elif c.tag not in AWAY:
            stack.extend(c.children)
    return said and not (template and all(digest(b) in template for b in blocks([node], True)))


def blocks(places: list[Node], named: bool = False, template: Set[int] = frozenset()) -> list[str]:
    """The blocks of text of some places, without the parts that the markup says are others.

    In places named as articles a part whose name is another's stays if it speaks(), but for what is strange to them.
    """
    out, now = [], []

    def end() -> None:
        text = " ".join(html.unescape("".join(now)).split())
        now.clear()
        if text:
            out.append(text)

    def stays(node: Node) -> bool:
        if not other(node):
            return True
        by_its_name = named and node.tag not in OTHER and node.tag != "header" and not node.words & {"#hidden", "#strange"} and "#other" in node.words
        return by_its_name and (node in places or speaks(node, template))

    stack: list = [*reversed(places)]
    while stack:
        node = stack.pop()
        if node is None:
            end()
        elif isinstance(node, str):
            now.append(node)
        elif node.tag in ("br", "wbr"):
            now.append(" " if node.tag == "br" else "")
        elif stays(node):
            if node.tag in BLOCK or node.tag == "#root":
                end()
                stack.append(None)
            stack.extend(reversed(node.children))
        elif node.tag in BLOCK:
            end()
    end()
    return out


def host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url or "")
    return m[1].lower() if m else ""


READ = "host string, kind string, what string, n long, page long"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What pages tell of their hosts: wrappers of those of a task, characters and pages by path (all pages by the empty one), and the digests of each page's blocks."""
    wrapped: dict[str, list] = {}
    sums: dict[tuple[str, str], list[int]] = {}

    def made(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["host", "kind", "what", "n", "page"], dtype=object).astype({"n": "Int64", "page": "Int64"})

    def ended() -> list[tuple]:
        out = [(name, "wrapper", json.dumps(w), None, None) for name, w in wrapped.items()]
        out += [(name, "filled", path, n, times) for (name, path), (n, times) in sums.items()]
        wrapped.clear()
        sums.clear()
        return out

    for batch in batches:
        rows: dict[tuple, None] = {}
        for u, h in zip(batch["url"], batch["html"], strict=True):
            name, root = host(u), parse(h or "")
            new = skeleton(root)
            wrapped[name] = merged(wrapped[name], new) if name in wrapped else new
            for path, n in (("", 0), *amounts(root).items()):
                own = sums.setdefault((name, path), [0, 0])
                own[0], own[1] = own[0] + n, own[1] + 1
            text = blocks([root], True)
            page = digest("\n".join(text))
            rows.update(((name, "block", str(len(b)), digest(b), page), None) for b in text)
        yield made([*rows, *(ended() if len(wrapped) > HOSTS or len(sums) > 50 * HOSTS else ())])
    yield made(ended())


def _wrapper(group: pd.DataFrame) -> pd.DataFrame:
    """Wrappers of a host as one, in order."""
    out = None
    for s in sorted(group["wrapper"]):
        out = json.loads(s) if out is None else merged(out, json.loads(s))
    return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(out)]})


def wrappers(read: DataFrame) -> DataFrame:
    """host and wrapper: about FAN_IN wrappers of a host become one, again and again until each host has one."""
    now = keep(read.where("kind = 'wrapper'").select("host", F.col("what").alias("wrapper")).distinct())
    while (most := now.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        part = F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // FAN_IN)))
        now = keep(now.groupBy("host", part.alias("part")).applyInPandas(_wrapper, "host string, wrapper string").distinct())
    return now


def templates(read: DataFrame) -> DataFrame:
    """host and template: the digests of blocks that stand word for word on nine in ten of its pages, two at least.

    Pages of equal text count as one.
    """
    block = read.where("kind = 'block'").select("host", "n", "page").distinct()
    pages = block.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    often = block.groupBy("host", "n").agg(F.count("*").alias("times")).where("times > 1").join(pages, "host").where("times * 10 >= pages * 9")
    return often.groupBy("host").agg(F.collect_list("n").alias("template"))


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        of = lambda w, f, n: article_path(json.loads(w), {r["path"]: (r["n"], r["times"]) for r in ([] if f is None else f)}, 1 if pd.isna(n) else int(n))
        paths = [json.dumps(of(*x)) for x in zip(batch["wrapper"], batch["filled"], batch["pages"], strict=True)]
        yield pd.DataFrame({"host": batch["host"], "path": paths})


def article_paths(read: DataFrame) -> DataFrame:
    """host and path, where its wrapper has the article."""
    sums = read.where("kind = 'filled'").groupBy("host", F.col("what").alias("path")).agg(F.sum("n").alias("n"), F.sum("page").alias("times"))
    filled = sums.groupBy("host").agg(F.collect_list(F.struct("path", "n", "times")).alias("filled"))  # as many as the wrapper has elements
    # a host whose pages have one text only counts as one page
    texts = read.where("kind = 'block'").select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    pages = sums.where("path = ''").join(texts, "host", "left").select("host", F.when(F.col("texts") > 1, F.col("times")).otherwise(1).alias("pages"))
    return wrappers(read).join(filled, "host", "left").join(pages, "host", "left").mapInPandas(_paths, "host string, path string")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = zip(*[batch.column(c).to_pylist() for c in ("html", "path", "template")], strict=True)
        texts = [extract(page or "", json.loads(path or "[]"), frozenset(template or ())) for page, path, template in each]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])


#: Bytes of paths and templates of all hosts up to which they go to every task; with more, pages and hosts meet in a join.
SMALL = 16 << 20


def main_text(pages: DataFrame) -> DataFrame:
    """pages without html, with text, in a struct _main: the article's blocks joined by two line feeds, whole.

    Null html gives an empty text, as does a page without an article's text; a null url is a host of its own. White
    space inside a block becomes one space. Every page is read whole, repeated rows each; other columns pass through,
    but for a column _main of the input.
    """
    read = keep(pages.select("url", "html").mapInPandas(_read, READ))
    found = keep(article_paths(read).join(templates(read), "host", "left"))
    size = found.agg(F.sum(F.length("host") + F.length("path") + 8 * F.coalesce(F.size("template"), F.lit(0)))).first()[0] or 0
    others = [c for c in pages.columns if c not in ("html", "_main")]
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")
    # the same host as host() finds
    name = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    whole = pages.select(row, "html", name.alias("host")).join(F.broadcast(found) if size <= SMALL else found, "host", "left").select("row", "html", "path", "template")
    out = whole.mapInArrow(_extract, f"row {whole.schema['row'].dataType.simpleString()}, text string")
    return out.select("row.*", F.struct("text").alias("_main"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page: the main text of its whole html."""
    out = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_main.text").alias("text"), F.length("_main.text").cast("long").alias("n_chars"))
