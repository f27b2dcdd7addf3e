"""Main text of web pages by wrapper induction.

Pages of a host are aligned by simple tree matching: two nodes match if their labels (tag and class, without tokens that
hold digits) are equal, and their children by the best order-preserving matching. Runs of siblings of one label fold into
one node first, as lists and paragraphs do. Over all pages of a host, a node whose text is the same everywhere, or one of
a few texts, is template; one whose text differs from page to page is a slot. From the root down, the template is
followed to the container that holds nearly all that varies: that is the content region, whatever its tags and names, with
headings and paragraphs that stand beside it on the way. In it, blocks that every page repeats are template and go.

Tags and names say what varies but is no article: navigation, forms, adverts, comments and the like. Names that an article
may bear too (a section on related work, on legal matters) count only where most of the text is linked. Only pages of
hosts with fewer than REGION_PAGES different pages, and pages that lack their host's region, are read by tags and names
alone: article, main, what is called content, or else the body without lists of links.

Templates are folded where the pages are, then merged in two steps, by host and salt and by host, so a host with a
third of all pages meets in no task; a template holds structure and hashes, no text, and its size follows the pages'
structure and not their number: a node has at most MOST_KIDS children, beyond which those of one tag are one. How many
different pages a node stands on, with how many different contents and characters, is counted over all pages of the host:
what pages have in each node is kept as marks, and aggregated by host, node, page and content. The last pass reads the
pages again, with their host's template.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, unstage

#: Fixed values of HTML: elements without content, with raw text, and that start a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas audio video annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements that an opening tag closes, if they are open in the same container.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body article section main div aside nav header footer form table ul ol dl td th blockquote figure details".split())
#: Elements and words of class, id and role that are not main text.
NOT_MAIN = frozenset("head title nav header footer aside form button select textarea input label menu dialog".split()) | RAW
NOT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promos sponsor sponsored sponsors nav navbar navigation menu menus "
    "breadcrumb breadcrumbs masthead topbar footer colophon sidebar sidebars aside widget widgets notice notices cookie cookies consent gdpr popup modal "
    "overlay newsletter subscribe signup login comment comments commentlist disqus respond pager pagination toolbar complementary contentinfo".split()
)
#: Words that name an article's own sections too: what bears them is none only where most of its text is linked.
MAYBE_WORDS = frozenset(
    "header promotion subscription alert reply replies share sharing social related recommended recommendations copyright legal disclaimer skip search contact".split()
)
MAIN_WORDS = frozenset("article main content post entry story body text articlebody maincontent postcontent entrycontent".split())
#: Different pages that a host has at least before its template names the region, and before what is the same on all of
#: them is template inside it.
REGION_PAGES, LEAST_PAGES = 3, 5
#: Different pages from which on a node's text has its full weight, and the share of a host's pages that is nearly all.
FULL, NEARLY_ALL = 10, 0.9
#: Different contents for a page from which on they vary; shares of a container's varying text that lead on into
#: the one that has it, and that any other one has at most; share of linked text from which a block is a list of links.
VARIES, LEADS, BESIDE, LINKED = 0.5, 0.5, 0.2, 0.6
#: Levels of a template; what stands further in is no template's. Pages are read to any depth.
DEEPEST = 200
#: Runs of siblings from which all of one label are one, and children of a template's node.
MOST_RUNS, MOST_KIDS = 24, 48
#: Elements that hold blocks, and those that are content where they stand beside the region.
CONTAINERS = frozenset("#root html body main article section div table tbody tr td ul ol li center form fieldset details dl dd header hgroup".split())
CONTENT = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figure".split())
#: Salts by which a host's partial templates meet first.
SALTS = 32


#: The class of a template's node that stands for those of a tag, whatever their class.
ANY = "*"


_NONE: frozenset = frozenset()


@lru_cache(maxsize=1 << 14)
def _words(named: str) -> frozenset:
    return frozenset(re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower().replace("-", " ").replace("_", " ").split())


@lru_cache(maxsize=1 << 14)
def _class(text: str) -> str:
    """The tokens of a class without those that hold digits."""
    return " ".join(x for x in text.split() if not re.search(r"\d", x))


class Node:
    __slots__ = ("kids", "label", "tag", "words")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.kids, self.words = tag, [], _NONE
        if not attrs:
            self.label = (tag, "")
            return
        self.label = (tag, _class(attrs["class"]) if "class" in attrs else "")
        for k in ("class", "id", "role", "itemprop"):
            if attrs.get(k):
                self.words |= _words(attrs[k])
        if "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", ""):
            self.words |= {"popup"}


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _end(self, tags: set, upto: frozenset) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in upto:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._end({"p"}, SCOPE)
        if tag in CLOSED_BY:
            self._end(CLOSED_BY[tag], SCOPE - CLOSED_BY[tag])
        if tag == "body":
            self._end({"head"}, frozenset())
        node = Node(tag, {k: v or "" for k, v in attrs} if attrs else None)
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in RAW and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if tag not in BLOCK and self.open[k].tag in BLOCK:
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def parse(html: str | None) -> Node:
    """The page's tree; anything parses. Children are nodes and texts with their references decoded."""
    page = _Builder()
    page.feed(html or "")
    page.close()
    return page.root


def linked(node: Node) -> float:
    """The share of the characters under a node that stand in links."""
    every = inside = 0
    left = [(node, False)]
    while left:
        one, a = left.pop()
        a = a or one.tag == "a"
        for k in one.kids:
            if isinstance(k, str):
                n = len("".join(k.split()))
                every += n
                inside += n if a else 0
            elif k.tag not in RAW:
                left.append((k, a))
    return inside / every if every else 0.0


def is_boilerplate(node: Node, inside: bool) -> bool:
    """inside: in the content region, where a header holds the article's own title."""
    if node.tag in NOT_MAIN:
        return not (inside and node.tag == "header" and not node.words & NOT_WORDS)
    if node.tag in ("html", "body", "article", "main"):
        return False
    return bool(node.words & NOT_WORDS) or bool(node.words & MAYBE_WORDS) and linked(node) >= LINKED


class Folded:
    """A node, or a run of siblings of one label, with the texts that stand in it directly."""

    __slots__ = ("kids", "label", "nodes")

    def __init__(self, nodes: list[Node], level: int = 1):
        self.label, self.nodes, self.kids = nodes[0].label, nodes, []
        if level == DEEPEST:
            return
        runs: list[list[Node]] = []
        for node in nodes if len(nodes) == 1 else ():
            for kid in node.kids:
                if isinstance(kid, str):
                    continue
                if runs and runs[-1][0].label == kid.label:
                    runs[-1].append(kid)
                else:
                    runs.append([kid])
        if len(nodes) > 1 or len(runs) > MOST_RUNS:
            by_label: dict[tuple, list[Node]] = {}
            for node in nodes:
                for kid in node.kids:
                    if not isinstance(kid, str):
                        by_label.setdefault(kid.label, []).append(kid)
            if len(by_label) > MOST_KIDS:
                by_tag: dict[str, list[Node]] = {}
                for (tag, _), some in by_label.items():
                    by_tag.setdefault(tag, []).extend(some)
                runs = list(by_tag.values())
            else:
                runs = list(by_label.values())
        self.kids = [Folded(x, level + 1) for x in runs]
        if len(nodes) > 1 or len(runs) > MOST_RUNS:
            for k in self.kids:
                if len({n.label for n in k.nodes}) > 1:
                    k.label = (k.label[0], ANY)

    def texts(self) -> list[str]:
        return [x for n in self.nodes if n.tag not in RAW and (x := " ".join(" ".join(k for k in n.kids if isinstance(k, str)).split()))]


def _hash(text: str | bytes) -> bytes:
    return blake2b(text if isinstance(text, bytes) else text.encode("utf-8", "replace"), digest_size=8).digest()


def _long(hashed: bytes) -> int:
    return int.from_bytes(hashed, "little", signed=True)


def _page(root: Node) -> tuple[bytes, bytes]:
    """Hash of a page's main text, which copies share, and of its two longest blocks, which near copies share too."""
    blocks = extract(root).split("\n")
    return _hash("\n".join(blocks)), _hash("\n".join(sorted(blocks, key=lambda x: (-len(x), x))[:2]))


class Slot:
    """A node of a template: hashes of the texts that are in it on every page; of pages that are no near copies the least
    LEAST_PAGES hashes, by which up to so many are counted exactly; whether it ever has text; and whether it is boilerplate
    by tag or name. counts: different pages on which it stands, their different contents, and their characters, over all
    pages. They come from pages (by page its content and characters) where all of a host are merged in one place, and else
    from the aggregate of all marks; pages are never written. region, beside and total are settled by decide()."""

    __slots__ = ("apart", "beside", "boiler", "counts", "kids", "label", "pages", "region", "said", "same", "total")

    def __init__(self, folded: Folded, page: tuple[bytes, bytes] | None = None):
        page = page or _page(folded.nodes[0])
        texts = folded.texts()
        hashes = sorted(map(_hash, texts))
        self.label, self.same, self.said, self.counts = folded.label, frozenset(hashes), bool(texts), None
        self.pages = {_long(page[0]): (_long(_hash(b"".join(hashes))) if texts else 0, sum(map(len, texts)))}
        self.apart = frozenset(page[1:])
        self.boiler = is_boilerplate(folded.nodes[0], True) or folded.label[0] == "a"
        self.kids = [Slot(k, page) for k in folded.kids]

    def __getstate__(self):
        return (self.label, self.apart, self.same, self.said, self.boiler, self.counts, self.kids)

    def __setstate__(self, state):
        self.label, self.apart, self.same, self.said, self.boiler, self.counts, self.kids = state
        self.pages = {}

    def own(self) -> float:
        """Characters a page of its own text that vary from page to page; less where it stands on few pages."""
        pages, contents, chars = self.counts
        if self.boiler or not pages or contents < max(2, VARIES * pages) and pages > 1:
            return 0.0
        return chars / pages * min(pages, FULL)


def preorder(template: Slot) -> list[Slot]:
    """A template's nodes; a node's place among them is its number."""
    out, left = [], [template]
    while left:
        out.append(left.pop())
        left += reversed(out[-1].kids)
    return out


def marks(slot: Slot) -> tuple:
    """Of one page's own template, each node's label, content, characters and children."""
    ((content, chars),) = slot.pages.values()
    return (slot.label, content, chars, [marks(k) for k in slot.kids])


class Mark:
    """A node of a page as marks() keeps it."""

    __slots__ = ("chars", "content", "kids", "label")

    def __init__(self, state: tuple):
        self.label, self.content, self.chars, kids = state
        self.kids = [Mark(k) for k in kids]


def standing(slot: Slot, mark: Mark, number: dict[int, int], out: list) -> None:
    """Appends (number, content, characters) of the template's nodes on a page, but for those that never have text, and for
    what is no main text by its tag, with all inside: nothing is read there."""
    if slot.said or not out:  # the root counts the pages
        out.append((number[id(slot)], mark.content, mark.chars))
    if slot.label[0] not in NOT_MAIN or slot.label[0] == "header":
        for x, y in _pairs(slot.kids, mark.kids, {}):
            standing(slot.kids[x], mark.kids[y], number, out)


def fits(a, b) -> bool:
    """Whether the labels of two nodes of templates or pages match."""
    return a.label == b.label or a.label[0] == b.label[0] and ANY in (a.label[1], b.label[1])


def score(a, b, known: dict | None = None) -> int:
    """Nodes of the largest simple tree matching of two trees whose roots match."""
    known = {} if known is None else known
    key = (id(a), id(b))
    if key not in known:
        known[key] = 1 + sum(score(a.kids[i], b.kids[j], known) for i, j in _pairs(a.kids, b.kids, known))
    return known[key]


def _pairs(xs: list, ys: list, known: dict) -> list[tuple[int, int]]:
    """The best order-preserving matching of two lists of children."""
    if len(xs) == len(ys) and all(x.label == y.label for x, y in zip(xs, ys, strict=True)):
        return [(i, i) for i in range(len(xs))]
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    w = [[score(x, y, known) if fits(x, y) else 0 for y in ys] for x in xs]
    for i in range(len(xs) - 1, -1, -1):
        for j in range(len(ys) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + w[i][j] if w[i][j] else 0)
    i = j = 0
    out = []
    while i < len(xs) and j < len(ys):
        if w[i][j] and best[i][j] == best[i + 1][j + 1] + w[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def merge(a: Slot, b: Slot, known: dict | None = None, whole: bool = True) -> Slot:
    """The template of two templates whose roots match; what one lacks is kept from the other. Changes a. whole: pages are
    kept, so that all pages of a host are counted here; else they are counted by their marks."""
    known = {} if known is None else known
    pairs = [*_pairs(a.kids, b.kids, known), (len(a.kids), len(b.kids))]  # before a changes
    if a.label != b.label:
        a.label = (a.label[0], ANY)
    for p, (content, chars) in b.pages.items() if whole else ():
        was = a.pages.get(p, (content, chars))  # copies of a page's main text are one page
        a.pages[p] = (min(content, was[0]), max(chars, was[1]))
    if not whole:
        a.pages = {}
    a.apart = frozenset(sorted(a.apart | b.apart)[:LEAST_PAGES])
    a.same &= b.same
    a.said |= b.said
    a.boiler &= b.boiler
    kids, i, j = [], 0, 0
    for x, y in pairs:
        kids += a.kids[i:x] + b.kids[j:y]
        if x < len(a.kids):
            kids.append(merge(a.kids[x], b.kids[y], known, whole))
        i, j = x + 1, y + 1
    if len(kids) > MOST_KIDS:
        by_tag: dict[str, Slot] = {}
        for k in kids:
            tag = k.label[0]
            by_tag[tag] = merge(by_tag[tag], k, whole=whole) if tag in by_tag else k
        kids = list(by_tag.values())
        for k in kids:
            k.label = (k.label[0], ANY)
    a.kids = kids
    return a


def decide(template: Slot) -> Slot:
    """Marks the template's region and what stands beside it; neither if there are too few different pages, or none vary."""
    for slot in preorder(template):
        if slot.counts is None:
            slot.counts = len(slot.pages), len({c for c, _ in slot.pages.values()}), sum(n for _, n in slot.pages.values())
    if not template.counts[0]:
        raise ValueError("a template that was written needs its host's counts")

    def settle(slot: Slot) -> float:
        slot.region = slot.beside = False
        slot.total = 0.0 if slot.boiler else slot.own() + sum(map(settle, slot.kids))
        if slot.boiler:
            for k in slot.kids:
                settle(k)
        return slot.total

    if not settle(template) or template.counts[0] < REGION_PAGES:
        return template
    now = template
    while True:
        inner = [k for k in now.kids if k.label[0] in CONTAINERS]
        best = max(inner, key=lambda k: k.total, default=None)
        if best is None or best.total < LEADS * now.total or any(k.total > BESIDE * now.total for k in inner if k is not best):
            break
        if now.label[0] not in ("#root", "html", "body") and sum(k.total for k in now.kids if k.label[0] not in CONTAINERS) + now.own() > BESIDE * now.total:
            break
        for k in now.kids:
            k.beside = k.label[0] in CONTENT and k.total > 0
        now = best
    now.region = True
    return template


def _matched(slot: Slot, folded: Folded, to: dict) -> dict:
    for node in folded.nodes:
        to[id(node)] = slot
    for x, y in _pairs(slot.kids, folded.kids, {}):
        _matched(slot.kids[x], folded.kids[y], to)
    return to


def _has_text(node: Node) -> bool:
    left = [node]
    while left:
        for k in left.pop().kids:
            if isinstance(k, str):
                if k.strip():
                    return True
            elif not is_boilerplate(k, True):
                left.append(k)
    return False


def _topmost(root: Node, wanted, whole: bool = False) -> list:
    """The outermost wanted nodes in page order; whole: the root itself is wanted."""
    found, left = [], [root]
    while left:
        node = left.pop()
        if (node is not root or whole) and wanted(node):
            found.append(node)
        else:
            left += [k for k in reversed(node.kids) if not isinstance(k, str) and not is_boilerplate(k, False)]
    return found


def region(root: Node) -> list[Node]:
    """The elements that hold the main text: articles, main, what is named so, or else the body."""
    for wanted in (lambda n: n.tag == "article", lambda n: n.tag == "main" or "main" in n.words, lambda n: n.words & MAIN_WORDS and n.tag in BLOCK - {"body"}, lambda n: n.tag == "body"):
        if found := [n for n in _topmost(root, wanted) if _has_text(n)]:
            return found
    return [root]


def _blocks(root: Node, out: list) -> None:
    """Appends (text, node that it stands in, linked characters) of each block."""
    now: list = []  # parts of the open block

    def close() -> None:
        text = " ".join("".join(x for x, _, _ in now).split())
        if text:
            out.append((text, next(n for x, n, _ in now if x.strip()), sum(len(x) for x, _, a in now if a)))
        now.clear()

    left = [(root, iter(root.kids))]
    while left:
        node, kids = left[-1]
        for k in kids:
            if isinstance(k, str):
                now.append((k, node, node.tag == "a"))
            elif k.tag in ("br", "wbr"):
                now.append((" " if k.tag == "br" else "", node, False))
            elif not is_boilerplate(k, True):
                if k.tag in BLOCK:
                    close()
                left.append((k, iter(k.kids)))
                break
        else:
            left.pop()
            if node.tag in BLOCK or node.tag == "#root":
                close()


def extract(root: Node, template: Slot | None = None) -> str:
    """The main text of a page: its slots' blocks in page order, one a line."""
    return "\n".join(read(root, template)[0])


def read(root: Node, template: Slot | None = None) -> tuple[list[str], bool]:
    """The blocks of a page's main text, and whether its host's template named the region."""
    if template is not None and not hasattr(template, "total"):
        decide(template)
    to = _matched(template, Folded([root]), {}) if template is not None and fits(template, root) else {}
    blocks: list = []
    if any(s.region for s in to.values()):
        for node in _topmost(root, lambda n: id(n) in to and (to[id(n)].region or to[id(n)].beside), to[id(root)].region):
            _blocks(node, blocks)
        if sum(not to[id(b[1])].beside if id(b[1]) in to else 1 for b in blocks):
            return [b[0] for b in blocks if not _constant(b, to, template)], True
        blocks = []
    whole = region(root)
    for node in whole:
        _blocks(node, blocks)
    if len(whole) == 1 and whole[0].tag in ("body", "#root"):  # nothing names the content: lists of links aren't it
        blocks = [b for b in blocks if b[2] < LINKED * len(b[0])]
    return [b[0] for b in blocks], False


def _constant(b: tuple, to: dict, template: Slot) -> bool:
    """Whether every page repeats the block in its slot, on enough pages that are no near copies, or on nearly all."""
    slot = to.get(id(b[1]))
    if slot is None or slot.counts[0] < LEAST_PAGES or _hash(b[0]) not in slot.same:
        return False
    return len(slot.apart) >= LEAST_PAGES or slot.counts[0] >= NEARLY_ALL * template.counts[0]


#: Hosts whose templates a task holds at once.
HOSTS = 2000


class Known(dict):
    """What is read from templates' bytes, by place; HOSTS at most."""

    def of(self, place: int, raw: bytes, reads=pickle.loads):
        if place not in self:
            if len(self) >= HOSTS:
                self.clear()
            self[place] = reads(raw)
        return self[place]


def _numbered(raw: bytes) -> tuple[Slot, dict[int, int]]:
    slot = pickle.loads(raw)
    return slot, {id(x): i for i, x in enumerate(preorder(slot))}


def folded(pages: DataFrame) -> DataFrame:
    """host, template, page, mark, of pages: host, html. A row a page has the hash of its main text and its marks; rows with
    a template have those of a task's hosts."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Slot] = {}
        for frame in frames:
            hashes, kept = [], []
            for host, html in zip(frame["host"], frame["html"], strict=True):
                slot = Slot(Folded([parse(html)]))
                hashes += slot.pages
                kept.append(pickle.dumps(marks(slot)))
                made[host] = merge(made[host], slot, whole=False) if host in made else slot
            yield pd.DataFrame({"host": frame["host"], "template": None, "page": hashes, "mark": kept})
            if len(made) > HOSTS:
                yield rows(made)
                made = {}
        if made:
            yield rows(made)

    def rows(made: dict[str, Slot]) -> pd.DataFrame:
        return pd.DataFrame({"host": list(made), "template": [pickle.dumps(x) for x in made.values()], "page": 0, "mark": None})

    return pages.mapInPandas(fold, "host string, template binary, page long, mark binary")


def met(parts: DataFrame) -> DataFrame:
    """host, template: the partial templates of each host merged, by salt and then all."""

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        slots = sorted(g["template"])
        first = pickle.loads(slots[0])
        for x in slots[1:]:
            first = merge(first, pickle.loads(x), whole=False)
        return pd.DataFrame({"host": [g["host"].iloc[0]], "template": [pickle.dumps(first)]})

    kind = "host string, template binary"
    salted = parts.where("template IS NOT NULL").select("host", "template").withColumn("salt", F.pmod(F.hash("template"), F.lit(SALTS)))
    return salted.groupBy("host", "salt").applyInPandas(meet, kind).groupBy("host").applyInPandas(meet, kind)


def counted(parts: DataFrame, made: DataFrame) -> DataFrame:
    """place, node, pages, contents, chars: a row for each node of a template (made: place, host, template) that has text,
    over the marks of all pages of its host."""

    def stand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known()
        for frame in frames:
            places, nodes, pages, contents, chars = [], [], [], [], []
            for place, raw, page, mark in zip(frame["place"], frame["template"], frame["page"], frame["mark"], strict=True):
                out: list = []
                slot, number = known.of(place, raw, _numbered)
                standing(slot, Mark(pickle.loads(mark)), number, out)
                places += [place] * len(out)
                pages += [page] * len(out)
                for i, content, n in out:
                    nodes.append(i)
                    contents.append(content)
                    chars.append(n)
            yield pd.DataFrame({"place": places, "node": nodes, "page": pages, "content": contents, "chars": chars}, dtype="int64")

    rows = _beside(parts.where("mark IS NOT NULL").select("host", "page", "mark"), made).select("place", "template", "page", "mark")
    each = rows.mapInPandas(stand, "place long, node long, page long, content long, chars long")
    pages = each.groupBy("place", "node", "page").agg(F.min("content").alias("content"), F.max("chars").alias("chars"))
    contents = pages.groupBy("place", "node", "content").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"))
    return contents.groupBy("place", "node").agg(F.sum("pages").alias("pages"), F.count("*").alias("contents"), F.sum("chars").alias("chars"))


def templates(pages: DataFrame) -> DataFrame:
    """place, host, template (pickled, with its counts over all pages), staged, from pages: host, html."""
    parts = stage(folded(pages))
    made = stage(met(parts).withColumn("place", F.monotonically_increasing_id()))
    counts = counted(parts, made).groupBy("place").agg(F.collect_list(F.array("node", "pages", "contents", "chars")).alias("counts"))

    @F.pandas_udf("binary")
    def settled(raw: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for one, rows in zip(raw, counts, strict=True):
            slot = pickle.loads(one)
            by = {int(i): tuple(map(int, numbers)) for i, *numbers in rows}
            for i, x in enumerate(preorder(slot)):
                x.counts = by.get(i, (0, 0, 0))
            out.append(pickle.dumps(slot))
        return pd.Series(out)

    done = stage(made.join(counts, "place").select("place", "host", settled("template", "counts").alias("template")))
    unstage(parts, made)
    return done


#: Bytes of all templates up to which they are broadcast.
BROADCAST_BYTES = 48 << 20


def _beside(rows: DataFrame, made: DataFrame) -> DataFrame:
    """rows with their host's template."""
    bytes_ = made.agg(F.sum(F.length("template") + F.length("host"))).first()[0] or 0
    return rows.join(F.broadcast(made) if bytes_ <= BROADCAST_BYTES else made, "host", "left")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text: one row per page. A null html is empty, its text too. Pages without a host in their url, or
    without a url, are one host. A host with fewer than REGION_PAGES different pages has no template that names its
    region. Rows that repeat all stay. Other columns are ignored, whatever their names."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    made = templates(rows.select("host", "html"))

    @F.pandas_udf("string")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = Known()
        for html, place, template in batches:
            yield pd.Series([extract(parse(page), known.of(at, raw)) for page, at, raw in zip(html, place, template, strict=True)], dtype=object)

    return _beside(rows, made).select(F.col("id").alias(id_col), F.col("url").alias(url_col), apply("html", "place", "template").alias("text"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
