"""HTML extraction by wrapper induction: pages of a host are aligned with reference pages, what stays is template, what varies is content."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segtide.llm.common import written
from segtide.llm.url_filter import host_of

#: Reference pages of each host.
REFERENCES = 3
#: A text is template if it stands in the same slot on this share of the aligned pages, of which there must be a few.
CONSTANT, VOTERS = 0.8, 8
#: Bytes of alignment sizes that a table holds at once; rows beyond it are made again when they are needed.
TABLE = 32_000_000
#: Pairs of children up to which an alignment's table is made without arrays.
FEW = 600
#: Paths and slots that a task holds before it sums them.
HELD = 1_000_000
#: Bytes of reference pages and slots that may be broadcast; beyond it Spark shuffles the pages by host.
SMALL = 32_000_000

#: Fixed values from the HTML standard: elements without end, elements whose content isn't markup, elements that end a block or a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend "
    "li main menu nav object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul noscript canvas math audio video".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
#: An element that starts ends an open one of its kind, unless one of the stops lies between.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "p": ("table", "td", "th", "button", "object", "template")}
#: Elements and names that hold no part of an article.
ASIDE = frozenset("nav footer aside header form head script style template noscript iframe object svg canvas math audio video button select option textarea title dialog menu".split())
NAMED_ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice gdpr newsletter subscribe subscription signup sidebar comment comments disqus replies reply "
    "respond menu nav navbar navigation breadcrumb breadcrumbs masthead footer share sharing social related recommended popup modal overlay pagination pager".split()
)
ROLES_ASIDE = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
_NEGATED = frozenset("has with no without is not".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"[0-9]+")
_LANGUAGE = re.compile(r"""<html\b[^>]*\slang\s*=\s*["']?([a-z-]+)""", re.I)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class Node:
    """An element with inner blocks, or a run of neighbours of one kind that hold only text, one text each."""

    __slots__ = ("label", "children", "texts", "aside", "main", "shape", "size", "depth")

    def __init__(self, label: str, aside: bool, main: bool):
        self.label, self.aside, self.main = label, aside, main
        self.children: list[Node] = []
        self.texts: list[str] = []
        self.close()

    def close(self) -> None:
        """Set the shape, a digest of the labels of the node and all below it, their number and how deep they go."""
        label = self.label.encode()
        self.shape = blake2b(b"%d %b" % (len(label), label) + b"".join([c.shape for c in self.children]), digest_size=16).digest()
        self.size = 1 + sum([c.size for c in self.children])
        self.depth = 1 + max([c.depth for c in self.children], default=0)


def _traits(tag: str, attributes: str) -> tuple[str, bool]:
    """The label by which elements are matched, and whether the element's own name or role marks it as no part of an article."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = found.get("class", "").split() + found.get("id", "").split()
    aside = tag in ASIDE or found.get("role") in ROLES_ASIDE
    if tag not in ("html", "body", "article", "main") or "comment" in " ".join(names):
        for name in names:
            parts = [p for p in re.split(r"[^a-z]+", name) if p]
            if parts and not _NEGATED & set(parts[:-1]) and (parts[0] in NAMED_ASIDE or parts[-1] in NAMED_ASIDE):
                aside = True
    # Digits number pages and posts, so they don't tell elements apart.
    return f"{tag}.{_DIGITS.sub('', names[0])}" if names else tag, aside


def parse(html: str) -> Node:
    """The tree of blocks. Inline markup dissolves in the text; missing and stray end tags are forgiven."""
    root = Node("", False, False)
    stack: list[tuple[str, Node, list[str]]] = [("", root, [])]
    open_tags: Counter[str] = Counter()

    def flush() -> None:
        _, node, pieces = stack[-1]
        text = _SPACE.sub(" ", unescape("".join(pieces))).strip(" ")
        pieces.clear()
        if text:
            if node.children and node.children[-1].label == "#text":
                node.children[-1].texts.append(text)
            else:
                leaf = Node("#text", node.aside, node.main)
                leaf.texts.append(text)
                node.children.append(leaf)

    def close() -> None:
        flush()
        tag, node, _ = stack.pop()
        open_tags[tag] -= 1
        parent = stack[-1][1]
        if len(node.children) == 1 and node.children[0].label == "#text":
            node.texts, node.children = node.children[0].texts, []
        if node.children:
            node.close()
        last = parent.children[-1] if parent.children else None
        if not node.children and last is not None and not last.children and last.label == node.label and last.aside == node.aside:
            last.texts += node.texts
        else:
            parent.children.append(node)

    def close_to(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        if not any(open_tags[n] > 0 for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                while len(stack) > depth:
                    close()
                return
            if stack[depth][0] in stops:
                return

    at, end = 0, len(html)
    while at < end:
        token = _TOKEN.match(html, at)
        at = token.end()
        name = token[2] or token[5]
        if not name:
            # A comment, a declaration or a tag that the end of the page cuts off says nothing.
            if token[0][0] != "<" or len(token[0]) == 1:
                stack[-1][2].append(token[0])
            continue
        tag = name.lower()
        if token[1] or token[4]:
            if tag == "br":
                flush()
            else:
                close_to((tag,), ())
            continue
        attributes = token[3] if token[2] else token[6]
        if tag in RAW:
            until = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            flush()
            at = until.start() if until else end
            if until:
                at = html.find(">", at) + 1 or end
            continue
        if tag in ("br", "hr"):
            flush()
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        label, aside = _traits(tag, attributes)
        if tag not in BLOCK and not aside:
            continue
        if tag in ENDS_PARAGRAPH:
            close_to(("p",), STOPS["p"])
        if tag in SIBLINGS and tag != "p":
            close_to(SIBLINGS[tag], STOPS[tag])
        flush()
        parent = stack[-1][1]
        main = parent.main or (tag in ("article", "main") and not aside)
        # A header inside the article belongs to it; the article itself may stand inside a careless aside.
        inner = parent.aside and not (main and not parent.main) or aside and not (tag == "header" and parent.main)
        open_tags[tag] += 1
        stack.append((tag, Node(label, inner, main), []))
    while len(stack) > 1:
        close()
    flush()
    root.close()
    return root


class Table:
    """Alignment sizes of the distinct shapes of both sides, a row at a time; as many rows are held as ``TABLE`` allows."""

    def __init__(self, rows: list[Node], columns: list[Node], known: dict):
        self.known = known
        mine, other = {n.shape: n for n in rows}, {n.shape: n for n in columns}
        self.rows, self.columns = list(mine.values()), list(other.values())
        #: Only nodes of one label match at all.
        self.labelled: dict[str, list[int]] = {}
        for k, n in enumerate(self.columns):
            self.labelled.setdefault(n.label, []).append(k)
        at, of = {s: k for k, s in enumerate(mine)}, {s: k for k, s in enumerate(other)}
        self.at, self.of = [at[n.shape] for n in rows], np.array([of[n.shape] for n in columns])
        self.held: dict[int, np.ndarray] = {}
        self.most = max(TABLE // (4 * len(columns)), 1)

    def sizes(self, k: int) -> np.ndarray:
        """The sizes of a row's shape with each column."""
        found = self.held.get(k)
        if found is None:
            own = np.zeros(len(self.columns), np.int32)
            row = self.rows[k]
            for j in self.labelled.get(row.label, ()):
                own[j] = _size(row, self.columns[j], self.known)
            found = own[self.of]
            if len(self.held) < self.most:
                self.held[k] = found
        return found


def _next(row: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The row of the matching table that follows ``row``, where ``sizes`` are those of its node with each column."""
    new = row.copy()
    np.maximum(row[1:], row[:-1] + sizes, out=new[1:])
    return np.maximum.accumulate(new, out=new)


def _size(page: Node, reference: Node, known: dict) -> int:
    """The size of the alignment. It depends on shapes only, so equal ones are counted once."""
    if page.label != reference.label:
        return 0
    if page.shape == reference.shape:
        return page.size
    if not page.children or not reference.children:
        return 1
    key = page.shape, reference.shape
    if key not in known:
        rows, columns = page.children, reference.children
        # A node earns most with one of its own shape, so equal ends are part of a largest set.
        start, end = 0, 0
        while start < min(len(rows), len(columns)) and rows[start].shape == columns[start].shape:
            start += 1
        while end < min(len(rows), len(columns)) - start and rows[-1 - end].shape == columns[-1 - end].shape:
            end += 1
        total = 1 + sum([n.size for n in rows[:start]]) + sum([n.size for n in rows[len(rows) - end :]])
        rows, columns = rows[start : len(rows) - end], columns[start : len(columns) - end]
        if len(rows) * len(columns) <= FEW:
            best = [0] * (len(columns) + 1)
            for r in rows:
                before = 0
                for j, c in enumerate(columns):
                    above = best[j + 1]
                    best[j + 1] = max(above, best[j], before + (_size(r, c, known) if r.label == c.label else 0))
                    before = above
            total += best[-1]
        else:
            table = Table(rows, columns, known)
            row = np.zeros(len(columns) + 1, np.int32)
            for i in table.at:
                row = _next(row, table.sizes(i))
            total += int(row[-1])
        known[key] = total
    return known[key]


def aligned_size(page: Node, reference: Node, known: dict) -> int:
    """The size of the alignment of two whole pages of any depth; the interpreter's limit on nested calls follows the pages."""
    deep = 2 * min(page.depth, reference.depth) + 2_000
    if sys.getrecursionlimit() < deep:
        sys.setrecursionlimit(deep)
    return _size(page, reference, known)


def _share(a: Node, b: Node) -> bool:
    """Whether nodes of one shape have a text in common at the same place."""
    return any(not set(x.texts).isdisjoint(y.texts) for x, y in zip(_nodes(a), _nodes(b), strict=True) if x.texts)


def _matched(rows: list[Node], columns: list[Node], known: dict) -> list[tuple[Node, Node]]:
    """The pairs of a largest order-preserving set. Ends of one shape that share a text belong together."""
    start, end, least = 0, 0, min(len(rows), len(columns))
    while start < least and rows[start].shape == columns[start].shape and _share(rows[start], columns[start]):
        start += 1
    while end < least - start and rows[-1 - end].shape == columns[-1 - end].shape and _share(rows[-1 - end], columns[-1 - end]):
        end += 1
    pairs = [*zip(rows[:start], columns, strict=False), *zip(rows[len(rows) - end :], columns[len(columns) - end :], strict=True)]
    rows, columns = rows[start : len(rows) - end], columns[start : len(columns) - end]
    if not rows or not columns:
        return pairs
    # Every so many rows of the table are held; those between are made again when the way back comes to them.
    table = Table(rows, columns, known)
    step = int(len(rows) ** 0.5) + 1
    row, held = np.zeros(len(columns) + 1, np.int32), []
    for i, k in enumerate(table.at):
        if i % step == 0:
            held.append(row)
        row = _next(row, table.sizes(k))
    i, j, first, best = len(rows), len(columns), len(rows) + 1, []
    while i and j:
        if i - 1 < first:
            first = (i - 1) // step * step
            best = [held[first // step]]
            for k in table.at[first : first + step]:
                best.append(_next(best[-1], table.sizes(k)))
        if best[i - first][j] == best[i - 1 - first][j]:
            i -= 1
        elif best[i - first][j] == best[i - first][j - 1]:
            j -= 1
        else:
            pairs.append((rows[i - 1], columns[j - 1]))
            i, j = i - 1, j - 1
    return pairs


def align(page: Node, reference: Node, known: dict | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the largest order-preserving set of node pairs with equal labels and paired parents, and its size."""
    known = {} if known is None else known
    size = aligned_size(page, reference, known)
    if not size:
        return 0, []
    found, open_ = [], [(page, reference)]
    while open_:
        pair = open_.pop()
        found.append(pair)
        mine, other = pair[0].children, pair[1].children
        open_ += zip(mine, other, strict=True) if pair[0].shape == pair[1].shape else _matched(mine, other, known)
    return size, found


def _nodes(node: Node) -> Iterator[Node]:
    """The node and all below it, in page order."""
    open_ = [node]
    while open_:
        found = open_.pop()
        yield found
        open_ += reversed(found.children)


class Wrapper:
    """The reference pages of a host; what they share with other pages becomes template."""

    def __init__(self, pages: list[str]):
        self.references = [parse(p) for p in pages]
        self.number = [{id(n): k for k, n in enumerate(_nodes(r))} for r in self.references]
        self.whole = ["\n".join(t for n in _nodes(r) for t in n.texts) for r in self.references]

    def best(self, page: Node) -> tuple[int, list[tuple[Node, Node]]]:
        """The reference that matches a page best, and the matched nodes."""
        known: dict = {}
        found = [aligned_size(page, r, known) for r in self.references]
        k = max(range(len(found)), key=lambda k: (2 * found[k] / (1 + len(self.number[k])), -k), default=-1)
        return k, align(page, self.references[k], known)[1] if k >= 0 else []

    def votes(self, page: Node) -> Iterator[tuple[int, int, int, bool]]:
        """For each text of the reference's matched nodes: whether the page has the same text there. Copies of the reference don't vote."""
        k, matched = self.best(page)
        if k < 0 or "\n".join(t for n in _nodes(page) for t in n.texts) == self.whole[k]:
            return
        for mine, other in matched:
            if other.texts:
                present = set(mine.texts)
                for j, text in enumerate(other.texts):
                    yield k, self.number[k][id(other)], j, text in present

    def template(self, page: Node, constant: set[tuple[int, int, int]]) -> dict[int, set[str]]:
        """The texts of the page's nodes that are template."""
        k, matched = self.best(page)
        found: dict[int, set[str]] = {}
        if constant:
            for mine, other in matched:
                texts = {t for j, t in enumerate(other.texts) if (k, self.number[k][id(other)], j) in constant}
                if texts:
                    found[id(mine)] = texts
        return found


def main_text(page: Node, template: dict[int, set[str]]) -> str:
    """The varying texts of the article, or of the whole page if it marks no article, in page order."""
    marked = any(n.main and not n.aside and (n.texts or n.children) for n in _nodes(page))
    found: list[str] = []
    for node in _nodes(page):
        if not node.aside and (node.main or not marked):
            fixed = template.get(id(node), ())
            found.extend(t for t in node.texts if t not in fixed)
    return " ".join(found)


def _wrappers():
    known: dict[tuple, Wrapper] = {}

    def of(host: str, pages: list[str]) -> Wrapper:
        if host not in known:
            if len(known) > 2_000:
                known.clear()
            known[host] = Wrapper(pages)
        return known[host]

    return of


@lru_cache(1 << 16)
def _below(path: int, label: str) -> int:
    """The hash of a label path. Digits number pages and posts, so they don't tell paths apart."""
    return int.from_bytes(blake2b(b"%d " % path + _DIGITS.sub("", label).encode(), digest_size=8).digest(), "little")


def _places(page: Node, host: str, html: str) -> tuple[int, list[tuple[Node, int, list[int]]]]:
    """The page's layout, a hash of its language and the set of its named blocks, and for each node with texts its label path and texts, hashed."""
    named, found, open_ = set(), [], [(page, _below(0, host))]
    while open_:
        node, path = open_.pop()
        if "." in node.label:
            named.add(_DIGITS.sub("", node.label))
        if node.texts:
            found.append((node, path, [int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "little") for t in node.texts]))
        open_ += [(c, _below(path, c.label)) for c in node.children]
    language = _LANGUAGE.search(html, 0, 4_000)
    return _below(1, " ".join([(language[1] if language else "").lower(), *sorted(named)])), found


def _slots(paths: np.ndarray, texts: np.ndarray, layout: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Paths and the slots of texts in them: of the whole host, and of one layout."""
    of_layout = paths * _ODD[0] + layout * _ODD[1]
    return [(p, p * _ODD[2] + texts * _ODD[3]) for p in (paths, of_layout)]


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of aligned pages, summed over a task's batch before the shuffle; and each page's layout and distinct pairs of path and text, packed."""
    wrapper = _wrappers()
    for batch in batches:
        sums: dict[tuple, list[int]] = {}
        packed: dict[tuple, bytes] = {}
        for host, html, pages in zip(*(batch.column(c) for c in ("host", "html", "pages")), strict=True):
            host, html = host.as_py(), html.as_py()
            page = parse(html)
            for k, node, j, same in wrapper(host, pages.as_py() or []).votes(page):
                held = sums.setdefault((host, k, node, j), [0, 0])
                held[0] += 1
                held[1] += same
            layout, found = _places(page, host, html)
            pairs = sorted({(path, t) for _, path, texts in found for t in texts})
            mark = blake2b("\n".join(t for n in _nodes(page) for t in n.texts).encode(), digest_size=8).digest()
            line = np.array([layout, *[x for pair in pairs for x in pair]], np.uint64).tobytes()
            packed[host, mark] = min(packed.get((host, mark), line), line)
        rows = [(*key, *held, None, None) for key, held in sums.items()] + [(host, None, None, None, None, None, mark, line) for (host, mark), line in packed.items()]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], ["host", "k", "node", "j", "aligned", "same", "mark", "packed"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages that have a path, as slot of its own, and pages that have a text in it; summed over some pages before the shuffle."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        home, base, slot = (np.concatenate([h[k] for h in held]) for k in range(3))
        table = pa.table({"home": home, "base": base.view(np.int64), "slot": slot.view(np.int64)}).group_by(["home", "base", "slot"]).aggregate([([], "count_all")])
        return table.select(["home", "base", "slot", "count_all"]).rename_columns(["home", "base", "slot", "n"]).combine_chunks().to_batches()[0]

    for batch in batches:
        for home, line in zip(batch.column("home").to_pylist(), batch.column("packed"), strict=True):
            line = np.frombuffer(line.as_py(), np.uint64)
            paths, texts = line[1::2], line[2::2]
            if len(paths):
                for base, slot in _slots(paths, texts, line[:1]):
                    every = np.unique(base)
                    base, slot = np.concatenate([base, every]), np.concatenate([slot, every])
                    held.append((np.full(len(base), home, np.int64), base, slot))
                    size += len(base)
            if size >= HELD:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def _extract(n_keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapper = _wrappers()
        known: dict[str, tuple[set, set]] = {}
        for batch in batches:
            texts = []
            for host, html, pages, constant, slots in zip(*(batch.column(c) for c in ("host", "html", "pages", "constant", "slots")), strict=True):
                host, html = host.as_py(), html.as_py()
                page = parse(html)
                if host not in known:
                    if len(known) > 2_000:
                        known.clear()
                    known[host] = {(c["k"], c["node"], c["j"]) for c in constant.as_py() or ()}, set(slots.as_py() or ())
                fixed, often = known[host]
                template = wrapper(host, pages.as_py() or []).template(page, fixed) if fixed else {}
                if often:
                    layout, found = _places(page, host, html)
                    for node, path, hashes in found:
                        sides = _slots(np.array([path], np.uint64), np.array(hashes, np.uint64), np.array([layout], np.uint64))
                        of_host, of_layout = (slot.view(np.int64).tolist() for _, slot in sides)
                        constants = {t for t, x, y in zip(node.texts, of_host, of_layout, strict=True) if x in often or y in often}
                        if constants:
                            template[id(node)] = template.get(id(node), set()) | constants
                texts.append(main_text(page, template))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[:n_keep], "text", "n_chars"])

    return run


def extract(df: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The main text of each page and its length: ``text``, ``n_chars``, with the columns in ``keep``.

    A page's blocks are aligned with those of the best matching reference of its host; texts that stand in the same slot on most pages are template.
    So are texts that stand on most pages that have their label path, counted over all pages of the host and over those of each layout, whichever pages the references are.
    Of the rest, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out by element, role or name, and
    the article is taken where the page marks one. White space in a block becomes one space, blocks are joined by one.

    Null and empty pages give an empty text; null URLs share the host ''; repeated rows give the same text and copies of a reference don't vote; a host with few pages has no
    template. An empty table gives an empty result.

    Columns in ``keep`` may have any names but those of the results, which are refused.

    References are a few pages a host, drawn by the smallest hashes. They are broadcast only if they are small; else pages meet them by host, and Spark splits a hot one. Votes
    are summed in each task before the shuffle; paths and texts travel as hashes, once for all copies of a page. No group of pages is ever gathered.
    """
    keep = [] if keep is None else keep
    if {c.lower() for c in keep} & {"text", "n_chars"}:
        raise ValueError("a kept column has the name of a result")
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    marked = rows.select("host", "html", F.xxhash64("html").alias("mark"))
    chosen = written(references(marked), "html-references")
    size = chosen.agg(F.sum(F.aggregate("pages", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p)))).first()[0] or 0
    held = F.broadcast(chosen) if size <= SMALL else chosen
    voted = rows.select("host", "html").join(held, "host", "left").mapInArrow(_vote, "host string, k int, node int, j int, aligned long, same long, mark binary, packed binary")
    votes = written(voted, "html-votes")
    sums = votes.filter("k IS NOT NULL").groupBy("host", "k", "node", "j").agg(F.sum("aligned").alias("aligned"), F.sum("same").alias("same"))
    fixed = sums.filter((F.col("aligned") >= VOTERS) & (F.col("same") >= CONSTANT * F.col("aligned"))).groupBy("host").agg(F.collect_list(F.struct("k", "node", "j")).alias("constant"))
    slots = written(constant_slots(votes), "html-constant")
    size += 8 * (slots.agg(F.sum(F.size("slots"))).first()[0] or 0)
    told = chosen.join(fixed, "host", "left").join(slots, F.xxhash64("host") == F.col("home"), "left").drop("home")
    joined = rows.join(F.broadcast(told) if size <= SMALL else told, "host", "left")
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    found = joined.select(*[f"k{i}" for i in range(len(keep))], "host", "html", "pages", "constant", "slots").mapInArrow(_extract(len(keep)), schema)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")


def constant_slots(votes: DataFrame) -> DataFrame:
    """For each hashed host, ``home``, the slots of texts that stand on most pages that have their label path, of all pages or of those of one layout. Copies count once."""
    pages = votes.filter("packed IS NOT NULL").select(F.xxhash64("host").alias("home"), "mark", "packed").groupBy("home", "mark").agg(F.min("packed").alias("packed"))
    counted = pages.select("home", "packed").mapInArrow(_count, "home long, base long, slot long, n long").groupBy("home", "base", "slot").agg(F.sum("n").alias("n"))
    often = written(counted.filter(F.col("n") >= VOTERS), "html-slots")
    every = often.filter("slot = base").select("home", "base", F.col("n").alias("pages"))
    return often.filter("slot <> base").join(every, ["home", "base"]).filter(F.col("n") >= CONSTANT * F.col("pages")).groupBy("home").agg(F.collect_list("slot").alias("slots"))


def references(marked: DataFrame) -> DataFrame:
    """Up to ``REFERENCES`` pages of each host as ``host``, ``pages``: those with the smallest hashes under as many seeds."""
    seeded = [F.xxhash64("mark", F.lit(s)) for s in range(REFERENCES)]
    least = marked.groupBy("host").agg(*[F.min_by("html", h).alias(f"p{s}") for s, h in enumerate(seeded)])
    return least.select("host", F.array_distinct(F.array(*[f"p{s}" for s in range(REFERENCES)])).alias("pages"))
