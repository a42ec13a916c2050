"""Main text of pages by a site style tree.

The whole DOMs of one host are merged into a tree of element paths. A path that looks the same wherever it occurs, in its children
(presentation) or in what its text is made of (content: the whole text, its words, link targets and attributes), tells little: its entropy-based
importance is low, and the branches of a page that are made of nothing else are removed, inside articles too; only an article of which nothing
would be left is a copy, not boilerplate, and stays whole.

What elements are called is known before and enters as a prior. Navigation, headers, footers, asides, forms, adverts, notices and comments
are of no importance, whatever the tree says; where elements name themselves the article, only whole texts that repeat count
against it, not words. Names never empty a page: an element around all of its text isn't judged by its name, and where nothing would be
left, names count for nothing, but for elements that the markup language itself sets apart.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import dom, words
from .url_rules import host_of

#: A host needs so many pages with a path before repetition counts, and a branch so much importance to stay.
MIN_PAGES, MIN_IMPORTANCE = 5, 0.2
#: Weight of a node's own presentation against its children's, as a power of its number of styles.
DAMPING = 0.9
#: Content that stands on fewer pages of a path than this power of their number is the page's own: its entropy counts as 0.
OWN_POWER = 0.5
#: A leaf's words, links and attributes count against it if it has so many: few may repeat by chance.
LEAST_EVIDENCE = 4
#: Entries of the style tree up to which they go to every task as two arrays (12 bytes each); beyond, pages are sorted beside their host's.
BROADCAST_ENTRIES, PAGES_PER_PART = 2_000_000, 20_000

#: Fixed words: what elements that are not the article, and those that are, call themselves.
ASIDE_TAGS = frozenset(
    "nav footer aside form script style noscript template button select textarea input svg iframe object canvas dialog menu head title "
    "audio video map datalist".split())
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Whole names that are telling inside articles too; parts of names aren't (ad-free, comments-open, share-price).
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox ad-box adslot ad-slot ad-unit ad-banner ad-container ad-wrapper advert-box sponsored nav navbar "
    "nav-bar navigation main-nav site-nav menubar breadcrumb breadcrumbs colophon footer site-footer page-footer gdpr cookie-banner cookie-notice cookie-consent "
    "newsletter newsletter-signup paywall share sharing social-share share-buttons share-bar comment comments commentlist comment-list comment-section "
    "post-comments reader-comments disqus disqus_thread pagination pager searchbox search-box".split())
#: Telling outside an article only: in articles, and of layouts, they name much else (section.legal, p.notice).
VAGUE_NAMES = frozenset(
    "sponsor promo promoted promotion banner menu crumbs header masthead topbar sidebar aside rail widget widgets cookie cookies consent privacy "
    "notice notices alert popup modal overlay subscribe subscription signup signin login register social follow respond reply replies discussion "
    "related related-posts related-articles recommended recommendations trending popular toolbar search copyright legal disclaimer hidden site-header "
    "page-header side-bar top-bar".split())
#: What the markup language itself sets apart: never text of a page, whatever else there is.
APART_TAGS = ASIDE_TAGS - frozenset("aside form".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article articlebody post-content entry-content article-body article-content main-content post-body story-body".split())
NEVER_ASIDE = frozenset("html body article main".split())


def _named(node: dom.Node) -> str:
    return f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}"


def _is_hidden(node: dom.Node) -> bool:
    return "hidden" in node.attributes or node.attributes.get("aria-hidden", "").lower() == "true"


def _is_certain(node: dom.Node) -> bool:
    """Hidden, or by its tag, role or a whole name not part of the article."""
    if node.tag in ASIDE_TAGS - {"form"} or _is_hidden(node):
        return True
    if not node.attributes:
        return False
    if node.attributes.get("role", "").lower() in ASIDE_ROLES - {"form"} or re.search(r"display\s*:\s*none", node.attributes.get("style", ""), re.I):
        return True
    return bool(ASIDE_NAMES & set(_named(node).lower().split()))


def is_aside(node: dom.Node, inside_main: bool) -> bool:
    """By name: not part of the article."""
    if node.tag == "form" or _is_hidden(node) or node.tag == "header" and not inside_main:
        return True
    if node.tag in NEVER_ASIDE and not inside_main:
        return False
    return _is_certain(node) or node.attributes.get("role", "").lower() == "form"


def is_vague(node: dom.Node) -> bool:
    return bool(node.attributes) and node.tag not in NEVER_ASIDE and bool(VAGUE_NAMES & set(_named(node).lower().split()))


def is_main(node: dom.Node) -> bool:
    if node.tag in MAIN_TAGS or node.attributes.get("role", "").lower() in ("main", "article"):
        return True
    if not node.attributes:
        return False
    return node.attributes.get("itemprop", "").lower() == "articlebody" or bool(MAIN_WORDS & set(_named(node).lower().split()))


def drop_apart(root: dom.Node) -> None:
    """Drop what the markup language sets apart, and what is hidden."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c if isinstance(c, str) or c.tag not in APART_TAGS and not _is_hidden(c) else _gap(c) for c in node.children]
        stack.extend(c for c in node.children if not isinstance(c, str))


def _gap(node: dom.Node) -> str:
    return " " if node.tag not in dom.INLINE else ""


def settle(root: dom.Node) -> list[dom.Node]:
    """Drop what is aside by name; return the article's elements, or the root where none names itself so.

    What holds an article is dropped only if it is certainly aside (articles among comments) and there is an article elsewhere.
    What holds all text of a page, beside what drop_apart would drop, stays. Vague names count outside articles only, and never for
    all the text of a page.
    """
    full, holds, size = set(), set(), {}
    for node in reversed(_nodes(root)):
        own, some, held = 0, False, False
        for c in node.children:
            if isinstance(c, str):
                inner = len(c.strip())
                some = some or inner > 0
            else:
                inner, key = size[id(c)], id(c)
                some, held = some or key in full, held or key in holds
            own += inner
        if some:
            full.add(id(node))
        if held or some and is_main(node):
            holds.add(id(node))
        size[id(node)] = 0 if node.tag in APART_TAGS or node.attributes and _is_hidden(node) else own
    elsewhere, stack = False, [(root, False)]
    while stack and not elsewhere:
        node, inside = stack.pop()
        inside = inside or is_main(node)
        for child in node.children:
            if isinstance(child, str):
                elsewhere |= inside and bool(child.strip())
            elif id(child) in full and (not _is_certain(child) or child.tag in NEVER_ASIDE and not inside and not _is_hidden(child)):
                stack.append((child, inside))
    mains: list[dom.Node] = []
    vague: list[dom.Node] = []
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        kept = []
        for child in node.children:
            if not isinstance(child, str):
                held = id(child) in holds and not (elsewhere and _is_certain(child)) or size[id(child)] == size[id(root)] > 0
                if is_aside(child, inside) and not held:
                    child = _gap(child)
                else:
                    own = is_main(child)
                    if own and not inside:
                        mains.append(child)
                    elif not inside and not held and is_vague(child):
                        vague.append(child)
                    stack.append((child, inside or own))
            kept.append(child)
        node.children = kept
    mains = [m for m in mains if "".join(_text(m)).strip()]
    if vague and not mains:
        inner = {id(n): n.children for n in vague}
        for node in vague:
            node.children = []
        if not "".join(_text(root)).strip():
            for node in vague:
                node.children = inner[id(node)]
    if len(mains) > 1:
        order = {id(n): i for i, n in enumerate(_walk(root))}
        mains.sort(key=lambda n: order[id(n)])
    return mains or [root]


def _nodes(root: dom.Node) -> list[dom.Node]:
    """All elements, parents before children."""
    out = [root]
    for node in out:
        for c in node.children:
            if not isinstance(c, str):
                out.append(c)
    return out


def _walk(node: dom.Node) -> Iterator[dom.Node]:
    stack = [node]
    while stack:
        at = stack.pop()
        yield at
        stack.extend(c for c in reversed(at.children) if not isinstance(c, str))


def _text(node: dom.Node) -> Iterator[str]:
    """Texts in order; a block's borders and line breaks are spaces."""
    stack: list[dom.Node | str] = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            yield at
        elif at.tag in dom.INLINE:
            stack.extend(reversed(at.children))
        else:
            stack.extend((" ", *reversed(at.children), " "))


def clean(parts: Iterator[str]) -> str:
    return " ".join("".join(parts).split())


def _leaves(nodes: list[dom.Node]) -> set[int]:
    """Ids of the branches of text and inline elements alone; nodes: parents before children."""
    out: set[int] = set()
    for node in reversed(nodes):
        for c in node.children:
            if not isinstance(c, str) and c.tag != "br" and (c.tag not in dom.INLINE or id(c) not in out):
                break
        else:
            out.add(id(node))
    return out


def enclose(root: dom.Node) -> set[int]:
    """Put runs of text and inline elements that stand beside blocks each in an element of its own, so that they are branches too.

    Returns the ids of the page's leaves: branches of text and inline elements alone.
    """
    nodes = _nodes(root)
    leaves = _leaves(nodes)
    for node in nodes:
        if id(node) in leaves:
            continue
        kept: list[dom.Node | str] = []
        run: list[dom.Node | str] = []
        for child in [*node.children, None]:
            if isinstance(child, str) or child is not None and (child.tag == "br" or child.tag in dom.INLINE and id(child) in leaves):
                run.append(child)
                continue
            if run:
                if any(not isinstance(c, str) or c.strip() for c in run):
                    own = dom.Node("span", {}, node)
                    own.children, run = run, [own]
                    leaves.add(id(own))
                kept.extend(run)
                run = []
            if child is not None:
                kept.append(child)
        node.children = kept
    return leaves


PATH, STYLE, CONTENT = 0, 1, 2
_TEXT, _WORD, _LINK, _NAME, _LOOK = (n * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for n in range(1, 6))


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


@dataclasses.dataclass
class StyleNode:
    """An element of a page as the style tree sees it: keys are hashes of its path (host and styles from the root) and a feature."""

    node: dom.Node
    path: int
    text: int | None    # key of a leaf's whole text
    finer: list[int]    # keys of a leaf's words, link targets and attributes, each once
    style: int | None   # key of another element's sequence of children's styles


def style_nodes(page: Page, host: str | None, names: bool = False, article_only: bool = False) -> Iterator[StyleNode]:
    """The elements of a page from the root down; empty leaves are left out.

    With `names`, leaves inside what names itself the article have no finer keys, as these don't count there; article_only leaves out
    everything else.
    """
    leaves = page.leaves
    stack = [(page.root, _hash(host or "", 0), False)]
    while stack:
        node, path, inside = stack.pop()
        inside = inside or names and is_main(node)
        if article_only and not inside:
            if id(node) not in leaves:
                stack.extend((c, _hash(f"{c.tag} {_named(c).strip()}", path), False) for c in node.children if not isinstance(c, str))
            continue
        if id(node) in leaves:
            text = clean(_text(node))
            if text and inside:
                yield StyleNode(node, path, _hash(text, path ^ _TEXT), [], None)
            elif text:
                finer = {_hash(w, path ^ _WORD) for w in text.split()}
                for inner in _walk(node):
                    if inner.attributes:
                        finer.update(_hash(v, path ^ _LINK) for k, v in inner.attributes.items() if k in ("href", "src", "alt", "title"))
                        finer.update(_hash(w, path ^ _NAME) for w in _named(inner).split())
                yield StyleNode(node, path, _hash(text, path ^ _TEXT), sorted(finer), None)
            continue
        below = [c for c in node.children if not isinstance(c, str)]
        styles = [f"{c.tag} {_named(c).strip()}" for c in below]
        yield StyleNode(node, path, None, [], _hash("\x1f".join(styles), path ^ _LOOK))
        stack.extend((c, _hash(s, path), inside) for c, s in zip(below, styles))


@dataclasses.dataclass
class Page:
    """A page's DOM, enclosed, and the ids of its leaves."""

    root: dom.Node
    leaves: set[int]


def _page(source: str | None) -> Page:
    root = dom.parse(source or "")
    return Page(root, enclose(root))


def _has_article(page: Page) -> bool:
    """Whether some element names itself the article and holds text."""
    return any(is_main(n) and any(t.strip() for t in _text(n)) for n in _nodes(page.root))


def _features(batches: Iterator[pa.RecordBatch], names: bool) -> Iterator[pa.RecordBatch]:
    """How many pages of a slice have each (path, kind, key); a path's own rows, its number of pages, have the key 0."""
    for batch in batches:
        for part in words.slices(batch, "html"):
            count: dict[tuple[int, int, int], int] = {}
            for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                own = set()
                for at in style_nodes(_page(source), host, names):
                    own.add((at.path, PATH, 0))
                    if at.style is not None:
                        own.add((at.path, STYLE, at.style))
                    else:
                        own.add((at.path, CONTENT, at.text))
                        own.update((at.path, CONTENT, k) for k in at.finer)
                for key in own:
                    count[key] = count.get(key, 0) + 1
            columns = [np.array([k[i] for k in count], np.uint64).view(np.int64) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array([k[1] for k in count], pa.int8()), pa.array(columns[1]), pa.array(list(count.values()), pa.int64())],
                ["path", "kind", "key", "n"])


def style_tree(pages: DataFrame, min_pages: int = MIN_PAGES, names: bool = False) -> DataFrame:
    """(key, path, value): the entries of the style tree that make branches less important; pages: host, html. `names` as in style_nodes.

    For content, value is the entropy of its spread over the pages that have its path, to base their number: log n / log m, so 1 where
    all m pages have it and 0 where one has. Content on fewer than m ** OWN_POWER pages is the page's own and has no entry. For a
    path's presentation, value is its importance, the entropy of its styles to base m, less its number of styles: 1 style and importance 0 is
    -1. All pages of a host take part; they are counted per slice first, so a hot host is no one's group, and what one page has alone goes
    no further than the first shuffle.
    """
    seen = pages.mapInArrow(lambda b: _features(b, names), "path long, kind byte, key long, n long")
    each = seen.groupBy("path", "kind", "key").agg(F.sum("n").alias("n"))
    each = cut(each.where((F.col("kind") != CONTENT) | (F.col("n") >= max(2, min_pages ** OWN_POWER))))
    paths = each.where(F.col("kind") == PATH).select("path", F.col("n").alias("m")).where(F.col("m") >= min_pages)
    content = each.where(F.col("kind") == CONTENT).join(paths, "path").where(F.col("n") >= F.pow("m", F.lit(OWN_POWER)))
    content = content.select("key", "path", (F.log("n") / F.log("m")).alias("value"))
    styled = each.where(F.col("kind") == STYLE).join(paths, "path").groupBy("path", "m").agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.count(F.lit(1)).alias("styles"))
    spread = (F.log("total") - F.col("nlogn") / F.col("total")) / F.log(F.greatest("m", "total"))
    look = styled.select(F.col("path").alias("key"), "path", (spread - F.col("styles")).alias("value"))
    return content.unionByName(look)


class Known:
    """Entries of the style tree, looked up many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, NaN for unknown ones."""
        if not len(self.keys) or not len(keys):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.nan)


NOTHING_KNOWN = Known(np.zeros(0, np.int64), np.zeros(0, np.float32))


def importance(page: Page, known: Known, host: str | None, names: bool, article_only: bool = False, damping: float = DAMPING) -> float:
    """Set each element's composite importance; return the least of a leaf.

    A leaf's is what its whole text leaves, or the mean of what its words, links and attributes leave, if there are LEAST_EVIDENCE of them, whichever
    is less; with `names`, inside what names itself the article the whole text alone. Another element's weighs its presentation and its children's mean.
    """
    nodes = list(style_nodes(page, host, names, article_only))
    if not nodes:
        return 1.0
    sizes = np.array([1 + len(at.finer) for at in nodes])
    keys = [k for at in nodes for k in ((at.text if at.style is None else at.path), *at.finer)]
    values = known.of(np.array(keys, np.uint64).view(np.int64))
    starts = np.cumsum(sizes) - sizes
    left = 1 - np.nan_to_num(values)
    whole = left[starts]
    others = (np.add.reduceat(left, starts) - whole) / np.maximum(sizes - 1, 1)
    weights = np.where(sizes > LEAST_EVIDENCE, np.minimum(whole, others), whole).tolist()
    for at, weight, value in zip(reversed(nodes), reversed(weights), reversed(values[starts].tolist())):
        if at.style is None:
            at.node.weight = weight
            continue
        styles = 1 if value != value else max(round(0.5 - value), 1)
        look = 1.0 if value != value else value + round(0.5 - value)
        below = [c.weight for c in at.node.children if not isinstance(c, str)]
        loose = any(isinstance(c, str) and c.strip() for c in at.node.children)
        share = damping ** styles
        mean = 1.0 if loose else sum(below) / len(below) if below else 1.0
        at.node.weight = (1 - share) * look + share * mean
    return min((w for at, w in zip(nodes, weights) if at.style is None), default=1.0)


def prune(page: Page, min_importance: float) -> None:
    """Remove the branches that, like everything in them, are of little importance."""
    stays: set[int] = set()
    for node in reversed(_nodes(page.root)):
        below = False
        if id(node) not in page.leaves:
            node.children = [c if isinstance(c, str) or id(c) in stays else " " for c in node.children]
            below = any(not isinstance(c, str) or c.strip() for c in node.children)
        if below or node.weight >= min_importance:
            stays.add(id(node))


def main_text(source: str | None, known: Known = NOTHING_KNOWN, host: str | None = None, min_importance: float = MIN_IMPORTANCE,
              names: bool = True) -> str:
    """The main text of one page. Without `names` the style tree alone decides, and the whole page is the article."""
    page = _page(source)
    articles = names and _has_article(page)
    least = importance(page, known, host, names, articles) if len(known.keys) else 1.0
    mains = settle(page.root) if names else [page.root]
    if names and not any(clean(_text(m)) for m in mains) or articles and mains == [page.root]:
        empty = not any(clean(_text(m)) for m in mains)
        page = _page(source)
        least = importance(page, known, host, names and not empty) if len(known.keys) else 1.0
        if empty:
            drop_apart(page.root)
            mains = [page.root]
        else:
            mains = settle(page.root)
    texts = [clean(_text(m)) for m in mains]
    if least < min_importance:
        prune(page, min_importance)
        left = [clean(_text(m)) for m in mains]
        if mains == [page.root] or any(left):
            texts = left
    return " ".join(t for t in texts if t)


def _texts(part: pa.RecordBatch, known: Known, min_importance: float, names: bool) -> pa.RecordBatch:
    texts = [main_text(source, known, host, min_importance, names) for source, host in zip(part.column("html").to_pylist(), part.column("host").to_pylist())]
    return pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _extract(batches: Iterator[pa.RecordBatch], entries: Broadcast, min_importance: float, names: bool) -> Iterator[pa.RecordBatch]:
    known = Known(*entries.value)
    for batch in batches:
        for part in words.slices(batch, "html"):
            yield _texts(part, known, min_importance, names)


def _extract_sorted(batches: Iterator[pa.RecordBatch], min_importance: float, names: bool) -> Iterator[pa.RecordBatch]:
    """Rows come by (host, part): first the entries of the host's tree, then its pages."""
    at, entries, known = None, [], None
    for batch in batches:
        for part in words.slices(batch, "html"):
            hosts, parts = part.column("host").to_pylist(), part.column("part").to_pylist()
            keys, values = part.column("key"), part.column("value")
            is_page = np.asarray(part.column("is_page"))
            borders = [0, *(i for i in range(1, len(hosts)) if (hosts[i], parts[i]) != (hosts[i - 1], parts[i - 1]) or is_page[i] != is_page[i - 1]), len(hosts)]
            for start, stop in zip(borders, borders[1:]):
                if stop <= start:
                    continue
                if (hosts[start], parts[start]) != at:
                    at, entries, known = (hosts[start], parts[start]), [], None
                if not is_page[start]:
                    entries.append((keys.slice(start, stop - start).to_numpy(), values.slice(start, stop - start).to_numpy()))
                    continue
                if known is None:
                    known = Known(*(np.concatenate(c) for c in zip(*entries))) if entries else NOTHING_KNOWN
                yield _texts(part.slice(start, stop - start), known, min_importance, names)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", min_pages: int = MIN_PAGES,
            min_importance: float = MIN_IMPORTANCE, broadcast_entries: int = BROADCAST_ENTRIES, names: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main text, empty where there is none.

    Character references are decoded, white space within a block becomes one space, blocks are joined by one space in page order. A null
    or empty html has an empty text; urls without a host share one style tree; a host with fewer than min_pages pages of a path has
    nothing removed for repetition. Repeated rows are extracted each, other columns ignored, an empty table gives no rows.
    The pages are scanned twice; counts of (path, feature) are shuffled, pages only where the style tree has more than broadcast_entries
    entries: then they are sorted by host beside its entries, large hosts in parts. A task holds a slice of a batch of pages.
    """
    plain = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"),
                         host_of(F.col(url_column)).alias("host"))
    tree = cut(style_tree(plain.select("host", "html"), min_pages, names))
    kinds = "page_id long, url string, text string"
    if tree.count() <= broadcast_entries:
        table = tree.select("key", F.col("value").cast("float")).toArrow()
        entries = pages.sparkSession.sparkContext.broadcast((table["key"].to_numpy(), table["value"].to_numpy()))
        texts = words.small_batches(plain).mapInArrow(lambda b: _extract(b, entries, min_importance, names), kinds)
    else:
        texts = _beside_entries(words.small_batches(plain), tree).mapInArrow(lambda b: _extract_sorted(b, min_importance, names), kinds)
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def _beside_entries(plain: DataFrame, tree: DataFrame) -> DataFrame:
    """Pages sorted by (host, part) after the entries of their host's tree."""
    owners = plain.select("host", "html").mapInArrow(_paths, "host string, path long").distinct()
    sizes = plain.groupBy("host").agg((F.floor(F.count(F.lit(1)) / PAGES_PER_PART) + 1).cast("int").alias("parts"))
    own = tree.select("path", "key", F.col("value").cast("float").alias("value")).join(owners, "path").join(sizes, "host")
    nothing = {"page_id": "long", "url": "string", "html": "string"}
    entries = own.select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_page"), "key", "value",
                         *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    dealt = plain.join(sizes, "host").select(
        "host", F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("is_page"),
        F.lit(None).cast("long").alias("key"), F.lit(None).cast("float").alias("value"), *nothing)
    return entries.unionByName(dealt).repartition("host", "part").sortWithinPartitions("host", "part", "is_page")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (host, path) of each slice's pages, once."""
    for batch in batches:
        for part in words.slices(batch, "html"):
            own = {(host, at.path) for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist()) for at in style_nodes(_page(source), host)}
            hosts, paths = zip(*own) if own else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(np.array(paths, np.uint64).view(np.int64))], ["host", "path"])
