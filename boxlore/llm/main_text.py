"""Main text of web pages: site templates are subtrees that recur over a host's pages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlore.session import Scratch

RECURS = 5  # distinct pages of a host that a template stands on at least,
SHARE = 0.5  # and their share of the host's distinct pages

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "aside audio button canvas datalist dialog embed footer form frame frameset head iframe input map math menu meter nav noframes noscript "
    "object optgroup option progress script search select style svg template textarea title video".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended related share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
# Noise that stays noise however long it is, and words that say where or how, but not what.
ALWAYS = frozenset("ad ads advert adverts advertisement advertising comment comments consent cookie cookies disqus promo promoted sponsor sponsored".split())
PLAIN = frozenset(
    "area article articles aside bar block body bottom box button buttons center col column container content desktop entry fixed global group "
    "holder icon icons inner item items left link links list main mobile module outer page panel post posts primary right row secondary section "
    "site sticky story text title top wrap wrapper".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# A start tag of the first kind ends an open element of the second kind, unless one of the third stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(>|\Z)|([^<]+|<(?![a-zA-Z/!?]))", re.S)
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[a-z0-9]+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list[Node | str] = field(default_factory=list)
    digest: int = 0
    size: int = 0
    place: int = 0
    length: int = 0
    spared: bool = False


def parse(page: str) -> Node:
    """Element tree of a page, however broken; texts are still encoded. No recursion."""
    root = Node("")
    stack = [root]
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if m:
            at = m.end()
            close, name, attrs, done, text = m.groups()
        else:  # no name, or a quote that never closes: it ends at its first >
            stop = page.find(">", at)
            if stop < 0:
                break
            m = _BROKEN.match(page, at, stop)
            close, name = m.groups() if m else ("", None)
            attrs, done, text, at = "", ">", None, stop + 1
        if text:
            stack[-1].kids.append(text)
            continue
        if not name or not done:  # a comment, a declaration, or a tag that the page's end cut off
            continue
        name = name.lower()
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
            continue
        if name in BLOCK:
            _end(stack, {"p"}, {"button", "table", "td", "th", "caption", "object"})
        if name in _ENDS:
            _end(stack, *_ENDS[name])
        node = Node(name, {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(attrs)} if attrs else {})
        stack[-1].kids.append(node)
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, at)
            node.kids.append(page[at : stop.start()])
            at = stop.end()
        elif name not in VOID and not attrs.endswith("/"):
            stack.append(node)
    return root


def _end(stack: list[Node], what: set[str], stop: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in what:
            del stack[k:]
            if "p" not in what:
                _end(stack, what, stop)
            return
        if stack[k].tag in stop:
            return


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Every element on the way in (False) and out (True)."""
    todo = [(root, False)]
    while todo:
        node, out = todo.pop()
        yield node, out
        if not out:
            todo.append((node, True))
            todo.extend((k, False) for k in reversed(node.kids) if isinstance(k, Node))


def spare(root: Node) -> None:
    """Mark what only looks like noise: a form, or an element with such a name, that holds most of the page's text."""
    for node, out in _walk(root):
        if out:
            own = sum(k.length if isinstance(k, Node) else len(k) for k in node.kids)
            node.length = 0 if node.tag in NEVER and node.tag != "form" else own
    for node, out in _walk(root):
        if not out and 2 * node.length > root.length:
            node.spared = ALWAYS.isdisjoint(w for m in _marks(node) for w in _PART.findall(m))


def hash_subtrees(root: Node) -> None:
    """Digest of each element: name, attributes and content, white space squeezed, and the names of
    the elements around it; size is that of the text without noise."""
    for node, out in _walk(root):
        if not out:
            for k in node.kids:
                if isinstance(k, Node):
                    k.place = crc32(k.tag.encode("utf-8", "surrogatepass"), node.place)
        else:
            h = blake2b(f"{node.place} {node.tag}".encode("utf-8", "surrogatepass"), digest_size=8)
            h.update(repr(sorted(node.attrs.items())).encode("utf-8", "surrogatepass"))
            for k in node.kids:
                if isinstance(k, Node):
                    h.update(b"\0" + k.digest.to_bytes(8, "little", signed=True))
                    node.size += k.size
                else:
                    words = " ".join(k.split())
                    node.size += len(words)
                    h.update(b"\1" + words.encode("utf-8", "surrogatepass"))
            node.digest = int.from_bytes(h.digest(), "little", signed=True)
            if _noise(node, True):
                node.size = 0


def _marks(node: Node) -> list[str]:
    return f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower().split() if node.attrs else []


def _named_noise(mark: str) -> bool:
    """Whether a class or id as a whole says noise: ``site-footer`` does, ``has-sidebar`` does not."""
    parts = _PART.findall(mark)
    return any(p in NOISE for p in parts) and all(p in NOISE or p in PLAIN or p.isdigit() for p in parts)


def _noise(node: Node, in_article: bool) -> bool:
    if node.tag in NEVER and not (node.tag == "form" and node.spared) or "hidden" in node.attrs and node.attrs["hidden"] != "until-found":
        return True
    if node.tag == "header" and not in_article or not node.attrs:
        return node.tag == "header" and not in_article
    if node.attrs.get("aria-hidden", "").lower() == "true":
        return True
    if node.tag in ("article", "main", "body", "html"):
        marks = node.attrs.get("class", "").lower().split()
        return node.tag == "article" and any(m in ("comment", "teaser", "promo", "ad") for m in marks)
    return not node.spared and (node.attrs.get("role", "").lower() in ROLES or any(map(_named_noise, _marks(node))))


def main_roots(root: Node) -> list[Node]:
    """Outermost articles that are not noise, else mains, else the page itself."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        node = todo.pop()
        kind = "main" if node.attrs.get("role", "").lower() == "main" else node.tag
        if node is not root and kind not in ("html", "body", "head") and _noise(node, False):
            continue
        if kind in found:
            found[kind].append(node)
            if kind == "article":
                continue
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return found["article"] or found["main"][:1] or [root]


def blocks(roots: list[Node], templates: frozenset[int] | set[int]) -> list[str]:
    """Texts of blocks in page order without noise and templates; one that holds most of the page's text stays whole."""
    most = sum(top.size for top in roots)
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        words = " ".join(html.unescape("".join(run)).split())
        if words:
            out.append(words)
        run.clear()

    for top in roots:
        article = top.tag == "article" or top.tag == "main" or top.attrs.get("role") == "main"
        todo: list[Node | str | None] = [top]
        whole = 0  # length of todo below a subtree that stays whole
        while todo:
            node = todo.pop()
            if len(todo) < whole:
                whole = 0
            found = isinstance(node, Node) and not whole and node is not top and node.digest in templates
            if found and 2 * node.size > most:
                found, whole = False, len(todo) + 1
            if node is None:
                flush()
            elif isinstance(node, str):
                run.append(node)
            elif node is not top and (found or _noise(node, article)):
                if node.tag in BLOCK:
                    flush()
            else:
                if node.tag == "br":
                    run.append(" ")
                kids = node.kids
                if article and node.tag == "header":  # of an article's own header, the headings
                    kids = [k for k in kids if isinstance(k, Node) and k.tag in HEADING]
                if node.tag in BLOCK or node is top:
                    flush()
                    todo.append(None)
                todo.extend(reversed(kids))
        flush()
    return out


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each page's text, and of its block elements that are no noise, each once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts, sets = [], []
            for page in part.column("html").to_pylist():
                root = parse(page or "")
                spare(root)
                hash_subtrees(root)
                roots = main_roots(root)
                text = "\n\n".join(blocks(roots, frozenset()))
                texts.append(int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
                tops = set(map(id, roots))
                seen: set[int] = set()
                todo = [root]
                while todo:
                    node = todo.pop()
                    if node.size:  # neither noise nor empty
                        if node.tag in BLOCK and node.tag not in ("html", "body") and id(node) not in tops:
                            seen.add(node.digest)
                        todo.extend(k for k in node.kids if isinstance(k, Node))
                sets.append(sorted(seen))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("site"), pa.array(texts, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                names=["page_id", "site", "content", "hashes"],
            )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = []
            for page, gone in zip(part.column("html").to_pylist(), part.column("gone").to_pylist(), strict=True):
                root = parse(page or "")
                spare(root)
                roots = main_roots(root)
                if gone:
                    hash_subtrees(root)
                texts.append("\n\n".join(blocks(roots, set(gone or ()))))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, own: Scratch, recurs: int = RECURS, share: float = SHARE, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``.

    Blocks of text in page order joined by an empty line; null, empty and text-less pages give an
    empty text. The main part is the page's articles, else its main element, else the page; there
    the elements that are never article text go, and the host's templates: block elements whose
    whole subtree stands under elements of the same names on at least ``recurs`` and a ``share`` of
    the host's pages. Pages of one text are one page, whatever their keys, so copied articles stay.
    Neither the body, the main part, nor an element with most of the page's text is taken for a
    template, nor anything on a page without a host. An element is noise by its name only if a class
    or id says so as a whole, and neither by its name nor as a form if it holds most of the page's
    text, unless it is named as advertising, consent or comments. On pages whose articles are
    marked as such, templates decide only what recurs inside them.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    base = pages.select(
        F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"),
        F.when(host != "", F.xxhash64(host)).alias("site"),
    )
    schema = "page_id bigint, site bigint, content bigint, hashes array<bigint>"
    trees = own.keep(base.where("site IS NOT NULL").select("page_id", "site", "html").mapInArrow(_subtrees, schema))
    sites = trees.groupBy("site").agg(F.count_distinct("content").alias("pages"))
    each = trees.select("site", "content", F.explode("hashes").alias("h"))
    often = each.groupBy("site", "h").agg(F.count_distinct("content").alias("n")).where(F.col("n") >= recurs)
    # At most blocks of a page / share for each site, so a site's templates are one row.
    templates = often.join(sites, "site").where(F.col("n") >= share * F.col("pages")).groupBy("site").agg(F.collect_list("h").alias("known"))
    gone = trees.join(templates, "site").select("page_id", "site", F.explode(F.array_intersect("hashes", "known")).alias("h"))
    gone = gone.groupBy("page_id", "site").agg(F.collect_set("h").alias("gone"))
    # One plan at every size; a page's set is no longer than the page.
    joined = base.join(gone.hint("merge"), ["page_id", "site"], "left").select("page_id", "url", "html", "gone")
    return joined.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
