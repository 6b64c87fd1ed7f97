"""Main text of web pages, with the templates of each site removed.

A first pass parses every page into its element tree and hashes element subtrees; Spark counts, for each host, in how
many different surroundings a subtree stands; a second pass deletes the subtrees that recur. Subtrees are hashed in two
ways. The exact hash covers names and text: a subtree that stands in many surroundings word for word is a template. The
shape hash leaves the text out: names, classes and ids along the way from the body and below, with repeated children
counted once. A shape that recurs over a host's pages is one of the site's slots, whose text differs from page to page
(menus of other links, adverts, footers). A slot is a template if no paragraph or heading stands in it, and it is
neither the host's main slot nor holds it or lies in it; the main slot is the path of containers that holds more than
half of the text of the host's pages.

Names, roles and classes that say what an element is (navigation, footers, forms, adverts, comments, ...) decide where
recurrence cannot: on hosts with few pages, and for what stands on few pages. What is left of the article, or of the main
element or the body where there is none, is the text. ``lists=False`` leaves all of these lists out, so that recurrence
alone decides.

The surroundings of a subtree are the running text of the page's main part outside of it, so that copies of one page
count once. Running text is text in paragraphs, headings, lists, tables and the like, and any text of LONG words in a
row; on a page without it, all text. Where exact templates together hold more than half of a page's running text, the page
is taken for a copy and those of them that hold any stay.

Inside an article any recurring container counts (CONTAINERS: divs, sections, lists, tables, ...), with paragraphs or
list items in it or without. Exempt are single headings, paragraphs, quotes, list items and cells and what is inside a
line, unless they stand in such a container: the article's own passages stay however often a host repeats them. The same
holds in the main slot of a host.

The templates are counted before the second pass. Up to BROADCAST_TEMPLATES of them are copied to the executors as one
sorted array of eight bytes each, and pages are not shuffled at all; beyond that, marks are joined to pages.

Defined results: null html is the empty text; broken markup is read to its end, an unfinished tag at the end is dropped
and an unfinished character reference stays as text; white space in a block becomes one space, blocks are joined by one
space. Repeated pages and null ids give one row each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.store import Scratch, in_worker
from cuelight.llm.url_filter import host_of

#: Element names by what they mean for the text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noframes xmp template".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = set("aside button canvas datalist dialog embed fieldset footer form head iframe input math menu nav noframes noscript object optgroup option script search select style svg template textarea title xmp".split())
CONTAINERS = set("address article aside center details dialog dir div dl figure footer form header menu nav ol section table ul".split())
RUNNING = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption".split())
HEADED = set("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = set("ad ads adv advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies respond share sharing sidebar sponsor sponsored subscribe toolbar widget".split())
#: Start tags that end an open element of their group, searched up to the elements that hold such groups.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("article aside body div dl fieldset figure footer form header html main menu nav ol section table td th ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z|<(?=[^a-zA-Z/!?]|\Z)|</(?=[^a-zA-Z]|\Z)|</?[a-zA-Z][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: A subtree is a template when it stands in at least LEAST_PAGES surroundings on the host, and in LEAST_SHARE of its different pages or MANY_PAGES surroundings.
LEAST_PAGES, LEAST_SHARE, MANY_PAGES = 3, 0.1, 50
#: Text of so many words in a row is running text wherever it stands.
LONG = 12
#: Templates up to which their keys are copied to each executor (8 MB).
BROADCAST_TEMPLATES = 1_000_000


class Element:
    __slots__ = ("furniture", "items", "label", "name", "number", "parent")

    def __init__(self, name: str, parent: Element | None, number: int, furniture: bool = False, label: str = ""):
        self.name, self.parent, self.number, self.furniture, self.label = name, parent, number, furniture, label or name
        self.items: list[Element | str] = []


def _label(name: str, attributes: str) -> str:
    """The element's name with the words of its class and id but for numbers: what tells the slots of a page apart."""
    words = {w for key, *values in _ATTRIBUTE.findall(attributes) if key.lower() in ("class", "id") for v in values for w in v.lower().split()} if "=" in attributes else ()
    return ".".join([name, *sorted(w for w in words if not any(c.isdigit() for c in w))])


def _is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in FURNITURE or (name == "header" and not in_article):
        return True
    for key, *values in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        key, value = key.lower(), html.unescape(next((v for v in values if v), ""))
        if key == "role" and value.lower() in ROLES or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and name not in ("html", "body", "main", "article"):
            words = {w.lower() for w in _NAMES.findall(value)}
            if words & WORDS or "header" in words and not in_article and name not in RUNNING:
                return True
        if key in ("class", "id") and name == "article" and {w.lower() for w in _NAMES.findall(value)} & {"comment", "comments", "reply"}:
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes))


def parse(page: str | None, lists: bool = True) -> tuple[Element, list[Element]]:
    """The root and all elements in page order; an element's number is its place in that list."""
    root = Element("#root", None, 0)
    elements, at, pos, articles = [root], root, 0, 0
    open_names: Counter[str] = Counter()
    text = page or ""

    def close(to: Element) -> None:
        nonlocal at, articles
        while at is not to:
            articles -= at.name == "article"
            open_names[at.name] -= 1
            at = at.parent

    while pos < len(text):
        m = _TOKEN.search(text, pos)
        if m is None:
            at.items.append(html.unescape(text[pos:]))
            break
        if m.start() > pos:
            at.items.append(html.unescape(text[pos : m.start()]))
        pos = m.end()
        if m[2] is None:
            if m[0] == "<":  # a sign, not a tag
                at.items.append("<")
            continue
        name = m[2].lower()
        if m[1]:
            e = at
            while open_names[name] and e.parent is not None and e.name != name and not (e.name in SCOPES and name not in SCOPES):
                e = e.parent
            if e.name == name:
                close(e.parent)
            elif name == "br":
                at.items.append(" ")
            continue
        if name == "br":
            at.items.append(" ")
            continue
        group = CLOSES.get(name) or ({"p"} if name in BLOCKS else None)
        if group and any(open_names[g] for g in group):
            e, found = at, None
            while e.parent is not None and (e.name in group or e.name not in SCOPES):
                if e.name in group:
                    found = e
                e = e.parent
            if found:
                close(found.parent)
        new = Element(name, at, len(elements), lists and _is_furniture(name, m[3], articles > 0), _label(name, m[3]) if name in CONTAINERS else name)
        elements.append(new)
        at.items.append(new)
        if name in VOID or m[3].endswith("/") and name not in BLOCKS and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(text, pos)
            pos = end.end() if end else len(text)
            continue
        at = new
        open_names[name] += 1
        articles += name == "article"
    return root, elements


def main_roots(elements: list[Element], lists: bool = True) -> list[Element]:
    """The outermost articles that are no furniture, else the main elements, else the whole page."""
    for name in ("article", "main") if lists else ():
        hidden, found = [False] * len(elements), []  # below furniture or another one of them
        for e in elements:
            hidden[e.number] = e.furniture or e.parent is not None and (hidden[e.parent.number] or e.parent.name == name)
            if e.name == name and not hidden[e.number]:
                found.append(e)
        if found:
            return found
    return elements[:1]


def running_text(elements: list[Element], lists: bool = True) -> tuple[list[int], list[int]]:
    """By element number, length and hash of the running text that is shown of the subtree. Hashes of parts add up."""
    roots = {e.number for e in main_roots(elements, lists)}
    shown, runs = [False] * len(elements), [False] * len(elements)
    texts: list[tuple[int, str, bool]] = []
    for e in elements:
        up = e.parent
        shown[e.number] = not e.furniture and (e.number in roots or up is not None and shown[up.number])
        runs[e.number] = e.name in RUNNING or up is not None and runs[up.number]
        if shown[e.number]:
            for x in e.items:
                if isinstance(x, str) and (words := x.split()):
                    texts.append((e.number, " ".join(words), runs[e.number] or len(words) >= LONG))
    every = not any(run for _, _, run in texts)
    lengths, hashes = [0] * len(elements), [0] * len(elements)
    for number, text, run in texts:
        if run or every:
            lengths[number] += len(text)
            hashes[number] += int.from_bytes(hashlib.md5(text.encode("utf-8", "replace"), usedforsecurity=False).digest()[:8])
    for e in reversed(elements[1:]):
        lengths[e.parent.number] += lengths[e.number]
        hashes[e.parent.number] += hashes[e.number]
    return lengths, hashes


def _signed(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _digest(*parts: bytes) -> bytes:
    return hashlib.md5(b"\0".join(parts), usedforsecurity=False).digest()


def subtree_hashes(elements: list[Element], lists: bool = True) -> tuple[dict[int, tuple[int, int]], int]:
    """Element number -> hashes of its subtree and of its surroundings, of the elements that may be exact templates.

    What is no container in an article is left out, and so are elements below a name of the lists. The second result is
    the hash of the page's running text.
    """
    exact: dict[int, bytes] = {}
    full: dict[int, bool] = {}
    for e in reversed(elements):
        parts, some = [e.name.encode()], False
        for x in e.items:
            if isinstance(x, str):
                if x := " ".join(x.split()):
                    parts.append(b"t" + x.encode("utf-8", "replace"))
                    some = True
            else:
                parts.append(b"e" + exact[x.number])
                some = some or full[x.number]
        exact[e.number], full[e.number] = _digest(*parts), some
    roots = {e.number for e in main_roots(elements, lists)}
    has_article = elements[min(roots)].name in ("article", "main")
    _, running = running_text(elements, lists)

    def signed(x: int) -> int:
        return (x + (1 << 63)) % (1 << 64) - (1 << 63)

    out, below = {}, {0: (False, 0 in roots)}
    for e in elements[1:]:
        hidden, inside = below[e.parent.number]
        if inside and not hidden and full[e.number] and e.number not in roots and e.name not in ("html", "body"):
            if not has_article or e.name in CONTAINERS:
                out[e.number] = _signed(exact[e.number]), signed(running[0] - running[e.number])
        below[e.number] = (hidden or e.furniture, inside or e.number in roots)
    return out, signed(running[0])


def slots(elements: list[Element]) -> list[tuple[int, int, int, int, int, bool]]:
    """(number, path, path above, shape, length of text, plain) of the containers that only containers stand above.

    ``path`` hashes the labels from the body down, ``shape`` also those below with neighbours of one shape counted once;
    ``plain`` is whether no paragraph or heading stands inside.
    """
    shape: dict[int, bytes] = {}
    length: dict[int, int] = {}
    plain: dict[int, bool] = {}
    for e in reversed(elements):
        parts, last, n, no_heads = [e.label.encode()], b"", 0, e.name not in HEADED
        for x in e.items:
            if isinstance(x, str):
                n += len(x.strip())
            else:
                if shape[x.number] != last:
                    parts.append(shape[x.number])
                last = shape[x.number]
                n += length[x.number]
                no_heads = no_heads and plain[x.number]
        shape[e.number], length[e.number], plain[e.number] = _digest(*parts), n, no_heads
    out, paths = [], {0: b""}
    for e in elements[1:]:
        above = paths.get(e.parent.number)
        if e.name in ("html", "body"):
            paths[e.number] = b""
        elif above is not None and e.name in CONTAINERS and length[e.number]:
            paths[e.number] = _digest(above, e.label.encode())
            out.append((e.number, _signed(paths[e.number]), _signed(above) if above else 0, _signed(_digest(paths[e.number], shape[e.number])), length[e.number], plain[e.number]))
    return out


def deletable(elements: list[Element], templates: set[int], lists: bool = True) -> set[int]:
    """The templates without those that hold running text, where together they hold more than half of the page's."""
    if not templates:
        return templates
    lengths, _ = running_text(elements, lists)
    outermost, covered = 0, {0: False}
    for e in elements[1:]:
        above = covered[e.parent.number]
        covered[e.number] = above or e.number in templates
        outermost += lengths[e.number] if covered[e.number] and not above else 0
    return {n for n in templates if not lengths[n]} if 2 * outermost > lengths[0] else templates


def text_of(elements: list[Element], templates: set[int] = frozenset(), lists: bool = True) -> str:
    """The text of the page's main part without furniture and the given elements, blocks joined by one space."""
    pieces: list[str] = []
    for root in main_roots(elements, lists):
        stack: list[Element | str] = [root]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                pieces.append(x)
            elif x.number in templates:
                pieces.append("\n" if x.name in BLOCKS else "")
            elif not x.furniture:
                if x.name in BLOCKS:
                    pieces.append("\n")
                    stack.append("\n")
                stack.extend(reversed(x.items))
    return " ".join("".join(pieces).split())


#: Kinds of counted rows: an exact subtree, the shape of a slot, text by path of containers, a page.
EXACT, SHAPE, PATH, PAGE = range(4)
_NODE = "host string, kind int, hash long, above long, around long, length long"


def _marked(elements: list[Element], host: int, known: np.ndarray, lists: bool) -> set[int]:
    """Numbers of the page's elements whose exact hash or shape is among the sorted keys of templates."""
    exact, _ = subtree_hashes(elements, lists)
    own = [(n, _key(host, EXACT, h)) for n, (h, _) in exact.items()]
    shapes = [(s[0], _key(host, SHAPE, s[3])) for s in slots(elements)]

    def hits(pairs: list[tuple[int, int]]) -> set[int]:
        if not pairs or not len(known):
            return set()
        keys = np.array([k for _, k in pairs], np.uint64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return {n for (n, _), hit in zip(pairs, known[at] == keys, strict=True) if hit}

    return deletable(elements, hits(own), lists) | hits(shapes)


def _host_hash(host: str) -> int:
    return xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))


def _key(host: int, kind: int, value: int) -> int:
    return ((host ^ (value & (1 << 64) - 1)) * 0x9E3779B97F4A7C15 + kind) & (1 << 64) - 1


def site_templates(rows: DataFrame, lists: bool = True) -> DataFrame:
    """(host, kind, hash) of all templates of (host, html) rows, stored."""

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("html")
        for b in parts:
            out: tuple[list, ...] = ([], [], [], [], [], [])

            def put(*values) -> None:
                for column, value in zip(out, values, strict=True):
                    column.append(value)

            for host, source in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                elements = parse(source.as_py(), lists)[1]
                exact, page = subtree_hashes(elements, lists)
                put(host, PAGE, 0, 0, page, 0)
                places = slots(elements)
                slot = {s[0]: s[1] for s in places}
                for e in elements[1:]:
                    slot.setdefault(e.number, slot.get(e.parent.number, 0))
                for n, (h, around) in exact.items():
                    put(host, EXACT, h, 0 if elements[n].name in CONTAINERS else slot[n], around, 0)
                for _, path, above, shape, length, plain in places:
                    put(host, PATH, path, above, page, length)
                    if plain:
                        put(host, SHAPE, shape, path, page, 0)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["host", "kind", "hash", "above", "around", "length"])

    nodes = rows.select("host", "html").mapInArrow(hashed, _NODE)
    # Copies of one page and slots of equal path count once: equal surroundings first, then the counts.
    once = nodes.groupBy("host", "kind", "hash", "above", "around").agg(F.max("length").alias("length"))
    counted = once.groupBy("host", "kind", "hash", "above").agg(F.count("*").alias("on"), F.sum("length").alias("length"))
    scratch = Scratch(rows.sparkSession, "html")
    counted = scratch.table(counted.filter((F.col("on") >= LEAST_PAGES) | (F.col("kind") >= PATH)), "counted")
    sizes = counted.filter(F.col("kind") == PAGE).select("host", F.col("on").alias("pages"))
    often = (F.col("on") >= LEAST_SHARE * F.col("pages")) | (F.col("on") >= MANY_PAGES)
    common = counted.filter((F.col("kind") < PATH) & (F.col("on") >= LEAST_PAGES)).join(sizes, "host").filter(often)
    # The main slot: the longest paths that hold more than half of the text which containers below the body hold.
    paths = counted.filter(F.col("kind") == PATH).select("host", "hash", "above", "length")
    whole = paths.filter("above = 0").groupBy("host").agg(F.sum("length").alias("whole"))
    main = scratch.table(paths.join(whole, "host").filter(2 * F.col("length") > F.col("whole")).select("host", "hash", "above"), "main")
    on_way = main.select("host", F.col("hash").alias("path"))
    # What lies in the main slot has it above; a slot is judged by its place: beside the way to the main slot, or below its end.
    ends = main.join(main.select("host", F.col("above").alias("hash")), ["host", "hash"], "left_anti").select("host", "hash")
    inside, reach = ends, ends
    while not reach.isEmpty():
        deeper = paths.select("host", "hash", "above").join(reach.select("host", F.col("hash").alias("above")), ["host", "above"]).select("host", "hash")
        reach = scratch.table(deeper.distinct(), "inside")
        inside = inside.unionByName(reach)
    kept = on_way.unionByName(inside.select("host", F.col("hash").alias("path"))).distinct()
    shapes = common.filter(F.col("kind") == SHAPE).withColumnRenamed("above", "path").join(kept, ["host", "path"], "left_anti")
    held = main.select("host").distinct()
    shapes = shapes.join(held, "host", "left_semi")  # without a main slot, nothing tells the site's slots from its text
    # In the main slot, single paragraphs and the like are the pages' own passages, as they are in an article.
    exact = common.filter(F.col("kind") == EXACT).withColumnRenamed("above", "path").join(kept, ["host", "path"], "left_anti")
    return scratch.table(exact.select("host", "kind", "hash").unionByName(shapes.select("host", "kind", "hash")).distinct(), "templates")


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", lists: bool = True) -> DataFrame:
    """Each row's key, url, text and n_chars (code points)."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    templates = site_templates(rows, lists)
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, url string, text string, n_chars long"

    def out(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["key", "url", "text", "n_chars"])

    if templates.count() <= BROADCAST_TEMPLATES:
        found = templates.toPandas()  # three short columns of a counted, bounded table
        keys = [_key(_host_hash(h), k, v) for h, k, v in zip(found["host"], found["kind"].tolist(), found["hash"].tolist(), strict=True)]
        shared = pages.sparkSession.sparkContext.broadcast(np.unique(np.array(keys, np.uint64)))

        def extracted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            in_worker("html")
            for b in parts:
                texts = []
                for source, host in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                    elements = parse(source.as_py(), lists)[1]
                    texts.append(text_of(elements, _marked(elements, _host_hash(host), shared.value, lists), lists))
                yield out(b, texts)

        return rows.select("key", "url", "html", "host").mapInArrow(extracted, schema).withColumnRenamed("key", key)

    # Pages' own hashes meet the templates, and each page's marks come back to it.
    rows = rows.withColumn("page", F.md5(F.concat_ws("\x01", "host", F.coalesce("html", F.lit("\x02")))))

    def own_hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("html")
        for b in parts:
            lines = []
            for host, one, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                elements = parse(source.as_py(), lists)[1]
                lines += [(host, one, n, EXACT, h) for n, (h, _) in subtree_hashes(elements, lists)[0].items()]
                lines += [(host, one, s[0], SHAPE, s[3]) for s in slots(elements)]
            names = ["host", "page", "number", "kind", "hash"]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], t) for i, t in enumerate(kinds)], names)

    mine = rows.select("host", "page", "html").mapInArrow(own_hashes, "host string, page string, number int, kind int, hash long")
    marks = mine.join(templates, ["host", "kind", "hash"]).groupBy("page").agg(F.collect_set(F.struct("kind", "number")).alias("marks"))

    def marked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("html")
        for b in parts:
            texts = []
            for source, found in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                elements = parse(source.as_py(), lists)[1]
                exact, shapes = ({m["number"] for m in found or () if m["kind"] == k} for k in (EXACT, SHAPE))
                texts.append(text_of(elements, deletable(elements, exact, lists) | shapes, lists))
            yield out(b, texts)

    return rows.join(marks, "page", "left").select("key", "url", "html", "marks").mapInArrow(marked, schema).withColumnRenamed("key", key)
