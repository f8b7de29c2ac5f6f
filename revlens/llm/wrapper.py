"""Main text of web pages by wrapper induction.

Pages of one host share a template. For every host a page of median length is the
seed; all pages of the host are aligned with the seed's tree by simple tree
matching (equal labels, order kept, most matched nodes), and the counts of the
alignments are summed for every seed node: how often it was found, how often its text
was the same, and how much varying text stood in it. Nodes whose text stays the same
are template, varying ones are slots. The wrapper of the host is the main slot:
an `article` or `main` with varying text if there is one, else the deepest node that holds
`Config.share` of it. A page's text is what stands in the node aligned with
the main slot, less the parts that HTML or their names mark as no content (menus,
adverts, forms, comments and so on) and less the slot's own template texts.

Copies must not pass for templates: text inside the main slot is template only if
found on `Config.least` pages or more, the same on `Config.constant` of them, and if all such
text is a small part (`Config.little`) of what stands in the slot. A page without the
host's slot falls back on its own `article` or `main`, then on all its text outside
of marked parts.

Work on Spark: the seed is chosen from lengths and hashes; both passes read the pages
where they lie, joined with one small row a host; a batch sums its alignments
before they are shuffled, so a host with most of the pages is no hot key.

Defined results: a null html is an empty page with an empty text; pages without or
with a broken url share the host ''; very long pages are read whole; elements nested
deeper than `DEEP` levels count as blocks of the one at that level; text is split at
Unicode white space; repeated rows give repeated results; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import record_batch, slices
from revlens.session import materialize

# --- fixed values: elements and the names that mark what is no content ---------------
RAW = "script style title textarea iframe noembed noframes xmp"
BLOCKS = frozenset(
    "address article aside blockquote button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav noscript object ol optgroup option p pre section select summary svg table tbody "
    "td template tfoot th thead tr ul".split()
)
MARKED_TAGS = frozenset("nav footer aside form noscript template button select svg object canvas dialog menu".split())
PAGE_TAGS = frozenset(["header"])  # no content unless inside the article
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MARKED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent gdpr notice notices notification alert popup modal newsletter subscribe subscription "
    "social share sharing comment comments commentlist commentform disqus replies respond adbox adslot adsbygoogle topbar subnav submenu related recommended widget widgets pagination pager toolbar".split()
)
CLOSES_P = BLOCKS - frozenset("button canvas noscript object option optgroup svg select template td th tr tbody thead tfoot caption".split())
NOT_P = BLOCKS - {"p"}
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd td th tr table pre blockquote figure figcaption caption".split())
SIBLINGS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "option": ("option", "select")}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}
# ----------------------------------------------------------------------------------

_TOKEN = re.compile(
    rf"<!--(?:.*?--!?>|.*\Z)|<({'|'.join(RAW.split())})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
DEEP = 60
TEXT, CONTENT, MARKED, PAGE = "#", 0, 1, 2


@dataclass(frozen=True)
class Config:
    share: float = 0.8  # of the varying text: go on into this child
    least: int = 8
    constant: float = 0.9
    little: float = 0.2


# --- one page --------------------------------------------------------------------------
@lru_cache(1 << 14)
def _kind(tag: str, attributes: str) -> tuple[str, int]:
    """Label (tag and class names) and whether the element is marked."""
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    names = set(re.split(r"[^a-z]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
    label = ".".join([tag, *sorted(set(found.get("class", "").lower().split()))])
    marked = tag in MARKED_TAGS or names & MARKED_NAMES or found.get("role", "").lower() in MARKED_ROLES or "hidden" in found
    return label, MARKED if marked else PAGE if tag in PAGE_TAGS else CONTENT


class Page:
    """Block elements and text blocks in page order; node 0 is the page."""

    def __init__(self) -> None:
        self.labels, self.kinds, self.parents, self.children, self.texts = ["page"], [CONTENT], [-1], [[]], [""]

    def add(self, label: str, kind: int, parent: int, text: str = "") -> int:
        n = len(self.labels)
        self.labels.append(label)
        self.kinds.append(kind)
        self.parents.append(parent)
        self.children.append([])
        self.texts.append(text)
        self.children[parent].append(n)
        return n


def parse(html: str) -> Page:
    page, at, held = Page(), 0, []
    stack: list[tuple[str, int]] = [("page", 0)]  # open elements and their nodes

    def flush() -> None:
        if held:
            text = "".join(held)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                page.add(TEXT, CONTENT, stack[-1][1], text)
            held.clear()

    def close(tags, barrier=()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in barrier:
                return

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag in BLOCKS:
                flush()
                close((tag,))
            elif stack[-1][0] == f"~{tag}":  # an inline element that was marked
                flush()
                stack.pop()
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P:
                close(("p",), NOT_P)
            if tag in SIBLINGS:
                close(*SIBLINGS[tag])
            label, kind = _kind(tag, m.group(4))
            if len(stack) > DEEP and kind == CONTENT:
                stack.append((tag, stack[-1][1]))
            else:
                stack.append((tag, page.add(label, kind, stack[-1][1])))
        elif tag == "hr":
            flush()
        elif tag == "br":
            held.append(" ")
        elif m.group(4) and tag not in ("html", "body", "head", "img", "input", "meta", "link", "wbr", "source", "track", "embed", "area", "col", "base"):
            label, kind = _kind(tag, m.group(4))
            if kind == MARKED:
                flush()
                stack.append((f"~{tag}", page.add(label, kind, stack[-1][1])))
    if at < len(html):
        held.append(html[at:])
    flush()
    return page


# --- alignment -------------------------------------------------------------------------
class Seed:
    """A page's tree without its texts; of a text block only its hash is kept."""

    def __init__(self, labels, parents, kinds, hashes) -> None:
        self.labels, self.parents, self.kinds, self.hashes = labels, parents, kinds, hashes
        self.children: list[list[int]] = [[] for _ in labels]
        for n, p in enumerate(parents):
            if p >= 0:
                self.children[p].append(n)
        self.alone = only_text(self.children, labels, hashes)

    @classmethod
    def of(cls, page: Page) -> Seed:
        return cls(page.labels, page.parents, page.kinds, [_hash(t) if t else 0 for t in page.texts])

    def dump(self) -> str:
        names = sorted(set(self.labels))
        where = {n: i for i, n in enumerate(names)}
        return json.dumps([names, [where[x] for x in self.labels], self.parents, self.kinds, self.hashes], separators=(",", ":"))


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


@lru_cache(64)
def load(dumped: str) -> Seed:
    names, labels, parents, kinds, hashes = json.loads(dumped)
    return Seed([names[i] for i in labels], parents, kinds, hashes)


def only_text(children: list[list[int]], labels: list[str], hashes: list[int]) -> list[int]:
    """For every node the hash of its text if that is all it holds, else -1."""
    return [hashes[c[0]] if len(c) == 1 and labels[c[0]] == TEXT else -1 for c in children]


def align(seed: Seed, page: Page) -> dict[int, int]:
    """Simple tree matching: page node -> seed node. Equal texts weigh a half
    more, so that template texts find each other."""
    tables: dict[tuple[int, int], list[list[float]]] = {}
    hashes = [_hash(t) if t else 0 for t in page.texts]
    alone_a, alone_b = seed.alone, only_text(page.children, page.labels, hashes)
    labels_a, labels_b = seed.labels, page.labels

    def table(a: int, b: int) -> list[list[float]]:
        if (a, b) in tables:
            return tables[a, b]
        ka, kb = seed.children[a], page.children[b]
        rows, prior = [[0.0] * (len(kb) + 1)], [0.0] * (len(kb) + 1)
        there = [(labels_b[y], alone_b[y], y) for y in kb]
        for x in ka:
            row, left, label, alone = [0.0], 0.0, labels_a[x], alone_a[x]
            for j, (other, text, y) in enumerate(there):
                s = prior[j + 1]
                if left > s:
                    s = left
                if label == other:
                    if alone >= 0 and text >= 0:
                        w = prior[j] + (2.5 if alone == text else 2.0)
                    else:
                        w = prior[j] + weight(x, y)
                    if w > s:
                        s = w
                row.append(s)
                left = s
            rows.append(row)
            prior = row
        tables[a, b] = rows
        return rows

    def weight(a: int, b: int) -> float:
        if labels_a[a] == TEXT:
            return 1.5 if seed.hashes[a] == hashes[b] else 1.0
        return 1.0 + table(a, b)[-1][-1] if seed.children[a] and page.children[b] else 1.0

    matched, todo = {0: 0}, [(0, 0)]
    while todo:
        a, b = todo.pop()
        ka, kb = seed.children[a], page.children[b]
        rows = table(a, b)
        i, j = len(ka), len(kb)
        while i and j:
            x, y = ka[i - 1], kb[j - 1]
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                matched[y] = x
                todo.append((x, y))
                i, j = i - 1, j - 1
    return matched


def locate(seed: Seed, page: Page, slot: int) -> int | None:
    """The page's node that any alignment matches with the slot, if labels alone
    tell it: on the way down, one child of the label in both trees."""
    way = []
    while slot:
        way.append(slot)
        slot = seed.parents[slot]
    at = 0
    for n in reversed(way):
        label = seed.labels[n]
        mine = [c for c in page.children[at] if page.labels[c] == label]
        if len(mine) != 1 or sum(seed.labels[c] == label for c in seed.children[seed.parents[n]]) != 1:
            return None
        at = mine[0]
    return at


# --- what a host's pages have in common -------------------------------------------------
def observe(seed: Seed, page: Page, sums: dict[int, list[int]]) -> None:
    """Adds one page to the sums of each seed node: found, same text, characters of
    the varying text at it and of the same text."""
    matched = align(seed, page)
    nearest = [0] * len(page.labels)  # the nearest aligned element
    outside = [False] * len(page.labels)  # in a marked part
    for n in range(len(page.labels)):
        p = page.parents[n]
        outside[n] = page.kinds[n] == MARKED or p >= 0 and outside[p]
        nearest[n] = matched.get(n, nearest[p] if p >= 0 else 0)
        if n in matched:
            s = sums.setdefault(matched[n], [0, 0, 0, 0])
            s[0] += 1
            if page.labels[n] == TEXT and seed.hashes[matched[n]] == _hash(page.texts[n]):
                s[1] += 1
                s[3] += 0 if outside[n] else len(page.texts[n])
                continue
        if page.labels[n] == TEXT and not outside[n]:
            sums.setdefault(nearest[n], [0, 0, 0, 0])[2] += len(page.texts[n])


def induce(seed: Seed, sums: dict[int, list[int]], cfg: Config = Config()) -> tuple[int, list[int]]:
    """The main slot and the template texts in it, from the sums of all pages."""
    zero = [0, 0, 0, 0]

    def total(at: int) -> list[int]:
        out = [sums.get(n, zero)[at] for n in range(len(seed.labels))]
        for n in range(len(out) - 1, 0, -1):  # children come after their parents
            out[seed.parents[n]] += out[n]
        return out

    varying = total(2)
    mass = varying if varying[0] else total(3)
    inside = [False] * len(seed.labels)
    for n in range(1, len(seed.labels)):
        inside[n] = seed.kinds[n] == MARKED or inside[seed.parents[n]]
    named = [n for n in range(len(seed.labels)) if seed.labels[n].split(".")[0] in ("article", "main") and mass[n] and not inside[n]]
    if named:
        slot = max(named, key=lambda n: (seed.labels[n].startswith("article"), mass[n], -n))
    else:
        slot, down = 0, True
        while down:
            down = False
            for c in seed.children[slot]:
                if seed.labels[c] != TEXT and seed.labels[c].split(".")[0] not in TEXT_BLOCKS and seed.kinds[c] == CONTENT and mass[slot] and mass[c] >= cfg.share * mass[slot]:
                    slot, down = c, True
                    break
    held = {slot}
    fixed = []
    for n in range(slot + 1, len(seed.labels)):
        if seed.parents[n] in held:
            held.add(n)
            found, same = sums.get(n, zero)[:2]
            if seed.labels[n] == TEXT and found >= cfg.least and found >= sums.get(slot, zero)[0] / 2 and same >= cfg.constant * found:
                fixed.append(n)
    chars = sum(sums[n][3] for n in fixed)
    if chars > cfg.little * (mass[slot] + chars):
        fixed = []
    return slot, fixed


def inner(page: Page, slot: int, without: frozenset[int] = frozenset(), headers: bool = True) -> str:
    """The texts in a node, less marked parts, in page order."""
    out, todo = [], [slot]
    while todo:
        n = todo.pop()
        if page.labels[n] == TEXT:
            if n not in without:
                out.append(page.texts[n])
            continue
        todo += [c for c in reversed(page.children[n]) if page.kinds[c] == CONTENT or headers and page.kinds[c] == PAGE]
    return " ".join(out)


def main_text(page: Page, seed: Seed | None = None, slot: int = 0, fixed: list[int] = ()) -> str:
    """The page's text in the host's main slot, or what it falls back on."""
    if seed is not None and slot:
        mine, out = None if fixed else locate(seed, page, slot), set()
        if mine is None:
            matched, constant = align(seed, page), set(fixed)
            mine = next((n for n, s in matched.items() if s == slot), None)
            out = {n for n, s in matched.items() if s in constant and seed.hashes[s] == _hash(page.texts[n])}
        text = inner(page, mine, frozenset(out)) if mine is not None else ""
        if text:
            return text
    best, most = None, -1
    for n in range(1, len(page.labels)):
        name = page.labels[n].split(".")[0]
        if name in ("article", "main") and page.kinds[n] == CONTENT:
            text = inner(page, n)
            if len(text) > most:
                best, most = text, len(text)
    return best if best else inner(page, 0, headers=False)


# --- Spark -----------------------------------------------------------------------------
def host(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), host().alias("host"))


def seeds(pages: DataFrame) -> DataFrame:
    """host, seed: the tree of a page of median length (the least hash among
    those nearest to it) for every host."""
    size, key = F.length("html"), F.xxhash64("html")
    known = pages.select("host", size.alias("size"), key.alias("key"))
    middle = materialize(known.groupBy("host").agg(F.percentile_approx("size", 0.5).alias("middle")), "wrapper-sizes")
    chosen = known.join(middle, "host").groupBy("host").agg(F.min(F.struct(F.abs(F.col("size") - F.col("middle")).alias("far"), "key", "size")).alias("s"))
    # stored, so that their size is known: a small table keeps the pages from being shuffled
    chosen = materialize(chosen.select(F.col("host").alias("h"), "s.key", F.col("s.size").alias("size")), "wrapper-chosen")
    same = (F.col("host") == F.col("h")) & (size == F.col("size")) & (F.xxhash64("html") == F.col("key"))
    rows = pages.join(chosen, same, "left_semi").select("host", "html")
    schema = pa.schema([("host", pa.string()), ("seed", pa.string())])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dumped = [Seed.of(parse(h.as_py())).dump() for h in b.column("html")]
            yield record_batch({"host": b.column("host"), "seed": dumped}, schema)

    made = rows.mapInArrow(trees, "host string, seed string")
    return materialize(made.groupBy("host").agg(F.min("seed").alias("seed")), "wrapper-seeds")


def wrappers(pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """host, seed, slot, fixed: the wrapper of every host, from all its pages."""
    known = seeds(pages)
    columns = ("node", "found", "same", "varying", "chars")
    schema = pa.schema([("host", pa.string()), *[(c, pa.int64()) for c in columns]])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: dict[str, dict[int, list[int]]] = {}
            for part in slices(b, "html"):
                for h, s, html in zip(part.column("host"), part.column("seed"), part.column("html"), strict=True):
                    observe(load(s.as_py()), parse(html.as_py()), of.setdefault(h.as_py(), {}))
            rows = [(h, n, *v) for h, nodes in of.items() for n, v in nodes.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    counted = pages.select("host", "html").join(known, "host").mapInArrow(sums, "host string, node long, found long, same long, varying long, chars long")
    counted = counted.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in columns[1:]])
    nodes = counted.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("nodes"))  # the seed's nodes at most
    out = pa.schema([("host", pa.string()), ("seed", pa.string()), ("slot", pa.int64()), ("fixed", pa.list_(pa.int64()))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for s, of in zip(b.column("seed").to_pylist(), b.column("nodes").to_pylist(), strict=True):
                found.append(induce(load(s), {r["node"]: [r[c] for c in columns[1:]] for r in of}, cfg))
            fields = {"host": b.column("host"), "seed": b.column("seed"), "slot": [f[0] for f in found], "fixed": [f[1] for f in found]}
            yield record_batch(fields, out)

    return materialize(known.join(nodes, "host").mapInArrow(made, "host string, seed string, slot long, fixed array<long>"), "wrappers")


def extract(pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = _pages(pages)
    known = wrappers(rows, cfg)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "html"):
                found = []
                for s, slot, fixed, html in zip(*[part.column(c) for c in ("seed", "slot", "fixed", "html")], strict=True):
                    found.append(main_text(parse(html.as_py()), load(s.as_py()), slot.as_py(), fixed.as_py()))
                yield record_batch({"page_id": part.column("page_id"), "url": part.column("url"), "text": found}, schema)

    joined = rows.withColumn("page_id", F.col("page_id").cast("long")).join(known, "host")
    return joined.mapInArrow(texts, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


#: The article's text in DuckDB's SQL, for pages that mark it as `article` and hold
#: headings, paragraphs, inline elements and the entities named below only.
EXTRACT_SQL = r"""
WITH articles AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages
), blocks AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda b:
    trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '<[^>]+>', '', 'g'),
      '&amp(;?)', chr(1) || '\1', 'g'), '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)), chr(1) || ';', '&'), chr(1), '&'), '\s+', ' ', 'g'))) AS parts
  FROM articles
)
SELECT page_id, url, array_to_string(list_filter(parts, lambda b: b <> ''), ' ') AS text,
       CAST(length(array_to_string(list_filter(parts, lambda b: b <> ''), ' ')) AS BIGINT) AS n_chars
FROM blocks
"""
