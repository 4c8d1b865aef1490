"""HTML extraction by wrapper induction.

1. Of each host and layout (pages that hold an article element, a main element, or neither) all pages are parsed into trees. Equal
   trees are one; they are dealt by their hash into SHARES parts, where they are aligned, one after another, by simple tree
   matching, and then the parts' trees likewise: the wrapper is the tree of their slots, whatever the input's partitions. Siblings with the same label that are passages or have a class are one
   slot, as are those beyond RUN others with the same label.
2. Every page of every host is aligned with its wrapper. For each slot all pages count how many of its block
   texts are constant, that is stand in that slot on at least two pages that differ (pages with the same
   longest block are copies and count as one).
3. A slot is template if at least CONSTANT of its texts are, in at least four differing pages; else it varies. Where more than
   COPIES of a host's whole text is constant, pages are near copies of each other and nothing follows from it. The content root is the
   deepest slot that holds all varying text outside links.
4. A page is read along its wrapper: the blocks of the content root's varying slots, in page order. An element that
   matches no slot is treated like the nearest ancestor that does. Text outside the root stays, too, unless it is in a
   link or template. Pages without the root give all their varying slots.

Priors, used beside the alignment: elements whose tag, class, id or role names a kind of chrome (menus, headers outside an
article, footers, sidebars, notices, adverts, forms, reader comments) are template even if they vary; an article or, without
one, a main element that holds at least half of the varying text is the root, and text outside of it goes. priors=False
leaves the decision to the alignment alone.

The wrappers and the counts a slot are bounded by host; they are broadcast where their counted size is
below common.SMALL_BYTES, else joined by shuffling the pages. Ties: of equally large matchings that with the earlier
elements of the wrapper; of equally deep roots the first in page order.

Null and empty html give empty text; a null or odd url means host ''. Repeated pages are extracted alike
and do not make text constant; a page with a null page_id is like any other. Pages may be nested to any depth and of any length. No
pages give an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, small_side, stored

SHARES, RUN = 64, 20
SAMPLE = 8  # pages that the tests induce() by hand; no query takes a sample
CONSTANT, COPIES, DIFFERING = 0.8, 0.4, 4
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title".split())  # their content is no markup
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr img".split())
NO_TEXT = set("script style title head template".split())  # never part of the page's text
# Tags that are chrome, and words of class, id and role that name it.
CHROME_TAGS = NO_TEXT | set("nav header footer aside form button menu dialog fieldset input textarea select option".split())
CHROME_WORDS = set(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar header toolbar comment comments respond disqus "
    "subscribe login pagination pager complementary contentinfo".split()
)
PASSAGE = set("p li blockquote pre td th dd dt tr h1 h2 h3 h4 h5 h6 article".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")


class Node:
    __slots__ = ("tag", "label", "chrome", "children", "parent")

    def __init__(self, tag: str, label: str, chrome: bool, parent: Node | None):
        self.tag, self.label, self.chrome, self.parent, self.children = tag, label, chrome, parent, []


def named(tag: str, attrs: str) -> tuple[str, bool]:
    """Label (tag and class words without digits) and whether tag, class, id or role name chrome."""
    if not attrs.strip():
        return tag, tag in CHROME_TAGS
    own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    kind = re.sub(r"\d+", "", own.get("class", "")).lower().split()
    words = re.split(r"[^a-z]+", " ".join(own.get(k, "") for k in ("class", "id", "role")).lower())
    bare = tag in ("html", "body", "article", "main")  # these may have such words of the whole page, like "has-sidebar"
    return ".".join([tag, *sorted(set(kind))]), tag in CHROME_TAGS or not bare and not CHROME_WORDS.isdisjoint(words)


def parse(page: str) -> Node:
    """The tree of a page; texts are str children. Unclosed and stray tags are put right as browsers do, roughly."""
    root = at = Node("", "", False, None)
    opened: dict[str, int] = {}  # tags of the elements from `at` up
    place, end = 0, len(page)

    def close(upto: Node) -> Node:
        """End all open elements up to and with this one."""
        nonlocal at
        while at is not upto:
            opened[at.tag] -= 1
            at = at.parent
        opened[at.tag] -= 1
        return at.parent

    while place < end:
        m = TOKEN.match(page, place)
        if m is None:  # a "<" that opens no whole tag is text
            at.children.append(page[place])
            place += 1
            continue
        place = m.end()
        if m[4] is not None:
            at.children.append(m[4])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                up = at
                while up.tag != tag and (tag not in INLINE or up.tag in INLINE):  # a stray end of an inline element ends no block
                    up = up.parent
                if up.tag == tag:
                    at = close(up)
            continue
        if tag not in INLINE and opened.get("p"):
            up = at  # a block's start ends an open paragraph
            while up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                at = close(up)
        if tag in CLOSED_BY and any(opened.get(t) for t in CLOSED_BY[tag]):
            up, ends = at, SCOPES.get(tag, ())
            while up is not None and up.tag not in ends and up.tag not in CLOSED_BY[tag]:
                up = up.parent
            if up is not None and up.tag in CLOSED_BY[tag]:
                at = close(up)
        label, chrome = named(tag, m[3])
        node = Node(tag, label, chrome, at)
        at.children.append(node)
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, place)
            if tag == "textarea":
                node.children.append(page[place : found.start() if found else end])
            place = found.end() if found else end
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            at = node
            opened[tag] = opened.get(tag, 0) + 1
    return root


class Slot:
    """A node of a folded page or of a wrapper."""

    __slots__ = ("label", "chrome", "children", "number")

    def __init__(self, label: str, chrome: bool):
        self.label, self.chrome, self.children, self.number = label, chrome, [], -1


class Block:
    """A run of text without a break: its slot, whether that is chrome, and whether it begins in a link."""

    __slots__ = ("text", "slot", "chrome", "link")

    def __init__(self, text: str, slot: Slot, chrome: bool, link: bool):
        self.text, self.slot, self.chrome, self.link = text, slot, chrome, link


def folded(page: str) -> tuple[Slot, list[Block]]:
    """The slots of a page, and its blocks in page order. Elements inside a line share the slot of their block."""
    top, found = Slot("", False), []
    held: list[str] = []
    owner: list[tuple[Slot, bool, bool]] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            found.append(Block(text, *owner[0]))
        owner.clear()

    # (node, iterator over its children, slot, chrome, link, in an article, whether its end breaks the line)
    stack = [(iter(parse(page).children), top, False, False, False, False)]
    known: dict[int, dict[str, list[Slot]]] = {}  # slot -> its children by label
    while stack:
        children, slot, chrome, link, article, breaks = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if breaks:
                flush()
        elif isinstance(child, str):
            held.append(child)
            if not owner and not child.isspace():
                owner.append((slot, chrome, link))
        elif child.tag in ("br", "wbr", "img"):
            held.append(" " if child.tag == "br" else "")
        elif child.tag not in NO_TEXT:
            off = chrome or child.chrome and not (article and child.tag == "header")
            linked, inside = link or child.tag == "a", article or child.tag == "article"
            if child.tag in INLINE and off == chrome:
                stack.append((iter(child.children), slot, off, linked, inside, False))
                continue
            flush()
            same = known.setdefault(id(slot), {}).setdefault(child.label, [])
            if same and (child.tag in PASSAGE or "." in child.label or len(same) > RUN):
                own = same[-1]
            else:
                own = Slot(child.label, off)
                same.append(own)
                slot.children.append(own)
            own.chrome &= off
            stack.append((iter(child.children), own, off, linked, inside, True))
        else:
            flush()
    flush()
    return top, found


def align(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the size and the pairs of the largest map between two trees that keeps roots, parents and the order of siblings."""
    if a.label != b.label:
        return 0, []
    order, among = [(a, b)], {}
    for x, y in order:  # grows: a pair of nodes is met only below the pair of their parents
        at: dict[str, list[int]] = {}
        for j, c in enumerate(y.children):
            at.setdefault(c.label, []).append(j)
        own = among[id(x), id(y)] = [(i, j) for i, c in enumerate(x.children) for j in at.get(c.label, ())]
        order += [(x.children[i], y.children[j]) for i, j in own]
    size: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x, y in reversed(order):
        own = among[id(x), id(y)]
        total, chosen[id(x), id(y)] = best(own, [size[id(x.children[i]), id(y.children[j])] for i, j in own])
        size[id(x), id(y)] = total + 1
    pairs = [(a, b)]
    for x, y in pairs:
        pairs += [(x.children[i], y.children[j]) for i, j in chosen[id(x), id(y)]]
    return size[id(a), id(b)], pairs


def best(own: list[tuple[int, int]], weights: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest chain of pairs (i, j) in which both rise, and its weight."""
    if len(own) == len({i for i, _ in own}) and all(p[1] < q[1] for p, q in zip(own, own[1:], strict=False)):
        return sum(weights), own
    rows, columns = sorted({i for i, _ in own}), sorted({j for _, j in own})
    to = {j: c for c, j in enumerate(columns)}
    weight: dict[int, dict[int, int]] = {}
    for (i, j), w in zip(own, weights, strict=True):
        weight.setdefault(i, {})[to[j]] = w
    table = [[0] * (len(columns) + 1)]
    for i in rows:
        above, line = table[-1], [0]
        for c in range(len(columns)):
            w = weight[i].get(c, 0)
            line.append(max(above[c + 1], line[c], above[c] + w if w else 0))
        table.append(line)
    out, r, c = [], len(rows), len(columns)
    while r and c:
        if table[r][c] == table[r - 1][c]:
            r -= 1
        elif table[r][c] == table[r][c - 1]:
            c -= 1
        else:
            r, c = r - 1, c - 1
            out.append((rows[r], columns[c]))
    return table[-1][-1], out[::-1]


def merge(wrapper: Slot, page: Slot) -> None:
    """Put a page's slots into the wrapper along their alignment; what has no partner is inserted in order."""
    for x, y in align(wrapper, page)[1]:
        x.chrome &= y.chrome
        x.number = id(y)  # its partner
    stack = [(wrapper, page)]
    while stack:
        x, y = stack.pop()
        places = {c.number: i for i, c in enumerate(x.children) if c.number != -1}
        out, at = [], 0
        for child in y.children:
            i = places.get(id(child))
            if i is None:
                out.append(child)
            else:
                out += x.children[at : i + 1]
                stack.append((x.children[i], child))
                x.children[i].number, at = -1, i + 1
        x.children = out + x.children[at:]


def numbered(top: Slot) -> list[Slot]:
    """The slots in page order, parents first; each gets its place as number."""
    out, stack = [], [top]
    while stack:
        slot = stack.pop()
        slot.number = len(out)
        out.append(slot)
        stack += reversed(slot.children)
    return out


def induce(pages: list[str]) -> list:
    """The wrapper of pages of one host and layout: [label, parent's number, chrome] of each slot."""
    top = Slot("", False)
    for page in sorted(set(pages)):
        merge(top, folded(page)[0])
    return listed(top)


def listed(top: Slot) -> list:
    """[label, parent's number, chrome] of each slot of a tree."""
    slots = numbered(top)
    up = {c.number: s.number for s in slots for c in s.children}
    return [[s.label, up.get(s.number, -1), s.chrome] for s in slots]


def united(wrappers: list[str]) -> str:
    """The wrapper of wrappers (or of single pages' trees), all as JSON."""
    top = Slot("", False)
    for wrapper in sorted(set(wrappers)):
        other = tree(json.loads(wrapper))
        for slot in numbered(other):
            slot.number = -1
        merge(top, other)
    return json.dumps(listed(top))


def tree(wrapper: list) -> Slot:
    slots = [Slot(label, chrome) for label, _, chrome in wrapper]
    for slot, (_, parent, _) in zip(slots, wrapper, strict=True):
        if parent >= 0:
            slots[parent].children.append(slot)
    return numbered(slots[0])[0] if slots else Slot("", False)


class Aligner:
    """Pages along one wrapper; alignments are kept by the page's skeleton, up to a bound."""

    def __init__(self, wrapper: list):
        self.top, self.known = tree(wrapper), {}

    def read(self, page: str) -> tuple[list[Block], list[int], list[bool]]:
        """The page's blocks, the wrapper slot of each (its own or the nearest ancestor's), and whether it is its own."""
        top, found = folded(page)
        slots = numbered(top)
        up = {c.number: s.number for s in slots for c in s.children}
        shape = "\n".join(f"{up.get(s.number, -1)} {s.label}" for s in slots)
        at = self.known.get(shape)
        if at is None:
            if len(self.known) >= 200:
                self.known.clear()
            own = {y.number: x.number for x, y in align(self.top, top)[1]}
            at = self.known[shape] = [(0, False)] * len(slots)
            for s in slots:
                at[s.number] = (own[s.number], True) if s.number in own else (at[up[s.number]][0], False)
        return found, [at[b.slot.number][0] for b in found], [at[b.slot.number][1] for b in found]


def page_key(found: list[Block]) -> int:
    """What tells differing pages apart: the hash of the longest block."""
    return xxhash.xxh3_64_intdigest(max((b.text for b in found), key=lambda t: (len(t), t), default="")) >> 1


def decide(wrapper: list, counts: dict[int, tuple[int, int, int, int]], priors: bool = True) -> dict:
    """{"template": slots, "roots": slots, "strict": text outside the roots goes}, from counts of each slot over all pages.

    counts: slot -> (texts, constant texts, characters of varying texts outside links, characters outside links); texts count once in
    each differing page.
    """
    n = len(wrapper)
    chrome = [priors and c for _, _, c in wrapper]
    whole = sum(c[3] for s, c in counts.items() if not chrome[s])
    copies = sum(c[3] - c[2] for s, c in counts.items() if not chrome[s]) > COPIES * whole
    constant = lambda c: not copies and c[0] >= DIFFERING and c[1] >= CONSTANT * c[0]
    template = [chrome[s] or s in counts and constant(counts[s]) for s in range(n)]
    mass = [0] * n
    for s, c in counts.items():
        if not template[s]:
            mass[s] += c[3] if copies else c[2]
    for s in range(n - 1, 0, -1):  # children follow their parents
        mass[wrapper[s][1]] += mass[s]
    tag = [label.split(".")[0] for label, _, _ in wrapper]
    inner = [False] * n
    for kind in ("article", "main") if priors else ():
        roots = []
        for s in range(n):
            inner[s] = s > 0 and (inner[wrapper[s][1]] or tag[wrapper[s][1]] == kind)
            if tag[s] == kind and not inner[s] and mass[s] > 0 and not template[s]:
                roots.append(s)
        if roots and 2 * sum(mass[s] for s in roots) >= mass[0]:
            return {"template": [s for s in range(n) if template[s]], "roots": roots, "strict": True}
    depth = [0] * n
    for s in range(1, n):
        depth[s] = depth[wrapper[s][1]] + 1
    whole_roots = [s for s in range(1, n) if mass[s] == mass[0] > 0]
    root = max(whole_roots, key=lambda s: (depth[s], -s), default=None)
    while root is not None and root > 0 and tag[root] in PASSAGE - {"article"}:
        root = wrapper[root][1]
    return {"template": [s for s in range(n) if template[s]], "roots": [] if root is None else [root], "strict": False}


class Reader:
    """Extracts pages along a wrapper and what was decided of its slots; without a wrapper every block of text that no prior names stays."""

    def __init__(self, wrapper: list | None, decided: dict | None, priors: bool = True):
        self.aligner, self.priors = Aligner(wrapper or [["", -1, False]]), priors
        decided = decided or {"template": [], "roots": [], "strict": False}
        self.template, self.strict = set(decided["template"]), decided["strict"]
        roots, self.inside = set(decided["roots"]), set()
        for s, (_, parent, _) in enumerate(wrapper or []):
            if s in roots or parent in self.inside:
                self.inside.add(s)

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        found, slots, _ = self.aligner.read(page)
        rooted = any(s in self.inside for s in slots)
        out = []
        for block, s in zip(found, slots, strict=True):
            outside = rooted and s not in self.inside and (self.strict or block.link)
            if not (self.priors and block.chrome or s in self.template or outside):
                out.append(block.text)
        return "\n\n".join(out)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def layout_of(html):
    return F.when(html.rlike(r"(?i)<article[\s/>]"), "article").when(html.rlike(r"(?i)<main[\s/>]"), "main").otherwise("")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, layout, wrapper json), induced from all pages of each host and layout."""

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for host, layout, page in zip(batch["host"], batch["layout"], batch["html"], strict=True):
                own = json.dumps(listed(folded(page)[0]))
                key = xxhash.xxh3_128_intdigest("\n".join((host, layout, own)).encode("utf-8", "surrogatepass"))
                if key not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(key)
                    out.append((host, layout, own))
            yield pd.DataFrame(out, columns=["host", "layout", "wrapper"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": rows["host"][:1], "layout": rows["layout"][:1], "wrapper": [united(rows["wrapper"].tolist())]})

    schema = "host string, layout string, wrapper string"
    found = mapped(pages.filter("length(html) > 0").select("host", "layout", "html"), trees, schema).distinct()
    parts = found.groupBy("host", "layout", F.pmod(F.xxhash64("wrapper"), F.lit(SHARES)).alias("share")).applyInPandas(run, schema)
    return parts.groupBy("host", "layout").applyInPandas(run, schema)


def slot_texts(joined: DataFrame) -> DataFrame:
    """(host, layout, slot, text, page, chars, linked): hashes of the blocks that stand in a slot of the wrapper, and of their page's key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Aligner] = {}
        for batch in batches:
            out: dict[tuple, tuple] = {}
            for host, layout, page, w in zip(batch["host"], batch["layout"], batch["html"], batch["wrapper"], strict=True):
                if w is None or not page:
                    continue
                found, slots, own = kept(known, w, lambda w: Aligner(json.loads(w))).read(page)
                key = page_key(found)
                for b, s, o in zip(found, slots, own, strict=True):
                    if o:
                        out[host, layout, s, xxhash.xxh3_64_intdigest(b.text) >> 1, key] = (len(b.text), b.link)
            yield pd.DataFrame([(*k, *v) for k, v in out.items()], columns=["host", "layout", "slot", "text", "page", "chars", "linked"])

    return mapped(joined, run, "host string, layout string, slot int, text long, page long, chars int, linked boolean")


def kept(known: dict, key, make):
    """known[key], made if need be; few are kept."""
    if key not in known:
        if len(known) >= 300:
            known.clear()
        known[key] = make(key)
    return known[key]


def slot_counts(joined: DataFrame) -> DataFrame:
    """(host, layout, counts): of each slot, texts, constant texts, characters of varying texts and of all, over all pages."""
    texts = slot_texts(joined).groupBy("host", "layout", "slot", "text", "page").agg(F.max("chars").alias("chars"), F.min("linked").alias("linked"))
    texts = texts.groupBy("host", "layout", "slot", "text").agg(F.count("*").alias("n"), F.max("chars").alias("chars"), F.min("linked").alias("linked"))
    size = F.when(~F.col("linked"), F.col("n") * F.col("chars")).otherwise(0)
    per_slot = texts.groupBy("host", "layout", "slot").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("constant"), F.sum(F.when(F.col("n") == 1, size).otherwise(0)).alias("varying"), F.sum(size).alias("whole")
    )
    return per_slot.groupBy("host", "layout").agg(F.to_json(F.array_sort(F.collect_list(F.array("slot", "n", "constant", "varying", "whole")))).alias("counts"))


def extracted(pages: DataFrame, priors: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every page of pages(page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"), layout_of(F.col("html")).alias("layout"))
    found = stored(wrappers(rows), "induced")
    on = ["host", "layout"]
    counts = slot_counts(rows.select(*on, "html").join(small_side(found, "aligned", "wrapper"), on))
    whole = small_side(found.join(counts, on, "left"), "wrappers", "wrapper")
    joined = rows.join(whole, on, "left").select("page_id", "url", "html", "wrapper", "counts")

    def reader(key: tuple) -> Reader:
        wrapper = json.loads(key[0]) if key[0] else None
        counts = {c[0]: tuple(c[1:]) for c in json.loads(key[1])} if key[1] else {}
        return Reader(wrapper, decide(wrapper, counts, priors) if wrapper else None, priors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, Reader] = {}
        for batch in batches:
            keys = zip(batch["wrapper"], batch["counts"], strict=True)
            text = [kept(known, key, reader).extract(page) for page, key in zip(batch["html"], keys, strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    return mapped(joined, run, "page_id long, url string, text string, n_chars long")
