"""Main text of web pages by site template removal.

A lenient reader turns a page into blocks of text and boxes: elements such as div, ul, nav or
footer, each with the range of blocks it holds and a hash over its tags and text, made once at
its end from the hashes of its children. In addition, blocks go by what an element itself says
it is (navigation, form, advert, comments ...), recurring or not; scripts are no text. Time and
memory grow with the length of the page, however deep or broken its markup.

Spark counts, per host, the different pages on which a box occurs, combining in each task
before the shuffle. Pages with the same blocks are copies and count once, whatever their
page_id. Near copies share their boxes too, without being a template: each box carries
min-hashes over the five-word windows of the page outside of it, and it is template only if
these differ between its pages (``least_difference`` of them at least, averaged over pages and
hash functions). Such boxes go if they are on ``least_pages`` pages, or on every page of a host
that has two or more.

Plain text blocks (p, h1, li ...) never are template by themselves, nor is a box that holds an
article or main. Class and id speak by whole words (``sidebar``, ``share-box``; not
``has-sidebar``), and never for an element that holds an article or main. Character references
are decoded, white space in a block becomes one space, blocks join in page order by one
newline. Nothing is capped.

Null and empty html give an empty text. Rows that repeat are extracted each. A null url
belongs to the host ''. Further columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from navpulse.llm.common import freeze, map_batches

# Element names and words in class, id and role that say what a part of a page is.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math".split())
PARTS = frozenset("head nav footer header aside form dialog menu fieldset".split())
WRAPS = frozenset({"form", "fieldset"})  # some sites put the whole page into one
SILENT = RAW | PARTS - {"header"} | frozenset("button select option object canvas audio video label input".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption address summary".split())
BLOCKS = TEXT_BLOCKS | frozenset(
    "html body article main section div ul ol dl table thead tbody tfoot tr figure hr details hgroup center".split()
) | PARTS
CLOSED_BY = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
}
KEEPS_OPEN = {"li": frozenset({"ul", "ol"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}),
              "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"})}
NAMES = (
    r"(?:ads?|advert[^\W_]*|sponsor[^\W_]*|promo[^\W_]*|banner|cookies?|consent|gdpr|notices?|comments?|disqus|replies|"
    r"sidebar|side-bar|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|share|sharing|social|related|"
    r"recommend[^\W_]*|newsletter|subscribe|subscription|signup|login|popup|modal|toolbar|pager|pagination|widget|skip-link)"
)
#: A whole class or id of such words, and of words for a box after the first.
UNWANTED = re.compile(
    rf"(?:^|\s){NAMES}(?:[_-]+(?:{NAMES}|box|bar|block|body|list|items?|links?|buttons?|area|section|slot|unit|form|text|\d+))*(?:$|\s)",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: A tag always ends, at > or with the page: a quote that has no partner is a character like others.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*\"|'[^']*'|['\"])*+)(?:>|\Z)",
    re.S,
)
ZEROS, LONG_REFERENCE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,}")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
BOXES = BLOCKS - TEXT_BLOCKS - frozenset("html body article main".split())
#: Hash functions of the text around a box, words in a window.
SKETCH, WINDOW = 16, 5
MIXERS = np.array([xxhash.xxh64_intdigest(b"around a box", seed=k) | 1 for k in range(SKETCH)], np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
HOST = r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


#: How an element says that it is no main text: not at all, unless it holds an article, in any case.
NOT, UNLESS, ALWAYS = 0, 1, 2


def named(attributes: str) -> bool:
    """Does the class or id name a part of a page that is no main text?"""
    return any(n.lower() in ("class", "id") and UNWANTED.search("".join(v)) for n, *v in ATTRIBUTE.findall(attributes))


def silent(tag: str, attributes: str, in_article: bool) -> int:
    """Does the element itself say that it is no main text?"""
    if tag in WRAPS or tag == "header" and not in_article:
        return UNLESS
    if tag in SILENT:
        return ALWAYS
    if "=" not in attributes and "hidden" not in attributes.lower():
        return NOT
    if tag in ("html", "body", "article", "main"):
        return NOT
    says = UNLESS if named(attributes) else NOT
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "role" and value.lower() in ROLES:
            says = max(says, UNLESS)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            says = ALWAYS
    return says


class Element:
    __slots__ = ("tag", "says", "hard", "holds", "silent", "doubt", "mute", "digest", "parent", "parts", "lo", "hi")

    def __init__(self, tag: str, says: int, parent: Element | None, at: int):
        self.tag, self.says, self.parent = tag, says, parent
        self.hard = says == ALWAYS or parent is not None and parent.hard
        self.holds = False  # an article or main
        self.silent: Element | None = None  # the outermost silent element around, or itself
        inline = parent is not None and tag not in BLOCKS
        #: Of the elements within the line: does one say ALWAYS, which is the innermost that says UNLESS?
        self.mute = inline and (says == ALWAYS or parent.mute)
        self.doubt: Element | None = None
        if inline:
            self.doubt = self if says == UNLESS else parent.doubt
        self.parts: list[str | Element] = []  # texts and children, in page order
        self.lo = self.hi = at  # range of its blocks

    def drops(self) -> bool:
        """Is text at this place inside a silent element within a line?

        What holds an article makes all around it hold one, so the innermost doubt decides.
        """
        return self.mute or self.doubt is not None and not self.doubt.holds


class Stack:
    """Open elements, with the depths of each tag and of blocks at hand."""

    def __init__(self, root: Element):
        self.open = [root]
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, e: Element) -> None:
        self.depths.setdefault(e.tag, []).append(len(self.open))
        if e.tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(e)

    def nearest(self, *tags: str) -> int:
        """Depth of the innermost open element of these tags, 0 if there is none."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def cut(self, depth: int, at: int) -> None:
        """End all elements from ``depth`` on; ``at`` blocks are complete."""
        while len(self.open) > depth:
            e = self.open.pop()
            e.hi = at
            self.depths[e.tag].pop()
            if e.tag in BLOCKS:
                self.blocks.pop()


class Box(NamedTuple):
    """An element subtree: hash, range of blocks, whether it may hold text that is not silent, hashes of the rest."""

    tree: int
    lo: int
    hi: int
    loud: bool
    rest: list[int]


class Page(NamedTuple):
    texts: list[str]
    quiet: list[bool]  # of each text: does it lie in a silent element?
    boxes: list[Box]


def decoded(text: str) -> str:
    """Character references resolved; numbers of any length are read."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = LONG_REFERENCE.sub("&#9999999", ZEROS.sub("&#", text))
    return html.unescape(text)


def elements_of(page: str) -> tuple[list[Element], list[tuple[str, Element]]]:
    """All elements, parents before children, and the blocks of text with the elements they stand in."""
    root = Element("", NOT, None, 0)
    stack, elements, run = Stack(root), [root], []
    blocks: list[tuple[str, Element]] = []

    def flush() -> None:
        if run:
            text = " ".join(decoded("".join(run)).split())
            run.clear()
            if text:
                top = stack.open[-1]
                blocks.append((text, top))
                top.parts.append(text)

    position, n = 0, len(page)
    while position < n:
        m = TAG.search(page, position)
        stop = n if m is None else m.start()
        if stop > position and not stack.open[-1].drops():
            run.append(page[position:stop])
        if m is None:
            break
        position = m.end()
        closing, tag, attributes = m[1], m[2], m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            depth = stack.nearest(tag)
            if depth:
                if stack.blocks and stack.blocks[-1] >= depth:
                    flush()
                stack.cut(depth, len(blocks))
            continue
        if tag in BLOCKS:
            flush()
            # A block ends an open paragraph, an item the one before it.
            k = stack.blocks[-1] if stack.blocks else 0
            if k and stack.open[k].tag == "p":
                stack.cut(k, len(blocks))
            if tag in CLOSED_BY:
                k = stack.nearest(*CLOSED_BY[tag])
                if k > stack.nearest(*KEEPS_OPEN.get(tag, ())):
                    stack.cut(k, len(blocks))
        elif tag == "br":
            run.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:  # no markup inside
            found = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, position)
            position = found.end() if found else n
            continue
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        top = stack.open[-1]
        # An article that is a comment or advert by its own words says nothing of what is around.
        if not top.hard and (tag == "main" or tag == "article" and not named(attributes)):
            e = top
            while e is not None and not e.holds:
                e.holds, e = True, e.parent
        in_article = bool(stack.nearest("article", "main"))
        e = Element(tag, silent(tag, attributes, in_article), top, len(blocks))
        top.parts.append(e)
        stack.push(e)
        elements.append(e)
    flush()
    stack.cut(1, len(blocks))
    return elements, blocks


def around(texts: list[str], boxes: list[tuple[int, int]]) -> np.ndarray:
    """For each range of ``texts``, the least hashes of the word windows outside of it: (ranges, SKETCH)."""
    n = len(texts)
    least = np.full((n, SKETCH), np.iinfo(np.uint64).max, np.uint64)
    if n:
        known: dict[str, int] = {}
        words = [text.split() for text in texts]
        sizes = np.array([len(w) for w in words])
        # Windows start at each word and end with the block: zeros stand between blocks.
        starts = np.concatenate([[0], np.cumsum(sizes + WINDOW - 1)])
        laid = np.zeros(int(starts[-1]) + WINDOW, np.uint64)
        held = np.zeros(len(laid), bool)
        for block, start in zip(words, starts):
            for w in block:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w) | 1
            laid[start : start + len(block)] = [known[w] for w in block]
            held[start : start + len(block)] = True
        windows = np.zeros(len(laid) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            windows = windows * STEP + laid[k : k + len(windows)]
        windows ^= windows >> np.uint64(31)
        held = held[: len(windows)]
        for j, mixer in enumerate(MIXERS):
            mixed = windows * mixer
            mixed = (mixed ^ (mixed >> np.uint64(29))) * STEP
            mixed[~held] = np.iinfo(np.uint64).max
            least[:, j] = np.minimum.reduceat(mixed, starts[:-1])
    end = np.full((1, SKETCH), np.iinfo(np.uint64).max, np.uint64)
    before = np.concatenate([end, np.minimum.accumulate(least, axis=0)])
    after = np.concatenate([np.minimum.accumulate(least[::-1], axis=0)[::-1], end])
    ranges = np.array(boxes, np.int64).reshape(-1, 2)
    return np.minimum(before[ranges[:, 0]], after[ranges[:, 1]])


def parsed(page: str, lists: bool = True) -> Page:
    """Blocks of a page and its boxes; without ``lists``, nothing is silent."""
    elements, blocks = elements_of(page)
    for e in elements[1:]:
        says = lists and (e.says == ALWAYS or e.says == UNLESS and not e.holds)
        e.silent = e.parent.silent or (e if says else None)
    # From children to parents. What is silent is part of its own subtrees, not of those around it.
    for e in reversed(elements):
        whole = xxhash.xxh64(e.tag)
        for part in e.parts:
            if isinstance(part, str):
                whole.update("\n" + part)
            elif part.silent is not part:
                whole.update(part.digest)
        e.digest = whole.digest()
    quiet = [e.silent is not None for _, e in blocks]
    own = np.concatenate([[0], np.cumsum(~np.array(quiet, bool))]).astype(int)
    found = [e for e in elements if e.tag in BOXES and not e.holds and e.hi > e.lo]
    loud = [text for (text, _), q in zip(blocks, quiet) if not q]
    rests = around(loud, [(int(own[e.lo]), int(own[e.hi])) for e in found]) >> np.uint64(33)
    boxes = [
        Box(int.from_bytes(e.digest, "big", signed=True), e.lo, e.hi, bool(own[e.hi] > own[e.lo]), rest)
        for e, rest in zip(found, rests.astype(np.int64).tolist())
    ]
    return Page([text for text, _ in blocks], quiet, boxes)


def read(page: str) -> list[str]:
    """Blocks of a page that are not silent."""
    made = parsed(page)
    return [text for text, quiet in zip(made.texts, made.quiet) if not quiet]


BOX = "tree:bigint,lo:int,hi:int,loud:boolean," + ",".join(f"rest{j}:int" for j in range(SKETCH))
BOX_ARROW = pa.struct(
    [("tree", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("loud", pa.bool_())]
    + [(f"rest{j}", pa.int32()) for j in range(SKETCH)]
)


def block_rows(pages: DataFrame, lists: bool = True) -> DataFrame:
    """page_id, url, host, blocks (null: silent) and boxes of every page, and a hash of its texts, equal for copies."""
    source = pages.select(
        F.col("page_id"),
        F.col("url").cast("string").alias("url"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, boxes, contents = [], [], []
        for page in batch.column("html"):
            made = parsed(page.as_py(), lists)
            texts.append([None if quiet else text for text, quiet in zip(made.texts, made.quiet)])
            boxes.append([(*box[:4], *box.rest) for box in made.boxes])
            whole = xxhash.xxh64("\n".join(text for text in texts[-1] if text is not None))
            contents.append(whole.intdigest() - (1 << 63))
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(texts, pa.list_(pa.string())),
             pa.array(boxes, pa.list_(BOX_ARROW)), pa.array(contents, pa.int64())],
            ["page_id", "url", "host", "blocks", "boxes", "content"],
        )

    kind = source.schema["page_id"].dataType.simpleString()
    made = f"page_id {kind}, url string, host string, blocks array<string>, boxes array<struct<{BOX}>>, content long"
    return map_batches(source, run, made)


def template_boxes(read_pages: DataFrame, least_pages: int, least_difference: float) -> DataFrame:
    """site, tree of the boxes that are template of their host."""
    box = F.explode("boxes").alias("box")
    rests = [F.max(f"box.rest{j}").alias(f"rest{j}") for j in range(SKETCH)]
    one_each = read_pages.select("site", "content", box).groupBy("site", "box.tree", "content").agg(*rests)
    kinds = one_each.select("site", "tree", F.posexplode(F.array(*[f"rest{j}" for j in range(SKETCH)])).alias("j", "rest"))
    kinds = kinds.groupBy("site", "tree", "j", "rest").agg(F.count("*").alias("pages"))
    seen = kinds.groupBy("site", "tree").agg(
        F.count("*").alias("kinds"), (F.sum("pages") / SKETCH).cast("long").alias("pages")
    )
    differ = F.col("kinds") - SKETCH >= least_difference * SKETCH * (F.col("pages") - 1)
    seen = seen.where((F.col("pages") >= 2) & differ)
    # Boxes of a large host are dealt out by their hash, those of a small one meet its number of pages.
    parts = 16
    small = read_pages.select("site", "content").distinct().groupBy("site").agg(F.count("*").alias("of_site"))
    small = small.where(F.col("of_site") < least_pages)
    small = small.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    seen = seen.withColumn("part", F.pmod("tree", F.lit(parts)).cast("int")).join(small, ["site", "part"], "left")
    often = (F.col("pages") >= least_pages) | F.coalesce(F.col("pages") == F.col("of_site"), F.lit(False))
    return seen.where(often).select("site", "tree")


def cut(df: DataFrame) -> DataFrame:
    """page_id, url and text of pages: their ``blocks`` outside the ranges ``gone``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for blocks, gone in zip(batch.column("blocks").to_pylist(), batch.column("gone").to_pylist()):
            if gone:
                deep = np.zeros(len(blocks) + 1, np.int64)
                np.add.at(deep, [g["lo"] for g in gone], 1)
                np.add.at(deep, [g["hi"] for g in gone], -1)
                blocks = [b for b, d in zip(blocks, np.cumsum(deep)) if not d]
            texts.append("\n".join(b for b in blocks if b is not None))
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])

    kind = df.schema["page_id"].dataType.simpleString()
    return map_batches(df.select("page_id", "url", "blocks", "gone"), run, f"page_id {kind}, url string, text string")


def main_text(
    pages: DataFrame, least_pages: int = 4, lists: bool = True, least_difference: float = 0.3
) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A box is template if what is around it differs between its pages and it is on at least
    ``least_pages`` different pages of its host, or on all of a host of two or more. Without
    ``lists``, recurrence alone deletes.
    """
    rows = block_rows(pages, lists).withColumn("row", F.monotonically_increasing_id())
    read_pages = freeze(rows.withColumn("site", F.xxhash64("host")).drop("host"))
    # Both tables written first: the join is a broadcast or a split one by their sizes, also for a box on all pages.
    template = freeze(template_boxes(read_pages, least_pages, least_difference))
    # Boxes without text that is not silent have nothing to delete; pages of no others need not move.
    loud = F.filter("boxes", lambda b: b["loud"])
    boxes = read_pages.select("row", "site", F.explode(loud).alias("box"))
    boxes = boxes.select("row", "site", "box.tree", F.struct("box.lo", "box.hi").alias("range"))
    gone = boxes.join(template, ["site", "tree"]).groupBy(F.col("row").alias("of_row")).agg(F.collect_list("range").alias("gone"))
    texts = read_pages.select("page_id", "url", "row", "blocks", (F.size(loud) > 0).alias("could"))
    whole = texts.where("NOT could").select("page_id", "url", F.array_join("blocks", "\n").alias("text"))
    some = texts.where("could")
    some = cut(some.join(gone, some["row"] == gone["of_row"], "left"))
    return whole.unionByName(some).withColumn("n_chars", F.length("text").cast("long"))
