"""Main text of web pages by site style trees.

The DOMs of one host are merged: nodes of equal path (tags with their classes, from the body down)
are one node of the host's style tree. For a node, the distribution of its presentations (the
sequence of its children's labels) and of its contents (digests of its text blocks) over the pages
gives its importance: a content that is spread over all pages has entropy near 1 and tells
nothing, one of a single page has 0. A branch's importance joins both over the branch; branches
of low importance on enough pages are noise of that host and are removed from each page, those within
articles too. The tree sees all text, that of menus, footers and adverts included, each of which is rated as a
branch of its own, so that it takes nothing from the branches that hold it.

What the tree can't know, as it differs from page to page or as the host has few pages, the author's marks
tell: menus, footers, forms, adverts, comments and the like by tag, class or role go, and on a page with an
article (or main) only text inside it stays; an article itself and what holds it are content by declaration. A
mark that holds the article takes nothing from it: html and body bear no mark, class words count as whole tokens,
and a form that holds the page's structure is a wrapper. Of articles, those in the fewest marks are the page's.

A node's name is a hash of its parent's name and its label, so a page takes memory in proportion to its
length however deep it nests. Sums over branches are made by doubling: in round k a node adds what those 2^k
levels below it hold, so there are as many rounds as the depth has bits.

Copies tell nothing about a site, so statistics count distinct pages: those of a host that differ in some
unmarked block or presentation. Pages leave the tasks as digests of these, meet by the digest of all of them, and
distinct ones are counted and summed by key, so a host of any share of the pages is no group anywhere.
Branches that leave a page without any text are not removed from it. Defined cases: null or empty html gives the empty text; pages without url form
one host; rows of equal page_id are extracted one by one; broken markup is read as browsers do
(unclosed elements end with their parent, a cut tag at the end is no text); an empty table gives no
row.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.operators.spread import spread

from ._base import drop_stash, picked, slices, stash

# Elements by the part they play in a page.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
NOISE_TAGS = frozenset("aside button canvas dialog footer form head menu nav noscript object select svg template".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer login menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related respond share sharing sidebar social sponsor sponsored subscribe toolbar".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CONTENT = frozenset("article main".split())
#: A form that holds one of these wraps the page.
STRUCTURE = CONTENT | frozenset("footer h1 header nav".split())
#: Tags whose author says that nothing in them is the page's own text, even if they hold an article: their
#: mark weighs more than any number of others, as do invisible elements.
HARD, WEIGHT = frozenset("aside button canvas dialog footer head menu nav noscript object select svg template".split()), 1 << 20
#: An open element of a kind that ends where one of these begins.
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: Branches below this importance, on so many distinct pages of a host at least, are noise.
LEAST_IMPORTANCE, LEAST_PAGES = 0.3, 4
#: Weight of a node's own presentation against its contents.
DAMPING = 0.9
#: Bytes of noise nodes that are broadcast at most; beyond it pages meet those of their host by salted host.
BROADCAST_BYTES, SALTS = 32 << 20, 32


ROOT = 0


def child(node: int, label: str) -> int:
    """The name of a node: 63 bits, never ROOT."""
    return (xxhash.xxh3_64_intdigest(label, seed=node) >> 1) or 1


class Block(NamedTuple):
    node: int
    text: str
    #: The weight of the marks around it, not counting those around its article.
    marks: int
    #: The weight of the marks around its article, -1 outside of articles.
    article: int
    forms: tuple[int, ...]


class Element(NamedTuple):
    name: str
    node: int
    marks: int
    article: int
    forms: tuple[int, ...]


class Page:
    """Blocks of text with their nodes, the nodes' parents, and their presentations."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.children: dict[int, list[str]] = {}
        self.parent: dict[int, int] = {}
        self.roots: set[int] = set()  # the nodes of outermost articles
        self.marked: set[int] = set()  # the nodes of marked elements and those in them
        self._text: list[str] = []
        self._open = [Element("", ROOT, 0, -1, ())]
        self._names: Counter[str] = Counter()
        self._forms = 0
        self._wrappers: set[int] = set()
        self._read(source)
        self._flush()
        if self._forms > len(self._wrappers):
            plain = {b.article for b in self.blocks if not b.marks and self._wrappers.issuperset(b.forms)}
            # a form that holds all there is, of the article or the page, is a wrapper too
            self.blocks = [b._replace(marks=b.marks + (b.article in plain and not self._wrappers.issuperset(b.forms))) for b in self.blocks]

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                _, node, marks, article, forms = self._open[-1]
                self.blocks.append(Block(node, text, marks, article, forms))
            self._text = []

    def _say(self, raw: str) -> None:
        if raw:
            self._text.append(entities.unescape(raw) if "&" in raw else raw)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        match = TOKEN.search(source)
        while match:
            self._say(source[at : match.start()])
            at = match.end()
            name = (match[2] or match[5] or "").lower()
            if name:
                if match[1] or match[4]:
                    self._close(name)
                else:
                    self._begin(name, match[3] or match[6] or "")
                    if name in RAW:
                        stop = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(source, at)
                        at = stop.end() if stop else end
            match = TOKEN.search(source, at)
        self._say(source[at:])

    def _begin(self, name: str, rest: str) -> None:
        if name in RAW:
            return
        label, noise = name, (WEIGHT if name in HARD else 1) if name in NOISE_TAGS else 0
        if rest.strip(" /"):
            found = {k.lower(): (v or "").strip("\"'").lower() for k, v in ATTRIBUTE.findall(rest)}
            if kinds := found.get("class"):
                label += "." + ".".join(sorted(kinds.split()))
            if not NOISE_WORDS.isdisjoint([*(kinds or "").split(), found.get("id", "").strip()]) or found.get("role") in NOISE_ROLES:
                noise = noise or 1
            if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
                noise = WEIGHT
        if name in VOID:
            if name in ("br", "hr"):
                self._flush()
            return
        if name in INLINE and not noise:
            return
        self._flush()
        while self._open[-1].name and name in CLOSED_BY.get(self._open[-1].name, ()):
            self._names[self._open.pop().name] -= 1
        _, above, marks, article, forms = self._open[-1]
        outermost = False
        if name in STRUCTURE and forms:
            self._wrappers.update(forms)
        if name in CONTENT:
            noise = 0
            if article < 0:  # the page's content begins: what is around it marks it no more
                marks, article, forms = 0, marks, ()
                outermost = True
        elif name in ("html", "body"):
            noise = 0
        elif name == "header" and article < 0:
            noise = noise or 1
        elif name == "form" and noise == 1:
            noise, forms, self._forms = 0, (*forms, self._forms), self._forms + 1
        if noise:
            label += "!"
        self.children.setdefault(above, []).append(label)
        node = above
        if name not in ("html", "body"):
            node = child(above, label)
            self.parent[node] = above
            if outermost:
                self.roots.add(node)
            if marks or noise:
                self.marked.add(node)
        self._names[name] += 1
        self._open.append(Element(name, node, marks + noise, article, forms))

    def _close(self, name: str) -> None:
        if name == "br":
            self._flush()
        if not self._names[name]:
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k].name == name:
                self._flush()
                self._names.subtract(e.name for e in self._open[k:])
                del self._open[k:]
                return
            if self._open[k].name in CONTENT and name in ("div", "p", "li", "section", "ul", "ol", "table"):
                return  # a stray end tag doesn't close what holds the article

    def removed(self, noise: frozenset[int], inside: bool) -> set[int]:
        """The nodes in branches of noise; with inside, in those below an article or main."""
        out: set[int] = set()
        below: set[int] = set(self.roots)
        for node, above in self.parent.items():  # parents come first
            if inside and above in below:
                below.add(node)
            if above in out or node in noise:
                if not inside or node in below and node not in self.roots:
                    out.add(node)
        return out

    def text(self, noise: frozenset[int] = frozenset()) -> str:
        seen = [b for b in self.blocks if not b.marks]
        levels = {b.article for b in seen}
        level = min((x for x in levels if x >= 0), default=-1)
        if level >= WEIGHT and -1 in levels:
            level = -1  # an article in a menu, an aside or out of sight isn't the page's while other text is
        own = [b for b in seen if b.article == level]
        gone = self.removed(noise, level >= 0) if noise else ()
        return "\n".join(b.text for b in [b for b in own if b.node not in gone] or own)


FEATURES = "page binary, host string, nodes array<long>, kinds array<int>, digests array<long>"
COUNTS = "host string, node long, kind int, digest long, pages long"
#: What is counted of a node: that it is there (with its parent for a digest), its contents, its presentations.
PRESENCE, CONTENTS, PRESENTATION = range(3)


def features_of(page: Page) -> set[tuple[int, int, int]]:
    """(node, kind, digest) of all that is counted of a page. A marked branch is rated by itself and tells nothing of what holds it."""
    found = {(b.node, CONTENTS, xxhash.xxh3_64_intdigest(b.text) >> 1) for b in page.blocks if not b.marks or b.node in page.marked}
    found |= {(node, PRESENTATION, xxhash.xxh3_64_intdigest(" ".join(a for a, b in pairwise([*labels, ""]) if a != b)) >> 1) for node, labels in page.children.items()}
    return found | {(ROOT, PRESENCE, ROOT)} | {(node, PRESENCE, ROOT if node in page.marked and above not in page.marked else above) for node, above in page.parent.items()}


def _features(most: int = 200_000):
    """Of each page its host, what is counted of it and a digest of both; copies within a task go at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, 128):
            rows: list[tuple] = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(source)
                features = sorted(features_of(page))
                digest = xxhash.xxh3_128_digest(repr((host, [f for f in features if f[0] not in page.marked])))
                if digest not in seen:
                    seen.add(digest)
                    rows.append((digest, host, *map(list, zip(*features))))
            if rows:
                kinds = (pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=[x.split()[0] for x in FEATURES.split(", ")])
            if len(seen) > most:
                seen.clear()

    return run


def _count(most: int = 200_000):
    """Counts of distinct pages; equal ones come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        last = None

        def flush() -> pa.RecordBatch:
            rows = list(zip(*((*key, n) for key, n in held.items())))
            held.clear()
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(rows, kinds)], names=[x.split()[0] for x in COUNTS.split(", ")])

        for batch in slices(batches, 128):
            for digest, host, *features in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if digest != last:
                    held.update((host, *feature) for feature in zip(*features))
                last = digest
            if len(held) > most:
                yield flush()
        if held:
            yield flush()

    return run


def importance(pages: DataFrame) -> DataFrame:
    """(host, node, m, importance) of each branch of the hosts' trees; m: on how many distinct pages. `pages` has host and html."""
    distinct = pages.mapInArrow(_features(), FEATURES).repartition("page").sortWithinPartitions("page")
    counts = distinct.mapInArrow(_count(), COUNTS).groupBy("host", "node", "kind", "digest").agg(F.sum("pages").alias("n"))
    kind = lambda k, value: F.when(F.col("kind") == k, value)
    sums = counts.groupBy("host", "node").agg(
        F.sum(kind(PRESENCE, F.col("n"))).alias("m"),
        F.max(kind(PRESENCE, F.col("digest"))).alias("parent"),
        F.sum(kind(CONTENTS, 1)).alias("features"),
        F.sum(kind(CONTENTS, F.log("n"))).alias("spread"),
        F.sum(kind(PRESENTATION, F.col("n") * F.log("n"))).alias("styled"),
        F.sum(kind(PRESENTATION, F.col("n"))).alias("shown"),
    )
    scale = F.log("m")
    looks = F.when((F.col("shown") > 1) & (F.col("m") > 1), (F.log("shown") - F.col("styled") / F.col("shown")) / scale)
    own = stash(sums.select(
        "host", "node", "m", F.when(F.col("node") != ROOT, F.col("parent")).alias("up"), F.coalesce("features", F.lit(0)).alias("features"),
        F.coalesce(F.when(F.col("m") > 1, F.col("spread") / scale), F.lit(0.0)).alias("entropy"), F.least(F.coalesce(looks, F.lit(0.0)), F.lit(1.0)).alias("looks"),
    ), "tree")
    # contents count for every branch that holds them: sums over 2^k levels, then over twice as many
    reach = own
    while not reach.where("up is not null").isEmpty():
        from_below = reach.where("up is not null").groupBy("host", F.col("up").alias("node")).agg(F.sum("features").alias("f"), F.sum("entropy").alias("e"))
        above = reach.select("host", F.col("node").alias("up"), F.col("up").alias("next"))
        joined = reach.join(from_below, ["host", "node"], "left").join(above, ["host", "up"], "left")
        older, reach = reach, stash(joined.select("host", "node", "m", F.col("next").alias("up"), (F.col("features") + F.coalesce("f", F.lit(0))).alias("features"), (F.col("entropy") + F.coalesce("e", F.lit(0.0))).alias("entropy"), "looks"), "tree")
        drop_stash(older)
    content = F.lit(1.0) - F.when(F.col("features") > 0, F.col("entropy") / F.col("features")).otherwise(1.0)
    return reach.select("host", "node", "m", (DAMPING * content + (1 - DAMPING) * F.col("looks")).alias("importance"))


def noise_branches(pages: DataFrame) -> DataFrame:
    """(host, node): branches of low importance. `pages` has host and html."""
    low = (F.col("importance") < LEAST_IMPORTANCE) & (F.col("m") >= LEAST_PAGES) & (F.col("node") != ROOT)
    return importance(pages).where(low).select("host", "node")


def _texts(batch: pa.RecordBatch, noise: list[frozenset[int]]) -> pa.RecordBatch:
    """Of page_id, url, html the texts."""
    texts = [Page(h).text(n) for h, n in zip(batch.column(2).to_pylist(), noise)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _extract(known):
    """Rows (page_id, url, html, host) with the broadcast noise of every host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            yield _texts(batch, [known.value.get(host, frozenset()) for host in batch.column(3).to_pylist()])

    return run


def _extract_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, host, node) by host, those with a node of noise before the pages of each salt."""
    last, nodes, noise = None, set(), frozenset()
    for batch in slices(batches, 128):
        pages, held = [], []
        for k, (host, node) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
            if host != last:
                last, nodes, noise = host, set(), frozenset()
            if node is not None:
                nodes.add(node)
                continue
            if len(noise) < len(nodes):
                noise = frozenset(nodes)
            pages.append(k)
            held.append(noise)
        if pages:
            yield _texts(batch.take(pa.array(pages)), held)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = picked(pages, "page_id", "url", "html")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    noise = stash(noise_branches(rows.select("host", "html")), "noise")
    size = noise.agg(F.sum(F.length("host") + 100).alias("n")).first().n or 0
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string"
    if size <= BROADCAST_BYTES:
        known: dict[str, set[int]] = {}
        for name, node in noise.collect():
            known.setdefault(name, set()).add(node)
        held = pages.sparkSession.sparkContext.broadcast({name: frozenset(nodes) for name, nodes in known.items()})
        found = rows.mapInArrow(_extract(held), schema)
    else:
        salted = rows.withColumns({"node": F.lit(None).cast("long"), "salt": F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")})
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("page_id", kind), ("url", "string"), ("html", "string"))]
        marks = noise.select(*nothing, "host", "node", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        ordered = salted.unionByName(marks).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("node").isNull())
        found = ordered.select("page_id", "url", "html", "host", "node").mapInArrow(_extract_sorted, schema)
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))
