"""Main text of web pages by wrappers inferred for each host.

A page is read as a stream of structural tags and text slots; inline tags are
part of the text. The streams of a host's pages are aligned one after another
into a wrapper, a regular expression without unions: where two streams differ
in a tag, the part that only one has becomes optional; neighbours of the same
tag are aligned with each other and become a repeated group; texts become
slots. Aligning is by the longest common run of tags at each level, so the
order of pages matters little and wrappers of parts of a host can be aligned
in turn.

Texts that meet in a slot are compared as well: one that stands there on most
of a host's different pages is a constant of the wrapper, not what a page has to
say, whatever its tags are called. Constants are counted per host, slot and text
over all pages; of pages that are the same in all their texts one counts.

The slots of the wrapper are labelled by the tags and classes on the way to
them, and where no article is marked on a host, by the container that holds
most text outside of links on its pages. A page's text is what its blocks put
into the slots labelled as main, but for constants.
"""

from __future__ import annotations

import html as references
import json
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.base import partitions, stored, table, texts
from gaugeworks.llm.urlfilter import host

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe svg".split())
#: Tags whose start ends an open one of these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BORDERS = frozenset("ul ol dl table body article section div main select".split())
DROPPED_TAGS = frozenset("head title nav footer aside form button select dialog menu object canvas audio video".split()) | RAW
OUTER_ONLY = frozenset("header banner".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu topbar footer sidebar "
    "aside complementary contentinfo cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall "
    "comment comments commentlist reply replies respond discussion disqus share sharing social breadcrumb breadcrumbs related recommended widget login "
    "signup search pagination pager toolbar skip".split()
)
MAIN_TAGS = frozenset("article main".split())
#: Of the dropped names those that also drop an article inside of them; others may name a page's whole layout.
REACTIONS = frozenset("comment comments commentlist reply replies respond discussion disqus related recommended widget".split())
#: Tags on a recorded path; deeper ones are followed, but recorded only where they change the label.
DEPTH = 60
#: A text is a constant of its slot on more than this share of a host's different pages, of which there are so many at least.
CONSTANT_SHARE, CONSTANT_PAGES = 0.5, 5
#: Most characters of all wrappers together that are sent to every task.
SENT_CHARS = 32_000_000

_TAG = re.compile(r"<(?:!--|/?[a-zA-Z][^\s/>]*|[!?])")
_ATTRIBUTE = re.compile(r"""\s(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_QUOTED = re.compile(r"""[^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*)*>""")
_DIGITS = re.compile(r"[0-9]+")
_NAMES = re.compile(r"[a-z]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', raw, ''), ('open', tag, attributes) and ('close', tag, '') in page order.

    Comments, declarations and the content of scripts and the like are left out,
    and so is a tag that the page's end cuts off.
    """
    at, size = 0, len(page)
    while at < size:
        found = _TAG.search(page, at)
        if not found:
            yield "text", page[at:], ""
            return
        if found.start() > at:
            yield "text", page[at : found.start()], ""
        mark = found[0]
        if mark == "<!--":
            stop = page.find("-->", found.start() + 2)
            at = size if stop < 0 else stop + 3
            continue
        if mark in ("<!", "<?"):
            stop = page.find(">", found.end())
            at = size if stop < 0 else stop + 1
            continue
        ended = _QUOTED.match(page, found.end())
        stop = ended.end() if ended else page.find(">", found.end()) + 1
        if stop <= 0:
            return
        at = stop
        if mark[1] == "/":
            yield "close", mark[2:].lower(), ""
            continue
        tag, attributes = mark[1:].lower(), page[found.end() : stop - 1]
        if tag in RAW and not attributes.endswith("/"):
            closing = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = closing.end() if closing else size
            continue
        yield "open", tag, attributes


def signature(tag: str, attributes: str) -> str:
    """The tag with the words of its class, id and role; digits don't count."""
    words: set[str] = set()
    for m in _ATTRIBUTE.finditer(" " + attributes):
        words.update(_DIGITS.sub("0", (m[2] or m[3] or m[4] or "").lower()).split())
    return ".".join([tag, *sorted(w.replace("/", "-") for w in words)])


class _Open:
    """The open tags. Looking one up takes no longer on a deeply nested page."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.path: list[str] = []
        #: Positions and signatures of tags beyond DEPTH that change the label of what is in them.
        self.deep: list[tuple[int, str]] = []

    def last(self, *names: str) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def first_after(self, position: int, names: set[str]) -> int | None:
        found = [at[k] for n in names if (at := self.at.get(n)) and (k := bisect_right(at, position)) < len(at)]
        return min(found, default=None)

    def push(self, tag: str, attributes: str) -> None:
        if len(self.tags) < DEPTH:
            self.path.append(signature(tag, attributes))
        elif telling(name := signature(tag, attributes)):
            if label((*(here := self.recorded()), name)) != label(here):
                self.deep.append((len(self.tags), name))
        self.at[tag].append(len(self.tags))
        self.tags.append(tag)

    def cut(self, count: int) -> None:
        for tag in self.tags[count:]:
            self.at[tag].pop()
        del self.tags[count:], self.path[count:]
        while self.deep and self.deep[-1][0] >= count:
            self.deep.pop()

    def recorded(self) -> tuple[str, ...]:
        return (*self.path, *(name for _, name in self.deep))


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters in links) of every block with text, in page order; paths are of signatures."""
    found: list[tuple[tuple[str, ...], str, int]] = []
    opened = _Open()
    held: list[str] = []
    state = {"links": 0, "anchor": 0}

    def flush() -> None:
        text = " ".join(references.unescape("".join(held)).split())
        if text:
            found.append((opened.recorded(), text, state["links"]))
        held.clear()
        state["links"] = 0

    def pop(count: int) -> None:
        flush()
        opened.cut(count)

    for kind, name, attributes in tokens(page or ""):
        if kind == "text":
            held.append(name)
            state["links"] += len(name) * bool(state["anchor"])
        elif name in INLINE:
            if name == "a":
                state["anchor"] = int(kind == "open")
            elif name == "br":
                held.append(" ")
        elif kind == "open":
            flush()
            state["anchor"] = 0
            if name not in VOID and (last := opened.last("p")) >= 0 and opened.last(*BORDERS) < last:
                pop(last)
            if name in CLOSES and (first := opened.first_after(opened.last(*BORDERS), CLOSES[name])) is not None:
                pop(first)
            if name not in VOID:
                opened.push(name, attributes)
        else:
            flush()
            state["anchor"] = 0
            if (last := opened.last(name)) >= 0:
                pop(last)
    flush()
    return found


# A wrapper is a list of nodes [signature, repeats, has text, wrapper of the children]; repeats is one of "", "?", "+", "*".


def stream(found: list[tuple[tuple[str, ...], str, int]]) -> list:
    """The wrapper of a single page: its blocks' paths as a tree, neighbours of the same signature folded."""
    root: list = []
    for path, _, _ in found:
        level = root
        for depth, name in enumerate(path):
            if not level or level[-1][0] != name:
                level.append([name, "", False, []])
            elif depth == len(path) - 1 and level[-1][2]:
                level[-1][1] = "+"
            if depth == len(path) - 1:
                level[-1][2] = True
            level = level[-1][3]
    return folded(root)


def repeated(one: str, other: str) -> str:
    many, maybe = {"+", "*"} & {one, other}, {"?", "*"} & {one, other}
    return "*" if many and maybe else "+" if many else "?" if maybe else ""


def joined(one: list, other: list) -> list:
    return [one[0], repeated(one[1], other[1]), one[2] or other[2], aligned(one[3], other[3])]


def folded(nodes: list) -> list:
    """Neighbours of the same signature aligned with each other into one repeated group."""
    out: list = []
    for node in nodes:
        node = [node[0], node[1], node[2], folded(node[3])]
        if out and out[-1][0] == node[0]:
            out[-1] = joined(out[-1], node)
            out[-1][1] = "*" if out[-1][1] in "?*" and out[-1][1] else "+"
        else:
            out.append(node)
    return out


def aligned(one: list, other: list) -> list:
    """Two wrappers as one: nodes on the longest common run of signatures are joined, all others become optional."""
    if not one or not other:
        return [[n[0], repeated(n[1], "?"), n[2], n[3]] for n in one or other]
    length = [[0] * (len(other) + 1) for _ in range(len(one) + 1)]
    for a in range(len(one) - 1, -1, -1):
        for b in range(len(other) - 1, -1, -1):
            same = one[a][0] == other[b][0]
            length[a][b] = length[a + 1][b + 1] + 1 if same else max(length[a + 1][b], length[a][b + 1])
    out, a, b = [], 0, 0
    while a < len(one) or b < len(other):
        if a < len(one) and b < len(other) and one[a][0] == other[b][0]:
            out.append(joined(one[a], other[b]))
            a, b = a + 1, b + 1
        elif b == len(other) or a < len(one) and length[a + 1][b] >= length[a][b + 1]:
            out.append([one[a][0], repeated(one[a][1], "?"), *one[a][2:]])
            a += 1
        else:
            out.append([other[b][0], repeated(other[b][1], "?"), *other[b][2:]])
            b += 1
    merged: list = []
    for node in out:
        if merged and merged[-1][0] == node[0]:
            merged[-1] = joined(merged[-1], node)
            merged[-1][1] = "*" if "?" in merged[-1][1] or "*" in merged[-1][1] else "+"
        else:
            merged.append(node)
    return merged


def expression(wrapper: list) -> str:
    """The wrapper as readable text: tags, # for a text slot, groups in parentheses with ?, + or *."""
    parts = []
    for name, repeats, text, children in wrapper:
        inner = " ".join(x for x in ("#" * text, expression(children)) if x)
        parts.append(f"<{name}>({inner}){repeats}")
    return " ".join(parts)


def telling(name: str) -> bool:
    """Whether a signature can change the label of a path."""
    tag, *rest = name.split(".")
    names = set(_NAMES.findall(" ".join(rest)))
    return tag in MAIN_TAGS | DROPPED_TAGS | OUTER_ONLY or not names.isdisjoint(DROPPED_NAMES | REACTIONS | OUTER_ONLY)


@lru_cache(10_000)
def label(path: tuple[str, ...]) -> str:
    """`drop`, `main` (in a marked article) or `open` for a slot, from the signatures on the way to it."""
    steps = [(name.split(".")[0], set(_NAMES.findall(" ".join(name.split(".")[1:])))) for name in path]
    first = next((k for k, (tag, names) in enumerate(steps) if tag in MAIN_TAGS), None)
    for k, (tag, names) in enumerate(steps):
        if tag in DROPPED_TAGS or names & REACTIONS:
            return "drop"
        above = first is not None and k <= first or tag in ("html", "body")
        if not above and names & DROPPED_NAMES:
            return "drop"
        if first is None and tag not in ("html", "body") and (tag in OUTER_ONLY or names & OUTER_ONLY):
            return "drop"
    return "open" if first is None else "main"


def slots(wrapper: list, path: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    """The paths of the wrapper's text slots."""
    for name, _, text, children in wrapper:
        if text:
            yield (*path, name)
        yield from slots(children, (*path, name))


def main_slots(wrapper: list, container: str | None) -> set[tuple[str, ...]]:
    """The slots in marked articles; without any those in the container; without one all that are not dropped."""
    labels = {path: label(path) for path in slots(wrapper)}
    marked = {path for path, name in labels.items() if name == "main"}
    if marked:
        return marked
    kept = {path for path, name in labels.items() if name == "open"}
    top = tuple(container.split("/")) if container else ()
    return {path for path in kept if path[: len(top)] == top}


def text_hash(path: tuple[str, ...], text: str) -> int:
    """Of a slot and what stands in it."""
    return xxhash.xxh64_intdigest("/".join(path) + "\x00" + text) - (1 << 63)


def constants(rows: DataFrame) -> DataFrame:
    """(host, constants): the hashes that most of a host's pages hold, from (host, hashes) of each page, each hash once a page.

    A host has fewer than twice as many as a page has on average.
    """
    different = rows.dropDuplicates(["host", "hashes"])
    sizes = different.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= CONSTANT_PAGES)
    held = different.select("host", F.explode("hashes").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    often = held.filter(F.col("n") > 1).join(sizes, held.host.eqNullSafe(sizes.host)).drop(sizes.host)
    often = often.filter(F.col("n") > CONSTANT_SHARE * F.col("pages"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("constants"))


def varying(kept: list[tuple[tuple[str, ...], str, int]], fixed: set[int]) -> list[str]:
    """The texts without constants; all of them where constants are over half: such a page is a copy of others."""
    rest = [text for path, text, _ in kept if text_hash(path, text) not in fixed] if fixed else []
    every = [text for _, text, _ in kept]
    return rest if 2 * sum(map(len, rest)) >= sum(map(len, every)) else every


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper, container, constants) of every host: the wrapper as JSON, the unmarked container with most text, if any, and its constant texts' hashes."""
    spark = pages.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("box", pa.string()), ("mass", pa.int64())]))
        for batch in batches:
            streams, boxes, hashes = [], [], []
            for (page,) in texts([batch], "html"):
                found = blocks(page)
                mass: dict[str, int] = {}
                for path, text, links in found:
                    if label(path) == "open" and len(path) > 1:
                        box = "/".join(path[:-1])
                        mass[box] = mass.get(box, 0) + max(0, len(text) - 2 * links)
                streams.append(json.dumps(stream(found), separators=(",", ":")))
                boxes.append([{"box": b, "mass": m} for b, m in sorted(mass.items())])
                hashes.append(sorted({text_hash(path, text) for path, text, _ in found}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(streams), pa.array(boxes, kind), pa.array(hashes, pa.list_(pa.int64()))], ["host", "stream", "boxes", "hashes"]
            )

    rows = pages.select(host(F.col(url).cast("string")).alias("host"), F.col(html).cast("string").alias("html"))
    rows = rows.mapInArrow(read, "host string, stream string, boxes array<struct<box:string,mass:long>>, hashes array<bigint>")
    mass = F.explode_outer("boxes")
    rows = stored(rows, "streams")
    boxes = rows.select("host", mass.alias("b")).groupBy("host", "b.box").agg(F.sum("b.mass").alias("mass"))
    best = boxes.groupBy("host").agg(F.max_by("box", F.struct("mass", F.length("box"), "box")).alias("container"))

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        whole = reduce(aligned, (json.loads(s) for s in sorted(group["stream"])))
        return pd.DataFrame({"host": [key[0]], "stream": [json.dumps(whole, separators=(",", ":"))]})

    part = F.pmod(F.xxhash64("stream"), F.lit(4 * partitions(spark)))
    distinct = rows.select("host", "stream").distinct()
    partial = distinct.groupBy("host", part.alias("part")).applyInPandas(merge, "host string, stream string")
    whole = partial.groupBy("host").applyInPandas(merge, "host string, stream string")
    found = whole.join(best, "host", "left").join(constants(rows.select("host", "hashes")), "host", "left")
    return stored(found.select("host", F.col("stream").alias("wrapper"), "container", "constants"), "wrappers")


def extract(pages: DataFrame, wrappers: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html", most: int = SENT_CHARS) -> DataFrame:
    """Key, URL, text and n_chars of each row of `pages`: the main text, its blocks joined by blank lines.

    Character references are decoded and white space in a block is one space.
    Null and empty pages, and pages with no text in a main slot, have the empty
    text. Pages without a host are wrapped together. Repeated rows come out as
    often as they went in. What stands in one place on most of the different pages
    of a host, of five at least, is left out of pages that have more to say. Tags nested deeper than 60 count as part of the tag
    at that depth, with all their text, unless they change its label. Other columns are not read.
    """
    wrappers = infer(pages, url, html) if wrappers is None else wrappers
    size = wrappers.agg(F.sum(F.length("wrapper") + F.coalesce(F.length("container"), F.lit(0)) + 8 * F.coalesce(F.size("constants"), F.lit(0)))).first()[0] or 0
    wrappers = F.broadcast(wrappers) if size <= most else wrappers
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("host", host(F.col("url").cast("string"))).join(wrappers, "host", "left").drop("host")
    names = ["key", "url", "html", "wrapper", "container", "constants"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, set] = {}
        for batch in batches:
            out, sizes = [], []
            for page, wrapper, container, constant in texts([batch], "html", "wrapper", "container", "constants"):
                if (wrapper, container) not in known:
                    if len(known) >= 1_000:
                        known.clear()
                    known[wrapper, container] = main_slots(json.loads(wrapper or "[]"), container)
                main = known[wrapper, container]
                found = blocks(page)
                kept = [block for block in found if block[0] in main] or [block for block in found if label(block[0]) == "open"]
                out.append("\n\n".join(varying(kept, set(constant or ()))))
                sizes.append(len(out[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(sizes, pa.int64())], ["key", "url", "text", "n_chars"]
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    done = rows.select(*names).mapInArrow(run, f"key {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return done.withColumnsRenamed({"key": key, "url": url})


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_text": op7_html_text}
