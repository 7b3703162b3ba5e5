"""Main text of web pages by consensus host paths.

Each page scores its containers by the running text their blocks hold, and votes for the generalised path
(tags and classes, digits replaced) of the best. Spark counts the votes per host. Every page is then read
again with its host's winning path; a page without such a container falls back on its own best.

A page is read in one pass whose time and memory grow with its length, whatever its tags are like.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, broadcast_within, fixed
from quire.llm.markup import RAW, decoded, tags_of
from quire.llm.url_filter import host_of

BROADCAST_HOSTS = 200_000

_NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\btype\s*=\s*["']?hidden\b""", re.I)
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[^a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var".split()
)
_PARAGRAPHS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split())  # their holder gets their text's score
_CLOSED_BY_SAME = frozenset("li dt dd tr td th option".split())
_FIELDS = frozenset("input textarea select button".split())
_OUTSIDE = frozenset(  # elements that never hold main text
    "head title nav header footer aside button select menu dialog object canvas".split()
)
_OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog".split())
_OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner sponsor sponsored promo "
    "promotion sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended comment comments commentlist disqus replies reply search widget pagination pager toolbar".split()
)
_AFTER_WORDS = frozenset("responses respond feedback discussion discussions guestbook".split())  # only after the article
_NEUTRAL_STARTS = ("no-", "has-", "with-", "without-", "is-", "not-")
_TRUSTED = frozenset(["html", "body", "main"])  # never left out for their class
_WHOLE_NAMES = _PARAGRAPHS | {"article", "li", "dt", "dd"}  # left out for a whole name only, not for a part of one

FORM_TEXT = 200  # a form with this much running text for each field is a wrapper around the page
AFTER_TEXT = 40  # running text (a sentence) after which an article counts as begun


class _Page:
    """Blocks of a page's text and its containers, from one pass over the tags.

    Paths are nodes of a tree, kept as (parent, step); open elements are rows of parallel arrays, each with the place of
    the nearest block and of the nearest holder of paragraphs at or above it. So nothing is searched for.
    """

    def __init__(self, source: str):
        self.pieces: list[str] = []
        self.starts = array("q")  # first piece of every block
        self.kept = bytearray()  # whether a block is outside menus, adverts and the like
        self._dropped: list[tuple[int, int]] = []  # forms: first block, block after the last
        self._h1: list[tuple[int, int, int]] = []  # parent element, first block, block after the last
        self._steps: dict[str, int] = {}
        self._names: list[str] = []
        self._children: dict[int, int] = {}  # parent node and step in one number: node
        self._parents, self._step_of = array("q", [-1]), array("q", [-1])  # node 0 is the root
        # containers with text: node, first block, block after the last, score, parent element
        self._containers = array("q"), array("q"), array("q"), array("d"), array("q")
        # open elements
        self._tags: list[str] = []
        self._nodes, self._first, self._block, self._holder, self._ids = (array("q") for _ in range(5))
        self._outside, self._scores = bytearray(), array("d")
        self._open_tags: Counter[str] = Counter()
        self._forms: list[tuple[int, int, int, int]] = []  # of open forms: fields, text, articles, containers before
        self._elements = self._field_count = self._articles = self._articles_ended = 0
        self._text_length = 0  # running text outside links
        self._fresh = True
        self._read(source)
        while self._tags:
            self._close()
        for first, end in self._dropped:
            self.kept[first:end] = bytes(end - first)

    def _text(self, piece: str) -> None:
        outside = bool(self._tags) and self._outside[-1]
        if self._fresh:
            self.starts.append(len(self.pieces))
            self.kept.append(not outside)
            self._fresh = False
        self.pieces.append(decoded(piece) if "&" in piece else piece)
        if outside or self._open_tags["a"]:
            return
        length = len(piece) - piece.count(" ")
        self._text_length += length
        holder = self._holder[-1] if self._tags else -1
        if holder >= 0:  # the paragraph's holder counts it fully, the next one by half
            self._scores[holder] += length
            above = self._holder[holder - 1] if holder else -1
            if above >= 0:
                self._scores[above] += length / 2

    def _node(self, parent: int, step: str) -> int:
        number = self._steps.setdefault(step, len(self._steps))
        if number == len(self._names):
            self._names.append(step)
        key = parent << 32 | number
        node = self._children.get(key)
        if node is None:
            node = self._children[key] = len(self._parents)
            self._parents.append(parent)
            self._step_of.append(number)
        return node

    def _open(self, tag: str, rest: str) -> None:
        top = len(self._tags) - 1
        outside = (top >= 0 and self._outside[top]) or tag in _OUTSIDE
        names = ""
        if rest:
            for kind, *values in _NAME.findall(rest):
                value = "".join(values).lower()
                if kind.lower() == "class" and tag not in _TRUSTED:
                    names = ".".join(sorted(set(_DIGITS.sub("#", value).split())))
                if kind.lower() == "role":
                    outside = outside or value in _OUTSIDE_ROLES
                elif tag not in _TRUSTED and not outside:
                    outside = self._named_outside(tag, value)
        if tag == "html":  # it may be left out
            node = 0
        else:
            node = self._node(self._nodes[top] if top >= 0 else 0, f"{tag}.{names}" if names else tag)
        place, inline = top + 1, tag in _INLINE
        if tag == "form":
            self._forms.append((self._field_count, self._text_length, self._articles, len(self._containers[0])))
        self._articles += tag in ("article", "main", "h1")
        self._tags.append(tag)
        self._open_tags[tag] += 1
        self._nodes.append(node)
        self._outside.append(outside)
        self._first.append(len(self.starts))
        self._scores.append(0.0)
        self._block.append((self._block[top] if top >= 0 else -1) if inline else place)
        self._holder.append((self._holder[top] if top >= 0 else -1) if inline or tag in _PARAGRAPHS else place)
        self._ids.append(self._elements)
        self._elements += 1

    def _named_outside(self, tag: str, value: str) -> bool:
        begun = self._text_length >= AFTER_TEXT or self._articles_ended
        for name in value.split():
            if name.startswith(_NEUTRAL_STARTS):
                continue
            for word in [name] if tag in _WHOLE_NAMES else _WORDS.split(name):
                if word in _OUTSIDE_WORDS or (begun and word in _AFTER_WORDS):
                    return True
        return False

    def _close(self) -> None:
        tag, node, outside = self._tags.pop(), self._nodes.pop(), self._outside.pop()
        first, score = self._first.pop(), self._scores.pop()
        self._block.pop(), self._holder.pop(), self._ids.pop()
        self._open_tags[tag] -= 1
        if tag == "form" and self._is_form(*self._forms.pop()):
            self._dropped.append((first, len(self.starts)))
        elif not outside and tag not in _INLINE and score > 0:
            parent = self._ids[-1] if self._ids else -1
            for column, value in zip(self._containers, (node, first, len(self.starts), score, parent), strict=True):
                column.append(value)
        if tag == "h1" and not outside and len(self.starts) > first:
            self._h1.append((self._ids[-1] if self._ids else -1, first, len(self.starts)))
        self._articles_ended += tag == "article" and not outside

    def _is_form(self, fields: int, text: int, articles: int, containers: int) -> bool:
        """Whether the form that ends holds fields rather than the page; its containers go with it."""
        if self._articles > articles:
            return False
        if self._text_length - text >= FORM_TEXT * max(1, self._field_count - fields):
            return False
        for column in self._containers:
            del column[containers:]
        return True

    def _close_to(self, place: int) -> None:
        while len(self._tags) > place:
            self._close()

    def _tag(self, tag: str, end: bool, rest: str) -> None:
        if tag == "br":
            self._text(" ")
            return
        inline = tag in _INLINE
        self._fresh = self._fresh or not inline
        if end:
            if self._open_tags[tag]:
                while self._tags[-1] != tag:
                    self._close()
                self._close()
            return
        if tag in _FIELDS and not (tag == "input" and _HIDDEN.search(rest)):
            self._field_count += 1
        if tag in _VOID or tag in RAW:
            return
        if not inline and self._tags and self._block[-1] >= 0:
            # a block ends an open paragraph, a list item or cell the one before it
            held = self._tags[self._block[-1]]
            if held == "p" or (held == tag and tag in _CLOSED_BY_SAME):
                self._close_to(self._block[-1])
        self._open(tag, rest)

    def _read(self, source: str) -> None:
        for text, tag, end, rest in tags_of(source):
            if text:
                self._text(text)
            if tag:
                self._tag(tag, end, rest)

    def _path(self, node: int) -> str:
        steps = []
        while node:
            steps.append(self._names[self._step_of[node]])
            node = self._parents[node]
        return " ".join(reversed(steps))  # no step holds a blank

    def _found(self, path: str) -> int | None:
        """The node of a path, None if the page has none."""
        node = 0
        for step in path.split():
            node = self._children.get(node << 32 | self._steps.get(step, 0xFFFFFFFF))
            if node is None:
                return None
        return node

    def _best(self) -> tuple[int, float] | None:
        """Node and score of the best container, the first of equals."""
        nodes, scores = self._containers[0], self._containers[3]
        best = max(range(len(nodes)), key=lambda i: (scores[i], -nodes[i]), default=None)
        return None if best is None else (nodes[best], scores[best])

    def vote(self) -> tuple[str | None, float]:
        """Path and score of the best container."""
        best = self._best()
        return (None, 0.0) if best is None else (self._path(best[0]), best[1])

    def text(self, path: str | None) -> str:
        """Text of all containers with ``path``; of the best one's path, or the whole page, if there is none.

        Without an h1 between its start and end, the last one before it that has the same parent element belongs to it.
        """
        nodes, firsts, ends, _, parents = self._containers
        wanted = None if path is None else self._found(path)
        chosen = [i for i, node in enumerate(nodes) if node == wanted]
        if not chosen and (best := self._best()):
            chosen = [i for i, node in enumerate(nodes) if node == best[0]]
        ranges = sorted((firsts[i], ends[i]) for i in chosen)
        if ranges:
            start, end, above = ranges[0][0], max(end for _, end in ranges), {parents[i] for i in chosen}
            if not any(start <= first < end for _, first, _ in self._h1):
                before = [(first, last) for parent, first, last in self._h1 if parent in above and last <= start]
                ranges = sorted(before)[-1:] + ranges
        lines, done = [], 0
        for first, end in ranges or [(0, len(self.starts))]:
            for block in range(max(first, done), end):
                if self.kept[block]:
                    stop = self.starts[block + 1] if block + 1 < len(self.starts) else len(self.pieces)
                    line = " ".join("".join(self.pieces[self.starts[block] : stop]).split())
                    if line:
                        lines.append(line)
            done = max(done, end)
        return "\n".join(lines)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_Page(source.as_py()).vote() for source in batch.column(1)]  # one page at a time in memory
        paths, scores = [path for path, _ in found], [score for _, score in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"]
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sources, paths = batch.column(2), batch.column(3).to_pylist()
        texts = [_Page(source.as_py()).text(path) for source, path in zip(sources, paths, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path most pages of the host vote for; between equals the higher sum of scores, then the path.

    Votes are combined before the shuffle, so a host with most of the pages costs no more than another.
    """
    sources = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    votes = sources.mapInArrow(_votes, "host string, path string, score double").where("path is not null")
    # whole numbers, so that the sum does not depend on the order of rows
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("score").cast("long")).alias("score"))
    best = F.max(F.struct("n", "score", "path")).alias("best")
    return counted.groupBy("host").agg(best).select("host", F.col("best.path").alias("path"))


def extract_main_text(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Blocks are joined by line ends, white space inside a block is one blank, character references are
    decoded. Null or empty html, or a page without main text, gives an empty text. Pages without a host vote
    among themselves. Repeated rows are read alike; other columns are not looked at. An empty table gives an empty one.
    Very long pages, with tags that are never closed or nest without end, take time and memory by their length.
    """
    bounded_batches(pages.sparkSession)
    winners = broadcast_within(fixed(host_paths(pages), "host-paths"), broadcast_hosts)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    rows = rows.join(winners, "host", "left").select("page_id", "url", "html", "path")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return rows.mapInArrow(_texts, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
