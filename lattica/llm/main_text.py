"""Operator 12, main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words of content score positive and tags negative, by weights learnt from labelled
pages: how often a tag, or a word in such a place, stands in the main text. One scan finds the contiguous stretch with the
largest sum. What labelled pages show to be no main text wherever it stands (menus, forms, adverts, comments) scores
no words, so a stretch may run over it, and is left out of the text. A block that the stretch touches is kept whole.

Weights are a few hundred numbers, so pages are worked on where they lie, without a shuffle.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.page_labels import PAGES

#: Kinds of HTML elements. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style title textarea iframe noembed noframes noscript template svg math head object audio video canvas datalist".split())
#: An element is ended by the start of one of these inside the same container.
ENDED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"]), "p": BLOCK - frozenset("button option optgroup select noscript title td th tr tbody thead tfoot caption".split()),
}
CONTAINERS = frozenset("table ul ol menu dl select article main body html button td th".split())

TOKEN = re.compile(
    r"""<!--(?:.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)>|<[!?][^>]*+>|</[^>]*+>|<[A-Za-z/!?][^>]*+\Z""", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
FILLER = re.compile(r"\{(\d+)\}")
#: Log odds from which a name decides (one more for main text), largest score of a word, least and most cost of a tag.
CLEAR, MOST, LEAST, DEAREST = 1.0, 3.0, 0.02, 6.0
SURE = 0.0


class Page:
    """A page as events: ("tag", name) and ("word", level, kind, linked, count, block, label), and the text of its blocks."""

    def __init__(self, html: str, names: dict[str, float]):
        self.names = names
        self.events: list[tuple] = []
        self.blocks: list[list[str]] = [[]]
        self.stack: list[tuple] = [("", False, 0, "", False, None)]  # name, left out, level, kind of block, linked, label
        self.seen_main = False
        self.under: list[tuple[str, ...]] = [()]  # names of the elements that are open, for learning
        at, end = 0, len(html)
        while at < end:
            found = TOKEN.search(html, at)
            self.text(html[at : found.start()] if found else html[at:])
            if not found:
                break
            at = found.end()
            name = (found[2] or "").lower()
            if not name:
                continue
            if found[1]:
                self.close(name)
            else:
                self.open(name, found[3])
                if name in RAW:
                    closing = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                    at = closing.start() if closing else at if name == "title" else end

    def text(self, text: str) -> None:
        name, out, level, kind, linked, label = self.stack[-1]
        if out or not text:
            return
        text = references.unescape(text) if "&" in text else text
        self.blocks[-1].append(text)
        if n := len(text.split()):
            self.events.append(("word", level, kind, linked, n, len(self.blocks) - 1, label, self.under[-1]))

    def cut(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def tag(self, name: str) -> None:
        if name in BLOCK:
            self.cut()
        _, out, level, _, _, label = self.stack[-1]
        self.events.append(("tag", name, level, out, label))

    def open(self, name: str, rest: str) -> None:
        if name in BLOCK or name in ENDED_BY:
            for i in range(len(self.stack) - 1, 0, -1):
                above = self.stack[i][0]
                if name in ENDED_BY.get(above, ()):
                    self.leave(i)
                    break
                if above in CONTAINERS:
                    break
        self.tag(name)
        if name == "br":
            self.text(" ")
        if name in VOID:
            return
        _, out, level, kind, linked, label = self.stack[-1]
        given = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if rest and not rest.isspace() else {}
        called = [x for k in ("id", "class", "role") for x in given.get(k, "").split()]
        if name in ("main", "article"):
            mine = self.value(name, called, True) < SURE
            if not self.seen_main and not mine:  # the first one counts even where something before it was never closed
                out, self.seen_main = self.stack[-1][0] in UNSEEN, True
            level = max(level, 3 if name == "article" else 2)
        value = self.value(name, called, level >= 2)
        # What names the whole page says nothing about its parts.
        out = out or name in UNSEEN or name not in ("html", "body") and value < SURE or "hidden" in given or given.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", given.get("style", "")))
        if value > SURE:
            level = max(level, 1)
        label = {"no": False}.get(given["data-main"], True) if "data-main" in given else label
        block = name if name in BLOCK else kind
        self.stack.append((name, out, level, block, linked or name == "a" and "href" in given, label))
        self.under.append((*self.under[-1], *(f"{k}@{int(level >= 2)}" for k in {f"<{name}>", *called, *(p.lower() for x in called for p in PART.findall(x))})) if self.names is LEARNING else ())

    def value(self, name: str, called: Iterable[str], inside: bool) -> float:
        """Below 0: no main text, above: main text, 0: nothing known. A name as it stands goes before its parts."""
        known = []
        for x in called:
            whole = self.known(x, inside)
            parts = [self.known(p.lower(), inside) for p in PART.findall(x)]
            known.append(whole if whole else min(parts, default=0.0) or max(parts, default=0.0))
        least, most = min(known, default=0.0), max(known, default=0.0)
        tag = self.known(f"<{name}>", inside)
        if tag < SURE:
            return tag
        return least if least < SURE and most <= SURE else most

    def known(self, name: str, inside: bool) -> float:
        here = self.names.get(f"{name}@{int(inside)}")
        return self.names.get(f"{name}@{int(not inside)}", 0.0) if here is None else here

    def close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == name:
                self.leave(i)
                break
            if name not in BLOCK and self.stack[i][0] in BLOCK:
                break
        self.tag(name)

    def leave(self, i: int) -> None:
        if any(x[0] in BLOCK for x in self.stack[i:]):
            self.cut()
        del self.stack[i:]
        del self.under[i:]

    def symbols(self) -> Iterator[tuple[str, int, int, bool | None]]:
        """(symbol, words or 0 for a tag, block, label). Symbols hold the place: inside or outside of the article if it has
        half of the words of the main element or more, else of the main element, else of what is named so; any place if the
        page has none of these. A word's symbol holds its block and whether it is linked. Left out parts inside cost nothing."""
        words = Counter()
        for x in self.events:
            if x[0] == "word":
                words[x[1]] += x[4]
        top = 3 if words[3] and words[3] >= words[2] else 2 if words[2] or words[3] else 1 if words[1] else 0
        for x in self.events:
            level = x[2] if x[0] == "tag" else x[1]
            place = "any" if not top else "in" if level >= top else "out"
            if x[0] == "word":
                yield f"{place} {x[2]} {'a' if x[3] else ''}", x[4], x[5], x[6]
            elif not (x[3] and place == "in"):
                yield f"{place} <{x[1]}>", 0, -1, x[4]


LEARNING: dict[str, float] = {}


def learn(pages: Iterable[str] = PAGES) -> tuple[dict[str, float], dict[str, float]]:
    """(names, weights) from labelled pages: log odds of element, class, id and role names, and of symbols.

    A name counts if nearly all words under it are of one side; a symbol's odds are of words, or of tags, inside and outside.
    """
    pages = [FILLER.sub(lambda m: " ".join(["word"] * int(m[1])), p) for p in pages]
    sides: dict[str, Counter] = defaultdict(Counter)
    for p in pages:
        for x in Page(p, LEARNING).events:
            if x[0] == "word":
                for name in set(x[7]):
                    sides[name][bool(x[6])] += x[4]
    odds = {k: math.log((v[True] + 0.5) / (v[False] + 0.5)) for k, v in sides.items()}
    names = {k: v for k, v in odds.items() if v < -CLEAR or v > CLEAR + 1}
    plain = ("<div>", "<p>", "<ul>", "<ol>", "<li>", "<table>", "<tr>", "<td>", "<th>", "<body>", "<section>", "<a>", "<b>", "<small>", "<span>", "<label>", "<dl>", "<dt>", "<dd>", "<pre>", "<blockquote>", "<figure>", "<figcaption>")
    names = {k: v for k, v in names.items() if not k.startswith(plain) and not re.match(r"<h\d>", k)}
    counts: dict[str, Counter] = defaultdict(Counter)
    tags = set()
    for p in pages:
        for symbol, n, _, label in Page(p, names).symbols():
            counts[symbol][bool(label)] += n or 1
            if not n:
                tags.add(symbol)
    weights = {}
    for symbol, c in counts.items():
        value = math.log((c[True] + 0.5) / (c[False] + 0.5))
        weights[symbol] = max(-DEAREST, min(value - 1.0, -LEAST)) if symbol in tags else max(-MOST, min(MOST, value))
    return names, weights


def extract(html: str, names: dict[str, float], weights: dict[str, float]) -> str:
    """Main text of a page: its blocks in page order, one a line."""
    page = Page(html, names)
    best = total = 0.0
    start, span = 0, None
    symbols = list(page.symbols())
    for i, (symbol, n, _, _) in enumerate(symbols):
        if n:
            place, block, linked = symbol.split(" ")
            weight = weights.get(symbol)
            if weight is None:  # a place that no labelled page has: as a paragraph's words there, less if linked
                weight = weights.get(f"{place} p ", 1.0) * (0.1 if linked and place != "out" else 1.0)
            total += n * weight
        else:
            total += weights.get(symbol, weights.get(f"{symbol.split(' ')[0]} <b>", -2 * LEAST))
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i)
    if span is None:
        return ""
    kept = sorted({block for _, n, block, _ in symbols[span[0] : span[1] + 1] if n})
    return "\n".join(line for b in kept if (line := " ".join("".join(page.blocks[b]).split())))


def main_text(pages: DataFrame, labelled: Iterable[str] = PAGES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Needs page_id, url and html; other columns are ignored. A null or empty html has the empty text, as has a page without
    main text; null ids and urls stay, repeated rows have a row each, very long pages are whole, an empty table stays empty.
    White space, no-break spaces included, becomes one space inside a block; a line break inside a block is white space.
    """
    names, weights = learn(labelled)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                texts = [extract(h or "", names, weights) for h in pdf["html"]]
                yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    given = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    out = given.mapInPandas(rows, "page_id string, url string, text string, n_chars long")
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "url", "text", "n_chars")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
