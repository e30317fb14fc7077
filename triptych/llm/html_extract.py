"""Main texts of web pages, with the templates of their hosts deduced from equivalence classes."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.llm.common import slices, whole_text
from triptych.llm.html_parse import is_text, main_text, parse
from triptych.sources.shared import materialize

# The token that every page has once.
PAGE = 0
# What the texts of one slot weigh together in one page.
WEIGHT = 1 << 20


def host_of(url: Column) -> Column:
    """The host with its port, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            hosts, tokens, counts, pages = [], [], [], []
            for host, key, source in zip(*(part.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                found = Counter(parse(source).tokens)
                if not found:
                    continue  # a page without anything says nothing about its host
                found[PAGE] = 1
                hosts += [host] * len(found)
                tokens += found.keys()
                counts += found.values()
                pages += [key] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(pages, pa.int64())], ["host", "token", "n", "page"])


def classes(pages: DataFrame, least_pages: int = 10, support: float = 0.5) -> DataFrame:
    """One row per `host`: its equivalence classes, as `template`, an array of (token, class, once),
    and `all`, its number of pages that are not empty.

    `pages` has `host`, `page` (a number for each page) and `html`. Tokens of a host are in
    one class if they have the same occurrence vector: how often each page has them. A
    vector is known by its number of pages and two sums of hashes of page and count, which
    are put together before the shuffle; so no task sees a host's pages, however many. Kept
    are classes of two tokens or more (those of the page itself included) in at least
    `least_pages` pages and `support` of the host's; `once` tells those that no page has
    twice. Such tokens are at most 1 / `support` times as many as an average page has. A
    class of texts alone is none: they fill a slot (see `slot_texts`).
    """
    def sum_of(seed: int) -> Column:
        return F.sum(F.pmod(F.xxhash64(F.lit(seed), "page", "n"), F.lit(1 << 31)))

    rows = pages.select("host", "page", "html").mapInArrow(
        _occurrences, "host string, token long, n long, page long")
    tokens = materialize(rows.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.max("n").alias("most"), sum_of(1).alias("one"), sum_of(2).alias("two")).filter(
        F.col("pages") >= least_pages), "tokens")
    hosts = tokens.filter(F.col("token") == PAGE).select("host", F.col("pages").alias("all"))
    often = tokens.join(hosts, "host").filter(F.col("pages") >= support * F.col("all"))
    found = often.groupBy("host", "pages", "one", "two").agg(
        F.collect_list("token").alias("tokens"), F.min("token").alias("name"),
        (F.max("most") == 1).alias("once"), F.max("all").alias("all")).filter(
        (F.size("tokens") > 1) & F.exists("tokens", lambda t: t.bitwiseAND(F.lit(1)) == 0))
    return materialize(found.select("host", "name", "once", "all", F.explode("tokens").alias("token")).groupBy("host").agg(
        F.collect_list(F.struct("token", "name", "once")).alias("template"), F.max("all").alias("all")), "templates")


def template_of(tokens: list[int], classes_: dict[int, int]) -> frozenset[int]:
    """The tokens of the classes that are valid in a page, nested in each other.

    A class is valid if its tokens come in one order, over and over: between two of them lie
    the slots. One that comes over and over is nested in those that come once if each of its
    turns lies in one slot of theirs; a class that straddles is given up. Texts in a turn
    fill it and are no border.
    """
    places: dict[int, list[tuple[int, int]]] = {}
    for at, token in enumerate(tokens):
        if token in classes_:
            places.setdefault(classes_[token], []).append((at, token))
    taken: set[int] = set()
    marks: list[int] = []
    again: list[tuple[list[int], list[int], list[int]]] = []
    for own in places.values():
        order = list(dict.fromkeys(token for _, token in own))
        turns, rest = divmod(len(own), len(order))
        if rest or [token for _, token in own] != order * turns:
            continue
        if turns == 1:
            taken.update(order)
            marks += [at for at, token in own if not is_text(token)]
        else:
            again.append((order, [own[i * len(order)][0] for i in range(turns)],
                          [own[(i + 1) * len(order) - 1][0] for i in range(turns)]))
    marks.sort()
    for order, first, last in again:
        if all(bisect_left(marks, low) == bisect_left(marks, high) for low, high in zip(first, last, strict=True)):
            taken.update(order)
    return frozenset(taken)


def slots_of(tokens: list[int], fixed: frozenset[int], once: frozenset[int]) -> list[int]:
    """For each text of a page the slot that it fills, named by the tags of the template before it.

    These are the last tag that pages have once and the last one of any class, so that turns
    of a class are told apart by where in the page they are.
    """
    out, outer, inner = [], PAGE, PAGE
    for token in tokens:
        if is_text(token):
            out.append((outer * 3 + inner) % (1 << 61))
        elif token in fixed:
            inner = token
            outer = token if token in once else outer
    return out


class Hosts:
    """What is made of a column's lists, one per host, which are not read again for each page."""

    def __init__(self, make: Callable[[list[dict]], Any], most: int = 256):
        self.make, self.most = make, most
        self.held: dict[str, Any] = {}

    def of(self, host: str, column: pa.Array, row: int) -> Any:
        if host not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            self.held[host] = self.make(column[row].as_py() or [])
        return self.held[host]


def _known(template: list[dict]) -> tuple[dict[int, int], frozenset[int]]:
    """The classes of a host, and the tokens that come once."""
    return {x["token"]: x["name"] for x in template}, frozenset(x["token"] for x in template if x["once"])


def _filling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates = Hosts(_known)
    for batch in batches:
        for part in slices(batch, "html"):
            rows: list[tuple[str, int, int, int, int]] = []
            for i, (host, source, pages) in enumerate(zip(*(part.column(c).to_pylist() for c in ("host", "html", "all")), strict=True)):
                tokens = parse(source).tokens
                known, once = templates.of(host, part.column("template"), i)
                slots = slots_of(tokens, template_of(tokens, known), once)
                filled = dict.fromkeys(zip(slots, filter(is_text, tokens), strict=True))
                sizes = Counter(slot for slot, _ in filled)
                rows += [(host, slot, text, WEIGHT // sizes[slot], pages) for slot, text in filled]
                rows += [(host, slot, PAGE, 0, pages) for slot in sizes]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                ["host", "slot", "text", "weight", "all"])


def slot_texts(pages: DataFrame, least_pages: int = 10, support: float = 0.5, own: float = 0.1) -> DataFrame:
    """One row per `host`: `common`, an array of (slot, text), the texts in its slots that are template.

    `pages` has `host`, `html`, and the `template` and `all` of the host. A text is common if
    `least_pages` pages and `support` of the host's have it in the slot. A slot is the
    article's if texts that are not common are `own` of what its pages fill it with, so that
    it differs between pages: common texts of such a slot may be copied passages, and are
    template only if less than `own` of the pages lack them. In other slots all common texts
    are template, and other texts are the page's.
    """
    found = pages.mapInArrow(_filling, "host string, slot long, text long, weight long, all long").groupBy(
        "host", "slot", "text").agg(F.count("*").alias("pages"), F.sum("weight").alias("weight"), F.max("all").alias("all"))
    text = F.col("text") != PAGE
    common = text & (F.col("pages") >= support * F.col("all")) & (F.col("pages") >= least_pages)
    slots = found.groupBy("host", "slot").agg(
        F.max("all").alias("all"),
        F.sum(F.when(text & ~common, F.col("weight")).otherwise(0)).alias("differs"),
        F.sum(F.when(~text, F.col("pages"))).alias("filled"),
        F.collect_list(F.when(common, F.struct("text", "pages"))).alias("texts"))
    article = F.col("differs") >= own * WEIGHT * F.col("filled")
    texts = slots.select("host", "slot", "all", article.alias("article"), F.explode("texts").alias("x")).filter(
        ~F.col("article") | (F.col("x.pages") > (1 - own) * F.col("all")))
    return materialize(texts.groupBy("host").agg(
        F.collect_list(F.struct("slot", F.col("x.text").alias("text"))).alias("common")), "common")


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates = Hosts(_known)
    commons = Hosts(lambda common: {(x["slot"], x["text"]) for x in common})
    for batch in batches:
        for part in slices(batch, "html"):
            texts = []
            for i, (source, host) in enumerate(zip(part.column("html").to_pylist(), part.column("host").to_pylist(), strict=True)):
                page = parse(source)
                known, once = templates.of(host, part.column("template"), i)
                shared = commons.of(host, part.column("common"), i)
                fixed = template_of(page.tokens, known)
                slots = slots_of(page.tokens, fixed, once)
                for slot, piece in zip(slots, (p for p in page.pieces if p.token), strict=True):
                    piece.common = (slot, piece.token) in shared
                texts.append(main_text(page, frozenset(t for t in fixed if known[t] == PAGE)))
            yield pa.RecordBatch.from_arrays([*part.columns[4:], pa.array(texts, pa.string())],
                                             [*part.schema.names[4:], "text"])


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
            least_pages: int = 10, support: float = 0.5, own: float = 0.1) -> DataFrame:
    """One row per page: its id, url, `text` and `n_chars`.

    The text is the article without menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles, markup and comments: character references are decoded, white
    space inside a block is one space, and blocks are joined by line breaks. Tags that
    the pages of a host share in the same numbers are its template, on some of the pages or
    all (see `classes` and `template_of`); the slots between them hold the texts. Slots whose
    texts differ between pages are the article's; texts that come again in other slots are
    template (see `slot_texts`), as are those that every page has once. Of slots that
    differ, those that are no article are known by the elements, roles and class names around
    them. If a page has an `article` or `main` element, only what stands in one counts.

    NULL pages are empty and have the empty text. NULL urls are one host, without a name.
    Hosts with less than `least_pages` pages have no template. Repeated rows are each given.
    Other columns are not carried.
    """
    source = whole_text(html_column)
    rows = pages.select(source.alias("html"), host_of(F.col(url_column)).alias("host"),
                        F.col(id_column).alias("key"), F.col(url_column).alias("address"))
    numbered = rows.select("host", "html", F.xxhash64("key", "address", "html").alias("page"))
    templates = classes(numbered, least_pages, support)
    common = slot_texts(numbered.join(templates, "host").select("host", "html", "template", "all"),
                        least_pages, support, own)
    kind = rows.schema["key"].dataType.simpleString()
    joined = rows.join(templates.join(common, "host", "left"), "host", "left").select(
        "html", "host", "template", "common", "key", "address")
    return joined.mapInArrow(_extracting, f"key {kind}, address string, text string").select(
        F.col("key").alias(id_column), F.col("address").alias(url_column), "text",
        F.length("text").cast("long").alias("n_chars"))
