"""HTML extraction by differencing each page with the nearest page of its host.

Pages of a host with equal lines are one group, and groups are put in the order of (host, URL path) of their first
page; the partner of a group is the nearer of its two neighbours in that order on the same host: the one with more
leading path segments in common, then fewer differing characters. The text lines of both are aligned by longest
common subsequence, and lines on that subsequence are shared: menus, notices and other furniture repeat from page to
page, the article does not. Lines that are no paragraph, heading, cell or quotation (bare text, the link of a list)
are aligned by their place in the markup as well: an advert's words change, its slot recurs. Places that hold a third
of a page's text or more are no slots. Shared lines are deleted, except within an element that is marked
up as the article (a passage that two articles quote is still theirs). Markup that never holds an article is left out
before.

Only line hashes (64 bits) travel between pages, and each page meets one partner, whatever the size of its host;
large groups are salted.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_spread, prepare_python, stash

# Elements without article text, elements that end a line, elements without an end tag.
DROPPED = frozenset("aside button canvas datalist dialog footer form head iframe input menu nav noscript object script select style svg template textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# Elements that end an open paragraph, and those within which one stays open.
ENDS_P = BLOCKS - frozenset("body br caption dd dt html legend li option tbody td tfoot th thead tr".split())
KEEPS_P = frozenset("button caption object table td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
# Words in class, id or role that mark furniture.
FURNITURE = frozenset(
    "ad ads adv advert advertisement adverts alert announcement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toc toolbar topbar widget".split()
)
# The same within an article, where the other words name sections of the text as well.
ARTICLE_FURNITURE = frozenset("ad ads adv advert advertisement adverts comments disqus newsletter promo promoted share sharing signup social sponsor sponsored subscribe".split())
# Elements whose lines are known by their text; and those within which a header is a heading.
PROSE = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
SECTIONS = frozenset("article main section".split())
#: A place with so large a share of the page's characters is no slot.
TEXT_SHARE = 3
_CLASS = re.compile(r"class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# What a page may wrap its article in; other dropped elements hide all they hold.
WRAPPERS = frozenset("aside footer form header menu nav search".split())
KEPT, WRAPPED, HIDDEN = 0, 1, 2


@dataclass
class Line:
    text: str
    article: bool
    place: str = ""  # elements from the root, with classes; empty where the text tells the line


def _furniture(name: str, attributes: str, in_article: bool, in_section: bool, open_page: bool) -> int:
    """KEPT, WRAPPED (furniture that an article inside may still leave) or HIDDEN.

    open_page: the page is empty otherwise, so neither a form nor a name makes furniture.
    """
    found = KEPT
    if (name in DROPPED and not (open_page and name == "form")) or (name == "header" and not in_section):
        found = WRAPPED if name in WRAPPERS else HIDDEN
    words = frozenset() if open_page else ARTICLE_FURNITURE if in_article else FURNITURE
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value.strip() == "true"):
            return HIDDEN
        if key in ("class", "id", "role") and name not in ("html", "body", "article", "main") and not words.isdisjoint(value.split()):
            found = max(found, WRAPPED)
    return found


def page_lines(html: str | None) -> list[Line]:
    """The visible lines of a page in order, without furniture; `article` where an article or main element holds them.

    Articles within furniture are comments or teasers, unless the page has no other: then the furniture wraps the page.
    A page that furniture empties is read again without what may wrap it: a form, and names of class, id or role.
    """
    lines, wrapped = _read_lines(html or "", False)
    if wrapped and not any(x.article for x in lines):
        lines = _read_lines(html or "", True)[0]
    return lines or (_read_lines(html, True, open_page=True)[0] if html else [])


def _place(stack: list[tuple], linked: bool) -> str:
    """The place of a line in the markup, if that and not its text tells it from others."""
    prose = any(x[0] in PROSE for x in stack) and not linked
    return "" if prose else "/".join(x[3] for x in stack if x[0] in BLOCKS)


def _read_lines(text: str, unwrap: bool, open_page: bool = False) -> tuple[list[Line], bool]:
    """Lines, and whether furniture wraps an article; with `unwrap` such an article is read."""
    lines, run, linked = [], [], []
    stack: list[tuple[str, int, bool, str]] = []  # name, dropped, article, name with class
    dropped, article, wrapped = KEPT, False, False
    at = 0

    def end_line() -> None:
        if run:
            line = " ".join(entities.unescape("".join(run)).split())
            if line:
                lines.append(Line(line, article, "" if article else _place(stack, all(linked))))
            run.clear()
            linked.clear()

    while at < len(text):
        m = _TOKEN.search(text, at)
        if m is None or m.start() > at:
            if not dropped:
                run.append(text[at : m.start() if m else len(text)])
                if not run[-1].isspace():
                    linked.append(any(x[0] == "a" for x in stack))
            if m is None:
                break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is None or (dropped and not any(entry[1] for entry in stack[depth:]) and name == "p"):
                continue
            if name in BLOCKS or stack[depth][1] != dropped:
                end_line()
            del stack[depth:]
        else:
            if name in BLOCKS or name in DROPPED:
                end_line()
            if name in VOID or m[3].rstrip().endswith("/"):
                continue
            if name in ENDS_P:
                open_p = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ("p", *KEEPS_P)), None)
                if open_p is not None and stack[open_p][0] == "p":
                    del stack[open_p:]
                    article, dropped = (stack[-1][2], stack[-1][1]) if stack else (False, KEPT)
            marks = name in ("article", "main") or "articlebody" in m[3].lower()
            inner_article = article or marks
            outer = dropped
            if marks and dropped == WRAPPED:
                wrapped = True
                outer = KEPT if unwrap else dropped
            inner_dropped = max(outer, _furniture(name, m[3], article, any(x[0] in SECTIONS for x in stack), open_page))
            if name in BLOCKS and inner_dropped != dropped:
                end_line()
            named = _CLASS.search(m[3]) if "class" in m[3].lower() else None
            stack.append((name, inner_dropped, inner_article, f"{name}.{named[1] or named[2] or named[3] or ''}" if named else name))
            if name in RAW:  # nothing inside is markup
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(text, at)
                if not inner_dropped:
                    run.append(text[at : end.start() if end else len(text)])
                at = end.start() if end else len(text)
        article = bool(stack) and stack[-1][2]
        dropped = stack[-1][1] if stack else KEPT
    end_line()
    return lines, wrapped


def shared_by_lcs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of a lie on a longest common subsequence with b."""
    shared = np.zeros(len(a), dtype=bool)
    n, m = len(a), len(b)
    differs = np.flatnonzero(a[: min(n, m)] != b[: min(n, m)])
    start = int(differs[0]) if len(differs) else min(n, m)
    left = min(n, m) - start
    differs = np.flatnonzero(a[n - left :][::-1] != b[m - left :][::-1])
    stop = int(differs[0]) if len(differs) else left
    shared[:start] = True
    shared[n - stop :] = True
    x, y = a[start : n - stop], b[start : m - stop]
    # lines that only one side has are on no common subsequence
    rows, columns = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    if len(rows) and len(columns):
        shared[start + rows[_align(x[rows], y[columns])]] = True
    return shared


def _align(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of x on a longest common subsequence with y, by bit sets.

    Bit j of a row's set is 0 where the subsequence with y[: j + 1] is longer than with y[:j]. Only the sets at the
    bounds of blocks of rows are held; a block's own sets are computed again on the way back.
    """
    whole = (1 << len(y)) - 1
    order = np.argsort(y, kind="stable")
    first, last = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")

    def places(i: int) -> int:
        bits = np.zeros(len(y), dtype=bool)
        bits[order[first[i] : last[i]]] = True
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def step(row: int, i: int) -> int:
        both = row & (found := places(i))
        return ((row + both) | (row & ~found)) & whole

    block = max(1, int(len(x) ** 0.5))
    bounds, row = [], whole
    for i in range(len(x)):
        if i % block == 0:
            bounds.append(row)
        row = step(row, i)
    met, column = [], len(y)
    for k in range(len(bounds) - 1, -1, -1):
        sets = [bounds[k]]  # the set before row i stands at i - k * block
        for i in range(k * block, min(len(x), (k + 1) * block)):
            sets.append(step(sets[-1], i))
        for i in range(len(sets) - 1, 0, -1):
            size = -(-len(y) // 8)
            own, above = sets[i].to_bytes(size, "little"), sets[i - 1].to_bytes(size, "little")
            while column and own[(column - 1) >> 3] >> ((column - 1) & 7) & 1:
                column -= 1
            if not column:
                return met
            if above[(column - 1) >> 3] >> ((column - 1) & 7) & 1:
                met.append(k * block + i - 1)
                column -= 1
    return met


def _hashes(texts: list[str]) -> np.ndarray:
    hashed = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) if x else 0 for x in texts), dtype=np.uint64, count=len(texts))
    return hashed.view(np.int64)


def line_hashes(lines: list[Line]) -> np.ndarray:
    return _hashes([x.text for x in lines])


def page_keys(lines: list[Line]) -> np.ndarray:
    """What a page tells its partner: the number of lines, the hashes of their texts and, if there are any, of their places."""
    if not lines:
        return np.zeros(0, dtype=np.int64)
    places = _hashes([x.place for x in lines])
    return np.concatenate(([len(lines)], line_hashes(lines), places[:0] if not places.any() else places))


def shared_lines(lines: list[Line], other: np.ndarray) -> np.ndarray:
    """Which lines the partner with these keys shares: by text, or as a slot by place."""
    shared = np.zeros(len(lines), dtype=bool)
    if not lines or not len(other):
        return shared
    n = int(other[0])
    shared = shared_by_lcs(line_hashes(lines), other[1 : n + 1])
    held = Counter()
    for x in lines:
        held[x.place] += len(x.text)
    slots = [k for k, x in enumerate(lines) if x.place and TEXT_SHARE * held[x.place] < held.total()]
    if slots and len(other) > n + 1:
        places = other[n + 1 :]
        shared[slots] |= shared_by_lcs(_hashes([lines[k].place for k in slots]), places[places != 0])
    return shared


def main_text(lines: list[Line], shared: np.ndarray) -> str:
    """The lines not shared with the partner; a marked-up article protects its lines from deletion."""
    return " ".join(x.text for x, s in zip(lines, shared, strict=True) if x.article or not s)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """Path without scheme, host, query, fragment, page suffix; numbers padded so that near numbers are neighbours."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.(?:html?|php|aspx?)$", "")
    return F.regexp_replace(F.regexp_replace(path, r"(\d+)", "000000000$1"), r"0*(\d{10})(?!\d)", "$1")


def _nearness(path: Column, other: Column) -> Column:
    """Orders neighbours: leading path segments in common, then the fewer edits between the paths."""
    a, b = F.split(path, "/"), F.split(other, "/")
    common = F.size(F.filter(F.sequence(F.lit(1), F.size(a)), lambda k: F.slice(a, 1, k) == F.slice(b, 1, k)))
    return F.struct(common.alias("common"), (-F.levenshtein(path, other)).alias("edits"))


def partners(keys: DataFrame) -> DataFrame:
    """page_key, partner_key: the nearer neighbour on the host in path order, the previous one on ties.

    keys(page_key, host, path). The order is global (one range partitioning), so that a hot host is spread over
    many tasks; partitions learn the row before their first and after their last from a table of their ends.
    """
    ordered = keys.repartitionByRange("host", "path", "page_key").sortWithinPartitions("host", "path", "page_key")
    ordered = stash(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "order")
    own = Window.partitionBy("part").orderBy("at")
    page = F.struct("host", "path", "page_key")
    near = ordered.select("part", "host", "path", "page_key", F.lag(page).over(own).alias("before"), F.lead(page).over(own).alias("after"))
    ends = ordered.groupBy("part").agg(F.min_by(page, "at").alias("first"), F.max_by(page, "at").alias("last"))
    chain = Window.orderBy("part")  # one row for each partition
    ends = ends.select("part", F.lag("last").over(chain).alias("last_before"), F.lead("first").over(chain).alias("first_after"))
    near = near.join(F.broadcast(ends), "part").select("host", "path", "page_key", F.coalesce("before", "last_before").alias("before"), F.coalesce("after", "first_after").alias("after"))
    before, after = (F.when(F.col(f"{side}.host") == F.col("host"), F.col(side)) for side in ("before", "after"))
    near = near.select("path", "page_key", before.alias("before"), after.alias("after"))
    later = F.col("before").isNull() | (_nearness(F.col("path"), F.col("after.path")) > _nearness(F.col("path"), F.col("before.path")))
    return near.select("page_key", F.when(F.col("after").isNotNull() & later, F.col("after.page_key")).otherwise(F.col("before.page_key")).alias("partner_key"))


def known_partners(pages: DataFrame) -> DataFrame:
    """page_key, partner_key, lines (of the partner) of pages(page_key, host, path, lines).

    The partner is the nearest page of the host with other lines; pages without lines are nobody's partner.
    """
    pages = pages.withColumn("group", F.xxhash64("lines"))
    filled = pages.filter(F.size("lines") > 0)
    groups = stash(filled.groupBy("host", "group").agg(F.min(F.struct("path", "page_key")).alias("first"), F.count("*").alias("n")), "groups")
    pairs = partners(groups.select("first.page_key", "host", "first.path"))
    lines = filled.select(F.col("page_key").alias("partner_key"), "lines")
    # a group is the partner of two others at most, so no key of this join is hot
    met = pairs.join(lines, "partner_key").select("page_key", "partner_key", "lines")
    by_group = groups.select("host", "group", F.col("first.page_key").alias("page_key")).join(met, "page_key").drop("page_key")
    # copies make hot groups
    total = groups.agg(F.sum("n")).first()[0] or 0
    rows = pages.select("page_key", "host", "group")
    return join_spread(rows, by_group, groups, ["host", "group"], F.col("page_key"), total, "left").select("page_key", "partner_key", "lines")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, partner_id, n_lines, n_shared for every row of pages(page_id, url, html, ...).

    Null or empty html gives empty text; a null url belongs to the empty host; a page whose host has no other lines
    than its own has no partner and no shared line; repeated rows are pages of their own, with the same partner; very
    long pages are aligned whole; a null page_id is kept; other columns are ignored; no rows give no rows.
    """
    prepare_python(pages.sparkSession)
    # a key of the content alone, so that a task that runs again finds the same; repeated rows share it
    content = F.xxhash64("url", F.col("url").isNull(), "html", F.col("html").isNull())
    rows = pages.select("page_id", "url", "html").withColumn("page_key", F.struct("page_id", content.alias("h")))

    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series([page_keys(page_lines(h)) for h in htmls], dtype=object)

    @F.pandas_udf("text string, n_lines int, n_shared int")
    def extracted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for htmls, others in batches:
            out = []
            for html, other in zip(htmls, others, strict=True):
                lines = page_lines(html)
                shared = shared_lines(lines, np.asarray(() if other is None else other, dtype=np.int64))
                out.append((main_text(lines, shared), len(lines), int(shared.sum())))
            yield pd.DataFrame(out, columns=["text", "n_lines", "n_shared"])

    keys = rows.select("page_key", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), hashes("html").alias("lines"))
    known = known_partners(stash(keys.dropDuplicates(["page_key"]), "lines")).select("page_key", "lines", F.col("partner_key.page_id").alias("partner_id"))
    met = rows.join(known, "page_key").withColumn("r", extracted("html", "lines"))
    return met.select("page_id", "url", "r.text", F.length("r.text").cast("long").alias("n_chars"), "partner_id", "r.n_lines", "r.n_shared")
