"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

1. Tokens: each document is cut into words once; the words are stored.
2. Terms: the words of the benchmark, with their number of places in the whole corpus.
3. Anchors: each window (13 consecutive item words) keeps its rarest terms; an item position is an anchor if it
   is among the rarest of some window.
4. Postings (term, document, position) of the anchor terms are stored: the positional inverted index.
5. Intersection: postings meet anchors on the term; the difference of the positions names a diagonal
   (document, item, shift). A diagonal stays if all anchors of some window lie on it.
6. Verification: on each remaining diagonal the document's words are compared with the item's; runs of at
   least a window are exact phrase matches, diagonals without such a run are proximity matches.

Postings carry no text and are as many as the corpus has places of anchor terms; no group is collected. What comes
of the benchmark is broadcast only if the benchmark's own bytes, which are summed first, are few; else the joins
shuffle, with the places of a term or an anchor dealt over SALTS tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, stash

WINDOW = 13
#: The rarest terms that each window is looked up by.
ANCHORS = 2
#: The benchmark's words are broadcast up to so many bytes; all that is derived of them is a small multiple.
BROADCAST_BYTES = 8 << 20
#: Documents with candidates are broadcast, to pick their words, up to so many (of two numbers each).
BROADCAST_DOCS = 100_000
SALTS = 16
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK), lambda w: w != "")


def _is_small(items: DataFrame) -> bool:
    """Whether the words of all items, each with 32 bytes of its own, are within BROADCAST_BYTES."""
    size = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 32)
    return (items.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def _meet(places: DataFrame, terms: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Inner join of many places with what comes of the benchmark; without a broadcast, hot keys are salted."""
    if small:
        return places.join(F.broadcast(terms), keys)
    salted = terms.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = places.withColumn("__salt", F.pmod(F.xxhash64("doc_key", *[c for c in ("pos",) if c in places.columns]), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*keys, "__salt"]).drop("__salt")


def item_words(items: DataFrame) -> DataFrame:
    """item_key, item_id, words, size (of a window: at most WINDOW, less in short items); items without words go."""
    rows = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    return rows.select(F.xxhash64("item_id", "words").alias("item_key"), "item_id", "words", F.least(F.size("words"), F.lit(WINDOW)).alias("size"))


def _places(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_key", F.posexplode("words").alias("pos", "term"))


def find_matches(tokens: DataFrame, items: DataFrame) -> DataFrame:
    """Matches of tokens(doc_key, words) with items from item_words(); both are read several times and so stored.

    doc_key, item_id, shift, kind ('phrase' or 'proximity'), start, length: a phrase is a longest run of equal
    words, at least a window long; a proximity match is a diagonal on which a window's rarest terms stand in
    place, but no whole window; it spans the item.
    """
    small = _is_small(items)
    item_places = items.select("item_key", "size", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))
    vocabulary = item_places.select("term").distinct()
    frequency = _meet(_places(tokens), vocabulary, ["term"], small).groupBy("term").agg(F.count("*").alias("places"))
    # windows by their rarest terms; a term that the corpus lacks rules its windows out
    starts = item_places.select("item_key", "size", "n", "at", "term").join(frequency, "term", "left")
    starts = starts.withColumn("start", F.explode(F.sequence(F.greatest(F.col("at") - F.col("size") + 1, F.lit(0)), F.least("at", F.col("n") - F.col("size")))))
    rarest = Window.partitionBy("item_key", "start").orderBy(F.coalesce("places", F.lit(0)), "at")
    anchors = starts.withColumn("rank", F.row_number().over(rarest)).filter(F.col("rank") <= ANCHORS)
    whole = Window.partitionBy("item_key", "start")
    anchors = anchors.withColumn("needed", F.count("*").over(whole)).withColumn("dead", F.max(F.col("places").isNull()).over(whole)).filter(~F.col("dead"))
    anchors = stash(anchors.select("item_key", "start", "at", "term", F.expr("shiftleft(1, rank - 1)").alias("bit"), F.expr("cast(shiftleft(1, cast(needed as int)) - 1 as int)").alias("needed")), "anchors")

    anchor_places = anchors.select("term", "item_key", "at").distinct()
    postings = stash(_meet(_places(tokens), anchor_places.select("term").distinct(), ["term"], small), "postings")
    on_diagonal = _meet(postings, anchor_places, ["term"], small).select("doc_key", "item_key", (F.col("pos") - F.col("at")).alias("shift"), "at")
    # whole windows of anchors: one bit for each anchor, so that repeated rows of a document count once
    by_window = _meet(on_diagonal, anchors.select("item_key", "start", "at", "bit", "needed"), ["item_key", "at"], small)
    full = by_window.groupBy("doc_key", "item_key", "shift", "start", "needed").agg(F.bit_or("bit").alias("got")).filter(F.col("got") == F.col("needed"))
    diagonals = stash(full.select("doc_key", "item_key", "shift").distinct(), "diagonals")

    texts = tokens.select("doc_key", F.col("words").alias("doc_words"))
    wanted = diagonals.select("doc_key").distinct()
    if wanted.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS:
        texts = texts.join(F.broadcast(wanted), "doc_key", "left_semi")
    met = _meet(diagonals.join(texts, "doc_key"), items, ["item_key"], small)
    # runs of equal words: the breaks are the positions where the words differ, with one before and one after
    differs = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda j: ~F.coalesce(F.get(F.col("doc_words"), j + F.col("shift").cast("int")) == F.get(F.col("words"), j), F.lit(False)))
    breaks = F.concat(F.array(F.lit(-1)), differs, F.array(F.size("words")))
    met = met.select("doc_key", "item_id", "shift", "size", F.size("words").alias("n"), breaks.alias("b"))
    runs = F.zip_with(F.slice("b", 1, F.size("b") - 1), F.slice("b", 2, F.size("b") - 1), lambda a, b: F.struct((a + 1).alias("at"), (b - a - 1).alias("length")))
    phrases = F.filter(runs, lambda r: r["length"] >= F.col("size"))
    met = met.select("doc_key", "item_id", "shift", "n", phrases.alias("phrases"))
    near = F.array(F.struct(F.lit(0).alias("at"), F.col("n").alias("length")))
    met = met.select("doc_key", "item_id", "shift", F.when(F.size("phrases") > 0, "phrase").otherwise("proximity").alias("kind"), F.explode(F.when(F.size("phrases") > 0, F.col("phrases")).otherwise(near)).alias("r"))
    return met.select("doc_key", "item_id", "shift", "kind", (F.col("r.at") + F.col("shift")).cast("long").alias("start"), F.col("r.length").cast("long").alias("length"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and doc_key, which repeated rows share and rows of other texts do not."""
    return docs.select("doc_id", "text").withColumn("doc_key", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = 0.05) -> DataFrame:
    """The columns of decontaminate() and doc_key, which tells apart the rows that share a doc_id or have none."""
    tokens = stash(keyed(docs).select("doc_id", "doc_key", words_of(F.col("text")).alias("words")), "tokens")
    items = stash(item_words(benchmark), "items")
    matches = find_matches(tokens, items)
    phrases = stash(matches.filter(F.col("kind") == "phrase").select("doc_key", "item_id", "start", (F.col("start") + F.col("length")).alias("stop")).distinct(), "phrases")
    before = F.max("stop").over(Window.partitionBy("doc_key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    spans = phrases.select("doc_key", "start", "stop").distinct()
    hits = spans.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("doc_key").agg(F.sum(F.greatest(F.col("stop") - F.greatest("start", "before"), F.lit(0))).alias("n_hit"))
    ids = phrases.select("doc_key", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    names = ids.groupBy("doc_key").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("names"))
    found = hits.join(names, "doc_key")
    counted = tokens.select("doc_id", "doc_key", F.size("words").cast("long").alias("n_words"))
    out = counted.join(found.withColumnRenamed("doc_key", "found_key"), F.col("doc_key").eqNullSafe(F.col("found_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "doc_key", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit >= F.lit(share) * F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = 0.05) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs(doc_id, text, ...).

    A document word within any occurrence of an item window counts once, whatever the number of items.
    contaminated: n_hit > 0 and n_hit >= share * n_words. Null and empty texts have no words and no hits; an
    item without words matches nothing; repeated rows of documents or items change no count (repeated rows
    give repeated results); null ids are kept, a null item_id counts as an item with an empty id; other
    columns are ignored; no rows give no rows.
    """
    return contamination(docs, benchmark, share).drop("doc_key")
