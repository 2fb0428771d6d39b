"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores a posting (term, document, position) for every word of the training texts that the test terms can
ask for. ``phrase_candidates`` takes for every window of a benchmark item its rarest terms by their counts over all
documents, shifts their postings by the terms' places in the item and intersects them, which leaves the alignments
(document, item, shift) where the window may occur; ``exact_hits`` compares the words there. ``proximity_matches``
intersects the same lists after cutting positions into cells.

Candidates carry numbers of items, never words; only texts that have a candidate are cut into words for the comparison, and only the words that
an item would cover are compared. The index knows each text's number of words, so that the report is a join of numbers and no text is
read for it again.

The index is stored by document, so building it shuffles nothing, and looking it up joins it with the few anchor terms
of the benchmark. Frequent terms are not anchors unless a window has nothing rarer, and the joins' large side may then be
split by adaptive execution: the other side has a row for each window at most.

Words: A-Z in lower case, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. Edge cases: null or empty texts have no words,
items without words no windows, an item of fewer than 13 words is one window; rows that repeat a doc_id are judged by their
own texts; item ids may repeat (an id is hit if any of its texts is) or be null (counted, rendered as an empty string);
empty tables give empty results; extra columns aren't read by the report and pass through ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import fresh, small, store, temporary

WINDOW = 13
ANCHORS = 2
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands after the last word of every text in the index, where its position is the number of words; no word is empty.
END = ""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z alone in lower case; ``lower`` does that for texts in which it changes nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """Words in order: the text is cut at what no word has, which is half the work of finding each word."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), "")


def item_words(benchmark: DataFrame) -> DataFrame:
    """item (a number of ours), item_id, words of every item that has any."""
    out = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    return store(out.select(F.monotonically_increasing_id().alias("item"), "item_id", "words"), "items")


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings (doc_id, text_hash, term, pos) of ``docs``, of the words in ``terms`` (term) alone if given; and each row's END."""
    words = F.concat(words_of(F.col("text")), F.array(F.lit(END)))
    postings = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(words).alias("pos", "term"))
    with temporary():
        if terms is not None:
            wanted = store(terms.select("term").union(docs.sparkSession.range(1).select(F.lit(END))).distinct(), "indexed-terms")
            postings = postings.join(small(wanted), "term", "left_semi")
        return store(postings.select("doc_id", "text_hash", "term", "pos"), "postings", keep=True)


def lengths(index: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words): one row for each row that was indexed."""
    return index.where(F.col("term") == END).select("doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))


def term_counts(index: DataFrame) -> DataFrame:
    return store(index.where(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "terms")


def window_anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """(item, lists, term, shift, pair): the rarest places of every window of every item; ``pair`` names their set.

    Windows with a word that no document has are left out: they can't occur.
    """
    n = F.size("words")
    starts = items.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("w"))
    places = starts.select("item", "w", F.size(F.slice("words", F.col("w") + 1, window)).alias("size"), F.posexplode(F.slice("words", F.col("w") + 1, window)).alias("o", "term"))
    known = places.join(small(counts), "term")
    order = Window.partitionBy("item", "w").orderBy("n", F.col("w") + F.col("o"))
    ranked = known.withColumn("rank", F.row_number().over(order)).withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("item", "w")))
    best = ranked.where((F.col("found") == F.col("size")) & (F.col("rank") <= anchors))
    sets = best.groupBy("item", "w").agg(F.array_sort(F.collect_list(F.struct((F.col("w") + F.col("o")).alias("shift"), "term"))).alias("set"))
    sets = sets.select("item", "set").distinct().withColumn("pair", F.monotonically_increasing_id())
    return store(sets.select("item", "pair", F.size("set").alias("lists"), F.inline("set")), "anchors")


def phrase_candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item, at): documents in which all anchors of a window stand as they do in the item.

    ``at``: where the item's first word would be in the document (it may be below zero).
    """
    found = index.join(small(anchors), "term").select("doc_id", "text_hash", "item", "pair", "lists", (F.col("pos") - F.col("shift")).alias("at"), "shift")
    both = found.groupBy("doc_id", "text_hash", "item", "pair", "lists", "at").agg(F.count_distinct("shift").alias("n"))
    return both.where("n = lists").select("doc_id", "text_hash", "item", "at").distinct()


def exact_hits(docs: DataFrame, items: DataFrame, candidates: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, item_id, places) of candidates (stored) that hold: the document's places in occurring windows of the item.

    A text with many candidates is cut into words once; a row of the comparison holds no more words than its item.
    """
    texts = candidates.select("doc_id", "text_hash").distinct()
    texts = store(texts, "candidate-texts")
    own = docs.select(F.col("doc_id").alias("doc_"), F.xxhash64("text").alias("hash_"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("doc_")) & (F.col("text_hash") == F.col("hash_"))
    # rows that repeat a document have the same words, so that one of them is enough
    words = own.join(small(texts), same).groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    words = store(words.select(F.col("doc_id").alias("doc_"), F.col("text_hash").alias("hash_"), words_of(F.col("text")).alias("said")), "candidate-words")
    sized = candidates.join(small(items.select("item", F.size("words").alias("n")), items), "item")
    lead = F.greatest(-F.col("at"), F.lit(0))  # words of the item that would stand before the text
    covered = F.slice("said", F.greatest(F.col("at"), F.lit(0)) + 1, F.greatest(F.col("n") - lead, F.lit(0)))
    pieces = sized.join(small(words), same).select("doc_id", "text_hash", "item", "at", lead.alias("lead"), covered.alias("said"))
    both = pieces.join(small(items), "item")
    n, width = F.size("words"), F.least(F.size("words"), F.lit(window))
    flags = F.array_join(F.transform("words", lambda w, i: F.when(F.coalesce((i >= F.col("lead")) & (F.get("said", i - F.col("lead")) == w), F.lit(False)), F.lit("1")).otherwise(F.lit("0"))), "")
    flagged = both.select("doc_id", "text_hash", "item_id", "at", width.alias("width"), n.alias("n"), flags.alias("flags"))
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - F.col("width")), lambda i: F.substring(F.col("flags"), i + 1, F.col("width")) == F.repeat(F.lit("1"), F.col("width")))
    places = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(F.col("at") + i, F.col("at") + i + F.col("width") - 1))))
    return flagged.select("doc_id", "text_hash", "item_id", places.alias("places")).where(F.size("places") > 0)


def hits_by_text(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, places sorted, items sorted as strings) of each text with an occurring window; and ``lengths``. Stored tables."""
    with temporary():
        items = item_words(benchmark)
        index = build_index(docs, items.select(F.explode("words").alias("term")))
        anchors = window_anchors(items, term_counts(index), window)
        candidates = store(phrase_candidates(index, anchors), "candidates")
        found = exact_hits(docs, items, candidates, window)
        of_item = found.select("doc_id", "text_hash", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "places")
        by_text = of_item.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("places")))).alias("places"), F.array_sort(F.collect_set("item_id")).alias("items"))
        return store(by_text, "hits", keep=True), store(lengths(index), "lengths", keep=True)


def _of_text(hits: DataFrame, *columns: Column) -> tuple[DataFrame, Column]:
    """Hits under key names of their own, and the condition that joins them to rows of their text."""
    told = hits.select(F.col("doc_id").alias("doc_"), F.col("text_hash").alias("hash_"), *columns)
    return told, F.col("doc_id").eqNullSafe(F.col("doc_")) & (F.col("text_hash") == F.col("hash_"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, hit places, item ids (sorted as strings), contaminated."""
    hits, rows = hits_by_text(docs.select("doc_id", "text"), benchmark, window)
    told, same = _of_text(hits, "places", "items")
    joined = rows.join(small(told, hits), same, "left")
    out = joined.select("doc_id", "n_words", F.coalesce("places", F.array().cast("array<int>")).alias("places"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    n_hit = F.size("places").cast("long")
    return out.withColumn("contaminated", (n_hit > 0) & (20 * n_hit >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated rows; all columns as they were."""
    with temporary():
        hits, rows = hits_by_text(docs.select("doc_id", "text"), benchmark, window)
        told, same = _of_text(hits, F.size("places").cast("long").alias("n_hit"))
        bad = rows.join(small(told, hits), same).where(20 * F.col("n_hit") >= F.col("n_words"))
        gone = store(bad.select("doc_", "hash_").distinct(), "contaminated", keep=True)
    doc, text_hash = fresh("_doc", docs.columns), fresh("_text_hash", docs.columns)
    keys = gone.select(F.col("doc_").alias(doc), F.col("hash_").alias(text_hash))
    return docs.join(small(keys, gone), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text_hash)), "left_anti")


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(query, doc_id, first, last): places where all terms of a query (query, terms array) stand within ``slop`` words.

    Positions fall into cells of ``slop`` words; a span of at most ``slop`` words lies in one cell or two neighbours, so
    every posting is filed under its cell and the one before, and lists meet by equality of (document, query, cell).
    The result has, for each place where a span may end, the tightest one. Edge cases: empty tables, null texts and null or empty
    term lists give no rows; a null or empty term stands nowhere, so its query matches nothing; repeated terms count once; rows that repeat a document
    give its spans once; ``slop`` must be 1 at least (then only queries of one term match).
    """
    if slop < 1:
        raise ValueError("slop must be 1 or more words")
    wanted = queries.select("query", F.size(F.array_distinct("terms")).alias("lists"), F.explode(F.array_distinct("terms")).alias("term"))
    cell = F.floor(F.col("pos") / slop)
    words = index.where(F.col("term") != END)
    filed = words.join(small(store(wanted, "proximity-terms")), "term").select("doc_id", "text_hash", "query", "lists", "term", "pos", F.explode(F.array(cell, cell - 1)).alias("cell"))
    lists = filed.groupBy("doc_id", "text_hash", "query", "lists", "cell").agg(F.array_sort(F.collect_set(F.struct("pos", "term"))).alias("all"), F.count_distinct("term").alias("n"))
    here = lists.where("n = lists")
    # the tightest span that ends at each posting: the latest place of every term up to it
    ends = F.transform("all", lambda e: F.struct(e["pos"].alias("last"), F.slice("all", F.lit(1), F.array_position("all", e).cast("int")).alias("upto")))
    latest = here.select("doc_id", "text_hash", "query", "lists", F.inline(ends)).select(
        "doc_id", "text_hash", "query", "lists", "last",
        F.aggregate("upto", F.create_map().cast("map<string,int>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["term"]), F.create_map(e["term"], e["pos"]))).alias("where"),
    )
    spans = latest.where(F.size("where") == F.col("lists")).withColumn("first", F.array_min(F.map_values("where")))
    return spans.where(F.col("last") - F.col("first") < slop).select("query", "doc_id", "text_hash", "first", "last").distinct()
