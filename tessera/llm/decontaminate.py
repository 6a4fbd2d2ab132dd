"""Benchmark decontamination by a positional inverted index, with DataFrame operations only.

1. Index: the postings (term, document, position) of every document word that the test items use,
   written to the shared folder in document order, each document's behind a row that tells its number
   of words.
2. The terms of each test window are ranked by how often they occur in the index.
3. Exact matches: the list of the rarest term, shifted by its place in the item, gives alignments of
   the item with a document; it is intersected with the equally shifted list of the next rarest term of
   the window. What is left is intersected with the lists of all terms of the windows concerned; runs
   of a window's length or more are exact phrases.
4. Proximity matches (``near_items``): of a window of w words at least ``near`` stand in a document at
   their places or up to ``slack`` words from them, but the whole window doesn't. As w - near words may
   be missing, one of the w - near + 1 rarest terms of such a window is there; terms that no document
   has are missing anyway and make that number smaller. The lists of these terms give the alignments,
   which are intersected with the lists of all the window's terms.

A window with a term that no document has is dropped from exact matching before any list is read. Terms
of test items and their anchors are broadcast while they are at most ``broadcast_rows`` (of under 100
bytes each); beyond that the same joins are shuffled. Joins with postings are on (document, position,
term), so that neither a common word nor a common passage gathers in one task; only the tables of the
items, which are as large as the benchmark, are joined on terms and items alone.

Null texts have no words and are never hit; null ids of documents match nothing. Repeated identical
rows each get their row. Empty tables on either side give no hits; further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import keep
from tessera.llm.lines import ascii_lower

#: A word: ASCII letters and digits and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Stands behind the last word of a document: no word is a space.
_END = " "


class Index(NamedTuple):
    """``items``: item_id, item, ipos, word, term; ``postings``: doc_id, pos, term of item words, and with
    the term ``end`` a row for each row of the documents whose pos is its number of words."""

    items: DataFrame
    postings: DataFrame
    end: int


class Matches(NamedTuple):
    """``hits``: doc_id, n_hit, item_ids of exact matches; ``spans``: doc_id, item_id, shift, first
    and last document word of each exact run."""

    hits: DataFrame
    spans: DataFrame


def raw_words(text: Column) -> Column:
    """Words of a text, A-Z matched but not yet lower-cased."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD.replace(r"\x60", r"\x40\x5B-\x60")), F.lit(0))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def build_index(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", broadcast_rows: int = 1_000_000
) -> Index:
    """The postings of all item words, and the items' words; the documents are read once."""
    item_words, _ = keep(
        items.select(
            F.col(item_id).alias("item_id"),
            F.xxhash64(item_id, text).alias("item"),
            F.posexplode(raw_words(F.col(text))).alias("ipos", "raw"),
        )
        .select("item_id", "item", "ipos", ascii_lower(F.col("raw")).alias("word"))
        .select("item_id", "item", "ipos", "word", F.xxhash64("word").alias("term"))
        .distinct(),
        "item-words",
    )
    end = docs.sparkSession.range(1).select(F.lit(_END).alias("word"), F.xxhash64(F.lit(_END)).alias("term"))
    vocabulary = _bounded(item_words.select("word", "term").distinct().union(end), broadcast_rows)
    words = F.concat(raw_words(F.col(text)), F.array(F.lit(_END)))
    postings, _ = keep(
        docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(words).alias("pos", "raw"))
        .select("doc_id", "pos", ascii_lower(F.col("raw")).alias("word"))
        .join(vocabulary, "word")
        .select("doc_id", "pos", "term"),
        "postings",
    )
    return Index(item_words, postings, end.first()["term"])


def _sized(index: Index, window: int) -> DataFrame:
    """The items' words with their numbers of words (len) and the lengths of their windows (w)."""
    lengths = index.items.groupBy("item").agg((F.max("ipos") + 1).alias("len"))
    return index.items.join(lengths, "item").withColumn("w", F.least("len", F.lit(window)))


def _in_windows(index: Index, sized: DataFrame) -> DataFrame:
    """Each word of each window (item, start), with the number n of its postings."""
    counts = index.postings.groupBy("term").agg(F.count("*").alias("n"))
    # Windows that a word belongs to start between these two.
    starts = F.sequence(F.greatest(F.lit(0), F.col("ipos") - F.col("w") + 1), F.least("ipos", F.col("len") - F.col("w")))
    return sized.withColumn("start", F.explode(starts)).join(counts, "term", "left")


def find_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    window: int = 10,
    broadcast_rows: int = 1_000_000,
    index: Index | None = None,
) -> Matches:
    """Where windows of ``window`` item words (all words of a shorter item) occur in documents."""

    def bounded(df: DataFrame) -> DataFrame:
        return _bounded(df, broadcast_rows)

    index = index or build_index(docs, items, doc_id, item_id, text, broadcast_rows)
    postings, sized = index.postings, _sized(index, window)
    in_windows = _in_windows(index, sized)
    ranked = in_windows.groupBy("item", "start").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"),
        F.slice(F.sort_array(F.collect_list(F.struct("n", "ipos", "term"))), 1, 2).alias("rare"),
        F.first("w").alias("w"),
    ).filter(F.col("least") > 0)
    windows, _ = keep(
        ranked.select(
            "item", "start", "w", F.col("rare")[0]["ipos"].alias("p1"), F.col("rare")[0]["term"].alias("t1"),
            F.coalesce(F.get("rare", F.lit(1))["ipos"], F.col("rare")[0]["ipos"]).alias("p2"),
            F.coalesce(F.get("rare", F.lit(1))["term"], F.col("rare")[0]["term"]).alias("t2"),
        ),
        "windows",
    )

    anchors = bounded(windows.select("item", "p1", F.col("t1").alias("term"), "p2", "t2").distinct())
    aligned = postings.join(anchors, "term").select(
        "doc_id", "item", (F.col("pos") - F.col("p1")).alias("shift"), "p1", "p2", "t2"
    )
    seconds = bounded(windows.select(F.col("t2").alias("term")).distinct())
    second_lists = postings.join(seconds, "term", "left_semi").select(
        "doc_id", F.col("pos").alias("_pos"), F.col("term").alias("t2")
    )
    both = (
        aligned.withColumn("_pos", F.col("shift") + F.col("p2"))
        .join(second_lists, ["doc_id", "_pos", "t2"], "left_semi")
        .select("doc_id", "item", "shift", "p1")
        .distinct()
    )
    alignments, _ = keep(both, "alignments")

    # All words of the windows whose rarest term is at p1.
    reach = windows.groupBy("item", "p1").agg(F.min("start").alias("lo"), F.max(F.col("start") + F.col("w") - 1).alias("hi"))
    wanted = sized.select("item", "item_id", "ipos", "term", "w").join(reach, "item").filter("ipos between lo and hi")
    needed = bounded(wanted.select("item", "item_id", "p1", "ipos", "term", "w").distinct())
    expected = (
        alignments.join(needed, ["item", "p1"])
        .select("doc_id", "item", "item_id", "w", "shift", "ipos", (F.col("shift") + F.col("ipos")).alias("pos"), "term")
        .filter("pos >= 0")
        .distinct()
    )
    of_docs = postings.join(bounded(alignments.select("doc_id").distinct()), "doc_id", "left_semi")
    in_place, _ = keep(expected.join(of_docs, ["doc_id", "pos", "term"], "left_semi"), "in-place")

    alignment = Window.partitionBy("doc_id", "item", "shift")
    runs = (
        in_place.withColumn("run", F.col("ipos") - F.row_number().over(alignment.orderBy("ipos")))
        .groupBy("doc_id", "item", "item_id", "shift", "run")
        .agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("w").alias("w"))
    )
    spans = runs.filter(F.col("last") - F.col("first") + 1 >= F.col("w")).select("doc_id", "item_id", "shift", "first", "last")
    # Overlapping spans of a document count each word once.
    upto = Window.partitionBy("doc_id").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.withColumn("before", F.coalesce(F.max("last").over(upto), F.lit(-1)))
    hits = fresh.groupBy("doc_id").agg(
        F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.col("before") + 1) + 1)).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("item_ids"),
    )
    return Matches(hits, spans)


def near_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    window: int = 10,
    near: int = 8,
    slack: int = 1,
    broadcast_rows: int = 1_000_000,
    index: Index | None = None,
) -> DataFrame:
    """doc_id, item_id, start (of the window in the item), shift (the least document word less item word),
    in_place (the most words in place): windows that are near, but not whole, in a document."""
    index = index or build_index(docs, items, doc_id, item_id, text, broadcast_rows)
    words = _in_windows(index, _sized(index, window)).filter(F.col("w") >= near)
    # Absent terms are missing; of the others the rarest, one more than may be missing besides.
    place = Window.partitionBy("item", "start").orderBy("n", "ipos")
    absent = F.count_if(F.col("n").isNull()).over(Window.partitionBy("item", "start"))
    present = words.withColumn("absent", absent).filter("n is not null").withColumn("nth", F.row_number().over(place))
    seeds = _bounded(
        present.filter(F.col("nth") <= F.col("w") - near + 1 - F.col("absent")).select("item", "start", "ipos", "term").distinct(), broadcast_rows
    )
    aligned, _ = keep(
        index.postings.join(seeds, "term").select("doc_id", "item", "start", (F.col("pos") - F.col("ipos")).alias("shift")).distinct(), "near-alignments"
    )
    parts = _bounded(present.select("item", "item_id", "start", "w", "ipos", "term").distinct(), broadcast_rows)
    shifts = F.explode(F.sequence(F.lit(-slack), F.lit(slack))).alias("by")
    expected = (
        aligned.join(parts, ["item", "start"])
        .select("doc_id", "item", "item_id", "start", "w", "shift", "ipos", "term", shifts)
        .withColumn("pos", F.col("shift") + F.col("ipos") + F.col("by"))
        .filter("pos >= 0")
    )
    there = expected.join(index.postings, ["doc_id", "pos", "term"], "left_semi")
    counted = there.groupBy("doc_id", "item", "item_id", "start", "w", "shift").agg(
        F.count_distinct("ipos").alias("in_place"), F.count_if(F.col("by") == 0).alias("exact")
    )
    best = counted.groupBy("doc_id", "item", "item_id", "start", "w").agg(
        F.max("in_place").alias("in_place"), F.max("exact").alias("exact"), F.min_by("shift", F.struct(-F.col("in_place"), "shift")).alias("shift")
    )
    return best.filter((F.col("in_place") >= near) & (F.col("exact") < F.col("w"))).select("doc_id", "item_id", "start", "shift", "in_place")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids, contaminated for every document."""
    index = build_index(docs, items, doc_id=doc_id, text=text, **{k: v for k, v in how.items() if k in ("item_id", "broadcast_rows")})
    hits = find_items(docs, items, index=index, **{k: v for k, v in how.items() if k != "item_id"}).hits.withColumnRenamed("doc_id", "_hit_doc")
    sizes = index.postings.filter(F.col("term") == index.end).select("doc_id", F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return sizes.join(hits, F.col("doc_id") == F.col("_hit_doc"), "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (n_hit > 0).alias("contaminated"),
    )
