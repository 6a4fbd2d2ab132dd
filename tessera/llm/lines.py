"""Line deduplication over a corpus, with DataFrame operations only.

Lines become 128-bit hashes of their keys (stripped, A-Z lower-cased). The hashes are partitioned by
range and sorted by document and position within them; one streaming pass over each range sees the
lines of a key one after the other, the keeping document first. What comes back is a compressed
bitmap of kept lines for each document that loses any, never text.

A key with ``heavy_rows`` lines or more would fill a range by itself. Such keys are found by a count
that is pre-aggregated before it is shuffled, and resolved without gathering their lines: their
keeper is a pre-aggregated maximum, joined back to the lines. That join is broadcast while the heavy
keys are few (``broadcast_rows`` at most) and a skew-splitting shuffle join beyond.

A null or empty text is one empty line. A null id counts as a document, smaller than all others.
Rows that repeat an id are one document of that id when documents are counted, and share its bitmap
only if their lines are the same; an id should therefore be unique. Empty tables give no rows. Further
columns pass through ``dedup_lines`` whatever their names, but n_lines and n_dropped, which are its own. The lines of one text stay in one row: a text of any length works that
a row can hold.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import fresh, keep, without

#: What is stripped from both ends of a line.
SPACES = " \t\n\x0b\f\r"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; the quick way for texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_bitmaps(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    heavy_rows: int = 2000,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """doc_id, n_dropped, keep for each document that loses lines.

    ``keep`` has an entry (word, bits) for each 64 lines of which some go: bit i of ``bits`` is 1 if
    line 64 * word + i stays. A key of ``min_chars`` code points or more that ``min_docs`` documents
    or more hold loses its lines except in the document of the largest id.
    """
    exploded = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    keys = exploded.select("doc_id", "pos", F.btrim("line", F.lit(SPACES)).alias("k")).filter(F.length("k") >= min_chars)
    lower = ascii_lower(F.col("k"))
    hashed = keys.select(
        F.xxhash64(lower).alias("h1"), F.xxhash64(F.lit(1), lower).alias("h2"), "doc_id", "pos"
    )
    lines, _ = keep(hashed, "lines")

    heavy, _ = keep(lines.groupBy("h1", "h2").count().filter(F.col("count") >= heavy_rows).select("h1", "h2"), "heavy-lines")
    small = heavy.count() <= broadcast_rows
    marked = F.broadcast(heavy) if small else heavy

    # Light keys: range partitions, secondary sort, one pass.
    light = (
        lines.join(marked, ["h1", "h2"], "left_anti")
        .repartitionByRange("h1", "h2")
        .sortWithinPartitions("h1", "h2", F.desc_nulls_last("doc_id"), "pos")
    )
    key = Window.partitionBy("h1", "h2")
    first = key.orderBy(F.desc_nulls_last("doc_id"), "pos")
    streamed = light.select(
        "doc_id",
        "pos",
        F.dense_rank().over(key.orderBy(F.desc_nulls_last("doc_id"))).alias("nth"),
        F.first(F.struct("doc_id")).over(first).alias("keeper"),
        "h1",
        "h2",
    ).withColumn("n_docs", F.max("nth").over(key))
    dropped = streamed.filter((F.col("n_docs") >= min_docs) & (F.col("nth") > 1)).select("doc_id", "pos")

    # Heavy keys: number of documents and keeper by pre-aggregation.
    hot = lines.join(marked, ["h1", "h2"])
    docs_of = hot.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    kept = docs_of.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs)
    kept = F.broadcast(kept) if small else kept
    hot_dropped = lines.join(kept, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "pos")

    word = F.floor(F.col("pos") / 64).cast("int")
    bits = dropped.unionByName(hot_dropped).groupBy("doc_id", word.alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, pos % 64))").alias("gone")
    )
    return bits.groupBy("doc_id").agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"),
    )


def kept_text(text: Column, keep_bits: Column) -> Column:
    """The lines of ``text`` whose bit is set, joined; all lines where ``keep_bits`` is null."""
    words = F.map_from_entries(keep_bits)
    top = F.element_at(keep_bits, -1)["word"]
    dense = F.transform(F.sequence(F.lit(0), top), lambda w: F.coalesce(F.element_at(words, w), F.lit(-1).cast("long")))
    # The bitmap is laid out once, as a struct field, and read by position.
    laid = F.transform(F.array(F.struct(dense.alias("d"), split_lines(text).alias("ls"))), _kept)
    return F.when(keep_bits.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(laid[0], "\n"))


def _kept(x: Column) -> Column:
    def stays(_: Column, i: Column) -> Column:
        bits = F.coalesce(F.get(x["d"], F.floor(i / 64).cast("int")), F.lit(-1).cast("long"))
        return F.call_function("shiftrightunsigned", bits, i % 64).bitwiseAND(F.lit(1).cast("long")) == 1

    return F.filter(x["ls"], stays)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """``docs`` with n_lines, n_dropped and ``text`` without the lines that go; all rows stay."""
    of, bits, gone = fresh(docs, "line_doc", "line_keep", "line_dropped")
    found = line_bitmaps(docs, doc_id, text, **how).select(F.col("doc_id").alias(of), F.col("keep").alias(bits), F.col("n_dropped").alias(gone))
    joined = docs.join(found.hint("shuffle_hash"), F.col(doc_id).eqNullSafe(F.col(of)), "left")
    return joined.select(
        *[kept_text(F.col(text), F.col(bits)).alias(c) if c == text else F.col(c) for c in without(docs, "n_lines", "n_dropped")],
        F.size(split_lines(F.col(text))).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"),
    )
