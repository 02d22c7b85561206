"""Exact deduplication by an extendible-hash index kept in shared files.

``records`` holds a 64-bit hash and the digest of each normalised text. A directory addresses the index by the top bits
of the hash: an overfull bucket is split, and the directory doubles when a bucket has used up its depth. How many
different hashes fall where is estimated by sketches over fine cells, so nothing is counted twice. Each row's hash is
looked up in the directory and inserted in its bucket, rows of one hash being added up in each task first; owners, tasks
that hold runs of buckets, that is, ranges of the key, sort and write the index. Only rows that find an entry with
several rows there bring their texts: copies are compared byte for byte and combined, in each task first, so a text with
very many copies travels once from each, and the key's owner chains the different texts that are left under one hash.

Defined cases: null text is the empty text; rows with a null id take part, and a group of only such rows
keeps null; rows that repeat an id have one identity, so if it stays, all of them are marked kept; other
columns are neither read nor returned, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.llm.shared import discard, keep_rows, materialize, named, partitions, sized_join, spread
from rasterweave.llm.textfn import ascii_lower, filled

#: Entries that a bucket of the index holds before it is split: so many, or, in a larger index, its share of the entries
#: of as many buckets. The directory's greatest depth; a bucket at that depth grows instead, so there are at most
#: 2 ** MAX_DEPTH slots, whatever the input.
BUCKET_ENTRIES, MOST_BUCKETS, MAX_DEPTH = 256, 8_192, 14
#: Ranges of the key for each partition, so that hashing them to partitions deals evenly.
OWNERS_EACH = 4


def build_directory(counts: dict[int, int], capacity: int, max_depth: int) -> list[tuple[int, int, int]]:
    """Slots (slot, bucket, local depth) of the directory over 2 ** max_depth fine cells with their entry counts.

    Starts with one bucket; splits any bucket above ``capacity`` by one more bit, doubling the directory when the
    bucket's local depth has reached the global depth. A bucket is named by the first fine cell of its range.
    """
    cells = 1 << max_depth
    below = [0] * (cells + 1)
    for i in range(cells):
        below[i + 1] = below[i] + counts.get(i, 0)
    depth, done, todo = 0, [], [(0, 0)]
    while todo:
        prefix, local = todo.pop()
        width = cells >> local
        start = prefix * width
        if local < max_depth and below[start + width] - below[start] > capacity:
            depth = max(depth, local + 1)
            todo += [(prefix * 2, local + 1), (prefix * 2 + 1, local + 1)]
        else:
            done.append((start, local))
    slots = []
    for start, local in sorted(done):
        first = start >> (max_depth - depth)
        slots += [(first + k, start, local) for k in range(1 << (depth - local))]
    return slots


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, key (the text's 64-bit hash).

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest id stays. ``capacity``: entries of a
    bucket; None: by the rule of ``BUCKET_ENTRIES``.
    """
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    texts = spread(docs).select(named(id_col).alias("doc_id"), ascii_lower(filled(named(text_col))).alias("norm")).withColumn("key", F.xxhash64("norm"))
    records = materialize(texts.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "dedup-records")

    cell = F.shiftrightunsigned("key", 64 - max_depth).cast("int")
    counts = {r["cell"]: r["n"] for r in records.groupBy(cell.alias("cell")).agg(F.approx_count_distinct("key", 0.05).alias("n")).collect()}
    slots = build_directory(counts, capacity or max(BUCKET_ENTRIES, sum(counts.values()) // MOST_BUCKETS), max_depth)
    buckets = sorted({b for _, b, _ in slots})
    owners = min(len(buckets), OWNERS_EACH * parts)
    owner = {b: k * owners // len(buckets) for k, b in enumerate(buckets)}
    directory = spark.createDataFrame([(s, b, owner[b]) for s, b, _ in slots], "slot int, bucket int, owner int").coalesce(1)
    depth = (len(slots) - 1).bit_length()

    def located(rows: DataFrame) -> DataFrame:
        """``rows`` with bucket and owner of their key."""
        slot = F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)
        return rows.withColumn("slot", slot).join(F.broadcast(directory), "slot").drop("slot")

    entries = located(records).groupBy("owner", "bucket", "key").agg(F.count(F.lit(1)).alias("n_rows"))
    index = materialize(entries.repartition(parts, "owner").sortWithinPartitions("bucket", "key"), "dedup-index")

    found = sized_join(located(texts), index.filter("n_rows > 1").select("bucket", "key"), ["bucket", "key"], "inner")
    combined = found.groupBy("owner", "bucket", "key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    combined = combined.select("owner", "bucket", "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size").repartition(parts, "owner")
    place = F.row_number().over(Window.partitionBy("owner", "bucket", "key").orderBy("text_sha256"))
    chains = materialize(combined.withColumn("place", place), "dedup-chains")
    discard(index)

    out = sized_join(records, chains.select("key", "text_sha256", "keep_id", "group_size", "place"), ["key", "text_sha256"], "left")
    keep = F.when(F.col("place").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "key"
    )


def text_key(text_col: str = "text") -> Column:
    return F.xxhash64(ascii_lower(filled(named(text_col))))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row keeps; of rows that repeat an id and a text one stays."""
    decided = materialize(exact_dedup(docs).select("doc_id", "key", "kept"), "dedup-decided")
    several = decided.filter("kept").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return keep_rows(docs, text_key(), decided.filter("not kept").select("doc_id", "key").distinct(), several)
