"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows, exact verification.

A text's words are its runs of letters and digits, lower-cased. An item's size says how many edits a passage
of it can bear and still be similar, and so how long a run of its words stays whole in the passage: the
window's size is the largest power of two that such a run must hold when windows begin at every half window
(``window_size``). Every document is cut into such windows, every item into the windows at each of its
words, and each gets a 64-bit SimHash fingerprint of its pairs of neighbouring words. A fingerprint has RADIUS + 1 blocks; two
that differ in RADIUS bits at most have a block in common, so the join on blocks finds all of those, among
them a window of the run that stayed whole. The documents that it finds, and only they, are verified: in
each, windows of the item's full size are laid wherever a shared shingle of five words would put the item's
first word (cut to the document's ends), and the exact weighted Jaccard similarity of the shingles, the
sum of smaller counts over the sum of larger counts, decides.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, only, picked, table

#: Words of a shingle, the least similarity, bits in which fingerprints may differ, and bits of a block.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 2
BLOCK_BITS = 64 // (RADIUS + 1)
#: The largest window.
LARGEST = 32
#: Rows about items up to which they are broadcast (some 30 bytes each); more go through a shuffle join.
BROADCAST_ROWS = 1_000_000


def window_size(length: int, k: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[int, int]:
    """The windows for an item of ``length`` words: how many neighbouring features, and words of a feature.

    A feature is a pair of words (one word for items of one): single words would let a few frequent ones
    decide the fingerprint. A similar window holds at least ``similarity`` of the item's shingles, and an
    edit within the passage costs k - 1 of them at least. So of the runs between edits the longest has a
    certain length, and windows of w features at every max(1, w / 2) have one inside it if w + max(1, w / 2)
    - 1 is no more than its features.
    """
    n = length - k + 1
    lost = n - math.ceil(n * similarity - 1e-9)
    run = length
    for edits in range(lost // max(1, k - 1) + 1):
        rest = n - (lost if edits == 0 else edits * (k - 1))
        run = min(run, -(-rest // (edits + 1)) + k - 1)
    span = min(2, length)
    size = 1
    while 2 * size <= LARGEST and 2 * size + size - 1 <= run - span + 1:
        size *= 2
    return size, span


def word_list(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_list(words: Column, k: int) -> Column:
    """Hashes of all runs of k words; none for a list of fewer."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    run = lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k)))
    return F.when(F.size(words) >= k, F.transform(at, run)).otherwise(F.array().cast("array<bigint>"))


def added(x: list[Column], y: list[Column]) -> list[Column]:
    """The sum, for each bit of a hash, of two numbers given by their binary digits: longs of 64 digits each."""
    out, carry = [], None
    for a, b in zip(x, y):
        half, both = a.bitwiseXOR(b), a.bitwiseAND(b)
        out.append(half if carry is None else half.bitwiseXOR(carry))
        carry = both if carry is None else both.bitwiseOR(carry.bitwiseAND(half))
    return [*out, carry]


def simhash(rows: DataFrame, hashes: str, size: int) -> DataFrame:
    """Replace ``hashes``, arrays of ``size`` (a power of two) word hashes, by f: each bit is that of most words.

    The bits are counted for all 64 places at once, by adding neighbouring numbers until one is left; a
    select for each step keeps what is used twice from being computed twice.
    """
    keys = [c for c in rows.columns if c != hashes]
    # numbers that can't be null keep the generated code small, which is compiled only up to some length
    rows = rows.select(*keys, *(F.coalesce(F.get(hashes, F.lit(i)), F.lit(0).cast("long")).alias(f"{hashes}{i}_0") for i in range(size)))
    count, digits = size, 1
    while count > 1:
        number = lambda i: [F.col(f"{hashes}{i}_{d}") for d in range(digits)]  # noqa: E731, B023
        sums = [added(number(2 * i), number(2 * i + 1)) for i in range(count // 2)]
        rows = rows.select(*keys, *(c.alias(f"{hashes}{i}_{d}") for i, planes in enumerate(sums) for d, c in enumerate(planes)))
        count, digits = count // 2, digits + 1
    # more than size / 2: the highest digit, or the next one and any below it
    planes = [F.col(f"{hashes}0_{d}") for d in range(digits)]
    if digits == 1:
        return rows.select(*keys, planes[0].alias("f"))
    if digits == 2:
        return rows.select(*keys, planes[1].alias("f"))
    low = reduce(lambda x, y: x.bitwiseOR(y), planes[:-2])
    return rows.select(*keys, planes[-1].bitwiseOR(planes[-2].bitwiseAND(low)).alias("f"))


def block_list(fingerprint: Column) -> Column:
    """(block, value) of a fingerprint as one number for each block."""
    value = lambda b: F.shiftrightunsigned(fingerprint, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) + F.lit(b << BLOCK_BITS)
    return F.array(*(value(b) for b in range(RADIUS + 1)))


def windows_of(rows: DataFrame, size: int, step: int, span: int) -> DataFrame:
    """``rows`` (w and others) with fingerprint f of each window of ``size`` features at every ``step``."""
    keys = [c for c in rows.columns if c != "w"]
    hashed = rows.select(*keys, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    if span == 2:
        count = F.greatest(F.size("h") - 1, F.lit(0))
        pairs = F.zip_with(F.slice("h", F.lit(1), count), F.slice("h", F.lit(2), count), lambda x, y: F.xxhash64(x, y))
        hashed = hashed.select(*keys, pairs.alias("h"))
    at = F.sequence(F.lit(0), F.floor((F.size("h") - size) / step).cast("int"))
    runs = F.when(F.size("h") >= size, F.transform(at, lambda i: F.slice("h", i * step + 1, F.lit(size))))
    return simhash(hashed.select(*keys, F.explode(runs).alias("h")), "h", size)


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """One row for each document and benchmark item that it holds, with the best window.

    ``docs`` has doc_id and text, ``items`` item_id and text. Columns: doc_id, item_id, start (the
    window's first word), n_words, hamming (the least distance of fingerprints that led to it),
    similarity. Of equally good windows the earliest counts. An item of fewer words than ``k`` is
    compared as one shingle of all its words; items and documents without words match nothing. Repeated items count once; rows that share a doc_id count as one
    document if their texts are equal and are searched apart if not, the best window being reported. Rows
    without a doc_id or a text aren't searched; callers that have such give them a key first.
    """
    length = F.size("w")
    wanted = (
        items.where("item_id IS NOT NULL").distinct()
        .select("item_id", F.xxhash64("item_id", "text").alias("uid"), word_list(F.col("text")).alias("w"))
        .where(length > 0)
        .withColumn("length", length)
        .withColumn("k", F.least("length", F.lit(k)))
    )
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("tid", F.xxhash64("text"))
    # an item of LARGEST * 40 words has the largest window whatever its size; so few lengths come to the driver
    lengths = wanted.select(F.least("length", F.lit(LARGEST * 40)).alias("n"), "k").distinct().collect()
    sizes: dict[tuple[int, int], list[int]] = {}
    for n, own in lengths:
        sizes.setdefault(window_size(n, own, similarity), []).append(n)
    if not sizes:
        return docs.select("doc_id").limit(0).selectExpr(
            "doc_id", "cast(null as long) item_id", "0 start", "0 n_words", "0 hamming", "0D similarity"
        )
    words = texts.select("doc_id", "tid", word_list(F.col("text")).alias("w"))
    of_size = lambda some: F.least("length", F.lit(LARGEST * 40)).isin(some)
    met = reduce(DataFrame.unionAll, (_met(words, wanted.where(of_size(some)), *size) for size, some in sorted(sizes.items())))
    met = cut_lineage(met.groupBy("doc_id", "tid", "uid").agg(F.min("hamming").alias("hamming")))
    held = picked(texts, met.select("tid").distinct(), "left_semi", "tid").dropDuplicates(["doc_id", "tid"])
    held = cut_lineage(held.join(met, ["doc_id", "tid"], "left_semi").select("doc_id", "tid", word_list(F.col("text")).alias("w")))
    parts = [_verified(held, met, wanted.where(F.col("k") == n), n, similarity) for n in sorted({own for _, own in lengths})]
    found = reduce(DataFrame.unionAll, parts)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words", (-F.col("hamming")).alias("near"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.back")).alias("start"), F.col("b.n_words").alias("n_words"),
        (-F.col("b.near")).alias("hamming"), F.col("b.similarity").alias("similarity"),
    )


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _met(words: DataFrame, wanted: DataFrame, size: int, span: int) -> DataFrame:
    """(doc_id, tid, uid, hamming): windows of documents and items whose fingerprints differ in RADIUS bits at most."""
    theirs = windows_of(wanted.select("uid", "w"), size, 1, span).distinct()
    blocks = _small(theirs.select("uid", F.col("f").alias("g"), F.explode(block_list(F.col("f"))).alias("block")))
    ours = windows_of(words, size, max(1, size // 2), span)
    hamming = F.bit_count(F.col("f").bitwiseXOR(F.col("g")))
    near = ours.withColumn("block", F.explode(block_list(F.col("f")))).join(blocks, "block").where(hamming <= RADIUS)
    return near.select("doc_id", "tid", "uid", hamming.alias("hamming"))


def _verified(held: DataFrame, met: DataFrame, wanted: DataFrame, k: int, similarity: float) -> DataFrame:
    """Windows of the items' size in documents that met them, with their exact similarity."""
    shingled = wanted.select("uid", "length", F.posexplode(shingle_list(F.col("w"), k)).alias("place", "h"))
    few = shingled.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    placed = held.select("doc_id", "tid", F.size("w").alias("n"), F.posexplode(shingle_list(F.col("w"), k)).alias("at", "h"))
    starts = placed.join(small(shingled), "h").withColumn(
        "start", F.least(F.greatest(F.col("at") - F.col("place"), F.lit(0)), F.greatest(F.col("n") - F.col("length"), F.lit(0)))
    )
    starts = starts.groupBy("doc_id", "tid", "uid", "length", "start").agg(F.count_distinct("at").alias("hits")).join(met, ["doc_id", "tid", "uid"])
    # a window that reaches the similarity shares that share of the item's shingles with the document
    enough = F.sum("hits").over(Window.partitionBy("doc_id", "tid", "uid")) >= F.ceil((F.col("length") - k + 1) * F.lit(similarity))
    starts = starts.withColumn("enough", enough).where("enough").select("doc_id", "tid", "uid", "length", "start", "hamming")
    windows = starts.join(held, ["doc_id", "tid"]).select(
        "doc_id", "tid", "uid", "start", "hamming", F.slice("w", F.col("start") + 1, F.col("length")).alias("w")
    )
    key = ["doc_id", "tid", "uid", "start", "n_words", "hamming"]
    counted = windows.select(*key[:4], F.size("w").alias("n_words"), "hamming", F.explode(shingle_list(F.col("w"), k)).alias("h"))
    counted = counted.groupBy(*key, "h").agg(F.count(F.lit(1)).alias("c"))
    theirs = shingled.groupBy("uid", "h").agg(F.count(F.lit(1)).alias("d"))
    sums = counted.join(small(theirs), ["uid", "h"], "left").groupBy(*key).agg(
        F.sum(F.least("c", F.coalesce("d", F.lit(0)))).alias("low"), F.sum("c").alias("size")
    )
    about = small(wanted.select("uid", "item_id", (F.col("length") - k + 1).alias("own")))
    value = F.col("low") / (F.col("size") + F.col("own") - F.col("low"))
    return sums.join(about, "uid").withColumn("similarity", value).where(F.col("similarity") >= similarity).select(
        "doc_id", "item_id", "start", "n_words", "hamming", "similarity"
    )


def inputs(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    return only(docs, doc_id="long", text="string"), only(items, item_id="long", text="string")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of ``benchmark``, and the passage."""
    return contaminated(*inputs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
