"""Removal of long byte strings that occur more than once, by two-stage suffix sorting of where they can be.

Every window of ``LENGTH`` bytes of every text counts. What must be compared is found by anchors: of the
quarter-length strings in a window the one with the least hash. Equal windows have equal anchors, so a
window whose anchor's hash occurs once occurs once itself. Windows of one text that share an anchor are
neighbours; the bytes that they cover are the anchor's context.

* A context that occurs twice, with the anchor at the same place in it, is repeated in all its windows.
* Contexts that share an anchor but differ are sorted by suffix: those with one anchor go to one task, many
  anchors to a task, and runs of them of ``CHUNK`` bytes are sorted together by two-stage sorting. Suffixes
  smaller than their successors are sorted directly, seven symbols at a time and only where still tied; the
  others follow from one scan over the buckets of first symbols. Windows whose neighbour in that order has
  ``LENGTH`` first bytes in common are repeated.
* Contexts of an anchor that very many differing ones share don't go to one task: their windows' hashes are
  counted by a grouping that Spark computes partly before it shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, as_text, blocks, cut_lineage, mix, only, prefix_hash, span_hash, table

#: Bytes of a string that counts as repeated; an anchor has a quarter of them.
LENGTH = 400
#: Bytes of contexts sorted together, and how many contexts of one anchor are sorted rather than counted.
CHUNK, SORTED = 2 << 20, 2000
_PLACE_BITS = np.uint64(28)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of ``width`` values, from running minima within blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    square = padded.reshape(-1, width)
    forward = np.minimum.accumulate(square, axis=1).reshape(-1)
    backward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of each anchor: document, place, first and last window start, hash, and hash of its context."""
    n, k = len(data), max(1, length // 4)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty, empty
    prefix = prefix_hash(data)
    at = np.arange(n - k + 1)
    hashes = span_hash(prefix, at, at + k)
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    least = window_minima((hashes & ~low) | at.astype(np.uint64), length - k + 1)
    place = (least & low).astype(np.int64)
    sizes = np.diff(offsets)
    here = np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), here)
    start = np.repeat(offsets[:-1], here) + np.arange(here.sum()) - np.repeat(np.cumsum(here) - here, here)
    if not len(start):
        return empty, empty, empty, empty, empty, empty
    place = place[start]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    lo, hi, place, doc = start[first], start[last], place[first], doc[first]
    context = mix(span_hash(prefix, lo, hi + length) + (place - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    base = offsets[doc]
    return doc, place - base, lo - base, hi - base, hashes[place].view(np.int64), context.view(np.int64)


def repeated_starts(contexts: list[bytes], zones: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its first ``zone`` places begin ``length`` bytes that begin in another place too.

    Only places in zones count; each has ``length`` bytes of its context left.
    """
    sizes = np.array([len(c) for c in contexts]) + 1
    offsets = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    s = np.zeros(n + length + 16, np.uint16)  # a context ends in symbol 0; bytes are 1 to 256
    s[:n] = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    s[:n] += 1
    s[offsets + sizes - 1] = 0
    zone = np.array(zones)
    # types: a suffix smaller than its successor is of type S
    at = np.arange(len(s) - 1)
    unlike = s[:-1] != s[1:]
    turn = np.minimum.accumulate(np.where(unlike, at, len(s) - 2)[::-1])[::-1]
    smaller = s[turn] < s[turn + 1]
    smaller = np.append(smaller, False)
    after = np.minimum.accumulate(np.where(smaller[:-1], at, len(s) - 1)[::-1])[::-1]
    # only zones are asked for; a last place of type L follows from the next S suffix
    change = np.zeros(len(s) + 1, np.int32)
    np.add.at(change, offsets, 1)
    np.add.at(change, np.minimum(after[offsets + zone - 1], offsets + sizes - 1) + 1, -1)
    active = np.cumsum(change)[:-1] > 0
    smaller[offsets + sizes - 1] = True  # a context's end takes part as it stands: it is a bucket of its own
    key = np.zeros(len(s), np.int64)
    for j in range(7):
        key[: len(s) - 6] |= s[j : len(s) - 6 + j].astype(np.int64) << (9 * (6 - j))
    # stage one: sort the S suffixes directly
    order = np.flatnonzero(active & smaller)
    k = key[order]
    perm = np.argsort(k, kind="stable")
    order, k = order[perm], k[perm]
    head = np.ones(len(order) + 1, bool)
    head[1:-1] = k[1:] != k[:-1]
    depth = 7
    while depth < length:
        tied = np.flatnonzero(~(head[:-1] & head[1:]))
        if not len(tied):
            break
        group = np.cumsum(head[:-1])[tied]
        k = key[np.minimum(order[tied] + depth, len(s) - 1)]
        perm = np.lexsort((k, group))
        order[tied] = order[tied][perm]
        k = k[perm]
        head[tied[1:]] |= (k[1:] != k[:-1]) | (group[1:] != group[:-1])
        depth += 7
    # stage two: scan the buckets of first symbols; a suffix sends its L predecessor to the next free place
    sent: list[list[np.ndarray]] = [[] for _ in range(257)]
    symbols = s[order]
    cut = np.searchsorted(symbols, np.arange(258))
    result = []

    def send(run: np.ndarray, own: int) -> np.ndarray:
        before = run[run > 0] - 1
        before = before[active[before] & ~smaller[before]]
        symbol = s[before]
        perm = np.argsort(symbol, kind="stable")
        before, symbol = before[perm], symbol[perm]
        edges = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(before) else []
        again = before[:0]
        for a, b in zip(edges, [*edges[1:], len(before)]):
            if symbol[a] == own:
                again = before[a:b]
            else:
                sent[symbol[a]].append(before[a:b])
        return again

    for c in range(257):
        run = np.concatenate(sent[c]) if sent[c] else order[:0]
        while len(run):
            result.append(run)
            run = send(run, c)
        run = order[cut[c] : cut[c + 1]]
        if len(run):
            result.append(run)
            send(run, c)
    ranked = np.concatenate(result) if result else order
    inside = np.zeros(len(s), bool)
    change[:] = 0
    np.add.at(change, offsets, 1)
    np.add.at(change, offsets + zone, -1)
    inside = np.cumsum(change)[:-1] > 0
    ranked = ranked[inside[ranked]]
    # common prefixes of neighbours, as far as they decide
    pair = np.arange(len(ranked) - 1)
    depth = 0
    while depth < length and len(pair):
        x, y = key[ranked[pair] + depth], key[ranked[pair + 1] + depth]
        if depth + 7 > length:
            shift = 9 * (depth + 7 - length)
            x, y = x >> shift, y >> shift
        pair = pair[x == y]
        depth += 7
    repeated = np.zeros(len(s), bool)
    repeated[ranked[pair]] = True
    repeated[ranked[pair + 1]] = True
    return [repeated[o : o + z] for o, z in zip(offsets, zones)]


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(d, t, a, lo, hi, f, c) of every anchor of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = batch.column("d").to_numpy(), batch.column("t").to_numpy()
            for first, data, offsets in blocks(batch.column("text")):
                doc, a, lo, hi, f, c = anchors(data, offsets, length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[first + doc], t[first + doc], a, lo, hi, f, c)], list("dt") + ["a", "lo", "hi", "f", "c"])

    return docs.mapInArrow(run, "d long, t long, a long, lo long, hi long, f long, c long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, sorted_contexts: int = SORTED) -> DataFrame:
    """(d, t, start, end) byte spans whose every window is repeated; ``docs`` has d, t and text."""
    rows = anchor_rows(docs, length)
    shared = cut_lineage(rows.groupBy("f").count().where("count > 1").select("f"))
    near = cut_lineage(rows.join(shared, "f", "left_semi"))
    contexts = cut_lineage(near.groupBy("f", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "t", "a", "lo", "hi")).alias("s")))
    whole = near.join(contexts.where("n > 1").select("f", "c"), ["f", "c"], "left_semi").select(
        "d", "t", F.col("lo").alias("start"), (F.col("hi") + length).alias("end")
    )
    groups = contexts.groupBy("f").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("fewest")).where("m > 1 AND fewest = 1")
    asked = contexts.join(groups, "f").select("f", "n", "s.*", (F.col("m") > sorted_contexts).alias("many"))
    asked = asked.groupBy("d", "t").agg(F.collect_list(F.struct("f", "n", "lo", "hi", "many")).alias("asked"))  # at most a document's anchors
    texts = cut_lineage(_contexts(docs.join(asked, ["d", "t"]), length))

    by_anchor = texts.where("NOT many").drop("many").repartition("f").sortWithinPartitions("f", "d", "t", "lo")
    few = by_anchor.mapInArrow(lambda b: _sorted(b, length), "d long, t long, start long, end long")

    windows = texts.where("many").mapInArrow(lambda b: _window_hashes(b, length), "d long, t long, lo long, n long, h array<bigint>")
    windows = windows.select("d", "t", "n", "lo", F.posexplode("h").alias("p", "h"))
    often = windows.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    many = windows.where("n = 1").join(often, "h", "left_semi").select(
        "d", "t", (F.col("lo") + F.col("p")).alias("start"), (F.col("lo") + F.col("p") + length).alias("end")
    )
    return whole.unionAll(few).unionAll(many)


def _contexts(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for d, t, text, asked in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), batch.column("text"), batch.column("asked")):
                raw = memoryview(text.as_buffer())
                for x in asked.as_py():
                    part = bytes(raw[x["lo"] : x["hi"] + length])
                    out.append((x["f"], d, t, x["lo"], x["n"], x["many"], part))
                    size += len(part)
                if size > CHUNK:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    return docs.select("d", "t", "text", "asked").mapInArrow(run, "f long, d long, t long, lo long, n long, many boolean, part binary")


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), kinds)], ["f", "d", "t", "lo", "n", "many", "part"])


def _sorted(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Suffix-sort runs of whole anchors (rows come ordered by f); a run holds CHUNK bytes and one anchor's contexts at most."""

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = repeated_starts([x[4] for x in held], [len(x[4]) - length + 1 for x in held], length)
        spans = [
            (d, t, lo + a, lo + b + length)
            for (d, t, lo, n, _), mask in zip(held, found) if n == 1
            for a, b in runs(mask)
        ]
        if spans:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*spans)], ["d", "t", "start", "end"])

    held: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        for f, *row in zip(*(batch.column(c).to_pylist() for c in ("f", "d", "t", "lo", "n", "part"))):
            if f != last and size > CHUNK:
                yield from solve(held)
                held, size = [], 0
            last = f
            held.append(tuple(row))
            size += len(row[4])
    if held:
        yield from solve(held)


def _window_hashes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = []
        for part in batch.column("part").to_pylist():
            prefix = prefix_hash(np.frombuffer(part, np.uint8))
            at = np.arange(len(part) - length + 1)
            hashes.append(span_hash(prefix, at, at + length).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("d", "t", "lo", "n")), pa.array(hashes, pa.list_(pa.int64()))], ["d", "t", "lo", "n", "h"]
        )


def keyed(docs: DataFrame) -> DataFrame:
    """``d`` and ``t`` name a row's text: its doc_id (the least number for null) and a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("t"), text.alias("text")
    )


def deduplicated(docs: DataFrame, length: int = LENGTH, sorted_contexts: int = SORTED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) of each row of ``docs`` (doc_id, text).

    A byte goes if any ``length`` bytes around it begin somewhere else as well, in the same text or in
    another row's (an equal row is another). Null texts are empty; texts shorter than ``length`` stay
    whole; bytes of characters can be parted, so what is kept is binary. An empty table gives no rows.
    """
    docs = keyed(docs)
    spans = repeated_spans(docs.drop("doc_id"), length, sorted_contexts)
    # at most a document's windows; spans of one anchor are joined before
    of_doc = spans.distinct().groupBy("d", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(as_text(batch.column("text")), batch.column("spans")):
                raw = np.frombuffer(text.as_buffer(), np.uint8) if len(text.as_buffer()) else np.zeros(0, np.uint8)
                change = np.zeros(len(raw) + 1, np.int32)
                if spans.is_valid:
                    got = spans.values
                    np.add.at(change, got.field("start").to_numpy(), 1)
                    np.add.at(change, got.field("end").to_numpy(), -1)
                gone = np.cumsum(change)[:-1] > 0
                kept = raw[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), len(runs(gone)), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            if out:
                columns = [pa.array(list(x), k) for x, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                )

    return docs.join(of_doc, ["d", "t"], "left").select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated 400-byte strings removed from every whole text of ``documents``; ``repeated`` tells if any were."""
    arrow_limits(spark)
    out = deduplicated(only(table(spark, sf_dir, "documents"), doc_id="long", text="string"))
    return out.drop("kept").withColumn("repeated", F.col("n_removed") > 0)
