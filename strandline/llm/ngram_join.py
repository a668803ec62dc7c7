"""Exact Jaccard self-join of shingle sets by universe partition, pigeonhole and one-deletion neighbourhoods.

Two sets with Jaccard similarity t at least differ in few tokens: with sizes a <= b, their symmetric
difference is at most (a + b)(1 - t)/(1 + t), and b <= a/t. So the token universe is cut, by hash, into
segments; a similar pair differs little in most of them.

* Sizes fall into bands of ratio ``RATIO``. In the scheme of band k meet all pairs whose smaller set lies
  in band k; the larger one lies in it too or above it up to (largest size of band k)/t. So each set
  enters the scheme of its own band and those below it that it can reach.
* A scheme's segments have allowances v of 0 (the set's part of the segment is indexed as it is) or 1 (its
  part and every part with one token deleted). Two sets that such a segment doesn't bring together differ
  in v + 1 tokens there at least (in one if the part is a single token, whose deletion isn't indexed).
* A set walks the segments in their fixed order, passes over those where it has no token, and indexes parts
  until their v + 1 add up to one more than the differences that a partner may have. Of two sets, take the
  one whose walk ends at the earlier segment: had they met nowhere, they would differ in more tokens than
  similar sets can. So no pair is missed, and empty parts, which say nothing, are never indexed.
* The few sets whose parts don't suffice (chance puts their tokens into very few segments) index all they
  have, and share one more key with each other.
* How many segments there are, and which share of them has v = 1, is decided for each band by cost: keys
  written, plus the chance meetings to expect among the band's sets, counted over the corpus.

Equal sets are one: only the smallest doc_id of each is indexed. Keys cross the shuffle packed, a few bytes
each. Sets that share a key meet the smallest id there first (a star, so the pairs grow with the keys and
not with their square). Parity sketches, of ``SKETCH`` bits and then of some bits for each token, rule out
what cannot be similar, the rest is verified exactly: first every set against the partner with which it shares the most keys, then those still
in different components. Where a key's members are in different components after that, they are held
against another of them, chosen by hash, ROUNDS times. What is then still apart is compared where sizes and
sketches allow a link; pairs in one component need no comparison. So no link between two components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, blocks, cut_lineage, mix, only, picked, release, shingles, small, table, trimmed, word_hashes
from .components import components

#: Ratio of a size band's ends.
RATIO = 2.0
#: Keys that a task gathers before it joins what meets within them, and keys of a bucket to aim at.
GATHER, BUCKET = 512 << 10, 1 << 20
#: Bits of a set's parity sketch.
SKETCH = 512
#: Times that members of a key in different components are held against one of them, chosen by hash, before
#: those that are still apart are held against each other.
ROUNDS = 2
#: Tokens of a segment to choose from, and eighths of the segments that have v = 1.
LOADS, ONES = (1 / 64, 1 / 8, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0), (0, 2, 4, 8)


@dataclass(frozen=True)
class Scheme:
    """How the sets of one size band, and those above that they can equal, are cut and indexed."""

    low: int
    high: int
    reach: int
    segments: int
    ones: int  # eighths of the segments with v = 1

    def allowance(self, segment: np.ndarray) -> np.ndarray:
        """v of segments, spread evenly over their order."""
        return (segment * 5 % 8 < self.ones).astype(np.int64)

    def target(self, sizes: np.ndarray, percent: int) -> np.ndarray:
        """The v + 1 that sets of these sizes must index: one over what they and a partner can differ in."""
        partner = np.where(sizes <= self.high, np.minimum(self.reach, 100 * sizes // percent), self.high)
        return (sizes + partner) * (100 - percent) // (100 + percent) + 1


def differences(a: int, b: int, percent: int) -> int:
    """The most tokens in which sets of sizes a and b differ whose similarity is percent/100 at least."""
    return (a + b) * (100 - percent) // (100 + percent)


def bands(largest: int) -> list[tuple[int, int]]:
    """Size bands (first, last) that cover 1 to ``largest``."""
    out, low = [], 1
    while low <= largest:
        high = max(low, math.ceil(low * RATIO) - 1)
        out.append((low, high))
        low = high + 1
    return out


def allocate(counts: dict[int, int], percent: int, largest: int) -> list[Scheme]:
    """Schemes for all bands, each with the segments and allowances of least expected cost.

    ``counts`` has the number of sets of each band (by place in ``bands``).
    """
    out = []
    for k, (low, high) in enumerate(bands(largest)):
        reach = 100 * high // percent
        n, mid = counts.get(k, 0), math.sqrt(low * high)
        best = None
        for load in LOADS:
            for ones in ONES:
                s = Scheme(low, high, reach, max(1, round(mid / load)), ones)
                if not all(_suffices(s, size, percent) for size in (low, high, reach)):
                    continue
                tokens = load / -math.expm1(-load)  # of a part that isn't empty
                share = ones / 8
                parts = int(s.target(np.array([int(mid)]), percent)[0]) / (1 + share * (tokens > 1.5))
                keys = parts * (1 + share * tokens)
                # of unlike texts about a tenth may be passages that others hold too
                chance = 0.01 * ((1 - share) * 0.1**tokens + share * (1 + tokens) * 0.1 ** max(0.0, tokens - 1))
                cost = n * keys + n * n / 2 * parts * chance
                if best is None or cost < best[0]:
                    best = (cost, s)
        out.append(best[1] if best else Scheme(low, high, reach, 64 * reach, 0))
    return out


def _suffices(s: Scheme, size: int, percent: int) -> bool:
    """Whether the parts of nearly all sets of a size add up to what they must index."""
    m, load = s.segments, size / s.segments
    empty = math.exp(-load)
    spread = 5 * math.sqrt(m * empty * max(0.0, 1 - (1 + load) * empty))
    several = max(0.0, 1 - empty * (1 + load))  # share of segments with two tokens or more
    return m * (1 - empty + s.ones / 8 * several) - spread * (1 + s.ones / 8) >= int(s.target(np.array([size]), percent)[0])


def set_hashes(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Two 64-bit hashes, the parity sketch (SKETCH / 64 words a row) and the deep sketch of each set.

    The deep one has two to four bits for each token (256 at least), a power of two of them, so that of the
    longer of two sketches the halves, added, are comparable to the shorter.
    """
    n = len(at) - 1
    out = np.zeros((2, n), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        starts = at[:-1][some]
        for k, salt in enumerate((0x51ED270B, 0x7FB5D329)):
            out[k, some] = mix(np.add.reduceat(mix(tokens ^ np.uint64(salt)), starts))
    bit = np.repeat(np.arange(n), np.diff(at)) * SKETCH + (tokens & np.uint64(SKETCH - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=n * SKETCH) & 1).astype(bool)
    sketch = np.packbits(odd.reshape(n, SKETCH), axis=1, bitorder="little").view(np.uint64)
    sizes = np.diff(at)
    words = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(sizes, 1) / 32)).clip(0).astype(np.int64))
    begin = np.cumsum(words) - words
    owner = np.repeat(np.arange(n), sizes)
    place = (tokens & (64 * words[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(64 * begin[owner] + place, minlength=64 * int(words.sum())) & 1).astype(bool)
    deep = np.packbits(odd, bitorder="little").view(np.int64) if n else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, words.sum()).astype(np.int32)), pa.array(deep))
    return out[0].view(np.int64), out[1].view(np.int64), sketch.view(np.int64), lists


def token_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of documents: first document, sorted distinct shingle hashes, offsets by document."""
    for first, data, offsets in blocks(column):
        got, at = shingles(*word_hashes(data, offsets), k)
        parts = [np.unique(got[a:b]) for a, b in zip(at, at[1:])]
        yield first, np.concatenate(parts) if parts else got, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def index_keys(tokens: np.ndarray, at: np.ndarray, schemes: list[Scheme], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) of all sets in all schemes that they enter."""
    keys, owners = [], []
    sizes = np.diff(at)
    for k, s in enumerate(schemes):
        inside = np.flatnonzero((sizes >= s.low) & (sizes <= s.reach))
        if not len(inside):
            continue
        m = np.uint64(s.segments)
        take = np.repeat(at[inside], sizes[inside]) + np.arange(sizes[inside].sum()) - np.repeat(np.cumsum(sizes[inside]) - sizes[inside], sizes[inside])
        t = tokens[take]
        doc = np.repeat(np.arange(len(inside)), sizes[inside])
        segment = ((t >> np.uint64(32)) * m >> np.uint64(32)).astype(np.int64)  # grows with t: parts are runs
        starts = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (doc[1:] != doc[:-1])]))
        count = np.diff(np.concatenate([starts, [len(t)]]))
        own, where = doc[starts], segment[starts]
        # the walk: a set's parts in order of segments, until their weights reach its target
        one = s.allowance(where) == 1
        weight = 1 + (one & (count > 1))
        before = np.cumsum(weight) - weight
        first = np.searchsorted(own, np.arange(len(inside)))
        before -= before[first][own]
        target = s.target(sizes[inside], percent)
        walked = before < target[own]
        value = mix(t + np.uint64((k + 1) * 0x2545F4914F6CDD1D % (1 << 64)))
        total = np.add.reduceat(value, starts)
        salt = mix(np.uint64(k) * np.uint64(1 << 32) + where.astype(np.uint64) + np.uint64(7))
        keys.append(_key(total[walked], count[walked], salt[walked]))
        owners.append(inside[own[walked]])
        # every part less one of its tokens, where v = 1
        of = np.repeat(np.arange(len(starts)), count)
        chosen = np.flatnonzero((walked & one & (count > 1))[of])
        if len(chosen):
            of = of[chosen]
            keys.append(_key(total[of] - value[chosen], count[of] - 1, salt[of]))
            owners.append(inside[doc[chosen]])
        short = np.flatnonzero(np.bincount(own, weight, len(inside)) < target)
        if len(short):
            keys.append(np.full(len(short), mix(np.array([k + 0xA5A5A5A5], np.uint64))[0]))
            owners.append(inside[short])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _key(sums: np.ndarray, counts: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return mix(sums + salts + counts.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


_WORDS = [f"s{i}" for i in range(SKETCH // 64)]


def profile(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), h1, h2 (hashes of the set), its sketch's words and its deep sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, tokens, at in token_sets(batch.column("text"), k):
                h1, h2, sketch, deep = set_hashes(tokens, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(at) - 1), *map(pa.array, (np.diff(at), h1, h2, *sketch.T.copy())), deep],
                    ["doc_id", "n", "h1", "h2", *_WORDS, "deep"],
                )

    return docs.mapInArrow(lambda b: trimmed(run(b)), "doc_id long, n long, h1 long, h2 long, " + ", ".join(f"{w} long" for w in _WORDS) + ", deep array<bigint>")


def planes(x: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of numbers, byte by byte, which packs better."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplaned(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def meetings(docs: DataFrame, k: int, schemes: list[Scheme], percent: int, expected: int) -> DataFrame:
    """(key, lead, doc): documents that share a key with a smaller one, ``lead``; as trees of stars.

    A task joins what meets among the keys it has gathered and sends on only the smallest id of each key,
    so a key of very many documents crosses the shuffle once for each gathering. Keys are dealt by range
    to buckets, of which there are so many that each holds about BUCKET of the ``expected`` keys; a row
    of the shuffle has all keys of one gathering and bucket, as sorted differences, and places in the
    list of its ids. Keys are cut to as many bits as the expected number asks for: those that fall
    together by chance cost a verification and lose nothing.
    """
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-expected // BUCKET))
    bits = min(64, max(32, expected.bit_length() + 16))

    def stars(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sorted distinct (key, doc), the smallest doc of each key, and where a key begins."""
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        fresh = first.copy()
        fresh[1:] |= doc[1:] != doc[:-1]
        key, doc, first = key[fresh], doc[fresh], first[fresh]
        return key, doc, doc[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))], first

    def met(key: np.ndarray, lead: np.ndarray, doc: np.ndarray) -> list[pa.Array]:
        return [pa.array(key.view(np.int64)), pa.array(lead), pa.array(doc)]

    def packed(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, doc, lead, first = stars(*(np.concatenate(x) for x in zip(*parts)))
        if not len(key):
            return
        rest = ~first
        key, doc, same = key[first], doc[first], met(key[rest], lead[rest], doc[rest])
        if rest.any():
            nothing = pa.nulls(len(same[0]), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(same[0]), pa.int32()), nothing, nothing, nothing, *same], _PACKED)
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cut = key >> np.uint64(64 - bits) if bits < 64 else key
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        rows: list[tuple] = []
        for a, b in zip(edges, [*edges[1:], len(key)]):
            step = np.diff(cut[a:b], prepend=np.uint64(0))
            ids, place = np.unique(doc[a:b], return_inverse=True)
            width = lambda x: max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
            tail = width(step[1:])
            rows.append((int(bucket[a]), step[:1].tobytes() + bytes([tail]) + planes(step[1:], tail), planes(place, width(place)), ids.tobytes()))
        if rows:
            x = list(zip(*rows))
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int32()), *(pa.array(c, pa.binary()) for c in x[1:]), none, none, none], _PACKED)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, tokens, at in token_sets(batch.column("text"), k):
                key, doc = index_keys(tokens, at, schemes, percent)
                held.append((key, ids[first + doc].astype(np.int64)))
                n += len(key)
                if n > GATHER:
                    yield from packed(held)
                    held, n = [], 0
        if held:
            yield from packed(held)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's rows are one bucket, but for those that have met already, which pass through."""
        held = []
        for batch in batches:
            already = batch.filter(batch.column("key").is_valid())
            if already.num_rows:
                yield already.select(["key", "lead", "doc"])
            for steps, place, ids in zip(*(batch.column(c).to_pylist() for c in ("steps", "place", "ids"))):
                if steps is None:
                    continue
                begin = np.frombuffer(steps, "<u8", 1)
                key = np.cumsum(np.concatenate([begin, unplaned(steps[9:], steps[8])]), dtype=np.uint64)
                held.append((key, np.frombuffer(ids, np.int64)[unplaned(place, len(place) // len(key)).astype(np.int64)]))
        if held:
            key, doc, lead, first = stars(*(np.concatenate(x) for x in zip(*held)))
            key = key << np.uint64(64 - bits) if bits < 64 else key
            rest = np.flatnonzero(~first)
            for a in range(0, len(rest), GATHER):
                part = rest[a : a + GATHER]
                yield pa.RecordBatch.from_arrays(met(key[part], lead[part], doc[part]), ["key", "lead", "doc"])

    sent = docs.mapInArrow(lambda b: trimmed(local(b)), "bucket int, steps binary, place binary, ids binary, key long, lead long, doc long")
    # what has met already passes through and is spread by its key
    to = F.coalesce("bucket", F.pmod(F.xxhash64("key", "doc"), F.lit(buckets)).cast("int"))
    out = sent.repartitionById(buckets, to).mapInArrow(lambda b: trimmed(across(b)), "key long, lead long, doc long")
    # a key cut like those that met across, so that its members are found together
    return out.withColumn("key", F.shiftleft(F.shiftrightunsigned("key", 64 - bits), 64 - bits)) if bits < 64 else out


_PACKED = ["bucket", "steps", "place", "ids", "key", "lead", "doc"]


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of distinct (a, b), a written table, those whose sets' similarity is percent/100 at least, from the whole texts."""
    wanted = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, tokens, at in token_sets(batch.column("text"), k):
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(at) - 1), sets], ["id", "tokens"])

    sets = picked(docs, wanted, "left_semi").mapInArrow(lambda b: trimmed(run(b)), "id long, tokens array<bigint>")
    both = small(pairs).join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a"
    )
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"))
    return shared.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("s") - F.col("i"))).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Documents whose sets of ``k``-word shingles have a Jaccard similarity of percent/100 at least are
    linked, also through others; component_id is the smallest doc_id reached. A null, empty or blank text
    has no shingles and is linked with nothing. Equal texts are linked. An empty table gives no rows. A
    doc_id is taken to name one document: rows that share it share its links. A null doc_id gives a
    component of null. The tables that the result is read from stay in the shared folder.
    """
    docs = docs.select("doc_id", "text")
    about = cut_lineage(profile(docs, k), few_files=True)
    known = about.where("n > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    rep = cut_lineage(known.select("doc_id", "n", "h1", "h2").distinct().join(classes, ["n", "h1", "h2"]).select("doc_id", "rep", "n"))

    edges_of = bands(1 << 31)
    band = F.lit(len(edges_of))
    for i, (_, high) in reversed(list(enumerate(edges_of))):
        band = F.when(F.col("n") <= high, F.lit(i)).otherwise(band)
    only_reps = rep.where("doc_id = rep")
    sizes = only_reps.groupBy(band.alias("band")).agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).collect()  # a row for each band
    schemes = allocate({r[0]: r[1] for r in sizes}, percent, max((r[3] for r in sizes), default=0))
    expected = sum(r[2] * max(1, schemes[r[0]].ones) * 3 * (100 - percent) // (100 + percent) + r[1] for r in sizes)
    copies = rep.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("rep")).alias("first")).where("NOT first").select("doc_id")
    indexed = picked(docs.where("doc_id IS NOT NULL"), cut_lineage(copies), "left_anti")
    met = cut_lineage(meetings(indexed, k, schemes, percent, expected), few_files=True)

    # what a set's sizes and sketch allow; a doc_id with several texts has several
    firsts = only_reps.select("doc_id", "n").distinct()
    sketches = cut_lineage(about.where("n > 0").join(firsts, ["doc_id", "n"], "left_semi").select(F.col("doc_id").alias("id"), "n", *_WORDS, "deep").dropDuplicates(["id", "n", *_WORDS]))
    pairs = cut_lineage(met.groupBy("lead", "doc").agg(F.count(F.lit(1)).alias("keys")).select(F.col("lead").alias("a"), F.col("doc").alias("b"), "keys"))
    likely = _deeper(cut_lineage(_likely(pairs, sketches, percent)), sketches, percent)

    # documents with texts of several classes join these
    several = rep.groupBy("doc_id").agg(F.count_distinct("rep").alias("reps")).where("reps > 1").select("doc_id")
    links = [cut_lineage(rep.join(several, "doc_id", "left_semi").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))]

    def link(new: DataFrame) -> DataFrame:
        """Components after ``new`` pairs are verified too."""
        links.append(cut_lineage(verified(docs, new, k, percent), few_files=True))
        return components(reduce(DataFrame.unionAll, links))

    best = cut_lineage(likely.groupBy("b").agg(F.max_by("a", F.struct("keys", -F.col("a"))).alias("a")).select("a", "b"))
    found = link(best)
    rest = cut_lineage(_apart(likely, found).join(small(best), ["a", "b"], "left_anti").select("a", "b"))
    old, found = found, link(rest)
    release(old, best, rest)

    # members of one key in different components: the pairs that the stars left open
    open_pairs = cut_lineage(_apart(pairs, found).select(F.col("a").alias("lead"), F.col("b").alias("doc")))
    open_keys = cut_lineage(met.join(small(open_pairs), ["lead", "doc"], "left_semi").select("key").distinct())
    of_open = cut_lineage(met.join(small(open_keys), "key", "left_semi"))
    members = of_open.select("key", F.col("lead").alias("id")).unionAll(of_open.select("key", F.col("doc").alias("id")))
    members = cut_lineage(members.distinct())
    release(met, open_pairs, open_keys, of_open, likely)
    seen = pairs.select("a", "b")
    for salt in [*range(ROUNDS), None]:
        named = members.join(small(found), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
        # one member of each key, chosen by hash; a pair alone has met, and so has one component
        chosen = F.min(F.struct(F.xxhash64("id", F.lit(salt)), F.col("id").alias("o_id"), F.col("c").alias("o_c"))).alias("o")
        groups = named.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("low"), F.max("c").alias("high"), chosen)
        groups = cut_lineage(groups.where("m > 2 AND low < high").select("key", "o.o_id", "o.o_c"))
        if groups.isEmpty():
            release(groups)
            break
        if salt is None:
            named = cut_lineage(named.join(small(groups.select("key")), "key", "left_semi"))
            # the deep sketches are compared here already: the short ones say nothing of sets with far more tokens than bits
            mine, other = (named.join(_named(sketches, "id", mark, deep=True), "id") for mark in "xy")
            other = other.withColumnsRenamed({"id": "o_id", "c": "o_c"})
            met_again = mine.join(other, "key").where(
                (F.col("id") < F.col("o_id")) & (F.col("c") != F.col("o_c")) & _fits(percent) & _fits_deep(percent)
            )
        else:
            met_again = named.join(small(groups), "key").where("c <> o_c")
        # written once each: else Spark looks a pair up in ``seen`` for every key that it shares
        new = cut_lineage(met_again.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct())
        new = cut_lineage(new.join(small(seen), ["a", "b"], "left_anti"))
        if salt is not None:
            new = _deeper(cut_lineage(_likely(new, sketches, percent).select("a", "b")), sketches, percent)
        seen = seen.unionAll(new)
        old, found = found, link(new)
        release(old, groups)
    release(members, *links)

    whole = rep.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    whole = whole.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    return about.select("doc_id", "n").join(whole, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def _named(sketches: DataFrame, column: str, mark: str, deep: bool = False) -> DataFrame:
    """The sketches of documents called ``column``, with marked names."""
    deeper = [F.col("deep").alias(f"{mark}d")] if deep else []
    return sketches.select(F.col("id").alias(column), *(F.col(c).alias(f"{mark}{c}") for c in ("n", *_WORDS)), *deeper)


def _fits(percent: int) -> Column:
    """Neither sizes nor parity sketches rule the similarity out."""
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"x{w}").bitwiseXOR(F.col(f"y{w}"))) for w in _WORDS))
    return (F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * percent) & (
        differ * (100 + percent) <= (F.col("xn") + F.col("yn")) * (100 - percent)
    )


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, ...) that neither sizes nor parity sketches rule out."""
    both = small(pairs).join(_named(sketches, "a", "x"), "a").join(_named(sketches, "b", "y"), "b")
    return both.where(_fits(percent)).select(*pairs.columns).distinct()


def _fits_deep(percent: int) -> Column:
    """Deep sketches don't rule the similarity out."""
    half = lambda c: F.floor(F.size(c) / 2).cast("int")
    folded = lambda c: F.zip_with(F.slice(c, F.lit(1), half(c)), F.slice(c, half(c) + 1, half(c)), lambda p, q: p.bitwiseXOR(q))
    alike = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, z: s + z)
    x, y = F.size("xd"), F.size("yd")
    differ = F.when(x == y, alike(F.col("xd"), F.col("yd"))).when(x == 2 * y, alike(folded("xd"), F.col("yd"))).when(y == 2 * x, alike(F.col("xd"), folded("yd"))).otherwise(0)
    return differ * (100 + percent) <= (F.col("xn") + F.col("yn")) * (100 - percent)


def _deeper(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Written pairs (a, b, ...) that deep sketches don't rule out either, written."""
    side = lambda column, mark: sketches.select(F.col("id").alias(column), F.col("n").alias(f"{mark}n"), F.col("deep").alias(f"{mark}d"))
    both = small(pairs).join(side("a", "x"), "a").join(side("b", "y"), "b")
    return cut_lineage(both.where(_fits_deep(percent)).select(*pairs.columns).distinct())


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs in different components."""
    found = small(found)
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("id").alias(side), F.col("component").alias(f"{side}_c")), side, "left")
    return pairs.where(F.coalesce("a_c", "a") != F.coalesce("b_c", "b")).drop("a_c", "b_c")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` linked at 90 % of three-word shingles."""
    arrow_limits(spark)
    return near_duplicates(only(table(spark, sf_dir, "documents"), doc_id="long", text="string"), k=3, percent=90)
