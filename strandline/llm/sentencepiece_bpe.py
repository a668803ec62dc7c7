"""Merge-type SentencePiece encoding by an agenda of adjacent symbol pairs, and decoding, in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import arrow_limits, as_text, only, table, trimmed

SPACE = "▁"
#: Units whose ids one worker remembers; beyond it the memory starts anew, so a worker's size is bounded.
CACHE_UNITS = 250_000
#: Distinct units that are encoded together at most, and characters of texts that are cut into units at a time.
PART_UNITS, PART_CHARS = 50_000, 1 << 20


class Unsupported(ValueError):
    """The model isn't one that this encoder reproduces."""


class MergeModel:
    """A merge-type vocabulary with byte fallback, an identity normaliser and a space put before the text.

    ``encode`` works on units: a run of escaped spaces and the characters up to the next one. No piece
    holds a space after another character (checked when the model is loaded), so no merge crosses a
    unit's start and units can be encoded one by one and remembered. In a unit, the agenda holds every
    adjacent pair of symbols that is a piece, best score first and leftmost among equals; a popped pair
    whose symbols still stand is merged, and its two new neighbour pairs enter the agenda.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.vocab_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.ids, self.scores, self.byte_ids, self.fixed = {}, {}, {}, set()
        for i, piece in enumerate(self.pieces):
            if self.library.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif self.library.is_control(i) or self.library.is_unknown(i):
                self.fixed.add(i)
            else:
                self.ids[piece] = i
                self.scores[piece] = self.library.get_score(i)
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        if len(self.byte_ids) != 256:
            raise Unsupported("the vocabulary has no full byte fallback")
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise Unsupported("a piece has a space after another character")
        if any("\n" in piece for piece in self.ids):
            raise Unsupported("a piece has a line end")
        # characters of words after which a piece goes on with one that isn't
        self.joining = sorted({m[0] for piece in self.ids for m in re.findall(f"(?=(\\w[^\\w{SPACE}]))", piece)})
        for probe in ("", "a", "  a b  ", "\ta\r\n", "ａ　é", SPACE + "a", "a\x00b"):
            if self.encode(probe) != self.library.encode(probe) or self.decode(self.encode(probe)) != self.library.decode(
                self.library.encode(probe)
            ):
                raise Unsupported(f"the model normalises {probe!r} in another way")

    _units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def units(self, text: str) -> list[str]:
        return self._units.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.units(text) for i in self.encode_unit(unit)]

    def encode_unit(self, unit: str) -> list[int]:
        scores = self.scores
        symbols: list[str | None] = list(unit)
        n = len(symbols)
        agenda = []
        for i in range(n - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None:
                agenda.append((-score, i, i + 1, symbols[i] + symbols[i + 1]))
        heapify(agenda)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while agenda:
            _, left, right, joined = heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or after[left] != right or len(a) + len(b) != len(joined):
                continue
            symbols[left], symbols[right] = joined, None
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                pair = joined + symbols[nxt]
                score = scores.get(pair)
                if score is not None:
                    heappush(agenda, (-score, left, nxt, pair))
            prev = before[left]
            if prev >= 0:
                pair = symbols[prev] + joined
                score = scores.get(pair)
                if score is not None:
                    heappush(agenda, (-score, prev, left, pair))
        out = []
        for s in symbols:
            if s is None:
                continue
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in s.encode()]
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The pieces' bytes with spaces restored; a text's first space is still there."""
        return b"".join(
            b if (b := self.bytes_of.get(i)) is not None else b"" if i in self.fixed else self.pieces[i].replace(SPACE, " ").encode()
            for i in ids
        )

    def decode(self, ids: Iterable[int]) -> str:
        """The text, without the space that was put before it; bytes that are no UTF-8 become U+FFFD each."""
        raw = self.decode_bytes(ids)
        return replace_bad(raw[1:] if raw[:1] == b" " else raw)


def replace_bad(raw: bytes) -> str:
    """UTF-8, with U+FFFD for each byte that is part of no character, as the library has it."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode(errors="surrogateescape").translate(_BAD)


_BAD = {code: "\ufffd" for code in range(0xDC80, 0xDD00)}


@lru_cache(2)
def model(path: str) -> MergeModel:
    return MergeModel(path)


class Agenda:
    """The agendas of many units at once, as arrays.

    A round takes the best pair (leftmost among equals) of every unit that still has one and merges it;
    only the two pairs beside a merge are looked up anew. Units of over ``LONG`` characters, whose many
    rounds would be slow, go through the model's own agenda.
    """

    LONG = 256
    NONE = np.int32(1 << 30)
    #: The pairs stand in an open hash table of 2**SLOTS places.
    SLOTS, FACTOR = 20, 0x9E3779B97F4A7C15
    TOGETHER = 4096

    def __init__(self, m: MergeModel):
        n = len(m.pieces)
        self.model, self.vocabulary = m, n
        self.char_ids = np.arange(0x110000, dtype=np.int32) + np.int32(n)
        for piece, i in m.ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i
        ranks = {s: r for r, s in enumerate(sorted(set(m.scores.values()), reverse=True))}
        known = lambda s: m.ids.get(s, n + ord(s) if len(s) == 1 else None)
        pairs = {}
        for piece, i in m.ids.items():
            for cut in range(1, len(piece)):
                left, right = known(piece[:cut]), known(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (i, ranks[m.scores[piece]])
        self.keys = np.full(1 << self.SLOTS, -1, np.int64)
        self.merged = np.zeros(1 << self.SLOTS, np.int32)
        self.ranks = np.full(1 << self.SLOTS, self.NONE)
        for key, (i, rank) in pairs.items():
            at = (key * self.FACTOR & (1 << 64) - 1) >> 64 - self.SLOTS
            while self.keys[at] >= 0:
                at = (at + 1) & (1 << self.SLOTS) - 1
            self.keys[at], self.merged[at], self.ranks[at] = key, i, rank
        self.id_text = [str(i) for i in range(n)]
        self.id_bytes = [m.decode_bytes([i]) for i in range(n)]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 32 | right
        at = (key.view(np.uint64) * np.uint64(self.FACTOR) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        there = self.keys[at]
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (1 << self.SLOTS) - 1
            there = self.keys[at[open_]]
            open_ = open_[(there != key[open_]) & (there >= 0)]
        return self.ranks[at], self.merged[at]  # a free place has the rank NONE

    def encode(self, units: list[str]) -> list[list[int]]:
        """The ids of each unit; so few units at a time that the arrays stay in a core's cache."""
        return [ids for at in range(0, len(units), self.TOGETHER) for ids in self.encode_part(units[at : at + self.TOGETHER])]

    def encode_part(self, units: list[str]) -> list[list[int]]:
        out: list = [None] * len(units)
        short = []
        for i, u in enumerate(units):
            if len(u) > self.LONG:
                out[i] = self.model.encode_unit(u)
            else:
                short.append(i)
        if not short:
            return out
        sym = self.char_ids[np.frombuffer("".join([units[i] for i in short]).encode("utf-32-le"), np.uint32)]
        own = np.repeat(np.arange(len(short), dtype=np.int32), [len(units[i]) for i in short])
        rank = np.full(len(sym), self.NONE)
        into = np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(own[:-1] == own[1:])
        rank[inner], into[inner] = self.look_up(sym[inner], sym[inner + 1])
        done = []
        while len(sym):
            starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            lengths = np.diff(np.concatenate([starts, [len(sym)]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            live = best < self.NONE
            if not live.all():
                done.append((own[~live], sym[~live]))
                sym, own, rank, into, best = sym[live], own[live], rank[live], into[live], best[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate([[True], own[at[1:]] != own[at[:-1]]])]
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one symbol before it is gone for each earlier merge
            sym, own, rank, into = sym[keep], own[keep], rank[keep], into[keep]
            for i in (at, at[at > 0] - 1):
                i = i[own[i] == own[np.minimum(i + 1, len(own) - 1)]] if len(i) else i
                i = i[i + 1 < len(own)]
                rank[i], into[i] = self.look_up(sym[i], sym[i + 1])
            last = at[(at + 1 == len(own)) | (own[at] != own[np.minimum(at + 1, len(own) - 1)])]
            rank[last] = self.NONE
        own = np.concatenate([x[0] for x in done])
        order = np.argsort(own, kind="stable")
        flat = np.concatenate([x[1] for x in done])[order]
        ends = np.cumsum(np.bincount(own, minlength=len(short)))
        rare = np.zeros(len(short), bool)
        rare[own[order][flat >= self.vocabulary]] = True
        ids, begin = flat.tolist(), 0
        for i, end, odd in zip(short, ends.tolist(), rare.tolist()):
            found = ids[begin:end]
            if odd:
                found = [x for s in found for x in ([s] if s < self.vocabulary else self.spelled(s - self.vocabulary))]
            out[i], begin = found, end
        return out

    def spelled(self, code: int) -> list[int]:
        return [self.model.byte_ids[b] for b in chr(code).encode()]


@lru_cache(2)
def agenda(path: str) -> Agenda:
    return Agenda(model(path))


_FINE = re.compile(f"{SPACE}+[^\\w{SPACE}\\n]*\\w*|[^\\w{SPACE}\\n]+\\w*|\\w+|\\n")
_MARKS = re.compile(r"\W[.,]")
_MEETING = ("  ", "\n\n", "\n ", "\0", SPACE)


class Encoder:
    """Encodes whole texts with a bounded memory of units; every new unit is checked against the library.

    A batch's new units are encoded together. All of them, joined to a text by line ends (which no piece
    holds, so none merges with its neighbour), must have the ids that the library gives; if any differs,
    each of that batch's new units takes the library's ids and ``differing`` counts those that changed.
    The memory has a young and an old half; a full young half becomes the old one, so frequent units stay
    and a worker's size is bounded.
    """

    def __init__(self, path: str):
        self.model, self.agenda = model(path), agenda(path)
        self.lead = self.model.library.encode("\n")  # the space before the text, and a line end
        self.ids: dict[str, str] = {}
        self.odd: dict[str, bytes] = {}  # what units decode to that isn't the unit itself
        self.old: tuple[dict[str, str], dict[str, bytes]] = ({}, {})
        self.differing = 0

    def units(self, text: str) -> list[str]:
        """The text's units, with plain spaces; cut more finely than the model's own.

        No piece holds a line end, or a character that isn't part of a word after one that is (but for the
        model's few ``joining`` characters), so merges don't cross those places either. Most texts can be
        cut there by replacing and splitting; where two marks meet, a pattern does it.
        """
        if not text:
            return []
        if any(c in text for c in self.model.joining):
            return [u.replace(SPACE, " ") for u in self.model.units(text)]
        if not (any(m in text for m in _MEETING) or text[0] in " \n.," or text[-1] == "\n" or _MARKS.search(text)):
            for mark, cut in (("\n", "\0\n\0"), (".", "\0."), (",", "\0,"), (" ", "\0 ")):
                text = text.replace(mark, cut)
            return (" " + text).split("\0")
        return [u.replace(SPACE, " ") for u in _FINE.findall(SPACE + text.replace(" ", SPACE))]

    def checked(self, units: list[str]) -> list[list[int]]:
        found = self.agenda.encode([u.replace(" ", SPACE) for u in units])
        library, lead = self.model.library, self.lead
        ids = lead[:-1]
        for f in found:
            ids.append(lead[-1])
            ids += f
        if library.encode("\n" + "\n".join(units)) != ids:
            for i, u in enumerate(units):
                if (want := library.encode("\n" + u)[len(lead) :]) != found[i]:
                    found[i] = want
                    self.differing += 1
        return found

    def learn(self, distinct: set[str]) -> None:
        """Bring units of one part into the young half."""
        fresh = distinct - self.ids.keys()
        if len(self.ids) + len(fresh) > CACHE_UNITS:
            self.old, self.ids, self.odd = (self.ids, self.odd), {}, {}
            fresh = distinct
        again = fresh & self.old[0].keys()
        for u in again:
            self.ids[u] = self.old[0][u]
            if u in self.old[1]:
                self.odd[u] = self.old[1][u]
        fresh = list(fresh - again)
        if fresh:
            texts, raws = self.agenda.id_text, self.agenda.id_bytes
            for u, ids in zip(fresh, self.checked(fresh)):
                self.ids[u] = ",".join(map(texts.__getitem__, ids))
                raw = b"".join(map(raws.__getitem__, ids))
                if raw != u.encode():
                    self.odd[u] = raw

    def batch(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Of each text, its ids joined by commas and the bytes that they decode to."""
        begin = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size > PART_CHARS:
                yield from self.some(texts[begin : i + 1])
                begin, size = i + 1, 0
        yield from self.some(texts[begin:])

    def some(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        cut = [self.units(t) for t in texts]
        distinct: set[str] = set()
        for units in cut:
            distinct.update(units)
            if len(distinct) > PART_UNITS:
                self.learn(distinct)
                distinct = set()
        self.learn(distinct)
        return map(self.both, cut)

    def both(self, units: list[str]) -> tuple[str, bytes]:
        try:
            ids, raw = ",".join(map(self.ids.__getitem__, units)), self.spelled(units)
        except KeyError:
            parts = []
            for at in range(0, len(units), PART_UNITS):
                part = units[at : at + PART_UNITS]
                self.learn(set(part))
                parts.append((",".join(map(self.ids.__getitem__, part)), self.spelled(part)))
            ids, raw = ",".join(p[0] for p in parts), b"".join(p[1] for p in parts)
        return ids, raw[1:] if raw[:1] == b" " else raw

    def spelled(self, units: list[str]) -> bytes:
        """The bytes that the units decode to."""
        odd = self.odd
        if odd and not odd.keys().isdisjoint(units):
            return b"".join(odd[u] if u in odd else u.encode() for u in units)
        return "".join(units).encode()

    def encode(self, text: str) -> list[int]:
        ids = self.both(self.units(text))[0]
        return [int(i) for i in ids.split(",")] if ids else []


def encode_column(docs: DataFrame, model_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``ids`` (array<int>), the ids of the whole text; a null or empty text has none, rows that
    repeat get theirs each, and an empty table gives no rows."""
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for batch in batches:
            found = encoder.batch(as_text(batch.column(text)).to_pylist())
            ids = [np.fromstring(joined, np.int32, sep=",") if joined else [] for joined, _ in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"]
            )

    return docs.mapInArrow(lambda b: trimmed(run(b)), schema)


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    A null text is empty and has no ids; rows that repeat get equal digests each, and an empty table gives
    no rows. Very long texts are encoded by parts of PART_UNITS units.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for batch in batches:
            counts, id_sums, text_sums = [], [], []
            for ids, raw in encoder.batch(as_text(batch.column("text")).to_pylist()):
                counts.append(ids.count(",") + 1 if ids else 0)
                id_sums.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sums.append(hashlib.sha256(replace_bad(raw).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.mapInArrow(lambda b: trimmed(run(b)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded; digests of the ids and of the decoded text."""
    arrow_limits(spark)
    return digest(only(table(spark, sf_dir, "documents"), doc_id="long", text="string"), vocabulary_path())
