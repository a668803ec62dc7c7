"""Secret scans: candidates by pattern, false positives removed by a random forest trained from labelled findings."""

from __future__ import annotations

import json
import math
import random
import re
import string
from bisect import bisect_left as bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, as_text, only, table, trimmed

THRESHOLD = 0.5
#: Characters before and after a candidate in which neighbouring words are looked for.
REACH = 60
_NAME = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|credential|auth)"
#: Patterns of candidates; the group ``value`` is the candidate.
PATTERNS = {
    "private_key": re.compile(r"(?P<value>-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:\s*[A-Za-z][A-Za-z-]*:(?:(?!-----BEGIN )[^\n])*\n)*[A-Za-z0-9+/=\s]{16,}?-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----)"),
    "prefixed": re.compile(r"\b(?P<value>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})"),
    "assigned": re.compile(_NAME + r"[\w-]{0,20}[\"']?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}[\"'`]?(?P<value>[A-Za-z0-9+/=_.!@#$%^&*~-]{8,})", re.I),
    "random": re.compile(r"(?<![A-Za-z0-9+/_=.-])(?P<value>[A-Za-z0-9+/_=-]{20,})"),
}
#: A text without any of these can hold no candidate of the first three patterns.
_HINT = re.compile(_NAME + r"|AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ|-----BEGIN ", re.I)
# Words that stand beside secrets, and words that stand beside what looks like one.
GOOD_WORDS = frozenset("token secret password passwd pwd key apikey credential auth bearer login private access".split())
BAD_WORDS = frozenset("example sample dummy placeholder test hash sha sha1 sha256 md5 checksum digest commit revision uuid guid id build etag version image data url src href".split())
# Marks of paths under which false findings, and under which secrets, are common.
BAD_PATHS = frozenset("test tests testing spec example examples sample samples fixture fixtures mock mocks doc docs readme lock vendor node_modules min dist snapshot".split())
GOOD_PATHS = frozenset("env config conf settings credentials secrets deploy prod production pem key properties ini".split())


@lru_cache(1)
def word_list(begin: str = "piece_bpe_32k.model", end: str = "word_bpe_49k.json") -> frozenset[str]:
    """Words of three letters or more: pieces that begin a word in one public vocabulary and end one in another."""
    import public_tokenizers
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(begin))
    begins = {pieces.id_to_piece(i)[1:].lower() for i in range(pieces.get_piece_size()) if pieces.id_to_piece(i).startswith("\u2581")}
    with open(public_tokenizers.path(end), encoding="utf-8") as f:
        ends = {w.removesuffix("</w>") for w in json.load(f)["model"]["vocab"] if w.endswith("</w>")}
    return frozenset(w for w in begins & ends if len(w) >= 3 and w.isascii() and w.isalpha())


def bare(value: str) -> str:
    """A candidate without the punctuation that ends a sentence or decoration."""
    return value.rstrip(".,;:!?#$%&*") or value


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, pattern) of every candidate, by place; of overlapping ones the earliest named pattern stays."""
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []  # by place, apart from each other
    hinted = _HINT.search(text) is not None
    for name, pattern in PATTERNS.items():
        if name != "random" and not hinted:
            continue
        for m in pattern.finditer(text):
            start = m.start("value")
            end = m.end("value") if name == "private_key" else start + len(bare(m["value"]))
            at = bisect(taken, (end,))
            if end - start >= 8 and not (at and taken[at - 1][1] > start):
                found.append((start, end, name))
        taken = sorted((a, b) for a, b, _ in found)
    return sorted(found)


def transitions(words: frozenset[str]) -> np.ndarray:
    """Log frequencies of character pairs in words."""
    counts = np.full((128, 128), 0.5)
    for word in words:
        for a, b in zip(word, word[1:]):
            counts[ord(a), ord(b)] += 1
    return np.log(counts / counts.sum(axis=1, keepdims=True))


FEATURES = [
    "length", "entropy", "transition", "class_changes", "digits", "upper", "hexadecimal", "coverage", "distinct",
    "slashes", "extension", "underscores", "good_words", "bad_words", "assigned", "prefixed", "uuid", "longest_run",
    "good_path", "bad_path",
]
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_EXTENSION = re.compile(r"\.[a-z]{1,4}\d?$|^[a-z]+://|^/|\.(com|org|net|io)\b", re.I)


def features(text: str, start: int, end: int, pattern: str, path: str, words: frozenset[str], pairs: np.ndarray) -> list[float]:
    """Length, character transitions, dictionary coverage, marks of a path in it and around it, neighbouring words."""
    value = text[start:end]
    n = len(value)
    counts = np.unique(list(value), return_counts=True)[1] / n
    codes = np.minimum(np.frombuffer(value.lower().encode("utf-32-le"), np.uint32), 127)
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in value]
    covered, i, low = 0, 0, value.lower()
    while i < n:
        size = next((k for k in range(min(12, n - i), 2, -1) if low[i : i + k] in words), 0)
        covered += size
        i += size or 1
    run = longest = 1
    for a, b in zip(value, value[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    parts = re.findall(r"[a-z_]+", path.lower())
    near = re.findall(r"[a-z0-9]+", (text[max(0, start - REACH) : start] + " " + text[end : end + REACH]).lower().replace("_", " "))
    return [
        math.log(n), float(-(counts * np.log2(counts)).sum()), float(pairs[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, kinds.count(0) / n, kinds.count(2) / n, sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        covered / n, len(counts) / n, value.count("/") / n, float(bool(_EXTENSION.search(value))), (value.count("_") + value.count("-")) / n,
        float(sum(w in GOOD_WORDS for w in near)), float(sum(w in BAD_WORDS for w in near)), float(pattern == "assigned"),
        float(pattern in ("prefixed", "private_key")), float(bool(_UUID.match(value))), longest / n,
        float(not GOOD_PATHS.isdisjoint(parts)), float(not BAD_PATHS.isdisjoint(parts)),
    ]


class Tree:
    """A binary tree on Gini impurity; each split looks at a random part of the features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = 10, least: int = 2):
        self.value = float(y.mean())
        self.feature = -1
        if depth == 0 or len(y) < 2 * least or self.value in (0.0, 1.0):
            return
        best = (1e-9, -1, 0.0)
        whole = self.value * (1 - self.value) * len(y)
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, positive = x[order, f], np.cumsum(y[order])
            left = np.arange(1, len(y))
            p = positive[:-1] / left
            q = (positive[-1] - positive[:-1]) / (len(y) - left)
            gain = whole - left * p * (1 - p) - (len(y) - left) * q * (1 - q)
            gain[(v[:-1] == v[1:]) | (left < least) | (len(y) - left < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float((v[k] + v[k + 1]) / 2))
        if best[1] >= 0:
            self.feature, self.cut = best[1:]
            low = x[:, self.feature] <= self.cut
            self.low, self.high = Tree(x[low], y[low], rng, depth - 1, least), Tree(x[~low], y[~low], rng, depth - 1, least)

    def predict(self, row: list[float]) -> float:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.value


class Forest:
    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(Tree(x[rows], y[rows], rng))

    def predict(self, row: list[float]) -> float:
        return sum(t.predict(row) for t in self.trees) / len(self.trees)


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[str, int, str]]:
    """Made-up lines with one candidate each, whether it is a secret, and a path: the default training set."""
    rng = random.Random(seed)
    listed = sorted(word_list())
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    word = lambda: rng.choice(listed)
    pseudo = lambda: "".join(rng.choices(["th", "er", "an", "on", "re", "ti", "en", "de", "la", "qu", "os", "ver", "sch", "ung"], k=rng.randint(2, 5)))
    prose = lambda k: " ".join(rng.choice((word, pseudo))() for _ in range(k))
    # most findings come without a path; where there is one, it tells a little
    places = sorted(GOOD_PATHS), sorted(BAD_PATHS)
    path = lambda label: "" if rng.random() < 0.6 else f"{word()}/{rng.choice(places[label != (rng.random() < 0.8)])}/{word()}.txt"
    hexa, mixed, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    name = lambda: rng.choice(["token", "secret", "password", "api_key", "apikey", "auth_token", "client_secret", "access_key", "db_password", "Password", "API_KEY"])
    op = lambda: rng.choice([" = ", "=", ": ", ":", " := "])
    quote = lambda s: rng.choice(['"%s"', "'%s'", "%s"]) % s
    real = [
        lambda: name() + op() + quote(pick(hexa, rng.choice([32, 40, 64]))), lambda: name() + op() + quote(pick(mixed, rng.randint(16, 64))),
        lambda: name() + op() + quote(pick(b64, rng.randint(20, 60)) + "="), lambda: name() + op() + quote(word() + pick(string.digits + "!@#$%", 6) + pick(mixed, 4)),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(mixed, 36), lambda: "sk_live_" + pick(mixed, 24),
        lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(mixed, 24), lambda: "AIza" + pick(mixed, 35), lambda: "Authorization bearer " + pick(mixed, 40),
        lambda: f"eyJ{pick(mixed, 30)}.eyJ{pick(mixed, 40)}.{pick(mixed, 43)}", lambda: "login key " + pick(mixed, 32),
    ]
    false = [
        lambda: rng.choice(["commit ", "sha1 ", "revision ", "build "]) + pick(hexa, 40), lambda: rng.choice(["sha256 ", "checksum ", "digest "]) + pick(hexa, 64),
        lambda: "md5 hash " + pick(hexa, 32), lambda: "uuid " + "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: "/".join(word() for _ in range(5)) + "/" + word() + pick(string.digits, 2),
        lambda: "_".join(word() for _ in range(5)) + pick(string.digits, 1), lambda: "".join(word().title() for _ in range(5)) + pick(string.digits, 1),
        lambda: name() + op() + quote(rng.choice(["your_api_key_here", "changeme_please", "xxxxxxxxxxxxxxxx", "example_token_value", "password", "placeholder123", "${SECRET_TOKEN}", "os.environ_token", "12345678", "00000000000000000000"])),
        lambda: name() + op() + word() + "_" + word() + "_" + word(), lambda: pick(string.digits, rng.randint(20, 30)), lambda: "image data src " + pick(b64, rng.randint(60, 200)),
        lambda: name() + ": " + pseudo() + pseudo(), lambda: "-".join(word() for _ in range(4)) + "-" + pick(string.digits, 4) + "-" + word(), lambda: "id " + pick(hexa, 24),
        lambda: "=" * rng.randint(20, 60) + "1", lambda: "".join(pseudo() for _ in range(4)) + pick(string.digits, 2), lambda: "etag " + pick(mixed, 32),
    ]
    out = []
    for i in range(n):
        label = int(i % 2 == 0)
        line = rng.choice(real if label else false)()
        out.append((f"{prose(rng.randint(0, 8))} {line}{rng.choice(['', '.', ' ', '###'])} {prose(rng.randint(0, 8))}", label, path(label)))
    return out


class Detector:
    """A forest trained from (line, is it a secret) or (line, is it, path) findings; a line's candidates take its label.

    It holds the word list and the trees, whose sizes follow from the vocabularies and the findings given.
    """

    def __init__(self, findings: list[tuple], words: frozenset[str]):
        self.words, self.pairs = words, transitions(words)
        x, y = [], []
        for line, label, *path in findings:
            for start, end, pattern in candidates(line):
                x.append(features(line, start, end, pattern, path[0] if path else "", words, self.pairs))
                y.append(label)
        self.forest = Forest(np.array(x), np.array(y, float))

    def secrets(self, text: str, path: str = "") -> list[tuple[int, int, str, float]]:
        """(start, end, pattern, score) of the candidates that the forest takes for secrets."""
        out = []
        for start, end, pattern in candidates(text):
            score = self.forest.predict(features(text, start, end, pattern, path, self.words, self.pairs))
            if score >= THRESHOLD:
                out.append((start, end, pattern, score))
        return out


@lru_cache(1)
def default_detector() -> Detector:
    return Detector(labelled_findings(), word_list())


def scan(docs: DataFrame, findings: list[tuple] | None = None, path: str | None = None) -> DataFrame:
    """One row per secret: doc_id, start and end (characters), pattern, score.

    Null and empty texts have none, an empty table gives no rows, and of rows that repeat each is scanned.
    ``findings`` are labelled lines to train from instead of the made-up ones; the forest is small and is
    trained once on the driver. ``path`` names the column with the place that a text comes from (a file's
    path or another source); null is none.
    """
    detector = Detector(findings, word_list()) if findings else default_detector()
    shipped = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = shipped.value
        for batch in batches:
            rows = [
                (i, *s)
                for i, t, p in zip(batch.column("doc_id").to_pylist(), as_text(batch.column("text")).to_pylist(), batch.column("path").to_pylist())
                for s in detector.secrets(t, p)
            ]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "start", "end", "pattern", "score"]
                )

    place = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    return docs.select("doc_id", "text", place.alias("path")).mapInArrow(
        run, "doc_id long, start long, end long, pattern string, score double"
    )


def redact(docs: DataFrame, mask: str = "[REDACTED]", path: str | None = None) -> DataFrame:
    """The same rows and columns, every secret in ``text`` replaced by ``mask``; null stays null."""
    shipped = docs.sparkSession.sparkContext.broadcast(default_detector())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = shipped.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            places = batch.column(path).cast(pa.string()).to_pylist() if path else [None] * len(texts)
            for k, (text, place) in enumerate(zip(texts, places)):
                for start, end, *_ in reversed(detector.secrets(text, place or "") if text else []):
                    texts[k] = texts[k][:start] + mask + texts[k][end:]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(lambda b: trimmed(run(b)), docs.schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in every whole text of ``documents``, with the document's source as its path."""
    arrow_limits(spark)
    return scan(only(table(spark, sf_dir, "documents"), doc_id="long", text="string", source="string"), path="source")
