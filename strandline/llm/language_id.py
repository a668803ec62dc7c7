"""Language identification: known words first, then progressively shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_limits, as_text, only, table

#: Labelled rows that the model is fitted on at most (in expectation), words and n-grams kept per language,
#: and the longest n-gram. The model's size follows from these and the number of languages alone.
FIT_ROWS, WORDS, GRAMS, LONGEST = 20_000, 20_000, 8_000, 4
#: Words whose scores a worker remembers, and words looked up at once.
CACHE_WORDS, BATCH_WORDS = 200_000, 100_000
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def held_out(key: Column) -> Column:
    """True for rows kept from fitting: crc32 of the key as text leaves 1 modulo 3, or the key is null."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(True))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) partial counts by batch, of ``lang`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), as_text(batch.column("text")).to_pylist()):
                found.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            if rows:
                lang, word, n = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"]
                )

    return texts.mapInArrow(run, "lang string, word string, n long")


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, size, word, n): n-grams of the counted words with their ends marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                for gram in grams(word, range(1, LONGEST + 1)):
                    found[lang, gram] += n
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in found], pa.string()), pa.array([len(k[1]) for k in found], pa.int32()),
                        pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64()),
                    ],
                    ["lang", "size", "word", "n"],
                )

    return words.mapInArrow(run, "lang string, size int, word string, n long")


def grams(word: str, sizes: range) -> Iterator[str]:
    marked = f"<{word}>"
    for n in sizes:
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]


class Model:
    """Per-language log frequencies of words (size 0) and of n-grams by size."""

    def __init__(self, rows: list[tuple[str, int, str, int]]):
        """``rows``: (lang, size, word or n-gram, count)."""
        self.langs = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        counts: dict[tuple[int, str], list[int]] = {}
        totals = np.zeros((LONGEST + 1, max(1, len(at))))
        for lang, size, word, n in rows:
            counts.setdefault((size, word), [0] * len(at))[at[lang]] += n
            totals[size, at[lang]] += n
        self.index = {key: i for i, key in enumerate(counts)}
        raw = np.array(list(counts.values()), np.float64).reshape(len(counts), len(at))
        size_of = np.array([k[0] for k in counts], int)
        seen = np.array([max(1, (size_of == s).sum()) for s in range(LONGEST + 1)])
        self.table = np.log((raw + 0.5) / (totals[size_of] + 0.5 * seen[size_of][:, None])).astype(np.float32) if len(counts) else raw

    def word(self, w: str) -> np.ndarray:
        """Scores of one word: its own log frequencies if it is known, else the mean of those of its longest known n-grams."""
        i = self.index.get((0, w))
        if i is not None:
            return self.table[i]
        for n in range(min(LONGEST, len(w) + 2), 0, -1):
            found = [i for g in grams(w, range(n, n + 1)) if (i := self.index.get((n, g))) is not None]
            if found:
                return self.table[found].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


class Predictor:
    """Predicts texts by batch: each differing word of a batch is scored once and remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.at: dict[str, int] = {}
        self.scores = np.zeros((CACHE_WORDS, len(model.langs)))

    def rows(self, words: list[str]) -> np.ndarray:
        """Scores of differing words."""
        if len(self.at) + len(words) > CACHE_WORDS:
            self.at.clear()
        if len(words) > CACHE_WORDS:
            return np.array([self.model.word(w) for w in words], np.float64)
        for w in words:
            if w not in self.at:
                self.scores[len(self.at)] = self.model.word(w)
                self.at[w] = len(self.at)
        return self.scores[[self.at[w] for w in words]]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior of each text."""
        langs = self.model.langs
        counts, words = np.zeros(len(texts), np.int64), []
        totals = np.zeros((len(texts), max(1, len(langs))))
        first = 0

        def add(last: int) -> None:
            """Add up the words held, which are those of the texts from ``first`` to ``last``."""
            if words:
                coded = pa.array(words, pa.string()).dictionary_encode()
                scores = self.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
                some = first + np.flatnonzero(counts[first : last + 1])
                at = np.cumsum(counts[some]) - counts[some]
                totals[some] = np.add.reduceat(scores, at, axis=0)
            words.clear()

        for i, text in enumerate(texts):
            if not text or not langs:
                continue
            found = _WORD.findall(text.lower())
            if not any(c.isalpha() for w in found for c in w):
                continue
            if len(words) + len(found) > BATCH_WORDS:
                add(i - 1)
                first = i
            counts[i] = len(found)
            words += found
        add(len(texts) - 1)
        out = []
        for n, total in zip(counts.tolist(), totals):
            if not n:
                out.append((UNDETERMINED, 0.0))
                continue
            # the mean word's evidence, as if of 20 words at most: a long text would else always give 1
            logits = total / n * min(n, 20)
            best = int(np.argmax(logits))
            out.append((langs[best], 1.0 / float(np.exp(logits - logits[best]).sum())))
        return out


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on rows with text and lang that ``held_out`` leaves, about ``fit_rows`` of them by a hash of the key.

    Only counts come to the driver: ``WORDS`` words and ``GRAMS`` n-grams of each size per language.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    share = min(1.0, fit_rows / max(1, known.count()))
    part = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    words = word_counts(part.select("lang", "text")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    both = words.select("lang", F.lit(0).alias("size"), "word", "n").unionAll(
        gram_counts(words).groupBy("lang", "size", "word").agg(F.sum("n").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "word"))
    kept = both.withColumn("_r", rank).where(F.col("_r") <= F.when(F.col("size") == 0, WORDS).otherwise(GRAMS))
    return Model([tuple(r) for r in kept.drop("_r").collect()])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score (posterior, 0 to 1) of every whole text; ``und`` with 0 where
    the text is null or has no letter, or nothing was learned. Only the text decides: equal texts, also in rows
    that repeat, get equal answers, and each row its own. An empty table gives no rows. Of languages that
    are equally likely the first in order of names counts."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS, GRAMS and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shipped.value)
        for batch in batches:
            found = predictor.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"),
                    pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return texts.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned from rows that aren't held out."""
    arrow_limits(spark)
    docs = only(table(spark, sf_dir, "documents"), doc_id="long", text="string", lang="string")
    return identify(docs, fit(docs))
