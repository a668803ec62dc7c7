"""Toxicity by a chain of linear models, each fed with the earlier categories' probabilities."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, arrow_limits, blocks, only, prefix_hash, span_hash, table, trim_memory, trimmed, words

#: Labelled documents that the chain is fitted on at most (in expectation), word buckets, and how many of
#: them a category's model uses. The model's size and the rows of the task that fits follow from these alone.
FIT_ROWS, BUCKET_BITS, SELECTED = 8_000, 20, 128
#: A bucket counts so often in a document at most, in fitting and predicting alike.
MOST = 32_767
#: Pairs of documents and buckets that are counted at a time.
COUNT_PAIRS = 1 << 20
#: Lengths in bytes of the word beginnings that count as features of their own.
STEMS = (5, 6, 7, 8)
FOLDS, RIDGE, THRESHOLD = 5, 1.0, 0.5
#: Categories in the chain's order; each is an SQL condition on the columns of ``labels``.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_low_quality": "toxic = 1 AND quality = 0"}
REJECT = "toxic"
_PARTS = np.ones(256, bool)  # every ASCII byte but letters and digits parts words
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
DENSE = 4


def buckets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of documents: first document, documents, buckets and counts of the pairs, dense features.

    A word counts in its own bucket and in one for each of its beginnings of ``STEMS`` bytes, since
    inflected words share those.
    """
    for first, data, offsets in blocks(column):
        n = len(offsets) - 1
        starts, ends, at = words(data, offsets, _PARTS)
        owner = np.repeat(np.arange(n), np.diff(at))
        prefix = prefix_hash(_LOWER[data])
        hashes, owners = [span_hash(prefix, starts, ends)], [owner]
        for k in STEMS:
            longer = ends - starts >= k
            hashes.append(span_hash(prefix, starts[longer], starts[longer] + k) + np.uint64(1))
            owners.append(owner[longer])
        pairs, counts = np.unique(
            np.concatenate(owners) << BUCKET_BITS | (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64),
            return_counts=True,
        )
        counts = np.minimum(counts, MOST)
        size = np.diff(offsets)
        share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]) / np.maximum(size, 1)  # noqa: E731, B023
        dense = np.stack(
            [np.log1p(size) / 10, share((data >= 65) & (data < 91)), share((data >= 48) & (data < 58)), share(_PARTS[data])], axis=1
        )
        yield first, pairs >> BUCKET_BITS, pairs & (1 << BUCKET_BITS) - 1, counts, dense


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Linear:
    """Ridge logistic regression on the buckets that tell the category best, and on dense columns."""

    def __init__(
        self, selected: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, dense: np.ndarray, y: np.ndarray
    ):
        n, size = len(y), 1 << BUCKET_BITS
        self.selected = selected
        place = np.full(size, -1)
        place[self.selected] = np.arange(len(self.selected))
        at = place[cols]
        x = np.zeros((n, len(self.selected) + dense.shape[1] + 1))
        x[rows[at >= 0], at[at >= 0]] = values[at >= 0]
        x[:, len(self.selected) : -1] = dense
        x[:, -1] = 1
        w = np.zeros(x.shape[1])
        penalty = np.full(x.shape[1], RIDGE)
        penalty[-1] = 1e-3
        for _ in range(12):
            prob = sigmoid(x @ w)
            step = np.linalg.solve((x * (prob * (1 - prob) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (prob - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-4:
                break
        self.chosen, self.dense = w[: len(self.selected)], w[len(self.selected) :]
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def predict(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, dense: np.ndarray) -> np.ndarray:
        if self.table is None:  # made where it is used: only the selected weights are shipped
            self.table = np.zeros(1 << BUCKET_BITS, np.float32)
            self.table[self.selected] = self.chosen
        return sigmoid(np.bincount(rows, self.table[cols] * values, len(dense)) + dense @ self.dense[:-1] + self.dense[-1])


def best_buckets(positive: np.ndarray, every: np.ndarray, n_positive: float, n: int) -> np.ndarray:
    """The ``SELECTED`` buckets that tell a category best, from the documents of each bucket."""
    a, b = positive + 0.5, every - positive + 0.5
    p, q = n_positive + 1 - a, n - n_positive + 1 - b
    z = np.log(a * q.clip(0.5) / (b * p.clip(0.5))) / np.sqrt(1 / a + 1 / b)
    return np.argsort(-np.abs(z), kind="stable")[:SELECTED]


def selections(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int) -> list[list[np.ndarray]]:
    """Of each category, the buckets chosen without each fold and, last, those chosen from all rows.

    All pairs are counted, in parts, so that no copy of them is needed to choose from the whole vocabulary.
    """
    size, kind = 1 << BUCKET_BITS, np.min_scalar_type(len(y))

    def counted(of: np.ndarray) -> np.ndarray:
        """By fold, how many of the documents marked in ``of`` have each bucket."""
        counts = np.zeros((folds, size), kind)
        for at in range(0, len(rows), COUNT_PAIRS):
            r, c = rows[at : at + COUNT_PAIRS], cols[at : at + COUNT_PAIRS]
            for f in range(folds):
                counts[f] += np.bincount(c[(fold[r] == f) & of[r]], minlength=size).astype(kind)
        return counts

    every = counted(np.ones(len(y), bool))
    all_of = every.sum(axis=0, dtype=np.int32)
    out = []
    for k in range(y.shape[1]):
        own = counted(y[:, k] > 0)
        positive = own.sum(axis=0, dtype=np.int32)
        parts = [best_buckets(positive - own[f], all_of - every[f], y[fold != f, k].sum(), (fold != f).sum()) for f in range(folds)]
        out.append([*parts, best_buckets(positive, all_of, y[:, k].sum(), len(y))])
    return out


class Chain:
    """Category k's model sees the words, the dense features and the probabilities of categories before k.

    While fitting, those probabilities are out of fold: each comes from a model that hasn't seen its row,
    so later models learn from probabilities as good as those they meet when predicting. ``values`` are
    the pairs' counts when fitting and their logarithms when predicting.
    """

    def __init__(
        self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, dense: np.ndarray, y: np.ndarray, folds: int = FOLDS
    ):
        self.models: list[Linear] = []
        fold = np.arange(len(dense)) % folds
        chosen = selections(rows, cols, y, fold, folds)
        used = np.zeros(1 << BUCKET_BITS, bool)
        used[np.concatenate([s for parts in chosen for s in parts])] = True
        kept = used[cols]  # pairs of other buckets have no weight in any model
        rows, cols, values = rows[kept], cols[kept], np.log1p(values[kept].astype(np.float64))
        for k in range(y.shape[1]):
            out_of_fold = np.zeros(len(dense))
            for f in range(folds):
                kept = np.flatnonzero(fold != f)
                renamed = np.full(len(dense), -1)
                renamed[kept] = np.arange(len(kept))
                inside = renamed[rows] >= 0
                part = Linear(chosen[k][f], renamed[rows[inside]], cols[inside], values[inside], dense[kept], y[kept, k])
                out_of_fold[fold == f] = part.predict(rows, cols, values, dense)[fold == f]
            self.models.append(Linear(chosen[k][folds], rows, cols, values, dense, y[:, k]))
            dense = np.concatenate([dense, out_of_fold[:, None]], axis=1)

    def predict(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, dense: np.ndarray) -> np.ndarray:
        for m in self.models:
            dense = np.concatenate([dense, m.predict(rows, cols, values, dense)[:, None]], axis=1)
        return dense[:, DENSE:]


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, fit_rows: int = FIT_ROWS) -> Chain | None:
    """Fit on about ``fit_rows`` labelled documents, chosen by a hash of doc_id; None without any.

    A document labelled twice counts once, with the largest value of each category. Buckets and labels of
    those documents go to one task, which fits; only the fitted chain comes to the driver.
    """
    each = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        *(F.max(F.coalesce(F.expr(c), F.lit(False)).cast("double")).alias(name) for name, c in categories.items())
    )
    share = min(1.0, fit_rows / max(1, each.count()))
    some = each.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    names = list(categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            ids = batch.column("doc_id").to_pylist()
            for first, rows, cols, values, dense in buckets(batch.column("text")):
                cut = np.searchsorted(rows, np.arange(len(dense) + 1))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids[first : first + len(dense)],
                    "cols": pa.array([cols[a:b] for a, b in zip(cut, cut[1:])], pa.list_(pa.int32())),
                    "counts": pa.array([values[a:b] for a, b in zip(cut, cut[1:])], pa.list_(pa.int16())),
                    "dense": pa.array(list(dense), pa.list_(pa.float64())),
                    "y": pa.array(list(y[first : first + len(dense)]), pa.list_(pa.float64())),
                })

    # ``some`` has about fit_rows rows of four numbers, whatever the input's size
    chosen = docs.where("text IS NOT NULL").join(F.broadcast(some), "doc_id").mapInArrow(
        run, "doc_id long, cols array<int>, counts array<smallint>, dense array<double>, y array<double>"
    )
    # one task fits, as it is small for executors but not for the driver; only the chain's few weights come here
    got = chosen.repartition(1).sortWithinPartitions("doc_id").mapInArrow(fitted, "chain binary").collect()
    return pickle.loads(got[0]["chain"]) if got else None


def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chain, pickled, that all rows (cols, counts, dense, y) of ``batches`` give; nothing without any."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    got = pa.Table.from_batches(held)
    del held
    dense, y = (np.array(got.column(c).to_pylist()) for c in ("dense", "y"))
    lists = got.column("cols").combine_chunks()
    cols, counts = lists.values.to_numpy(), got.column("counts").combine_chunks().values.to_numpy()
    rows = np.repeat(np.arange(got.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    del got, lists
    chain = Chain(rows, cols, counts, dense, y)
    del rows, cols, counts
    yield pa.RecordBatch.from_pydict({"chain": pa.array([pickle.dumps(chain)], pa.binary())})
    trim_memory()


def probabilities(column: pa.Array, chain: Chain | None, n: int) -> np.ndarray:
    """Of each text, its probability in each of n categories; 0 for texts without words or without a chain."""
    out = np.zeros((len(column), n))
    if chain is not None:
        for first, rows, cols, values, dense in buckets(column):
            some = np.bincount(rows, minlength=len(dense)) > 0
            out[first : first + len(dense)] = chain.predict(rows, cols, np.log1p(values), dense) * some[:, None]
    return out


def score(docs: DataFrame, chain: Chain | None, categories: dict[str, str] = CATEGORIES, key: str = "doc_id") -> DataFrame:
    """``key``, ``toxic`` (the probability of ``REJECT`` is at least 0.5) and p_<category> of each category.

    Null, empty and whitespace texts have probabilities 0 and stay; without a fitted chain all do. Rows that
    repeat are scored each, and an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in categories]
    reject = list(categories).index(REJECT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = probabilities(batch.column("text"), shipped.value, len(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(out[:, reject] >= THRESHOLD), *(pa.array(out[:, k]) for k in range(len(names)))],
                [key, "toxic", *names],
            )

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, toxic boolean" + "".join(f", {n} double" for n in names))


def keep_clean(docs: DataFrame, chain: Chain | None, categories: dict[str, str] = CATEGORIES) -> DataFrame:
    """The rows of ``docs`` that ``score`` doesn't call toxic, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(chain)
    reject = list(categories).index(REJECT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch.column("text"), shipped.value, len(categories))[:, reject] < THRESHOLD))

    return docs.mapInArrow(lambda b: trimmed(run(b)), docs.schema)


def inputs(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    return only(docs, doc_id="long", text="string"), only(labels, doc_id="long", quality="int", toxic="int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every document, from a chain fitted on labelled documents."""
    arrow_limits(spark)
    docs, labels = inputs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score(docs, fit(docs, labels))
