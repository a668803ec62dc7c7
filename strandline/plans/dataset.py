"""Sample sets: a leaf table whose rows are addressed by number, with media joined on demand."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted
from ..operators.index import numbered
from ..session import exists
from ..sources.media import lookup

#: Rows of a set that is pickled with its rows.
PICKLED = 1_000_000


@dataclass(frozen=True)
class Stream:
    """Media of one kind: a table (input_id, seq, data) and the samples' column that indexes it."""

    index: str
    path: str | None = None
    data: DataFrame | None = field(default=None, compare=False, hash=False)
    media_index: str = "seq"
    value: str = "data"

    def table(self, spark: SparkSession) -> DataFrame:
        return self.data if self.data is not None else spark.read.parquet(self.path)


class SampleSet:
    """``samples`` has sample_idx, input_id and data columns; ``streams`` are joined by ``get_batch``."""

    def __init__(self, samples: DataFrame, streams: Mapping[str, Stream] | None = None):
        kind = samples.schema["input_id"].dataType if "input_id" in samples.columns else None
        if not isinstance(kind, T.StringType):
            raise ValueError("samples need a column input_id of strings")
        if "sample_idx" not in samples.columns:
            raise ValueError("samples need a column sample_idx")
        missing = {s.index for s in (streams or {}).values()} - set(samples.columns)
        if missing:
            raise ValueError(f"no such index columns: {sorted(missing)}")
        self.samples, self.streams = samples, dict(streams) if streams is not None else None
        self.path: str | None = None

    @classmethod
    def build(cls, leaf: DataFrame, order: Sequence[str], streams: Mapping[str, Stream] | None = None) -> SampleSet:
        return cls(numbered(leaf, order), streams)

    @property
    def meta(self) -> DataFrame:
        return self.samples.select("sample_idx", "input_id")

    @property
    def data(self) -> DataFrame:
        return self.samples.drop("input_id")

    def __len__(self) -> int:
        return self.samples.count()

    def __getitem__(self, index: int) -> DataFrame:
        return self.get_batch([index])

    def __getitems__(self, index: Sequence[int]) -> DataFrame:
        return self.get_batch(index)

    def get_batch(self, index: Sequence[int] | range | slice, include_streams: bool | None = None, include_meta: bool = True) -> DataFrame:
        """The rows of ``index`` with their place ``pos`` in it; repeated ones repeat. Streams are joined if
        there are any (None), must be there (True) or are left out (False). Runs of numbers are filtered by
        range, which reaches the scan; others are joined with the few numbers asked for."""
        if include_streams and not self.streams:
            raise ValueError("there are no streams to include")
        if isinstance(index, slice):
            start, stop = index.start or 0, index.stop if index.stop is not None else len(self)
            index = range(start, stop, index.step or 1)
        if isinstance(index, range) and index.step > 0:
            rows = self.samples.where((F.col("sample_idx") >= index.start) & (F.col("sample_idx") < index.stop))
            rows = rows.withColumn("pos", (F.col("sample_idx") - index.start) / index.step).where(f"(sample_idx - {index.start}) % {index.step} = 0")
            rows = rows.withColumn("pos", F.col("pos").cast("long"))
        else:
            asked = self.samples.sparkSession.createDataFrame([(p, int(i)) for p, i in enumerate(index)], "pos long, sample_idx long")
            rows = self.samples.join(F.broadcast(asked), "sample_idx")  # a batch, given by the caller
        if include_streams is None:
            include_streams = bool(self.streams)
        if include_streams:
            spark = self.samples.sparkSession
            for name, s in self.streams.items():
                rows = lookup(rows, s.table(spark), s.index, name, media_index=s.media_index, value=s.value, key="pos")
        return rows.select("pos", *[quoted(c) for c in rows.columns if c != "pos" and (include_meta or c != "input_id")]).orderBy("pos")

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """data (Parquet by input_id), meta and streams (JSON) below ``path``, by Spark's writers."""
        self.samples.write.mode(mode).partitionBy("input_id").parquet(f"{path}/data")
        self.meta.write.mode(mode).parquet(f"{path}/meta")
        if self.streams is not None:
            if any(s.path is None for s in self.streams.values()):
                raise ValueError("streams of tables without a path can't be saved")
            text = json.dumps({n: {k: v for k, v in asdict_of(s).items()} for n, s in self.streams.items()})
            self.samples.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/streams")
        self.path = path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SampleSet:
        samples = spark.read.parquet(f"{path}/data")
        samples = samples.withColumn("input_id", F.col("input_id").cast("string"))
        streams = None
        if exists(spark, f"{path}/streams"):
            streams = {n: Stream(**s) for n, s in json.loads("".join(r[0] for r in spark.read.text(f"{path}/streams").collect())).items()}
        out = cls(samples, streams)
        out.path = path
        return out

    def __reduce__(self):
        """A set that was saved or loaded is pickled as its folder; another as its rows, PICKLED of them at most."""
        if self.path is not None:
            return _load, (self.path,)
        table = self.samples.limit(PICKLED + 1).toArrow()
        if table.num_rows > PICKLED:
            raise ValueError(f"a set of more than {PICKLED} rows must be saved before it is pickled")
        if self.streams and any(s.path is None for s in self.streams.values()):
            raise ValueError("streams of tables without a path can't be pickled")
        return _rebuild, (table, self.samples.schema.json(), self.streams)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, SampleSet) and self.equals(other)

    __hash__ = None

    def equals(self, other: SampleSet) -> bool:
        """Equal rows (counted) and streams."""
        if sorted(self.samples.columns) != sorted(other.samples.columns) or self.streams != other.streams:
            return False
        a, b = self.samples, other.samples.select(*map(quoted, self.samples.columns))
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def to_arrow(self, index: Sequence[int] | range) -> pa.Table:
        return self.get_batch(index).toArrow()


def _load(path: str) -> SampleSet:
    return SampleSet.load(SparkSession.getActiveSession(), path)


def _rebuild(table: pa.Table, schema: str, streams: Mapping[str, Stream] | None) -> SampleSet:
    spark = SparkSession.getActiveSession()
    return SampleSet(spark.createDataFrame(table, T.StructType.fromJson(json.loads(schema))), streams)


def asdict_of(s: Stream) -> dict:
    return {"index": s.index, "path": s.path, "media_index": s.media_index, "value": s.value}


def with_batch_ids(samples: DataFrame, batch_size: int, shuffle_seed: int | None = None, drop_last: bool = False) -> DataFrame:
    """Add ``batch_id`` and ``batch_pos``. Without a seed batches follow sample_idx, which needs no shuffle;
    with one, rows are dealt in the order of a hash of (seed, sample_idx). ``drop_last`` leaves out a last
    batch that isn't full."""
    if shuffle_seed is None:
        at = samples.withColumn("_at", F.col("sample_idx"))
    else:
        keyed = samples.withColumn("_h", F.xxhash64(F.lit(shuffle_seed), "sample_idx"))
        at = numbered(keyed.withColumnRenamed("sample_idx", "_s"), ["_h", "_s"]).withColumnRenamed("sample_idx", "_at").withColumnRenamed("_s", "sample_idx").drop("_h")
    out = at.withColumns({"batch_id": F.floor(F.col("_at") / batch_size), "batch_pos": (F.col("_at") % batch_size).cast("int")})
    if drop_last:
        total = samples.agg(F.count(F.lit(1)).alias("_total"))  # one row
        out = out.join(F.broadcast(total)).where(f"(batch_id + 1) * {batch_size} <= _total").drop("_total")
    return out.drop("_at")


class Shuffle:
    """A random order of n numbers, by number: four rounds of a Feistel network over the next even power of two,
    walked until the result is below n. Neither the order nor its inverse is ever held."""

    def __init__(self, n: int, seed: int):
        self.n, self.seed = n, seed
        self.half = max(1, -(-max(1, n - 1).bit_length() // 2))

    def __call__(self, i: int) -> int:
        low = (1 << self.half) - 1
        while True:
            a, b = i >> self.half, i & low
            for k in range(4):
                mixed = hashlib.blake2b(f"{self.seed} {k} {b}".encode(), digest_size=8).digest()
                a, b = b, a ^ (int.from_bytes(mixed, "little") & low)
            i = a << self.half | b
            if i < self.n:
                return i


class Loader:
    """Iterates over batches as Arrow tables, or over what ``collate`` makes of them.

    A batch is addressed by its number: its rows follow sample_idx, or with ``shuffle`` a random order of it
    that ``seed`` decides, and each is fetched by ``get_batch``, streams included. ``prebatch`` batches are
    fetched by one Spark job, ``num_workers`` jobs run beside each other, and ``num_workers *
    prefetch_factor`` are asked for ahead of the consumer. With ``in_order`` batches come by number, else
    as they are ready. The driver holds the batches asked for and no more.
    """

    def __init__(
        self, samples: SampleSet, batch_size: int = 1, shuffle: bool = False, seed: int = 0, drop_last: bool = False, collate=None,
        num_workers: int = 1, prefetch_factor: int = 2, in_order: bool = True, prebatch: int = 16, include_streams: bool | None = None,
    ):
        if min(batch_size, num_workers, prefetch_factor, prebatch) < 1:
            raise ValueError("sizes and numbers must be positive")
        self.set, self.size, self.shuffle, self.seed, self.drop_last, self.collate = samples, batch_size, shuffle, seed, drop_last, collate or (lambda t: t)
        self.workers, self.ahead, self.in_order, self.prebatch, self.include_streams = num_workers, num_workers * prefetch_factor, in_order, prebatch, include_streams

    def __len__(self) -> int:
        return self._batches(len(self.set))

    def _batches(self, n: int) -> int:
        return n // self.size if self.drop_last else -(-n // self.size)

    def _fetch(self, first: int, last: int, n: int) -> list[pa.Table]:
        """Batches first to last - 1."""
        places = range(first * self.size, min(last * self.size, n))
        if self.shuffle:
            order = Shuffle(n, self.seed)
            places = [order(i) for i in places]
        table = self.set.get_batch(places, self.include_streams).drop("pos").toArrow()
        return [table.slice(i * self.size, self.size) for i in range(last - first)]

    def __iter__(self) -> Iterator:
        n = len(self.set)
        batches = self._batches(n)
        runs = iter(range(0, batches, self.prebatch))
        with ThreadPoolExecutor(self.workers) as pool:
            waiting: list[Future] = []
            try:
                while True:
                    for first in islice(runs, self.ahead - len(waiting)):
                        waiting.append(pool.submit(self._fetch, first, min(batches, first + self.prebatch), n))
                    if not waiting:
                        return
                    ready = waiting[0] if self.in_order else next(as_completed(waiting))
                    waiting.remove(ready)
                    for table in ready.result():
                        yield self.collate(table)
            finally:
                for future in waiting:
                    future.cancel()
