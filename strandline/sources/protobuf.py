"""Protobuf payloads by their descriptors, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Protobuf field types by their number.
_KINDS = {
    1: T.DoubleType(), 2: T.FloatType(), 3: T.LongType(), 4: T.DecimalType(20, 0), 5: T.IntegerType(), 6: T.DecimalType(20, 0), 7: T.LongType(), 8: T.BooleanType(),
    9: T.StringType(), 12: T.BinaryType(), 13: T.LongType(), 14: T.StringType(), 15: T.IntegerType(), 16: T.LongType(), 17: T.IntegerType(), 18: T.LongType(),
}


@lru_cache(32)
def message_class(descriptor_set: bytes, name: str):
    """The message class from a FileDescriptorSet, its files added after those they depend on."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    files = {f.name: f for f in descriptor_pb2.FileDescriptorSet.FromString(descriptor_set).file}
    pool, added = descriptor_pool.DescriptorPool(), set()

    def add(file: str) -> None:
        if file in added or file not in files:
            return
        added.add(file)
        for other in files[file].dependency:
            add(other)
        pool.Add(files[file])

    for file in files:
        add(file)
    try:
        return message_factory.GetMessageClass(pool.FindMessageTypeByName(name))
    except KeyError as e:
        raise ValueError(f"the schema has no message {name}") from e


def field_type(field) -> T.DataType:
    kind = T.StructType([T.StructField(f.name, field_type(f)) for f in field.message_type.fields]) if field.message_type else _KINDS[field.type]
    return T.ArrayType(kind) if field.is_repeated else kind


def value(message, field) -> object:
    got = getattr(message, field.name)
    if field.is_repeated:
        return [plain(x, field) for x in got]
    if field.message_type and not message.HasField(field.name):
        return None
    return plain(got, field)


def plain(x, field) -> object:
    if field.message_type:
        return {f.name: value(x, f) for f in field.message_type.fields}
    if field.enum_type:
        found = field.enum_type.values_by_number.get(x)
        return found.name if found else str(x)
    if isinstance(_KINDS[field.type], T.DecimalType):
        from decimal import Decimal

        return Decimal(x)
    return x


def decode_protobuf(df: DataFrame, descriptor_set: bytes, name: str, fields: Sequence[str], payload: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the message's top-level ``fields`` of each payload; enums by name, unsigned longs as decimals."""
    known = {f.name: f for f in message_class(descriptor_set, name).DESCRIPTOR.fields}
    for f in fields:
        if f not in known:
            raise ValueError(f"message {name} has no field {f}")
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(f, field_type(known[f])) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = message_class(descriptor_set, name)
        own = {f.name: f for f in kind.DESCRIPTOR.fields}
        for batch in batches:
            messages = [kind.FromString(p) for p in batch.column(payload).to_pylist()]
            columns = [pa.array([value(m, own[f]) for m in messages], to_arrow_type(schema[f].dataType)) for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *columns], schema.names)

    return df.mapInArrow(run, schema)
