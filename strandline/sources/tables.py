"""JSON record lists, GeoJSON, and the formats that Spark reads itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted
from ..functions.geo import point


def flatten(df: DataFrame) -> DataFrame:
    """Fields of structs as columns, at all depths; a name's first use stands."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema):
        out, seen = [], set()
        for f in df.schema:
            parts = [(g.name, quoted(f.name).getField(g.name)) for g in f.dataType] if isinstance(f.dataType, T.StructType) else [(f.name, quoted(f.name))]
            for n, c in parts:
                if n not in seen:
                    seen.add(n)
                    out.append(c.alias(n))
        df = df.select(*out)
    return df


def scan_json_records(spark: SparkSession, path: str, records: str = "records", schema: str | T.StructType | None = None) -> DataFrame:
    """(input_id, seq, the records' fields): whole-file JSON with a list of records; seq is the place in it."""
    reader = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true")
    files = (reader.schema(schema) if schema else reader).json(path)
    rows = files.select(F.input_file_name().alias("input_id"), F.posexplode(records).alias("seq", "_r"))
    return flatten(rows)


def scan_geojson(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """(input_id, seq, properties, geom): point features, in the file's order."""
    reader = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true")
    files = (reader.schema(schema) if schema else reader).json(path)
    rows = files.select(F.input_file_name().alias("input_id"), F.posexplode("features").alias("seq", "_f"))
    xy = F.col("_f.geometry.coordinates")
    return rows.select("input_id", "seq", "_f.properties.*", point(F.get(xy, 0), F.get(xy, 1)).alias("geom"))


def scan(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """Parquet, ORC, CSV, JSON lines or text, by Spark's own readers."""
    return spark.read.format(kind).options(**options).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
