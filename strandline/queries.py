"""Registered queries over the recording operators, and the SQL that says the same.

Results hold scalars only: lists are exploded with their place, so both engines can be compared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import columns as C
from .functions import geo
from .functions.durations import key_number
from .operators.align import AsOf, Field, Interp, align
from .operators.concat import concat
from .operators.group_dynamic import group_dynamic
from .operators.index import with_row_index
from .operators.sql import sql
from .operators.tree import partition_split, tree_map, unnest
from .operators.waypoints import with_waypoints
from .plans.dataset import SampleSet, Stream, with_batch_ids
from .plans.sinks import Component, ViewerSink
from .session import shared_folder
from .sources import framed_log, mcap, media
from .sources.path import extract_path
from .sources.writers import npy_bytes, write_files, write_framed_log, write_mcap

FLAGSHIP = "drive_clips"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _events(spark: SparkSession, sf_dir: str, kind: str, value: str = "value") -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", "event_id", "ts", value)


# --- alignment ---------------------------------------------------------------------------------------------

_SIDES = """WITH l AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, event_id AS r_id, ts AS r_ts, value AS r_value FROM events WHERE event_type = 'click'),
s AS (SELECT user_id, event_id AS s_id, ts AS s_ts, value AS s_value FROM events WHERE event_type = 'view'),
b AS (SELECT l.*, r_id AS b_id, r_ts AS b_ts, r_value AS b_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.r_ts),
f AS (SELECT l.*, r_id AS f_id, r_ts AS f_ts, r_value AS f_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.r_ts),
n AS (SELECT b.*, f_id, f_ts, f_value, f_ts IS NOT NULL AND (b_ts IS NULL OR epoch_us(f_ts) - epoch_us(b.ts) <= epoch_us(b.ts) - epoch_us(b_ts)) AS later FROM b JOIN f USING (event_id))
"""


def _asof(how: AsOf):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left = _events(spark, sf_dir, "purchase").drop("value")
        right = _events(spark, sf_dir, "click")
        out = align(
            {"purchase": left, "click": right},
            {"purchase": Field("ts"), "click": Field("ts", {"event_id": how, "value": how})}, by=("user_id",), order="event_id",
        )
        return out.select("user_id", C.quoted("purchase/event_id").alias("event_id"), C.quoted("click/event_id").alias("r_id"), C.quoted("click/value").alias("r_value"))

    return run


for _name, _how, _sql in (
    ("align_asof_backward", AsOf("backward"), "SELECT user_id, event_id, b_id AS r_id, b_value AS r_value FROM b"),
    ("align_asof_forward", AsOf("forward"), "SELECT user_id, event_id, f_id AS r_id, f_value AS r_value FROM f"),
    ("align_asof_nearest", AsOf("nearest"), "SELECT user_id, event_id, CASE WHEN later THEN f_id ELSE b_id END AS r_id, CASE WHEN later THEN f_value ELSE b_value END AS r_value FROM n"),
    ("align_asof_tolerance", AsOf("nearest", "1h"), """SELECT user_id, event_id, CASE WHEN abs(epoch_us(CASE WHEN later THEN f_ts ELSE b_ts END) - epoch_us(ts)) <= 3600000000 THEN CASE WHEN later THEN f_id ELSE b_id END END AS r_id,
CASE WHEN abs(epoch_us(CASE WHEN later THEN f_ts ELSE b_ts END) - epoch_us(ts)) <= 3600000000 THEN CASE WHEN later THEN f_value ELSE b_value END END AS r_value FROM n"""),
):
    QUERIES[_name] = _asof(_how)
    ORACLE_SQL[_name] = _SIDES + _sql


@query(_SIDES + "SELECT user_id, event_id, b_ts AS r_ts, b_value AS r_value FROM b")
def align_asof_keep_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(
        {"p": _events(spark, sf_dir, "purchase").drop("value"), "c": _events(spark, sf_dir, "click")},
        {"p": Field("ts"), "c": Field("ts", {"ts": AsOf(), "value": AsOf()})}, by=("user_id",),
    )
    return out.select("user_id", C.quoted("p/event_id").alias("event_id"), C.quoted("c/ts").alias("r_ts"), C.quoted("c/value").alias("r_value"))


_INTERP = "CASE WHEN b_ts = ts THEN b_value WHEN f_ts = ts THEN f_value ELSE b_value + (f_value - b_value) * (epoch_us(ts) - epoch_us(b_ts)) / (epoch_us(f_ts) - epoch_us(b_ts)) END"


@query(_SIDES + f"SELECT user_id, event_id, round({_INTERP}, 6) AS r_value FROM n")
def align_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(
        {"p": _events(spark, sf_dir, "purchase").drop("value"), "c": _events(spark, sf_dir, "click")},
        {"p": Field("ts"), "c": Field("ts", {"value": Interp()})}, by=("user_id",),
    )
    return out.select("user_id", C.quoted("p/event_id").alias("event_id"), F.round(C.quoted("c/value"), 6).alias("r_value"))


@query(
    _SIDES
    + f"""SELECT n.user_id, n.event_id, CASE WHEN abs(epoch_us(CASE WHEN later THEN f_ts ELSE b_ts END) - epoch_us(n.ts)) <= 86400000000 THEN CASE WHEN later THEN f_id ELSE b_id END END AS c_id,
round({_INTERP}, 6) AS c_value, sb.s_id AS v_id, sb.s_value AS v_value
FROM n JOIN (SELECT l.event_id, s_id, s_value FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.ts >= s.s_ts) sb ON n.event_id = sb.event_id
WHERE sb.s_id IS NOT NULL"""
)
def align_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three leaves in one pass: as-of with tolerance, interpolation and as-of, then rows with a match."""
    click = _events(spark, sf_dir, "click")
    out = align(
        {"p": _events(spark, sf_dir, "purchase").drop("value"), "s": {"c": click, "v": _events(spark, sf_dir, "view")}},
        {"p": Field("ts"), "s": {"c": Field("ts", {"event_id": AsOf("nearest", "1d"), "value": Interp()}), "v": Field("ts", {"event_id": AsOf(), "value": AsOf()})}},
        by=("user_id",), order="event_id",
    )
    out = out.where(C.quoted("s/v/event_id").isNotNull())
    return out.select(
        "user_id", C.quoted("p/event_id").alias("event_id"), C.quoted("s/c/event_id").alias("c_id"), F.round(C.quoted("s/c/value"), 6).alias("c_value"),
        C.quoted("s/v/event_id").alias("v_id"), C.quoted("s/v/value").alias("v_value"),
    )


# --- index, concat, structure ------------------------------------------------------------------------------


@query("SELECT CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, event_id FROM events")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row_index(table(spark, sf_dir, "events"), "idx", ["ts", "event_id"], ["user_id"]).select("idx", "event_id")


@query("SELECT CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + 99 AS INTEGER) AS idx, event_type, event_id FROM events WHERE event_type IN ('click', 'view')".replace("PARTITION BY user_id", "PARTITION BY event_type, user_id"))
def row_index_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a tree of tables."""
    tree = partition_split(table(spark, sf_dir, "events"), "event_type", ["click", "view"])
    tree = with_row_index(tree, "idx", ["ts", "event_id"], ["user_id"], 100, "int")
    return concat([t.select("idx", F.lit(k).alias("event_type"), "event_id") for k, t in tree.items()])


@query("SELECT doc_id, n_chars, lang AS k FROM documents WHERE lang IN ('en', 'de')")
def concat_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return concat([docs.where(F.col("lang") == k).select("doc_id", "n_chars") for k in ("en", "de")], ["en", "de"], "k")


@query("SELECT doc_id AS id, lang, NULL::INTEGER AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality::INTEGER FROM labels")
def concat_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return concat([a, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"))], how="diagonal")


@query("WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS n FROM nation), b AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS n FROM region) SELECT n_name, r_name FROM a FULL JOIN b USING (n)")
def concat_horizontal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("o"), "n_name")
    b = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("o"), "r_name")
    return concat([a, b], how="horizontal", order="o").drop("o")


@query("SELECT doc_id, n_chars, quality::INTEGER AS quality FROM documents FULL JOIN labels USING (doc_id)")
def concat_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat([table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))], how="align")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnest(table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p")), "p")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS p_k, value AS p_v FROM events")
def struct_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "events").select("event_id", F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("value").alias("v")).alias("p"))
    return unnest(nested, "p", "_")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def partition_split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = partition_split(table(spark, sf_dir, "events"), "event_type")
    totals = {k: t.agg(F.lit(k).alias("event_type"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")) for k, t in parts.items()}
    return concat(list(totals.values()))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE value > 50 AND event_type IN ('click', 'view') GROUP BY event_type")
def tree_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query over each table of a tree."""
    tree = partition_split(table(spark, sf_dir, "events"), "event_type", ["click", "view"])
    found = tree_map(lambda t, least: sql(spark, "SELECT count(*) AS n FROM self WHERE value > $least", self=t, least=least), tree, 50)
    return concat([t.select(F.lit(k).alias("event_type"), "n") for k, t in found.items()])


@query("SELECT d.doc_id, d.lang, l.quality::INTEGER AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def all_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return sql(spark, "SELECT * FROM self WHERE COLUMNS(*) IS NOT NULL", self=joined)


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)/(.+)$', 1) AS host_name, regexp_extract(url, '^https?://([^/]+)/(.+)$', 2) AS rest FROM pages WHERE regexp_matches(url, '^https?://([^/]+)/(.+)$')")
def path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_path(table(spark, sf_dir, "pages"), r"^https?://(?P<host_name>[^/]+)/(?P<rest>.+)$", {"host_name": None, "rest": "string"}, "url", ("page_id",))


# --- dynamic grouping --------------------------------------------------------------------------------------

_DAY = 86_400_000_000


def _dyn(every: str, period: str | None = None, closed: str = "left", start_by: str = "datapoint"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
        out = group_dynamic(events, "ts", every, period, ["user_id"], closed, start_by=start_by, order="event_id")
        return out.select("user_id", F.get("event_id", 0).alias("first_id"), F.size("ts").cast("long").alias("n"), F.posexplode("event_id").alias("pos", "event_id"))

    return run


def _dyn_sql(every: int, period: int, closed: str, start: str = "min(epoch_us(ts)) OVER (PARTITION BY user_id)", clip: bool = True) -> str:
    low, high = {"left": (">=", "<"), "right": (">", "<="), "both": (">=", "<="), "none": (">", "<")}[closed]
    first = f"floor((k - t0 - {period}) / {every}.0) - 1"
    return f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS k, {start} AS t0 FROM events),
w AS (SELECT *, unnest(generate_series(CAST({'greatest(0, ' + first + ')' if clip else first} AS BIGINT), CAST(floor((k - t0) / {every}.0) AS BIGINT) + 1)) AS i FROM e),
m AS (SELECT user_id, event_id, k, i FROM w WHERE k {low} t0 + i * {every} AND k {high} t0 + i * {every} + {period})
SELECT user_id, first_value(event_id) OVER g AS first_id, CAST(count(*) OVER (PARTITION BY user_id, i) AS BIGINT) AS n, CAST(row_number() OVER g - 1 AS INTEGER) AS pos, event_id
FROM m WINDOW g AS (PARTITION BY user_id, i ORDER BY k, event_id)"""


for _name, _args, _sql in (
    ("dyn_tumbling", ("1d",), _dyn_sql(_DAY, _DAY, "left")),
    ("dyn_sliding", ("1d", "3d"), _dyn_sql(_DAY, 3 * _DAY, "left")),
    ("dyn_gapped", ("3d", "1d"), _dyn_sql(3 * _DAY, _DAY, "left")),
    ("dyn_closed_right", ("1d", "2d", "right"), _dyn_sql(_DAY, 2 * _DAY, "right")),
    ("dyn_closed_both", ("1d", "2d", "both"), _dyn_sql(_DAY, 2 * _DAY, "both")),
    ("dyn_closed_none", ("1d", "2d", "none"), _dyn_sql(_DAY, 2 * _DAY, "none")),
    ("dyn_start_window", ("6h", None, "left", "window"), _dyn_sql(_DAY // 4, _DAY // 4, "left", "0", False)),
):
    QUERIES[_name] = _dyn(*_args)
    ORACLE_SQL[_name] = _sql

_TURNS = "SELECT conv_id, turn, floor((turn - min(turn) OVER (PARTITION BY conv_id)) / {n}) AS w, row_number() OVER (PARTITION BY conv_id, floor((turn - t0) / {n}) ORDER BY turn, text, role) - 1 AS pos FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM conversations)"


@query(f"SELECT conv_id, CAST(pos // 2 AS INTEGER) AS pos, turn FROM ({_TURNS.format(n=4)}) WHERE pos % 2 = 0")
def dyn_gather_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = group_dynamic(talks, "turn", "4i", group_by=["conv_id"], gather_every={"turn": 2})
    return out.select("conv_id", F.posexplode("turn").alias("pos", "turn"))


@query(f"SELECT conv_id, CAST(turn - pos AS BIGINT) AS first_turn, CAST(pos AS INTEGER) AS pos, turn FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, w) AS n FROM ({_TURNS.format(n=2)})) WHERE n = 2 AND turn - pos >= 0")
def clip_fixed_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of two turns: ragged ones are dropped before the cast to a fixed size."""
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    clips = group_dynamic(talks, "turn", "2i", group_by=["conv_id"]).where(F.size("turn") == 2)
    fixed = clips.select("conv_id", C.fixed_array(F.col("turn"), "bigint", 2).alias("turn")).where(F.get("turn", 0) >= 0)
    return fixed.select("conv_id", F.posexplode("turn").alias("pos", "turn")).select("conv_id", (F.col("turn") - F.col("pos")).alias("first_turn"), "pos", "turn")


@query(
    "WITH a AS (" + ORACLE_SQL["align_multi"] + """), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM a WHERE c_value IS NOT NULL),
c AS (SELECT *, idx // 3 AS clip, count(*) OVER (PARTITION BY user_id, idx // 3) AS n FROM i)
SELECT user_id, CAST(clip AS BIGINT) AS clip, CAST(idx % 3 AS INTEGER) AS pos, event_id, c_value FROM c WHERE n = 3"""
)
def drive_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole recording pipeline in one plan: scan, align, filter, number, clips of three rows of fixed length."""
    rows = sql(spark, "SELECT * FROM self WHERE c_value IS NOT NULL", self=align_multi(spark, sf_dir))
    rows = with_row_index(rows, "idx", "event_id", ["user_id"])
    clips = group_dynamic(rows, "idx", "3i", group_by=["user_id"]).where(F.size("idx") == 3)
    fixed = clips.select(
        "user_id", F.expr("idx[0] div 3").alias("clip"), C.fixed_array(F.col("event_id"), "bigint", 3).alias("e"), C.fixed_array(F.col("c_value"), "double", 3).alias("v")
    )
    rows = fixed.select("user_id", "clip", F.posexplode(F.arrays_zip("e", "v")).alias("pos", "z"))
    return rows.select("user_id", "clip", "pos", F.col("z.e").alias("event_id"), F.col("z.v").alias("c_value"))


# --- waypoints and geometry --------------------------------------------------------------------------------

_POINTS = "SELECT user_id, event_id, value AS x, value / 2 + 10 AS y, row_number() OVER g AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW g AS (PARTITION BY user_id ORDER BY ts, event_id)"
_WAY = f"WITH p AS ({_POINTS}), w AS (SELECT a.user_id, a.event_id, a.x AS ax, a.y AS ay, CAST(j AS INTEGER) AS pos, b.x, b.y FROM p a, generate_series(0, 3) t(j), p b WHERE b.user_id = a.user_id AND b.rn = least(a.rn + j, a.n)) "


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = with_row_index(table(spark, sf_dir, "events"), "seq", ["ts", "event_id"], ["user_id"])
    return events.select("user_id", "event_id", "seq", geo.point(F.col("value"), F.col("value") / 2 + 10).alias("geom"))


@query(_WAY + "SELECT user_id, event_id, pos, x, y FROM w")
def waypoints_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = with_waypoints(_points(spark, sf_dir), "geom", "waypoints", 4, "seq", ["user_id"])
    return way.select("user_id", "event_id", F.posexplode("waypoints").alias("pos", "p")).select("user_id", "event_id", "pos", "p.x", "p.y")


@query(
    _WAY
    + """, r AS (SELECT user_id, event_id, pos, (x - ax) * cos(radians(ax)) - (y - ay) * sin(radians(ax)) AS x, (x - ax) * sin(radians(ax)) + (y - ay) * cos(radians(ax)) AS y FROM w),
k AS (SELECT event_id FROM r GROUP BY event_id HAVING bool_and(abs(x) <= 150 AND abs(y) <= 150) AND bool_or(abs(x) < 150 AND abs(y) < 150))
SELECT user_id, event_id, pos, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM r JOIN k USING (event_id)"""
)
def waypoints_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waypoints moved to the row's own point, turned by its heading, and kept where a box holds them."""
    way = with_waypoints(_points(spark, sf_dir), "geom", "waypoints", 4, "seq", ["user_id"])
    moved = geo.rotate(geo.translate(F.col("waypoints"), -F.col("geom.x"), -F.col("geom.y")), F.radians("geom.x"))
    kept = way.select("user_id", "event_id", moved.alias("w")).where(geo.contains(-150, -150, 150, 150, F.col("w")))
    rows = kept.select("user_id", "event_id", F.posexplode(geo.coordinates(F.col("w"))).alias("pos", "p"))
    return rows.select("user_id", "event_id", "pos", *((F.round(F.get("p", i), 6) + 0.0).alias(c) for i, c in enumerate("xy")))


_N = 1 / 298.257222101 / (2 - 1 / 298.257222101)
_E = 2 * _N**0.5 / (1 + _N)
_A = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_EAST = " + ".join(["eta", *(f"{a:.17e} * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j, a in enumerate(_ALPHA, 1))])
_NORTH = " + ".join(["xi", *(f"{a:.17e} * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j, a in enumerate(_ALPHA, 1))])


@query(
    f"""WITH g AS (SELECT event_id, radians(value % 12 - 9) AS lon, radians(value / 4 + 30) AS lat FROM events),
q AS (SELECT event_id, lon, 0.5 * ln((1 + sin(lat)) / (1 - sin(lat))) - {_E:.17e} * 0.5 * ln((1 + {_E:.17e} * sin(lat)) / (1 - {_E:.17e} * sin(lat))) AS psi FROM g),
t AS (SELECT event_id, lon, (exp(psi) - exp(-psi)) / 2 AS t FROM q),
u AS (SELECT event_id, atan2(t, cos(lon)) AS xi, 0.5 * ln((1 + sin(lon) / sqrt(1 + t * t)) / (1 - sin(lon) / sqrt(1 + t * t))) AS eta FROM t)
SELECT event_id, round(500000 + 9996e-4 * {_A:.17e} * ({_EAST}), 3) AS east, round(9996e-4 * {_A:.17e} * ({_NORTH}), 3) AS north FROM u"""
)
def utm_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geo.utm(geo.point(F.col("value") % 12, F.col("value") / 4 + 30))
    return table(spark, sf_dir, "events").select("event_id", p.alias("p")).select("event_id", F.round("p.x", 3).alias("east"), F.round("p.y", 3).alias("north"))


# --- samples, batches and media ----------------------------------------------------------------------------


def _samples(spark: SparkSession, sf_dir: str) -> SampleSet:
    leaf = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("input_id"), "event_id", "value", (F.col("event_id") % 97).alias("frame"))
    return SampleSet.build(leaf, ["event_id"])


@query("SELECT CAST(n AS BIGINT) AS sample_idx, CAST(n // 64 AS BIGINT) AS batch_id, CAST(n % 64 AS INTEGER) AS batch_pos, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events)")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_batch_ids(_samples(spark, sf_dir).samples, 64).select("sample_idx", "batch_id", "batch_pos", "event_id")


@query("SELECT CAST(n // 64 AS BIGINT) AS batch_id, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n, count(*) OVER () AS c FROM events) WHERE (n // 64 + 1) * 64 <= c")
def drop_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_batch_ids(_samples(spark, sf_dir).samples, 64, drop_last=True).select("batch_id", "event_id")


@query("WITH s AS (SELECT event_id, value, 'u' || user_id AS input_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events), q AS (SELECT * FROM (VALUES (0, 5), (1, 3), (2, 5), (3, 9)) t(pos, i)) SELECT CAST(pos AS BIGINT) AS pos, CAST(n AS BIGINT) AS sample_idx, input_id, event_id, value FROM q JOIN s ON s.n = q.i")
def get_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).get_batch([5, 3, 5, 9]).drop("frame")


@query("WITH t AS (SELECT CAST(vec_id % 5 AS BIGINT) AS g, vec_id, label FROM embeddings), s AS (SELECT conv_id, turn, CAST(conv_id % 5 AS BIGINT) AS g, conv_id * 5 + turn AS i, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n FROM conversations) SELECT CAST(n AS BIGINT) AS sample_idx, CAST(t.label AS INTEGER) AS label FROM s LEFT JOIN t ON t.g = s.g AND t.vec_id = s.i")
def stream_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).cast("string").alias("input_id"), F.col("vec_id").alias("seq"), F.col("label").cast("int").alias("data"))
    leaf = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).cast("string").alias("input_id"), "conv_id", "turn", (F.col("conv_id") * 5 + F.col("turn")).alias("i"))
    full = SampleSet.build(leaf, ["conv_id", "turn"], {"label": Stream("i", data=media)})
    return full.get_batch(slice(0, None)).select("sample_idx", "label")


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(embedding), 3) AS total FROM embeddings".replace("list_sum(embedding)", "list_sum(list_transform(embedding, lambda x: x::DOUBLE))"))
def fixed_array_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = table(spark, sf_dir, "embeddings").select("vec_id", C.fixed_array(F.col("embedding"), "float", 64).alias("e"))
    return fixed.select("vec_id", F.size("e").alias("n"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("SELECT event_id, CAST(list_position(['click', 'view', 'purchase'], event_type) - 1 AS INTEGER) AS event_type, epoch_us(ts) AS ts FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def to_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "view", "purchase"]
    return C.physical(table(spark, sf_dir, "events").where(F.col("event_type").isin(kinds)).select("event_id", "event_type", "ts"), {"event_type": kinds})


# --- files: tables written in a format and scanned back ----------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


_NUMBERED = "SELECT CAST(user_id % 4 AS BIGINT) AS file, event_type AS topic, event_id, epoch_us(ts) * 1000 AS log_time, row_number() OVER (PARTITION BY user_id % 4, event_type ORDER BY ts, event_id) - 1 AS seq FROM events"


def _mcap(spark: SparkSession, sf_dir: str) -> str:
    """Four files of all events, a topic for each type."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("file"), "event_type", (key_number(F.col("ts"), T.TimestampNTZType()) * 1000).alias("t"), F.to_json(F.struct("event_id", F.col("value").alias("v"))).alias("m"), "event_id")
    folder = _folder(spark)
    write_mcap(events, folder, "file", "event_type", "t", "m", ["t", "event_id"]).collect()  # a path for each file
    return folder


def _file(column: str = "input_id"):
    return F.regexp_extract(column, r"(\d+)\.\w+$", 1).cast("long").alias("file")


@query(f"SELECT file, topic, seq, event_id, log_time FROM ({_NUMBERED}) WHERE topic IN ('click', 'purchase')")
def mcap_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = mcap.scan_messages(spark, _mcap(spark, sf_dir), ["click", "purchase"])
    tables = mcap.decode_topics(scanned, {t: {"event_id": "bigint", "log_time": None} for t in ("click", "purchase")})
    return concat([t.select(_file(), F.lit(k).alias("topic"), "seq", "event_id", "log_time") for k, t in tables.items()])


@query(f"SELECT file, topic, seq, log_time FROM ({_NUMBERED}) WHERE seq % 9 = 4 OR topic = 'view' AND seq < 2")
def mcap_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _mcap(spark, sf_dir)
    wanted = mcap.message_index(spark, folder).where("seq % 9 = 4 OR topic = 'view' AND seq < 2").select("input_id", "topic", "seq")
    return mcap.fetch_messages(spark, folder, wanted.unionAll(wanted)).select(_file(), "topic", "seq", "log_time")


@query(f"SELECT file, topic, CAST(count(*) AS BIGINT) AS messages FROM ({_NUMBERED}) GROUP BY file, topic")
def mcap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcap.message_counts(spark, _mcap(spark, sf_dir)).select(_file(), "topic", "messages")


@query("""SELECT file, seq, message_type, payload FROM (SELECT CAST(user_id % 3 AS BIGINT) AS file, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS seq,
CASE event_type WHEN 'click' THEN 'Gnss' WHEN 'view' THEN 'ImageMetadata' WHEN 'purchase' THEN 'VehicleMotion' END AS message_type, CAST(event_id AS VARCHAR) AS payload FROM events) WHERE message_type IN ('Gnss', 'VehicleMotion')""")
def framed_log_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in ("click", 0, "view", 4, "purchase", 7))), F.col("event_type")), F.lit(99))
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("file"), "event_id", kind.alias("kind"), F.col("event_id").cast("string").cast("binary").alias("payload"))
    folder = _folder(spark)
    write_framed_log(events, folder, "file", "kind", "payload", ["event_id"]).collect()  # a path for each file
    frames = framed_log.scan_frames(spark, folder, ["Gnss", "VehicleMotion"])
    return frames.select(_file(), "seq", "message_type", F.col("payload").cast("string").alias("payload"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) AS total FROM embeddings")
def path_media_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is a numpy file in its label's folder, found by a path template."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("input_id"), "embedding")
    folder = _folder(spark)
    named = vectors.withColumn("name", F.concat_ws("/", "input_id", F.format_string("%06d", "vec_id")))
    write_files(named, folder, "name", ["embedding"], ["vec_id"], lambda rows: npy_bytes(rows[0][0]), ".npy").write.format("noop").mode("overwrite").save()
    samples = vectors.select(F.col("vec_id").alias("sample_idx"), "input_id", "vec_id")
    found = media.path_media(samples, folder, "{:06d}.npy", "vec_id", media.npy_decoder())
    got = media.lookup(samples, found, "vec_id", "data")
    return got.select("vec_id", F.get("data.shape", 0).alias("n"), F.round(F.aggregate("data.values", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


# --- more of grouping, concatenation and functions ---------------------------------------------------------


@query("""WITH e AS (SELECT user_id, event_id, date_trunc('month', ts) AS m, ts FROM events)
SELECT user_id, first_value(event_id) OVER g AS first_id, CAST(count(*) OVER (PARTITION BY user_id, m) AS BIGINT) AS n, CAST(row_number() OVER g - 1 AS INTEGER) AS pos, event_id FROM e WINDOW g AS (PARTITION BY user_id, m ORDER BY ts, event_id)""")
def dyn_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dyn("1mo", start_by="window")(spark, sf_dir)


@query(f"SELECT conv_id, first_turn, CAST(pos // 3 AS INTEGER) AS pos, turn FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id, w) AS first_turn FROM ({_TURNS.format(n=6)})) WHERE pos % 3 = 0")
def dyn_gather_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping thins its columns, which come last; the others stay whole."""
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("all"), "role", "text")
    out = group_dynamic(talks, "turn", "6i", group_by=["conv_id"], gather_every={"turn": 3}, include_boundaries=True)
    assert out.columns == ["conv_id", "all", "role", "text", "turn"]
    return out.select("conv_id", F.get("all", 0).alias("first_turn"), F.posexplode("turn").alias("pos", "turn"))


@query("SELECT CAST(doc_id AS BIGINT) AS k, CAST(n_chars AS DOUBLE) AS v FROM documents UNION ALL SELECT CAST(label AS BIGINT), CAST(vec_id AS DOUBLE) / 2 FROM embeddings")
def concat_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("n_chars").alias("v"))
    b = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("k"), (F.col("vec_id") / 2).alias("v"))
    return concat([a, b], how="vertical_relaxed")


@query("SELECT doc_id, n_chars, CAST(quality AS INTEGER) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def concat_align_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return concat([table(spark, sf_dir, "documents").select("doc_id", "n_chars"), labels], how="align_left")


@query("SELECT event_id, make_timestamp(epoch_us(ts)) AS at, epoch_us(ts) * 1000 + 123 AS ns FROM events")
def nanos_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with nine places to nanoseconds, and nanoseconds to a time of microseconds."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("123Z"))
    named = table(spark, sf_dir, "events").select("event_id", C.nanos_from_text(text).alias("ns"))
    exact = F.timestamp_micros(F.floor(F.col("ns") / 1000).cast("long")).cast("timestamp_ntz")
    near = C.datetime_from_nanos(F.col("ns")).cast("timestamp_ntz")
    return named.select("event_id", F.when(F.abs(F.timestamp_diff("MICROSECOND", near, exact)) <= 1, exact).alias("at"), "ns")


@query("SELECT event_id, value AS x, value * 2 - 1 AS y, CAST(CASE WHEN value BETWEEN 10 AND 60 AND value * 2 - 1 BETWEEN 10 AND 60 AND value > 10 AND value < 60 AND value * 2 - 1 > 10 AND value * 2 - 1 < 60 THEN 1 ELSE 0 END AS INTEGER) AS inside FROM events")
def wkb_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to well-known binary and back, and a box that must hold one."""
    p = geo.point_from_wkb(geo.point_to_wkb(geo.point(F.col("value"), F.col("value") * 2 - 1)))
    points = table(spark, sf_dir, "events").select("event_id", p.alias("p"))
    inside = geo.contains(10.0, 10.0, 60.0, 60.0, F.array("p"))
    return points.select("event_id", "p.x", "p.y", inside.cast("int").alias("inside"))


@query("SELECT 'u' || user_id AS recording, 'value' AS entity, event_id AS key, CAST(0 AS INTEGER) AS pos, CAST(ts AS VARCHAR) AS at, value AS v FROM events")
def viewer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("input_id"), "event_id", "ts", "value")
    out = ViewerSink({"ts": "time", "value": Component("Scalars")}, key="event_id").rows(rows)
    return out.select("recording", "entity", "key", "pos", out.times["ts"].alias("at"), F.get("data", 0).alias("v"))


# --- SQL pass-through: one text for both engines ------------------------------------------------------------

PASS_THROUGH = {
    "sql_inner_join": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000",
    "sql_left_join": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    "sql_full_join": "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey",
    "semi_frames": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "anti_frames": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "sql_range_join": "SELECT n_name, r_name FROM nation JOIN region ON n_nationkey BETWEEN r_regionkey * 5 AND r_regionkey * 5 + 2",
    "sql_cross_join": "SELECT r1.r_name AS a, r2.r_name AS b FROM region r1 CROSS JOIN region r2",
    "sql_group": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(CAST(l_quantity AS DOUBLE)), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_cube": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_grouping_sets": "SELECT lang, source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",
    "sql_distinct": "SELECT DISTINCT lang, source FROM documents",
    "sql_window": "SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events",
    "sql_union": "SELECT lang AS x FROM documents UNION SELECT role AS x FROM conversations",
    "sql_intersect": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels",
    "sql_except": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "sql_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "sql_cte": "WITH big AS (SELECT o_custkey, sum(CAST(o_totalprice AS DOUBLE)) AS t FROM orders GROUP BY o_custkey) SELECT c_custkey, round(t, 2) AS t FROM big JOIN customer ON c_custkey = o_custkey WHERE t > 500000",
    "sql_scalar_subquery": "SELECT doc_id FROM documents WHERE n_chars > (SELECT avg(n_chars) FROM documents)",
    "sql_case_strings": "SELECT doc_id, upper(lang) AS u, CASE WHEN n_chars BETWEEN 100 AND 1000 THEN 'short' WHEN n_chars < 100 THEN 'tiny' ELSE 'long' END AS size, substring(source, 4) AS s FROM documents",
}
for _name, _text in PASS_THROUGH.items():

    def _run(spark: SparkSession, sf_dir: str, text: str = _text) -> DataFrame:
        import re

        names = [n for n in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "conversations", "labels") if re.search(rf"(?:FROM|JOIN) {n}\b", text)]
        return sql(spark, text, **{n: table(spark, sf_dir, n) for n in names})

    QUERIES[_name] = _run
    ORACLE_SQL[_name] = _text


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND turn >= 1")
def sql_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named parameters, double-quoted names and EXCLUDE."""
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return sql(spark, 'SELECT * EXCLUDE (role) FROM self WHERE "role" = $role AND turn >= $least', self=talks, role="user", least=1)


@query("SELECT page_id, i AS pos, part FROM (SELECT page_id, unnest(string_split(url, '/')) AS part, CAST(generate_subscripts(string_split(url, '/'), 1) - 1 AS INTEGER) AS i FROM pages)")
def sql_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, "SELECT page_id, pos, part FROM pages LATERAL VIEW posexplode(split(url, '/')) t AS pos, part", pages=table(spark, sf_dir, "pages"))
