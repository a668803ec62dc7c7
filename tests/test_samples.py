from __future__ import annotations

import pickle

import pytest
from pyspark.sql import functions as F

from strandline.plans.config import Node, Pipeline
from strandline.operators.index import numbered
from strandline.plans.dataset import Loader, SampleSet, Shuffle, Stream, with_batch_ids
from strandline import visualize
from strandline.plans.sinks import Component, ViewerSink, flatten_for_viewer


@pytest.fixture
def samples(spark, tmp_path):
    leaf = spark.createDataFrame([("a" if i % 2 else "b", i, [i, i + 1]) for i in range(20)], "input_id string, t long, i array<long>")
    media = spark.createDataFrame([(k, i, f"{k}{i}") for k in "ab" for i in range(30)], "input_id string, seq long, data string")
    media.write.parquet(str(tmp_path / "media"))
    return SampleSet.build(leaf, ["t"], {"m": Stream("i", str(tmp_path / "media"))})


def test_batches_follow_the_index(samples):
    got = samples.get_batch([5, 3, 5])
    assert [(r.sample_idx, r.m) for r in got.collect()] == [(5, ["a5", "a6"]), (3, ["a3", "a4"]), (5, ["a5", "a6"])]
    assert [r.sample_idx for r in samples.get_batch(range(2, 9, 3)).collect()] == [2, 5, 8]
    assert [r.sample_idx for r in samples.get_batch(slice(17, None)).collect()] == [17, 18, 19]
    assert "m" not in samples.get_batch([1], include_streams=False).columns
    assert "input_id" not in samples.get_batch([1], include_meta=False).columns
    assert len(samples) == 20 and samples[4].first().t == 4


def test_checks(spark, samples):
    with pytest.raises(ValueError):
        SampleSet(samples.samples, {"x": Stream("none")})
    with pytest.raises(ValueError):
        SampleSet(samples.samples.drop("input_id"))
    with pytest.raises(ValueError):
        SampleSet(samples.samples).get_batch([0], include_streams=True)


def test_saved_sets_are_equal(spark, samples, tmp_path):
    samples.save(str(tmp_path / "s"))
    back = SampleSet.load(spark, str(tmp_path / "s"))
    assert back.equals(samples) and not back.equals(SampleSet(samples.samples))
    SampleSet(samples.samples).save(str(tmp_path / "t"))
    assert SampleSet.load(spark, str(tmp_path / "t")).streams is None


def test_loader(samples):
    numbers = lambda loader: [b["sample_idx"].to_pylist() for b in loader]
    plain = numbers(Loader(samples, 6))
    assert plain == [list(range(0, 6)), list(range(6, 12)), list(range(12, 18)), [18, 19]]
    assert next(iter(Loader(samples, 2)))["m"].to_pylist() == [["b0", "b1"], ["a1", "a2"]]
    loader = Loader(samples, 6, shuffle=True, seed=1, drop_last=True, prebatch=2)
    mixed = numbers(loader)
    assert len(mixed) == len(loader) == 3 and len({i for b in mixed for i in b}) == 18 and mixed != plain[:3]
    assert mixed == numbers(loader) != numbers(Loader(samples, 6, shuffle=True, seed=2, drop_last=True))
    loose = numbers(Loader(samples, 3, num_workers=3, prefetch_factor=1, in_order=False, prebatch=1, collate=lambda t: t.select(["sample_idx"])))
    assert sorted(loose) == [list(range(i, min(20, i + 3))) for i in range(0, 20, 3)]
    assert with_batch_ids(samples.samples, 6).where("batch_id = 3").count() == 2
    with pytest.raises(ValueError):
        Loader(samples, 0)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_shuffle_is_a_permutation(n):
    assert sorted(map(Shuffle(n, 5), range(n))) == list(range(n))


def test_sets_are_pickled(spark, samples, tmp_path):
    assert pickle.loads(pickle.dumps(samples)) == samples
    samples.save(str(tmp_path / "s"))
    raw = pickle.dumps(samples)
    assert len(raw) < 500 and pickle.loads(raw) == samples
    with pytest.raises(ValueError):
        pickle.dumps(SampleSet(samples.samples, {"m": Stream("i", data=spark.range(1))}))


@pytest.mark.parametrize("ranges", ["1", "7"])
def test_numbers_over_all_rows(spark, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.lit("x").alias("_range"))
        got = numbered(df.repartition(5), ["k"], "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r.n for r in got) == list(range(500)) and all(r.n == r.k and r["_range"] == "x" for r in got)


def test_pipeline(spark, tmp_path):
    add = lambda t, n: t.withColumn("v", F.col("id") + n)
    nodes = [Node(lambda a, b: a.unionByName(b), "leaf", {"a": "x", "b": "y"}), Node(add, "x", {"t": "source"}, {"n": 1}), Node(add, "y", {"t": "source"}, {"n": 2})]
    p = Pipeline(nodes)
    assert sorted(r.v for r in p.run(source=spark.range(2)).collect()) == [1, 2, 2, 3]
    for bad in ([Node(add, "x", {"t": "y"}), Node(add, "y", {"t": "x"}), Node(add, "z", {"t": "y"})], [Node(add, "x", {"t": "s"}), Node(add, "y", {"t": "s"})]):
        with pytest.raises(ValueError):
            Pipeline(bad).run(s=spark.range(1))
    text = "nodes:\n- {func: 'strandline.operators.index:with_row_index', output: out, inputs: {tables: t}, bound: {name: n, order: id, by: []}}"
    y = Pipeline.from_yaml(text)
    assert y.digest() == Pipeline.from_yaml(text).digest()
    for _ in range(2):
        assert sorted(r.n for r in y.cached(str(tmp_path), t=spark.range(3)).collect()) == [0, 1, 2]


def test_pipeline_declarations_and_folders(spark, tmp_path):
    node = {"func": "strandline.operators.index:with_row_index", "output": "out", "inputs": {"tables": "t"}, "bound": {"name": "n", "order": "id", "by": []}}
    for bad, error in (({"output": "x"}, ValueError), (node | {"extra": 1}, ValueError), (node | {"output": 3}, TypeError), (node | {"func": "nowhere"}, ValueError)):
        with pytest.raises(error):
            Pipeline([bad])
    p = Pipeline([node])
    with pytest.raises(ValueError):
        p.run(t=spark.range(2), other=1)
    with pytest.raises(ValueError):
        p.run(t=spark.range(2), return_results=False)
    assert p.run(t=spark.range(2), run_folder=str(tmp_path / "r")).count() == 2
    assert p.run(t=spark.range(3), run_folder=str(tmp_path / "r"), return_results=False) is None and spark.read.parquet(str(tmp_path / "r" / "out")).count() == 3
    assert p.cached(str(tmp_path / "c"), t=spark.range(2)).count() == 2 and p.cached(str(tmp_path / "c"), t=spark.range(4)).count() == 4


def test_viewer(spark):
    df = spark.createDataFrame([(0, "a", [1, 2], [5.0, 6.0])], "sample_idx long, input_id string, t array<long>, v array<double>")
    assert [tuple(r) for r in flatten_for_viewer(df, "t", ["input_id"]).collect()] == [(0, 0, 1, 5.0, "a"), (0, 1, 2, 6.0, "a")]


def test_viewer_sink(spark, tmp_path):
    rows = [(0, "a", [10, 20], [1.5, None], [[1, 2, 3], [4, 5, 6]], 7), (1, "a", [30, 40], [2.5, 3.5], [[7, 8, 9], [1, 1, 1]], 8), (2, "b", [5, 6], [0.5, 0.5], [[0, 0, 0], [9, 9, 9]], 9)]
    df = spark.createDataFrame(rows, "sample_idx long, input_id string, t array<long>, v array<double>, p array<array<int>>, s int")
    sink = ViewerSink({"t": "time", "v": Component("Scalars"), "p": [Component("Points3D"), Component("Points2D", indices=[2, 0])], "s": Component("Size", static=True)})
    sink.log(df, str(tmp_path / "v"))
    got = spark.read.parquet(str(tmp_path / "v"))
    of = lambda kind: sorted((r.recording, r.key, r.pos, r.times.get("t"), list(r["shape"]), list(r.data)) for r in got.where(F.col("kind") == kind).collect())
    assert of("Scalars") == [("a", 0, 0, "10", [], [1.5]), ("a", 1, 0, "30", [], [2.5]), ("a", 1, 1, "40", [], [3.5]), ("b", 2, 0, "5", [], [0.5]), ("b", 2, 1, "6", [], [0.5])]
    assert of("Points3D")[1] == ("a", 0, 1, "20", [3], [4.0, 5.0, 6.0]) and of("Points2D")[1][-2:] == ([2], [6.0, 4.0])
    assert of("Size") == [("a", 0, 0, None, [], [7.0]), ("b", 2, 0, None, [], [9.0])]
    with pytest.raises(ValueError):
        ViewerSink({"v": Component("Scalars")})
    with pytest.raises(ValueError):
        sink.rows(df.drop("v"))
    with pytest.raises(TypeError):
        ViewerSink({"t": "time", "v": 3})


def test_visualize_command(spark, samples, tmp_path, capfd):
    samples.save(str(tmp_path / "s"))
    visualize.main([str(tmp_path / "s"), "--rows", "3"])
    assert "sample_idx" in capfd.readouterr().out
    (tmp_path / "schema.yaml").write_text("t: time\ni:\n- {kind: Points2D}\n")
    visualize.main([str(tmp_path / "s"), "--to", str(tmp_path / "out"), "--schema", str(tmp_path / "schema.yaml")])
    assert spark.read.parquet(str(tmp_path / "out")).where("recording = 'a' AND entity = 'i'").count() == 10
