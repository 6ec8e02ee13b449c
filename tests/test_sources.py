from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from pagemill import session
from pagemill.sources import records
from pagemill.sources.stages import StageStore
from pagemill.plans.synthesis import Synthesis


def write(folder, name, value):
    path = folder / name
    path.write_text(json.dumps(value, indent=4), encoding="utf-8")
    return str(path)


def page(*names):
    return [{"webpage": n} for n in names]


def test_array_and_object_roots_are_appended_in_order(spark, tmp_path):
    paths = [
        write(tmp_path, "b.json", page("b0", "b1 漢\n\né", "b2")),
        write(tmp_path, "c.json", {"webpage": "single"}),
        write(tmp_path, "a.json", page("a0")),
    ]
    merged = records.read_json_in_order(spark, paths, records.PAGES).orderBy("source_ord", "seq")
    assert [r.webpage for r in merged.collect()] == ["b0", "b1 漢\n\né", "b2", "single", "a0"]


@pytest.mark.parametrize("root", ["text", 3, ["a", "b"]])
def test_other_roots_fail(spark, tmp_path, root):
    with pytest.raises(Exception):
        records.read_json(spark, write(tmp_path, "x.json", root), records.PAGES).collect()


def test_no_paths(spark):
    with pytest.raises(ValueError):
        records.read_json_in_order(spark, [], records.PAGES)
    with pytest.raises(ValueError):
        records.union_pools([])


def test_missing_field_reads_as_null(spark, tmp_path):
    path = write(tmp_path, "x.json", [{"webpage": "p"}, {"other": 1}])
    assert [r.webpage for r in records.read_json(spark, path, records.PAGES).collect()] == ["p", None]


def test_array_files_are_valid_json_of_bounded_length(spark, tmp_path):
    df = spark.range(95).select(F.col("id").alias("seq"), F.concat(F.lit("p"), "id").alias("webpage"))
    records.write_json_arrays(df.repartition(5), str(tmp_path / "out"), rows_per_file=20)
    files = [json.loads(f.read_text()) for f in (tmp_path / "out").rglob("part-*")]
    assert sorted(len(f) for f in files if f) == [15, 20, 20, 20, 20]
    assert all([r["seq"] for r in f] == sorted(r["seq"] for r in f) for f in files)
    assert sorted(r["webpage"] for f in files for r in f) == sorted(f"p{i}" for i in range(95))


def test_array_files_are_bounded_in_bytes(spark, tmp_path):
    """Records of 3 MB: a file ends with the one that reaches the limit."""
    df = spark.range(-3, 9).select(F.col("id").alias("seq"), F.repeat(F.lit('x"{}\\'), 600_000).alias("webpage"))
    records.write_json_arrays(df, str(tmp_path / "out"), rows_per_file=5, bytes_per_file=4_000_000)
    files = [json.loads(f.read_text()) for f in (tmp_path / "out").rglob("part-*")]
    # Blocks of five keys are [-5, 0), [0, 5) and [5, 10).
    assert sorted(tuple(r["seq"] for r in f) for f in files) == [(-3,), (-2,), (-1,), (0,), (1,), (2,), (3,), (4,), (5,), (6,), (7,), (8,)]
    back = records.read_json(spark, str(tmp_path / "out"), df.schema)
    assert back.columns == df.columns and back.exceptAll(df).count() == 0 and back.count() == 12


@pytest.fixture
def split_bytes(spark):
    """Sets the size of a split."""
    conf = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(c) for c in conf]

    def put(size):
        for c in conf:
            spark.conf.set(c, str(size))

    yield put
    for c, value in zip(conf, before):
        spark.conf.set(c, value)


TRICKY = ["}", "{", "[", "]", '"', "\\", '\\"', "\\\\", "},{", '"}', '{"a": 1}', "\n", "é漢", ""]


@pytest.mark.parametrize(("indent", "size"), [(None, 61), (4, 83), (None, 400), (4, 1 << 20)])
def test_one_array_file_is_read_in_many_tasks(spark, tmp_path, split_bytes, indent, size):
    draw = random.Random(size)
    rows = [
        {"n": n, "webpage": "".join(draw.choices(TRICKY, k=draw.randrange(6))), "more": {"x": draw.choices(TRICKY, k=2)}}
        for n in range(40)
    ]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=size != 61), encoding="utf-8")
    split_bytes(size)
    schema = "n int, webpage string, more struct<x: array<string>>"
    read = records.read_json_array(spark, str(path), schema, "position")
    got = sorted(read.collect(), key=lambda r: r["position"])
    assert [(r["n"], r["webpage"], r["more"]["x"]) for r in got] == [(r["n"], r["webpage"], r["more"]["x"]) for r in rows]
    if size < 100:
        assert read.select("position").where("position >= 4294967296").count() > 20  # elements of later splits


def test_split_reading_of_folders_objects_and_other_roots(spark, tmp_path, split_bytes):
    split_bytes(60)
    write(tmp_path, "a.json", page("a0", "a1}", "a2"))
    write(tmp_path, "b.json", {"webpage": "single", "deep": {"x": {}}})
    write(tmp_path, "c.json", [])
    write(tmp_path, "d.json", [{}])
    (tmp_path / "e.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(page("e0")).encode())
    (tmp_path / "f.json").write_text("")
    got = records.read_json_array(spark, str(tmp_path), "webpage string", "p").orderBy("p")
    assert [r["webpage"] for r in got.collect()] == ["a0", "a1}", "a2", "single", None, "e0"]
    merged = records.read_json_in_order(spark, [str(tmp_path / "b.json"), str(tmp_path / "a.json")], records.PAGES, split=True)
    assert [r.webpage for r in merged.orderBy("source_ord", "seq").collect()] == ["single", "a0", "a1}", "a2"]
    for root in ("text", 3, ["a", "b"], [1, {"webpage": "x"}], [[{"webpage": "x"}]]):
        (tmp_path / "other").mkdir(exist_ok=True)
        with pytest.raises(Exception):
            records.read_json_array(spark, write(tmp_path / "other", "x.json", root), records.PAGES).collect()


def test_parquet_sink_counts_its_rows(spark, tmp_path):
    assert records.write_parquet(spark.range(37), str(tmp_path / "p")) == 37
    assert spark.read.parquet(str(tmp_path / "p")).count() == 37


def test_final_schema(spark, tmp_path):
    from pagemill.functions.messages import wr_messages

    df = spark.createDataFrame([("i", "q", "a")], "prompt_id string, q string, a string")
    records.write_parquet(df.select("prompt_id", wr_messages(F.col("q"), F.col("a")).alias("messages")), str(tmp_path / "p"))
    got = spark.read.parquet(str(tmp_path / "p"))
    want = "struct<prompt_id:string,messages:array<struct<content:string,role:string>>>"
    assert got.schema.simpleString() == want


def test_stage_store(spark, tmp_path):
    store = StageStore(spark, str(tmp_path), "web", "model")
    df = spark.createDataFrame([(1, "WI_all"), (2, "WR_all")], "seq bigint, category string")
    assert not store.finished("request")
    store.ensure("request", lambda: df)
    assert store.finished("request") and (tmp_path / "web_model/request/wave=0/category=WI_all").is_dir()
    store.ensure("request", lambda: pytest.fail("built twice"))
    assert sorted(r.seq for r in store.read("request").collect()) == [1, 2]
    store.write("empty", df.limit(0))
    assert store.read("empty").count() == 0 and "category" in store.read("empty").columns


def test_ingest_fixes_the_order(spark, tmp_path):
    paths = [write(tmp_path, "b.json", page("x", "y")), write(tmp_path, "a.json", page("z"))]
    job = Synthesis(StageStore(spark, str(tmp_path / "store"), "web", "stub"), backend=None)
    assert [r.webpage for r in job.ingest(paths).orderBy("seq").collect()] == ["x", "y", "z"]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_path(Session(), "x")


def test_scratch_is_below_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    path = session.scratch_path(spark, "x")
    assert path.startswith(folder) and path != session.scratch_path(spark, "x")


def test_scratch_is_deleted_on_request(spark):
    from pathlib import Path

    session.materialize(spark.range(3), "some").count()
    folder = Path(session.scratch_path(spark, "x").removeprefix("file:")).parent
    assert any(folder.iterdir())
    session.clear_scratch(spark)
    assert not folder.exists()


def test_broadcast_only_within_the_bound(spark):
    from pagemill.operators.numbering import bounded

    df = spark.range(3)
    assert "broadcast" in bounded(df, 3)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in bounded(df, session.MAX_BROADCAST_ROWS + 1)._jdf.queryExecution().logical().toString()


@pytest.mark.parametrize(("rows_per_file", "bytes_per_file", "files"), [(1 << 60, 1 << 60, 4), (50, 1 << 60, None), (1 << 60, 3000, None)])
def test_long_array_files_are_sorted_in_ranges(spark, tmp_path, monkeypatch, rows_per_file, bytes_per_file, files):
    """Files that reach over many ranges of keys are those that one sort of each would give."""
    from pagemill.sources import json_arrays

    monkeypatch.setattr(json_arrays, "RANGE_BYTES", 1000)
    keys = [*range(-60, 300, 2), 1 << 62, (1 << 62) + 1, -(1 << 62)]
    rows = [(k, "".join(random.Random(k).choices(TRICKY, k=abs(k) % 40))) for k in keys]
    df = spark.createDataFrame(rows, "seq long, webpage string").repartition(7)
    records.write_json_arrays(df, str(tmp_path / "out"), rows_per_file=rows_per_file, bytes_per_file=bytes_per_file)
    found = [f.read_text() for f in (tmp_path / "out").rglob("part-*")]
    found = sorted((f for f in found if f), key=lambda f: json.loads(f)[0]["seq"])
    got = [[r["seq"] for r in json.loads(f)] for f in found]
    wanted = []
    if bytes_per_file == 1 << 60:
        for k in sorted(keys):
            if wanted and wanted[-1][0] // rows_per_file == k // rows_per_file:
                wanted[-1].append(k)
            else:
                wanted.append([k])
        assert got == wanted
    assert [k for f in got for k in f] == sorted(keys)
    if files:
        assert len(got) == files
    if bytes_per_file == 1 << 60 and rows_per_file == 1 << 60:  # a sort for each range of about 1000 bytes
        assert len(found[2]) > 5000
        sized = df.select(F.col("seq").alias("_key"), F.octet_length(F.to_json(F.struct("*"))).cast("long").alias("_bytes"))
        ranges = json_arrays._in_ranges(sized)[0].groupBy("range").agg(F.sum("_bytes").alias("n")).collect()
        assert len(ranges) > 5 and max(r["n"] for r in ranges) < 2000
    assert all(f.startswith("[\n{") and f.endswith("}\n]\n") for f in found)
    back = records.read_json_array(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    if bytes_per_file == 3000:
        assert len(got) > 3 and max(len(f.encode()) for f in found) < 3000 + 400
