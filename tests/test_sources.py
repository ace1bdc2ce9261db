"""Files in: CSV records with line breaks, JSON arrays, per-key files that come again."""

import csv
import gzip
import io
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sigvane import runtime
from sigvane.operators import hiring, universe
from sigvane.sources import ledger, readers, sinks, versions
from sigvane.sources.records import quoted_records, read_quoted_csv


@pytest.fixture
def split_size(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def put(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.csv").write_bytes(text.encode())
    return str(folder)


def untidy_rows(n, seed):
    draw = random.Random(seed)
    pieces = ["a", "\n", '"', ",", "\n\n", "é", "word ", "\n,\"", "x" * 30]
    return [[str(i)] + ["".join(draw.choice(pieces) for _ in range(draw.randrange(1, 25))) + "." for _ in range(2)] for i in range(n)]


@pytest.mark.parametrize("size", ["64b", "700b", "1m"])
def test_records_are_the_same_at_any_split_size(spark, tmp_path, split_size, size):
    split_size(size)
    expected = []
    for name in ("one", "two"):
        table = untidy_rows(40, name)
        expected += table
        text = io.StringIO(newline="")
        csv.writer(text, lineterminator="\n").writerows([["id", "a", "b c"], *table])
        put(tmp_path / "in.csv", **{name: text.getvalue()})
    df = readers.read_table(spark, str(tmp_path / "in.csv"), multi_line=True)
    assert df.columns == ["id", "a", "b c"]
    assert sorted(map(list, df.collect())) == sorted(expected)
    if size == "64b":
        assert spark.read.text(str(tmp_path / "in.csv")).select("_metadata.file_block_start").distinct().count() > 20


def test_one_record_over_many_blocks(spark, tmp_path, split_size):
    split_size("64b")
    long = "\n".join(f"line {i}" for i in range(200))
    path = put(tmp_path / "in.csv", a=f'id,t\n1,"{long}"\n2,after\n')
    assert {tuple(r) for r in read_quoted_csv(spark, path).collect()} == {("1", long), ("2", "after")}


def test_untidy_files(spark, tmp_path):
    path = put(tmp_path / "a.csv", a='\ufeffid,t\r\n1,"x\r\ny"\r\n\r\n2,\r\n', b="\ufeffid,t\r\n")
    assert {tuple(r) for r in read_quoted_csv(spark, path).collect()} == {("1", "x\r\ny"), ("2", None)}
    typed = read_quoted_csv(spark, put(tmp_path / "t.csv", a="id,t\n007,b\n"), "id int, t string")
    assert rows(typed) == [{"id": 7, "t": "b"}]
    open_end = put(tmp_path / "o.csv", a='id\n1\n"2\n3')
    assert sorted(r["record"] for r in quoted_records(spark, open_end).collect()) == ['"2\n3', "1", "id"]
    with pytest.raises(ValueError, match="differ"):
        read_quoted_csv(spark, put(tmp_path / "d.csv", a="id,t\n", b="id,u\n"))
    with pytest.raises(ValueError, match="repeats"):
        read_quoted_csv(spark, put(tmp_path / "r.csv", a="id,id\n"))
    with pytest.raises(ValueError, match="no header"):
        read_quoted_csv(spark, put(tmp_path / "e.csv", a=""))


def test_json_arrays_come_back(spark, tmp_path):
    schema = "k int, t string, n struct<a:array<int>>"
    df = spark.createDataFrame([(i, f'a "{i}"\n' if i % 3 else None, ([i],)) for i in range(25)], schema)
    path = sinks.write_json_snapshot(df, str(tmp_path / "s"), ["k"], rows_per_file=4)
    assert spark.read.text(path, wholetext=True, recursiveFileLookup=True).count() > 3
    back = readers.read_json_snapshot(spark, path, schema)
    assert sorted(back.collect(), key=lambda r: r["k"]) == sorted(df.collect(), key=lambda r: r["k"])
    empty = sinks.write_json_snapshot(df.where("k < 0"), str(tmp_path / "e"), ["k"])
    assert readers.read_json_snapshot(spark, empty, schema).count() == 0


def test_files_follow_the_order(spark, tmp_path):
    values = [(v, i) for i, v in enumerate([5, 3, None, 9, 3, 1, None, 7] * 40)]
    df = spark.createDataFrame(values, "v int, i int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        path = str(tmp_path / "o.parquet")
        index = sinks.write_ordered(df, path, ["v", "i"]).orderBy("first_position").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_key = lambda v, i: (v is None, v or 0, i)
    ends = [by_key(*k) for r in index for k in (r["first_key"], r["last_key"])]
    assert len(index) > 1 and ends == sorted(ends) and sum(r["rows"] for r in index) == len(values)
    index = spark.createDataFrame([(r["file"], r["first_position"]) for r in index], "file string, first_position long")
    placed = sinks.read_ordered(spark, path, index).orderBy("position").collect()
    assert [(r["v"], r["i"]) for r in placed] == sorted(values, key=lambda x: by_key(*x))
    assert [r["position"] for r in placed] == list(range(1, len(values) + 1))
    empty = sinks.write_ordered(df.where("i < 0"), str(tmp_path / "e.parquet"), ["v"])
    assert empty.count() == 0


def test_result_lines(spark):
    df = spark.createDataFrame([("h", 1, "T", "u", "text"), ("h", 2, None, None, " "), ("h", 3, "U", "w", None)], "host string, n int, title string, url string, body string")
    line = hiring.result_line(F.col("title"), F.col("url"), F.col("body"))
    got = rows(hiring.request_batches(df, "host", "n", F.col("host"), line, size=2), "batch")
    assert [r["request"] for r in got] == ["h\n\nRESULTS:\n[0] T <u>\n    text\n[1]  <>", "h\n\nRESULTS:\n[0] U <w>"]


def test_dimensions_of_any_name(spark):
    pages = [
        (1, '{"aiScores": {"maturityIndex": "3", "adoption": {"score": "4", "label": "high", "evidence": [{"a": 1}, 2]}, "new one": {"score": 2.5, "confidence": "low"}}}'),
        (2, '{"aiScores": null}'), (3, "{}"), (4, '{"aiScores": {"impact": {"score": "n/a", "missingEvidence": ["x"]}, "odd": 7}}'), (5, '{"aiScores": [1]}'), (6, None),
    ]
    df = spark.createDataFrame(pages, "id int, json string").select("id", F.parse_json("json").alias("content"))
    got = [tuple(r) for r in universe.score_dimensions(df).orderBy("id", "dimension").collect()]
    assert got == [(1, "adoption", 4.0, "high", None, 2, 0, 0), (1, "new one", 2.5, None, "low", 0, 0, 0), (4, "impact", None, None, None, 0, 1, 0)]


def test_files_that_come_again(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "tables")
    folder.mkdir()

    def run(**texts):
        for name, text in texts.items():
            (folder / f"{name}.json").unlink(missing_ok=True) if text is None else (folder / f"{name}.json").write_text(text)
        log = {r["key"]: r["action"] for r in ledger.refresh(spark, str(folder), root, "v int").collect()}
        return log, {r["key"]: r["v"] for r in versions.read_current(spark, root, "rows").collect()}

    assert run(a='{"v": 1}', b='{\n"v": 2}', c="{oops") == ({"a": "added", "b": "added", "c": "unreadable"}, {"a": 1, "b": 2})
    assert run() == ({"a": "unchanged", "b": "unchanged", "c": "unchanged"}, {"a": 1, "b": 2})
    assert run(a='{"v": 5}', b=None, c='{"v": 3}', d="{}") == ({"a": "changed", "b": "deleted", "c": "changed", "d": "added"}, {"a": 5, "c": 3, "d": None})
    assert run(b='{"v": 2}')[0]["b"] == "added"
    (folder / "sub").mkdir()
    (folder / "sub" / "a.json").write_text("{}")
    with pytest.raises(ValueError, match="key a"):
        run()
    assert versions.read_current(spark, root, "rows").count() == 4


@pytest.mark.parametrize("suffix", ["parquet", "csv"])
def test_outputs_are_counted_while_they_are_written(spark, tmp_path, suffix):
    some = spark.range(1000).withColumn("g", F.col("id") % 7)
    tables = {"some": some, "few": some.groupBy("g").count(), "none": some.where("id < 0"), "nothing": spark.createDataFrame([], "a string")}
    metadata = sinks.write_outputs(tables, str(tmp_path), ["s"], ["o"], "note", suffix)
    row = metadata.first()
    assert {t["table"]: t["rows"] for t in row["tables"]} == {"some": 1000, "few": 7, "none": 0, "nothing": 0}
    assert (row["signals"], row["outcomes"], row["caveat"]) == (["s"], ["o"], "note")
    assert readers.read_table(spark, f"{tmp_path}/few.{suffix}").count() == 7


def test_a_run_opens_every_file_once(spark, tmp_path, monkeypatch):
    read, files = spark.sparkContext.accumulator(0), ledger._files

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    monkeypatch.setattr(ledger, "_files", lambda *a: files(*a).select("key", seen("text").alias("text")))
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):
        (folder / f"k{i}.json").write_text(f'{{"v": {i}}}')
    log = ledger.refresh(spark, str(folder), f"{tmp_path}/out", "v int").collect()
    assert {r["action"] for r in log} == {"added"} and len(log) == 5
    assert read.value == 5


def tasks_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    return sum(tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds)


def test_files_by_key_lie_as_spark_lays_them(spark, tmp_path):
    keys = ["a", "b", "b", "x/y", "50%", "k=v", "é ü", "{q}", 'say "hi"', "a\tb", "", None, "..a"]
    df = spark.createDataFrame([(k, f"{i}\nline {i}" if i else None) for i, k in enumerate(keys)], "k string, value string")
    plain, local = f"{tmp_path}/spark", f"{tmp_path}/own"
    sinks.write_by_key(df, plain, "k", len(keys))
    assert sinks.write_by_key(df, f"file:{local}", "k", len(keys)) == f"file:{local}"

    def lines(folder):
        files = [p for p in (tmp_path / folder).rglob("*.txt") if p.name[0] != "."]
        assert len(files) == len({p.parent for p in files}) == len({k or None for k in keys})
        return {p.parent.name: sorted(p.read_bytes().split(b"\n")) for p in files}

    assert lines("own") == lines("spark")
    assert not [p for p in (tmp_path / "own").rglob("*") if p.is_file() and not p.name.startswith("part-")]
    with pytest.raises(FileExistsError):
        sinks.write_by_key(df, f"file:{local}", "k", len(keys))
    none = sinks.write_by_key(df.where("false"), f"file:{tmp_path}/none", "k", 0)
    assert ledger.refresh(spark, none, f"{tmp_path}/out", "v int", r"/k=([^/]+)/", "*.txt").count() == 0


def test_texts_are_those_of_the_text_reader(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in {"a": b'{"v": 1}\r\n', "b": b"\xef\xbb\xbf{}", "c": b"\xff\xfe bad \x00", "d": b"", "e f": "é\n\n".encode()}.items():
        (folder / f"{name}.json").write_bytes(text)
        (folder / f"{name}.json.gz").write_bytes(gzip.compress(text) if text else b"")

    def texts(glob):
        return sorted(tuple(r) for r in ledger._files(spark, str(folder), r"([^/]+)\.json(?:\.gz)?$", glob).select("key", F.hex("text")).collect())

    read = spark.read.text(str(folder), wholetext=True, pathGlobFilter="*.json").select(F.hex("value")).collect()
    assert sorted(t for _, t in texts("*.json")) == sorted(r[0] for r in read) and len(read) == 4
    assert texts("*.json.gz") == texts("*.json")


def test_many_folders_take_few_tasks(spark, tmp_path):
    df = spark.range(600).selectExpr("concat('S', id) AS k", "concat('{\"v\": ', id, '}') AS value")
    folder = sinks.write_by_key(df, f"file:{tmp_path}/in", "k", 600)
    assert not list(tmp_path.rglob("*.crc"))  # Hadoop's; it starts processes for every file
    confs = {key: spark.conf.get(key, None) for key in ledger.MANY_FILES}
    logs = []
    tasks = tasks_of(spark, "refresh", lambda: logs.extend(ledger.refresh(spark, folder, f"{tmp_path}/out", "v int", r"/k=([^/]+)/", "*.txt").collect()))
    assert {(r["key"], r["action"]) for r in logs} == {(f"S{i}", "added") for i in range(600)} and len(logs) == 600
    assert tasks < 600
    assert confs == {key: spark.conf.get(key, None) for key in ledger.MANY_FILES}
    rows = versions.read_current(spark, f"{tmp_path}/out", "rows").collect()
    assert {(r["key"], r["v"]) for r in rows} == {(f"S{i}", i) for i in range(600)}


def test_settings_hold_inside_only(spark):
    key = "spark.sql.files.openCostInBytes"
    with pytest.raises(ZeroDivisionError), runtime.settings(spark, {key: "1m"}):
        assert spark.conf.get(key) == "1m"
        1 / 0
    assert spark.conf.get(key, None) != "1m"
