"""Files read in byte ranges, cut anywhere, against a parse of the whole file."""

import json
import random

import pytest
from pyspark.sql import functions as F

from hearlog.plans import layers
from hearlog.session import prepare_session
from hearlog.sources import landing
from hearlog.sources.split import split_records

GLOB = "*.json"


def whole(spark, path):
    files = landing.with_payload(spark.read.format("binaryFile").load(path))
    records = landing.records(files).select("path", "position", F.to_json("record").alias("r"))
    counts = landing.with_count(files).select("path", "record_count")
    return sorted(map(tuple, records.collect())), sorted(map(tuple, counts.collect()))


def split(spark, path):
    records, counts = split_records(spark, path, GLOB)
    rows = records.select("path", "position", F.to_json("record").alias("r")).collect()
    return sorted(map(tuple, rows)), sorted(map(tuple, counts.collect()))


@pytest.fixture
def cut(spark):
    """Sets how many bytes a task reads."""
    prepare_session(spark)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def at(size):
        spark.conf.set(names[0], f"{size}b")
        spark.conf.set(names[1], "1b")

    yield at
    for name in names:
        spark.conf.unset(name)


ODD = {
    "plain": '[{"a":1},{"b":"x}y{[,\\"\\\\"}, {"c":{"d":[{"e":2}]}}]',
    "spaced": ' \n[ {"a" : "}" }\n,\t{"b":[ ]} ] \n',
    "wrapped": '{"history" : [{"a":1}, {"b":"]}"}], "more":[{"c":3}], "n":{"x":"}"}}',
    "items": '[1, {"a":1}, "x}", [2, {"y":"{"}], null, {"b":2}, true]',
    "scalars": '[1, "a", null]',
    "empty": "[]", "empty wrapped": '{"h":[]}', "nothing": " ", "object": '{"h":{"a":[1]}}', "text": "no json", "one": '[{"a":1}]',
    "open": '[{"a":1},{"b":2}', "open wrapped": '{"h":[{"a":1}]', "open string": '[{"a":1},{"b":"2}]',
    "no comma": '[{"a":1}{"b":2}]', "two commas": '[{"a":1},,{"b":2}]', "last comma": '[{"a":1},]', "first comma": '[,{"a":1}]',
    "bad item": '[{"a":1},{"b":nope}]', "behind": '[{"a":1}] and {"more": "}', "behind wrapped": '{"h":[{"a":1}]} }',
    "unicode": '[{"é":"ñ}字"},{"b":"\U0001f600"}]', "bom": '\ufeff[{"a":1}]', "name +%é": '[{"a":1}]',
    "escaped quote": '[{"a":"\\\\"},{"b":"\\\\\\"}"},{"c":"\\u007d"}]',
}


def check(spark, folder, names, cut, sizes):
    for name in names:
        (folder / f"{name}.json").write_bytes(ODD[name].encode())
    cut(1 << 20)
    want = whole(spark, str(folder))
    for size in sizes:
        cut(size)
        got = split(spark, str(folder))
        assert [sorted(set(a) ^ set(b), key=str) for a, b in zip(got, want, strict=True)] == [[], []], size
        assert got == want, size
    return want


def test_pieces_make_the_records_of_the_whole(spark, tmp_path, cut):
    rows, counts = check(spark, tmp_path, ODD, cut, [1 << 20, 23])
    assert sum(count is None for _, count in counts) >= 9 and len(rows) > 25


def test_files_may_be_cut_at_every_byte(spark, tmp_path, cut):
    check(spark, tmp_path, ["plain", "wrapped", "items", "escaped quote", "open string"], cut, [1, 3])


def test_landing_of_a_file_too_large_for_a_row(spark, tmp_path):
    """The same tables as from whole files, in all that does not need a file's bytes."""
    source = tmp_path / "in"
    source.mkdir()
    for number, name in enumerate(["plain", "wrapped", "empty", "text", "last comma", "bad item"]):
        (source / f"Streaming_History_Audio_{number}.json").write_text(ODD[name])
    tables = [layers.land(spark, str(source), f"{tmp_path}/{large}", large) for large in (20, 1 << 20)]
    by_range, at_once = (
        [
            sorted(map(str, frame.collect())) for frame in (
                landed["records"].select("path", "position", F.to_json("record")),
                landed["manifest"].select("file_name", "record_count", "size_bytes"),
                landed["field_profile"], landing.rejects(landed["files"]),
            )
        ] for landed in tables
    )
    assert by_range == at_once and len(at_once[0]) == 5
    assert landing.landing(spark, str(source), large=20).where("content IS NULL").count() >= 3


def test_large_file_is_read_by_many_tasks(spark, tmp_path, cut):
    rng = random.Random(1)
    rows = [{"ts": n, "t": rng.choice(['a}', 'b{"', "c\\", "]["]) * rng.randrange(9), "n": {"k": [n]} if n % 7 == 0 else None} for n in range(20_000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text(json.dumps({"h": rows[:5_000]}, indent=1))
    cut(40_000)
    records, counts = split_records(spark, str(tmp_path), GLOB)
    assert {r.path[-6:]: r.record_count for r in counts.collect()} == {"a.json": 20_000, "b.json": 5_000}
    got = {(r.path[-6:], r.position): json.loads(r.j) for r in records.select("path", "position", F.to_json("record").alias("j")).collect()}
    want = {("a.json", i): r for i, r in enumerate(rows)} | {("b.json", i): r for i, r in enumerate(rows[:5_000])}
    plain = {key: {k: v for k, v in r.items() if v is not None} for key, r in want.items()}
    assert {key: {k: v for k, v in r.items() if v is not None} for key, r in got.items()} == plain


def test_parsed_items_are_not_shuffled_again(spark, tmp_path):
    """Items are numbered in the range they were parsed in: only small tables are sent to them."""
    (tmp_path / "a.json").write_text(ODD["plain"])
    records, _ = split_records(prepare_session(spark), str(tmp_path), GLOB)
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan
    assert records.count() == 3


def test_an_item_over_many_ranges_keeps_its_place(spark, tmp_path, cut):
    long = {"a": "}" * 50, "b": [{"c": n} for n in range(30)], "d": "]"}
    (tmp_path / "a.json").write_text(json.dumps([{"n": 0}, long, {"n": 2}, 3, long, {"n": 5}]))
    for size in (40, 100, 1 << 20):
        cut(size)
        rows, counts = split(spark, str(tmp_path))
        assert [json.loads(r) for _, _, r in rows] == [{"n": 0}, long, {"n": 2}, 3, long, {"n": 5}]
        assert [(at, counts[0][1]) for _, at, _ in rows] == [(n, 6) for n in range(6)]


def test_many_folders_are_listed_by_some_hundred_tasks(spark, tmp_path):
    for n in range(300):
        (tmp_path / f"{n}").mkdir()
        (tmp_path / f"{n}" / "a.json").write_text("[]")
    context = prepare_session(spark).sparkContext
    context.setJobGroup("folders", "listing")
    try:
        files = landing.landing(spark, str(tmp_path), GLOB)
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            context.setLocalProperty(name, None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(stage) for job in tracker.getJobIdsForGroup("folders") for stage in tracker.getJobInfo(job).stageIds]
    assert max(stage.numTasks for stage in stages if stage) <= 256
    assert files.count() == 300
