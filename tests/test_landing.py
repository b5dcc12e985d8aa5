import json

import pytest
from pyspark.sql import functions as F

from hearlog.plans import layers
from hearlog.session import prepare_session
from hearlog.sources import landing, tables
from hearlog.sources.export_format import FIELDS


def record(**fields):
    base = {name: None for name, _, _ in FIELDS}
    return base | {"ts": "2023-01-01T00:00:00Z", "ms_played": 40_000} | fields


@pytest.fixture
def exports(tmp_path):
    folder = tmp_path / "exports"

    def write(**files):
        folder.mkdir(exist_ok=True)
        for name, content in files.items():
            text = content if isinstance(content, str) else json.dumps(content, ensure_ascii=False)
            (folder / f"Streaming_History_Audio_{name}.json").write_text(text, encoding="utf-8")
        return str(folder)

    return write


def names(df):
    return {r["path"].split("_")[-1] for r in df.select("path").collect()}


def test_discovery_and_precedence(spark, exports):
    path = exports(**{"0": [], "2020": [], "2020-2021": []})
    assert names(landing.landing(spark, path)) == {"0.json", "2020.json"}


def test_precedence_is_decided_per_folder(spark, tmp_path):
    for listener, name in (("anna", "0"), ("anna", "2020-2021"), ("ben", "2020-2021")):
        (tmp_path / listener).mkdir(exist_ok=True)
        (tmp_path / listener / f"Streaming_History_Audio_{name}.json").write_text(json.dumps([record()]))
    plays = landing.read_history(spark, str(tmp_path), listener_pattern=r"/([a-z]+)/[^/]*$")
    assert sorted(r["listener_id"] for r in plays.collect()) == ["anna", "ben"]


def test_a_key_that_a_record_has_twice_keeps_its_last_value(spark, exports):
    path = exports(**{"1": '[{"ts":"x","ts":"y"},{"ts":"z"}]'})
    files = landing.landing(prepare_session(spark), path)
    assert sorted(r["ts"] for r in landing.history_from_records(landing.records(files)).collect()) == ["y", "z"]
    assert landing.rejects(files).count() == 0


def test_unnumbered_files_alone_are_used(spark, exports):
    assert names(landing.landing(spark, exports(a=[], b=[]))) == {"a.json", "b.json"}


def test_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        landing.landing(spark, str(tmp_path))


def test_wrapped_broken_and_empty_files(spark, exports):
    path = exports(**{
        "1": [record(), record(ms_played=1)],
        "2": {"zeta": [record()], "alpha": [record(), record()]},
        "3": "no json",
        "4": [],
        "5": {"count": 5, "rows": [record()]},
        "6": {},
    })
    files = landing.landing(spark, path)
    counts = {r["file_name"].split("_")[-1]: r["record_count"] for r in landing.manifest(files).collect()}
    # The first value in document order counts, whatever its key.
    assert counts == {"1.json": 2, "2.json": 1, "3.json": None, "4.json": 0, "5.json": None, "6.json": None}
    assert names(landing.rejects(files)) == {"3.json", "5.json", "6.json"}
    assert landing.records(files).count() == 3
    with pytest.raises(Exception, match="Unexpected JSON structure"):
        landing.records(files, on_bad_file="fail").collect()


def test_manifest_digest(spark, exports):
    import hashlib

    path = exports(**{"1": [record()]})
    content = (json.dumps([record()], ensure_ascii=False)).encode()
    row = landing.manifest(landing.landing(spark, path)).first()
    assert (row["sha256"], row["size_bytes"]) == (hashlib.sha256(content).hexdigest(), len(content))


def test_field_profile(spark, exports):
    path = exports(**{"1": [
        {"a": 1, "b": "x", "c": None}, {"a": 1.5, "b": True, "d": [1], "e": {"f": 1}}, {"a": None}]})
    profile = landing.field_profile(landing.records(landing.landing(spark, path)))
    found = {r["field"]: r["types"] for r in profile.collect()}
    assert found == {"a": ["NoneType", "float", "int"], "b": ["bool", "str"], "c": ["NoneType"],
                     "d": ["list"], "e": ["dict"]}


def test_wrong_kinds_become_null_and_are_kept_as_text(spark, exports):
    path = exports(**{"1": [record(), record(ms_played="12", shuffle=1), 7]})
    recs = landing.records(landing.landing(spark, path))
    plays = landing.history_from_records(recs)
    rows = plays.select("ms_played", "shuffle", F.col("_corrupt_record").isNotNull().alias("bad")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(40_000, None, False), (None, None, True)], key=str)
    assert [r["item"] for r in landing.bad_items(recs).collect()] == ["7"]


def test_whole_run(spark, exports, tmp_path):
    # Two years of plays, two a day and every second one skipped, with copies.
    rows = []
    for day in range(730):
        for play in range(2):
            month = f"{2022 + day // 365}-{1 + day % 365 // 31:02d}-{1 + day % 28:02d}"
            rows.append(record(
                ts=f"{month}T{10 + play * 2:02d}:00:00Z", ms_played=20_000 + (day % 5) * 10_000,
                spotify_track_uri=f"t{day % 13}", master_metadata_track_name=f"n{day % 13} ★",
                master_metadata_album_artist_name=f"a{day % 4}", skipped=play == 0, shuffle=day % 3 == 0,
                reason_start=["clickrow", "trackdone"][day % 2], conn_country="MX"))
    source, root = exports(**{"1": rows, "2": {"history": rows[:100]}}), str(tmp_path / "out")
    from hearlog.params import Params

    light = Params(forest_trees=3, boost_rounds=2, boost_depth=2, folds=2, search_starts=1, final_starts=1,
                   max_clusters=3)
    layers.run_all(spark, source, root, light, published=True)

    manifest = tables.read_table(spark, f"{root}/landing/manifest")
    assert manifest.agg(F.sum("record_count")).first()[0] == len(rows) + 100
    fact = tables.read_table(spark, f"{root}/plays/fact_plays")
    distinct = {(r["ts"], r["ms_played"], r["spotify_track_uri"]) for r in rows}
    assert fact.count() == len(distinct)
    assert {r[0] for r in fact.select("track_name").distinct().collect()} == {f"n{i}" for i in range(13)}
    assert tables.read_table(spark, f"{root}/plays/fact_streaming").columns[-2:] == ["año", "tipo_arte"]

    per_year = tables.read_table(spark, f"{root}/marts/G01_tiempo_total_por_año")
    assert per_year.columns == ["año", "reproducciones", "ms_total", "horas_total"]
    assert per_year.agg(F.sum("reproducciones")).first()[0] == len(distinct)
    stats = tables.read_table(spark, f"{root}/marts/G09_sesiones_estadisticas").first()
    assert stats["total_sesiones"] > 0
    plan = tables.read_table(spark, f"{root}/marts/G10_plan_recomendacion").first()
    assert plan["recomendacion_plan"] == "anual"
    assert spark.read.json(f"{root}/marts/_document").first()["total_records"] == len(distinct)

    importance = tables.read_table(spark, f"{root}/models/ML1_feature_importance")
    assert {r["feature"] for r in importance.collect()} >= {"ms_played", "escucha_completa", "hora"}
    skip = spark.read.json(f"{root}/models/ML3_resultados").first()
    assert 0 <= skip["accuracy"] <= 1 and skip["modelo"].startswith("Gradient Boosting")
    summary = spark.read.json(f"{root}/models/summary").first()
    assert summary["week_result"]["best_k"] >= 2

    # A second run replaces the tables.
    years = per_year.count()
    layers.write_marts(fact, f"{root}/marts", light, published=True)
    assert tables.read_table(spark, f"{root}/marts/G01_tiempo_total_por_año").count() == years


def test_listener_from_path(spark, exports):
    path = exports(**{"1": [record()], "2": [record()]})
    plays = landing.read_history(spark, path, listener_pattern=r"Audio_(\d+)")
    assert {r["listener_id"] for r in plays.collect()} == {"1", "2"}


def test_absent_table(spark, tmp_path):
    assert tables.read_table_if_present(spark, str(tmp_path / "none")) is None


def test_partition_write_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "year int, content_type string, n int"
    tables.write_table(spark.createDataFrame([(1, "a", 1), (2, "a", 2)], schema), path, ("year", "content_type"))
    tables.write_partitions(spark.createDataFrame([(2, "a", 9)], schema), path, ("year", "content_type"))
    assert sorted(r["n"] for r in tables.read_table(spark, path).collect()) == [1, 9]


def test_layers_from_the_command_line(spark, exports, tmp_path):
    from hearlog.__main__ import main

    source, root = exports(**{"1": [record(), record(ms_played=50_000)]}), str(tmp_path / "out")
    main(["landing", root, "--source", source], spark)
    main(["plays", root], spark)
    main(["marts", root, "--published"], spark)
    assert tables.read_table(spark, f"{root}/plays/fact_plays").count() == 2
    assert tables.read_table(spark, f"{root}/marts/G01_tiempo_total_por_año").first()["reproducciones"] == 2
    with pytest.raises(SystemExit):
        main(["all", root], spark)
