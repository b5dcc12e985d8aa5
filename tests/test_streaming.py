import json

from hearlog.plans.layers import build_plays
from hearlog.sources import landing, tables
from hearlog.streaming.landing import land_new_files


def test_only_new_files_are_landed(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def export(name, n):
        rows = [{"ts": "2023-01-01T00:00:00Z", "ms_played": i} for i in range(n)]
        (source / f"Streaming_History_Audio_{name}.json").write_text(json.dumps(rows))

    export("1", 3)
    land_new_files(spark, str(source), root)
    export("2", 4)
    export("sample", 5)
    land_new_files(spark, str(source), root)
    land_new_files(spark, str(source), root)
    files = tables.read_table(spark, f"{root}/files")
    assert files.count() == 3
    plays = landing.history_from_records(landing.records(landing.prefer_numbered(files)))
    assert plays.count() == 7
    # The sample's five plays do not count; copies (equal times and lengths) are one play.
    assert build_plays(files, f"{root}/plays").count() == 4
