import pytest
from pyspark.sql import functions as F

from hearlog.operators import marts, views
from hearlog.params import Params
from hearlog.plans import layers
from hearlog.plans.published import TABLES, publish
from tests.plays import fact_plays

P = Params()


def mixed(spark):
    """Plays with null keys, null flags and borders."""
    rows = []
    for i in range(200):
        rows.append({
            "start_ms": i * 400_000, "ms_played": [29_999, 30_000, None, 500_000][i % 4],
            "content_type": ["music", "podcast", "audiobook", "unknown", "music"][i % 5],
            "track_name": f"t{i % 11}", "artist_name": None if i % 7 == 0 else f"a{i % 5}",
            "show_name": f"s{i % 30}", "audiobook_title": f"b{i % 12}",
            "skipped": [True, False, None][i % 3], "conn_country": [None, "MX", "US"][i % 3],
            "country_name": ["Desconocido", "México", "Estados Unidos"][i % 3],
            "year": 2020 + i % 3, "month": 1 + i % 12, "day": 1 + i % 28, "hour": i % 24 if i % 50 else None,
            "weekday": 1 + i % 7,
        })
    return fact_plays(spark, *rows)


def rows(df):
    return sorted(map(str, df.collect()))


def test_cubes_give_the_same_marts(spark):
    fact = mixed(spark)
    direct = {
        "time_per_year": marts.time_per_year(fact), "content_mix": marts.content_mix(fact),
        "skip_rate": marts.skip_rate(fact), "skip_rate_by_artist": marts.skip_rate_by_artist(fact, P),
        "complete_tracks": marts.complete_tracks(fact, P), "activity_by_hour": marts.activity_by_hour(fact),
        "activity_by_month": marts.activity_by_month(fact), "activity_by_weekday": marts.activity_by_weekday(fact),
        "top_artists": marts.top_artists(fact, P), "plan_recommendation": marts.plan_recommendation(fact, P),
        "top_tracks_by_country": marts.top_tracks_by_country(fact, P), "day_part_mix": marts.day_part_mix(fact),
        "daily_average": marts.daily_average(fact), "top_shows": marts.top_shows(fact, P),
        "top_audiobooks": marts.top_audiobooks(fact, P),
    }
    fused = layers.build_marts(fact, P)
    assert {n for n in direct if rows(direct[n]) != rows(fused[n])} == set()
    assert set(fused) - set(direct) == {"calendar_cube", "catalogue_cube", "session_detail", "session_stats"}


def test_sums_agree_across_marts(spark):
    tables = layers.build_marts(mixed(spark), P)
    names = ["time_per_year", "content_mix", "activity_by_hour", "activity_by_month", "activity_by_weekday", "day_part_mix"]
    totals = {tuple(tables[n].agg(F.sum("plays"), F.sum("ms_total")).first()) for n in names}
    assert len(totals) == 1
    assert tables["session_detail"].agg(F.sum("plays")).first()[0] == 200


def test_thresholds(spark):
    fact = fact_plays(spark, *[{"artist_name": "four"}] * 4, *[{"artist_name": "five", "skipped": None}] * 5)
    assert [tuple(r) for r in marts.skip_rate_by_artist(fact).collect()] == [("five", None, 5, None)]
    border = fact_plays(spark, {"ms_played": 29_999}, {"ms_played": 30_000}, {"ms_played": 30_000, "skipped": None})
    assert marts.complete_tracks(border).first()["complete_plays"] == 1
    assert marts.top_artists(border).first()["complete_plays"] == 2


def test_null_skips_are_counted_in_the_total_only(spark):
    fact = fact_plays(spark, {"skipped": True}, {"skipped": None}, {"skipped": False}, {"skipped": True})
    assert tuple(marts.skip_rate(fact).first()) == (2, 4, 50.0)


def test_rank_keeps_all_ties_and_null_country(spark):
    fact = fact_plays(
        spark, *[{"track_name": f"t{i}"} for i in range(11)],
        *[{"track_name": "x", "conn_country": None}] * 2, {"track_name": "y", "conn_country": None})
    ranked = marts.top_tracks_by_country(fact).collect()
    assert sum(r["conn_country"] == "MX" and r["rank"] == 1 for r in ranked) == 11
    assert [(r["track_name"], r["rank"]) for r in ranked if r["conn_country"] is None] == [("x", 1), ("y", 2)]


def test_no_country_is_ranked_in_one_task(spark):
    plan = marts.top_tracks_by_country(mixed(spark))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("track_name" not in line for line in windows)


def test_empty_history(spark):
    tables = layers.build_marts(fact_plays(spark), P)
    assert tuple(tables["skip_rate"].first()) == (None, 0, None)
    plan = tables["plan_recommendation"].first()
    assert (plan["mean_hours_per_month"], plan["active_months"], plan["recommended_plan"]) == (0.0, 0, "mensual")
    assert tables["session_stats"].first()["sessions"] == 0


@pytest.mark.parametrize("months, plan", [(9, "mensual"), (10, "anual")])
def test_plan_border(spark, months, plan):
    fact = fact_plays(spark, *[{"month": m + 1, "ms_played": 3_600_000} for m in range(months)])
    row = marts.plan_recommendation(fact).first()
    assert (row["recommended_plan"], row["annual_saving"], row["mean_hours_per_month"]) == (plan, 198.0, 1.0)


def test_headline_without_tables(spark):
    fact = fact_plays(spark, {"ms_played": 3_600_000, "skipped": True})
    row = views.headline(marts.time_per_year(fact), None, None).first()
    assert tuple(row) == (1.0, 1, 0.0, 0.0)


def test_least_skipped_is_the_reversed_end(spark):
    fact = fact_plays(spark, *[
        {"artist_name": f"a{i:02d}", "skipped": play < i % 4} for i in range(14) for play in range(6)])
    by_artist = marts.skip_rate_by_artist(fact)
    whole = [r["artist_name"] for r in by_artist.collect()]
    assert [r["artist_name"] for r in views.most_skipped(by_artist).collect()] == whole[:10]
    assert [r["artist_name"] for r in views.least_skipped(by_artist).collect()] == whole[:-11:-1]


def test_published_names(spark):
    tables = layers.build_marts(mixed(spark), P)
    shown = publish("content_mix", tables["content_mix"])
    assert shown.columns == ["tipo_arte", "reproducciones", "ms_total", "horas_total", "pct_reproducciones"]
    assert {r["tipo_arte"] for r in shown.collect()} == {"musica", "podcast", "audiolibro", "desconocido"}
    session = publish("session_detail", tables["session_detail"])
    assert session.columns == ["session_id", "tracks_en_sesion", "duracion_ms", "duracion_min"]
    assert len({name for name, _ in TABLES.values()}) == len(TABLES)
