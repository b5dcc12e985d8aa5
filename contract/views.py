"""Presentation tables (V) and the label joins (J4)."""

from pyspark.sql import functions as F

from contract.marts import ACTIVITY, G04, G08, G10, G11, MUSIC_CONTEXT, SKIP_PCT, SKIPS, detail_cte
from contract.models import (
    case,
    confusion_cells,
    context,
    mean,
    on_plays,
    on_weeks,
    plays,
    ruled_named_weeks,
    ruled_weeks,
)
from contract.tables import MONTHS, half_even, history, hours, on_history
from hearlog.operators import fatigue, marts, origin, refine, views, weekly
from hearlog.params import Params
from hearlog.plans.layers import marts_from_cubes
from hearlog.vocabulary import FEATURE_LABELS

P = Params()
PER_LISTENER = Params(listener_keys=("listener_id",))


def _mart(name, view, *args):
    """A view of one mart of the shared pre-aggregates."""

    def query(spark, sf):
        fact = history(spark, sf)
        tables = marts_from_cubes(marts.calendar_cube(fact), marts.catalogue_cube(fact, P), P)
        return view(tables[name], *args)

    return query


def headline(spark, sf):
    fact = history(spark, sf)
    detail = marts.session_detail(fact, PER_LISTENER)
    return views.headline(marts.time_per_year(fact), marts.skip_rate(fact), marts.session_stats(detail))


def headline_without_sessions(spark, sf):
    fact = history(spark, sf)
    return views.headline(marts.time_per_year(fact), marts.skip_rate(fact), None)


def _profiles(spark, sf):
    return weekly.cluster_profiles(ruled_weeks(spark, sf))


def by_year_labelled(spark, sf):
    counts = weekly.profiles_by_year(ruled_named_weeks(spark, sf))
    return views.with_profile_names(counts, _profiles(spark, sf))


def by_month_labelled(spark, sf):
    counts = weekly.profiles_by_month(ruled_named_weeks(spark, sf), history(spark, sf), PER_LISTENER)
    return views.months_with_profile_names(counts, _profiles(spark, sf))


def weeks_labelled(spark, sf):
    labelled = views.with_profile_names(ruled_weeks(spark, sf), _profiles(spark, sf))
    return labelled.select("listener_id", "year", "week", "cluster", "profile_name")


def feature_labels(spark, sf):
    """Means of the skip model's features, labelled; one name has no label."""
    rows = context(spark, sf).select(*fatigue.FEATURES, "ms_before")
    means = rows.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in rows.columns])
    ranked = means.unpivot([], list(means.columns), "feature", "mean")
    return views.with_feature_labels(ranked).withColumn("mean", F.round("mean", 6))


QUERIES = {
    "v1_headline": headline,
    "v1_headline_without_sessions": headline_without_sessions,
    "v2_content_shares": _mart("content_mix", views.share_of_total),
    "v2_country_shares": _mart("top_tracks_by_country", lambda m: views.share_of_total(views.plays_by_country(m))),
    "v3_monthly_series": _mart("activity_by_month", views.monthly_series),
    "v4_top_15_artists": _mart("top_artists", lambda m: views.first_rows(m, 15, F.desc("plays"), F.desc("ms_total"), "artist_name")),
    "v4_top_10_tracks": _mart("complete_tracks", lambda m: views.first_rows(
        m, 10, F.desc("complete_plays"), F.desc("ms_total"), "track_name", "artist_name", "album_name")),
    "v5_most_skipped": _mart("skip_rate_by_artist", views.most_skipped),
    "v5_least_skipped": _mart("skip_rate_by_artist", views.least_skipped),
    "v6_countries": _mart("top_tracks_by_country", views.countries),
    "v6_country_top": _mart("top_tracks_by_country", views.country_top, "MX"),
    "v7_plays_by_country": _mart("top_tracks_by_country", views.plays_by_country),
    "v8_plan_costs": _mart("plan_recommendation", views.plan_costs),
    "v9_show_list": _mart("top_shows", views.show_list),
    "v9_audiobook_list": _mart("top_audiobooks", views.audiobook_list),
    "v10_trend_series": lambda s, sf: views.trend_series(origin.trend(plays(s, sf))),
    "v11_years_with_profiles": by_year_labelled,
    "v11_months_with_profiles": by_month_labelled,
    "v12_reference_skip_rate": lambda s, sf: views.reference_skip_rate(
        fatigue.skip_by_position(context(s, sf))).select(F.round("reference_rate", 9).alias("reference_rate")),
    "v13_skip_deltas": lambda s, sf: views.skip_deltas(fatigue.skip_rates(context(s, sf))).select(
        F.round("shuffle_delta", 6).alias("shuffle_delta"), F.round("recommender_delta", 6).alias("recommender_delta")),
    "v14_labelled_confusion": lambda s, sf: views.labelled_confusion(confusion_cells(s, sf)),
    "v15_only_years": lambda s, sf: marts.activity_by_hour(refine.only_years(history(s, sf), [2024])),
    "j4_weeks_with_profiles": weeks_labelled,
    "j4_feature_labels": feature_labels,
}

YEARS = f"years AS (SELECT year, count(*) AS plays, {hours('sum(ms_played)')} AS hours FROM history GROUP BY year)"
SKIP = f"skip AS (SELECT {SKIP_PCT} FROM history WHERE content_type = 'music')"
SESSION_MEAN = ("CAST(sum(CAST(round(minutes * 10) AS BIGINT)) AS BIGINT) / count(minutes) / 10")
HEADLINE = ("SELECT CAST(sum(CAST(round(hours * 100) AS BIGINT)) AS BIGINT) / 100 AS hours, CAST(sum(plays) AS BIGINT) AS plays, "
            "(SELECT skip_pct FROM skip) AS skip_pct, {} AS mean_session_minutes FROM years")
BY_ARTIST = (f"by_artist AS (SELECT artist_name, {SKIPS}, {SKIP_PCT} FROM history WHERE content_type = 'music' "
             "GROUP BY artist_name HAVING count(*) >= 5)")
RATES = "skip_rates AS (SELECT " + ", ".join(
    half_even(f"CAST(sum(skip){f} AS BIGINT) / count(*){f}", 4) + f" AS {n}" for n, f in {
        "s1": " FILTER (shuffle_on = 1)", "s0": " FILTER (shuffle_on = 0)",
        "a1": " FILTER (active = 1)", "a0": " FILTER (active = 0)"}.items()) + " FROM skip_context)"

ORACLES = {
    "v1_headline": on_history(
        HEADLINE.format(f"(SELECT {SESSION_MEAN} FROM detail)"), f"{YEARS}, {SKIP}, {detail_cte('listener_id')}"
    ),
    "v1_headline_without_sessions": on_history(HEADLINE.format("CAST(0 AS DOUBLE)"), f"{YEARS}, {SKIP}"),
    "v2_content_shares": on_history(
        f"SELECT content_type, {ACTIVITY}, CAST(round(CAST(CAST(count(*) / sum(count(*)) OVER () * 100 AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE) "
        "AS plays_pct, count(*) / sum(count(*)) OVER () AS share FROM history GROUP BY content_type"
    ),
    "v2_country_shares": on_history(
        "SELECT conn_country, country_name, CAST(sum(plays) AS BIGINT) AS plays, sum(plays) / sum(sum(plays)) OVER () AS share "
        "FROM by_country GROUP BY ALL", G11
    ),
    "v3_monthly_series": on_history(
        f"SELECT year, month, {case('month', MONTHS)} AS month_label, {hours('sum(ms_played)')} AS hours FROM history GROUP BY year, month"
    ),
    "v4_top_15_artists": on_history(
        f"SELECT * FROM (SELECT * FROM ({G08})) ORDER BY plays DESC, ms_total DESC, artist_name NULLS FIRST LIMIT 15"
    ),
    "v4_top_10_tracks": on_history(
        f"SELECT * FROM ({G04}) ORDER BY complete_plays DESC, ms_total DESC, track_name NULLS FIRST, artist_name NULLS FIRST, "
        "album_name NULLS FIRST LIMIT 10"
    ),
    "v5_most_skipped": on_history(
        "SELECT * FROM by_artist ORDER BY skip_pct DESC, plays DESC, artist_name NULLS FIRST LIMIT 10", BY_ARTIST
    ),
    "v5_least_skipped": on_history(
        "SELECT * FROM by_artist ORDER BY skip_pct, plays, artist_name DESC NULLS LAST LIMIT 10", BY_ARTIST
    ),
    "v6_countries": on_history("SELECT DISTINCT conn_country FROM by_country", G11),
    "v6_country_top": on_history(
        "SELECT * FROM by_country WHERE conn_country = 'MX' ORDER BY rank, track_name NULLS FIRST, artist_name NULLS FIRST LIMIT 10", G11
    ),
    "v7_plays_by_country": on_history(
        "SELECT conn_country, country_name, CAST(sum(plays) AS BIGINT) AS plays FROM by_country GROUP BY ALL", G11
    ),
    "v8_plan_costs": on_history(
        "SELECT '12 × Mensual' AS plan, monthly_price_x12 AS cost, monthly_price_x12 - annual_price AS saving FROM plan "
        "UNION ALL SELECT 'Plan Anual', annual_price, monthly_price_x12 - annual_price FROM plan", G10
    ),
    "v9_show_list": on_history(
        f"SELECT show_name AS show, count(*) AS episodes, {hours('sum(ms_played)')} AS hours FROM history "
        "WHERE content_type = 'podcast' GROUP BY show_name ORDER BY sum(ms_played) DESC, show_name NULLS FIRST LIMIT 20"
    ),
    "v9_audiobook_list": on_history(
        f"SELECT audiobook_title AS audiobook, count(*) AS sessions, {hours('sum(ms_played)')} AS hours FROM history "
        "WHERE content_type = 'audiobook' GROUP BY audiobook_title ORDER BY sum(ms_played) DESC, audiobook_title NULLS FIRST LIMIT 10"
    ),
    "v10_trend_series": on_plays(
        f"SELECT concat(CAST(year AS VARCHAR), '-', lpad(CAST(month AS VARCHAR), 2, '0')) AS date, {half_even(mean('origin'), 3)} "
        "AS active_share FROM plays GROUP BY year, month"
    ),
    "v11_years_with_profiles": on_weeks(
        "SELECT year, cluster, profile, profile AS profile_name, count(*) AS weeks FROM named GROUP BY ALL"
    ),
    "v11_months_with_profiles": on_weeks(
        f"SELECT month, cluster, profile, profile AS profile_name, {case('month', MONTHS)} AS month_label, count(*) AS weeks "
        "FROM named LEFT JOIN months USING (listener_id, year, week) GROUP BY ALL"
    ),
    "v12_reference_skip_rate": on_history(
        f"SELECT round(avg(r), 9) AS reference_rate FROM (SELECT {mean('skip')} AS r FROM skip_context GROUP BY position "
        "HAVING count(*) >= 10 ORDER BY position LIMIT 30)", MUSIC_CONTEXT
    ),
    "v13_skip_deltas": on_history(
        "SELECT round(s0 - s1, 6) AS shuffle_delta, round(a0 - a1, 6) AS recommender_delta FROM skip_rates", MUSIC_CONTEXT + "," + RATES
    ),
    "v14_labelled_confusion": on_plays(
        "SELECT CASE WHEN skip = 0 THEN 'Real: No Skip' ELSE 'Real: Skip' END AS actual_label, "
        "count(*) FILTER (1 - origin = 0) AS \"Pred: No Skip\", count(*) FILTER (1 - origin = 1) AS \"Pred: Skip\" FROM plays GROUP BY 1"
    ),
    "v15_only_years": on_history(f"SELECT hour, {ACTIVITY} FROM history WHERE year IN (2024) GROUP BY hour"),
    "j4_weeks_with_profiles": on_weeks("SELECT listener_id, year, week, cluster, profile AS profile_name FROM named"),
    "j4_feature_labels": on_history(
        " UNION ALL ".join(
            f"SELECT '{f}' AS feature, '{FEATURE_LABELS.get(f, f)}' AS feature_label, "
            f"round(avg(CAST({f} AS DOUBLE)), 6) AS mean FROM skip_context"
            for f in [*fatigue.FEATURES, "ms_before"]
        ), MUSIC_CONTEXT
    ),
}
