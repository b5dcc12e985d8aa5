"""Activity marts.

Every mart reads the play table or a pre-aggregate of it (``calendar_cube``,
``catalogue_cube``): counts and sums add up, so the result is the same, and one scan can
serve many marts. Whatever is limited or ranked breaks ties on the key columns.

With ``Params.listener_keys`` every mart is one per listener: the keys lead its columns,
and totals, limits and ranks are the listener's own. Without them it is over all plays.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearlog.functions import labels
from hearlog.functions.calendar import day_part, weekday_name
from hearlog.functions.rounding import MS_PER_HOUR, hours, minutes, percent, ratio
from hearlog.operators.sequence import play_sessions
from hearlog.params import Params
from hearlog.vocabulary import PLAN_ANNUAL, PLAN_MONTHLY


def _music() -> Column:
    return F.col("content_type") == "music"


def _plays(df: DataFrame) -> Column:
    return F.coalesce(F.sum("plays"), F.lit(0)) if "plays" in df.columns else F.count("*")


def _ms(df: DataFrame) -> Column:
    return F.sum("ms_total") if "ms_total" in df.columns else F.sum("ms_played")


def _skips(df: DataFrame) -> Column:
    return F.sum("skips") if "skips" in df.columns else F.sum(F.col("skipped").cast("bigint"))


def _complete(df: DataFrame, params: Params) -> Column:
    if "complete_plays" in df.columns:
        return F.sum("complete_plays")
    return F.sum(labels.is_complete(F.col("ms_played"), params.complete_ms).cast("bigint"))


def _first(df: DataFrame, params: Params, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows, of each listener where there are keys."""
    keys = params.listener_keys
    if not keys:
        return df.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def calendar_cube(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """Counts and played time per local hour and content type."""
    return fact.groupBy(*params.listener_keys, "year", "month", "day", "hour", "weekday", "content_type").agg(
        F.count("*").alias("plays"), F.sum("ms_played").alias("ms_total")
    )


def catalogue_cube(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """Counts, skips, complete plays and played time per country and title."""
    complete = labels.is_complete(F.col("ms_played"), params.complete_ms)
    finished = F.coalesce(complete == 1, F.lit(False)) & F.coalesce(~F.col("skipped"), F.lit(False))
    return fact.groupBy(
        *params.listener_keys, "content_type", "conn_country", "country_name", "track_name", "artist_name", "album_name",
        "show_name", "audiobook_title",
    ).agg(
        F.count("*").alias("plays"),
        F.sum("ms_played").alias("ms_total"),
        F.sum(F.col("skipped").cast("bigint")).alias("skips"),
        F.sum(complete.cast("bigint")).alias("complete_plays"),
        F.count(F.when(finished, 1)).alias("finished_plays"),
        F.sum(F.when(finished, F.col("ms_played"))).alias("finished_ms"),
    )


def _activity(df: DataFrame, params: Params, *keys: str) -> DataFrame:
    return (
        df.groupBy(*params.listener_keys, *keys)
        .agg(_plays(df).alias("plays"), _ms(df).alias("ms_total"))
        .withColumn("hours", hours(F.col("ms_total")))
    )


def time_per_year(plays: DataFrame, params: Params = Params()) -> DataFrame:
    return _activity(plays, params, "year").orderBy(*params.listener_keys, "year")


def content_mix(plays: DataFrame, params: Params = Params()) -> DataFrame:
    keys = params.listener_keys
    mix = _activity(plays, params, "content_type")
    total = F.sum("plays").over(Window.partitionBy(*keys))
    return mix.withColumn("plays_pct", percent(F.col("plays"), total)).orderBy(
        *keys, F.desc("plays"), "content_type"
    )


def skip_rate(plays: DataFrame, params: Params = Params()) -> DataFrame:
    music = plays.filter(_music())
    return music.groupBy(*params.listener_keys).agg(_skips(music).alias("skips"), _plays(music).alias("plays")).withColumn(
        "skip_pct", percent(F.col("skips"), F.col("plays"))
    )


def skip_rate_by_artist(plays: DataFrame, params: Params = Params()) -> DataFrame:
    music = plays.filter(_music())
    return (
        music.groupBy(*params.listener_keys, "artist_name")
        .agg(_skips(music).alias("skips"), _plays(music).alias("plays"))
        .filter(F.col("plays") >= params.min_artist_plays)
        .withColumn("skip_pct", percent(F.col("skips"), F.col("plays")))
        .orderBy(*params.listener_keys, F.desc("skip_pct"), F.desc("plays"), "artist_name")
    )


def complete_tracks(plays: DataFrame, params: Params = Params()) -> DataFrame:
    title = ["track_name", "artist_name", "album_name"]
    group = [*params.listener_keys, *title]
    if "finished_plays" in plays.columns:
        totals = (
            plays.filter(_music() & (F.col("finished_plays") > 0))
            .groupBy(*group)
            .agg(F.sum("finished_plays").alias("complete_plays"), F.sum("finished_ms").alias("ms_total"))
        )
    else:
        finished = _music() & (F.col("ms_played") >= params.complete_ms) & ~F.col("skipped")
        totals = (
            plays.filter(finished)
            .groupBy(*group)
            .agg(F.count("*").alias("complete_plays"), F.sum("ms_played").alias("ms_total"))
        )
    totals = totals.withColumn("minutes", minutes(F.col("ms_total")))
    return _first(totals, params, params.top_tracks, F.desc("complete_plays"), F.desc("ms_total"), *title)


def activity_by_hour(plays: DataFrame, params: Params = Params()) -> DataFrame:
    return _activity(plays, params, "hour").orderBy(*params.listener_keys, "hour")


def activity_by_month(plays: DataFrame, params: Params = Params()) -> DataFrame:
    return _activity(plays, params, "year", "month").orderBy(*params.listener_keys, "year", "month")


def activity_by_weekday(plays: DataFrame, params: Params = Params()) -> DataFrame:
    return (
        _activity(plays, params, "weekday")
        .withColumn("weekday_name", weekday_name(F.col("weekday")))
        .orderBy(*params.listener_keys, "weekday")
    )


def top_artists(plays: DataFrame, params: Params = Params()) -> DataFrame:
    music = plays.filter(_music())
    artists = (
        music.groupBy(*params.listener_keys, "artist_name")
        .agg(
            _plays(music).alias("plays"),
            _complete(music, params).alias("complete_plays"),
            _ms(music).alias("ms_total"),
        )
        .withColumn("hours", hours(F.col("ms_total")))
    )
    return _first(artists, params, params.top_artists, F.desc("plays"), F.desc("ms_total"), "artist_name")


def session_totals(sessions: DataFrame, params: Params = Params()) -> DataFrame:
    """Plays and length of each session, from numbered plays; in no order, as there may be
    any number of sessions."""
    keys = [*params.listener_keys, "session_id"]
    return (
        sessions.groupBy(*keys)
        .agg(F.count("*").alias("plays"), F.sum("ms_played").alias("ms_total"))
        .withColumn("minutes", minutes(F.col("ms_total")))
    )


def session_detail(fact: DataFrame, params: Params = Params()) -> DataFrame:
    columns = [*params.listener_keys, "play_id", "start_ms", "ms_played"]
    return session_totals(play_sessions(fact.select(*columns), params), params)


def session_stats(detail: DataFrame, params: Params = Params()) -> DataFrame:
    """One row over all sessions, or over each listener's; minutes are averaged as whole tenths, so the order in
    which partial sums meet does not show in the result."""
    tenths = F.round(F.col("minutes") * 10).cast("bigint")
    return detail.groupBy(*params.listener_keys).agg(
        F.count("*").alias("sessions"),
        (F.try_divide(F.sum(tenths), F.count("minutes")) / 10).alias("mean_minutes"),
        ratio(F.sum("plays"), F.count("*")).alias("mean_plays"),
        F.max("minutes").alias("longest_minutes"),
    )


def plan_recommendation(plays: DataFrame, params: Params = Params()) -> DataFrame:
    """Monthly or annual plan, from the number of active months."""
    keys = params.listener_keys
    months = plays.groupBy(*keys, "year", "month").agg(_ms(plays).alias("ms_total"))
    hundredths = F.round(F.round(F.col("ms_total") / MS_PER_HOUR, 2) * 100).cast("bigint")
    stats = months.groupBy(*keys).agg(
        F.rint(F.try_divide(F.sum(hundredths), F.count("ms_total"))).alias("_mean"),
        F.count("*").alias("active_months"),
    )
    monthly_year = params.monthly_price * 12
    return stats.select(
        *keys,
        F.coalesce(F.col("_mean") / 100, F.lit(0.0)).alias("mean_hours_per_month"),
        "active_months",
        F.lit(params.monthly_price).alias("monthly_price"),
        F.lit(params.annual_price).alias("annual_price"),
        F.lit(monthly_year).alias("monthly_price_x12"),
        F.lit(round(monthly_year - params.annual_price, 2)).alias("annual_saving"),
        F.when(F.col("active_months") >= params.annual_from_months, PLAN_ANNUAL)
        .otherwise(PLAN_MONTHLY)
        .alias("recommended_plan"),
    )


def top_tracks_by_country(plays: DataFrame, params: Params = Params()) -> DataFrame:
    """Tracks ranked by plays within each country; all tracks tied at a kept rank stay.

    Ranks come from how many tracks have each play count, which is a small table, and are
    joined back. A country with a third of all tracks is never sorted in one task.
    """
    keys = list(params.listener_keys)
    place, title = ["conn_country", "country_name"], ["track_name", "artist_name"]
    own = [f"_own_{k}" for k in keys]
    music = plays.filter(_music())
    tracks = music.groupBy(*keys, *place, *title).agg(_plays(music).alias("plays"))
    by_plays = Window.partitionBy(*own, "_code").orderBy(F.desc("plays"))
    more_plays = by_plays.rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        tracks.groupBy(
            *[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col("conn_country").alias("_code"), "plays"
        )
        .agg(F.count("*").alias("_tied"))
        .withColumn("rank", (F.coalesce(F.sum("_tied").over(more_plays), F.lit(0)) + 1).cast("int"))
        .filter(F.col("rank") <= params.top_country_rank)
        .select(*own, "_code", F.col("plays").alias("_count"), "rank")
    )
    kept = F.col("conn_country").eqNullSafe(F.col("_code")) & (F.col("plays") == F.col("_count"))
    for key, other in zip(keys, own, strict=True):
        kept = kept & F.col(key).eqNullSafe(F.col(other))
    return (
        tracks.join(ranks, kept)
        .select(*keys, *place, *title, "plays", "rank")
        .orderBy(*keys, "conn_country", "rank", *title)
    )


def day_part_mix(plays: DataFrame, params: Params = Params()) -> DataFrame:
    parts = plays.withColumn("day_part", day_part(F.col("hour")))
    return _activity(parts, params, "day_part", "content_type").orderBy(
        *params.listener_keys, "day_part", "content_type"
    )


def daily_average(plays: DataFrame, params: Params = Params()) -> DataFrame:
    keys = params.listener_keys
    days = plays.groupBy(*keys, "year", "month", "day").agg(_plays(plays).alias("plays"))
    return days.groupBy(*keys).agg(
        ratio(F.sum("plays"), F.count("*")).alias("mean_plays_per_day"),
        F.sum("plays").alias("plays"),
        F.count("*").alias("active_days"),
    )


def _longest(plays: DataFrame, params: Params, kind: str, title: str, n: int) -> DataFrame:
    titles = _activity(plays.filter(F.col("content_type") == kind), params, title)
    return _first(titles, params, n, F.desc("ms_total"), title)


def top_shows(plays: DataFrame, params: Params = Params()) -> DataFrame:
    return _longest(plays, params, "podcast", "show_name", params.top_shows)


def top_audiobooks(plays: DataFrame, params: Params = Params()) -> DataFrame:
    return _longest(plays, params, "audiobook", "audiobook_title", params.top_audiobooks)
