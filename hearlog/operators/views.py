"""Presentation tables derived from the marts and model tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearlog.functions.calendar import literal_map, month_key, month_label
from hearlog.vocabulary import ACTUAL_LABELS, FEATURE_LABELS, PLAN_LABELS, PREDICTED_LABELS


def headline(
    per_year: DataFrame | None, skips: DataFrame | None, sessions: DataFrame | None
) -> DataFrame:
    """One row of headline numbers; 0 for what comes from a table that is absent."""
    spark = next(t for t in (per_year, skips, sessions) if t is not None).sparkSession

    def one_row(table: DataFrame | None, **columns: Column) -> DataFrame:
        if table is None:
            return spark.range(1).select(*[F.lit(None).cast("double").alias(n) for n in columns])
        return table.agg(*[c.alias(n) for n, c in columns.items()])

    hundredths = F.round(F.col("hours") * 100).cast("bigint")
    row = one_row(per_year, hours=F.sum(hundredths) / 100, plays=F.sum("plays"))
    row = row.crossJoin(F.broadcast(one_row(skips, skip_pct=F.max("skip_pct"))))
    row = row.crossJoin(F.broadcast(one_row(sessions, mean_session_minutes=F.max("mean_minutes"))))
    return row.select(
        F.coalesce("hours", F.lit(0.0)).alias("hours"),
        F.coalesce(F.col("plays").cast("bigint"), F.lit(0)).alias("plays"),
        F.coalesce("skip_pct", F.lit(0.0)).alias("skip_pct"),
        F.coalesce("mean_session_minutes", F.lit(0.0)).alias("mean_session_minutes"),
    )


def share_of_total(mart: DataFrame, value: str = "plays") -> DataFrame:
    """Each row's part of the total of ``value``; the mart is an aggregate already."""
    total = F.sum(value).over(Window.partitionBy())
    return mart.withColumn("share", F.try_divide(F.col(value), total))


def monthly_series(per_month: DataFrame) -> DataFrame:
    return per_month.select(
        "year", "month", month_label(F.col("month")).alias("month_label"), "hours"
    ).orderBy("year", "month")


def first_rows(mart: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of a ranked mart."""
    return mart.orderBy(*order).limit(n)


def most_skipped(by_artist: DataFrame, n: int = 10) -> DataFrame:
    return by_artist.orderBy(F.desc("skip_pct"), F.desc("plays"), "artist_name").limit(n)


def least_skipped(by_artist: DataFrame, n: int = 10) -> DataFrame:
    order = [F.asc("skip_pct"), F.asc("plays"), F.desc_nulls_last("artist_name")]
    return by_artist.orderBy(*order).limit(n)


def countries(by_country: DataFrame) -> DataFrame:
    return by_country.select("conn_country").distinct().orderBy("conn_country")


def country_top(by_country: DataFrame, code: str, n: int = 10) -> DataFrame:
    return (
        by_country.filter(F.col("conn_country") == code)
        .orderBy("rank", "track_name", "artist_name")
        .limit(n)
    )


def plays_by_country(by_country: DataFrame) -> DataFrame:
    """Plays of the ranked tracks only, by country."""
    return (
        by_country.groupBy("conn_country", "country_name")
        .agg(F.sum("plays").alias("plays"))
        .orderBy(F.desc("plays"), "conn_country")
    )


def plan_costs(plan: DataFrame) -> DataFrame:
    """The two plans side by side, with what the annual one saves."""
    monthly, annual = PLAN_LABELS
    return plan.select(
        F.expr("inline(array(named_struct('plan', '%s', 'cost', monthly_price_x12), "
               "named_struct('plan', '%s', 'cost', annual_price)))" % (monthly, annual)),
        (F.col("monthly_price_x12") - F.col("annual_price")).alias("saving"),
    )


def show_list(shows: DataFrame) -> DataFrame:
    return shows.select(
        F.col("show_name").alias("show"), F.col("plays").alias("episodes"), "hours"
    )


def audiobook_list(books: DataFrame) -> DataFrame:
    return books.select(
        F.col("audiobook_title").alias("audiobook"), F.col("plays").alias("sessions"), "hours"
    )


def trend_series(trend: DataFrame) -> DataFrame:
    return trend.select(
        month_key(F.col("year"), F.col("month")).alias("date"), "active_share"
    ).orderBy("date")


def with_profile_names(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add the profile name of each row's cluster (a handful of clusters)."""
    names = F.broadcast(profiles.select("cluster", F.col("profile").alias("profile_name")))
    return rows.join(names, "cluster", "left")


def months_with_profile_names(by_month: DataFrame, profiles: DataFrame) -> DataFrame:
    return with_profile_names(by_month, profiles).withColumn(
        "month_label", month_label(F.col("month"))
    )


def with_feature_labels(ranked: DataFrame) -> DataFrame:
    label = F.try_element_at(literal_map(FEATURE_LABELS), F.col("feature"))
    return ranked.withColumn("feature_label", F.coalesce(label, F.col("feature")))


def reference_skip_rate(by_position: DataFrame) -> DataFrame:
    return by_position.agg(F.avg("skip_rate").alias("reference_rate"))


def skip_deltas(rates: DataFrame) -> DataFrame:
    return rates.select(
        (F.col("skip_rate_shuffle_off") - F.col("skip_rate_shuffle_on")).alias("shuffle_delta"),
        (F.col("skip_rate_recommender") - F.col("skip_rate_active")).alias("recommender_delta"),
    )


def labelled_confusion(cells: DataFrame) -> DataFrame:
    """Confusion counts as a 2 × 2 table with readable rows and columns."""
    columns = [
        F.coalesce(F.sum(F.when(F.col("predicted") == k, F.col("plays"))), F.lit(0)).alias(name)
        for k, name in PREDICTED_LABELS.items()
    ]
    actual = F.try_element_at(literal_map(ACTUAL_LABELS), F.col("actual"))
    return cells.groupBy(actual.alias("actual_label")).agg(*columns).orderBy("actual_label")
