"""From raw plays to the play table and its dimensions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearlog.functions import labels
from hearlog.functions.calendar import calendar_fields, export_instant
from hearlog.functions.identity import digest
from hearlog.functions.text import clean_text
from hearlog.params import Params
from hearlog.session import require_utc
from hearlog.sources.export_format import PLAY_KEY, TEXT_COLUMNS

CALENDAR = ["year", "month", "day", "hour", "weekday"]


def drop_copies(plays: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, null equal to null; the survivor is the smallest of the copies.

    An aggregate rather than a window: copies are reduced in every map task, so a play
    that was exported a billion times does not reach one task.
    """
    rest = [c for c in plays.columns if c not in keys]
    if not rest:
        return plays.distinct()
    return (
        plays.groupBy(*keys)
        .agg(F.min(F.struct(*rest)).alias("_rest"))
        .select(*[F.col(c) if c in keys else F.col(f"_rest.{c}").alias(c) for c in plays.columns])
    )


def copy_counts(plays: DataFrame, keys: list[str]) -> DataFrame:
    """One row: plays before and after ``drop_copies`` and the difference."""
    groups = plays.groupBy(*keys).agg(F.count("*").alias("_n"))
    totals = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"), F.count("*").alias("rows_after")
    )
    return totals.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def clean_text_columns(plays: DataFrame, columns: list[str]) -> DataFrame:
    return plays.withColumns({c: clean_text(F.col(c)) for c in columns})


def with_calendar(plays: DataFrame, zone: str) -> DataFrame:
    """Start instant in ms and local calendar fields; null for a time that does not parse."""
    require_utc(plays.sparkSession)
    instant = export_instant(F.col("ts"))
    return plays.withColumns(
        {"start_ms": F.unix_millis(instant)} | calendar_fields(instant, zone)
    )


def with_content_type(plays: DataFrame) -> DataFrame:
    kind = labels.content_type(F.col("track_uri"), F.col("episode_uri"), F.col("audiobook_uri"))
    return plays.withColumn("content_type", kind)


def with_country_name(plays: DataFrame) -> DataFrame:
    return plays.withColumn("country_name", labels.country_name(F.col("conn_country")))


def with_play_id(plays: DataFrame, keys: list[str], reproducible: bool = True) -> DataFrame:
    """Identity from the key columns; or Spark's running number, unique in one run only."""
    if reproducible:
        return plays.withColumn("play_id", digest(*[F.col(c) for c in keys]))
    return plays.withColumn("play_id", F.monotonically_increasing_id())


def refine(raw: DataFrame, params: Params = Params()) -> DataFrame:
    """The play table: copies dropped, identity given, text cleaned, labels derived.

    Identity comes from the raw key, before cleaning makes different titles alike.
    """
    keys = [*params.listener_keys, *PLAY_KEY]
    plays = raw.drop("_corrupt_record", "path")
    plays = with_play_id(drop_copies(plays, keys), keys)
    plays = with_calendar(clean_text_columns(plays, TEXT_COLUMNS), params.zone)
    return with_country_name(with_content_type(plays))


def only_years(fact: DataFrame, years: list[int]) -> DataFrame:
    """Plays of the given years, all plays when none is given; prunes year partitions."""
    return fact.filter(F.col("year").isin(years)) if years else fact


def without_incognito(fact: DataFrame) -> DataFrame:
    return fact.filter(~F.coalesce(F.col("incognito_mode"), F.lit(False)))


def with_hashed_address(fact: DataFrame) -> DataFrame:
    return fact.withColumn("ip_addr", F.sha2("ip_addr", 256))


def dim_time(fact: DataFrame) -> DataFrame:
    """One row per local hour, with the smallest of its play identities."""
    return (
        fact.groupBy("year", "month", "day", "hour")
        .agg(F.min("play_id").alias("time_id"), F.min("weekday").alias("weekday"))
        .select("time_id", *CALENDAR)
    )


def _dimension(fact: DataFrame, id_name: str, columns: list[str]) -> DataFrame:
    return fact.select(F.col("play_id").alias(id_name), *columns)


def dim_art(fact: DataFrame) -> DataFrame:
    titles = ["track_name", "artist_name", "album_name", "episode_name", "show_name",
              "audiobook_title", "chapter_title", "content_type"]
    return _dimension(fact, "art_id", titles)


def dim_location(fact: DataFrame) -> DataFrame:
    return _dimension(fact, "location_id", ["conn_country", "country_name"])


def dim_user(fact: DataFrame) -> DataFrame:
    return _dimension(fact, "user_id", ["ip_addr", "platform"])


def dim_playback(fact: DataFrame) -> DataFrame:
    columns = ["ms_played", "reason_end", "reason_start", "skipped", "shuffle", "offline",
               "incognito_mode"]
    return _dimension(fact, "playback_id", columns)


def dim_keys(fact: DataFrame) -> DataFrame:
    return _dimension(fact, "key_id", ["chapter_uri", "audiobook_uri", "episode_uri", "track_uri"])


DIMENSIONS = {
    "dim_time": dim_time,
    "dim_art": dim_art,
    "dim_location": dim_location,
    "dim_user": dim_user,
    "dim_playback": dim_playback,
    "dim_keys": dim_keys,
}


def enrich_country(fact: DataFrame, locations: DataFrame) -> DataFrame:
    """Add the country name from the location dimension to a play table that lacks it."""
    if "country_name" in fact.columns:
        return fact
    names = locations.select(F.col("location_id").alias("play_id"), "country_name")
    return fact.join(names, "play_id", "left")
