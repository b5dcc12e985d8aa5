"""Classification of a play: content, country, origin, completeness."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearlog.functions.calendar import literal_map
from hearlog.vocabulary import (
    ACTIVE_REASONS,
    COUNTRY_NAMES,
    RECOMMENDER_REASONS,
    UNKNOWN_COUNTRY,
)


def content_type(track_uri: Column, episode_uri: Column, audiobook_uri: Column) -> Column:
    return (
        F.when(track_uri.isNotNull(), "music")
        .when(episode_uri.isNotNull(), "podcast")
        .when(audiobook_uri.isNotNull(), "audiobook")
        .otherwise("unknown")
    )


def country_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(COUNTRY_NAMES), code), F.lit(UNKNOWN_COUNTRY))


def origin(reason_start: Column) -> Column:
    """1 the listener chose, 0 the recommender did, null for any other reason."""
    return F.when(reason_start.isin(ACTIVE_REASONS), 1).when(reason_start.isin(RECOMMENDER_REASONS), 0)


def is_active(reason_start: Column) -> Column:
    """1 when the listener chose, 0 for every other reason and for none."""
    return F.when(reason_start.isin(ACTIVE_REASONS), 1).otherwise(0)


def is_complete(ms_played: Column, complete_ms: int) -> Column:
    """1 or 0, null when the played time is."""
    return (ms_played >= complete_ms).cast("int")


def flag(value: Column) -> Column:
    """A nullable boolean as 1 or 0, null counted as false."""
    return F.coalesce(value, F.lit(False)).cast("int")
