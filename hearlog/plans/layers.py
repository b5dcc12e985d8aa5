"""The four layers: landing, plays, marts, models.

Each takes paths or DataFrames, runs on its own and can be repeated. Only this module
writes; operators return DataFrames.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearlog.operators import fatigue, marts, origin, refine, session_store, weekly
from hearlog.params import Params
from hearlog.plans.published import publish, published_name
from hearlog.session import durable, prepare_session, temporary_tables
from hearlog.sources import landing, tables

FACT = "fact_plays"
FACT_PARTITIONS = ("year", "content_type")


def _store(name: str, df: DataFrame, root: str, published: bool, partitions: tuple[str, ...] = ()) -> str:
    if published:
        before = df.columns
        df = publish(name, df)
        names = dict(zip(before, df.columns, strict=True))
        partitions = tuple(names[c] for c in partitions)
        name = published_name(name)
    tables.write_table(df, f"{root}/{name}", partitions)
    return name


def land(
    spark: SparkSession, source: str, root: str, large: int = landing.LARGE
) -> dict[str, DataFrame]:
    """Land export files as they are, with manifest, field profile, rejects and summary.

    The source is read once, but for files too large for one row, whose records are read in
    byte ranges. The landed copy holds the bytes of each file; records, and their number by
    file, are tables of their own.
    """
    prepare_session(spark)
    tables.write_table(landing.landing(spark, source, large=large), f"{root}/files")
    files = tables.read_table(spark, f"{root}/files")

    def stored(found: DataFrame) -> DataFrame:
        tables.write_table(found, f"{root}/records")
        return tables.read_table(spark, f"{root}/records")

    with temporary_tables(spark):
        records, counts = landing.records_and_counts(files, stored)
        tables.write_table(counts, f"{root}/record_counts")
    counts = tables.read_table(spark, f"{root}/record_counts")
    files = files.join(counts, "path", "left")
    tables.write_table(landing.manifest(files, f"{root}/files"), f"{root}/manifest")
    tables.write_table(landing.field_profile(records), f"{root}/field_profile")
    tables.write_table(landing.rejects(files), f"{root}/rejects")
    manifest = tables.read_table(spark, f"{root}/manifest")
    profile = tables.read_table(spark, f"{root}/field_profile")
    summary = landing.landing_summary(manifest, profile)
    tables.write_document(summary, f"{root}/summary")
    return {
        "files": files, "records": records, "manifest": manifest, "field_profile": profile, "summary": summary,
    }


def build_plays(
    files: DataFrame,
    root: str,
    params: Params = Params(),
    listener_pattern: str | None = None,
    published: bool = False,
    records: DataFrame | None = None,
) -> DataFrame:
    """Refine landed files into the play table and its dimensions; returns the table.

    ``records`` is the table of records that ``land`` wrote. Without it, as for files that
    were landed one by one, the records of those files count that ``prefer_numbered``
    leaves. Dimensions read the stored table, so the JSON is parsed once.
    """
    spark = prepare_session(files.sparkSession)
    if records is None:
        records = landing.records(landing.prefer_numbered(files))
    raw = landing.history_from_records(records)
    if listener_pattern:
        raw = raw.withColumn("listener_id", F.regexp_extract("path", listener_pattern, 1))
    tables.write_table(refine.refine(raw, params), f"{root}/{FACT}", FACT_PARTITIONS)
    fact = tables.read_table(spark, f"{root}/{FACT}")
    if published:
        _store(FACT, fact, root, published, FACT_PARTITIONS)
    names = [_store(name, extract(fact), root, published) for name, extract in refine.DIMENSIONS.items()]
    document = tables.layer_document(spark, "plays", root, fact.count(), [FACT, *names])
    tables.write_document(document, f"{root}/_document")
    return fact


def build_marts(fact: DataFrame, params: Params = Params()) -> dict[str, DataFrame]:
    """All marts. Those that only count and sum read two pre-aggregates of the plays; these
    and the sessions are computed here once and kept in the shared folder."""
    calendar = durable(marts.calendar_cube(fact, params))
    catalogue = durable(marts.catalogue_cube(fact, params))
    detail = durable(marts.session_detail(fact, params))
    return {
        "calendar_cube": calendar,
        "catalogue_cube": catalogue,
        **marts_from_cubes(calendar, catalogue, params),
        "session_detail": detail,
        "session_stats": marts.session_stats(detail, params),
    }


def marts_from_cubes(
    calendar: DataFrame, catalogue: DataFrame, params: Params = Params()
) -> dict[str, DataFrame]:
    return {
        "time_per_year": marts.time_per_year(calendar, params),
        "content_mix": marts.content_mix(calendar, params),
        "skip_rate": marts.skip_rate(catalogue, params),
        "skip_rate_by_artist": marts.skip_rate_by_artist(catalogue, params),
        "complete_tracks": marts.complete_tracks(catalogue, params),
        "activity_by_hour": marts.activity_by_hour(calendar, params),
        "activity_by_month": marts.activity_by_month(calendar, params),
        "activity_by_weekday": marts.activity_by_weekday(calendar, params),
        "top_artists": marts.top_artists(catalogue, params),
        "plan_recommendation": marts.plan_recommendation(calendar, params),
        "top_tracks_by_country": marts.top_tracks_by_country(catalogue, params),
        "day_part_mix": marts.day_part_mix(calendar, params),
        "daily_average": marts.daily_average(calendar, params),
        "top_shows": marts.top_shows(catalogue, params),
        "top_audiobooks": marts.top_audiobooks(catalogue, params),
    }


def write_marts(
    fact: DataFrame,
    root: str,
    params: Params = Params(),
    locations: DataFrame | None = None,
    published: bool = False,
) -> list[str]:
    """Compute and store all marts: one scan of the plays for each pre-aggregate and one
    for the sessions."""
    spark = fact.sparkSession
    if locations is not None:
        fact = refine.enrich_country(fact, locations)
    with temporary_tables(spark):
        results = build_marts(fact, params)
        calendar, _ = results.pop("calendar_cube"), results.pop("catalogue_cube")
        names = [_store(name, df, root, published) for name, df in results.items()]
        total = calendar.agg(F.coalesce(F.sum("plays"), F.lit(0))).first()[0]
    tables.write_document(
        tables.layer_document(spark, "marts", root, total, names), f"{root}/_document"
    )
    return names


def update_sessions(fact: DataFrame, new_plays: DataFrame, root: str, params: Params = Params()) -> DataFrame:
    """Stored sessions with ``new_plays`` merged in; ``fact`` are the plays they stand for so far.

    The first call, without stored sessions, computes those of all plays. Returns the mart of
    sessions.
    """
    spark = fact.sparkSession
    path = f"{root}/session_store"
    stored = tables.read_table_if_present(spark, path)
    with temporary_tables(spark):
        columns = [*params.listener_keys, "play_id", "start_ms", "ms_played"]
        if stored is None:
            found = session_store.sessions_of(fact.select(*columns).unionByName(new_plays.select(*columns)), params)
        else:
            found = session_store.merged(stored, fact, new_plays, params)
        # Written apart first, as the table read is the one that is replaced.
        tables.write_table(durable(found), path)
    return session_store.session_detail(tables.read_table(spark, path), params)


def run_models(fact: DataFrame, params: Params = Params()) -> dict[str, DataFrame]:
    """All model tables; a model with too little data leaves its tables out."""
    plays = tables.model_input(fact)
    return (
        origin.origin_tables(plays, params)
        | weekly.weekly_tables(plays, params)
        | fatigue.fatigue_tables(plays, params)
    )


def model_summary(results: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """One row with the result documents of all models side by side; of a model that has a
    result per listener, how many listeners and weeks it covers."""
    summary = spark.range(1).select(F.current_timestamp().alias("written_at"))
    for name in ("origin_result", "week_result", "skip_result"):
        if name in results:
            found = results[name]
            if name == "week_result" and found.columns[0] != "weeks_analysed":
                found = found.agg(F.count("*").alias("listeners"), F.sum("weeks_analysed").alias("weeks_analysed"))
            document = found.select(F.struct("*").alias(name))
            summary = summary.crossJoin(F.broadcast(document))
    return summary


def write_models(
    fact: DataFrame, root: str, params: Params = Params(), published: bool = False
) -> list[str]:
    spark, names = fact.sparkSession, []
    with temporary_tables(spark):
        results = run_models(fact, params)
        for name, df in results.items():
            if name.endswith("_result") and not (name == "week_result" and params.listener_keys):
                shown = publish(name, df) if published else df
                shown_name = published_name(name) if published else name
                tables.write_document(shown, f"{root}/{shown_name}")
            else:
                names.append(_store(name, df, root, published))
        tables.write_document(model_summary(results, spark), f"{root}/summary")
    return names


def run_all(
    spark: SparkSession,
    source: str,
    root: str,
    params: Params = Params(),
    listener_pattern: str | None = None,
    models: bool = True,
    published: bool = False,
) -> None:
    """Landing, plays, marts and models, each under its own folder of ``root``."""
    prepare_session(spark)
    landed = land(spark, source, f"{root}/landing")
    fact = build_plays(
        landed["files"], f"{root}/plays", params, listener_pattern, published, landed["records"]
    )
    write_marts(fact, f"{root}/marts", params, published=published)
    if models:
        write_models(fact, f"{root}/models", params, published)
