"""Row transforms (T), dimensions (D) and the joins (J) around them."""

from pyspark.sql import functions as F

from contract.tables import (
    LOCAL_FIELDS,
    MONTHS,
    WEEKDAYS,
    country_case,
    history,
    hours,
    minutes,
    on_history,
    on_raw,
    percent,
    raw,
    raw_with_copies,
)
from hearlog.functions import calendar, labels, rounding
from hearlog.functions.text import clean_text
from hearlog.operators import refine
from hearlog.params import Params
from hearlog.session import prepare_session
from hearlog.sources.export_format import PLAY_KEY, TEXT_COLUMNS

P = Params()
PER_LISTENER = Params(listener_keys=("listener_id",))
KEYS = ["listener_id", *PLAY_KEY]


# White space by code point: what text is trimmed of on both sides.
BLANKS = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def clean_sql(column: str) -> str:
    """Other symbols, all beyond U+FFFF and a few newer symbols out; blanks trimmed; null if nothing is left."""
    symbols = r"[\p{So}\x{10000}-\x{10FFFF}\x{2FFC}-\x{2FFF}\x{31EF}\x{FD40}-\x{FD4F}\x{FDCF}\x{FDFE}\x{FDFF}]"
    kept = f"regexp_replace({column}, '{symbols}', '', 'g')"
    return f"nullif(trim({kept}, '{''.join(map(chr, BLANKS))}'), '')"


def digest_sql(columns: list[str]) -> str:
    parts = ", ".join(
        f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
        for c in columns
    )
    return f"upper(md5(concat_ws('|', {parts})))"


KEY_SQL = ", ".join(KEYS)
REST = ["platform", "conn_country", "ip_addr", "artist_name", "album_name", "show_name", "chapter_uri",
        "chapter_title", "reason_start", "reason_end", "shuffle", "skipped", "offline",
        "offline_timestamp", "incognito_mode"]
REST_ORDER = ", ".join(
    f"{c} NULLS FIRST" for c in
    ["conn_country", "ip_addr", "artist_name", "album_name", "show_name", "chapter_uri", "chapter_title",
     "reason_start", "reason_end", "shuffle", "skipped", "offline", "offline_timestamp", "incognito_mode",
     "platform"]
)
INSTANT = "try_strptime(ts, '%Y-%m-%dT%H:%M:%SZ')"
CONTENT = """CASE WHEN track_uri IS NOT NULL THEN 'music' WHEN episode_uri IS NOT NULL THEN 'podcast'
  WHEN audiobook_uri IS NOT NULL THEN 'audiobook' ELSE 'unknown' END"""

# The whole refinement: copies out, identity from the raw key, text cleaned, labels added.
FACT_CTE = f"""
single AS (
  SELECT * EXCLUDE nth FROM (
    SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY {REST_ORDER}) AS nth FROM raw_with_copies
  ) WHERE nth = 1
),
identified AS (SELECT *, {digest_sql(KEYS)} AS play_id, {INSTANT} AS instant FROM single),
fact AS (
  SELECT * EXCLUDE (instant, {", ".join(TEXT_COLUMNS)}),
    {", ".join(f"{clean_sql(c)} AS {c}" for c in TEXT_COLUMNS)},
    epoch_us(instant) // 1000 AS start_ms,
    {LOCAL_FIELDS.format(t="instant")},
    {CONTENT} AS content_type,
    {country_case("conn_country")} AS country_name
  FROM identified
)
"""


def fact(spark, sf):
    return refine.refine(raw_with_copies(spark, sf), PER_LISTENER)


def _shown(df):
    """Identities as hexadecimal text."""
    binary = [c for c, t in df.dtypes if t == "binary"]
    return df.withColumns({c: F.hex(c) for c in binary})


def _dimension(extract):
    return lambda spark, sf: _shown(extract(fact(spark, sf)))


def _text(spark, sf, table, identity):
    rows = prepare_session(spark).read.parquet(f"{sf}/{table}.parquet")
    return rows.select(*identity, clean_text(F.col("text")).alias("clean"))


def _case(column: str, names: dict) -> str:
    return f"CASE {column}" + "".join(f" WHEN {k} THEN '{v}'" for k, v in names.items()) + " END"


def _on_fact(body: str) -> str:
    return on_raw(body, FACT_CTE)


def literal_labels(spark, sf):
    plays = history(spark, sf)
    return plays.select(
        "play_id",
        calendar.weekday_name(F.col("weekday")).alias("weekday_name"),
        calendar.month_label(F.col("month")).alias("month_label"),
    )


def week_labels(spark, sf):
    plays = history(spark, sf)
    date = F.col("year"), F.col("month"), F.col("day")
    return plays.select(
        "play_id",
        calendar.week_label(*date).alias("week"),
        calendar.week_label(*date, iso_year=True).alias("iso_week"),
    )


def units(spark, sf):
    plays, ms = history(spark, sf), F.col("ms_played")
    return plays.select(
        "play_id",
        rounding.hours(ms).alias("hours"),
        rounding.minutes(ms).alias("minutes"),
        rounding.percent(ms, F.lit(1_800_000)).alias("pct_of_half_hour"),
    )


def origins(spark, sf):
    reason = F.col("reason_start")
    return history(spark, sf).select(
        "play_id", labels.origin(reason).alias("origin"), labels.is_active(reason).alias("active")
    )


def parsed(spark, sf):
    return refine.with_calendar(raw(spark, sf), P.zone).select(
        "event_id", "ts", "start_ms", "year", "month", "day", "hour", "weekday"
    )


def enriched(spark, sf):
    """Country names joined back to a play table that was stored without them."""
    plays = fact(spark, sf)
    bare = plays.drop("country_name")
    joined = refine.enrich_country(bare, refine.dim_location(plays))
    return _shown(joined.select("play_id", "conn_country", "country_name"))


def guarded(spark, sf):
    """Addresses hashed, incognito plays left out."""
    plays = refine.without_incognito(refine.with_hashed_address(raw(spark, sf)))
    return plays.select("event_id", "ip_addr", "incognito_mode")


def _select(columns):
    return lambda spark, sf: history(spark, sf).select(*columns())


QUERIES = {
    "t1_drop_copies": lambda s, sf: refine.drop_copies(raw_with_copies(s, sf), KEYS),
    "t1_copy_counts": lambda s, sf: refine.copy_counts(raw_with_copies(s, sf), KEYS),
    "t2_clean_titles": lambda s, sf: refine.clean_text_columns(raw(s, sf), TEXT_COLUMNS).select("event_id", *TEXT_COLUMNS),
    "t2_clean_documents": lambda s, sf: _text(s, sf, "documents", ["doc_id"]),
    "t2_clean_conversations": lambda s, sf: _text(s, sf, "conversations", ["conv_id", "turn"]),
    "t3_local_calendar": parsed,
    "t4_content_type": lambda s, sf: refine.with_content_type(raw(s, sf)).select("event_id", "content_type"),
    "t5_country_name": lambda s, sf: refine.with_country_name(raw(s, sf)).select("event_id", "conn_country", "country_name"),
    "t6_play_id": lambda s, sf: _shown(refine.with_play_id(raw(s, sf), KEYS).select("event_id", "play_id")),
    "t7_literal_labels": literal_labels,
    "t8_day_part": _select(lambda: ["play_id", calendar.day_part(F.col("hour")).alias("day_part")]),
    "t9_origin": origins,
    "t10_complete": _select(lambda: ["play_id", labels.is_complete(F.col("ms_played"), P.complete_ms).alias("complete")]),
    "t11_units": units,
    "t12_week_label": week_labels,
    "t13_minute_bucket": _select(lambda: ["play_id", calendar.ten_minute_bucket(F.col("ms_played")).alias("minute_bucket")]),
    "t14_epoch_ms": lambda s, sf: refine.with_calendar(raw(s, sf), P.zone).select("event_id", "start_ms"),
    "t15_privacy": guarded,
    "d1_dim_time": _dimension(refine.dim_time),
    "d2_dim_art": _dimension(refine.dim_art),
    "d3_dim_location": _dimension(refine.dim_location),
    "d4_dim_user": _dimension(refine.dim_user),
    "d5_dim_playback": _dimension(refine.dim_playback),
    "d6_dim_keys": _dimension(refine.dim_keys),
    "d7_fact": lambda s, sf: _shown(fact(s, sf)),
    "j1_enrich_country": enriched,
}

DIM_ART = ["track_name", "artist_name", "album_name", "episode_name", "show_name", "audiobook_title",
           "chapter_title", "content_type"]
DIM_PLAYBACK = ["ms_played", "reason_end", "reason_start", "skipped", "shuffle", "offline", "incognito_mode"]

ORACLES = {
    "t1_drop_copies": on_raw(
        f"SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY {REST_ORDER}) AS nth "
        "FROM raw_with_copies) WHERE nth = 1"
    ),
    "t1_copy_counts": on_raw(
        "SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(n) AS BIGINT) - count(*) AS rows_removed "
        f"FROM (SELECT count(*) AS n FROM raw_with_copies GROUP BY {KEY_SQL})"
    ),
    "t2_clean_titles": on_raw(
        f"SELECT event_id, {', '.join(f'{clean_sql(c)} AS {c}' for c in TEXT_COLUMNS)} FROM raw"
    ),
    "t2_clean_documents": f"SELECT doc_id, {clean_sql('text')} AS clean FROM documents",
    "t2_clean_conversations": f"SELECT conv_id, turn, {clean_sql('text')} AS clean FROM conversations",
    "t3_local_calendar": on_raw(
        f"SELECT event_id, ts, epoch_us(i) // 1000 AS start_ms, {LOCAL_FIELDS.format(t='i')} "
        f"FROM (SELECT *, {INSTANT} AS i FROM raw)"
    ),
    "t4_content_type": on_raw(f"SELECT event_id, {CONTENT} AS content_type FROM raw"),
    "t5_country_name": on_raw(f"SELECT event_id, conn_country, {country_case('conn_country')} AS country_name FROM raw"),
    "t6_play_id": on_raw(f"SELECT event_id, {digest_sql(KEYS)} AS play_id FROM raw"),
    "t7_literal_labels": on_history(
        f"SELECT play_id, {_case('weekday', WEEKDAYS)} AS weekday_name, {_case('month', MONTHS)} AS month_label FROM history"
    ),
    "t8_day_part": on_history(
        "SELECT play_id, CASE WHEN hour BETWEEN 0 AND 5 THEN 'Madrugada (0-5h)' WHEN hour BETWEEN 6 AND 11 THEN 'Mañana (6-11h)' "
        "WHEN hour BETWEEN 12 AND 17 THEN 'Tarde (12-17h)' ELSE 'Noche (18-23h)' END AS day_part FROM history"
    ),
    "t9_origin": on_history(
        "SELECT play_id, CAST(CASE WHEN reason_start IN ('clickrow', 'playbtn', 'remote', 'backbtn') THEN 1 "
        "WHEN reason_start IN ('trackdone', 'autoplay', 'fwdbtn') THEN 0 END AS INTEGER) AS origin, "
        "CAST(CASE WHEN reason_start IN ('clickrow', 'playbtn', 'remote', 'backbtn') THEN 1 ELSE 0 END AS INTEGER) AS active FROM history"
    ),
    "t10_complete": on_history("SELECT play_id, CAST(ms_played >= 30000 AS INTEGER) AS complete FROM history"),
    "t11_units": on_history(
        f"SELECT play_id, {hours('ms_played')} AS hours, {minutes('ms_played')} AS minutes, "
        f"{percent('ms_played', '1800000')} AS pct_of_half_hour FROM history"
    ),
    "t12_week_label": on_history(
        "SELECT play_id, concat(CAST(year AS VARCHAR), '-W', lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0')) AS week, "
        "concat(CAST(isoyear(d) AS VARCHAR), '-W', lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0')) AS iso_week "
        "FROM (SELECT *, make_date(year, month, day) AS d FROM history)"
    ),
    "t13_minute_bucket": on_history(
        "SELECT play_id, CAST(ms_played // 600000 * 10 AS INTEGER) AS minute_bucket FROM history"
    ),
    "t14_epoch_ms": on_raw(f"SELECT event_id, epoch_us({INSTANT}) // 1000 AS start_ms FROM raw"),
    "t15_privacy": on_raw("SELECT event_id, sha256(ip_addr) AS ip_addr, incognito_mode FROM raw WHERE NOT incognito_mode"),
    "d1_dim_time": _on_fact(
        "SELECT min(play_id) AS time_id, year, month, day, hour, min(weekday) AS weekday FROM fact GROUP BY year, month, day, hour"
    ),
    "d2_dim_art": _on_fact(f"SELECT play_id AS art_id, {', '.join(DIM_ART)} FROM fact"),
    "d3_dim_location": _on_fact("SELECT play_id AS location_id, conn_country, country_name FROM fact"),
    "d4_dim_user": _on_fact("SELECT play_id AS user_id, ip_addr, platform FROM fact"),
    "d5_dim_playback": _on_fact(f"SELECT play_id AS playback_id, {', '.join(DIM_PLAYBACK)} FROM fact"),
    "d6_dim_keys": _on_fact("SELECT play_id AS key_id, chapter_uri, audiobook_uri, episode_uri, track_uri FROM fact"),
    "d7_fact": _on_fact("SELECT * FROM fact"),
    "j1_enrich_country": _on_fact("SELECT play_id, conn_country, country_name FROM fact"),
}
