"""The driver's ``events`` seen as listening history, in Spark and in DuckDB.

The tables hold no play history, so each event is mapped to one play by rule. The same
text runs in both engines; only the placeholders differ.
"""

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearlog.functions import labels
from hearlog.functions.calendar import calendar_fields
from hearlog.session import delete_at_exit, prepare_session

ZONE = "America/Mexico_City"

# Events cover one month; by blocks of 1,000 they are moved back over six years, so that
# summer time before its end in 2022, the turn of a year and ten months are reached.
DAYS_BACK = "CAST((event_id % 10000 - event_id % 1000) / 1000 AS BIGINT) * 222"
SPARK = {
    "MOVED": f"timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) - {DAYS_BACK} * 86400000000)",
    "EPOCH_MS": "unix_millis(CAST(ts AS TIMESTAMP))",
    "TS_TEXT": "date_format(CAST(ts AS TIMESTAMP), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
}
DUCKDB = {
    "MOVED": f"make_timestamp(epoch_us(ts) - {DAYS_BACK} * 86400000000)",
    "EPOCH_MS": "epoch_us(ts) // 1000",
    "TS_TEXT": "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')",
}

EVENTS = "(SELECT event_id, user_id, event_type, value, {MOVED} AS ts FROM events)"
MS = "CAST(round(value * 100) AS BIGINT) * 10"
MUSIC = "event_type NOT IN ('signup', 'error')"
TRACK = "CAST((event_id * 7919) % 211 AS VARCHAR(10))"

COUNTRY = """CASE event_id % 9 WHEN 0 THEN 'US' WHEN 1 THEN 'ES' WHEN 2 THEN 'CO' WHEN 3 THEN 'AR'
    WHEN 4 THEN 'ZZ' ELSE 'MX' END"""
REASON_START = """CASE (event_id * 13) % 8 WHEN 0 THEN 'trackdone' WHEN 1 THEN 'fwdbtn' WHEN 2 THEN 'backbtn'
    WHEN 3 THEN 'clickrow' WHEN 4 THEN 'playbtn' WHEN 5 THEN 'remote' WHEN 6 THEN 'autoplay' END"""

# A play table: one play per event, without calendar fields.
HISTORY = f"""
SELECT
  event_id AS play_id,
  ts,
  user_id AS listener_id,
  {{EPOCH_MS}} AS start_ms,
  {MS} AS ms_played,
  CASE event_type WHEN 'signup' THEN 'podcast' WHEN 'error' THEN 'audiobook' ELSE 'music' END AS content_type,
  CASE WHEN {MUSIC} THEN concat('track_', {TRACK}) END AS track_name,
  CASE WHEN {MUSIC} AND event_id % 29 <> 0
       THEN concat('artist_', CAST(((event_id * 7919) % 211) % 37 AS VARCHAR(10))) END AS artist_name,
  CASE WHEN {MUSIC} THEN concat('album_', CAST(((event_id * 7919) % 211) % 73 AS VARCHAR(10))) END AS album_name,
  CASE WHEN {MUSIC} THEN concat('spotify:track:', {TRACK}) END AS track_uri,
  CASE WHEN event_type = 'signup' THEN concat('show_', CAST(event_id % 31 AS VARCHAR(10))) END AS show_name,
  CASE WHEN event_type = 'error' THEN concat('book_', CAST(event_id % 17 AS VARCHAR(10))) END AS audiobook_title,
  {COUNTRY} AS conn_country,
  {REASON_START} AS reason_start,
  event_id % 5 < 2 AS shuffle,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE event_type = 'click' OR {MS} < 5000 END AS skipped
FROM {EVENTS}
"""

# Raw records as an export holds them, under the play table's column names.
RAW = f"""
SELECT
  event_id,
  user_id AS listener_id,
  CASE WHEN event_id % 97 = 0 THEN 'not a time' WHEN event_id % 89 = 0 THEN NULL ELSE {{TS_TEXT}} END AS ts,
  CASE event_id % 4 WHEN 0 THEN 'Android 🎧' WHEN 1 THEN '  iOS ★ ' WHEN 2 THEN '🎵' ELSE 'web_player' END AS platform,
  {MS} AS ms_played,
  {COUNTRY} AS conn_country,
  concat('189.', CAST(user_id % 256 AS VARCHAR(10)), '.0.1') AS ip_addr,
  CASE WHEN {MUSIC} THEN concat('track_', {TRACK}, CASE WHEN event_id % 6 = 0 THEN ' ♫' ELSE '' END) END AS track_name,
  CASE WHEN {MUSIC} AND event_id % 29 <> 0
       THEN concat('artist_', CAST(((event_id * 7919) % 211) % 37 AS VARCHAR(10))) END AS artist_name,
  CASE WHEN {MUSIC} THEN concat('album_', CAST(((event_id * 7919) % 211) % 73 AS VARCHAR(10))) END AS album_name,
  CASE WHEN {MUSIC} AND event_id % 53 <> 0 THEN concat('spotify:track:', {TRACK}) END AS track_uri,
  CASE WHEN event_type = 'signup' THEN concat('episode_', CAST(event_id % 101 AS VARCHAR(10))) END AS episode_name,
  CASE WHEN event_type = 'signup' THEN concat('show_', CAST(event_id % 31 AS VARCHAR(10))) END AS show_name,
  CASE WHEN event_type = 'signup' THEN concat('spotify:episode:', CAST(event_id % 101 AS VARCHAR(10))) END AS episode_uri,
  CASE WHEN event_type = 'error' THEN concat('book_', CAST(event_id % 17 AS VARCHAR(10))) END AS audiobook_title,
  CASE WHEN event_type = 'error' THEN concat('spotify:audiobook:', CAST(event_id % 17 AS VARCHAR(10))) END AS audiobook_uri,
  CASE WHEN event_type = 'error' THEN concat('spotify:audiobook_chapter:', CAST(event_id % 67 AS VARCHAR(10))) END AS chapter_uri,
  CASE WHEN event_type = 'error' THEN concat('chapter_', CAST(event_id % 67 AS VARCHAR(10))) END AS chapter_title,
  {REASON_START} AS reason_start,
  CASE event_id % 6 WHEN 0 THEN 'trackdone' WHEN 1 THEN 'fwdbtn' WHEN 2 THEN 'backbtn' WHEN 3 THEN 'endplay'
    WHEN 4 THEN 'logout' ELSE 'remote' END AS reason_end,
  event_id % 5 < 2 AS shuffle,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE event_type = 'click' OR {MS} < 5000 END AS skipped,
  event_id % 4 = 0 AS offline,
  CAST(NULL AS VARCHAR(10)) AS offline_timestamp,
  event_id % 7 = 0 AS incognito_mode
FROM {EVENTS}
"""

# Summer time in Mexico City, in UTC: from the first Sunday of April to the last of October,
# for the last time in 2022.
SUMMERS = [("2018-04-01", "2018-10-28"), ("2019-04-07", "2019-10-27"), ("2020-04-05", "2020-10-25"),
           ("2021-04-04", "2021-10-31"), ("2022-04-03", "2022-10-30")]
IN_SUMMER = " OR ".join(
    f"({{t}} >= TIMESTAMP '{first} 08:00:00' AND {{t}} < TIMESTAMP '{last} 07:00:00')" for first, last in SUMMERS
)
LOCAL = f"({{t}} - to_hours(CASE WHEN {IN_SUMMER} THEN 5 ELSE 6 END))"
LOCAL_FIELDS = f"""
  CAST(year({LOCAL}) AS INTEGER) AS year,
  CAST(month({LOCAL}) AS INTEGER) AS month,
  CAST(day({LOCAL}) AS INTEGER) AS day,
  CAST(hour({LOCAL}) AS INTEGER) AS hour,
  CAST(dayofweek({LOCAL}) + 1 AS INTEGER) AS weekday
"""


def _sql_names(names: dict) -> str:
    return "\n".join(f"    WHEN '{k}' THEN '{v}'" for k, v in names.items())


# The oracles state the labels they need themselves, so a wrong label in the library shows.
COUNTRIES = {"US": "Estados Unidos", "ES": "España", "CO": "Colombia", "AR": "Argentina", "MX": "México"}
WEEKDAYS = {1: "Domingo", 2: "Lunes", 3: "Martes", 4: "Miércoles", 5: "Jueves", 6: "Viernes", 7: "Sábado"}
MONTHS = {1: "Ene", 2: "Feb", 3: "Mar", 4: "Abr", 5: "May", 6: "Jun", 7: "Jul", 8: "Ago", 9: "Sep", 10: "Oct", 11: "Nov", 12: "Dic"}


def country_case(column: str) -> str:
    return f"CASE {column}\n{_sql_names(COUNTRIES)}\n    ELSE 'Desconocido' END"


def with_shared_folder(spark: SparkSession) -> None:
    """A local session that names no shared folder gets one, for as long as it lives."""
    context = spark.sparkContext
    if context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return
    if context.master == "local" or context.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="hearlog-checkpoint-")
        context.setCheckpointDir(folder)
        delete_at_exit(spark, folder)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_shared_folder(spark)
    return prepare_session(spark).read.parquet(f"{sf_dir}/events.parquet")


def select_from(spark: SparkSession, text: str, table: str, df: DataFrame) -> DataFrame:
    """Run ``text`` with ``df`` as its table; other braces in it are plain text."""
    escaped = text.replace("{", "{{").replace("}", "}}")
    return spark.sql(escaped.replace(f"FROM {table}", "FROM {source}"), source=df)


def events_as(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for name, expression in SPARK.items():
        text = text.replace("{%s}" % name, expression)
    return select_from(spark, text, "events", _events(spark, sf_dir))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The play table, with calendar fields and country name by the library's rules."""
    plays = events_as(spark, sf_dir, HISTORY)
    fields = calendar_fields(F.col("ts").cast("timestamp"), ZONE)
    return plays.withColumns(fields | {"country_name": labels.country_name(F.col("conn_country"))})


def history_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The play table where some plays have no time, and some no length."""
    return history(spark, sf_dir).withColumns({
        "start_ms": F.when(F.col("play_id") % 83 != 0, F.col("start_ms")),
        "ms_played": F.when(F.col("play_id") % 71 != 0, F.col("ms_played")),
    })


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as(spark, sf_dir, RAW)


def raw_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record one to three times, the copies on different platforms."""
    copies = raw(spark, sf_dir).withColumn("copy", F.explode(F.expr("sequence(0, event_id % 3)")))
    return copies.withColumn(
        "platform", F.concat("platform", F.lit("_"), F.col("copy").cast("string"))
    ).drop("copy", "event_id")


def for_duckdb(text: str) -> str:
    for name, expression in DUCKDB.items():
        text = text.replace("{%s}" % name, expression)
    return text


HISTORY_CTE = f"""
plain_history AS ({for_duckdb(HISTORY)}),
history AS (
  SELECT *, {LOCAL_FIELDS.format(t="ts")},
  {country_case("conn_country")} AS country_name
  FROM plain_history
)
"""

RAW_CTE = f"""
raw AS ({for_duckdb(RAW)}),
raw_with_copies AS (
  SELECT * EXCLUDE (event_id, platform, copy), concat(platform, '_', CAST(copy AS VARCHAR)) AS platform
  FROM (SELECT *, unnest(generate_series(0, event_id % 3)) AS copy FROM raw)
)
"""


WITH_GAPS = """
history_with_gaps AS (
  SELECT * REPLACE (CASE WHEN play_id % 83 <> 0 THEN start_ms END AS start_ms, CASE WHEN play_id % 71 <> 0 THEN ms_played END AS ms_played)
  FROM history
)
"""


def on_history(body: str, more: str = "") -> str:
    """An oracle over the play table; ``more`` holds further common table expressions."""
    return f"WITH {HISTORY_CTE}{',' + more if more else ''}\n{body}"


def on_raw(body: str, more: str = "") -> str:
    return f"WITH {RAW_CTE}{',' + more if more else ''}\n{body}"


def half_up(expression: str, digits: int) -> str:
    """Rounding of a double's decimal reading, half away from zero."""
    reading = f"CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38, 20))"
    return f"CAST(round({reading}, {digits}) AS DOUBLE)"


def half_even(expression: str, digits: int) -> str:
    if digits == 0:
        return f"round_even(CAST({expression} AS DOUBLE), 0)"
    return f"round_even(({expression}) * {10**digits}, 0) / {10**digits}"


def hours(ms: str) -> str:
    return half_up(f"{ms} / 3600000", 2)


def minutes(ms: str) -> str:
    return half_up(f"{ms} / 60000", 1)


def percent(part: str, whole: str) -> str:
    return half_up(f"({part} / {whole} * 100)", 2)
