"""Activity marts (G), session scan (W) and the mart runner."""

from pyspark.sql import functions as F

from contract.tables import (
    half_even,
    WEEKDAYS,
    WITH_GAPS,
    history,
    history_with_gaps,
    hours,
    minutes,
    on_history,
    percent,
)
from hearlog.operators import marts, sequence, session_store
from hearlog.params import Params
from hearlog.plans.layers import build_marts, marts_from_cubes
from hearlog.session import durable

P = Params()
PER_LISTENER = Params(listener_keys=("listener_id",))


def _of(mart, *args):
    return lambda spark, sf: mart(history(spark, sf), *args)


def _unordered_day_part(hour: str) -> str:
    return (f"CASE WHEN {hour} BETWEEN 0 AND 5 THEN 'Madrugada (0-5h)' WHEN {hour} BETWEEN 6 AND 11 THEN 'Mañana (6-11h)' "
            f"WHEN {hour} BETWEEN 12 AND 17 THEN 'Tarde (12-17h)' ELSE 'Noche (18-23h)' END")


WEEKDAY_CASE = "CASE weekday" + "".join(f" WHEN {k} THEN '{v}'" for k, v in WEEKDAYS.items()) + " END"
ACTIVITY = f"count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms_total, {hours('sum(ms_played)')} AS hours"
SKIPS = "CAST(sum(CAST(skipped AS BIGINT)) AS BIGINT) AS skips, count(*) AS plays"
SKIP_PCT = f"{percent('sum(CAST(skipped AS BIGINT))', 'count(*)')} AS skip_pct"

G04 = f"""
SELECT track_name, artist_name, album_name, count(*) AS complete_plays,
  CAST(sum(ms_played) AS BIGINT) AS ms_total, {minutes('sum(ms_played)')} AS minutes
FROM history WHERE content_type = 'music' AND ms_played >= 30000 AND skipped = false
GROUP BY ALL
ORDER BY complete_plays DESC, ms_total DESC, track_name NULLS FIRST, artist_name NULLS FIRST, album_name NULLS FIRST
LIMIT 50
"""

G08 = f"""
SELECT artist_name, count(*) AS plays, CAST(sum(CAST(ms_played >= 30000 AS BIGINT)) AS BIGINT) AS complete_plays,
  CAST(sum(ms_played) AS BIGINT) AS ms_total, {hours('sum(ms_played)')} AS hours
FROM history WHERE content_type = 'music' GROUP BY artist_name
ORDER BY plays DESC, ms_total DESC, artist_name NULLS FIRST LIMIT 30
"""

G11 = """
ranked AS (
  SELECT conn_country, country_name, track_name, artist_name, count(*) AS plays,
    CAST(rank() OVER (PARTITION BY conn_country ORDER BY count(*) DESC) AS INTEGER) AS rank
  FROM history WHERE content_type = 'music' GROUP BY conn_country, country_name, track_name, artist_name
),
by_country AS (SELECT * FROM ranked WHERE rank <= 10)
"""


def session_ctes(end: str = "start_ms + ms_played", keys: str = "", source: str = "history") -> str:
    """Session numbers by a plain window over the whole order."""
    over = (f"PARTITION BY {keys} " if keys else "") + "ORDER BY start_ms NULLS FIRST, play_id"
    return f"""
gaps AS (
  SELECT *, start_ms - lag({end}) OVER ({over}) AS gap FROM {source}
),
sessions AS (
  SELECT * EXCLUDE gap, CAST(sum(CASE WHEN gap IS NULL OR gap > 1800000 THEN 1 ELSE 0 END)
    OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_id
  FROM gaps
)
"""


def detail_cte(keys: str = "", gaps: bool = False) -> str:
    columns = f"{keys}, session_id" if keys else "session_id"
    source = "history_with_gaps" if gaps else "history"
    return (WITH_GAPS + "," if gaps else "") + session_ctes(keys=keys, source=source) + f""",
detail AS (
  SELECT {columns}, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms_total,
    {minutes('sum(ms_played)')} AS minutes
  FROM sessions GROUP BY {columns}
)
"""


STATS = """
SELECT count(*) AS sessions,
  CAST(sum(CAST(round(minutes * 10) AS BIGINT)) AS BIGINT) / count(minutes) / 10 AS mean_minutes,
  CAST(sum(plays) AS BIGINT) / count(*) AS mean_plays, max(minutes) AS longest_minutes
FROM detail
"""

G10 = f"""
months AS (SELECT year, month, {hours('sum(ms_played)')} AS h FROM history GROUP BY year, month),
plan AS (
  SELECT {half_even('CAST(sum(CAST(round(h * 100) AS BIGINT)) AS BIGINT) / count(h)', 0)} / 100 AS mean_hours_per_month,
    count(*) AS active_months, CAST(99 AS DOUBLE) AS monthly_price, CAST(990 AS DOUBLE) AS annual_price,
    CAST(1188 AS DOUBLE) AS monthly_price_x12, CAST(198 AS DOUBLE) AS annual_saving,
    CASE WHEN count(*) >= 10 THEN 'anual' ELSE 'mensual' END AS recommended_plan
  FROM months
)
"""


def _long(kind: str, title: str, n: int) -> str:
    return on_history(
        f"SELECT {title}, {ACTIVITY} FROM history WHERE content_type = '{kind}' GROUP BY {title} "
        f"ORDER BY ms_total DESC, {title} NULLS FIRST LIMIT {n}"
    )


def _session_ids(params):
    def query(spark, sf):
        columns = [*params.listener_keys, "play_id", "start_ms", "ms_played"]
        plays = sequence.play_sessions(history_with_gaps(spark, sf).select(*columns), params)
        return plays.select(*params.listener_keys, "play_id", "session_id")

    return query


def _music_context(*columns):
    return lambda spark, sf: sequence.skip_context(history(spark, sf), PER_LISTENER).select("play_id", *columns)


TOTALS = ["plays", "ms_total", "skips", "complete_plays"]


def mart_digest(spark, sf):
    """Totals of every mart of the runner, one per listener, from the shared pre-aggregates: rows, and where
    it has them plays, played time, skips and complete plays."""
    parts = []
    for name, df in build_marts(history(spark, sf), PER_LISTENER).items():
        sums = [(F.sum(c) if c in df.columns else F.lit(None)).cast("bigint").alias(c) for c in TOTALS]
        parts.append(df.agg(F.count("*").alias("table_rows"), *sums).select(F.lit(name).alias("mart"), "table_rows", *TOTALS))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _first(body: str, n: int, order: str) -> str:
    """The first n rows of each listener."""
    return f"SELECT * FROM ({body}) QUALIFY row_number() OVER (PARTITION BY listener_id ORDER BY {order}) <= {n}"


def _own(key: str, where: str = "") -> str:
    return f"SELECT listener_id, {key}, {ACTIVITY} FROM history {where} GROUP BY ALL"


MUSIC = "WHERE content_type = 'music'"
OF_LISTENER = {
    "time_per_year": _own("year"),
    "content_mix": f"SELECT *, {percent('plays', 'sum(plays) OVER (PARTITION BY listener_id)')} AS plays_pct FROM ({_own('content_type')})",
    "skip_rate": f"SELECT listener_id, {SKIPS}, {SKIP_PCT} FROM history {MUSIC} GROUP BY listener_id",
    "skip_rate_by_artist": f"SELECT listener_id, artist_name, {SKIPS}, {SKIP_PCT} FROM history {MUSIC} GROUP BY ALL HAVING count(*) >= 5",
    "complete_tracks": _first(
        "SELECT listener_id, track_name, artist_name, album_name, count(*) AS complete_plays, CAST(sum(ms_played) AS BIGINT) AS ms_total, "
        f"{minutes('sum(ms_played)')} AS minutes FROM history {MUSIC} AND ms_played >= 30000 AND skipped = false GROUP BY ALL",
        50, "complete_plays DESC, ms_total DESC, track_name NULLS FIRST, artist_name NULLS FIRST, album_name NULLS FIRST"),
    "activity_by_hour": _own("hour"),
    "activity_by_month": _own("year, month"),
    "activity_by_weekday": f"SELECT *, {WEEKDAY_CASE} AS weekday_name FROM ({_own('weekday')})",
    "top_artists": _first(
        "SELECT listener_id, artist_name, count(*) AS plays, CAST(sum(CAST(ms_played >= 30000 AS BIGINT)) AS BIGINT) AS complete_plays, "
        f"CAST(sum(ms_played) AS BIGINT) AS ms_total, {hours('sum(ms_played)')} AS hours FROM history {MUSIC} GROUP BY listener_id, artist_name",
        30, "plays DESC, ms_total DESC, artist_name NULLS FIRST"),
    "plan_recommendation": f"""
      SELECT listener_id, {half_even('CAST(sum(CAST(round(h * 100) AS BIGINT)) AS BIGINT) / count(h)', 0)} / 100 AS mean_hours_per_month,
        count(*) AS active_months, CAST(99 AS DOUBLE) AS monthly_price, CAST(990 AS DOUBLE) AS annual_price,
        CAST(1188 AS DOUBLE) AS monthly_price_x12, CAST(198 AS DOUBLE) AS annual_saving,
        CASE WHEN count(*) >= 10 THEN 'anual' ELSE 'mensual' END AS recommended_plan
      FROM (SELECT listener_id, year, month, {hours('sum(ms_played)')} AS h FROM history GROUP BY ALL) GROUP BY listener_id""",
    "top_tracks_by_country": f"""
      SELECT * FROM (SELECT listener_id, conn_country, country_name, track_name, artist_name, count(*) AS plays,
        CAST(rank() OVER (PARTITION BY listener_id, conn_country ORDER BY count(*) DESC) AS INTEGER) AS rank
        FROM history {MUSIC} GROUP BY listener_id, conn_country, country_name, track_name, artist_name) WHERE rank <= 10""",
    "day_part_mix": f"SELECT listener_id, {_unordered_day_part('hour')} AS day_part, content_type, {ACTIVITY} FROM history GROUP BY ALL",
    "daily_average": "SELECT listener_id, CAST(sum(n) AS BIGINT) / count(*) AS mean_plays_per_day, CAST(sum(n) AS BIGINT) AS plays, "
        "count(*) AS active_days FROM (SELECT listener_id, count(*) AS n FROM history GROUP BY listener_id, year, month, day) GROUP BY listener_id",
    "top_shows": _first(_own("show_name", "WHERE content_type = 'podcast'"), 20, "ms_total DESC, show_name NULLS FIRST"),
    "top_audiobooks": _first(_own("audiobook_title", "WHERE content_type = 'audiobook'"), 10, "ms_total DESC, audiobook_title NULLS FIRST"),
    "session_stats": STATS.replace("SELECT count(*)", "SELECT listener_id, count(*)") + " GROUP BY listener_id",
}


def _digest_sql() -> str:
    def part(name: str, body: str, totals: str) -> str:
        sums = ", ".join(
            f"CAST({f'sum({c})' if c in totals.split() else 'NULL'} AS BIGINT) AS {c}" for c in TOTALS
        )
        return f"SELECT '{name}' AS mart, count(*) AS table_rows, {sums} FROM ({body})"

    complete = "sum(CASE WHEN ms_played >= 30000 THEN 1 WHEN ms_played IS NOT NULL THEN 0 END) AS complete_plays"
    cube = "SELECT {k}, count(*) AS plays, sum(ms_played) AS ms_total, sum(CAST(skipped AS BIGINT)) AS skips, " + complete + " FROM history GROUP BY {k}"
    hour = "listener_id, year, month, day, hour, weekday, content_type"
    titles = "listener_id, content_type, conn_country, country_name, track_name, artist_name, album_name, show_name, audiobook_title"
    own = {
        "skip_rate": "plays skips", "skip_rate_by_artist": "plays skips", "complete_tracks": "ms_total complete_plays",
        "top_artists": "plays ms_total complete_plays", "plan_recommendation": "", "top_tracks_by_country": "plays",
        "daily_average": "plays", "session_stats": "",
    }
    parts = [
        part("calendar_cube", cube.format(k=hour), "plays ms_total"),
        part("catalogue_cube", cube.format(k=titles), " ".join(TOTALS)),
        part("session_detail", "SELECT * FROM detail", "plays ms_total"),
        *[part(name, body, own.get(name, "plays ms_total")) for name, body in OF_LISTENER.items()],
    ]
    return on_history("\nUNION ALL ".join(parts), detail_cte("listener_id"))


def _mart_of_listeners(name: str):
    """A mart of the runner, one per listener."""
    def query(spark, sf):
        fact = history(spark, sf)
        if name == "session_stats":
            return marts.session_stats(marts.session_detail(fact, PER_LISTENER), PER_LISTENER)
        cubes = marts.calendar_cube(fact, PER_LISTENER), marts.catalogue_cube(fact, PER_LISTENER)
        return marts_from_cubes(*cubes, PER_LISTENER)[name]

    return query


NUMBERS = dict(zip(OF_LISTENER, (
    "g01", "g02", "g03a", "g03b", "g04", "g05", "g06", "g07", "g08", "g10", "g11", "g12", "g13", "g14", "g15", "g09b"
), strict=True))


def _sessions_in_batches(params):
    """Sessions of a third of the plays, with the other thirds merged in one after the other."""

    def query(spark, sf):
        plays = history_with_gaps(spark, sf)
        stored = session_store.sessions_of(plays.where("play_id % 3 = 1"), params)
        for turn in (2, 0):
            so_far = plays.where("play_id % 3 = 1" if turn == 2 else "play_id % 3 > 0")
            stored = durable(session_store.merged(durable(stored), so_far, plays.where(f"play_id % 3 = {turn}"), params))
        return session_store.session_detail(stored, params)

    return query


QUERIES = {
    "g09a_sessions_in_batches": _sessions_in_batches(P),
    "g09a_sessions_in_batches_per_listener": _sessions_in_batches(PER_LISTENER),
    "g01_time_per_year": _of(marts.time_per_year),
    "g02_content_mix": _of(marts.content_mix),
    "g03a_skip_rate": _of(marts.skip_rate),
    "g03b_skip_rate_by_artist": _of(marts.skip_rate_by_artist),
    "g04_complete_tracks": _of(marts.complete_tracks),
    "g05_activity_by_hour": _of(marts.activity_by_hour),
    "g06_activity_by_month": _of(marts.activity_by_month),
    "g07_activity_by_weekday": _of(marts.activity_by_weekday),
    "g08_top_artists": _of(marts.top_artists),
    "g09a_session_detail": lambda s, sf: marts.session_detail(history_with_gaps(s, sf)),
    "g09a_session_detail_per_listener": lambda s, sf: marts.session_detail(history_with_gaps(s, sf), PER_LISTENER),
    "g09b_session_stats": lambda s, sf: marts.session_stats(marts.session_detail(history_with_gaps(s, sf))),
    "g09b_session_stats_per_listener":
        lambda s, sf: marts.session_stats(marts.session_detail(history_with_gaps(s, sf), PER_LISTENER)),
    "g10_plan_recommendation": _of(marts.plan_recommendation),
    "g11_top_tracks_by_country": _of(marts.top_tracks_by_country),
    "g12_day_part_mix": _of(marts.day_part_mix),
    "g13_daily_average": _of(marts.daily_average),
    "g14_top_shows": _of(marts.top_shows),
    "g15_top_audiobooks": _of(marts.top_audiobooks),
    **{f"{number}_{name}_of_each_listener": _mart_of_listeners(name) for name, number in NUMBERS.items()},
    "g16_all_marts": mart_digest,
    "w1_session_ids": _session_ids(P),
    "w1_session_ids_per_listener": _session_ids(PER_LISTENER),
    "w2_rank_per_group": lambda s, sf: marts.top_tracks_by_country(history(s, sf), Params(top_country_rank=3)),
    "w3_start_gap_sessions": _music_context("session_id"),
    "w4_position_in_session": _music_context("session_id", "position"),
    "w5_played_before": _music_context("ms_before"),
    "w6_skips_before": _music_context("skips_before"),
    "w6_skip_streak": _music_context("skip_streak"),
}

MUSIC_CONTEXT = """
music AS (
  SELECT *, CASE WHEN skipped THEN 1 ELSE 0 END AS skip, CASE WHEN shuffle THEN 1 ELSE 0 END AS shuffle_on,
    CASE WHEN reason_start IN ('clickrow', 'playbtn', 'remote', 'backbtn') THEN 1 ELSE 0 END AS active
  FROM history WHERE content_type = 'music' AND ms_played IS NOT NULL AND hour IS NOT NULL AND weekday IS NOT NULL
),
""" + session_ctes(end="start_ms", keys="listener_id", source="music") + """,
unbroken AS (
  SELECT *, sum(1 - skip) OVER (PARTITION BY listener_id, session_id ORDER BY start_ms, play_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS breaks FROM sessions
),
context AS (
  SELECT *,
    CAST(row_number() OVER w - 1 AS BIGINT) AS position,
    CAST(row_number() OVER (PARTITION BY listener_id, session_id, coalesce(breaks, 0) ORDER BY start_ms, play_id) - 1
      AS BIGINT) AS skip_streak,
    CAST(coalesce(sum(ms_played) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ms_before,
    CAST(coalesce(sum(skip) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS skips_before
  FROM unbroken
  WINDOW w AS (PARTITION BY listener_id, session_id ORDER BY start_ms, play_id)
),
skip_context AS (
  SELECT *, ms_before / 60000 AS minutes_before, CAST(floor(ms_before / 600000) * 10 AS INTEGER) AS minute_bucket
  FROM context
)
"""

ORACLES = {
    "g01_time_per_year": on_history(f"SELECT year, {ACTIVITY} FROM history GROUP BY year ORDER BY year"),
    "g02_content_mix": on_history(
        f"SELECT content_type, {ACTIVITY}, {percent('count(*)', 'sum(count(*)) OVER ()')} AS plays_pct "
        "FROM history GROUP BY content_type"
    ),
    "g03a_skip_rate": on_history(f"SELECT {SKIPS}, {SKIP_PCT} FROM history WHERE content_type = 'music'"),
    "g03b_skip_rate_by_artist": on_history(
        f"SELECT artist_name, {SKIPS}, {SKIP_PCT} FROM history WHERE content_type = 'music' "
        "GROUP BY artist_name HAVING count(*) >= 5"
    ),
    "g04_complete_tracks": on_history(G04),
    "g05_activity_by_hour": on_history(f"SELECT hour, {ACTIVITY} FROM history GROUP BY hour"),
    "g06_activity_by_month": on_history(f"SELECT year, month, {ACTIVITY} FROM history GROUP BY year, month"),
    "g07_activity_by_weekday": on_history(
        f"SELECT weekday, {ACTIVITY}, {WEEKDAY_CASE} AS weekday_name FROM history GROUP BY weekday"
    ),
    "g08_top_artists": on_history(G08),
    "g09a_sessions_in_batches": on_history("SELECT * FROM detail", detail_cte(gaps=True)),
    "g09a_sessions_in_batches_per_listener": on_history("SELECT * FROM detail", detail_cte("listener_id", gaps=True)),
    "g09a_session_detail": on_history("SELECT * FROM detail", detail_cte(gaps=True)),
    "g09a_session_detail_per_listener": on_history("SELECT * FROM detail", detail_cte("listener_id", gaps=True)),
    "g09b_session_stats": on_history(STATS, detail_cte(gaps=True)),
    "g09b_session_stats_per_listener": on_history(STATS, detail_cte("listener_id", gaps=True)),
    "g10_plan_recommendation": on_history("SELECT * FROM plan", G10),
    "g11_top_tracks_by_country": on_history("SELECT * FROM by_country", G11),
    "g12_day_part_mix": on_history(
        f"SELECT {_unordered_day_part('hour')} AS day_part, content_type, {ACTIVITY} FROM history GROUP BY 1, 2"
    ),
    "g13_daily_average": on_history(
        "SELECT CAST(sum(n) AS BIGINT) / count(*) AS mean_plays_per_day, CAST(sum(n) AS BIGINT) AS plays, "
        "count(*) AS active_days FROM (SELECT count(*) AS n FROM history GROUP BY year, month, day)"
    ),
    "g14_top_shows": _long("podcast", "show_name", 20),
    "g15_top_audiobooks": _long("audiobook", "audiobook_title", 10),
    **{
        f"{number}_{name}_of_each_listener": on_history(OF_LISTENER[name], detail_cte("listener_id"))
        for name, number in NUMBERS.items()
    },
    "g16_all_marts": _digest_sql(),
    "w1_session_ids": on_history(
        "SELECT play_id, session_id FROM sessions", WITH_GAPS + "," + session_ctes(source="history_with_gaps")
    ),
    "w1_session_ids_per_listener": on_history(
        "SELECT listener_id, play_id, session_id FROM sessions",
        WITH_GAPS + "," + session_ctes(keys="listener_id", source="history_with_gaps")
    ),
    "w2_rank_per_group": on_history("SELECT * FROM ranked WHERE rank <= 3", G11),
    "w3_start_gap_sessions": on_history("SELECT play_id, session_id FROM skip_context", MUSIC_CONTEXT),
    "w4_position_in_session": on_history("SELECT play_id, session_id, position FROM skip_context", MUSIC_CONTEXT),
    "w5_played_before": on_history("SELECT play_id, ms_before FROM skip_context", MUSIC_CONTEXT),
    "w6_skips_before": on_history("SELECT play_id, skips_before FROM skip_context", MUSIC_CONTEXT),
    "w6_skip_streak": on_history("SELECT play_id, skip_streak FROM skip_context", MUSIC_CONTEXT),
}
