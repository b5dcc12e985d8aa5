"""Hand-made plays for tests."""

RAW_COLUMNS = [
    ("ts", "string"), ("platform", "string"), ("ms_played", "bigint"), ("conn_country", "string"),
    ("ip_addr", "string"), ("track_name", "string"), ("artist_name", "string"), ("album_name", "string"),
    ("track_uri", "string"), ("episode_name", "string"), ("show_name", "string"), ("episode_uri", "string"),
    ("audiobook_title", "string"), ("audiobook_uri", "string"), ("chapter_uri", "string"),
    ("chapter_title", "string"), ("reason_start", "string"), ("reason_end", "string"),
    ("shuffle", "boolean"), ("skipped", "boolean"), ("offline", "boolean"),
    ("offline_timestamp", "string"), ("incognito_mode", "boolean"),
]

FACT_COLUMNS = [
    ("play_id", "bigint"), ("listener_id", "bigint"), ("start_ms", "bigint"), ("ms_played", "bigint"),
    ("content_type", "string"), ("track_name", "string"), ("artist_name", "string"), ("album_name", "string"),
    ("track_uri", "string"), ("show_name", "string"), ("audiobook_title", "string"),
    ("conn_country", "string"), ("country_name", "string"), ("reason_start", "string"),
    ("shuffle", "boolean"), ("skipped", "boolean"),
    ("year", "int"), ("month", "int"), ("day", "int"), ("hour", "int"), ("weekday", "int"),
]


def _frame(spark, columns, defaults, rows):
    values = [tuple({**defaults, **row}.get(name) for name, _ in columns) for row in rows]
    return spark.createDataFrame(values, ", ".join(f"{n} {t}" for n, t in columns))


def raw_plays(spark, *rows):
    return _frame(spark, RAW_COLUMNS, {"ts": "2023-01-01T00:00:00Z", "ms_played": 40_000}, rows)


def fact_plays(spark, *rows):
    defaults = {
        "content_type": "music", "track_name": "t", "artist_name": "a", "album_name": "b", "track_uri": "u",
        "conn_country": "MX", "country_name": "México", "ms_played": 40_000, "skipped": False, "shuffle": False,
        "year": 2023, "month": 1, "day": 1, "hour": 5, "weekday": 1, "start_ms": 0,
    }
    return _frame(spark, FACT_COLUMNS, defaults, [{"play_id": i, **row} for i, row in enumerate(rows)])
