"""Sources and sinks (S): export files assembled from the events, and stored tables."""

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from contract.refine import FACT_CTE, fact
from contract.tables import (
    COUNTRY,
    MS,
    MUSIC,
    TRACK,
    events_as,
    for_duckdb,
    history,
    hours,
    on_history,
    on_raw,
    select_from,
)
from hearlog.operators import marts
from hearlog.session import delete_at_exit, durable, shared_folder
from hearlog.sources import landing, tables
from hearlog.sources.split import split_records

# One export record as JSON text. Some values are of the wrong kind on purpose.
RECORDS = f"""
SELECT event_id, {{CHUNK}} AS chunk,
  concat('{{', CASE WHEN event_id % 61 = 0 THEN '"ts":"written twice",' ELSE '' END, '"ts":"', {{TS_TEXT}},
    '","ms_played":', CASE WHEN event_id % 43 = 0 THEN '"bad"' ELSE CAST({MS} AS VARCHAR(20)) END,
    ',"conn_country":"', {COUNTRY},
    '","master_metadata_track_name":', CASE WHEN {MUSIC} THEN concat('"track_', {TRACK}, '"') ELSE 'null' END,
    ',"spotify_track_uri":', CASE WHEN {MUSIC} THEN concat('"spotify:track:', {TRACK}, '"') ELSE 'null' END,
    ',"episode_name":', CASE WHEN event_type = 'signup' THEN concat('"episode_', CAST(event_id % 101 AS VARCHAR(10)), '"') ELSE 'null' END,
    ',"shuffle":', CASE WHEN event_id % 5 < 2 THEN 'true' ELSE 'false' END,
    ',"skipped":', CASE WHEN event_id % 41 = 0 THEN 'null' WHEN event_type = 'click' THEN 'true' ELSE 'false' END,
    ',"score":', CAST(event_id % 10 AS VARCHAR(10)), '.5',
    ',"tags":[', CAST(event_id % 3 AS VARCHAR(10)), ']',
    ',"device":{{"os":"a"}}',
    '}}') AS record,
  {{TS_TEXT}} AS ts,
  CASE WHEN event_id % 43 <> 0 THEN {MS} END AS ms_played,
  {COUNTRY} AS conn_country,
  CASE WHEN {MUSIC} THEN concat('track_', {TRACK}) END AS track_name,
  CASE WHEN {MUSIC} THEN concat('spotify:track:', {TRACK}) END AS track_uri,
  CASE WHEN event_type = 'signup' THEN concat('episode_', CAST(event_id % 101 AS VARCHAR(10))) END AS episode_name,
  event_id % 5 < 2 AS shuffle,
  CASE WHEN event_id % 41 <> 0 THEN event_type = 'click' END AS skipped
FROM events
""".replace("{{", "{").replace("}}", "}")

# An export file holds the records of 400 successive events; every fifth one wraps them,
# some are broken, some carry a sample file's name. One folder has samples only. Some
# records name their time twice.
FILES = """
SELECT chunk,
  concat('/exports/', CASE WHEN chunk % 6 = 0 THEN 'samples' ELSE concat('listener_', CAST(chunk % 4 AS VARCHAR(10))) END,
    '/Streaming_History_Audio_', CASE WHEN chunk % 3 = 0 THEN 'sample' ELSE '' END,
    CAST(chunk AS VARCHAR(20)), '.json') AS path,
  CASE WHEN chunk % 5 = 1 THEN concat('{"history":', items, ',"exported":1}')
       WHEN chunk % 7 = 3 THEN '{"history":5}'
       WHEN chunk % 11 = 5 THEN 'not json'
       ELSE items END AS text
FROM items
"""
GOOD = "(chunk % 5 = 1 OR NOT (chunk % 7 = 3 OR chunk % 11 = 5))"


def files(spark, sf):
    """Landed files with path and content, as the binary file source gives them."""
    text = RECORDS.replace("{CHUNK}", "event_id div 400")
    records = events_as(spark, sf, text).select("event_id", "chunk", "record")
    # Identities are unique, so a chunk has at most 400 records.
    items = records.groupBy("chunk").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "record"))).alias("rows")
    ).select("chunk", F.concat(F.lit("["), F.concat_ws(",", "rows.record"), F.lit("]")).alias("items"))
    named = select_from(spark, FILES, "items", items)
    return named.select(
        "chunk", "path", F.length("text").cast("bigint").alias("length"), F.col("text").cast("binary").alias("content")
    )


def scratch(spark) -> str:
    """A new path in the shared folder, gone when the driver's JVM ends."""
    parent = f"{shared_folder(spark)}/contract"
    folder = spark._jvm.org.apache.hadoop.fs.Path(parent)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    delete_at_exit(spark, parent)
    return f"{parent}/{uuid.uuid4().hex}"


def stored_files(spark, sf) -> str:
    """The export files as real files, one folder each."""
    folder = scratch(spark)
    texts = files(spark, sf).select("chunk", F.col("content").cast("string").alias("text"))
    texts.write.partitionBy("chunk").text(folder)
    return folder


STORED_GLOB = "part-*.txt"


def discover(spark, sf):
    found = landing.landing(spark, stored_files(spark, sf), STORED_GLOB)
    return found.select(F.regexp_extract("path", r"chunk=(\d+)", 1).cast("bigint").alias("chunk"), "length")


def _profile(spark, sf):
    profile = landing.field_profile(landing.records(files(spark, sf)))
    return profile.select("field", F.concat_ws(",", "types").alias("types"))


def _manifest(spark, sf):
    return landing.manifest(files(spark, sf), "landing/files").drop("ingested_at")


def _summary(spark, sf):
    exported = files(spark, sf)
    summary = landing.landing_summary(
        landing.manifest(exported), landing.field_profile(landing.records(exported))
    )
    return summary.select(
        "layer", "total_files", "total_records", "total_fields",
        F.concat_ws(",", F.transform("fields", lambda f: f["field"])).alias("field_names"),
    )


def _landed_copy(spark, sf):
    folder = scratch(spark)
    tables.write_table(files(spark, sf), folder)
    return tables.read_table(spark, folder).select("path", "length", F.sha2("content", 256).alias("sha256"))


TYPED = ["ts", "ms_played", "conn_country", "track_name", "track_uri", "episode_name", "shuffle", "skipped"]


def _typed(spark, sf):
    return landing.history_from_records(landing.records(files(spark, sf))).select("path", *TYPED)


def _read_history(spark, sf):
    """Through real files, listener taken from the path."""
    plays = landing.read_history(spark, stored_files(spark, sf), STORED_GLOB, r"chunk=(\d+)")
    return plays.select("listener_id", *TYPED)


def _chunk() -> Column:
    return F.regexp_extract("path", r"chunk=(\d+)", 1).cast("bigint").alias("chunk")


def _ranged_records(spark, sf):
    """Records of real files, read in byte ranges."""
    records, _ = split_records(spark, stored_files(spark, sf), STORED_GLOB)
    return records.select(_chunk(), "position", F.try_variant_get("record", "$.ts", "string").alias("ts"))


def _ranged_counts(spark, sf):
    _, counts = split_records(spark, stored_files(spark, sf), STORED_GLOB)
    return counts.select(_chunk(), "record_count")


def _history_of_large_files(spark, sf):
    """Typed plays of real files, all taken as too large for one row."""
    exported = landing.landing(spark, stored_files(spark, sf), STORED_GLOB, large=1)
    records, _ = landing.records_and_counts(exported, durable)
    return landing.history_from_records(records).select(_chunk(), *TYPED)


def _fact_stored(spark, sf):
    folder = scratch(spark)
    tables.write_table(fact(spark, sf), folder, ("year", "content_type"))
    return tables.read_table(spark, folder)


def _partitioned(spark, sf):
    counts = _fact_stored(spark, sf).groupBy("year", "content_type")
    return counts.agg(F.count("*").alias("plays"), F.sum("ms_played").alias("ms_total"))


def _mart_stored(spark, sf) -> str:
    folder = scratch(spark)
    tables.write_table(marts.activity_by_hour(history(spark, sf)), folder)
    return folder


def _document(spark, sf):
    """A layer document written as JSON and read back."""
    folder = scratch(spark)
    total = history(spark, sf).count()
    tables.write_document(tables.layer_document(spark, "marts", "marts", total, ["a", "b"]), folder)
    read = spark.read.schema("layer string, total_records bigint, tables array<string>").json(folder)
    return read.select("layer", "total_records", F.concat_ws(",", "tables").alias("tables"))


def _fact_read(spark, sf):
    music = _fact_stored(spark, sf).filter(F.col("content_type") == "music")
    return music.groupBy("track_name").agg(F.count("*").alias("plays"))


def _model_input(spark, sf):
    stored = history(spark, sf).withColumns({
        "ms_played": F.when(F.col("play_id") % 43 == 0, "bad").otherwise(F.col("ms_played").cast("string")),
        "hour": F.col("hour").cast("string"),
    })
    return tables.model_input(stored).select("play_id", "ms_played", "hour", "shuffle", "skipped")


def _model_sinks(spark, sf):
    """A result document through JSON, nested values included."""
    folder = scratch(spark)
    mix = marts.content_mix(history(spark, sf)).agg(
        F.array_sort(F.collect_list(F.struct("content_type", "plays"))).alias("mix"), F.sum("plays").alias("plays")
    )
    tables.write_document(mix, folder)
    read = spark.read.schema("mix array<struct<content_type string, plays bigint>>, plays bigint").json(folder)
    return read.selectExpr("plays AS total", "inline(mix) AS (content_type, plays)")


def _mart_read(spark, sf):
    present = tables.read_table_if_present(spark, _mart_stored(spark, sf))
    absent = tables.read_table_if_present(spark, scratch(spark))
    return present.withColumn("other_mart_present", F.lit(absent is not None))


QUERIES = {
    "s1_discover": discover,
    "s2_precedence": lambda s, sf: landing.prefer_numbered(files(s, sf)).select("path", "length"),
    "s3_records": lambda s, sf: landing.records(files(s, sf)).select(
        "path", F.col("position").cast("bigint").alias("position"),
        F.try_variant_get("record", "$.ts", "string").alias("ts"),
    ),
    "s3_records_of_byte_ranges": _ranged_records,
    "s4_counts_of_byte_ranges": _ranged_counts,
    "s8_history_of_large_files": _history_of_large_files,
    "s3_rejects": lambda s, sf: landing.rejects(files(s, sf)),
    "s4_landing_copy": _landed_copy,
    "s5_manifest": _manifest,
    "s6_field_profile": _profile,
    "s7_landing_summary": _summary,
    "s8_typed_records": _typed,
    "s8_read_history": _read_history,
    "s9_partitioned_sink": _partitioned,
    "s10_mart_sink": lambda s, sf: tables.read_table(s, _mart_stored(s, sf)),
    "s11_layer_document": _document,
    "s12_fact_read": _fact_read,
    "s13_model_input": _model_input,
    "s14_model_document": _model_sinks,
    "s15_mart_read": _mart_read,
}

FILES_CTE = f"""
records AS ({for_duckdb(RECORDS.replace("{CHUNK}", "event_id // 400"))}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY event_id) - 1 AS position FROM records),
items AS (SELECT chunk, concat('[', string_agg(record, ',' ORDER BY event_id), ']') AS items, count(*) AS n FROM records GROUP BY chunk),
files AS ({FILES}),
good AS (SELECT r.*, f.path FROM numbered r JOIN files f USING (chunk) WHERE {GOOD.replace("chunk", "r.chunk")})
"""

KINDS = {
    "ts": "'str'",
    "ms_played": "CASE WHEN event_id % 43 = 0 THEN 'str' ELSE 'int' END",
    "conn_country": "'str'",
    "master_metadata_track_name": "CASE WHEN track_name IS NULL THEN 'NoneType' ELSE 'str' END",
    "spotify_track_uri": "CASE WHEN track_uri IS NULL THEN 'NoneType' ELSE 'str' END",
    "episode_name": "CASE WHEN episode_name IS NULL THEN 'NoneType' ELSE 'str' END",
    "shuffle": "'bool'",
    "skipped": "CASE WHEN skipped IS NULL THEN 'NoneType' ELSE 'bool' END",
    "score": "'float'",
    "tags": "'list'",
    "device": "'dict'",
}
KINDS_CTE = ",\nkinds AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {k} AS kind FROM good" for f, k in KINDS.items()) + ")"


def _on_files(body: str, more: str = "") -> str:
    return f"WITH {FILES_CTE}{more}\n{body}"


MANIFEST_SQL = f"""
SELECT regexp_extract(path, '[^/]+$') AS file_name, path AS source_path, 'landing/files' AS landing_path,
  sha256(text) AS sha256, CASE WHEN {GOOD.replace("chunk", "f.chunk")} THEN n END AS record_count,
  strlen(text) AS size_bytes
FROM files f JOIN items USING (chunk)
"""

HOURLY = f"SELECT hour, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms_total, {hours('sum(ms_played)')} AS hours"

ORACLES = {
    # A text file ends with a line break, hence one byte more.
    "s1_discover": _on_files("SELECT chunk, strlen(text) + 1 AS length FROM files"),
    "s2_precedence": _on_files(
        "SELECT path, strlen(text) AS length FROM files f WHERE chunk % 3 <> 0 OR NOT EXISTS ("
        "SELECT 1 FROM files g WHERE g.chunk % 3 <> 0 "
        "AND regexp_replace(g.path, '[^/]*$', '') = regexp_replace(f.path, '[^/]*$', ''))"
    ),
    "s3_records": _on_files("SELECT path, position, ts FROM good"),
    "s3_records_of_byte_ranges": _on_files("SELECT chunk, CAST(position AS INTEGER) AS position, ts FROM good"),
    "s4_counts_of_byte_ranges": _on_files(
        f"SELECT f.chunk, CASE WHEN {GOOD.replace('chunk', 'f.chunk')} THEN n END AS record_count FROM files f JOIN items USING (chunk)"
    ),
    "s8_history_of_large_files": _on_files(f"SELECT chunk, {', '.join(TYPED)} FROM good"),
    "s3_rejects": _on_files(f"SELECT path, strlen(text) AS size_bytes FROM files WHERE NOT {GOOD}"),
    "s4_landing_copy": _on_files("SELECT path, strlen(text) AS length, sha256(text) AS sha256 FROM files"),
    "s5_manifest": _on_files(MANIFEST_SQL),
    "s6_field_profile": _on_files(
        "SELECT field, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types FROM kinds GROUP BY field", KINDS_CTE
    ),
    "s7_landing_summary": _on_files(
        "SELECT 'landing' AS layer, count(*) AS total_files, "
        f"CAST(sum(CASE WHEN {GOOD.replace('chunk', 'f.chunk')} THEN n ELSE 0 END) AS BIGINT) AS total_records, "
        "any_value(k.total_fields) AS total_fields, any_value(k.field_names) AS field_names "
        "FROM files f JOIN items USING (chunk), (SELECT count(DISTINCT field) AS total_fields, "
        "string_agg(DISTINCT field, ',' ORDER BY field) AS field_names FROM kinds) k", KINDS_CTE
    ),
    "s8_typed_records": _on_files(f"SELECT path, {', '.join(TYPED)} FROM good"),
    "s8_read_history": _on_files(f"SELECT CAST(chunk AS VARCHAR) AS listener_id, {', '.join(TYPED)} FROM good"),
    "s9_partitioned_sink": on_raw(
        "SELECT year, content_type, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms_total FROM fact GROUP BY 1, 2", FACT_CTE
    ),
    "s10_mart_sink": on_history(f"{HOURLY} FROM history GROUP BY hour"),
    "s11_layer_document": "SELECT 'marts' AS layer, count(*) AS total_records, 'a,b' AS tables FROM events",
    "s12_fact_read": on_raw(
        "SELECT track_name, count(*) AS plays FROM fact WHERE content_type = 'music' GROUP BY track_name", FACT_CTE
    ),
    "s13_model_input": on_history(
        "SELECT play_id, CASE WHEN play_id % 43 <> 0 THEN ms_played END AS ms_played, hour, shuffle, "
        "coalesce(skipped, false) AS skipped FROM history"
    ),
    "s14_model_document": on_history(
        "SELECT CAST(sum(count(*)) OVER () AS BIGINT) AS total, content_type, count(*) AS plays FROM history GROUP BY content_type"
    ),
    "s15_mart_read": on_history(f"{HOURLY}, false AS other_mart_present FROM history GROUP BY hour"),
}
