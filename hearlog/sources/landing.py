"""Raw export files: landing table, records, manifest, field profile, summary.

An export file is one row with its bytes; its records are a table of their own, so that
all work behind the landing splits by record. A file too large for that is a row without
bytes, and its records are read in byte ranges (see ``split``).
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearlog.sources.export_format import FIELDS, FILE_GLOB, NUMBERED_FILE, TYPE_LABELS
from hearlog.sources.split import split_records

#: Bytes from which a file is not held in one row. Spark's binary source ends at 2 GB.
LARGE = 256 << 20


def landing(
    spark: SparkSession, path: str | list[str], glob: str = FILE_GLOB, large: int = LARGE
) -> DataFrame:
    """Export files under ``path`` with their bytes; an error when there are none.

    Of files of ``large`` bytes or more the bytes are null and not read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no {glob} under {path}")
    columns = files.columns
    rest = files.where(F.col("length") >= large).drop("content").withColumn("content", F.lit(None).cast("binary"))
    return prefer_numbered(files.where(F.col("length") < large).union(rest.select(columns)))


def prefer_numbered(files: DataFrame) -> DataFrame:
    """Real exports are numbered: in a folder that has any, unnumbered (sample) files are
    left out. Folders, and so listeners, do not affect each other.

    Only paths are read to find the files that go; their contents are not shuffled unless
    those files are too many to send around.
    """
    paths = files.select("path", F.regexp_replace("path", "[^/]*$", "").alias("_folder"))
    numbered = F.col("path").rlike(NUMBERED_FILE)
    real = paths.filter(numbered).select("_folder").distinct()
    left_out = paths.filter(~numbered).join(real, "_folder", "left_semi").select("path")
    return files.join(left_out, "path", "left_anti").select(files.columns)


def with_payload(files: DataFrame) -> DataFrame:
    """Add ``payload``, the array of records in a file: the file itself, or the first
    value of its object. Null when that is not an array.
    """
    text = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    wrapped = F.get(F.map_values(F.from_json(text, "map<string,variant>")), F.lit(0))
    parsed = F.coalesce(
        F.from_json(text, "array<variant>"),
        F.try_variant_get(wrapped, "$", "array<variant>"),
    )
    return files.withColumn("payload", parsed)


def with_count(files: DataFrame) -> DataFrame:
    """Add ``record_count``, null for a file without an array of records."""
    if "record_count" in files.columns:
        return files
    counted = F.array_size("payload").cast("bigint")
    return with_payload(files).withColumn("record_count", counted).drop("payload")


def records(files: DataFrame, on_bad_file: str = "skip") -> DataFrame:
    """One row per record. Bad files are skipped (see ``rejects``) or fail the query."""
    items = F.col("payload")
    if on_bad_file == "fail":
        message = F.concat(F.lit("Unexpected JSON structure in "), F.col("path"))
        items = F.coalesce(items, F.raise_error(message).cast("array<variant>"))
    elif on_bad_file != "skip":
        raise ValueError("on_bad_file is 'skip' or 'fail'")
    return with_payload(files).select("path", F.posexplode(items).alias("position", "record"))


def records_and_counts(files: DataFrame, store: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(records of all files, as ``store`` has put them away; ``path, record_count`` of each).

    A file is parsed once, when its records are stored; only files that gave none are
    looked at again, to tell an empty array from none.
    """
    spark = files.sparkSession
    found = records(files.where("content IS NOT NULL"))
    # There are no more of these than the data has multiples of ``LARGE``.
    large = [row["path"] for row in files.where("content IS NULL").select("path").collect()]
    known = None
    if large:
        split, known = split_records(spark, large, "*")
        found = found.union(split)
    stored = store(found)
    counted = stored.groupBy("path").agg(F.count("*").alias("record_count"))
    silent = files.where("content IS NOT NULL").join(counted, "path", "left_anti")
    counts = counted.union(with_count(silent).select("path", "record_count"))
    if known is not None:
        counts = counts.unionByName(known.join(counted, "path", "left_anti"))
    return stored, counts


def rejects(files: DataFrame) -> DataFrame:
    """Files that hold no array of records."""
    return (
        with_count(files)
        .filter(F.col("record_count").isNull())
        .select("path", F.col("length").alias("size_bytes"))
    )


def manifest(files: DataFrame, landed_as: str | None = None) -> DataFrame:
    """Name, place, digest, size and record count of every landed file."""
    return with_count(files).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("path").alias("source_path"),
        (F.lit(landed_as) if landed_as else F.col("path")).alias("landing_path"),
        F.sha2("content", 256).alias("sha256"),
        "record_count",
        F.current_timestamp().alias("ingested_at"),
        F.col("length").alias("size_bytes"),
    )


def field_profile(recs: DataFrame) -> DataFrame:
    """Every field with the kinds of value seen in it.

    A field and kind pair is counted once per map task before the shuffle, so the set
    is collected from at most eight rows per field.
    """
    variant_kind = F.regexp_extract(F.expr("schema_of_variant(value)"), "^[A-Z]+", 0)
    label = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for p in TYPE_LABELS.items() for x in p]), variant_kind),
        F.lower(variant_kind),
    )
    fields = recs.lateralJoin(
        recs.sparkSession.tvf.variant_explode(F.col("record").outer())
    ).select(F.col("key").alias("field"), label.alias("type"))
    return (
        fields.filter(F.col("field").isNotNull())
        .groupBy("field", "type")
        .agg(F.count("*").alias("_n"))
        .groupBy("field")
        .agg(F.array_sort(F.collect_list("type")).alias("types"))
    )


def landing_summary(files_manifest: DataFrame, profile: DataFrame) -> DataFrame:
    """One row: totals over the manifest and the field profile."""
    totals = files_manifest.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("total_records"),
        F.max("ingested_at").alias("ingested_at"),
    )
    fields = profile.agg(
        F.count("*").alias("total_fields"),
        F.array_sort(F.collect_list(F.struct("field", "types"))).alias("fields"),
    )
    return totals.crossJoin(F.broadcast(fields)).withColumn("layer", F.lit("landing"))


def history_from_records(recs: DataFrame) -> DataFrame:
    """Typed plays. A value of the wrong kind becomes null and the text of its record is
    kept in ``_corrupt_record``; items that are no records at all are left to ``bad_items``.
    """
    columns, fits_all = [], F.lit(True)
    for field, kind, name in FIELDS:
        value = F.try_variant_get("record", f"$.{field}", kind)
        if kind != "string":
            seen = F.schema_of_variant(F.try_variant_get("record", f"$.{field}", "variant"))
            value = F.when(seen == kind.upper(), value)
            fits_all = fits_all & F.coalesce(seen.isin(kind.upper(), "VOID"), F.lit(True))
        columns.append(value.alias(name))
    corrupt = F.when(~fits_all, F.to_json("record")).alias("_corrupt_record")
    return recs.filter(_is_record()).select(*columns, "path", corrupt)


def bad_items(recs: DataFrame) -> DataFrame:
    """Items of a payload that are not JSON objects, as text."""
    return recs.filter(~_is_record()).select("path", "position", F.to_json("record").alias("item"))


def _is_record() -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant("record"), F.lit("OBJECT")), F.lit(False))


def read_history(
    spark: SparkSession,
    path: str | list[str],
    glob: str = FILE_GLOB,
    listener_pattern: str | None = None,
) -> DataFrame:
    """Plays of all export files under ``path``, wrapped files included.

    ``listener_pattern`` is a regular expression whose first group, found in the file
    path, names the listener; without it all files belong to one listener.
    """
    plays = history_from_records(records_and_counts(landing(spark, path, glob), lambda found: found)[0])
    if listener_pattern:
        plays = plays.withColumn("listener_id", F.regexp_extract("path", listener_pattern, 1))
    return plays
