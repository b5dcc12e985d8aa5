"""Records of export files of any size: one JSON array read by many tasks.

Spark's text source cuts a file at every closing brace, in byte ranges that tasks read on
their own. Where in the JSON a piece starts, inside a string or how deep, follows from all
pieces before it. So each piece is reduced to what it does to that state, for both ways it
may start; the sums of ranges are composed along the file, and every range's pieces get
their state from its start. The pieces of an array item are joined and parsed in the
range they are in; only items that a range border cuts go on to another task.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearlog.session import durable

#: Byte ranges (one per 128 MB) up to which what they carry is sent to every executor.
BROADCAST_RANGES = 1_000_000

_NO_MARKS = r'(?s)\\.|[^"\[\]{}\\]+'
_STRING = r'"[^"]*("|$)'
_OBJECT_OPENS = r'(?s)^\s*\{\s*"[^"\\]*"\s*:\s*\['
_ARRAY_OPENS = r"^\s*\["
_ALONG = ["block", "row"]


def file_name(url: Column) -> Column:
    """The path that the binary source gives to a file, from the text source's."""
    return F.url_decode(F.regexp_replace(url, r"\+", "%2B"))


def pieces(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """Text up to each closing brace, with the byte range it was read in and its place there."""
    return (
        spark.read.option("lineSep", "}").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
        .select(
            F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"), F.col("_metadata.file_size").alias("size"), "value",
        )
    )


def _depths(structure: Column) -> Column:
    """(depth after, least depth on the way) of brackets and braces, from 0."""
    # What opens and closes at once changes neither; little is left to go over.
    for pair in ("[]", "{}", "[]", "{}"):
        structure = F.replace(structure, F.lit(pair), F.lit(""))
    marks = F.split(structure, "")
    step = F.struct(F.lit(0).alias("end"), F.lit(0).alias("least"))

    def after(state: Column, mark: Column) -> Column:
        end = state["end"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(end.alias("end"), F.least(state["least"], end).alias("least"))

    return F.aggregate(marks, step, after)


def _effects(rows: DataFrame) -> DataFrame:
    """What each piece does: strings it leaves open, and depths when it starts outside or in one."""
    # A string without brackets, or what is between two, leaves a pair of quotes that goes
    # whether the piece starts in a string or not.
    marks = F.replace(F.regexp_replace("text", _NO_MARKS, ""), F.lit('""'), F.lit(""))
    quotes = F.length("marks") - F.length(F.replace("marks", F.lit('"'), F.lit("")))
    inside = F.regexp_replace("marks", r'^[^"]*("|$)', "")
    return rows.withColumn("marks", marks).withColumns({
        "flips": (quotes % 2).cast("int"),
        "out": _depths(F.regexp_replace("marks", _STRING, "")),
        "in": _depths(F.regexp_replace(inside, _STRING, "")),
    }).drop("marks")


def _offsets(ranges: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Per byte range, the sums of ``values`` over the ranges before it in its file."""
    before = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumns({name: F.coalesce(F.sum(value).over(before), F.lit(0)) for name, value in values.items()})


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_RANGES else df


def _scanned(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces with the state they start in, relative to the array's items; facts of each file)."""
    in_range = Window.partitionBy("url", "block").orderBy("row")
    before = in_range.rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.col("block") == 0) & (F.row_number().over(in_range) == 1)
    start = F.regexp_replace("value", "^\ufeff", "")
    level = F.when(start.rlike(_ARRAY_OPENS), 1).when(start.rlike(_OBJECT_OPENS), 2).otherwise(0)
    rows = rows.withColumn("opens", opens).withColumns({
        "level": F.when(F.col("opens"), level),
        # The first piece goes on behind the bracket that opens the array.
        "text": F.concat(
            F.when(F.col("opens") & (level > 0), F.regexp_replace(F.regexp_replace(start, _OBJECT_OPENS, ""), _ARRAY_OPENS, ""))
            .otherwise(F.col("value")), F.lit("}")
        ),
        "bytes": F.octet_length("value") + 1,
    }).drop("value")
    rows = _effects(rows)
    # Depth sums for a range that starts outside (0) and inside (1) of a string.
    rows = rows.withColumn("odd", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    for start_in in (0, 1):
        effect = F.when(F.col("odd") == start_in, F.col("out")).otherwise(F.col("in"))
        rows = rows.withColumn(f"effect_{start_in}", effect).withColumn(
            f"depth_{start_in}", F.coalesce(F.sum(effect["end"]).over(before), F.lit(0))
        )
    rows = durable(rows.drop("out", "in"))
    ranges = rows.groupBy("url", "block").agg(
        F.sum("flips").alias("flips"), F.sum("effect_0.end").alias("sum_0"), F.sum("effect_1.end").alias("sum_1")
    )
    ranges = _offsets(ranges, {"quotes": F.col("flips")}).withColumn("starts_in", (F.col("quotes") % 2).cast("int"))
    ranges = _offsets(ranges, {"depth": F.when(F.col("starts_in") == 1, F.col("sum_1")).otherwise(F.col("sum_0"))})
    rows = rows.join(_small(durable(ranges.select("url", "block", "starts_in", "depth"))), ["url", "block"])
    entered = F.col("starts_in") == 1
    effect = F.when(entered, F.col("effect_1")).otherwise(F.col("effect_0"))
    rows = rows.withColumns({
        "in_string": (F.col("odd") + F.col("starts_in")) % 2 == 1,
        "from": F.col("depth") + F.when(entered, F.col("depth_1")).otherwise(F.col("depth_0")),
    }).withColumns({
        "to": F.col("from") + effect["end"], "least": F.col("from") + effect["least"],
        "ends_in_string": (F.col("in_string").cast("int") + F.col("flips")) % 2 == 1,
    }).select("url", *_ALONG, "size", "bytes", "text", "opens", "level", "in_string", "from", "to", "least", "ends_in_string")
    place = F.struct(*_ALONG)
    files = rows.groupBy("url").agg(
        F.max("level").alias("level"),
        F.min(F.when(F.col("least") < 0, place)).alias("closed"),
        F.min(F.when(F.col("least") <= -2, place)).alias("left"),
        F.max(place).alias("last"),
        F.max_by(F.struct("to", "least"), place).alias("end"),
        (F.sum("bytes") - F.max("size")).isin(1, -2).alias("cut"),
    )
    # A last piece that no brace follows was given one too many; the text source leaves out
    # the three bytes of a byte order mark. What is behind the object does not count.
    given = F.col("cut") & (F.col("left") == F.col("last")) & (F.col("end.least") > -3) & (F.col("end.to") > -3)
    whole = (F.col("level") == 1) | ((F.col("level") == 2) & F.col("left").isNotNull() & ~given)
    return rows, files.withColumn("whole", F.coalesce(whole, F.lit(False)) & F.col("closed").isNotNull())


def _parsed(chunks: DataFrame, ready: Column) -> DataFrame:
    """Add the items of those chunks that are ``ready``, their number, and whether they are right."""
    items = F.when(F.col("opens"), F.col("text")).otherwise(F.regexp_replace("text", r"^\s*,", ""))
    array = F.concat(F.lit("["), items, F.when(F.col("closes"), F.lit("")).otherwise(F.lit("]")))
    chunks = chunks.withColumn("items", F.from_json(F.when(ready, array), "array<variant>"))
    count = F.size("items")
    separated = F.col("opens") | (F.col("text").rlike(r"^\s*,") & (count > 0)) | (F.col("closes") & F.col("text").rlike(r"^\s*\]"))
    return chunks.withColumns({"fine": F.col("items").isNotNull() & separated, "n": F.coalesce(count, F.lit(0))})


def _chunks(inner: DataFrame) -> DataFrame:
    """Pieces joined to whole array items, parsed, with the items before them in their byte range."""
    in_range = Window.partitionBy("url", "block").orderBy("row")
    so_far = in_range.rowsBetween(Window.unboundedPreceding, 0)
    # A run goes from a piece that begins between two items to the next one; run 0 goes on
    # with an item of an earlier range, and the last may go on in a later one. Runs, items
    # and sums are made where the range's pieces are.
    runs = (
        inner.withColumn("run", F.sum(F.col("begins").cast("int")).over(so_far))
        .groupBy("url", "block", "run").agg(
            F.sort_array(F.collect_list(F.struct("row", "text"))).alias("parts"), F.min("row").alias("row"),
            F.bool_or("opens").alias("opens"), F.bool_or("closes").alias("closes"), F.max_by("ends", "row").alias("ended"),
        )
        .withColumns({"text": F.array_join("parts.text", ""), "cut": (F.col("run") == 0) | ~F.col("ended")})
    )
    before = in_range.rowsBetween(Window.unboundedPreceding, -1)
    runs = durable(_parsed(runs, ~F.col("cut")).select(
        "url", "block", "run", "row", "opens", "closes", "cut", F.when(F.col("cut"), F.col("text")).alias("text"),
        "items", "fine", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("within"),
    ))
    # At most two runs of a range are cut; they go to the last one that begins before them.
    begun = F.when(F.col("run") > 0, F.struct("block", "row", "within", "opens"))
    along = Window.partitionBy("url").orderBy("block", "run").rowsBetween(Window.unboundedPreceding, 0)
    joined = (
        runs.where("cut").withColumn("head", F.last(begun, ignorenulls=True).over(along))
        .groupBy("url", "head").agg(
            F.sort_array(F.collect_list(F.struct("block", "run", "text"))).alias("parts"), F.bool_or("closes").alias("closes")
        )
        .select("url", "head.*", F.array_join("parts.text", "").alias("text"), "closes")
    )
    columns = ["url", "block", "items", "fine", "n", "within"]
    return runs.where("NOT cut").select(columns).union(durable(_parsed(joined, F.lit(True)).select(columns)))


def split_records(spark: SparkSession, path: str | list[str], glob: str) -> tuple[DataFrame, DataFrame]:
    """(``path, position, record`` of all files; ``path, record_count`` of every file).

    Rows are those of a parse of each whole file: the items of its array, or of the array
    that is the first value of its object. The count is null for a file without one, whose
    items do not count either. Not seen is what no JSON writer makes: single-quoted
    strings, braces or escapes in the name of the wrapping key, and, behind the array of a
    wrapping object, text whose brackets match but which is no JSON.
    """
    rows, files = _scanned(pieces(spark, path, glob))
    files = durable(files)
    place = F.struct(*_ALONG)
    inner = rows.drop("level").join(
        _small(files.where("whole").select("url", "closed", "last", "cut")), "url"
    ).where(place <= F.col("closed"))
    text = F.when((place == F.col("last")) & F.col("cut"), F.substring("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))
    chunks = _chunks(inner.select(
        "url", *_ALONG, text.alias("text"), "opens", (place == F.col("closed")).alias("closes"),
        ((F.col("from") == 0) & ~F.col("in_string")).alias("begins"),
        ((F.col("to") == 0) & ~F.col("ends_in_string") | (place == F.col("closed"))).alias("ends"),
    ))
    counts = files.select("url", "whole").join(
        chunks.groupBy("url").agg(F.sum("n").alias("n"), F.bool_and("fine").alias("fine")), "url", "left"
    ).select("url", file_name(F.col("url")).alias("path"), F.when(F.col("whole") & F.col("fine"), F.col("n")).alias("record_count"))
    counts = durable(counts)
    ranges = durable(_offsets(
        chunks.groupBy("url", "block").agg(F.sum("n").alias("n")), {"earlier": F.col("n")}
    ).join(counts.where("record_count IS NOT NULL"), "url").select("url", "block", "path", "earlier"))
    numbered = chunks.join(_small(ranges), ["url", "block"]).select(
        "path", (F.col("earlier") + F.col("within")).alias("earlier"), F.posexplode("items").alias("at", "record")
    )
    records = numbered.select("path", (F.col("earlier") + F.col("at")).cast("int").alias("position"), "record")
    return records, counts.select("path", "record_count")
