"""Landing of export files as they arrive.

The batch ``land`` copies a whole folder. Where exports of many listeners keep arriving,
this lands only the files that are new since the last call, each exactly once, into the
same table.
"""

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from hearlog.sources.export_format import FILE_GLOB
from hearlog.sources.landing import with_count

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def land_new_files(
    spark: SparkSession, source: str, root: str, glob: str = FILE_GLOB, files_per_batch: int = 10_000
) -> StreamingQuery:
    """Append the new files under ``source`` to ``root/files`` and stop.

    Progress is kept under ``root/_progress``. All files are landed; which of them count
    (see ``prefer_numbered``) is decided over the whole table, by ``build_plays``.
    """
    arriving = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(source)
    )
    query = (
        with_count(arriving)
        .writeStream.format("parquet")
        .option("path", f"{root}/files")
        .option("checkpointLocation", f"{root}/_progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
