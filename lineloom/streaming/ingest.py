"""New caption files, and new lines, as streams: each micro-batch is read and takes the place of its sources in the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lineloom.operators.incremental import update_index, write_index
from lineloom.sources.captions import read_files


def caption_stream(spark: SparkSession, root: str) -> DataFrame:
    """A stream of ``relpath, content`` of files that arrive below a root."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:", "")
    return found.select(F.substr(F.regexp_replace("path", "^file:/*", "/"), F.length(base) + 2).alias("relpath"), "content")


def indexed(lines: DataFrame, media: str = "subs") -> DataFrame:
    """Lines of read files as rows of an index: the source by the hash of its path, rows by source and place."""
    source = F.xxhash64("relpath")
    return lines.select(
        F.lit(media).alias("media"), source.alias("source_id"), (F.shiftleft(source, 20).bitwiseXOR(F.col("place").cast("long"))).alias("row_id"), F.col("relpath").alias("file"),
        F.split("relpath", r"[\\/]")[0].alias("folder"), "line",
    )


def keep_index(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the files of a stream into the index at ``path``; a batch that runs again gives the same index."""

    def write(batch: DataFrame, _: int) -> None:
        # of one path the last content in the batch; a file that arrives twice is one source
        latest = batch.groupBy("relpath").agg(F.max_by("content", F.length("content")).alias("content"))
        fresh = indexed(read_files(latest))
        spark = batch.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            none = spark.createDataFrame([], "media string, source_id long")
            update_index(spark, path, fresh, none)
        else:
            write_index(fresh, path)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_counts(lines: DataFrame, time: str = "at", wait: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """``window, folder, lines`` of a stream of lines with event times; later lines than ``wait`` are left out."""
    return lines.withWatermark(time, wait).groupBy(F.window(time, width), "folder").agg(F.count("*").alias("lines"))
