"""Files that arrive in a folder, as a stream: kinds, texts, duplicates, passages and status rows, each micro-batch one commit.

A micro-batch is published under its own number, so a batch that is run again after a crash changes nothing, and a
file's row, its text and its passages are seen together.  A file that cannot be taken is a row with a reason, not a failed job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartage.functions.passages import passages_of
from cartage.functions.staging import cut
from cartage.functions.text import content_hash
from cartage.operators.lifecycle import title_of
from cartage.sources import commits, files


def file_stream(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """The files of ``folder`` as a stream of (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_a_batch).load(folder)


def judged_files(arrived: DataFrame, known: DataFrame | None) -> DataFrame:
    """(path, title, kind, status, reason, source_hash, content_hash, text) of arrived files: ready, failed or duplicate.

    The same bytes, or the same text in other bytes, as a ready document of before or as an earlier path of this batch are a duplicate.
    """
    read = cut(files.extracted(arrived).withColumn("content_hash", content_hash(F.col("text"))))
    good = read.where("error IS NULL")
    old = [] if known is None else [known.where("status = 'ready'").select(F.col("content_hash").alias("key"), F.lit("").alias("path"))]
    every = good.select(F.col("content_hash").alias("key"), "path")
    for more in old:
        every = every.unionByName(more)
    first = every.groupBy("key").agg(F.min("path").alias("__first"))  # "" is a document of before
    met = read.join(first, F.col("content_hash") == F.col("key"), "left")
    again = F.col("error").isNull() & (F.col("path") != F.col("__first"))
    status = F.when(F.col("error").isNotNull(), "failed").when(again, "duplicate").otherwise("ready")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(again, "the same text is there already")
    return met.select("path", title_of(F.col("path")).alias("title"), "kind", status.alias("status"), reason.alias("reason"), "source_hash", "content_hash", F.when(status == "ready", F.col("text")).alias("text"))


def passages_of_documents(documents: DataFrame) -> DataFrame:
    """(document, chunk_index, heading, content, token_count, content_hash, is_active) of the ready documents."""
    each = documents.where("status = 'ready'").select(F.col("path").alias("document"), F.explode(passages_of(F.col("text"), F.col("title"))).alias("c"))
    return each.select("document", "c.chunk_index", "c.heading", "c.content", "c.token_count", "c.content_hash", F.lit(True).alias("is_active"))


def ingest_batch(spark: SparkSession, root: str, arrived: DataFrame, name: str) -> bool:
    """Publish one batch of files; files whose path and bytes are known already are left out."""
    if commits.is_published(spark, root, name):
        return False
    known = commits.read(spark, root, "documents")
    fresh = arrived.withColumn("source_hash", F.sha2("content", 256))
    if known is not None:
        fresh = fresh.join(known.select("path", "source_hash"), ["path", "source_hash"], "left_anti")
    documents = cut(judged_files(fresh, known))
    return commits.publish(spark, root, name, {"documents": documents, "passages": passages_of_documents(documents)})


def ingest_stream(spark: SparkSession, folder: str, root: str, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Take all files that are there, batch by batch, and stop; a later call goes on where this one ended."""

    def step(batch: DataFrame, number: int) -> None:
        ingest_batch(batch.sparkSession, root, batch, f"ingest-{number:09d}")

    return file_stream(spark, folder, files_a_batch).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_documents(documents: DataFrame) -> DataFrame:
    """One row a path: the one that was published last (a file may come again with other bytes)."""
    last = Window.partitionBy("path").orderBy(F.desc("commit"))
    return documents.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
