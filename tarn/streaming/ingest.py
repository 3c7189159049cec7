"""Incremental ingestion: a file stream into chunk tables, each batch committed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.operators.chunking import children_of, chunk, parents_of
from tarn.sources.files import pages_of


def ingest_stream(spark: SparkSession, folder: str, store: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Read text files that land in ``folder`` and append parents, children and manifest below ``store``.

    A document already in the manifest with the same content is skipped, so that replays change
    nothing; another content for a known document is recorded as a conflict and not loaded. A text of
    blanks only is recorded as failed; Spark's file source passes over files without any bytes.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)

    def one(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, store, number)

    w = files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def manifest(spark: SparkSession, store: str) -> DataFrame:
    schema = "doc_id string, content_hash string, path string, status string, chars_removed int, suspicious array<string>, n_parents long, n_children long, batch long"
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(f"{store}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def ingest_batch(files: DataFrame, store: str, number: int) -> None:
    """Anti-join against the manifest, chunk, write the tables of this batch, the manifest last.

    Each batch has folders of its own, overwritten on a retry: a batch that failed half-way leaves nothing twice.
    """
    from tarn.storage import Scratch

    spark = files.sparkSession
    known = manifest(spark, store).where(F.col("batch") != number)
    scratch = Scratch(spark, "ingest")
    p = scratch.cut(pages_of(files), "pages")
    heads = p.groupBy("doc_id").agg(F.min("content_hash").alias("content_hash"), F.min("path").alias("path"), F.sum("chars_removed").cast("int").alias("chars_removed"), F.array_distinct(F.flatten(F.collect_list("suspicious"))).alias("suspicious"))
    k = known.where("status = 'loaded'").select("doc_id", F.col("content_hash").alias("_h"))
    heads = heads.join(k, "doc_id", "left")
    new = scratch.cut(heads.where("_h is null").drop("_h"), "new")
    clash = heads.where("_h is not null and _h <> content_hash").drop("_h")
    c = scratch.cut(chunk(p.join(new.select("doc_id"), "doc_id", "left_semi")), "chunks")
    children_of(c).write.mode("overwrite").parquet(f"{store}/children/batch={number}")
    parents_of(c).write.mode("overwrite").parquet(f"{store}/parents/batch={number}")
    n = c.groupBy("doc_id").agg(F.count_distinct("parent_id").alias("n_parents"), F.count("*").alias("n_children"))
    rows = new.join(n, "doc_id", "left").select("doc_id", "content_hash", "path", F.when(F.col("n_children") > 0, "loaded").otherwise("failed").alias("status"), "chars_removed", "suspicious", F.coalesce("n_parents", F.lit(0)).cast("long").alias("n_parents"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))
    bad = clash.select("doc_id", "content_hash", "path", F.lit("conflict").alias("status"), "chars_removed", "suspicious", F.lit(0).cast("long").alias("n_parents"), F.lit(0).cast("long").alias("n_children"))
    rows.unionByName(bad).write.mode("overwrite").parquet(f"{store}/manifest/batch={number}")


def verify(spark: SparkSession, store: str) -> dict[str, int | bool]:
    """Counts of the tables against the manifest."""
    m = manifest(spark, store).where("status = 'loaded'").agg(F.count("*").alias("d"), F.sum("n_parents").alias("p"), F.sum("n_children").alias("c")).first()
    p = spark.read.parquet(f"{store}/parents").count() if m.d else 0
    c = spark.read.parquet(f"{store}/children").count() if m.d else 0
    return {"documents": m.d, "parents": p, "children": c, "ok": (m.p or 0) == p and (m.c or 0) == c}
