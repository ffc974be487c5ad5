"""Streams: running k-mer counts over arriving sequences, and ingestion that skips what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.operators import kmers as K


def sequence_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_counts(stream: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, n) over both strands; run in update mode. The state is one row per distinct k-mer."""
    return K.count_kmers(stream, k, seq)


def windowed_counts(stream: DataFrame, k: int, at: str, width: str, late: str, seq: str = "seq") -> DataFrame:
    """(window, kmer, n) per time window; rows later than ``late`` are dropped and old windows leave the state."""
    rows = K.kmers(K.strands(K.fragments(stream.withWatermark(at, late).select(at, seq), k, seq), seq), k, seq)
    return rows.groupBy(F.window(at, width).alias("window"), "kmer").agg(F.count("*").alias("n"))


def ingest_new(stream: DataFrame, key: str, target: str, checkpoint: str, once: bool = True):
    """Append rows whose key isn't in ``target`` yet; a batch that is run again adds nothing."""

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
        except Exception as e:  # noqa: BLE001 - the target isn't there before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").parquet(target)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
