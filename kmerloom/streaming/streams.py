"""Building and probing a filter from streams. A filter only ever gains bits, so a batch that is replayed changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kmerloom.config import Config, shards_for
from kmerloom.operators.filter import SCHEMA, KmerFilter, masked, shards_of


def shard_stream(records: DataFrame, config: Config, filter_bits: int, sequence: str = "sequence") -> DataFrame:
    """A streaming aggregation of shards, for output mode `update` or `complete`; its state is a row a shard."""
    return shards_of(masked(records, config, shards_for(filter_bits), sequence))


def build_into(records: DataFrame, config: Config, filter_bits: int, path: str, checkpoint: str, sequence: str = "sequence", **trigger) -> StreamingQuery:
    """Keep a filter under `path` up to date. Each micro-batch writes its own shards as version=<batch>; open_built() ORs all versions."""

    def batch(df: DataFrame, number: int) -> None:
        KmerFilter.build(df, config, filter_bits, sequence).shards.write.mode("overwrite").parquet(f"{path}/version={number}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def open_built(spark: SparkSession, config: Config, filter_bits: int, path: str) -> KmerFilter:
    rows = spark.read.schema(SCHEMA + ", version bigint").parquet(path)
    shards = rows.groupBy("shard").agg(*(F.bit_or(w).alias(w) for w in ("w0", "w1", "w2", "w3")))
    return KmerFilter(config, shards_for(filter_bits), shards)


def probe_stream(records: DataFrame, flt: KmerFilter, key: str = "record_index", sequence: str = "sequence") -> DataFrame:
    """key, pos, hit of a stream's windows against a filter that stays as it is (append mode)."""
    return flt.contains(records, key, sequence)


def consume(records: DataFrame, flt: KmerFilter, consumer: Callable, checkpoint: str, key: str = "record_index", sequence: str = "sequence") -> StreamingQuery:
    """Hand each micro-batch's per-record rows to consumer(DataFrame)."""
    return records.writeStream.foreachBatch(lambda df, _: consumer(flt.query_records(df, key, sequence, hits=True))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
