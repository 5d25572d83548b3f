"""The minimizer-sharded Bloom filter as a DataFrame of 256-bit shards, and the operators that build and probe it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.config import Config, shards_for
from kmerloom.errors import InvalidArgumentError
from kmerloom.functions import kmers as K
from kmerloom.functions import vector
from kmerloom.session import saved

from . import records as batches

WORDS = ("w0", "w1", "w2", "w3")
SCHEMA = "shard bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint"
#: A filter of at most so many bytes is broadcast to probes; its size is known from its number of shards.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 48
#: Distinct k-mers that are broadcast, 8 bytes each and some more.
FEW_KMERS = 1_000_000


def from_blob(batch: DataFrame, blob: str = "sequence", ranges: str = "records", keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts and their (sequence_offset, sequence_bytes) ranges as records: keep, record_index, input_offset, sequence."""
    text = K.as_bytes(F.col("__t"))
    r = F.col("__r")
    cut = text.substr((r["sequence_offset"] + 1).cast("int"), r["sequence_bytes"].cast("int"))
    out = batch.select(*keep, F.col(blob).alias("__t"), F.posexplode(ranges).alias("__i", "__r"))
    return out.select(*keep, F.col("__i").cast("long").alias("record_index"), r["sequence_offset"].alias("input_offset"), F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8").alias("sequence"))


def insert_report(records: DataFrame, config: Config, sequence: str = "sequence") -> DataFrame:
    """One row: records_indexed, indexed_bases, inserted_kmers (valid windows, each time they occur)."""
    return _report(records, config, sequence, ("records_indexed", "indexed_bases", "inserted_kmers"))


def _report(records: DataFrame, config: Config, sequence: str, names: tuple[str, str, str]) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return records.agg(F.count("*").alias(names[0]), zero(F.sum(F.octet_length(sequence))).alias(names[1]), zero(F.sum(K.valid_kmer_count(F.col(sequence), config))).alias(names[2]))


def attempted(records: DataFrame, config: Config, sequence: str = "sequence") -> DataFrame:
    """One row: attempted, all windows, valid or not."""
    return records.agg(F.coalesce(F.sum(K.kmer_count(F.col(sequence), config)), F.lit(0)).cast("long").alias("attempted"))


def masked(records: DataFrame, config: Config, num_shards: int, sequence: str, *keep: str) -> DataFrame:
    """keep, pos, packed, minimizer, shard, m0 to m3 of each valid window."""
    found = K.windows(records, config, sequence, *keep)
    return K.located(found.select(*keep, "pos", K.packed(F.col("kmer"), config).alias("packed")), config, num_shards)


def shards_of(kmers: DataFrame) -> DataFrame:
    """Shards from masks: partial OR before the shuffle, so a shard of very common k-mers is a row a task."""
    return kmers.groupBy("shard").agg(*(F.bit_or(m).alias(w) for m, w in zip(("m0", "m1", "m2", "m3"), WORDS, strict=True)))


@dataclass(frozen=True)
class KmerFilter:
    """An immutable filter. Shards that are all zero have no row."""

    config: Config
    num_shards: int
    shards: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, config: Config, filter_bits: int) -> KmerFilter:
        return cls(config, shards_for(filter_bits), spark.createDataFrame([], SCHEMA))

    @classmethod
    def build(cls, records: DataFrame, config: Config, filter_bits: int, sequence: str = "sequence") -> KmerFilter:
        n = shards_for(filter_bits)
        return cls(config, n, vector.build(records, config, n, sequence))

    @classmethod
    def by_expressions(cls, records: DataFrame, config: Config, filter_bits: int, sequence: str = "sequence") -> KmerFilter:
        """build() on Columns alone, without Python workers; the same shards."""
        n = shards_for(filter_bits)
        return cls(config, n, shards_of(masked(records, config, n, sequence)))

    @classmethod
    def of_packed(cls, kmers: DataFrame, config: Config, filter_bits: int, packed: str = "packed") -> KmerFilter:
        """From packed k-mers, one a row."""
        n = shards_for(filter_bits)
        return cls(config, n, shards_of(K.located(kmers, config, n, packed)))

    @property
    def filter_bits(self) -> int:
        return self.num_shards * Config.BLOCK_BITS

    @property
    def size_bytes(self) -> int:
        return self.filter_bits // 8

    def insert(self, records: DataFrame, sequence: str = "sequence") -> KmerFilter:
        return self.merge(KmerFilter.build(records, self.config, self.filter_bits, sequence))

    def merge(self, other: KmerFilter) -> KmerFilter:
        """The filter of both inputs."""
        if (self.config, self.num_shards) != (other.config, other.num_shards):
            raise InvalidArgumentError("filters of different configurations or sizes can't be merged")
        both = self.shards.unionByName(other.shards)
        return replace(self, shards=both.groupBy("shard").agg(*(F.bit_or(w).alias(w) for w in WORDS)))

    def clear(self) -> KmerFilter:
        return KmerFilter.empty(self.shards.sparkSession, self.config, self.filter_bits)

    def load(self) -> DataFrame:
        """One row: set_bits, load_factor."""
        bits = sum((F.bit_count(w) for w in WORDS[1:]), F.bit_count(WORDS[0]))
        return self.shards.agg(F.coalesce(F.sum(bits), F.lit(0)).cast("long").alias("set_bits")).withColumn("load_factor", F.col("set_bits") / F.lit(float(self.filter_bits)))

    def load_factor(self) -> float:
        return self.load().first().load_factor

    def save(self, path: str) -> None:
        self.shards.write.mode("overwrite").parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, config: Config, filter_bits: int, path: str) -> KmerFilter:
        return cls(config, shards_for(filter_bits), spark.read.schema(SCHEMA).parquet(path))

    def _held(self) -> DataFrame:
        return F.broadcast(self.shards) if self.num_shards * ROW_BYTES <= BROADCAST_BYTES else self.shards

    def probe(self, kmers: DataFrame) -> DataFrame:
        """kmers (with shard, m0 to m3) and hit: whether all their bits are set."""
        inside: Column = F.lit(True)
        for m, w in zip(("m0", "m1", "m2", "m3"), WORDS, strict=True):
            inside = inside & (F.col(w).bitwiseAND(F.col(m)) == F.col(m))
        return kmers.join(self._held(), "shard", "left").withColumn("hit", F.coalesce(inside, F.lit(False)).cast("tinyint")).drop(*WORDS)

    def contains(self, records: DataFrame, key: str = "record_index", sequence: str = "sequence") -> DataFrame:
        """key, pos, hit for each valid window; the others are misses."""
        return self.probe(masked(records, self.config, self.num_shards, sequence, key)).select(key, "pos", "hit")

    def contains_packed(self, kmers: DataFrame, packed: str = "packed") -> DataFrame:
        return self.probe(K.located(kmers, self.config, self.num_shards, packed)).drop("minimizer", "shard", "m0", "m1", "m2", "m3")

    def query_records(self, records: DataFrame, key: str = "record_index", sequence: str = "sequence", hits: bool = False, held: int = vector.HELD_BYTES) -> DataFrame:
        """A row for each record, also where it has no window: key, queried_bases, queried_kmers, positive_kmers; hits: array with 1 or 0 for every window.

        A filter of at most `held` bytes goes to every worker; a larger one is joined by shard, a row for each run of neighbouring windows with one shard.
        """
        if self.num_shards * 32 <= min(held, vector.HELD_BYTES):
            return vector.probe(records, vector.table(self.shards, self.num_shards), self.config, key, sequence, hits)
        found = vector.looked_up(vector.runs(records, self.num_shards, self.config, key, sequence).join(self.shards, "shard", "left"), self.config)
        of = found.groupBy("id").agg(F.max("k").alias(key), F.max("bases").alias("queried_bases"), F.max("windows").alias("n"), F.max("valid").alias("queried_kmers"), F.sum("positive").alias("positive_kmers"), *[F.flatten(F.collect_list("at")).alias("at")] * hits)
        if hits:  # of one record: zeros up to each hit and after the last
            at = F.concat(F.array(F.lit(-1)), F.array_sort("at"), F.array(F.col("n").cast("int")))
            zeros = lambda n: F.array_repeat(F.lit(0).cast("tinyint"), n)
            gaps = F.transform(F.array(at), lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.concat(zeros(a[i] - a[i - 1] - 1), F.when(i < F.size(a) - 1, F.array(F.lit(1).cast("tinyint"))).otherwise(zeros(0)))))[0]
            of = of.withColumn("hits", F.flatten(gaps))
        return of.select(key, "queried_bases", "queried_kmers", "positive_kmers", *["hits"] * hits)

    def query_report(self, records: DataFrame, key: str = "record_index", sequence: str = "sequence") -> DataFrame:
        """One row: records_queried, queried_bases, queried_kmers, positive_kmers."""
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
        return self.query_records(records, key, sequence).agg(F.count("*").alias("records_queried"), *map(zero, ("queried_bases", "queried_kmers", "positive_kmers")))

    def query_batch(self, records: DataFrame, group: str = "batch", sequence: str = "sequence") -> DataFrame:
        """group, hits: a mark for each window of a batch's joined text; windows over a separator are misses."""
        joined = batches.joined_text(records, self.config, sequence, group)
        return self.query_records(joined, group, "normalized", hits=True).select(group, "hits")

    def query_batch_records(self, records: DataFrame, group: str = "batch", sequence: str = "sequence") -> DataFrame:
        """group, record_index, hits: each record's slice of its batch's marks."""
        where = batches.layout(batches.normalized(records, self.config, sequence, group), self.config, group)
        cut = F.slice("hits", (F.col("hit_offset") + 1).cast("int"), F.col("hit_count").cast("int"))
        return where.join(self.query_batch(records, group, sequence), group).select(group, "record_index", cut.alias("hits"))

    def query_fastx(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """For records of files (file, record_index, header, sequence): a row for each with its counts, and one with the totals."""
        named = records.withColumn("__r", F.struct("file", "record_index", "header"))
        rows = self.query_records(named, "__r").select("__r.*", "queried_bases", "queried_kmers", "positive_kmers")
        return rows, self.query_report(records)

    def for_each(self, records: DataFrame, consume, key: str = "record_index", sequence: str = "sequence") -> dict:
        """Hand each record's row to consume in order of key; what it raises ends the query. Returns the totals."""
        totals = {"records_queried": 0, "queried_bases": 0, "queried_kmers": 0, "positive_kmers": 0}
        for row in self.query_records(records, key, sequence, hits=True).orderBy(key).toLocalIterator():
            totals["records_queried"] += 1
            for c in ("queried_bases", "queried_kmers", "positive_kmers"):
                totals[c] += row[c]
            consume(row)
        return totals


def blocked(config: Config) -> Config:
    """The plain blocked Bloom filter of the same k-mers and hashes: the block is chosen by the whole k-mer, and so are its bits."""
    return replace(config, m=config.k, s=config.k)


def any_count(count: Column) -> Column:
    """A counting filter's answer as a hit."""
    return (count > 0).cast("tinyint")


def metrics(flt: KmerFilter, items: int) -> dict[str, float]:
    """A filter's size, and how many bits it has for each of `items` k-mers."""
    return {"filter_bits": flt.filter_bits, "memory_bytes": flt.size_bytes, "items": items, "bits_per_item": flt.filter_bits / items if items else 0.0}


def exact_semi(queries: DataFrame, members: DataFrame, kmer: str = "packed") -> DataFrame:
    """Query k-mers that were inserted: the exact counterpart of a probe."""
    return queries.join(_of_queries(queries, members, kmer), kmer, "left_semi")


def exact_anti(queries: DataFrame, members: DataFrame, kmer: str = "packed") -> DataFrame:
    return queries.join(_of_queries(queries, members, kmer), kmer, "left_anti")


def _of_queries(queries: DataFrame, members: DataFrame, kmer: str) -> DataFrame:
    """The distinct members that may be among the queries. Where the queries' distinct k-mers are few enough to broadcast, the others leave before the exchange."""
    own = saved(queries.select(kmer).distinct(), "queried")
    members = members.select(kmer)
    if own.count() <= FEW_KMERS:
        members = members.join(F.broadcast(own), kmer, "left_semi")
    return members.distinct()


def false_positive_rate(flt: KmerFilter, members: DataFrame, queries: DataFrame, packed: str = "packed") -> DataFrame:
    """One row: queries (distinct k-mers that were not inserted), false_positives, fpr_percentage."""
    outside = exact_anti(queries.select(packed).distinct(), members, packed)
    hits = flt.contains_packed(outside, packed)
    return hits.agg(F.count("*").alias("queries"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("false_positives")).withColumn("fpr_percentage", F.when(F.col("queries") > 0, F.col("false_positives") * 100.0 / F.col("queries")).otherwise(F.lit(0.0)))
