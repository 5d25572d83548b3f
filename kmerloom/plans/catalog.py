"""The registered queries and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.config import DNA, DNA_TRIPLET, PROTEIN, Alphabet, Config, bits_for, shards_for
from kmerloom.functions import dense, kmers, vector
from kmerloom.operators import analysis, records
from kmerloom.operators.filter import WORDS, KmerFilter, any_count, attempted, blocked, exact_anti, exact_semi, false_positive_rate, insert_report, masked, metrics
from kmerloom.session import shared, ship
from kmerloom.sources import fastx
from kmerloom.streaming import streams

from . import sql

FLAGSHIP = "query_records"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

BITS = 1 << 20
SHARDS = shards_for(BITS)
RESIDUES = Config(8, 6, 4, 4, PROTEIN)
BASES = Config(12, 9, 5, 4, DNA)
CODONS = Config(4, 3, 2, 4, DNA_TRIPLET)

#: Adapters: texts as residues; hashes of keys as bases, with N for one hex digit of sixteen.
DOCS, BENCH, ORDERS = "SELECT doc_id AS key, text AS seq FROM documents", "SELECT item_id AS key, text AS seq FROM benchmark", "SELECT o_orderkey AS key, translate(md5(o_orderkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq FROM orders"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("seq"))


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("seq"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    dna = F.translate(F.md5(F.col("o_orderkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGN")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), dna.alias("seq"))


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            ORACLE_SQL[name] = text
        return f

    return add


def _windows(name: str, source, src: str, cfg: Config) -> None:
    query(f"kmer_windows_{name}", f"WITH {sql.windows(cfg, src)} SELECT key, pos, kmer FROM win")(lambda spark, d: kmers.windows(source(spark, d), cfg, "seq", "key"))
    query(f"kmer_packed_{name}", f"WITH {sql.packed(cfg, src)} SELECT key, pos, {sql.signed('p')} AS packed FROM win_p")(lambda spark, d: kmers.windows(source(spark, d), cfg, "seq", "key").select("key", "pos", kmers.packed(F.col("kmer"), cfg).alias("packed")))


_windows("protein", docs, DOCS, RESIDUES)
_windows("dna", orders, ORDERS, BASES)
_windows("triplet", orders, ORDERS, CODONS)

#: An alphabet of the user's own: hex digits, over the keys' hashes as they are.
HEX = Config(10, 7, 4, 4, Alphabet("hex", {ord(c): int(c, 16) for c in "0123456789abcdefABCDEF"}, 16, "-"))
HEXES = "SELECT o_orderkey AS key, md5(o_orderkey::VARCHAR) || '-' || md5('x' || o_orderkey) AS seq FROM orders"


def hexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.md5(c.cast("binary"))
    key = F.col("o_orderkey").cast("string")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.concat_ws("-", digest(key), digest(F.concat(F.lit("x"), key))).alias("seq"))


_windows("custom", hexes, HEXES, HEX)


@query("record_kmer_counts", f"WITH r AS (SELECT key, {sql.as_bytes('seq')} AS b FROM ({DOCS})) SELECT key, length(b)::BIGINT AS bytes, length(b)::BIGINT AS symbols, greatest(length(b) - {RESIDUES.k - 1}, 0)::BIGINT AS attempted, {sql.valid_count(RESIDUES)} AS valid FROM r")
def record_kmer_counts(spark, d):
    s = F.col("seq")
    return docs(spark, d).select("key", F.octet_length(s).cast("long").alias("bytes"), kmers.symbol_count(s, PROTEIN).alias("symbols"), kmers.kmer_count(s, RESIDUES).alias("attempted"), kmers.valid_kmer_count(s, RESIDUES).alias("valid"))


@query("triplet_counts", f"WITH {sql.windows(CODONS, ORDERS)} SELECT b.key, (length(b) // 3)::BIGINT AS symbols, greatest(length(b) // 3 - {CODONS.k - 1}, 0)::BIGINT AS attempted, (SELECT count(*) FROM win WHERE win.key = b.key)::BIGINT AS valid FROM win_b b")
def triplet_counts(spark, d):
    s = F.col("seq")
    return orders(spark, d).select("key", kmers.symbol_count(s, DNA_TRIPLET).alias("symbols"), kmers.kmer_count(s, CODONS).alias("attempted"), kmers.valid_kmer_count(s, CODONS).alias("valid"))


@query("invalid_symbol_scan", f"SELECT key, regexp_full_match({sql.as_bytes('seq')}, '{sql.letters(BASES)}*') AS all_valid FROM ({ORDERS})")
def invalid_symbol_scan(spark, d):
    return orders(spark, d).select("key", kmers.all_valid(F.col("seq"), DNA).alias("all_valid"))


@query("kmer_spectrum", f"WITH {sql.packed(RESIDUES, DOCS)} SELECT {sql.signed('p')} AS packed, count(*) AS n FROM win_p GROUP BY p")
def kmer_spectrum(spark, d):
    return kmers.spectrum(_packed(docs(spark, d), RESIDUES))


@query("kmer_distinct", f"WITH {sql.packed(RESIDUES, DOCS)} SELECT count(*)::BIGINT AS windows, count(DISTINCT p)::BIGINT AS distinct_kmers FROM win_p")
def kmer_distinct(spark, d):
    s = kmers.spectrum(_packed(docs(spark, d), RESIDUES))
    return s.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("windows"), F.count("*").alias("distinct_kmers"))


def _packed(source: DataFrame, cfg: Config, *keep: str) -> DataFrame:
    return kmers.windows(source, cfg, "seq", *(c for c in keep if c != "pos")).select(*keep, kmers.packed(F.col("kmer"), cfg).alias("packed"))


@query("minimizer_shards", f"WITH {sql.located(BASES, SHARDS, ORDERS)} SELECT key, pos, {sql.signed('mini')} AS minimizer, shard FROM win_l")
def minimizer_shards(spark, d):
    return masked(orders(spark, d), BASES, SHARDS, "seq", "key").select("key", "pos", "minimizer", "shard")


@query("smer_hashes", f"WITH {sql.located(BASES, SHARDS, ORDERS)}, x AS (SELECT key, pos, unnest([{', '.join(f'{{o: {o}, h: h{o}}}' for o in range(BASES.smer_span))}]) AS s FROM win_l) SELECT key, pos, s.o AS o, {sql.signed('s.h')} AS hash FROM x")
def smer_hashes(spark, d):
    k = kmers.windows(orders(spark, d), BASES, "seq", "key").select("key", "pos", kmers.packed(F.col("kmer"), BASES).alias("packed"))
    return k.select("key", "pos", F.posexplode(kmers.smer_hashes(F.col("packed"), BASES)).alias("o", "hash"))


@query("super_kmers", f"""WITH {sql.located(BASES, SHARDS, ORDERS)}, h AS (SELECT key, pos, shard, CASE WHEN lag(shard) OVER w = shard AND lag(pos) OVER w = pos - 1 THEN 0 ELSE 1 END AS head FROM win_l WINDOW w AS (PARTITION BY key ORDER BY pos)),
r AS (SELECT key, pos, shard, sum(head) OVER (PARTITION BY key ORDER BY pos) AS run FROM h) SELECT key, shard, min(pos)::BIGINT AS start, count(*) AS n FROM r GROUP BY key, run, shard""")
def super_kmers(spark, d):
    return kmers.super_kmers(masked(orders(spark, d), BASES, SHARDS, "seq", "key").select("key", "pos", "shard"), "key")


_SHARD_COLUMNS = ", ".join(f"{sql.signed(w)} AS {w}" for w in WORDS)


def _build(h: int) -> None:
    cfg = replace(RESIDUES, hashes=h)
    query(f"filter_build_shards_h{h}", f"WITH {sql.located(cfg, SHARDS, BENCH)}, {sql.built()} SELECT shard, {_SHARD_COLUMNS} FROM flt")(lambda spark, d: KmerFilter.build(bench(spark, d), cfg, BITS, "seq").shards)


for _h in (4, 8, 12, 16):
    _build(_h)

_FILTER = f"{sql.located(RESIDUES, SHARDS, DOCS)}, {sql.built()}"
_SET_BITS = "coalesce(sum(bit_count(w0)::INT + bit_count(w1)::INT + bit_count(w2)::INT + bit_count(w3)::INT), 0)"


def _of_docs(spark, d) -> KmerFilter:
    return KmerFilter.build(docs(spark, d), RESIDUES, BITS, "seq")


@query("filter_build_vectorised", f"WITH {_FILTER} SELECT shard, {_SHARD_COLUMNS} FROM flt")
def filter_build_vectorised(spark, d):
    return vector.build(docs(spark, d), RESIDUES, SHARDS, "seq")


@query("filter_load_factor", f"WITH {_FILTER} SELECT {_SET_BITS}::BIGINT AS set_bits, {_SET_BITS}::DOUBLE / {BITS} AS load_factor FROM flt")
def filter_load_factor(spark, d):
    return _of_docs(spark, d).load()


_TWO = f"{sql.located(RESIDUES, SHARDS, DOCS, 'win')}, {sql.built()}, {sql.located(RESIDUES, SHARDS, BENCH, 'q')}, probe AS (SELECT q_l.*, {sql.HIT} AS hit FROM q_l LEFT JOIN flt USING (shard))"


@query("filter_contains", f"WITH {_TWO} SELECT key, pos, hit::TINYINT AS hit FROM probe")
def filter_contains(spark, d):
    return _of_docs(spark, d).contains(bench(spark, d), "key", "seq")


_RECORDS = f"r AS (SELECT key, {sql.as_bytes('seq')} AS b FROM ({BENCH})), pos AS (SELECT key, count(*) FILTER (hit) AS n FROM probe GROUP BY key)"


@query("query_records", f"WITH {_TWO}, {_RECORDS} SELECT r.key, length(b)::BIGINT AS queried_bases, {sql.valid_count(RESIDUES)} AS queried_kmers, coalesce(pos.n, 0)::BIGINT AS positive_kmers FROM r LEFT JOIN pos ON r.key = pos.key")
def query_records(spark, d):
    return _of_docs(spark, d).query_records(bench(spark, d), "key", "seq")


@query("query_records_hits", f"WITH {_TWO}, {_RECORDS}, hit_at AS (SELECT key, list(pos) AS ps FROM probe WHERE hit GROUP BY key) SELECT r.key, array_to_string(list_transform(range(0, greatest(length(b) - {RESIDUES.k - 1}, 0)), lambda i: CASE WHEN list_contains(coalesce(ps, []), i::INT) THEN '1' ELSE '0' END), '') AS hits FROM r LEFT JOIN hit_at ON r.key = hit_at.key")
def query_records_hits(spark, d):
    return _of_docs(spark, d).query_records(bench(spark, d), "key", "seq", hits=True).select("key", F.array_join(F.col("hits").cast("array<string>"), "").alias("hits"))


@query("query_vectorised", f"WITH {_TWO}, {_RECORDS} SELECT r.key, {sql.valid_count(RESIDUES)} AS queried_kmers, coalesce(pos.n, 0)::BIGINT AS positive_kmers FROM r LEFT JOIN pos ON r.key = pos.key")
def query_vectorised(spark, d):
    words = vector.table(vector.build(docs(spark, d), RESIDUES, SHARDS, "seq"), SHARDS)
    return vector.probe(bench(spark, d), words, RESIDUES, "key", "seq").drop("queried_bases")


@query("query_records_joined", f"WITH {_TWO}, {_RECORDS}, hit_at AS (SELECT key, list(pos) AS ps FROM probe WHERE hit GROUP BY key) SELECT r.key, length(b)::BIGINT AS queried_bases, {sql.valid_count(RESIDUES)} AS queried_kmers, coalesce(pos.n, 0)::BIGINT AS positive_kmers, array_to_string(list_transform(range(0, greatest(length(b) - {RESIDUES.k - 1}, 0)), lambda i: CASE WHEN list_contains(coalesce(ps, []), i::INT) THEN '1' ELSE '0' END), '') AS hits FROM r LEFT JOIN hit_at ON r.key = hit_at.key LEFT JOIN pos ON r.key = pos.key")
def query_records_joined(spark, d):
    rows = _of_docs(spark, d).query_records(bench(spark, d), "key", "seq", hits=True, held=0)
    return rows.withColumn("hits", F.array_join(F.col("hits").cast("array<string>"), ""))


@query("record_sink", f"WITH {_TWO}, {_RECORDS} SELECT r.key, coalesce(pos.n, 0)::BIGINT AS positive_kmers FROM r LEFT JOIN pos ON r.key = pos.key")
def record_sink(spark, d):
    rows: list[tuple] = []
    total = _of_docs(spark, d).for_each(bench(spark, d), lambda r: rows.append((r["key"], r["positive_kmers"])), "key", "seq")
    assert total["records_queried"] == len(rows)
    return spark.createDataFrame(rows, "key bigint, positive_kmers bigint")


@query("stream_probe", f"WITH {_TWO} SELECT key, pos, hit::TINYINT AS hit FROM probe")
def stream_probe(spark, d):
    source, out = shared(spark, "probe-stream"), shared(spark, "probe-hits")
    bench(spark, d).repartition(4).write.parquet(source)
    stream = spark.readStream.schema("key bigint, seq string").option("maxFilesPerTrigger", 2).parquet(source)
    hits = streams.probe_stream(stream, _of_docs(spark, d), "key", "seq")
    hits.writeStream.format("parquet").option("checkpointLocation", shared(spark, "offsets")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("key bigint, pos int, hit tinyint").parquet(out)


@query("counting_filter_hits", f"WITH {sql.packed(RESIDUES, DOCS, 'win')}, {sql.packed(RESIDUES, BENCH, 'q')}, n AS (SELECT p, count(*) AS n FROM win_p GROUP BY p) SELECT key, pos, coalesce(n, 0)::BIGINT AS n, (coalesce(n, 0) > 0)::TINYINT AS hit FROM q_p LEFT JOIN n USING (p)")
def counting_filter_hits(spark, d):
    counts = kmers.spectrum(_packed(docs(spark, d), RESIDUES))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return _packed(bench(spark, d), RESIDUES, "key", "pos").join(counts, "packed", "left").select("key", "pos", n.alias("n"), any_count(n).alias("hit"))


@query("query_report", f"WITH {_TWO}, {_RECORDS} SELECT count(*) AS records_queried, sum(length(b))::BIGINT AS queried_bases, sum({sql.valid_count(RESIDUES)})::BIGINT AS queried_kmers, (SELECT count(*) FILTER (hit) FROM probe)::BIGINT AS positive_kmers FROM r")
def query_report(spark, d):
    return _of_docs(spark, d).query_report(bench(spark, d), "key", "seq")


@query("insert_report", f"SELECT count(*) AS records_indexed, sum(length(b))::BIGINT AS indexed_bases, sum({sql.valid_count(RESIDUES)})::BIGINT AS inserted_kmers FROM (SELECT {sql.as_bytes('seq')} AS b FROM ({DOCS}))")
def report_of_insert(spark, d):
    return insert_report(docs(spark, d), RESIDUES, "seq")


@query("attempted_windows", f"SELECT sum(greatest(length(b) - {RESIDUES.k - 1}, 0))::BIGINT AS attempted FROM (SELECT {sql.as_bytes('seq')} AS b FROM ({DOCS}))")
def attempted_windows(spark, d):
    return attempted(docs(spark, d), RESIDUES, "seq")


@query("filter_metrics", f"""WITH n AS (SELECT sum({sql.valid_count(RESIDUES)})::BIGINT AS items FROM (SELECT {sql.as_bytes('seq')} AS b FROM ({DOCS}))),
b AS (SELECT items, list_min(list_filter(list_transform(range(0, 62), lambda i: 1::BIGINT << i::INT), lambda x: x >= items * 16)) AS filter_bits FROM n)
SELECT filter_bits, filter_bits // 8 AS memory_bytes, items, filter_bits / items::DOUBLE AS bits_per_item FROM b""")
def filter_metrics(spark, d):
    n = insert_report(docs(spark, d), RESIDUES, "seq").first().inserted_kmers
    m = metrics(KmerFilter.empty(spark, RESIDUES, bits_for(n)), n)
    return spark.createDataFrame([tuple(m.values())], "filter_bits bigint, memory_bytes bigint, items bigint, bits_per_item double")


_UNION = f"WITH {sql.located(RESIDUES, SHARDS, f'{DOCS} UNION ALL {BENCH}')}, {sql.built()} SELECT {_SET_BITS}::BIGINT AS set_bits FROM flt"


@query("filter_union", _UNION)
def filter_union(spark, d):
    return _of_docs(spark, d).merge(KmerFilter.build(bench(spark, d), RESIDUES, BITS, "seq")).load().select("set_bits")


@query("filter_insert_twice", _UNION)
def filter_insert_twice(spark, d):
    return _of_docs(spark, d).insert(bench(spark, d), "seq").insert(bench(spark, d), "seq").load().select("set_bits")


@query("filter_clear", "SELECT 0::BIGINT AS set_bits, 0.0::DOUBLE AS load_factor")
def filter_clear(spark, d):
    return _of_docs(spark, d).clear().load()


@query("filter_saved", f"WITH {_FILTER} SELECT shard, {_SHARD_COLUMNS} FROM flt")
def filter_saved(spark, d):
    path = shared(spark, "filter")
    _of_docs(spark, d).save(path)
    return KmerFilter.open(spark, RESIDUES, BITS, path).shards


_EXACT = f"{sql.packed(RESIDUES, DOCS, 'win')}, {sql.packed(RESIDUES, BENCH, 'q')}"


@query("exact_semi_join", f"WITH {_EXACT} SELECT key, {sql.signed('p')} AS packed FROM q_p WHERE p IN (SELECT p FROM win_p)")
def exact_semi_join(spark, d):
    return exact_semi(_packed(bench(spark, d), RESIDUES, "key"), _packed(docs(spark, d), RESIDUES))


@query("exact_anti_join", f"WITH {_EXACT} SELECT key, {sql.signed('p')} AS packed FROM q_p WHERE p NOT IN (SELECT p FROM win_p)")
def exact_anti_join(spark, d):
    return exact_anti(_packed(bench(spark, d), RESIDUES, "key"), _packed(docs(spark, d), RESIDUES))


_FPR = Config(8, 6, 4, 4, DNA)
_OTHERS = "SELECT o_custkey AS key, translate(md5('c' || o_custkey), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM orders"


def _fpr_sql(cfg: Config) -> str:
    return f"""WITH {sql.located(cfg, 64, ORDERS, 'win')}, {sql.built()}, {sql.located(cfg, 64, _OTHERS, 'q')},
out AS (SELECT DISTINCT p, shard, m0, m1, m2, m3 FROM q_l WHERE p NOT IN (SELECT p FROM win_p)), probe AS (SELECT {sql.HIT} AS hit FROM out LEFT JOIN flt USING (shard))
SELECT count(*) AS queries, count(*) FILTER (hit) AS false_positives, count(*) FILTER (hit) * 100.0::DOUBLE / count(*) AS fpr_percentage FROM probe"""


def _fpr(spark, d, cfg: Config) -> DataFrame:
    other = _table(spark, d, "orders").select(F.translate(F.md5(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))
    flt = KmerFilter.build(orders(spark, d), cfg, 64 * 256, "seq")
    return false_positive_rate(flt, _packed(orders(spark, d), cfg), _packed(other, cfg))


@query("false_positive_rate", _fpr_sql(_FPR))
def fpr(spark, d):
    return _fpr(spark, d, _FPR)


#: Filters of one size with longer and longer s-mers, and the plain blocked Bloom filter.
_LADDER = {f"s={s}": replace(_FPR, s=s) for s in (5, 6, 7)} | {"blocked": blocked(_FPR)}


@query("fpr_ladder", " UNION ALL ".join(f"SELECT '{n}' AS filter, * FROM ({_fpr_sql(c)})" for n, c in _LADDER.items()))
def fpr_ladder(spark, d):
    rows = [_fpr(spark, d, c).select(F.lit(n).alias("filter"), "*") for n, c in _LADDER.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("blocked_bloom_build", f"WITH {sql.located(blocked(RESIDUES), SHARDS, BENCH)}, {sql.built()} SELECT shard, {_SHARD_COLUMNS} FROM flt")
def blocked_bloom_build(spark, d):
    return KmerFilter.build(bench(spark, d), blocked(RESIDUES), BITS, "seq").shards


_DENSE = f"d AS (SELECT key, seq, length(seq) AS n, list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN strpos('ACTG', substr(seq, i::INT, 1)) > 0 THEN (strpos('ACTG', substr(seq, i::INT, 1)) - 1)::UBIGINT ELSE 3::UBIGINT END) AS c FROM ({ORDERS}))"


@query("dense_pack", f"WITH {_DENSE}, w AS (SELECT key, n, unnest(range(0, (n + 31) // 32)) AS w, c FROM d) SELECT key, w, {sql.signed('x')} AS word FROM (SELECT key, w, list_reduce(list_transform(range(0, least(32, n - w * 32)), lambda i: c[w * 32 + i + 1] << (2 * i)), lambda a, b: a | b) AS x FROM w)")
def dense_pack(spark, d):
    return orders(spark, d).select("key", F.posexplode(dense.pack(F.col("seq"), DNA)).alias("w", "word")).select("key", F.col("w").cast("long").alias("w"), "word")


@query("dense_unpack", f"WITH {_DENSE} SELECT key, n::BIGINT AS symbols, array_to_string(list_transform(c, lambda x: substr('ACTG', x::INT + 1, 1)), '') AS sequence FROM d")
def dense_unpack(spark, d):
    n = kmers.symbol_count(F.col("seq"), DNA)
    packed = orders(spark, d).select("key", dense.pack(F.col("seq"), DNA).alias("words"), n.alias("symbols"))
    letters = F.transform(dense.codes(F.col("words"), F.col("symbols"), DNA), lambda c: F.lit("ACTG").substr((c + 1).cast("int"), F.lit(1)))
    return packed.where(dense.check(F.col("words"), F.col("symbols"), DNA)).select("key", "symbols", F.array_join(letters, "").alias("sequence"))


@query("dense_kmers", f"WITH {sql.packed(BASES, ORDERS.replace('ACGTACGTACGTACGN', 'ACGTACGTACGTACGG'))} SELECT key, pos, {sql.signed('p')} AS packed FROM win_p")
def dense_kmers(spark, d):
    n = kmers.symbol_count(F.col("seq"), DNA)
    packed = orders(spark, d).select("key", dense.pack(F.col("seq"), DNA).alias("words"), n.alias("symbols"))
    return packed.select("key", F.posexplode(dense.packed_kmers(F.col("words"), F.col("symbols"), BASES)).alias("pos", "packed"))


@query("insert_dense", f"WITH {sql.located(BASES, SHARDS, ORDERS.replace('ACGTACGTACGTACGN', 'ACGTACGTACGTACGG'))}, {sql.built()} SELECT shard, {_SHARD_COLUMNS} FROM flt")
def insert_dense(spark, d):
    return KmerFilter.of_packed(dense_kmers(spark, d), BASES, BITS).shards


def _batches(spark, d) -> DataFrame:
    """Order lines' keys as batches of records: one batch an order."""
    dna = F.translate(F.substring(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber").cast("binary")), 1, 3 + 3 * 2), "0123456789abcdef", "ACGTACGTACGTACGN")
    return _table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c")).select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").cast("long").alias("record_index"), dna.alias("sequence"))


_RECORD_BATCHES = "SELECT DISTINCT l_orderkey AS batch, l_linenumber::BIGINT AS record_index, translate(substr(md5(l_orderkey || '-' || l_linenumber), 1, 9), '0123456789abcdef', 'ACGTACGTACGTACGN') AS sequence FROM lineitem"
_SHORT = Config(5, 4, 3, 4, DNA)
_META = f"r AS ({_RECORD_BATCHES}), n AS (SELECT batch, record_index, coalesce(sum(length(sequence)) OVER (PARTITION BY batch ORDER BY record_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS input_offset, length(sequence)::BIGINT AS size, {sql.valid_count(_SHORT, 'sequence')} AS valid_kmers FROM r)"


@query("normalized_batch", f"WITH {_META} SELECT * FROM n")
def normalized_batch(spark, d):
    return records.normalized(_batches(spark, d), _SHORT, group="batch")


@query("query_layout", f"WITH {_META} SELECT *, (input_offset + row_number() OVER (PARTITION BY batch ORDER BY record_index) - 1)::BIGINT AS hit_offset, greatest(size - 4, 0)::BIGINT AS hit_count FROM n")
def query_layout(spark, d):
    return records.layout(records.normalized(_batches(spark, d), _SHORT, group="batch"), _SHORT, group="batch")


@query("joined_text", f"WITH {_META} SELECT batch, string_agg(sequence, 'N' ORDER BY record_index) AS normalized FROM r GROUP BY batch")
def joined_text(spark, d):
    return records.joined_text(_batches(spark, d), _SHORT, group="batch")


@query("batch_range_validation", f"""WITH {_META}, x AS (SELECT batch, record_index, input_offset - (CASE WHEN batch % 7 = 0 AND record_index = 2 THEN 1 ELSE 0 END) AS o, size, sum(size) OVER (PARTITION BY batch) - (CASE WHEN batch % 11 = 0 THEN 1 ELSE 0 END) AS total FROM n),
y AS (SELECT *, lag(o + size) OVER (PARTITION BY batch ORDER BY record_index) AS before FROM x)
SELECT batch, record_index, CASE WHEN o < 0 OR o + size > total THEN 'record range is out of bounds' WHEN before > o THEN 'record ranges overlap or are out of order' END AS problem FROM y""")
def batch_range_validation(spark, d):
    from pyspark.sql.window import Window

    n = records.normalized(_batches(spark, d), _SHORT, group="batch")
    total = F.sum("size").over(Window.partitionBy("batch")) - F.when(F.col("batch") % 11 == 0, 1).otherwise(0)
    moved = F.col("input_offset") - F.when((F.col("batch") % 7 == 0) & (F.col("record_index") == 2), 1).otherwise(0)
    ranges = n.select("batch", "record_index", moved.alias("sequence_offset"), F.col("size").alias("sequence_bytes"), total.alias("total_bytes"))
    return records.validated(ranges, _SHORT, group="batch").select("batch", "record_index", "problem")


@query("batch_from_blob", f"WITH {_META} SELECT batch, (row_number() OVER (PARTITION BY batch ORDER BY record_index) - 1)::BIGINT AS record_index, input_offset, sequence FROM n JOIN r USING (batch, record_index)")
def batch_from_blob(spark, d):
    from kmerloom.operators.filter import from_blob

    b = _batches(spark, d)
    meta = records.normalized(b, _SHORT, group="batch").join(b, ["batch", "record_index"])
    blob = meta.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("record_index", "input_offset", "size", "sequence"))).alias("rs")).select("batch", F.array_join(F.transform("rs", lambda r: r["sequence"]), "").alias("sequence"), F.transform("rs", lambda r: F.struct(r["input_offset"].alias("sequence_offset"), r["size"].alias("sequence_bytes"))).alias("records"))
    return from_blob(blob.withColumn("sequence", F.col("sequence")), keep=("batch",))


_JOINED = f"""{_META}, {sql.located(_SHORT, 64, f"SELECT batch AS key, sequence AS seq FROM ({_RECORD_BATCHES}) WHERE batch % 2 = 0")}, {sql.built()},
{sql.located(_SHORT, 64, f"SELECT batch AS key, string_agg(sequence, 'N' ORDER BY record_index) AS seq FROM ({_RECORD_BATCHES}) GROUP BY batch", 'q')},
hit_at AS (SELECT key, list(pos) FILTER ({sql.HIT}) AS ps FROM q_l LEFT JOIN flt USING (shard) GROUP BY key),
flat AS (SELECT q_b.key AS batch, array_to_string(list_transform(range(0, greatest(length(b) - 4, 0)), lambda i: CASE WHEN list_contains(coalesce(ps, []), i::INT) THEN '1' ELSE '0' END), '') AS hits FROM q_b LEFT JOIN hit_at ON q_b.key = hit_at.key)"""


def _of_even(spark, d) -> KmerFilter:
    return KmerFilter.build(_batches(spark, d).where("batch % 2 = 0"), _SHORT, 64 * 256)


def _marks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hits", F.array_join(F.col("hits").cast("array<string>"), ""))


@query("batch_hits", f"WITH {_JOINED} SELECT batch, hits FROM flat")
def batch_hits(spark, d):
    return _marks(_of_even(spark, d).query_batch(_batches(spark, d)))


@query("batch_hit_slices", f"WITH {_JOINED}, o AS (SELECT *, input_offset + row_number() OVER (PARTITION BY batch ORDER BY record_index) - 1 AS hit_offset FROM n) SELECT batch, record_index, substr(hits, hit_offset + 1, greatest(size - 4, 0)) AS hits FROM o JOIN flat USING (batch)")
def batch_hit_slices(spark, d):
    return _marks(_of_even(spark, d).query_batch_records(_batches(spark, d)))


def _runs(spark, d) -> DataFrame:
    """Order lines as benchmark rows: parameters, throughput, size."""
    return _table(spark, d, "lineitem").select((F.col("l_linenumber") + 20).cast("long").alias("s"), (F.col("l_orderkey") % 5 * 2 + 8).cast("long").alias("m"), (F.col("l_partkey") % 4 * 4 + 4).cast("long").alias("h"), F.col("l_extendedprice").alias("items_per_second"), F.col("l_quantity").alias("bits"), F.col("l_returnflag").alias("series"), (F.col("l_discount") * 100).alias("fpr"))


_RUNS = "runs AS (SELECT (l_linenumber + 20)::BIGINT AS s, (l_orderkey % 5 * 2 + 8)::BIGINT AS m, (l_partkey % 4 * 4 + 4)::BIGINT AS h, l_extendedprice AS items_per_second, l_quantity AS bits, l_returnflag AS series, l_discount * 100 AS fpr FROM lineitem)"
_MED = lambda where: f"SELECT s, m, h, median(items_per_second) / 1e9 AS throughput FROM runs WHERE {where} GROUP BY s, m, h"


@query("median_throughput", f"WITH {_RUNS} SELECT s, m, h, round(throughput, 12) AS throughput FROM ({_MED('true')})")
def median_throughput(spark, d):
    return analysis.medians(_runs(spark, d), "s", "m", "h").withColumn("throughput", F.round("throughput", 12))


@query("metric_outer_join", f"""WITH {_RUNS}, i AS ({_MED("series = 'A'")}), q AS ({_MED("series = 'N' AND s < 25")}), f AS (SELECT s, m, h, max(fpr) AS fpr FROM runs WHERE series = 'R' AND m > 8 GROUP BY s, m, h)
SELECT s, m, h, round(i.throughput, 12) AS "insert", round(q.throughput, 12) AS query, round(f.fpr, 6) AS fpr FROM i FULL JOIN q USING (s, m, h) FULL JOIN f USING (s, m, h)""")
def metric_outer_join(spark, d):
    r = _runs(spark, d)
    i = analysis.medians(r.where("series = 'A'"), *analysis.KEYS).withColumnRenamed("throughput", "insert")
    q = analysis.medians(r.where("series = 'N' AND s < 25"), *analysis.KEYS).withColumnRenamed("throughput", "query")
    f = r.where("series = 'R' AND m > 8").groupBy(*analysis.KEYS).agg(F.max("fpr").alias("fpr"))
    return analysis.metric_table(i, q, f, *analysis.KEYS).select(*analysis.KEYS, F.round("insert", 12).alias("insert"), F.round("query", 12).alias("query"), F.round("fpr", 6).alias("fpr"))


@query("metric_override", f"""WITH {_RUNS}, b AS (SELECT s, max(bits) AS bits FROM runs WHERE series = 'A' GROUP BY s), o AS (SELECT s, min(bits) AS bits FROM runs WHERE series = 'N' AND s % 2 = 0 GROUP BY s)
SELECT s, bits FROM b WHERE s NOT IN (SELECT s FROM o) UNION ALL SELECT s, bits FROM o""")
def metric_override(spark, d):
    r = _runs(spark, d)
    return analysis.overriding(r.where("series = 'A'").groupBy("s").agg(F.max("bits").alias("bits")), r.where("series = 'N' AND s % 2 = 0").groupBy("s").agg(F.min("bits").alias("bits")), "s")


@query("pareto_front", """SELECT p_partkey AS key, p_size AS x, p_retailprice AS y, NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size <= p.p_size AND q.p_retailprice <= p.p_retailprice AND (q.p_size < p.p_size OR q.p_retailprice < p.p_retailprice)) AS pareto FROM part p""")
def pareto_front(spark, d):
    return analysis.skyline(_table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y")), "x", "y")


@query("pivot_metric", f"WITH {_RUNS} SELECT s, " + ", ".join(f'max(bits) FILTER (m = {m}) AS "{m}"' for m in (8, 10, 12, 14, 16)) + " FROM runs WHERE h = 4 GROUP BY s")
def pivot_metric(spark, d):
    g = _runs(spark, d).where("h = 4").groupBy("s", "m").agg(F.max("bits").alias("v"))
    return analysis.pivoted(g, "s", "m", [8, 10, 12, 14, 16], "v")


@query("distinct_parameters", f"WITH {_RUNS} SELECT DISTINCT 's' AS \"column\", s AS value FROM runs UNION SELECT DISTINCT 'm', m FROM runs UNION SELECT DISTINCT 'h', h FROM runs")
def distinct_parameters(spark, d):
    return analysis.distinct_values(_runs(spark, d), *analysis.KEYS)


@query("series_order", f"WITH {_RUNS}, t AS (SELECT series, max(fpr) AS top FROM runs GROUP BY series) SELECT series, round(top, 6) AS top, row_number() OVER (ORDER BY top DESC, series)::INT AS place FROM t")
def series_order(spark, d):
    return analysis.series_order(_runs(spark, d), "series", "fpr").withColumn("top", F.round("top", 6))


@query("host_overhead", "SELECT o_orderkey AS key, round(CASE WHEN o_totalprice > 0 AND o_custkey > 0 THEN greatest(0, (1 - least(1, o_totalprice / (o_custkey * 100.0::DOUBLE))) * 100) ELSE 0 END, 6)::DOUBLE AS pct FROM orders")
def host_overhead(spark, d):
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.round(analysis.overhead(F.col("o_totalprice"), F.col("o_custkey") * 100.0), 6).alias("pct"))


_NAME = "'ShardedBloom' || l_shipmode_ || '<K31_S' || (l_linenumber + 20) || '_M' || (l_orderkey % 9 + 8) || '_H4>/' || CASE WHEN l_orderkey % 2 = 0 THEN 'Insert' ELSE 'Query' END || '/' || (65536 * l_linenumber) || '_median'"


@query("benchmark_names", f"WITH n AS (SELECT DISTINCT {_NAME.replace('l_shipmode_', 'l_returnflag')} AS name FROM lineitem) SELECT name, regexp_extract(name, '^([^/]+)', 1) AS fixture, regexp_extract(name, '(Insert|Query|FPR)', 1) AS operation, try_cast(regexp_extract(name, '/(\\d+)(?:/|_|$)', 1) AS BIGINT) AS size, " + ", ".join(f"try_cast(regexp_extract(name, '(?:^|[^A-Za-z0-9]){t}(\\d+)', 1) AS BIGINT) AS {t.lower()}" for t in "KSMH") + ", regexp_extract(name, '_(mean|median|stddev|cv)$', 1) AS aggregate FROM n WHERE ends_with(name, '_median')")
def benchmark_names(spark, d):
    flag = F.when(F.col("l_orderkey") % 2 == 0, "Insert").otherwise("Query")
    cast = lambda c: c.cast("string")
    name = F.concat(F.lit("ShardedBloom"), "l_returnflag", F.lit("<K31_S"), cast(F.col("l_linenumber") + 20), F.lit("_M"), cast(F.col("l_orderkey") % 9 + 8), F.lit("_H4>/"), flag, F.lit("/"), cast(65536 * F.col("l_linenumber")), F.lit("_median"))
    return analysis.selected(_table(spark, d, "lineitem").select(name.alias("name")).distinct())


_CUSTOMERS = "SELECT c_name AS header, translate(md5(c_custkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGN') AS sequence FROM customer"


def _customers(spark, d) -> DataFrame:
    return _table(spark, d, "customer").select(F.col("c_name").alias("header"), F.translate(F.md5(F.col("c_custkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGN").alias("sequence"))


@query("fasta_split_read", _CUSTOMERS)
def fasta_split_read(spark, d):
    path = shared(spark, "fasta")
    fastx.write_fasta(_customers(spark, d), path, wrap=10)
    return fastx.read_fasta(spark, path).select("header", "sequence")


@query("fasta_gzip_read", _CUSTOMERS)
def fasta_gzip_read(spark, d):
    path = shared(spark, "fasta-gz")
    fastx.write_fasta(_customers(spark, d), path, wrap=12, compression="gzip")
    return fastx.read(spark, f"{path}/*.gz").select("header", "sequence")


@query("fastq_read", _CUSTOMERS)
def fastq_read(spark, d):
    path = shared(spark, "fastq")
    fastx.write_fastq(_customers(spark, d), path)
    return fastx.read(spark, f"{path}/part-*").select("header", "sequence")


@query("fastx_report", f"SELECT count(*) AS records_indexed, sum(length(sequence))::BIGINT AS indexed_bases, sum({sql.valid_count(BASES, 'sequence')})::BIGINT AS inserted_kmers FROM ({_CUSTOMERS})")
def fastx_report(spark, d):
    path = shared(spark, "fasta")
    fastx.write_fasta(_customers(spark, d), path)
    spark.dataSource.register(fastx.FastxDataSource)
    return insert_report(spark.read.format("fastx").load(path), BASES)


@query("fastx_indexed", "SELECT count(*) AS records, (count(*) - 1)::BIGINT AS last, (count(*) * (count(*) - 1) // 2)::BIGINT AS total FROM customer")
def fastx_indexed(spark, d):
    path = shared(spark, "fasta")
    fastx.write_fasta(_customers(spark, d), path)
    r = fastx.indexed(fastx.read(spark, f"{path}/part-*"))
    return r.agg(F.count("*").alias("records"), F.max("record_index").alias("last"), F.sum("record_index").alias("total"))


@query("streaming_build", f"WITH {sql.located(BASES, SHARDS, ORDERS)}, {sql.built()} SELECT shard, {_SHARD_COLUMNS} FROM flt")
def streaming_build(spark, d):
    source, out = shared(spark, "stream"), shared(spark, "stream-filter")
    orders(spark, d).write.parquet(source)
    stream = spark.readStream.schema("key bigint, seq string").option("maxFilesPerTrigger", 2).parquet(source)
    streams.build_into(stream, BASES, BITS, out, shared(spark, "offsets"), "seq").awaitTermination()
    return streams.open_built(spark, BASES, BITS, out).shards


_ENTRIES = f"SELECT CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN ' ' || c_name ELSE c_name END AS header, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE sequence END AS sequence FROM customer JOIN ({_CUSTOMERS}) ON c_name = header"


@query("fasta_odd_headers", _ENTRIES)
def fasta_odd_headers(spark, d):
    """Empty headers, headers that begin with a blank, and entries without a sequence, read from splits."""
    key, path = F.col("c_custkey"), shared(spark, "fasta")
    c = _table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("header")).join(_customers(spark, d), "header")
    header = F.when(key % 7 == 0, "").when(key % 5 == 0, F.concat(F.lit(" "), "header")).otherwise(F.col("header"))
    fastx.write_fasta(c.select(header.alias("header"), F.when(key % 11 == 0, "").otherwise(F.col("sequence")).alias("sequence")), path, wrap=10)
    return fastx.read_fasta(spark, path).select("header", "sequence")


_OF_ORDERS = f"{sql.located(BASES, SHARDS, ORDERS)}, {sql.built()}, {sql.located(BASES, SHARDS, f'SELECT header AS key, sequence AS seq FROM ({_CUSTOMERS})', 'q')}, pos AS (SELECT key, count(*) FILTER ({sql.HIT}) AS n FROM q_l LEFT JOIN flt USING (shard) GROUP BY key)"


def _query_fastx(spark, d) -> tuple[DataFrame, DataFrame]:
    path = shared(spark, "fasta")
    fastx.write_fasta(_customers(spark, d), path, wrap=10)
    spark.dataSource.register(fastx.FastxDataSource)
    return KmerFilter.build(orders(spark, d), BASES, BITS, "seq").query_fastx(spark.read.format("fastx").load(path))


@query("fastx_query_records", f"WITH {_OF_ORDERS} SELECT header, length(sequence)::BIGINT AS queried_bases, {sql.valid_count(BASES, 'sequence')} AS queried_kmers, coalesce(n, 0)::BIGINT AS positive_kmers FROM ({_CUSTOMERS}) LEFT JOIN pos ON header = key")
def fastx_query_records(spark, d):
    return _query_fastx(spark, d)[0].select("header", "queried_bases", "queried_kmers", "positive_kmers")


@query("fastx_query_report", f"WITH {_OF_ORDERS} SELECT count(*) AS records_queried, sum(length(sequence))::BIGINT AS queried_bases, sum({sql.valid_count(BASES, 'sequence')})::BIGINT AS queried_kmers, sum(coalesce(n, 0))::BIGINT AS positive_kmers FROM ({_CUSTOMERS}) LEFT JOIN pos ON header = key")
def fastx_query_report(spark, d):
    return _query_fastx(spark, d)[1]


@query("fastx_pieces", f"SELECT c_name AS header, (31 * 40 + 32)::BIGINT AS bases, {sql.valid_count(BASES, 'long')} AS kmers FROM (SELECT header AS c_name, repeat(substr(sequence, 1, 31), 40) || sequence AS long FROM ({_CUSTOMERS}))")
def fastx_pieces(spark, d):
    """Long records in pieces that share k - 1 bases: no window is lost or counted twice."""
    path = shared(spark, "fasta")
    long = F.concat(F.repeat(F.substring("sequence", 1, 31), 40), "sequence")
    fastx.write_fasta(_customers(spark, d).select("header", long.alias("sequence")), path, wrap=50)
    spark.dataSource.register(fastx.FastxDataSource)
    r = spark.read.format("fastx").option("size", 300).option("overlap", BASES.k - 1).load(path)
    ends = F.max(F.col("start") + F.octet_length("sequence")).cast("long")
    return r.groupBy("header").agg(ends.alias("bases"), F.sum(kmers.valid_kmer_count(F.col("sequence"), BASES)).alias("kmers"))


@query("concatenated_file", f"SELECT string_agg(sequence, 'N' ORDER BY header) AS sequence, sum(length(sequence) + 1)::BIGINT - 1 AS bases FROM ({_CUSTOMERS})")
def concatenated_file(spark, d):
    path = shared(spark, "fasta")
    fastx.write_fasta(_customers(spark, d).coalesce(1).sortWithinPartitions("header"), path)
    one = fastx.concatenated(fastx.indexed(fastx.read(spark, f"{path}/part-*")))
    return one.select("sequence", F.octet_length("sequence").cast("long").alias("bases"))


@query("result_csv", f"WITH n AS (SELECT DISTINCT {_NAME.replace('l_shipmode_', 'l_returnflag')} AS name, l_linenumber FROM lineitem) SELECT name, l_linenumber * 1.5::DOUBLE AS real_time, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber * 1000.0::DOUBLE END AS items_per_second, NULL::DOUBLE AS fpr_percentage FROM n")
def result_csv(spark, d):
    """A result table with lines before its header, quoted names, missing cells and a missing column."""
    path, n = shared(spark, "results"), F.col("l_linenumber")
    flag = F.when(F.col("l_orderkey") % 2 == 0, "Insert").otherwise("Query")
    cast = lambda c: c.cast("string")
    name = F.concat(F.lit("ShardedBloom"), "l_returnflag", F.lit("<K31_S"), cast(n + 20), F.lit("_M"), cast(F.col("l_orderkey") % 9 + 8), F.lit("_H4>/"), flag, F.lit("/"), cast(65536 * n), F.lit("_median"))
    rows = _table(spark, d, "lineitem").select(name.alias("name"), "l_linenumber").distinct()
    line = F.concat(F.lit('"'), "name", F.lit('",'), cast(n * 1.5), F.lit(","), F.when(n % 3 == 0, "").otherwise(cast(n * 1000.0)))
    head = "host: somewhere\nname,real_time,items_per_second"
    files = rows.groupBy(F.pmod(F.xxhash64("name"), F.lit(8)).alias("file")).agg(F.concat_ws("\n", F.lit(head), F.array_join(F.collect_list(line), "\n")).alias("value"))
    files.write.partitionBy("file").text(path)
    return analysis.read_results(spark, f"{path}/*/part-*").select("name", "real_time", "items_per_second", "fpr_percentage")


@query("random_sequences", "SELECT i AS record_index, translate(md5('s' || i), '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence FROM range(1000) t(i)")
def random_sequences(spark, d):
    return fastx.hashed_sequences(spark, 1000, "s")
