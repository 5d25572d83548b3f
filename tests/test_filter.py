import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.config import DNA, DNA_TRIPLET, PRODUCTION, PROTEIN, Alphabet, Config, bits_for, kmers_for, mebibytes, shards_for
from kmerloom.errors import InvalidArgumentError, ResourceError
from kmerloom.functions import dense, kmers, vector
from kmerloom.operators.filter import KmerFilter, attempted, from_blob, insert_report, masked
from tests.scalar import Model

XYZ = Alphabet("xyz", {ord(c): i for i, c in enumerate("xyz")}, 3, "!", invalid=7)
TEST = Config(5, 4, 3, 4)
RESIDUE = Config(5, 4, 3, 4, PROTEIN)
CODON = Config(3, 2, 2, 4, DNA_TRIPLET)
CUSTOM = Config(3, 2, 2, 4, XYZ)


def records(spark, *seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "record_index bigint, sequence string")


def hits(flt, spark, *seqs):
    return [r.hits for r in flt.query_records(records(spark, *seqs), hits=True).orderBy("record_index").collect()]


CASES = [
    (TEST, "GATTACAGATTACCA", "GATTACAGATTACCA", [1] * 11),
    (TEST, "GATTANCAGATTACC", "GATTANCAGATTACC", [1, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1]),
    (TEST, "GATC", "GATC", []),
    (TEST, "gattacagattacca", "GATTACAGATTACCA", [1] * 11),
    (RESIDUE, "MKVLATWYQ", "mkvlatwyq", [1] * 5),
    (RESIDUE, "MKVLA*TWYQGH", "MKVLA*TWYQGH", [1, 0, 0, 0, 0, 0, 1, 1]),
    (TEST, "TTGAC\nCATGAT\n", "TTGAC\nCATGAT\n", [1, 0, 0, 0, 0, 0, 1, 1, 0]),
    (CUSTOM, "zyx!yyz", "zyx!yyz", [1, 0, 0, 0, 1]),
    (CODON, "GATTACAGATTACCATTG", "gattacagattaccattg", [1] * 4),
    (CODON, "TTGACCNNNCATGATTAC", "TTGACCNNNCATGATTAC", [0, 0, 0, 1]),
    (CODON, "GATTACAGATTACCATTGA", "GATTACAGATTACCATTGA", [1] * 4),
]


@pytest.mark.parametrize("cfg,insert,query,expected", CASES)
def test_hits(spark, cfg, insert, query, expected):
    flt = KmerFilter.build(records(spark, insert), cfg, 1 << 12)
    assert hits(flt, spark, query) == [expected]


@pytest.mark.parametrize("cfg,text", [(c, i) for c, i, _, _ in CASES])
def test_set_bits(spark, cfg, text):
    model = Model(cfg, 1 << 12)
    model.insert(text.encode())
    assert KmerFilter.build(records(spark, text), cfg, 1 << 12).load().first().set_bits == sum(bin(w).count("1") for ws in model.shards.values() for w in ws)


def test_load_factor_and_idempotence(spark):
    text = "GATTACAGATTACCATTGAC"
    one = KmerFilter.build(records(spark, text), TEST, 1 << 12)
    assert one.load_factor() == one.load().first().set_bits / 4096 > 0
    assert one.insert(records(spark, text)).load_factor() == one.load_factor()
    assert one.clear().load_factor() == 0 and hits(one.clear(), spark, text) == [[0] * 16]


@pytest.mark.parametrize("h", [4, 8, 12, 16])
def test_production_lengths(spark, h):
    cfg, text = Config(31, 28, 16, h), "GATTACACCATTGACGGATCCTAGATTTACCAGGAT" * 3
    model = Model(cfg, 1 << 16)
    model.insert(text.encode())
    expected = {s: tuple(w) for s, w in model.shards.items()}
    unsigned = lambda df: {r.shard: tuple(x & (1 << 64) - 1 for x in (r.w0, r.w1, r.w2, r.w3)) for r in df.collect()}
    flt, by = KmerFilter.build(records(spark, text), cfg, 1 << 16), KmerFilter.by_expressions(records(spark, text), cfg, 1 << 16)
    assert unsigned(flt.shards) == unsigned(by.shards) == expected
    assert set(hits(flt, spark, text)[0]) == {1}


@pytest.mark.parametrize("cfg", [TEST, RESIDUE, CODON, CUSTOM, Config(8, 6, 4, 12), Config(12, 10, 6, 4, PROTEIN), Config(32, 30, 29, 8)])
def test_three_ways_agree(spark, cfg):
    rng = np.random.default_rng(5)
    letters = "".join(chr(b) for b in cfg.alphabet.codes) * 6 + cfg.alphabet.separator + "é-"
    texts = ["".join(rng.choice(list(letters), n)) for n in (0, 1, 4, 9, 31, 32, 33, 80, 200, 301)]
    model = Model(cfg, 1 << 12)
    for t in texts[::2]:
        model.insert(t.encode())
    flt = KmerFilter.by_expressions(records(spark, *texts[::2]), cfg, 1 << 12)
    expected = {s: tuple(w) for s, w in model.shards.items()}
    unsigned = lambda rows: {r.shard: tuple(x & (1 << 64) - 1 for x in (r.w0, r.w1, r.w2, r.w3)) for r in rows}
    assert unsigned(flt.shards.collect()) == expected
    fast = vector.build(records(spark, *texts[::2]), cfg, flt.num_shards)
    assert unsigned(fast.collect()) == expected
    assert hits(flt, spark, *texts) == [model.hits(t.encode()) for t in texts]
    joined = flt.query_records(records(spark, *texts, None), hits=True, held=0).orderBy("record_index").collect()
    assert [r.hits for r in joined] == [model.hits(t.encode()) for t in texts] + [[]] and joined[-1].queried_bases is None
    assert joined == flt.query_records(records(spark, *texts, None), hits=True).orderBy("record_index").collect()
    probed = vector.probe(records(spark, *texts), vector.table(fast, flt.num_shards), cfg).orderBy("record_index").collect()
    assert [(r.queried_kmers, r.positive_kmers) for r in probed] == [(sum(p is not None for p in model.windows(t.encode())), sum(model.hits(t.encode()))) for t in texts]


def test_reports(spark):
    r = records(spark, "GATTANCAGATTACC", "TTGACCATGATT", "", "GA")
    flt = KmerFilter.build(r, TEST, 1 << 12)
    assert tuple(insert_report(r, TEST).first()) == (4, 29, 14)
    assert attempted(r, TEST).first().attempted == 19
    assert tuple(flt.query_report(r).first()) == (4, 29, 14, 14)
    seen = []
    assert flt.for_each(r, seen.append) == {"records_queried": 4, "queried_bases": 29, "queried_kmers": 14, "positive_kmers": 14}
    assert [x.record_index for x in seen] == [0, 1, 2, 3]
    with pytest.raises(RuntimeError):
        flt.for_each(r, lambda row: (_ for _ in ()).throw(RuntimeError("stop")))
    assert tuple(flt.query_report(r).first()) == (4, 29, 14, 14)
    assert tuple(flt.query_report(records(spark).limit(0)).first()) == (0, 0, 0, 0)


def test_plan_computes_shards_once(spark):
    """Joining on the shard adds no filter that would compute it again below the aggregate."""
    r = records(spark, "GATTACAGATTACCA")
    plan = KmerFilter.by_expressions(r, TEST, 1 << 12).contains(r)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(least" not in plan and "isnotnull(shard" not in plan


def test_hits_of_a_long_record(spark):
    rng = np.random.default_rng(8)
    text = "".join(np.array(list("ACGT"))[rng.integers(0, 4, 1_000_000)])
    flt = KmerFilter.build(records(spark, text[:400_000]), PRODUCTION, 1 << 23)
    for held in (0, vector.HELD_BYTES):
        row = flt.query_records(records(spark, text), hits=True, held=held).first()
        assert len(row.hits) == 999_970 and row.hits[:399_970] == [1] * 399_970 and sum(row.hits) == row.positive_kmers < 420_000


def test_limits(monkeypatch, spark):
    monkeypatch.setattr(vector, "HELD_BYTES", 1000)
    with pytest.raises(ResourceError):
        vector.table(KmerFilter.empty(spark, TEST, 1 << 20).shards, 4096)
    monkeypatch.setenv("SOME_MIB", "3")
    assert mebibytes("SOME_MIB", 7) == 3 << 20 and mebibytes("NO_SUCH_MIB", 7) == 7
    monkeypatch.setenv("SOME_MIB", "3.5")
    with pytest.raises(InvalidArgumentError):
        mebibytes("SOME_MIB", 7)


def test_seeded_hash():
    import xxhash

    keys = np.array([0, 1, 2**64 - 1], np.uint64)
    assert vector.xxhash64(keys, 7).tolist() == [xxhash.xxh64_intdigest(int(k).to_bytes(8, "little"), 7) for k in keys]


def test_accumulation_and_batches(spark):
    flt = KmerFilter.build(records(spark, "GATTACAGATTACCA"), TEST, 1 << 14).insert(records(spark, "TTGACCATGATT"))
    assert hits(flt, spark, "GATTACAGATTACCA", "TTGACCATGATT") == [[1] * 11, [1] * 8]
    blob = spark.createDataFrame([("GATTACAGATTANTTGACCATGATT", [(0, 12), (13, 12)])], "sequence string, records array<struct<sequence_offset:bigint,sequence_bytes:bigint>>")
    two = from_blob(blob)
    assert attempted(two, TEST).first().attempted == 16
    flt = KmerFilter.build(two, TEST, 1 << 14)
    assert hits(flt, spark, "GATTACAGATTANTTGACCATGATT") == [[1] * 8 + [0] * 5 + [1] * 8]
    batch = two.selectExpr("7 AS batch", "record_index", "sequence")
    assert flt.query_batch(batch).first().hits == [1] * 8 + [0] * 5 + [1] * 8
    assert [r.hits for r in flt.query_batch_records(batch).orderBy("record_index").collect()] == [[1] * 8, [1] * 8]


def test_saved_and_merged(spark, tmp_path):
    flt = KmerFilter.build(records(spark, "GATTACAGATTACCA"), TEST, 1 << 12)
    flt.save(str(tmp_path / "f"))
    assert KmerFilter.open(spark, TEST, 1 << 12, str(tmp_path / "f")).load_factor() == flt.load_factor()
    with pytest.raises(InvalidArgumentError):
        flt.merge(KmerFilter.empty(spark, TEST, 1 << 13))


def test_sizes_and_conditions():
    assert shards_for(0) == 1 and shards_for(257) == 2 and bits_for(437_500) == 8_388_608 and kmers_for(8_388_608) >= 437_500
    for bad in ({"k": 0}, {"m": 6}, {"s": 6}, {"hashes": 6}, {"k": 33, "m": 3, "s": 4}):
        with pytest.raises(InvalidArgumentError):
            Config(**({"k": 5, "s": 4, "m": 3, "hashes": 4} | bad))
    with pytest.raises(InvalidArgumentError):
        Alphabet("bad", {65: 0}, 1, "A")
    assert (DNA.bits, DNA_TRIPLET.bits, PROTEIN.bits) == (2, 6, 5) and (DNA.max_k, DNA_TRIPLET.max_k, PROTEIN.max_k) == (32, 10, 12)


@pytest.mark.parametrize("cfg,text", [(TEST, "GATTACACCATTGACGGATCCTAG" * 3), (RESIDUE, "MKVLATWYQGHPRNDCEFISMKVLA")])
def test_dense(spark, cfg, text):
    df = records(spark, text).select("record_index", dense.pack(F.col("sequence"), cfg.alphabet).alias("words"), F.lit(len(text)).cast("long").alias("n"))
    assert [x & (1 << 64) - 1 for x in df.first().words] == vector.pack_dense(text.encode(), cfg).tolist()
    packed = df.select(F.explode(dense.packed_kmers(F.col("words"), F.col("n"), cfg)).alias("packed"))
    plain = kmers.windows(records(spark, text), cfg, "sequence").select(kmers.packed(F.col("kmer"), cfg).alias("packed"))
    assert sorted(r.packed for r in packed.collect()) == sorted(r.packed for r in plain.collect())
    flt = KmerFilter.of_packed(packed, cfg, 1 << 14)
    assert set(hits(flt, spark, text)[0]) == {1}
    with pytest.raises(Exception, match="fewer"):
        df.select(dense.check(F.slice("words", 1, 0), F.col("n"), cfg.alphabet)).collect()


def test_dense_has_no_invalid_code(spark):
    words = records(spark, "ACNT").select(dense.pack(F.col("sequence"), DNA)).first()[0]
    assert words == [0b10_11_01_00] and vector.pack_dense(b"ACNT", TEST).tolist() == words


def test_vector_windows_of_nulls_and_empty():
    packed, row, pos = vector.kmers(pa.array(["", "ACGTA", "NNNNN", "ACG", "TTTTTT"]), TEST)
    assert row.tolist() == [1, 4, 4] and pos.tolist() == [0, 0, 1]


def test_super_kmers(spark):
    k = masked(records(spark, "GATTACACCATTGACNGGATCCTAGATTA"), TEST, 16, "sequence", "record_index").select("record_index", "pos", "shard")
    rows = sorted((r.pos, r.shard) for r in k.collect())
    runs = []
    for pos, shard in rows:
        if runs and runs[-1][2] == shard and runs[-1][0] + runs[-1][1] == pos:
            runs[-1][1] += 1
        else:
            runs.append([pos, 1, shard])
    assert sorted((r.start, r.n, r.shard) for r in kmers.super_kmers(k, "record_index").collect()) == sorted(map(tuple, runs))
