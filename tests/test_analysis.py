import pytest
from pyspark.sql import functions as F

from kmerloom.config import Config
from kmerloom.functions.vector import build
from kmerloom.operators import analysis
from kmerloom.operators.filter import KmerFilter, false_positive_rate
from kmerloom.sources import fastx
from kmerloom.functions import kmers


def test_skyline(spark):
    pts = [(1, 5.0, 5.0), (2, 1.0, 9.0), (3, 9.0, 1.0), (4, 5.0, 5.0), (5, 5.0, 6.0), (6, 6.0, 5.0), (7, 1.0, 9.5), (8, 0.5, 20.0)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    expected = {i for i, x, y in pts if not any(a <= x and b <= y and (a < x or b < y) for _, a, b in pts)}
    assert {r.id for r in analysis.skyline(df, "x", "y").where("pareto").collect()} == expected


@pytest.mark.parametrize("host,device,pct", [(5.0, 10.0, 50.0), (12.0, 10.0, 0.0), (0.0, 10.0, 0.0), (1.0, 0.0, 0.0)])
def test_overhead(spark, host, device, pct):
    assert spark.range(1).select(analysis.overhead(F.lit(host), F.lit(device))).first()[0] == pct


def test_names(spark):
    df = spark.createDataFrame([("ShardedBloomCpu<K31_S28_M16_H4>/Insert/65536_median",), ("Other/Build/1_mean",)], "name string")
    r = analysis.parsed_names(df).collect()
    assert (r[0].fixture, r[0].operation, r[0].size, r[0].k, r[0].s, r[0].m, r[0].h, r[0].aggregate) == ("ShardedBloomCpu<K31_S28_M16_H4>", "Insert", 65536, 31, 28, 16, 4, "median")
    assert (r[1].operation, r[1].k, r[1].aggregate) == ("", None, "mean") and analysis.selected(df).count() == 1
    assert [x[0] for x in df.select(analysis.labelled(F.col("name"), {"ShardedBloomCpu": "on the host", "Sharded": "sharded"})).collect()] == ["on the host", "other/build/1_mean"]


def test_stacked_and_shares(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "x int, z int")
    assert [tuple(r) for r in analysis.stacked(a, b).orderBy("x").collect()] == [(1, 2, None), (3, None, 4)]
    assert analysis.shares(10, 3) == [(0, 3), (3, 3), (6, 4)]


def test_false_positives_order_by_s(spark):
    """At equal size, shorter s-mers demand more bits of a k-mer: fewer false positives. Larger filters have fewer."""
    rates = {}
    inserted = fastx.random_sequences(spark, 40, 400, seed=1)
    queries = fastx.random_sequences(spark, 40, 400, seed=2)
    pack = lambda df, cfg: kmers.windows(df, cfg, "sequence").select(kmers.packed(F.col("kmer"), cfg).alias("packed"))
    for s, bits in ((10, 1 << 15), (12, 1 << 15), (12, 1 << 18)):
        cfg = Config(12, s, 6)
        shards = bits // 256
        flt = KmerFilter(cfg, shards, build(inserted, cfg, shards).cache())
        row = false_positive_rate(flt, pack(inserted, cfg), pack(queries, cfg)).first()
        assert row.queries > 10_000
        rates[s, bits] = row.fpr_percentage
    assert rates[10, 1 << 15] < rates[12, 1 << 15] and rates[12, 1 << 18] < rates[12, 1 << 15]
