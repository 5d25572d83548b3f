import pytest

from kmerloom.config import DNA_TRIPLET, Config
from kmerloom.operators import records

LAYOUT = Config(3, 2, 2, 4)
CODON = Config(3, 2, 2, 4, DNA_TRIPLET)


def meta(spark, *sizes):
    return spark.createDataFrame([(i, 0, s, v) for i, (s, v) in enumerate(sizes)], "record_index bigint, input_offset bigint, size bigint, valid_kmers bigint")


@pytest.mark.parametrize("sizes,offsets,counts", [([(6, 1), (8, 2)], [0, 7], [4, 6]), ([(14, 3)], [0], [12]), ([(4, 2), (4, 2)], [0, 5], [2, 2]), ([(0, 0), (4, 2), (4, 2)], [0, 0, 5], [0, 2, 2]), ([(1, 0)], [0], [0])])
def test_layout(spark, sizes, offsets, counts):
    rows = records.layout(meta(spark, *sizes), LAYOUT).orderBy("record_index").collect()
    assert [r.hit_offset for r in rows] == offsets and [r.hit_count for r in rows] == counts and [r.valid_kmers for r in rows] == [v for _, v in sizes]


def test_layout_of_triplets_pads(spark):
    rows = records.layout(meta(spark, (9, 1), (10, 1), (9, 1)), CODON).orderBy("record_index").collect()
    assert [r.hit_offset for r in rows] == [0, 4, 9] and [r.hit_count for r in rows] == [1, 1, 1]


def test_normalized(spark):
    df = spark.createDataFrame([(0, "ACGT"), (1, "ACGT")], "record_index bigint, sequence string")
    rows = records.normalized(df, LAYOUT).orderBy("record_index").collect()
    assert [(r.input_offset, r.size, r.valid_kmers) for r in rows] == [(0, 4, 2), (4, 4, 2)]
    assert records.total_valid(records.normalized(df, LAYOUT)).first()[0] == 4
    assert records.joined_text(df, LAYOUT).first().normalized == "ACGTNACGT"
    assert records.joined_text(spark.createDataFrame([(0, "ACGTA"), (1, "ACG")], "record_index bigint, sequence string"), CODON).first().normalized == "ACGTANNNNACG"


@pytest.mark.parametrize("ranges,problem", [([(4, 4), (0, 4)], "overlap"), ([(0, 6), (4, 4)], "overlap"), ([(0, 4), (4, 9)], "bounds"), ([(-1, 4)], "bounds")])
def test_bad_ranges(spark, ranges, problem):
    df = spark.createDataFrame([(i, o, n, 12) for i, (o, n) in enumerate(ranges)], "record_index bigint, sequence_offset bigint, sequence_bytes bigint, total_bytes bigint")
    with pytest.raises(Exception, match=problem):
        records.require_valid(df, LAYOUT).collect()


def test_width(spark):
    df = spark.createDataFrame([(0, 0, 4, 12)], "record_index bigint, sequence_offset bigint, sequence_bytes bigint, total_bytes bigint")
    assert records.require_valid(df, LAYOUT).count() == 1
    assert "width" in records.validated(df, CODON).first().problem
