import gzip

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException

from kmerloom.config import PRODUCTION, Config
from kmerloom.errors import FastxParseError
from kmerloom.functions import vector
from kmerloom.operators.filter import KmerFilter, insert_report
from kmerloom.session import ship
from kmerloom.sources import fastx

TEST = Config(5, 4, 3, 4)

GOOD = {
    "lines": (">one entry\nGATTA\nCAGAT\nTA\n", [("one entry", "GATTACAGATTA")]),
    "crlf": ("@read/1\r\nGATT\r\nACA\r\n+\r\n!!!!\r\n!!!\r\n", [("read/1", "GATTACA")]),
    "two": (">left\nTTGAC\nAA\n>right\nCCGT\nG\n", [("left", "TTGACAA"), ("right", "CCGTG")]),
    "blank": ("\n\n>x y z\n\nGA\n\nTC\n", [("x y z", "GATC")]),
    "header only": (">none\n>some\nGC", [("none", ""), ("some", "GC")]),
    "empty headers": (">\nGGTT\n>\n>\n\n> sp\nA\n>>two\nC\n", [("", "GGTT"), ("", ""), ("", ""), (" sp", "A"), (">two", "C")]),
    "crlf fasta": (">a\r\nAC\r\n\r\nGT\r\n>b\r\n", [("a", "ACGT"), ("b", "")]),
    "quality at": ("@q\nTGCA\n+\n@!!!\n@r\nG\n+q\n!\n", [("q", "TGCA"), ("r", "G")]),
    "empty fastq": ("@q\n\n+\n@r\nG\n+\n!\n", [("q", ""), ("r", "G")]),
    "empty": ("", []),
}
# What messages say and the places they name.
BAD = {
    "header": ("GATTACA\n", 1, 1, "expected FASTA or FASTQ header"),
    "mixed fastq": ("@a\nGC\n+\n!!\n>b\nGC\n", 5, 1, "mixed FASTA and FASTQ records are not supported"),
    "no plus": ("@a\nGATC\n", 2, 1, "unterminated FASTQ record: missing '+' separator"),
    "short": ("@cut off\nGATTACAGA\n+\n!!!!!!!\n", 4, 8, "FASTQ quality length does not match sequence length"),
    "long": ("@too much\nGAT\n+\n!!!!!\n", 4, 4, "FASTQ quality length exceeds sequence length"),
}
FASTA = [n for n in GOOD if GOOD[n][0].lstrip("\n")[:1] in (">", "")]


@pytest.mark.parametrize("name", GOOD)
def test_parse(name):
    text, expected = GOOD[name]
    for data in (text.encode(), gzip.compress(text.encode())):
        assert [(r.header, r.sequence) for r in fastx.parse_bytes(data)] == expected


@pytest.mark.parametrize("name", BAD)
def test_errors(name):
    text, line, column, message = BAD[name]
    with pytest.raises(FastxParseError) as e:
        list(fastx.parse_bytes(text.encode(), "f"))
    assert (e.value.location.line, e.value.location.column, e.value.message) == (line, column, message)
    assert str(e.value) == f"f:{line}:{column}: {message}"


def test_at_line_inside_fasta_is_sequence():
    assert [(r.header, r.sequence) for r in fastx.parse_bytes(b">a\nAC\n@c\n")] == [("a", "AC@c")]


def test_cut_off_gzip():
    whole = gzip.compress(b">a\n" + b"ACGT" * 5000 + b"\n")
    assert set("".join(r.sequence for r in fastx.parse_bytes(whole[: len(whole) // 2]))) <= set("ACGT")
    assert fastx.unzipped(b"plain") == b"plain"


def test_readers_agree(spark, tmp_path):
    ship(spark)
    for i, name in enumerate(["lines", "two", "header only"]):
        (tmp_path / f"{i}.fa").write_text(GOOD[name][0])
    (tmp_path / "3.gzipped").write_bytes(gzip.compress(GOOD["blank"][0].encode()))
    expected = sorted(r for n in ("lines", "two", "header only", "blank") for r in GOOD[n][1])
    rows = lambda df: sorted((r.header, r.sequence) for r in df.collect())
    assert rows(fastx.read(spark, str(tmp_path))) == expected
    spark.dataSource.register(fastx.FastxDataSource)
    assert rows(spark.read.format("fastx").load(str(tmp_path))) == expected
    assert rows(fastx.read_fasta(spark, str(tmp_path / "*.fa"))) == sorted(r for n in ("lines", "two", "header only") for r in GOOD[n][1])
    one = fastx.indexed(fastx.read(spark, str(tmp_path))).orderBy("record_index").collect()
    assert [r.record_index for r in one] == list(range(len(expected))) and [r.header for r in one] == ["one entry", "left", "right", "none", "some", "x y z"]
    assert fastx.concatenated(fastx.indexed(fastx.read(spark, str(tmp_path / "1.fa")))).first().sequence == "TTGACAANCCGTG"


def test_split_reader_over_small_splits(spark, tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">r{i}\n{'ACGT' * (i % 7 + 1)}\n" for i in range(200)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        df = fastx.read_fasta(spark, str(tmp_path / "a.fa"))
        assert df.rdd.getNumPartitions() > 5
        rows = df.orderBy("block", "at").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.header, r.sequence) for r in rows] == [(f"r{i}", "ACGT" * (i % 7 + 1)) for i in range(200)]


def test_errors_reach_the_user(spark, tmp_path):
    ship(spark)
    (tmp_path / "bad.fq").write_text("@ok\nAC\n+\nII\n" + BAD["short"][0])
    with pytest.raises(PythonException, match="FASTQ quality length does not match sequence length"):
        fastx.read(spark, str(tmp_path / "bad.fq")).collect()
    rows = fastx.read(spark, str(tmp_path / "bad.fq"), permissive=True).orderBy("record_index").collect()
    assert rows[0].sequence == "AC" and rows[0].error is None and rows[1].error.line == 8 and rows[1].error.column == 8


def test_written_files_come_back(spark, tmp_path):
    ship(spark)
    df = spark.createDataFrame([("a", "ACGTACGTACG"), ("b", "N")], "header string, sequence string")
    fastx.write_fasta(df, str(tmp_path / "fa"), wrap=4)
    fastx.write_fastq(df, str(tmp_path / "fq"))
    fastx.write_fasta(df, str(tmp_path / "gz"), compression="gzip")
    for p in ("fa/part-*", "fq/part-*", "gz/part-*"):
        assert sorted((r.header, r.sequence) for r in fastx.read(spark, str(tmp_path / p)).collect()) == [("a", "ACGTACGTACG"), ("b", "N")]


@pytest.mark.parametrize("name", FASTA)
def test_split_reader_is_the_parser(spark, tmp_path, name):
    (tmp_path / "a.fa").write_bytes(GOOD[name][0].encode())
    (tmp_path / "b.fa").write_bytes(GOOD["two"][0].encode())
    rows = fastx.read_fasta(spark, str(tmp_path / "*.fa")).orderBy("file", "at").collect()
    assert [(r.header, r.sequence) for r in rows] == GOOD[name][1] + GOOD["two"][1]


@pytest.mark.parametrize("text", ["GATTACA\n", "\n\nGATTACA\n>a\nG\n", "@q\nG\n+\n!\n"])
def test_split_reader_wants_a_header(spark, tmp_path, text):
    (tmp_path / "a.fa").write_text(text)
    with pytest.raises(PythonException, match="expected FASTA header"):
        fastx.read_fasta(spark, str(tmp_path / "a.fa")).collect()


def test_long_records_in_pieces(spark, tmp_path):
    """A record of 3 MB in pieces that overlap by k - 1: each window once, also in chunks of the array path."""
    rng = np.random.default_rng(6)
    text = "".join(np.array(list("ACGT"))[rng.integers(0, 4, 3_000_000)])
    text = text[:1_000_000] + "N" + text[1_000_001:]
    data = ">long\n" + "\n".join(text[i : i + 80] for i in range(0, len(text), 80)) + "\n>short\nACGT\n>none\n"
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(data.encode() [:1_500_000]) + gzip.compress(data.encode()[1_500_000:]))
    spark.dataSource.register(fastx.FastxDataSource)
    df = spark.read.format("fastx").option("size", 100_000).option("overlap", 30).load(str(tmp_path))
    rows = df.orderBy("record_index", "start").collect()
    assert len(rows) > 30 and max(len(r.sequence) for r in rows) < 101_000 and [r.header for r in rows[-2:]] == ["short", "none"]
    back = rows[0].sequence + "".join(r.sequence[30:] for r in rows[1:-2])
    assert back == text and all(r.start + len(r.sequence) == n.start + 30 for r, n in zip(rows[:-3], rows[1:-2], strict=True))
    whole = pa.array([text, "ACGT", ""])
    assert insert_report(df, PRODUCTION).first().inserted_kmers == len(text) - 30 - 31
    few, all_ = list(vector.chunks(whole, PRODUCTION, 1 << 18)), vector.kmers(whole, PRODUCTION)
    assert len(few) == 12 and all((np.concatenate([c[i] for c in few]) == all_[i]).all() for i in range(3)) and len(all_[0]) == len(text) - 61


def test_reports_over_files(spark, tmp_path):
    ship(spark)
    (tmp_path / "x.fa").write_text(">first\nTTGACCAT\n>second\nGATTNCAGATTAC\n>third\nCCATGAAC\n")
    for parts in (1, 3):
        r = fastx.read(spark, str(tmp_path / "x.fa")).repartition(parts)
        assert tuple(insert_report(r, TEST).first()) == (3, 29, 12)
        flt = KmerFilter.build(r, TEST, 1 << 12)
        rows, total = flt.query_fastx(r)
        rows = rows.orderBy("record_index").collect()
        assert [(x.header, x.queried_bases, x.queried_kmers, x.positive_kmers) for x in rows] == [("first", 8, 4, 4), ("second", 13, 4, 4), ("third", 8, 4, 4)]
        detail = flt.query_records(r, hits=True).orderBy("record_index").collect()
        assert detail[1].hits == [0] * 5 + [1] * 4 and tuple(total.first()) == (3, 29, 12, 12)


def test_random_sequences_do_not_depend_on_partitions(spark):
    a = fastx.random_sequences(spark, 20, 40, fastx.RESIDUES, 7)
    assert {r.record_index: r.sequence for r in a.collect()} == {r.record_index: r.sequence for r in a.repartition(3).collect()}
    assert all(len(r.sequence) == 40 and set(r.sequence) <= set(fastx.RESIDUES) for r in a.collect())
    assert fastx.random_kmers(spark, 10, 20).where("packed < 0 or packed >= 1048576").isEmpty()
