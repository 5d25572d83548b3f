import numpy as np
import xxhash

from kmerloom.__main__ import main
from kmerloom.functions import vector
from kmerloom.operators import analysis


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text(">a\nACGTACGTACGTACGTTTGACA\n")
    (tmp_path / "b.fa").write_text(">b\nACGTACGTACGTACGTTTGACA\n>c\nGGGGGGGGGG\n")
    rows = main(["--insert", str(tmp_path / "a.fa"), "--query", str(tmp_path / "b.fa"), "--k", "9", "--s", "7", "--m", "4", "--save", str(tmp_path / "f")], spark)
    assert rows[0]["inserted_kmers"] == 14 and rows[0]["filter_bits"] == 256 and rows[0]["load_factor"] > 0
    assert rows[1]["records_queried"] == 2 and rows[1]["positive_kmers"] >= 14 and "positive_kmers=" in capsys.readouterr().out


def test_read_results(spark, tmp_path):
    (tmp_path / "a.csv").write_text('run on some host\n2026\n\nname,iterations,real_time,items_per_second,s\n"Sharded,Bloom/Insert/65536_median",5,1.5,2e9,28\n"Bad ""one""",1,,x,\n')
    (tmp_path / "b.csv").write_text("name,m\nOther_mean,16\n")
    rows = sorted((r.name, r.real_time, r.items_per_second, r.s, r.m) for r in analysis.read_results(spark, str(tmp_path / "*.csv")).collect())
    assert rows == [('Bad "one"', None, None, None, None), ("Other_mean", None, None, None, 16.0), ("Sharded,Bloom/Insert/65536_median", 1.5, 2e9, 28.0, None)]


def test_xxhash64():
    keys = np.array([0, 1, 1 << 63], np.uint64)
    assert vector.xxhash64(keys, 7).tolist() == [xxhash.xxh64_intdigest(int(k).to_bytes(8, "little"), 7) for k in keys]
