"""python -m kmerloom --insert FILES [--query FILES ...]: build a filter and report on queries."""

from __future__ import annotations

import argparse

from kmerloom.config import DNA, DNA_TRIPLET, PROTEIN, Config, bits_for
from kmerloom.operators.filter import KmerFilter, insert_report
from kmerloom.session import ship
from kmerloom.sources import fastx

ALPHABETS = {a.name: a for a in (DNA, DNA_TRIPLET, PROTEIN)}


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="kmerloom", description=__doc__)
    p.add_argument("--insert", required=True, help="FASTA or FASTQ files whose k-mers are inserted")
    p.add_argument("--query", action="append", default=[], help="files to query, each reported on")
    p.add_argument("--alphabet", choices=ALPHABETS, default="dna")
    for name, value, text in (("k", 31, "k-mer length"), ("s", 28, "s-mer length"), ("m", 16, "minimizer length"), ("hashes", 4, "hashes of an s-mer")):
        p.add_argument(f"--{name}", type=int, default=value, help=text)
    p.add_argument("--bits", type=int, default=0, help="filter bits; by default 16 for each k-mer")
    p.add_argument("--save", default="", help="where to save the filter")
    return p.parse_args(args)


def main(args: list[str] | None = None, spark=None) -> list[dict]:
    from pyspark.sql import SparkSession

    o = arguments(args)
    spark = ship(spark or SparkSession.builder.appName("kmerloom").getOrCreate())
    cfg = Config(o.k, o.s, o.m, o.hashes, ALPHABETS[o.alphabet])
    inserted = fastx.read(spark, o.insert)
    out = [insert_report(inserted, cfg).first().asDict()]
    flt = KmerFilter.build(inserted, cfg, o.bits or bits_for(out[0]["inserted_kmers"]))
    if o.save:
        flt.save(o.save)
        flt = KmerFilter.open(spark, cfg, flt.filter_bits, o.save)
    out[0] |= {"filter_bits": flt.filter_bits, "load_factor": flt.load_factor()}
    out += [{"query": q} | flt.query_report(fastx.read(spark, q)).first().asDict() for q in o.query]
    for row in out:
        print("  ".join(f"{k}={v}" for k, v in row.items()))
    return out


if __name__ == "__main__":
    main()
