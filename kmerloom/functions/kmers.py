"""k-mer windows, packing, minimizers and filter masks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kmerloom.config import Alphabet, Config

from .bits import any_of, bit_address, hash64, mask_of, minimizer_hash64, right, unsigned_least


def as_bytes(sequence: Column) -> Column:
    """A string with one character for each UTF-8 byte, as symbols are bytes."""
    return F.decode(F.encode(sequence, "UTF-8"), "ISO-8859-1")


def symbol_count(sequence: Column, alphabet: Alphabet) -> Column:
    """Whole symbols; a trailing part of one is ignored."""
    return F.floor(F.octet_length(sequence) / alphabet.width).cast("long")


def kmer_count(sequence: Column, config: Config) -> Column:
    """Windows, valid or not."""
    return F.greatest(symbol_count(sequence, config.alphabet) - config.k + 1, F.lit(0)).cast("long")


def all_valid(sequence: Column, alphabet: Alphabet) -> Column:
    """No byte is invalid."""
    return ~as_bytes(sequence).rlike("[^" + alphabet.byte_class[1:])


def valid_kmer_count(sequence: Column, config: Config) -> Column:
    """Windows of valid symbols only, from the lengths of runs of valid symbols; no window is made."""
    a = config.alphabet
    if a.width == 1:
        runs = F.regexp_extract_all(as_bytes(sequence), F.lit(f"{a.byte_class}{{{config.k},}}"), F.lit(0))
        lengths = F.transform(runs, F.length)
    else:
        marks = F.translate(F.array_join(F.transform(_symbols(as_bytes(sequence), a), lambda s: F.when(s.rlike(rf"^{a.byte_class}{{{a.width}}}\z"), F.lit("1")).otherwise(F.lit("0"))), ""), "", "")
        lengths = F.transform(F.regexp_extract_all(marks, F.lit(f"1{{{config.k},}}"), F.lit(0)), F.length)
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda x, n: x + (n - config.k + 1))


def _symbols(text: Column, a: Alphabet) -> Column:
    n = F.floor(F.length(text) / a.width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: text.substr(i * a.width + 1, F.lit(a.width)))).otherwise(F.array().cast("array<string>"))


def valid_runs(text: Column, config: Config) -> Column:
    """Runs of at least k valid one-byte symbols: array of struct(start, run as bytes). Starts follow from the lengths of the pieces between runs."""
    rx = f"{config.alphabet.byte_class}{{{config.k},}}"
    kind = "array<struct<start:int,run:binary>>"

    def laid(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        begin = lambda a, i: a["at"] + gaps[i]
        step = lambda a, i: F.struct((begin(a, i) + F.length(found[i])).alias("at"), F.array_append(a["out"], F.struct(begin(a, i).alias("start"), F.encode(found[i], "ISO-8859-1").alias("run"))).alias("out"))
        # in parts of 256 runs, as appending copies what is there
        part = lambda at, r: F.aggregate(F.sequence(r, F.least(r + 256, F.size(found)) - 1), F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step)
        whole = lambda a, r: F.transform(F.array(part(a["at"], r)), lambda p: F.struct(p["at"].alias("at"), F.array_append(a["out"], p["out"]).alias("out")))[0]
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.size(found) - 1, F.lit(256)), start, whole, lambda a: a["out"]))

    both = F.struct(F.regexp_extract_all(text, F.lit(rx), F.lit(0)).alias("found"), F.transform(F.split(text, rx, -1), F.length).alias("gaps"))
    return F.when(text.rlike(rx), F.transform(F.array(both), laid)[0])


def windows(records: DataFrame, config: Config, sequence: str = "sequence", *keep: str, valid: bool = True) -> DataFrame:
    """A row for each window: keep, pos (symbols from the start), kmer. valid: only those without an invalid symbol.

    Valid windows of one-byte symbols are cut from runs of valid symbols, so windows that would be dropped are not made.
    """
    k, w = config.k, config.alphabet.width
    raw = F.col("__raw")  # bytes, as a part of them is found by its place without counting characters from the start
    starts = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1))
    cut = lambda at: F.decode(F.substring(raw, at * w + 1, F.lit(k * w)), "ISO-8859-1").alias("kmer")
    if valid and w == 1:
        runs = records.select(*keep, as_bytes(F.col(sequence)).alias("__text")).select(*keep, F.explode(valid_runs(F.col("__text"), config)).alias("__run"))
        out = runs.select(*keep, F.col("__run.start").alias("__start"), F.col("__run.run").alias("__raw"))
        out = out.select(*keep, "__start", "__raw", F.explode(starts(F.octet_length(raw) - k + 1)).alias("__at"))
        return out.select(*keep, (F.col("__start") + F.col("__at")).alias("pos"), cut(F.col("__at")))
    n = F.floor(F.octet_length(raw) / w).cast("int") - k + 1
    out = records.select(*keep, F.encode(F.col(sequence), "UTF-8").alias("__raw")).select(*keep, "__raw", F.explode(starts(n)).alias("pos"))
    out = out.select(*keep, "pos", cut(F.col("pos")))
    return out.where(F.col("kmer").rlike(rf"^{config.alphabet.byte_class}+\z")) if valid else out


def packed(kmer: Column, config: Config) -> Column:
    """A valid k-mer as 64 bits, first symbol most significant."""
    a = config.alphabet
    return F.conv(F.translate(kmer, *a.digits), 1 << a.unit_bits, -10).cast("long")


def part(kmer: Column, config: Config, length: int, offset: int) -> Column:
    """The packed sub-window of `length` symbols at `offset`."""
    return right(kmer, config.bits * (config.k - offset - length)).bitwiseAND(F.lit(mask_of(config.bits * length)))


def minimizer(kmer: Column, config: Config) -> Column:
    """The least hash, as unsigned, of the packed k-mer's m-mers."""
    return unsigned_least([minimizer_hash64(part(kmer, config, config.m, o)) for o in range(config.minimizer_span)])


def shard(minimizer_hash: Column, num_shards: int) -> Column:
    """Never null: a join on it adds no filter that would compute it twice."""
    return F.coalesce(minimizer_hash.bitwiseAND(F.lit(num_shards - 1)), F.lit(0).cast("long"))


def smer_hashes(kmer: Column, config: Config) -> Column:
    """Array of the hashes of the packed k-mer's s-mers, by offset."""
    return F.array(*(hash64(part(kmer, config, config.s, o)) for o in range(config.smer_span)))


def masks(hashes: Column, config: Config) -> list[Column]:
    """The bits that a k-mer sets in the four words of its shard."""
    one = F.lit(1).cast("long")
    of = lambda w: [F.call_function("shiftleft", one, bit_address(hashes[o], i, config.hashes)) for o in range(config.smer_span) for i in range(w, config.hashes, 4)]
    return [any_of(of(w)) for w in range(4)]


def located(kmers: DataFrame, config: Config, num_shards: int, kmer: str = "packed") -> DataFrame:
    """kmers with minimizer, shard and the masks m0 to m3 of a packed k-mer; each step is computed once."""
    out = kmers.withColumn("minimizer", minimizer(F.col(kmer), config)).withColumn("__h", smer_hashes(F.col(kmer), config))
    ms = dict(zip(("m0", "m1", "m2", "m3"), masks(F.col("__h"), config), strict=True))
    return out.withColumns({"shard": shard(F.col("minimizer"), num_shards), **ms}).drop("__h")


def super_kmers(kmers: DataFrame, key: str) -> DataFrame:
    """Runs of neighbouring windows with the same shard: key, start, n, shard. kmers: key, pos, shard."""
    by = Window.partitionBy(key).orderBy("pos")
    head = (F.lag("shard").over(by).isNull() | (F.lag("shard").over(by) != F.col("shard")) | (F.lag("pos").over(by) != F.col("pos") - 1)).cast("int")
    runs = kmers.withColumn("__head", head).withColumn("__run", F.sum("__head").over(by))
    return runs.groupBy(key, "__run", "shard").agg(F.min("pos").cast("long").alias("start"), F.count("*").alias("n")).drop("__run")


def spectrum(kmers: DataFrame, kmer: str = "packed") -> DataFrame:
    """How often each k-mer occurs."""
    return kmers.groupBy(kmer).agg(F.count("*").alias("n"))
