"""SQL of the k-mer operators for an engine with unsigned 64-bit and 128-bit integers: texts that say the same independently of the Column builders."""

from __future__ import annotations

from kmerloom.config import Config
from kmerloom.functions.bits import GOLDEN, SALTS

_ORDER = {"dna": "ACTG", "dna_triplet": "ACTG", "protein": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "hex": "0123456789ABCDEF"}
TWO64 = "18446744073709551616::UHUGEINT"


def as_bytes(t: str) -> str:
    """One character for each UTF-8 byte; those beyond ASCII become ~."""
    return rf"regexp_replace(regexp_replace(regexp_replace({t}, '[\x{{10000}}-\x{{10FFFF}}]', '~~~~', 'g'), '[\x{{800}}-\x{{FFFF}}]', '~~~', 'g'), '[\x{{80}}-\x{{7FF}}]', '~~', 'g')"


def letters(cfg: Config) -> str:
    o = _ORDER[cfg.alphabet.name]
    return f"[{o}{o.lower()}]"


def signed(x: str) -> str:
    return f"(({x}::HUGEINT + 9223372036854775808) % 18446744073709551616 - 9223372036854775808)::BIGINT"


def times(x: str, c: int) -> str:
    return f"((({x})::UHUGEINT * {c}::UHUGEINT) % {TWO64})::UBIGINT"


def windows(cfg: Config, src: str, name: str = "win") -> str:
    """CTE: key, pos, kmer of src (key, seq)."""
    k, w = cfg.k, cfg.alphabet.width
    return f"""{name}_b AS (SELECT key, {as_bytes('seq')} AS b FROM ({src})),
{name} AS (SELECT key, pos, kmer FROM (SELECT key, i::INT AS pos, substr(b, i * {w} + 1, {k * w}) AS kmer FROM (SELECT key, b, unnest(range(0, greatest(length(b) // {w} - {k - 1}, 0))) AS i FROM {name}_b))
  WHERE regexp_full_match(kmer, '{letters(cfg)}+'))"""


def packed(cfg: Config, src: str, name: str = "win") -> str:
    """CTEs up to {name}_p: key, pos, p (unsigned)."""
    o, n = _ORDER[cfg.alphabet.name], cfg.k * cfg.alphabet.width
    code = f"(strpos('{o}', upper(substr(kmer, i::INT, 1))) - 1)::UBIGINT"
    return f"""{windows(cfg, src, name)},
{name}_p AS (SELECT key, pos, list_reduce(list_transform(range(1, {n + 1}), lambda i: {code}), lambda a, b: a * {1 << cfg.alphabet.unit_bits} + b) AS p FROM {name})"""


def _part(cfg: Config, length: int, offset: int) -> str:
    return f"((p >> {cfg.bits * (cfg.k - offset - length)}) & {(1 << cfg.bits * length) - 1}::UBIGINT)"


def located(cfg: Config, shards: int, src: str, name: str = "win") -> str:
    """CTEs up to {name}_l: key, pos, p, mini, shard, h0.., m0 to m3."""
    mini = f"least({', '.join(times(_part(cfg, cfg.m, o), GOLDEN) for o in range(cfg.minimizer_span))})"
    hs = ", ".join(f"xor({times(_part(cfg, cfg.s, o), GOLDEN)}, {times(_part(cfg, cfg.s, o), GOLDEN)} >> 33) AS h{o}" for o in range(cfg.smer_span))

    def address(o: int, i: int) -> str:
        return f"((h{o} >> {64 // cfg.hashes * i}) & 63)" if cfg.hashes <= 8 else f"({times(f'h{o}', SALTS[i])} >> 58)"

    ms = ", ".join("(" + " | ".join(f"(1::UBIGINT << {address(o, i)})" for o in range(cfg.smer_span) for i in range(w, cfg.hashes, 4)) + f") AS m{w}" for w in range(4))
    return f"""{packed(cfg, src, name)},
{name}_h AS (SELECT key, pos, p, {mini} AS mini, {hs} FROM {name}_p),
{name}_l AS (SELECT *, (mini & {shards - 1})::BIGINT AS shard, {ms} FROM {name}_h)"""


def built(src: str = "win_l", name: str = "flt") -> str:
    return f"{name} AS (SELECT shard, bit_or(m0) AS w0, bit_or(m1) AS w1, bit_or(m2) AS w2, bit_or(m3) AS w3 FROM {src} GROUP BY shard)"


HIT = "coalesce((w0 & m0) = m0 AND (w1 & m1) = m1 AND (w2 & m2) = m2 AND (w3 & m3) = m3, false)"


def valid_count(cfg: Config, b: str = "b") -> str:
    """Valid windows of a text of one-byte symbols, by its runs."""
    return f"coalesce(list_sum(list_transform(regexp_extract_all({b}, '{letters(cfg)}{{{cfg.k},}}'), lambda x: length(x) - {cfg.k - 1})), 0)::BIGINT"
