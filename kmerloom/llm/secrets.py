r"""Secret scan: an Aho-Corasick automaton finds keywords, anchored regular expressions run only at its hits, and tokens that
carry a checksum are kept only if it is right.

Kinds, in this order: assign (`password = ...` and the like), access (AKIA...), hex (runs of 24 or more of 0-9a-f), then
the method's own: github (ghp_, gho_, ghu_, ghs_, ghr_ with 36 characters, whose last six are the CRC-32 of those
before them in base 62), npm (npm_, the same scheme), pem (a private key block), jwt (three base64url parts whose
first is a JSON object with "alg"). For each kind matches are leftmost and non-overlapping; a match that fails its check is dropped
without another try inside it. Positions are code points, ends exclusive. `hex` has no keyword: its runs are found by their byte
class in the whole batch, so that texts without one cost no pattern. A hit of pem or jwt can reach far, so what lies ahead of it is found once for all hits that share it
(the end of the run, the next END line), and a text of nothing but openings takes linear time.

Edge cases: null and empty texts have no spans; texts of any length are scanned whole; rows are judged each by itself, so ties
and repeated rows don't matter; an empty table gives none; in scan() other columns are left out, in redact() they stay as they are.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import column, per_slice, table, text_offsets, texts

KINDS = ("assign", "access", "hex", "github", "npm", "pem", "jwt")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str, width: int = 6) -> str:
    """CRC-32 of the body in base 62, with leading zeros."""
    x, out = zlib.crc32(body.encode()), ""
    while x:
        x, r = divmod(x, 62)
        out = _62[r] + out
    return out.rjust(width, "0")


def _sealed(m: re.Match) -> bool:
    body = m[0].rpartition("_")[2]
    return len(body) == 36 and base62_crc(body[:30]) == body[30:]


def _alg(head: str) -> bool:
    """Whether a token's first part is a JSON object with "alg"."""
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


class _Jwt:
    """Matches at hits of one text, in order. All hits in one run of base64url meet the same end, so that is tried once."""

    run, tail = re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")

    def __init__(self, text: str):
        self.text, self.end, self.rest = text, -1, None

    def match(self, at: int) -> tuple[int, bool] | None:
        """The match's end, and whether it passes its check."""
        if at >= self.end:
            self.end = self.run.match(self.text, at).end()
            self.rest = self.tail.match(self.text, self.end)
        if not self.rest or self.end == at + 3 or self.text[at : at + 3] != "eyJ":
            return None
        return self.rest.end(), _alg(self.text[at : self.end])


class _Pem:
    """The same for private key blocks: a head, then key characters up to the next END line."""

    head, tail, body = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]*PRIVATE KEY-----"), re.compile(r"[A-Za-z0-9+/=\s:,-]*")

    def __init__(self, text: str):
        self.text, self.reach, self.begin, self.end = text, -1, -1, -1

    def match(self, at: int) -> tuple[int, bool] | None:
        if not (m := self.head.match(self.text, at)):
            return None
        first = m.end() + 1  # a block holds something
        if self.reach < m.end():
            self.reach = self.body.match(self.text, m.end()).end()
        if self.begin < first:
            found = self.tail.search(self.text, first)
            self.begin, self.end = found.span() if found else (len(self.text) + 1, -1)
        return (self.end, True) if self.begin <= self.reach else None


def _matcher(rx: re.Pattern, check: Callable[[re.Match], bool]):
    class Matcher:
        def __init__(self, text: str):
            self.text = text

        def match(self, at: int) -> tuple[int, bool] | None:
            m = rx.match(self.text, at)
            return (m.end(), check(m)) if m else None

    return Matcher


_ASSIGN = _matcher(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= MIN_VALUE)
_SEALED = _matcher(re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]+"), _sealed)
#: Keyword (lower-cased): the kind, and what matches at its hits.
RULES: dict[str, tuple[str, type]] = {
    **{k: ("assign", _ASSIGN) for k in ("password", "passwd", "secret", "token", "apikey", "api_key")},
    "akia": ("access", _matcher(re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= MIN_ACCESS)),
    **{f"gh{c}_": ("github", _SEALED) for c in "pousr"},
    "npm_": ("npm", _SEALED),
    "-----begin ": ("pem", _Pem),
    "eyj": ("jwt", _Jwt),
}
_HEX = re.compile(r"[0-9a-f]{24,}")
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_LOWER = {i: i + 32 for i in range(65, 91)}
_machine: list = []


def automaton():
    import ahocorasick

    if not _machine:
        a = ahocorasick.Automaton()
        for word, rule in RULES.items():
            a.add_word(word, (len(word), *rule))
        a.make_automaton()
        _machine.append(a)
    return _machine[0]


def with_hex(array: pa.Array) -> set[int]:
    """The texts that hold a run of at least MIN_HEX hex digits."""
    raw, off = text_offsets(array)
    if not len(raw):
        return set()
    is_hex = np.concatenate([[False], _IS_HEX[raw], [False]])
    edge = np.flatnonzero(is_hex[1:] != is_hex[:-1])
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= MIN_HEX  # may reach over texts; the pattern decides
    return {d for b, e in zip(begin[long], end[long], strict=True) for d in range(int(np.searchsorted(off, b, "right")) - 1, int(np.searchsorted(off, e, "left")))}


def spans(text: str, hexes: bool = True) -> list[tuple[int, int, str]]:
    """Start, end, kind of all secrets, by start, then kind."""
    found, last = [], {}
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    tries: dict[str, object] = {}
    for at, kind, matcher in sorted({(end - n + 1, kind, matcher) for end, (n, kind, matcher) in automaton().iter(low)}, key=lambda h: h[0]):
        if at < last.get(kind, 0):
            continue
        if kind not in tries:
            tries[kind] = matcher(text)
        if m := tries[kind].match(at):
            last[kind] = m[0]
            if m[1]:
                found.append((at, m[0], kind))
    if hexes:
        found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans: array of struct(kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        array = texts(batch, text)
        hexes = with_hex(array)
        rows = [[{"kind": k, "start": a, "end": b} for a, b, k in spans(s, i in hexes)] for i, s in enumerate(array.to_pylist())]
        return pa.RecordBatch.from_arrays([column(batch, key), pa.array(rows, kind)], names=[key, "spans"])

    return docs.select(key, text).mapInArrow(per_slice(one, name=text), f"{key} {dict(docs.dtypes)[key]}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The same rows and columns; in the text each stretch of overlapping secrets is replaced by [SECRET:kind], and chars, if there is such a column, follows."""
    schema = docs.schema

    def covered(s: str, hexes: bool) -> str:
        out, at, end, label = [], 0, 0, ""
        for a, b, k in [*spans(s, hexes), (len(s), len(s), "")]:
            if a >= end:
                if label:
                    out.append(f"[SECRET:{label}]")
                    at = end
                out.append(s[at:a])
                at, label = a, k
            end = max(end, b)
        return "".join(out)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        array = texts(batch, text)
        hexes = with_hex(array)
        old = column(batch, text).to_pylist()
        new = [None if s is None else covered(s, i in hexes) for i, s in enumerate(old)]
        cols = dict(zip(batch.schema.names, batch.columns, strict=True)) | {text: pa.array(new, column(batch, text).type)}
        if chars in cols:
            cols[chars] = pa.array([n if s == was else len(s) for s, was, n in zip(new, old, cols[chars].to_pylist(), strict=True)], cols[chars].type)
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(per_slice(one, name=text), schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def digest(found: list[tuple[int, int, str]]) -> str:
    """base_sha256 of spans()."""
    return hashlib.sha256(joined([s for s in found if s[2] in ("assign", "access", "hex")]).encode()).hexdigest()


def _sql() -> str:
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    quote = "[\"'']?"  # doubled within a text of SQL
    words = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = {
        "assign": rf"({words}){quote}\x20*[:=]\x20*{quote}([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "github": "gh[pousr]_[A-Za-z0-9]+", "npm": "npm_[A-Za-z0-9]+",
        "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]+?-----END [A-Z ]*PRIVATE KEY-----", "jwt": r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    }
    found = " UNION ALL ".join(f"SELECT id, '{k}' AS kind, {i} AS rank, regexp_extract_all(t, '{p}') AS vs, string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')" for i, (k, p) in enumerate(patterns.items()))
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 31), lambda i: ascii(substr(body, i::INT, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
    base62 = f"array_to_string(list_transform([5, 4, 3, 2, 1, 0], lambda i: substr('{_62}', ((crc // (62 ** i)::BIGINT) % 62)::INT + 1, 1)), '')"
    head = "split_part(v, '.', 1)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT id, kind, rank, unnest(vs) AS v, unnest(gaps[1:len(vs)]) AS gap, unnest(range(1, len(vs) + 1)) AS i FROM ({found})),
p AS (SELECT id, kind, rank, v, sum(length(gap) + length(v)) OVER (PARTITION BY id, kind ORDER BY i) AS e FROM m),
b AS (SELECT *, split_part(v, '_', 2) AS body FROM p),
c AS (SELECT *, CASE WHEN kind IN ('github', 'npm') AND length(body) = 36 THEN {crc} END AS crc FROM b),
good AS (SELECT id, rank, kind, e - length(v) AS s, kind || ':' || (e - length(v)) || ':' || e AS span FROM c WHERE CASE kind
  WHEN 'assign' THEN length(regexp_extract(v, '{patterns['assign']}', 2)) >= {MIN_VALUE} WHEN 'access' THEN length(v) >= {MIN_ACCESS} WHEN 'hex' THEN length(v) >= {MIN_HEX} WHEN 'pem' THEN true
  WHEN 'jwt' THEN coalesce(try(json_exists(decode(from_base64(translate({head}, '-_', '+/') || repeat('=', ((4 - length({head}) % 4) % 4)::INT))), '$.alg')), false)
  ELSE crc IS NOT NULL AND substr(body, 31) = {base62} END),
o AS (SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM good GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (id)"""


SQL = {"op7_secrets": _sql()}
