r"""URL filter with pattern rules indexed by their rarest literal token.

A pattern rule is written as in common filter lists: `||` at the front anchors at a host label, `|` at an end
anchors there, `^` stands for a separator (anything but letters, digits, `_ - . %`) or the end, `*` for anything;
other characters stand for themselves; letters match in either case. A prefix `@@` makes it an allowing rule, which overrides
blocking ones. A rule's literal tokens are its runs of letters and digits that any match must hold as a whole run,
so never runs beside `*` or an open end. Each rule is filed under the one of them that is rarest among all URLs (ties: the first in the alphabet);
rules without one are filed under no token and tried on every URL.

A URL's distinct tokens fetch candidate rules; only those run their regular expression. Rules are a tuple or a table (rules_table() reads files). Up to HELD of them go to every worker;
more are joined to the URLs by token, where only rules without a token, again at most HELD, go to every worker.

Edge cases: a null URL, or one without `://`, has an empty host and path, no host rule and, as no pattern is run on it
if null, the verdict allow. Very long URLs are judged whole. Of several patterns that fit, an allowing one decides, then the first in the alphabet. Repeated rows and ids are judged each by itself; other columns are left out. An empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.errors import ResourceError

from .store import column, saved, table

RUN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query's contract.
HOST_RULES = (HostRule("allow", "com", "/"), HostRule("block", "example.com", "/en/"), HostRule("allow", "www.example.com", "/en/"), HostRule("block", "net", "/es/"), HostRule("block", "net", "/fr/"))
#: Production patterns are made of words and forms: hosts that sell gambling, pills, adult content, fakes and loans, or farm links; advertisement and tracking.
HOST_WORDS = (
    "adult", "bingo", "bitcoins", "blackjack", "buylinks", "camgirls", "cams", "cashloan", "casino", "cheap", "cialis", "clickbait", "crack", "dating", "debt", "diet", "escort", "essay", "fakeid", "forex",
    "freebies", "gamble", "jackpot", "keygen", "linkfarm", "loan", "lottery", "pawn", "payday", "pharma", "pills", "poker", "porn", "replica", "roulette", "seo", "sex", "slots", "spam", "tramadol", "viagra", "warez", "xxx",
)
HOST_FORMS = ("||{}-", "||{}.", "||free{}.", "||best{}.", "||online{}.")
AD_WORDS, AD_FORMS = ("ads", "adserver", "adservice", "adtrack", "banner", "clicktrack", "doubleclick", "popunder", "sponsor"), ("://{}.", "||{}-", "/{}/")
PATHS = ("/banner/ads^", "^utm_source=spam^", "||click-track.*/redirect^", "-free-download.", "/affiliate/*?id=", "@@||spam-farm.example.org/en/about^")
PATTERNS = (*(f.format(w) for w in HOST_WORDS for f in HOST_FORMS), *(f.format(w) for w in AD_WORDS for f in AD_FORMS), *PATHS)
#: So many rules go to every worker, a few hundred bytes each.
HELD = 50_000


@dataclass(frozen=True)
class Pattern:
    rule: str
    allow: bool
    regex: str
    tokens: tuple[str, ...]


def compiled(rule: str) -> Pattern:
    """A rule's regular expression and the tokens every match must hold."""
    body = rule[2:] if (allow := rule.startswith("@@")) else rule
    body, out = body.lower(), ""
    host = body.startswith("||")
    front = host or body.startswith("|")
    body = body.lstrip("|") if front else body
    back = body.endswith("|")
    body = body.rstrip("|") if back else body
    out = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*[.@])?" if host else "^" if front else ""
    out += "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in body) + ("$" if back else "")
    tokens = {m.group() for m in RUN.finditer(body) if (m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and front) and (m.end() < len(body) and body[m.end()] != "*" or m.end() == len(body) and back)}
    return Pattern(rule, allow, out, tuple(sorted(tokens)))


def rules_table(spark: SparkSession, path: str) -> DataFrame:
    """rule: the lines of text files, without empty ones and comments (!)."""
    lines = spark.read.text(path).select(F.trim("value").alias("rule"))
    return lines.where((F.col("rule") != "") & ~F.col("rule").startswith("!")).distinct()


def url_tokens(urls: DataFrame, *keep: str) -> DataFrame:
    """keep, token: the distinct tokens of each URL."""
    return urls.select(*keep, F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("token")).where("token <> ''")


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many URLs hold each of the given tokens: counted over all URLs; as many rows come back as there are tokens."""
    asked = urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    return {r.token: r.n for r in url_tokens(urls).join(asked, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}


def indexed(patterns: tuple[str, ...], counts: dict[str, int]) -> dict[str, list[Pattern]]:
    """The rules by their rarest token; under "" those without one."""
    index: dict[str, list[Pattern]] = {}
    for p in map(compiled, patterns):
        index.setdefault(min(p.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(p)
    return index


_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path."""
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(_ASCII_LOWER), re.match(r"[^?#]*", rest[len(host) :]).group()


def host_rule(host: str, path: str, rules: dict[str, list[HostRule]]) -> HostRule | None:
    """The longest rule that fits; each suffix of the host is looked up once."""
    best, at = None, 0
    while True:
        for r in rules.get(host[at:], ()):
            if path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
                best = r
        at = host.find(".", at) + 1
        if not at:
            return best


OUT = "host string, path string, rule string, verdict string, pattern string, n_candidates bigint"


def _judged(url: str | None, hosts: dict[str, list[HostRule]], candidates: Callable[[str], list[tuple[Pattern, re.Pattern]]]) -> tuple:
    host, path = parts(url)
    rule, hit, tried = host_rule(host, path, hosts), None, 0
    if rule is None and url is not None:
        low = url.translate(_ASCII_LOWER)
        found = candidates(low)
        tried = len(found)
        hit = min((p for p, r in found if r.search(low)), key=lambda p: (not p.allow, p.rule), default=None)
    return host, path, rule.name if rule else None, rule.verdict if rule else "block" if hit and not hit.allow else "allow", hit.rule if hit else None, tried


def _batch(keys: pa.Array, rows: list[tuple], key: str) -> pa.RecordBatch:
    fields = [x.split() for x in OUT.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.string() if t == "string" else pa.int64()) for c, (_, t) in zip(cols, fields, strict=True))], names=[key, *(n for n, _ in fields)])


def _made(ps: list[Pattern]) -> list[tuple[Pattern, re.Pattern]]:
    return [(p, re.compile(p.regex, re.S)) for p in ps]


def judge(urls: DataFrame, patterns: tuple[str, ...] | DataFrame = PATTERNS, host_rules: tuple[HostRule, ...] = HOST_RULES, key: str = "page_id") -> DataFrame:
    """For each row of urls (key, url): key, host, path, rule, verdict, pattern (the deciding one), n_candidates (patterns run). patterns: rules, or a table with a column `rule`."""
    hosts: dict[str, list[HostRule]] = {}
    for r in host_rules:
        hosts.setdefault(r.host, []).append(r)
    urls = urls.select(key, F.col("url").cast("string").alias("url"))
    if not isinstance(patterns, tuple):
        some = [r.rule for r in patterns.select("rule").where("rule is not null").distinct().limit(HELD + 1).collect()]
        if len(some) > HELD:
            return _joined(urls, patterns, hosts, key)
        patterns = tuple(some)
    index = indexed(patterns, token_counts(urls, sorted({t for p in map(compiled, patterns) for t in p.tokens})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, list] = {}

        def candidates(low: str) -> list:
            out = []
            for t in ("", *sorted(set(RUN.findall(low)))):
                if t in index:
                    if t not in files:
                        files[t] = _made(index[t])
                    out += files[t]
            return out

        for batch in batches:
            yield _batch(column(batch, key), [_judged(u, hosts, candidates) for u in column(batch, "url").to_pylist()], key)

    return urls.mapInArrow(run, f"{key} {dict(urls.dtypes)[key]}, {OUT}")


def _joined(urls: DataFrame, patterns: DataFrame, hosts: dict[str, list[HostRule]], key: str) -> DataFrame:
    """judge() with more rules than workers hold: each is joined to the URLs by its rarest token."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [compiled(r) for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"rule": [p.rule for p in made], "tokens": pa.array([list(p.tokens) for p in made], pa.list_(pa.string()))})

    numbered = saved(urls.withColumn("__row", F.monotonically_increasing_id()), "urls")
    rules = saved(patterns.select("rule").where("rule is not null").distinct().mapInArrow(cut, "rule string, tokens array<string>"), "rules")
    bare = [r.rule for r in rules.where("size(tokens) = 0").select("rule").limit(HELD + 1).collect()]
    if len(bare) > HELD:
        raise ResourceError(f"more than {HELD} rules have no literal token")
    counts = url_tokens(numbered).groupBy("token").agg(F.count("*").alias("n"))
    of_rule = rules.select("rule", F.explode("tokens").alias("token")).join(counts, "token", "left").groupBy("rule").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    found = url_tokens(numbered, "__row").join(of_rule, "token").groupBy("__row").agg(F.sort_array(F.collect_list("rule")).alias("__rules"))  # the candidates of one URL
    rows = numbered.join(found, "__row", "left").select(key, "url", "__rules")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        always = _made([compiled(r) for r in bare])
        for batch in batches:
            rs = column(batch, "__rules").to_pylist()
            yield _batch(column(batch, key), [_judged(u, hosts, lambda _, r=r: always + _made([compiled(x) for x in r or ()])) for u, r in zip(column(batch, "url").to_pylist(), rs, strict=True)], key)

    return rows.mapInArrow(run, f"{key} {dict(urls.dtypes)[key]}, {OUT}")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("n_candidates")


def _sql() -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    rules = sorted(HOST_RULES, key=lambda r: -len(r.name))
    fits = [(r, f"(host = {lit(r.host)} OR ends_with(host, {lit('.' + r.host)})) AND starts_with(path, {lit(r.path)})") for r in rules]
    case = lambda f: "CASE " + " ".join(f"WHEN {c} THEN {lit(f(r))}" for r, c in fits)
    rules_ = ", ".join(f"({lit(p)})" for p in PATTERNS)
    # A rule's body without its marks, with each character that means something to a regular expression in brackets, then the rule's own signs.
    return f"""
WITH rules AS (SELECT rule, starts_with(rule, '@@') AS allow, CASE WHEN starts_with(rule, '@@') THEN substr(rule, 3) ELSE rule END AS b FROM (VALUES {rules_}) AS v(rule)),
bare AS (SELECT rule, allow, starts_with(b, '||') AS at_host, starts_with(b, '|') AS at_start, ends_with(b, '|') AS at_end, regexp_replace(regexp_replace(b, '^[|]+', ''), '[|]+$', '') AS b FROM rules),
rx AS (SELECT rule, allow, CASE WHEN at_host THEN '^[a-z][-a-z0-9+.]*://([^/?#]*[.@])?' WHEN at_start THEN '^' ELSE '' END
  || replace(replace(regexp_replace(b, '([.?+()=&])', '[\\1]', 'g'), '^', '([^-a-z0-9_.%]|$)'), '*', '.*') || CASE WHEN at_end THEN '$' ELSE '' END AS rx FROM bare),
u AS (SELECT row_number() OVER () AS id, page_id, url, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT id, page_id, url, low, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, {case(lambda r: r.name)} END AS rule, {case(lambda r: r.verdict)} END AS ruled FROM p),
m AS (SELECT id, first(rx.rule ORDER BY NOT allow, rx.rule) AS pattern FROM r JOIN rx ON regexp_matches(low, rx.rx, 's') WHERE r.rule IS NULL GROUP BY id)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN ruled WHEN pattern IS NULL OR starts_with(pattern, '@@') THEN 'allow' ELSE 'block' END AS verdict, pattern FROM r LEFT JOIN m USING (id)"""


SQL = {"op8_url_filter": _sql()}
