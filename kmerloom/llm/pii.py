r"""Sanitisation of personal data by information theory. Native: DataFrame functions only.

Protected entities are found by pattern: email, ip, card (16 to 19 digits passing Luhn), phone. From the corpus it is estimated how much a term
in an entity's document reveals it. With n(e) documents that hold entity e and N documents in all, the disclosure of e by a term t is
PMI(e;t) / IC(e) = 1 + log2 p(e|t) / -log2(n(e) / N): 1 if t is never seen without e, 0 if they are independent.

p(e|t) is n(e,t) / n(t), of n(t) documents that hold t and n(e,t) documents that hold both, smoothed: seen in m different texts
(copies count once here), it weighs m / (m + prior), its back-off prior / (m + prior). The back-off is p(kind|t) p(e|kind), with p(kind|t) smoothed likewise
by the kind's share of all documents, and p(e|kind) e's share of the texts of its kind, with `prior` texts added for entities unseen. So an entity of one
text loses terms too, in a corpus large enough that one text is evidence: with prior 1, p of a term of one text alone is about 1/2, which exceeds a
threshold of 0.9 from about 1000 documents on; a term of more documents must be seen with the entity in a share of them that
shrinks with IC(e). A term whose disclosure is at least `threshold` is a span of kind `term` wherever it stands in a document that holds e; documents that
hold the term without e keep it.

sanitise() replaces protected spans by their kind, removes terms that are never seen without the entity, and generalises the others: a
term gives way to the class of all terms of the corpus that begin as it does, named by that beginning, with the longest beginning whose class discloses
less than the threshold: 1 + log2(sum of n(e,t') / sum of n(t')) / IC(e) over the terms t' of the class. Without such a class it is [TERM].

Terms are runs of three or more letters, lower-cased, outside protected spans. Work beyond one pass over all texts is on
documents that hold entities: a row for each occurrence of a term, and for each pair of an entity and a distinct term of a document.
All steps take time in proportion to a text's length and its number of spans: matches are laid out in runs, and texts are cut by bytes.

Patterns are written so that matching takes linear time without recursion: possessive runs that start at the run's begin or the
last match's end (\G), bounded repeats for cards, and a lazy run for an email's domain; their matches are those of the plain patterns.

Edge cases: null and empty texts have no spans. Rows are numbered when first written, so repeated ids and rows stay apart. Very long texts are taken whole.
Of spans that overlap each leaves its label. A word beside the control character 127 may not count as a term there. An empty table gives none. Other columns are kept by sanitise(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import let
from .store import saved, table

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++\.{_LABEL}[A-Za-z0-9.-]*?(?=\.(?!{_LABEL})|[^A-Za-z0-9.-]|\z)"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"(?<=\P{L})\p{L}{3,}+(?=\P{L})"
KINDS = ("email", "ip", "card", "phone", "term")
THRESHOLD, PRIOR = 0.9, 1.0
RUN, PLACE = 256, "struct<start:bigint,end:bigint,first:bigint,last:bigint,value:string>"
SPANS = "array<struct<kind:string,start:bigint,end:bigint,first:bigint,last:bigint,value:string>>"
ALL = "array<struct<kind:string,start:bigint,end:bigint,first:bigint,last:bigint,label:string>>"
#: Stands for a protected letter in a text whose other protected characters are blanks: no letter, so that no term reaches over it. Protected spans are ASCII.
HIDDEN = "\x7f"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    def total(d: Column) -> Column:
        n = F.length(d)
        twice = lambda i: d.substr(i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return F.aggregate(F.transform(F.sequence(F.lit(1), n), lambda i: let(twice(i), lambda x: F.when(x > 9, x - 9).otherwise(x))), F.lit(0), lambda a, b: a + b) % 10

    return let(_digits(m), total) == 0


RULES = {
    "email": (EMAIL, lambda m: F.lit(True)),
    "ip": (IP, lambda m: m.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")),
    "card": (CARD, _luhn),
    "phone": (PHONE, lambda m: F.length(_digits(m)).between(8, 15)),
}


def running(xs: Column, zero: Column, step, kind: str) -> Column:
    """The states after each element, from `zero` on: step(state, x). In runs of RUN, as appending copies what is there. kind: the state's type."""
    last = lambda a: F.element_at(a, -1)

    def run(a: Column, r: Column) -> Column:
        one = F.aggregate(F.slice(xs, r + 1, F.lit(RUN)), F.array(a["state"]), lambda b, x: F.array_append(b, step(last(b), x)))
        return let(one, lambda b: F.struct(last(b).alias("state"), F.array_append(a["out"], F.slice(b, F.lit(2), F.size(b))).alias("out")))

    start = F.struct(zero.cast(kind).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(xs) > 0, F.flatten(F.aggregate(F.sequence(F.lit(0), F.size(xs) - 1, F.lit(RUN)), start, run, lambda a: a["out"]))).otherwise(F.array().cast(f"array<{kind}>"))


def places(text: Column, pattern: str) -> Column:
    """All matches in order: array of struct(start, end in code points, first, last in UTF-8 bytes, value); they follow from the pieces between matches."""

    def laid(both: Column) -> Column:
        pair = F.arrays_zip(F.slice(both["gaps"], F.lit(1), F.size(both["found"])).alias("gap"), both["found"].alias("value"))

        def step(a: Column, x: Column) -> Column:
            n, m = (lambda c: F.length(c).cast("long")), (lambda c: F.octet_length(c).cast("long"))
            return F.struct(
                (a["end"] + n(x["0"])).alias("start"), (a["end"] + n(x["0"]) + n(x["1"])).alias("end"), (a["last"] + m(x["0"])).alias("first"), (a["last"] + m(x["0"]) + m(x["1"])).alias("last"), x["1"].alias("value")
            )

        zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("start", "end", "first", "last")), F.lit("").alias("value"))
        return let(pair.cast("array<struct<`0`:string,`1`:string>>"), lambda p: running(p, zero, step, PLACE))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(both, laid)).otherwise(F.array().cast(f"array<{PLACE}>"))


def protected(text: Column) -> Column:
    """The protected spans of a text, by kind, then start."""
    whole = F.coalesce(text, F.lit(""))

    def of(kind: str) -> Column:
        pattern, good = RULES[kind]
        valid = F.filter(places(whole, pattern), lambda m: good(m["value"]))
        return F.transform(valid, lambda m: F.struct(F.lit(kind).alias("kind"), *(m[c].alias(c) for c in ("start", "end", "first", "last", "value"))))

    emails = F.when(F.instr(whole, "@") > 0, of("email")).otherwise(F.array().cast(SPANS))
    return F.concat(emails, *(of(k) for k in RULES if k != "email"))


def _by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def replaced(text: Column, spans: Column, by) -> Column:
    """The text with its spans replaced: by(span, end), where `end` is the end in code points of the spans before it."""
    reach = "struct<end:bigint,last:bigint>"

    def joined(both: Column) -> Column:
        raw, s = both["raw"], both["s"]
        zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("last"))
        upto = F.concat(F.array(zero.cast(reach)), running(s, zero, lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), F.greatest(a["last"], x["last"]).alias("last")), reach))
        cut = lambda a, b: F.when(b > a, F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8")).otherwise(F.lit(""))
        piece = lambda u: lambda x, i: F.concat(cut(u[i]["last"], x["first"]), by(x, u[i]["end"]))
        return let(upto, lambda u: F.concat(F.array_join(F.transform(s, piece(u)), ""), cut(F.element_at(u, -1)["last"], F.octet_length(raw).cast("long"))))

    return let(F.struct(F.encode(text, "UTF-8").alias("raw"), _by_start(spans).alias("s")), joined)


def _terms(text: Column, spans: Column) -> Column:
    """Terms outside protected spans: array of struct(start, end, first, last, term)."""

    def hidden(x: Column, end: Column) -> Column:
        rest = F.when(end <= x["start"], x["value"]).when(end < x["end"], x["value"].substr((end - x["start"] + 1).cast("int"), F.length(x["value"]))).otherwise(F.lit(""))
        return F.regexp_replace(F.regexp_replace(rest, r"\P{L}", " "), r"\p{L}", HIDDEN)

    framed = F.concat(F.lit(" "), replaced(text, spans, hidden), F.lit(" "))  # so the text's code point i is the frame's i + 1
    outside = TERM.replace(r"\P{L}", r"[^\p{L}\x7F]")
    return F.transform(places(framed, outside), lambda m: F.struct(*((m[c] - 1).alias(c) for c in ("start", "end", "first", "last")), F.lower(m["value"]).alias("term")))


def holders(found: DataFrame) -> DataFrame:
    """__row, kind, entity, first: which document holds which entity; first is 1 for one document of those with the same text, else 0."""
    norm = lambda s: F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(_digits(s["value"]))
    some = found.where(F.size("__spans") > 0)
    one = some.select("__row", F.explode("__spans").alias("s")).select("__row", F.col("s.kind").alias("kind"), norm(F.col("s")).alias("entity")).distinct()
    first = some.groupBy(F.xxhash64("__text")).agg(F.min("__row").alias("__row")).select("__row", F.lit(1).alias("first"))
    return one.join(first, "__row", "left").fillna(0, ["first"])


def occurrences(found: DataFrame) -> DataFrame:
    """A row for each place of a term in a document that holds an entity: __row, start, end, first, last, term."""
    terms = found.where(F.size("__spans") > 0).select("__row", F.explode(_terms(F.col("__text"), F.col("__spans"))).alias("t"))
    return terms.select("__row", "t.*")


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, n_t: the documents that hold each term of the corpus."""
    framed = F.concat(F.lit(" "), F.col(text), F.lit(" "))
    each = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(framed, F.lit(TERM), F.lit(0)), F.lower)))
    return docs.select(each.alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def disclosures(words: DataFrame, held: DataFrame, places: DataFrame, total: int, prior: float = PRIOR) -> DataFrame:
    """kind, entity, term, n_et, n_e, disclosure, alone (the term is never seen without the entity); counts cover all documents."""
    seen = lambda n, m: (F.count("*").alias(n), F.sum("first").alias(m))
    terms = places.select("__row", "term").distinct()
    pairs = terms.join(held, "__row").groupBy("kind", "entity", "term").agg(*seen("n_et", "m_et"))
    of_kind = held.select("__row", "kind", "first").distinct()
    kind_terms = terms.join(of_kind, "__row").groupBy("kind", "term").agg(*seen("n_kt", "m_kt"))
    entities = held.groupBy("kind", "entity").agg(*seen("n_e", "m_e"))
    kinds = of_kind.groupBy("kind").agg(F.count("*").alias("n_k")).join(held.groupBy("kind").agg(F.sum("first").alias("m_k")), "kind")
    of_term = saved(kind_terms, "kind-terms").join(words, "term")
    joined = saved(pairs, "pairs").join(of_term, ["kind", "term"]).join(entities, ["kind", "entity"]).join(F.broadcast(kinds), "kind")  # `kinds` is four rows
    n = F.lit(float(total))
    smooth = lambda share, m, back: (F.col(m) * share + prior * back) / (F.col(m) + prior)
    of_kind_given_t = smooth(F.col("n_kt") / F.col("n_t"), "m_kt", F.col("n_k") / n)
    p = smooth(F.col("n_et") / F.col("n_t"), "m_et", of_kind_given_t * F.col("m_e") / (F.col("m_k") + prior))
    ic = -F.log2(F.col("n_e") / n)
    return joined.select("kind", "entity", "term", "n_et", "n_e", (1 + F.log2(p) / F.when(ic > 0, ic)).alias("disclosure"), (F.col("n_et") == F.col("n_t")).alias("alone"))


def classes(risky: DataFrame, pairs: DataFrame, words: DataFrame, total: int, threshold: float) -> DataFrame:
    """kind, entity, term, beginning: for the risky pairs of an entity and a term, the longest beginning of the term whose class discloses less.

    Only beginnings of risky terms are counted; a vocabulary's row adds to each of those that it has.
    """
    begin = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.col(c).substr(F.lit(1), i))).alias("beginning")
    asked = saved(risky.select("kind", "entity", "term", "n_e", begin("term")), "beginnings")
    of_class = words.select(begin("term"), "n_t").join(asked.select("beginning").distinct(), "beginning", "left_semi").groupBy("beginning").agg(F.sum("n_t").alias("n_c"))
    key = ["kind", "entity", "beginning"]
    of_both = pairs.select("kind", "entity", begin("term"), "n_et").join(asked.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.sum("n_et").alias("n_ec"))
    ic = -F.log2(F.col("n_e") / F.lit(float(total)))
    safe = 1 + F.log2(F.col("n_ec") / F.col("n_c")) / F.when(ic > 0, ic) < threshold
    return asked.join(of_both, key).join(of_class, "beginning").where(safe).groupBy("kind", "entity", "term").agg(F.max_by("beginning", F.length("beginning")).alias("beginning"))


def spans(docs: DataFrame, threshold: float = THRESHOLD, prior: float = PRIOR, text: str = "text", keep: tuple[str, ...] = ("doc_id",), labels: bool = False) -> DataFrame:
    """`row` (a struct of the columns `keep`) and `all`: all spans, array of struct(kind, start, end, first, last, label), by kind, then start.

    first and last are places in UTF-8 bytes. labels: what sanitise() puts in place of each span, else null.
    """
    numbered = docs.select(F.struct(*keep).alias("row"), F.monotonically_increasing_id().alias("__row"), F.col(text).alias("__text"), protected(F.col(text)).alias("__spans"))
    found = saved(numbered.withColumn("__text", F.when(F.size("__spans") > 0, F.col("__text"))), "protected")
    where, held = saved(occurrences(found), "occurrences"), saved(holders(found), "holders")
    total, words = docs.count(), vocabulary(docs, text)
    words = saved(words, "vocabulary") if labels else words
    pairs = disclosures(words, held, where, total, prior)
    if labels:
        pairs = saved(pairs, "disclosures")
    risky = saved(pairs.where(F.col("disclosure") >= threshold), "risky")
    label = F.lit(None).cast("string")
    if labels:
        risky = risky.join(classes(risky, pairs, words, total, threshold), ["kind", "entity", "term"], "left")
        # of several entities' classes the most general
        label = F.when(F.max("alone"), F.lit("")).when(F.count("*") > F.count("beginning"), F.lit("[TERM]")).otherwise(F.concat(F.lit("["), F.min_by("beginning", F.length("beginning")), F.lit("*]")))
    of_doc = held.join(risky, ["kind", "entity"]).groupBy("__row", "term").agg(label.alias("label"))
    terms = where.join(of_doc, ["__row", "term"])
    of_row = terms.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "first", "last", "label"))).alias("__terms"))  # one document's own
    at = lambda s: [s[c].alias(c) for c in ("start", "end", "first", "last")]
    base = F.transform("__spans", lambda s: F.struct(s["kind"].alias("kind"), *at(s), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label")))
    more = F.transform("__terms", lambda s: F.struct(F.lit("term").alias("kind"), *at(s), s["label"].alias("label")))
    return found.join(of_row, "__row", "left").select("row", F.concat(base.cast(ALL), F.coalesce(more.cast(ALL), F.array().cast(ALL))).alias("all"))


def sanitise(docs: DataFrame, threshold: float = THRESHOLD, prior: float = PRIOR, text: str = "text") -> DataFrame:
    """docs with protected spans replaced by [EMAIL], [IP], [CARD], [PHONE], and revealing terms by the name of their class, or by nothing."""
    found = spans(docs, threshold, prior, text, tuple(docs.columns), labels=True)
    body = F.col("row")[text]
    new = F.when(F.size("all") > 0, replaced(body, F.col("all"), lambda x, end: x["label"])).otherwise(body)
    return found.select(*(new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def op2_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("all", lambda s: s["kind"] != "term")
    return found.select("row.doc_id", *map(n, KINDS[:4]), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("all")).alias("spans"))
