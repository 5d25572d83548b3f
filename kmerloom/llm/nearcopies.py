r"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct shingles of five words (lower-cased A-Z). Two documents link when the Jaccard similarity of their sets is at least 0.8.

1. Documents are cut into blocks of word hashes, written once. Equal sets become one: of the documents with a set the first stands for it, found by
   the set's hash alone, so exact copies cost a short row each, and neither shingles nor pairs.
2. Each block sends its distinct shingles to key ranges (in levels, as the module `exchange` says) and
   gets back in how many different sets of a block each occurs: the frequency that fixes the global order (rarest first). A set
   of whose shingles fewer than four fifths occur elsewhere can have no partner and leaves here.
3. Prefix postings: of n shingles in global order the first n - ceil(0.8 n) + 1; two linked sets share one of them, and what
   stands after the first that they share must be enough for the overlap they need.
4. Candidates come in rounds. In each, every posting list compares all its sets with one (one of a few, another in each round), skipping sets already in the
   same component; links found are joined into components. A list of thousands of near copies so costs rows for each copy, not for each pair. After
   the first, when
   the pairs left across components are few for the postings, or a round found links for few of its pairs, all pairs left across components are
   compared: no link between components is missed. There long lists are cut into parts of LIST sets, each pair of parts being work of its own, and a pair
   is made only if the parities of its shingles in 512 classes differ in so few that it may link; texts that merely share some sentences make none.
5. Candidates are verified by fragments of the global order: sets are cut into segments, by frequency class, as that comes first in the order, and
   within a class into four ranges of keys (intervals of the order for shingles of one frequency); overlaps of segments are
   counted separately for each fragment, and summed per pair.

Shingles are 64-bit hashes; sets are compared by 128-bit hashes where equality is meant. In step 2 keys are cut to 48 bits; a
clash there can only let a document stay for the exact steps.

Edge cases: null and empty texts and texts without words have empty sets and link with nothing. Very long texts are taken whole, each as a block of its own. Fewer than five words: one shingle of them all. Repeated rows
are copies. A null key takes part, but a component's id is the smallest key that isn't null (null if it has none). An empty table gives
none. Other columns are left out by classes(), kept by deduplicate().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import exchange
from .coding import pack, unpack
from .components import components
from .store import arrow, block_ids, column, discard, saved, slices, table, texts, tidy
from .words import Words, shingles, split

BLOCK, PER_RANGE, SHIFT = 4 << 20, 1_000_000, np.uint64(16)
#: Hubs of a group of lists in a round; a round is fruitful if this share of its pairs links; pairs a posting that are few enough to compare all.
HUBS, FRUITFUL, FEW = 4, 0.5, 8
#: Sets of a part of a posting list whose pairs are all compared; words of a set's parities.
LIST, PARITIES = 2048, 8
#: The hash of the empty set.
EMPTY = xxh3_128_digest(b"")
#: So many ids are broadcast to drop documents; more are joined by shuffle.
BROADCAST = 1_000_000


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each block: keys, words as places among its distinct ones, their hashes, the 16-byte hashes of the documents' sets."""
    schema = f"block bigint, docs array<{dict(docs.dtypes)[key]}>, index binary, bounds binary, words binary, sets binary, n bigint"
    out = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in zip(block_ids(), slices(batches, BLOCK, text)):
            w, ids = split(texts(batch, text)), column(batch, key)
            keys, at = shingles(w)
            hashes = b"".join(xxh3_128_digest(keys[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True))
            cols = [pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in (pack(w.index.astype(np.uint32)), pack(w.bounds.astype(np.int64), True), w.hashes.tobytes(), hashes)), pa.array([len(w.index)])]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(cols, out, strict=True)], names=out.names)

    return docs.select(key, text).mapInArrow(run, schema)


def distinct_sets(made: DataFrame) -> DataFrame:
    """A row for each set that isn't empty: set, block and i of the first document with it, doc (the smallest key), copies."""
    one = made.select("block", "docs", "sets", F.posexplode(F.sequence(F.lit(0), F.size("docs") - 1)).alias("i", "at"))
    one = one.select("block", "i", F.get("docs", "at").alias("doc"), F.substring("sets", F.col("at") * 16 + 1, F.lit(16)).alias("set")).where(F.col("set") != F.lit(EMPTY))
    first = one.groupBy("set").agg(F.min(F.struct("block", "i")).alias("at"), F.min("doc").alias("doc"), F.count("*").alias("copies"))
    return first.select("set", "at.block", "at.i", "doc", "copies")


class Sets:
    """A block's sets: keys and bounds, the hash of each, and its distinct keys cut to 48 bits with the number of different sets that hold each."""

    def __init__(self, row: dict):
        w = Words(unpack(row["index"], np.uint32).astype(np.int64), unpack(row["bounds"], np.int64, True), np.frombuffer(row["words"], np.uint64))
        self.keys, self.bounds = shingles(w)
        self.hashes = [row["sets"][i : i + 16] for i in range(0, len(row["sets"]), 16)]
        seen, first = set(), np.zeros(len(self.hashes), bool)
        for i, h in enumerate(self.hashes):
            first[i] = h not in seen
            seen.add(h)
        self.cut, self.count = np.unique((self.keys >> SHIFT)[np.repeat(first, np.diff(self.bounds))], return_counts=True)


def _ask(fan: int):
    out = arrow(exchange.schema(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Sets(row)
                sent = exchange.rows(row["block"], s.cut << SHIFT, [s.count.astype(np.uint64)], fan)
                yield pa.RecordBatch.from_arrays([pa.array(sent[f.name], f.type) for f in out], names=out.names)
        tidy()

    return run


def needed(n: np.ndarray) -> np.ndarray:
    """ceil(0.8 n)."""
    return (4 * n + 4) // 5


def _keep(key: str, kind: str):
    schema = f"{key} {kind}, n bigint, set binary, keys array<bigint>, counts array<int>"
    out = arrow(schema)

    def kept(own: pa.Table, answers: pa.Table) -> pa.Table:
        rows = own.to_pylist()
        if not rows:
            return out.empty_table()
        s, a = Sets(rows[0]), answers.sort_by("range").to_pydict()
        total = np.concatenate([unpack(x, np.uint64) for x in a["t0"] if x is not None] or [np.zeros(0, np.uint64)])
        first = {x["i"]: x["copies"] for xs in a["own"] if xs for x in xs}  # the sets that this block's documents stand for
        own_total = total[np.searchsorted(s.cut, s.keys >> SHIFT)] if len(s.keys) else total
        n = np.diff(s.bounds)
        shared = np.concatenate([[0], np.cumsum(own_total > 1)])
        # A set that is whole in another document has that as its partner, also where its shingles are in no other set.
        stays = (n > 0) & ((np.diff(shared[s.bounds]) >= needed(n)) | np.array([first.get(i, 0) > 1 for i in range(len(n))], bool))
        keys, counts = [], []
        for i in range(len(n)):
            if not stays[i] or i not in first:
                keys.append(None)
                counts.append(None)
                continue
            k, c = s.keys[s.bounds[i] : s.bounds[i + 1]].view(np.int64), own_total[s.bounds[i] : s.bounds[i + 1]].astype(np.int32)
            order = np.lexsort((k, c))
            keys.append(k[order])
            counts.append(c[order])
        return pa.table([pa.array(rows[0]["docs"], out.field(0).type), pa.array(n, pa.int64()), pa.array(s.hashes, pa.binary()), pa.array(keys, out.field(3).type), pa.array(counts, out.field(4).type)], schema=out)

    def fn(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = kept(own, answers)
        tidy()
        return out

    return fn, schema


def sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two written tables: of each document key, n (size of the set), set (its hash), and keys and counts in global order if it is the first with
    a set that may have a partner; and distinct_sets()."""
    spark = docs.sparkSession
    made = saved(blocks(docs, key, text), "sets-blocks")
    size = made.agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).first()
    first = saved(distinct_sets(made), "distinct-sets")
    plan = exchange.plan(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size.n or 0) // PER_RANGE)), size.blocks)
    answers = exchange.totals(made.mapInArrow(_ask(plan.fan), exchange.schema(1)), plan, 1)
    own = first.groupBy("block").agg(F.collect_list(F.struct("i", "copies")).alias("own"))  # a block's documents
    both = answers.select("unit", "range", "t0", F.lit(None).cast(own.schema["own"].dataType).alias("own")).union(own.select("block", F.lit(-1).cast("long"), F.lit(None).cast("binary"), "own"))
    fn, schema = _keep(key, dict(docs.dtypes)[key])
    out = saved(made.groupBy("block").cogroup(both.groupBy("unit")).applyInArrow(fn, schema), "sets")
    discard(made)
    return out, first


def segments(reps: DataFrame) -> DataFrame:
    """rid, fragment, part: each set cut by the global order; keys of one set alone are left out, as they overlap with nothing."""
    one = reps.select("rid", F.explode(F.arrays_zip("keys", "counts")).alias("z")).where("z.counts > 1")
    fragment = (F.floor(F.log2("z.counts")) * 4 + F.shiftrightunsigned("z.keys", 62)).cast("int")
    return one.groupBy("rid", fragment.alias("fragment")).agg(F.collect_list("z.keys").alias("part"))  # a part of one set


def verified(pairs: DataFrame, parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: overlaps are counted by fragment and summed."""
    left = pairs.join(parts.select(F.col("rid").alias("a"), "fragment", F.col("part").alias("pa")), "a")
    each = left.join(parts.select(F.col("rid").alias("b"), "fragment", F.col("part").alias("pb")), ["b", "fragment"])
    summed = each.select("a", "b", F.size(F.array_intersect("pa", "pb")).alias("o")).groupBy("a", "b").agg(F.sum("o").alias("o"))
    n = sizes.select("rid", "n")
    with_n = summed.join(n.select(F.col("rid").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("rid").alias("b"), F.col("n").alias("nb")), "b")
    return with_n.where("100 * o >= 80 * (na + nb - o)").select("a", "b")


#: Whether two sets that share a shingle, at these places of theirs, may link if it is the first that they share: at least 4/9 of both must be common.
_MAY = "9 * least(x.n - x.pos, y.n - y.pos) >= 4 * (x.n + y.n)"


def parities(keys: Column) -> list[Column]:
    """A bit for each of 64 * PARITIES classes of keys: whether the set holds an odd number of it. Two sets' bits differ in at most as many as their keys."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))
    own = lambda w: F.filter(keys, lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(PARITIES - 1)) == w)
    return [F.aggregate(own(w), F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(bit(k))).alias(f"p{w}") for w in range(PARITIES)]


def left_over(live: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b: the pairs of postings (key, rid, label, n, pos) across labels that may link."""
    long = live.groupBy("key").agg(F.ceil(F.count("*") / LIST).cast("int").alias("parts"))
    bits = reps.join(live.select("rid").distinct(), "rid", "left_semi").select("rid", *parities(F.col("keys")))
    rows = saved(live.select("key", "rid", "label", "n", "pos").join(long, "key").join(bits, "rid"), "left-over")
    x = rows.withColumn("part", F.pmod(F.xxhash64("rid"), "parts").cast("int")).alias("x")
    y = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    differ = sum((F.bit_count(F.col(f"x.p{w}").bitwiseXOR(F.col(f"y.p{w}"))) for w in range(1, PARITIES)), F.bit_count(F.col("x.p0").bitwiseXOR(F.col("y.p0"))))
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.rid") < F.col("y.rid"))
    may = (F.col("x.label") != F.col("y.label")) & F.expr(_MAY) & (9 * differ <= F.col("x.n") + F.col("y.n"))  # linked sets differ in at most a ninth of both
    return x.join(y, on & may).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct()


def linked(reps: DataFrame) -> DataFrame:
    """rid, label, for representatives in components of two or more."""
    spark = reps.sparkSession
    prefix = F.expr("slice(arrays_zip(keys, counts), 1, cast(n - div(4 * n + 4, 5) + 1 as int))")
    own = F.size(F.filter("counts", lambda c: c <= 1)).alias("own")  # shingles of no other set
    cut = reps.select("rid", "n", own, prefix.alias("prefix"))  # once a set, not once a posting
    postings = cut.select("rid", "n", "own", F.posexplode("prefix").alias("pos", "z")).where("z.counts > 1").select(F.col("z.keys").alias("key"), "rid", "n", "own", "pos")
    shared = postings.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    live = saved(postings.join(shared, "key").withColumn("label", F.col("rid")), "postings")
    parts = saved(segments(reps.join(live.select("rid").distinct(), "rid", "left_semi")), "segments")
    labels, tested, turn, fruitful = spark.createDataFrame([], "node bigint, label bigint"), [], 0, True
    while True:
        per = live.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("sq"), F.count("*").alias("labels")).where("labels > 1")
        new = saved(live.join(per.select("key"), "key", "left_semi"), "live")
        left = per.agg(F.sum((F.col("m") * F.col("m") - F.col("sq")) / 2).alias("pairs"), F.sum("m").alias("rows")).first()
        discard(live)
        live = new
        if not left.rows:
            return labels
        final = turn > 0 and (left.pairs <= FEW * left.rows or not fruitful)
        if final:
            found = left_over(live, reps)
            for t in tested:
                found = found.join(t, ["a", "b"], "left_anti")
        else:
            # First those with the fewest shingles of their own, which stand nearest to the others; then any, so that neighbouring lists agree on a few.
            pick = F.struct(F.col("own") if not turn else F.lit(0), F.xxhash64("rid", F.pmod("key", F.lit(HUBS)), F.lit(turn)))
            hubs = live.groupBy("key").agg(F.min_by(F.struct("rid", "n", "label", "pos"), pick).alias("y"))
            x, y = live.alias("x"), hubs.select("key", "y.*").alias("y")
            found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & F.expr(_MAY)).select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")).distinct()
        pairs = saved(found, "pairs")
        links = saved(verified(pairs, parts, reps), "links")
        n_links, n_pairs = links.count(), pairs.count()
        if n_links:
            # what is joined already are edges too: each node with its label
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))
        if final:
            return labels
        tested.append(pairs)
        fruitful = n_pairs > 0 and n_links >= FRUITFUL * n_pairs
        turn += 1
        live = saved(live.drop("label").join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid")), "labelled")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id: the smallest key of the documents reachable by links, itself included."""
    all_sets, first = sets(docs, key, text)
    reps = saved(all_sets.where("keys is not null").select(F.monotonically_increasing_id().alias("rid"), "set", "n", "keys", "counts"), "representatives")
    labels = linked(reps.select("rid", "n", "keys", "counts"))
    of_set = reps.select("rid", "set").join(first.select("set", "doc"), "set").join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    smallest = of_set.groupBy("label").agg(F.min("doc").alias("component"))
    named = of_set.join(smallest, "label").select("set", "component", F.lit(True).alias("some"))
    joined = all_sets.select(key, "n", "set").join(named, "set", "left")
    return joined.select(key, F.col("n").alias("n_shingles"), F.when(F.col("some"), F.col("component")).otherwise(F.col(key)).alias("component_id"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest key, a null key last; of those with one key, that of the smallest hash of its text.

    Rows are told apart by key and text, so what becomes of a row does not touch another with its key. Rows that repeat a key and text become one. A row with
    a null key is dropped if it is a near copy of a kept one, and kept if it is not.
    """
    id_ = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    found = saved(classes(docs.select(id_.alias("__id"), text), "__id", text), "classes")
    gone = found.where(~F.col("__id").eqNullSafe(F.col("component_id"))).select(F.col("__id.key").alias("__key"), F.col("__id.hash").alias("__hash")).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST else gone  # else texts are shuffled for nothing
    out = docs.join(gone, F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(text) == F.col("__hash")), "left_anti").select(*docs.columns)
    if found.groupBy("__id").count().where("count > 1").isEmpty():
        return out
    own = out.withColumn("__text", F.xxhash64(text)).dropDuplicates([key, "__text"])
    return own.select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and whatever is reachable by links, without candidates, blocks or hashes.
SQL = {
    "op5_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w WHERE len(ws) >= 5),
g AS (SELECT id, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS g FROM t WINDOW o AS (PARTITION BY id ORDER BY i)),
e AS (SELECT DISTINCT id, g FROM g WHERE g IS NOT NULL UNION ALL SELECT id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
s AS (SELECT w.id, doc_id, count(g) AS n FROM w LEFT JOIN e ON w.id = e.id GROUP BY w.id, doc_id),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS o FROM e x JOIN e y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT id, id FROM s UNION SELECT reach.id, both_.b FROM reach JOIN both_ ON both_.a = reach.other),
low AS (SELECT reach.id, min(s.doc_id) AS component_id FROM reach JOIN s ON s.id = reach.other GROUP BY reach.id)
SELECT doc_id, n AS n_shingles, component_id FROM s JOIN low USING (id)"""
}
