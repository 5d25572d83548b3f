import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from kmerloom.llm import exchange, lm, nearcopies, packing, quality, secrets
from kmerloom.llm.components import components
from kmerloom.llm.coding import pack, unpack
from kmerloom.llm.words import shingles, split
from tests.oracle import DATA, expect

from .conftest import ODD, words


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(docs):
    sets, up = [(i, shingle_set(t)) for i, t in docs], {}
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted(((d, len(s), low.get(top(i))) for i, (d, s) in enumerate(sets)), key=repr)


def near_copies(seed, groups=6, size=25, n=60):
    rnd, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(4000)]
    shared = [rnd.choice(vocabulary) for _ in range(50)]
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(n + 5 * g)] + (shared if g % 2 else [])
        for _ in range(size):
            t = list(base)
            for _ in range(rnd.randrange(5)):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            out.append(" ".join(t) if rnd.random() < 0.8 else " ".join(base).upper())
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_op5_is_brute_force(spark, tables, seed):
    docs = near_copies(seed) + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000 + i, t) for i, t in enumerate(ODD)] + [(None, "w w w w w w w"), (None, None)] + [(1, near_copies(seed)[1][1])]
    where = tables(docs, "doc_id bigint, text string")
    found = nearcopies.op5_jaccard_join(spark, where)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=repr) == brute_components(docs)
    expect(found, nearcopies.SQL["op5_jaccard_join"], where)


def test_every_pair_at_the_border(spark):
    """Sets of 9 shingles of which 8 are shared link (8/10); 7 do not."""
    a = [f"a{i}" for i in range(13)]
    docs = [(1, " ".join(a)), (2, " ".join(a[:12] + ["x"])), (3, " ".join(a[:11] + ["x", "y"])), (4, " ".join(a[:12]))]
    got = {r.doc_id: r.component_id for r in nearcopies.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {d: c for d, _, c in brute_components(docs)} and got[2] == 1


def test_rounds_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "FEW", 0)
    monkeypatch.setattr(nearcopies, "BLOCK", 2000)
    monkeypatch.setattr(nearcopies, "PER_RANGE", 500)
    monkeypatch.setattr(nearcopies, "LIST", 10)
    monkeypatch.setattr(exchange, "FAN", 4)
    docs = near_copies(3, groups=3)
    rows = nearcopies.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr) == brute_components(docs)


def test_deduplicate(spark, odd):
    out = nearcopies.deduplicate(odd)
    assert out.columns == odd.columns
    ids = sorted((r.doc_id for r in out.collect()), key=str)
    assert ids == sorted([None, *range(len(ODD))], key=str)  # repeated rows become one
    assert nearcopies.deduplicate(odd.limit(0)).count() == 0


def test_deduplicate_tells_rows_of_a_key_apart(spark):
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    near = lambda w, x: " ".join([*w[:-1], x])
    rows = [(1, " ".join(a)), (5, near(a, "x")), (5, " ".join(b)), (None, near(a, "y")), (None, "no copy of anything"), (7, near(b, "z")), (8, near(b, "z"))]
    out = {tuple(r) for r in nearcopies.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {rows[0], rows[2], rows[4]}


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    up = {n: n for e in edges for n in e}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: top(n) for n in up if top(n) != n}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


ZIGZAG = [(4, 1), (4, 3), (5, 3), (5, 2)]
CROSSED = [(10 * c + i, 10 * c) for c in range(1, 5) for i in range(1, 4)] + [(13, 20), (33, 20), (43, 30)]


@pytest.mark.parametrize("edges", [[(3, 1), (3, 2)], ZIGZAG, CROSSED])
def test_components_join_stars_by_their_members(spark, edges):
    rows = [tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()]
    nodes = {n for e in edges for n in e}
    assert sorted(rows) == [(n, min(nodes)) for n in sorted(nodes) if n != min(nodes)]


def test_words_and_shingles():
    texts = ODD + ["A b c\x1cd", "end", "of text"]
    w = split(pa.array([t or "" for t in texts], pa.large_string()))
    assert np.diff(w.bounds).tolist() == [len(words(t)) for t in texts]
    names = {}
    for t, a, b in zip(texts, w.bounds[:-1], w.bounds[1:], strict=True):
        for word, h in zip(words(t), w.hashes[w.index[a:b]], strict=True):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)
    _, bounds = shingles(w)
    assert np.diff(bounds).tolist() == [len(shingle_set(t)) for t in texts]
    x = np.array([0, 3, 3, 1 << 60], np.uint64)
    assert unpack(pack(x, True), np.uint64, True).tolist() == x.tolist() and len(unpack(pack(x[:0]), np.uint64)) == 0


@pytest.mark.parametrize("fan,ranges,depth", [(256, 8, 1), (4, 11, 2), (3, 20, 3)])
def test_exchange_adds_up_at_any_depth(spark, monkeypatch, fan, ranges, depth):
    """Each unit gets the totals of its keys, in their order, and distinct marked keys are counted once."""
    monkeypatch.setattr(exchange, "FAN", fan)
    rnd = np.random.default_rng(1)
    pool = np.unique(rnd.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2))
    pool[::7] |= np.uint64(1)
    units = {u << 32 | 5: np.sort(rnd.choice(pool, int(rnd.integers(1, 200)), replace=False)) for u in range(40)}
    counts = {u: [rnd.integers(0, 3, len(k)).astype(np.uint64) for _ in range(2)] for u, k in units.items()}
    plan = exchange.plan(ranges, len(units))
    assert plan.depth == depth and plan.fan**depth >= ranges
    sent = [dict(zip(row, values, strict=True)) for u, k in units.items() for row in [exchange.rows(u, k, counts[u], plan.fan)] for values in zip(*row.values(), strict=True)]
    asked = spark.createDataFrame([tuple(int(v) if isinstance(v, np.integer) else v for v in r.values()) for r in sent], exchange.schema(2))
    got = exchange.totals(asked, plan, 2, 1).collect()
    total = [collections.Counter(), collections.Counter()]
    for u, k in units.items():
        for i in range(2):
            for key, n in zip(k.tolist(), counts[u][i].tolist(), strict=True):
                total[i][key] += n
    for u, k in units.items():
        own = sorted((r for r in got if r.unit == u), key=lambda r: r.range)
        for i in range(2):
            assert np.concatenate([unpack(r[f"t{i}"], np.uint64) for r in own]).tolist() == [total[i][x] for x in k.tolist()]
    assert sum(r.marked for r in got) == sum(1 for x, n in total[0].items() if x & 1 and n)


def test_sets_that_merely_share_sentences_make_no_pairs(spark, monkeypatch):
    """Texts drawn from a pool of sentences meet in long posting lists; those that can't link are no candidates."""
    rnd = random.Random(9)
    pool = [" ".join(f"s{i}w{j}" for j in range(15)) for i in range(40)]
    docs = [(i, " ".join(rnd.sample(pool, 20))) for i in range(150)] + [(1000 + i, " ".join(pool[:20]) + f" x{i}") for i in range(3)]
    made = []
    real = nearcopies.left_over
    monkeypatch.setattr(nearcopies, "left_over", lambda *a: made.append(real(*a)) or made[-1])
    rows = nearcopies.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr) == brute_components(docs)
    assert sum(f.count() for f in made) < 200  # of 11,000 pairs


def brute_model(rows):
    folds = [zlib.crc32(b"" if d is None else str(d).encode()) % 10 for d, _ in rows]
    toks = [[*words(t), "\n"] for _, t in rows]
    pairs = [list(zip(["\n", *t[:-1]], t, strict=True)) for t in toks]
    count = lambda xs, on: collections.Counter(x for x, f in zip(xs, folds, strict=True) if on(f) for x in x)
    c, c2, k, k2 = count(toks, lambda f: f), count(pairs, lambda f: f), count(toks, lambda f: f > 1), count(pairs, lambda f: f > 1)
    n, nk, v = sum(c.values()), sum(k.values()), len(c)
    level = lambda x: int(x).bit_length()
    weights = np.full((65, 3), 1 / 3)
    held = [p for ps, f in zip(pairs, folds, strict=True) if f == 1 for p in ps]
    for _ in range(20 if held else 0):
        e = np.zeros((65, 3))
        for a, w in held:
            share = weights[level(k[a])] * [k2[a, w] / max(k[a], 1), k[w] / max(nk, 1), 1 / (v + 1)]
            e[level(k[a])] += share / share.sum()
        whole = e.sum(axis=0) + 1e-3
        e += whole / whole.sum()
        e[0, 0] = 0
        new = e / e.sum(axis=1, keepdims=True)
        still = np.abs(new - weights).max() < 1e-3
        weights = new
        if still:
            break
    score = lambda ps: sum(math.log10(weights[level(c[a])] @ [c2[a, w] / max(c[a], 1), c[w] / n, 1 / (v + 1)]) for a, w in ps)
    return sorted(((d, f == 0, len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6), round(score(ps), 6)) for (d, _), f, t, ps in zip(rows, folds, toks, pairs, strict=True)), key=repr)


@pytest.mark.parametrize("levels", [False, True])
def test_op1_is_brute_force(spark, tables, monkeypatch, levels):
    monkeypatch.setattr(lm, "BLOCK", 3000)
    if levels:
        monkeypatch.setattr(exchange, "FAN", 3)
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["the", "cat", "sat", "on", f"x{rnd.randrange(40)}"]) for _ in range(rnd.randrange(30)))) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(1000, None), (None, "the cat")]
    got = lm.op1_deleted_interpolation(spark, tables(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got), key=repr) == brute_model(rows)


def test_op1_learns_and_degenerate_tables(spark, odd):
    rows = [(i, "a b c d e f g h " * 3) for i in range(100)]
    got = lm.score(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").collect()
    assert got and all(r.score > r.base_score / 3 for r in got)
    assert lm.score(odd).count() == odd.count()
    assert lm.score(odd.limit(0)).count() == 0
    only = [(i, "x y") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in lm.score(spark.createDataFrame(only, "doc_id bigint, text string")).collect())


def brute_counts(text):
    text = text or ""
    ws = __import__("re").findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for i in range(len(ws) - 4):
        at[tuple(ws[i : i + 5])].append(i)
    covered = {j for ps in at.values() if len(ps) > 1 for p in ps for j in range(p, p + 5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_op10(spark, odd, tables):
    where = tables(odd)
    rows = quality.op10_quality_rules(spark, where).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    out = quality.rules(odd, "q")
    assert out.columns == [*odd.columns, "q"] and quality.rules(odd.limit(0)).count() == 0
    rnd = random.Random(4)
    junk = [(i, " ".join(rnd.choice(["a", "a", "bb", "ccc", "d##", "e|"]) for _ in range(rnd.randrange(200))) + rnd.choice(["", "\nx y\nx y"]), None, None, 0) for i in range(300)]
    for r in quality.op10_quality_rules(spark, tables(junk)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(junk[r.doc_id][1])


def test_thresholds_follow_the_group(spark):
    plain = [(i, f"word{i} and some more words that stand here for document {i} in source a", "en", "a", 0) for i in range(300)]
    noisy = [(1000 + i, f"# word{i} | and # some | more # words | that # stand | here # for | document # {i}", "en", "b", 0) for i in range(300)]
    odd_one = [(5000, "# word | and # some | more # words | that # stand | here # for | document # x", "en", "a", 0)]
    df = spark.createDataFrame(plain + noisy + odd_one, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in quality.rules(df, "q").where("q.kept").collect()}
    assert kept == {r[0] for r in plain + noisy}
    whole = quality.sketches(df.select("*", quality.counts(df.text).alias("q")), "q")
    halves = [quality.sketches(df.where(f"doc_id % 2 = {k}").select("*", quality.counts(df.text).alias("q")), "q") for k in (0, 1)]
    merged = quality.merged(halves[0].union(halves[1]), "lang", "source").select(*whole.columns)
    assert merged.exceptAll(whole).isEmpty() and whole.exceptAll(merged).isEmpty()


def test_a_document_more_flips_no_group(spark):
    """Thresholds move little by little as a small group grows, and names that clash are kept."""
    rows = [(i, f"word{i} and some more words that stand here for document {i} in source a", "en", "a", 0) for i in range(300)]
    noisy = [(1000 + i, f"# word{i} | and # some | more # words | that # stand | here # for | document # {i}", "en", "b", 0) for i in range(30)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    limit = []
    for n in range(15, 30):
        df = spark.createDataFrame(rows + noisy[:n], schema)
        t = quality.thresholds(quality.sketches(df.select("*", quality.counts(df.text).alias("q")), "q")).where("source = 'b'").first()
        limit.append(t.symbols)
    assert all(0 < b - a < 0.03 for a, b in zip(limit, limit[1:]))
    odd = spark.createDataFrame([(1, rows[0][1], "en", "a", 5, 6, 7, 8, 9, 10)], "doc_id bigint, text string, lang string, source string, row int, c int, limits int, t_lang int, __lang int, quality int")
    out = quality.rules(odd)
    assert out.columns == odd.columns and out.first().quality.kept and tuple(out.first())[4:9] == (5, 6, 7, 8, 9)


def test_limits_come_from_the_sketches_alone(spark):
    """One event in a group without any is chance, many are not; a long text is held nearer to its group's threshold than a short one."""
    line = lambda i, n: " ".join(f"w{i:04}x{j % 200:03}y{j // 200:02}" for j in range(n))
    rows = [(i, line(i, 200), "en", "a", 0) for i in range(400)]
    rows += [(1000, line(1000, 200) + " #", "en", "a", 0), (1001, line(1001, 200) + " #" * 12, "en", "a", 0), (1002, line(1002, 4000) + " #" * 12, "en", "a", 0)]
    copies = f"{line(2000, 200)}\n" + "\n".join(line(2000 + k, 12) for k in range(9))
    rows += [(1003, copies + "\n" + line(2001, 12), "en", "a", 0), (1004, line(3000, 1300) + " " + " ".join([line(3001, 60)] * 4), "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.q for r in quality.rules(df, "q").collect()}
    assert got[0].limits.symbols == got[0].limits.repeats == 0
    assert {i for i, q in got.items() if not q.kept} == {1001, 1002, 1004} and not got[1004].base_failed
    assert {r.doc_id for r in quality.rules(df, "q", z=10.0).where("not q.kept").collect()} == set()


def test_op10_sql(spark):
    expect(quality.op10_quality_rules(spark, DATA), quality.SQL["op10_quality_rules"])


def test_pipeline(spark, tables):
    base = "this document has quite a few words of its own that nobody else would ever use here today number"
    rows = [(i, f"{base} {i} " + " ".join(f"u{i}x{j}" for j in range(30)), "en", "s", 0) for i in range(20)]
    rows += [(100 + i, rows[i][1], "en", "s", 0) for i in range(5)]  # copies
    rows += [(200, "too short", "en", "s", 0), (201, None, "en", "s", 0), (202, "same same " * 50, "en", "s", 0)]
    rows += [(300, f"{base} with password=hunter22hunter and {' '.join(f'z{j}' for j in range(40))}", "en", "s", 0)]
    where = tables(rows)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = set(range(20)) | {300}
    states = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        states.append({r.doc_id: r.text for r in docs.collect()})
    assert set(states[0]) == kept | set(range(100, 105)) and set(states[1]) == kept and set(states[2]) == kept
    assert "[SECRET:assign]" in states[2][300] and "hunter22" not in states[2][300]
    pieces = corpus_pipeline.run(spark, where).collect()
    assert {r.doc_id for r in pieces} == kept
    expected = {r.doc_id: r.doc_tokens for r in packing.pack(secrets.redact(spark.createDataFrame([(i, dict((a, b) for a, b, *_ in rows)[i]) for i in kept], "doc_id bigint, text string"))).collect()}
    total = collections.Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    assert dict(total) == expected
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "secrets", "packing"]


def test_pipeline_of_odd_rows(spark, odd, tables):
    """Nulls in any column, repeated rows, extra columns with clashing names."""
    words_ = " ".join(f"w{i}" for i in range(40))
    more = [(50, f"{words_} token=abcdef123", None, None, None, "x", None, None), (50, f"{words_} token=abcdef123", None, None, None, "x", None, None), (50, f"other {words_[:80]}", None, "s", 3, None, 1.0, [1]), (None, f"{words_} zz", "en", None, 1, "", 0.0, [])]
    where = tables(odd.union(spark.createDataFrame(more, odd.schema)))
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where)
        assert docs.columns == odd.columns
        docs = spark.createDataFrame(docs.collect(), odd.schema)
    assert sorted((r.doc_id, "token" in r.text, "[SECRET:assign]" in r.text) for r in docs.collect() if r.doc_id == 50) == [(50, False, False), (50, False, True)]
    assert not [r for r in docs.collect() if r.doc_id is None]  # a near copy of document 50
    total = collections.Counter()
    for r in corpus_pipeline.run(spark, where).collect():
        total[r.doc_id] += r.length
    assert total.keys() == {r.doc_id for r in docs.collect()}


def test_pipeline_of_nothing(spark, tables):
    assert corpus_pipeline.run(spark, tables([])).count() == 0
