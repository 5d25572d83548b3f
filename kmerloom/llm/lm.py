r"""Bigram language model by deleted interpolation, learned from the documents and scoring them.

p(w|v) = L2(b) c(v,w)/c(v) + L1(b) c(w)/N + L0(b)/(V+1), where b is the bucket of the context's frequency (its number of binary digits).
A document's tokens are its words and an end, which is also the first word's context. Training documents are those whose fold, crc32(key as text)
mod 10, is not 0. The weights of each bucket are learned by expectation-maximisation on the counts of fold HELD, which are deleted from the maximum-likelihood
estimates meanwhile; the estimates used for scores are of all training documents.

Counts are gathered without moving text: documents are cut into blocks, written once. Each block sends its distinct words and pairs (hashes, sorted, packed) with
their counts to key ranges, in levels as the module `exchange` says, so a pair as common as a third of all is one key for each block, and then for each group of blocks. Each range
adds up its keys and answers with the totals of the keys that it was sent, and no others. Blocks then keep the counts that their tokens need: one
pass a round of EM over the held-out tokens' counts, and one to score. What the driver sees are the buckets' weights and totals.

Words are told apart by 64-bit hashes in a block, and words and pairs by keys over all: those have SPARE bits more than number the corpus' tokens, up to 63, so
at any size at most about one key in 2^24 shares its count with another (in 10^8 tokens, with a million words, the chance that any two words do is one in 4,000). A context that was
never seen (level 0) has no weight on its pairs, so all three estimates there are probabilities.

Edge cases: null and empty texts are one end token. Texts of any length are scored whole, a very long one as a block of its own. A null key counts as the empty text, whose crc32 is 0: held out. Repeated rows count each time they occur. With no training documents all is
scored by L0 = 1 and V = 0. An empty table gives none. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from .coding import pack, unpack
from .store import arrow, block_ids, column, discard, saved, slices, table, texts, tidy
from .words import _ODD, mixed, split

FOLDS, HELD, BLOCK, PER_RANGE = 10, 1, 12 << 20, 2_000_000
#: EM ends after ROUNDS or when no weight moves by more than STILL.
ROUNDS, STILL, LEVELS = 20, 1e-3, 65
_END = np.uint64(0x0123456789ABCDEF)
#: Bits of a key beyond those that number the corpus' tokens: the share of keys that clash with another is at most one in 2**SPARE at any size.
SPARE = 24


def fold(key: object) -> int:
    return zlib.crc32(b"" if key is None else str(key).encode()) % FOLDS


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each block: keys, folds, tokens as places in its distinct words, those words' hashes (the end has one too)."""
    schema = f"block bigint, docs array<{dict(docs.dtypes)[key]}>, folds binary, tokens binary, bounds binary, words binary, n bigint, n_train bigint, n_held bigint"
    out = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in zip(block_ids(), slices(batches, BLOCK, text)):
            w, ids = split(texts(batch, text)), column(batch, key)
            folds = np.array([fold(i) for i in ids.to_pylist()], np.uint8)
            n = np.diff(w.bounds)
            tokens = np.full(len(w.index) + len(n), len(w.hashes), np.uint32)
            tokens[np.arange(len(w.index)) + np.repeat(np.arange(len(n)), n)] = w.index
            common = np.argsort(-np.bincount(tokens, minlength=len(w.hashes) + 1), kind="stable")  # small numbers for common words pack better
            rank = np.empty(len(common), np.uint32)
            rank[common] = np.arange(len(common))
            tokens, words, size = rank[tokens], np.append(w.hashes, _END)[common], n + 1
            row = [block, None, folds.tobytes(), pack(tokens), pack(np.concatenate([[0], np.cumsum(size)]).astype(np.int64), True), words.tobytes(), int(size.sum()), int(size[folds > 0].sum()), int(size[folds == HELD].sum())]
            cols = [pa.array([v], t.type) if v is not None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids) for v, t in zip(row, out, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return docs.select(key, text).mapInArrow(run, schema)


class Keys:
    """A block's distinct words and pairs as sorted keys, and the place of each token's among them.

    A key is the upper bits of a hash, down to bit `shift`, which is 0 for pairs and 1 for words.
    """

    def __init__(self, row: dict, shift: int):
        self.tokens, self.bounds = unpack(row["tokens"], np.uint32), unpack(row["bounds"], np.int64, True)
        self.folds = np.frombuffer(row["folds"], np.uint8)
        words = mixed(np.frombuffer(row["words"], np.uint64))
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[self.bounds[:-1]] = np.flatnonzero(words == mixed(np.array([_END]))[0])[0]
        low = np.uint64(shift + 1)
        coded = pa.array(mixed(words[context] * _ODD[0] + words[self.tokens] * _ODD[1]) >> low << low).dictionary_encode()
        both = np.concatenate([words >> low << low | np.uint64(1 << shift), coded.dictionary.to_numpy()])
        self.keys, place = np.unique(both, return_inverse=True)
        self.word, self.word_context = place[self.tokens], place[context]
        self.pair = place[len(words) + coded.indices.to_numpy()]

    def counts(self, folds: np.ndarray) -> np.ndarray:
        """How often each key occurs in documents of these folds."""
        on = np.repeat(folds, np.diff(self.bounds))
        return (np.bincount(self.word[on], minlength=len(self.keys)) + np.bincount(self.pair[on], minlength=len(self.keys))).astype(np.uint64)


def _ask(fan: int, shift: int):
    out = arrow(exchange.schema(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                k = Keys(row, shift)
                sent = exchange.rows(row["block"], k.keys, [k.counts(k.folds > 0), k.counts(k.folds == HELD)], fan)
                yield pa.RecordBatch.from_arrays([pa.array(sent[f.name], f.type) for f in out], names=out.names)
        tidy()

    return run


def _keep(key_kind: str, shift: int):
    schema = f"docs array<{key_kind}>, folds binary, bounds binary, word binary, pair binary, context_held binary, word_held binary, pair_held binary, vocabulary bigint"
    out = arrow(schema)

    def fn(own: pa.Table, answers: pa.Table) -> pa.Table:
        rows = own.to_pylist()
        if not rows:
            return out.empty_table()
        k, a = Keys(rows[0], shift), answers.sort_by("range").to_pydict()
        total, held = (np.concatenate([unpack(x, np.uint64) for x in a[c]]) for c in ("t0", "t1"))
        on, kept = np.repeat(k.folds == HELD, np.diff(k.bounds)), total - held
        row = [rows[0]["docs"], rows[0]["folds"], rows[0]["bounds"], pack(total[k.word]), pack(total[k.pair]), pack(kept[k.word_context[on]]), pack(kept[k.word[on]]), pack(kept[k.pair[on]]), sum(a["marked"])]
        return pa.table([pa.array([v], t.type) for v, t in zip(row, out, strict=True)], schema=out)

    return fn, schema


def level(c: np.ndarray) -> np.ndarray:
    """The bucket of a context frequency: its number of binary digits."""
    return np.frexp(c.astype(np.float64))[1]


def _parts(context: np.ndarray, word: np.ndarray, pair: np.ndarray, n: int, v: int) -> np.ndarray:
    """The three estimates of each token."""
    return np.stack([pair / np.maximum(context, 1), word / max(n, 1), np.full(len(word), 1.0 / (v + 1))])


def learned(kept: DataFrame, n: int, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (LEVELS x 3) by EM over the held-out tokens. n: kept training tokens."""
    weights = np.full((LEVELS, 3), 1 / 3)
    held = kept.select("context_held", "word_held", "pair_held")
    for _ in range(rounds):
        now = weights

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((LEVELS, 3))
            for batch in batches:
                for row in batch.to_pylist():
                    context, word, pair = (unpack(row[c], np.uint64) for c in ("context_held", "word_held", "pair_held"))
                    at = level(context)
                    share = now[at].T * _parts(context, word, pair, n, v)
                    share /= np.maximum(share.sum(axis=0), 1e-300)
                    for j in range(3):
                        total[:, j] += np.bincount(at, share[j], LEVELS)
            yield pa.RecordBatch.from_pydict({"level": np.arange(LEVELS), **{f"e{j}": total[:, j] for j in range(3)}})

        sums = held.mapInArrow(expect, "level bigint, e0 double, e1 double, e2 double").groupBy("level").agg(*(F.sum(f"e{j}").alias(f"e{j}") for j in range(3))).collect()
        e = np.zeros((LEVELS, 3))
        for r in sums:  # LEVELS rows
            e[r.level] = [r.e0, r.e1, r.e2]
        whole = e.sum(axis=0) + 1e-3
        e += whole / whole.sum()  # a level without held-out tokens takes the weights of all
        e[0, 0] = 0  # nothing follows a context that was never seen
        weights = e / e.sum(axis=1, keepdims=True)
        if np.abs(weights - now).max() < STILL:
            break
    return weights


def _fixed(n: int) -> np.ndarray:
    """Weights where no held-out token can teach them. n: training tokens."""
    weights = np.tile([0.6, 0.3, 0.1] if n else [0.0, 0.0, 1.0], (LEVELS, 1))
    if n:
        weights[0] = [0.0, 0.75, 0.25]
    return weights


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigram), score: log10 probabilities."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    made = saved(blocks(docs, key, text), "lm-blocks")
    size = made.agg(F.sum("n").alias("n"), F.sum("n_train").alias("train"), F.sum("n_held").alias("held"), F.count("*").alias("blocks")).first()
    n, held = size.train or 0, size.held or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * (size.n or 0) // PER_RANGE))
    plan, shift = exchange.plan(ranges, size.blocks), max(0, 63 - SPARE - (size.n or 0).bit_length())
    answers = exchange.totals(made.mapInArrow(_ask(plan.fan, shift), exchange.schema(2)), plan, 2, 1 << shift)
    fn, schema = _keep(kind, shift)
    kept = saved(made.groupBy("block").cogroup(answers.groupBy("unit")).applyInArrow(fn, schema), "lm-counts")
    discard(made)
    v = kept.agg(F.sum("vocabulary").alias("v")).first().v or 0
    weights = learned(kept, n - held, v, rounds) if held else _fixed(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["folds", "bounds", "word", "pair"]).to_pylist()):
                bounds, word, pair = unpack(row["bounds"], np.int64, True), unpack(row["word"], np.uint64), unpack(row["pair"], np.uint64)
                first = bounds[:-1]
                context = np.empty_like(word)
                context[1:] = word[:-1]
                context[first] = word[bounds[1:] - 1]  # the end's count
                p = (weights[level(context)].T * _parts(context, word, pair, n, v)).sum(axis=0)
                base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))
                cols = [column(batch, "docs")[i].values, np.frombuffer(row["folds"], np.uint8) == 0, np.diff(bounds), np.add.reduceat((word > 0).astype(np.int64), first), np.full(len(first), n), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return kept.select("docs", "folds", "bounds", "word", "pair").mapInArrow(run, f"{key} {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
