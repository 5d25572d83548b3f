import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kmerloom.llm import bpe, packing, tokenfiles, tokens

from .conftest import ODD

BYTE, WORDS = tokens.default_path("byte_bpe_50k.json"), tokens.default_path("word_bpe_49k.json")
BITS = ["'", "'s", "'ll", "'re", " ", "  ", "\n", "\t", "a", "re", "don't", "1", "23", "²", "!", "?!", "é", "É", "ß", "İ", "ſ", "Σ", "\xa0", "\x1c", "\x85", "日本", "<|endoftext|>", "S", "\r\n", "''s", "l", "̀", "aaa", "----"]


def fuzz(n):
    rnd = random.Random(n)
    easy = [b for b in BITS if all(ord(c) < 0x240 for c in b) and "<" not in b]
    return [t or "" for t in ODD] + ["".join(rnd.choice(x) for _ in range(rnd.randrange(14))) for x in (BITS, easy) for _ in range(n)]


@pytest.mark.parametrize("path,kind", [(BYTE, "byte"), (WORDS, "word")])
def test_encoder_is_the_library(path, kind):
    texts = fuzz(3000)
    enc = tokens.Encoder(path, kind)
    for part in (texts, texts[:7], texts[5:6], []):
        ids, bounds = enc.ids(pa.array(part, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [e.ids for e in enc.tokenizer.encode_batch(part, add_special_tokens=False)]


def test_words_in_one_string_are_told_apart():
    """Every character below the cut as a word and at a word's end; white space has no ids."""
    enc = tokens.Encoder(WORDS, "word")
    words = [w for c in map(chr, range(tokens.EASY)) if not c.isspace() and c.lower() == c for w in (c, c * 3)] + ["'s", "a" * 5000, "word"]
    words = [w for w in words if len(enc.tokenizer.pre_tokenizer.pre_tokenize_str(w)) == 1]
    assert len(words) > 400
    flat, sizes = enc._coded(words)
    lists = [e.ids for e in enc.tokenizer.encode_batch(words, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in lists] and flat.tolist() == [i for x in lists for i in x]
    enc.ends[lists[-1][-1]] = False  # a word without an end: its string is encoded word by word
    again = enc._coded(words)
    assert again[0].tolist() == flat.tolist() and again[1].tolist() == sizes.tolist()
    ids, bounds = enc.ids(pa.array(["", " \n ", "a b", "", "'s it's  x\t"], pa.large_string()))
    assert bounds.tolist()[:3] == [0, 0, 0] and bounds[3] == bounds[4] == 2
    assert ids.tolist() == enc.tokenizer.encode("a b", add_special_tokens=False).ids + enc.tokenizer.encode("'s it's  x\t", add_special_tokens=False).ids


def test_trie_is_the_library_and_decodes():
    texts, c = fuzz(3001), bpe.Coder(BYTE)
    ids, bounds = c.encode(pa.array(texts, pa.large_string()))
    ref = c.encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [e.ids for e in ref]
    assert c.decode(ids, bounds) == texts == [c.encoder.tokenizer.decode(e.ids, skip_special_tokens=False) for e in ref]
    cut = np.array([ids[bounds[5]]], np.uint32)  # a part of a character
    assert c.decode(cut, np.array([0, 1])) == [c.encoder.tokenizer.decode(cut.tolist(), skip_special_tokens=False)]
    word = "ab" * 3000
    assert c.model.words([word, word[:-1], ""]) == [e.ids for e in c.encoder.tokenizer.encode_batch([word, word[:-1], ""], add_special_tokens=False)]


def test_op4(spark, odd, tables):
    tok = tokens.load(BYTE)
    rows = bpe.op4_bpe_trie(spark, tables(odd)).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in rows:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert {(r.doc_id, r.decoded) for r in bpe.encode(odd).collect()} == set(texts.items())
    assert bpe.digests(odd.limit(0)).count() == 0


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    enc = tokens.Encoder(BYTE, "byte")
    for text in ("one two three four", "five six seven", "one six eight nine ten"):
        assert enc.ids(pa.array([text], pa.large_string()))[0].tolist() == enc.tokenizer.encode(text).ids


def reference_level(counts, size, length):
    def cost(h):
        n = counts.copy()
        if h:
            n[h] -= 1
        if h + length < size:
            n[h + length] += 1
        return int((n[1:size] ** 2).sum())

    levels = [h for h in range(size - length + 1) if h == 0 or counts[h] > 0]
    return min(levels, key=lambda h: (cost(h), -h))


def test_level_minimises_the_sum_of_squares():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        p = packing.Packer(16)
        p.count[1:16] = rnd.integers(0, 4, 15)
        for length in range(1, 16):
            assert p.level(length) == reference_level(p.count, 16, length)


def test_packer_keeps_every_id():
    rnd = np.random.default_rng(4)
    p, docs, done = packing.Packer(64, most=600), {}, []
    for i in range(400):
        docs[i] = rnd.integers(0, 1 << 30, int(rnd.integers(1, 200))).astype(np.uint32)
        done += p.add(i, docs[i])
    done += p.flush()
    assert not p.flush() and len({w.number for w in done}) == len(done)
    fills = [w.fill for w in done]
    assert all(f == sum(len(x.ids) for x in w.pieces) and f & f - 1 == 0 for f, w in zip(fills, done, strict=True))
    back = {i: np.zeros(len(d), np.uint32) for i, d in docs.items()}
    seen = {i: 0 for i in docs}
    for w in done:
        for x in w.pieces:
            back[x.doc][x.start : x.start + len(x.ids)] = x.ids
            seen[x.doc] += len(x.ids)
    assert all((back[i] == docs[i]).all() and seen[i] == len(docs[i]) for i in docs)


@pytest.mark.parametrize("parts", [1, 8, 211])
def test_placement_decides(parts):
    """Over nine tenths of the ids of sf0.1 lie in the window where the rule put them, however the table is cut, and no window needs padding."""
    enc, sizes = tokens.encoder(WORDS, "word"), []
    for batch in pq.ParquetFile("/root/testdata/sf0.1/documents.parquet").iter_batches(1000, columns=["text"]):
        _, bounds = enc.ids(batch.column(0).cast(pa.large_string()).fill_null(""))
        sizes += (np.diff(bounds) + 1).tolist()
    moved, total = 0, sum(sizes)
    for part in np.array_split(np.array(sizes), parts):
        p = packing.Packer()
        done = [w for i, n in enumerate(part) for w in p.add(i, np.zeros(n, np.uint32))] + p.flush()
        moved += p.moved
        assert all(w.fill == sum(len(x.ids) for x in w.pieces) for w in done) and sum(w.fill for w in done) == part.sum()
        assert all(w.fill == p.size or w.fill & w.fill - 1 == 0 for w in done) and sum(w.fill < p.size for w in done) <= 12
    assert moved < 0.1 * total


def test_op3(spark, odd, tables):
    tok = tokens.load(WORDS)
    df = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r.doc_id: np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], np.uint32) for r in df.collect()}
    rows = packing.op3_packing(spark, tables(df)).collect()
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for seq in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & at - 1 == 0
    assert packing.pack(odd).count() and packing.pack(odd.limit(0)).count() == 0
    assert {len(r.ids) for r in packing.pack(df, with_ids=True).collect()} == {4 * r.length for r in rows}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 50, 5000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    x = tokenfiles.Index.build(2, keys, np.zeros(n, bool), np.arange(1, n + 1))
    x = tokenfiles.Index.load(x.dump())
    at, count = x.find(keys)
    assert (at == np.arange(n)).all() and (count == 1).all() and len(x.first) == n
    other = np.setdiff1d(np.arange(2000), keys)
    assert (x.find(other)[0] >= 0).sum() == 0


def test_op6(spark, odd, tables, tmp_path):
    tok = tokens.load(BYTE)
    where = tables(odd.repartition(3))
    rows = tokenfiles.op6_token_files(spark, where).collect()
    assert len(rows) == odd.count()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    keys = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    ids = {r.doc_id: np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], np.uint32) for r in odd.collect()}
    assert all((r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes())) for r in rows)
    out = tokenfiles.write(odd, f"file://{tmp_path}/out")
    for k, wanted in ids.items():
        got = tokenfiles.get(out, k)
        assert len(got) == sum(1 for r in rows if r.doc_id == k) and all((g == wanted).all() for g in got)
    assert tokenfiles.get(out, 10**9) == []
    with pytest.raises(TypeError):
        tokenfiles.write(odd, key="text")
    assert tokenfiles.read(spark, out, with_ids=True).count() == len(rows)
    assert tokenfiles.read(spark, tokenfiles.write(odd.limit(0))).count() == 0


def test_op6_hot_key_over_shards(spark, tmp_path, monkeypatch):
    """A key of a third of all rows is dealt over several shards, and its documents are found in all of them."""
    monkeypatch.setattr(tokenfiles, "SHARD", 2000)
    tok = tokens.load(BYTE)
    rows = [(7 if i % 3 == 0 else i, f"document number {i} " + "x " * (i % 50)) for i in range(300)]
    out = tokenfiles.write(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), f"file://{tmp_path}/out")
    at = [s for s in tokenfiles.manifest(out) if s["first_key"] <= 7 <= s["last_key"]]
    assert len(at) > 2
    of = lambda k: sorted(tok.encode(t, add_special_tokens=False).ids + [2] for i, t in rows if i == k)
    for k in (7, 8, 299, 4, 3):
        assert sorted(x.tolist() for x in tokenfiles.get(out, k)) == of(k)
    found = sorted((r.doc_id, r.start, r.n_tokens) for r in tokenfiles.read(spark, out).collect())
    assert len(found) == 300 and sum(x[2] for x in found) == sum(s["tokens"] for s in tokenfiles.manifest(out))
