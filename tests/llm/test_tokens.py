"""Token counts, packing and wavelet shards: all on ids that must equal the library's."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tonewright.llm import packing, token_counts, wavelet
from tonewright.llm.common import documents
from tonewright.llm.tokens import BYTE_BPE, WORD_BPE, ChunkEncoder, vocabulary

from . import fixtures as fx


def library(name):
    t = Tokenizer.from_file(vocabulary(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module", params=[BYTE_BPE, WORD_BPE])
def pair(request):
    return ChunkEncoder(vocabulary(request.param)), library(request.param)


def test_encoder_on_awkward_texts(pair):
    own, lib = pair
    for _, t in fx.awkward():
        assert own.encode((t or "").encode()) == packed(lib(t))


def test_special_strings(pair):
    """An untouched library takes them as its added tokens, wherever they stand."""
    own, lib = pair
    for t in ("a <|endoftext|> b", "x<|startoftext|>y", "<|endoftext|>", "a  <|endoftext|>  b\n", "<|ENDOFTEXT|> <|endoftext"):
        assert own.encode(t.encode()) == packed(lib(t))
    assert own.encode_all([b"a b", b"c <|endoftext|> d", b""]) == [packed(lib(t)) for t in ("a b", "c <|endoftext|> d", "")]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_special_strings_as_text(name):
    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    own = ChunkEncoder(vocabulary(name), special_as_text=True)
    for text in ("a <|endoftext|> b", "x<|startoftext|>y"):
        assert own.encode(text.encode()) == packed(t.encode(text, add_special_tokens=False).ids)


def test_a_lost_mark_changes_nothing(pair):
    """Chunks whose joined ids don't give every mark back go to the library one by one."""
    own, lib = pair
    texts = [b"some words", "e\u0301 \x01 n\x01o".encode(), b"\x01", "\u0301x".encode(), b"\n \n"]
    assert own.encode_all(texts) == [packed(lib(t.decode())) for t in texts]
    broken = ChunkEncoder.__new__(ChunkEncoder)
    broken.__dict__.update(own.__dict__ | {"mark_id": -1, "fresh": {}, "older": {}})
    assert broken.encode_all(texts) == [packed(lib(t.decode())) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t\r\x0b\x0c\x85\xa0 　ab1'sTé<|>.中̈İß", max_size=40)))
def test_encoder_on_any_text(pair, text):
    own, lib = pair
    assert own.encode(text.encode()) == packed(lib(text))


def test_memory_turns_over(monkeypatch):
    monkeypatch.setattr("tonewright.llm.tokens.CACHE_CHUNKS", 50)
    own, lib = ChunkEncoder(vocabulary(BYTE_BPE)), library(BYTE_BPE)
    rng = random.Random(1)
    for _ in range(40):
        t = " ".join(fx.words(rng, 30, 300))
        assert own.encode(t.encode()) == packed(lib(t))
        assert len(own.fresh) <= 50 + 30


def test_histogram_and_sums(spark):
    rows = fx.awkward()
    lib = library(BYTE_BPE)
    n = [len(lib(t)) + 1 for _, t in rows]
    h = token_counts.length_histogram(documents(fx.table(spark, rows)))
    assert {r.n_tokens: r.documents for r in h.collect()} == Counter(n)
    h = h.cache()
    for r in token_counts.context_table(h).collect():
        limit = r.n_tokens
        assert r.documents == n.count(limit)
        assert (r.docs_upto, r.tokens_upto) == (sum(x <= limit for x in n), sum(x for x in n if x <= limit))
        assert (r.docs_longer, r.tokens_longer) == (sum(x > limit for x in n), sum(x for x in n if x > limit))
        assert r.truncated_tokens == sum(min(x, limit) for x in n)
        assert r.lost_tokens == sum(max(0, x - limit) for x in n)
        assert r.quantile == pytest.approx(sum(x <= limit for x in n) / len(n))
    got = {r.context_limit: (r.documents_cut, r.tokens) for r in token_counts.at_limits(h, [1, 100, 10**6]).collect()}
    assert got == {k: (sum(x > k for x in n), sum(min(x, k) for x in n)) for k in (1, 100, 10**6)}
    for r in token_counts.quantiles(token_counts.context_table(h), [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == min(x for x in n if sum(y <= x for y in n) >= r.share * len(n))


def test_sums_over_many_blocks(spark):
    rng = random.Random(3)
    n = [rng.choice([1, 5, 4095, 4096, 4097, 8192, 100_000, rng.randrange(1, 60_000)]) for _ in range(300)]
    h = spark.createDataFrame(list(Counter(n).items()), "n_tokens long, documents long")
    for r in token_counts.context_table(h).collect():
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)


def test_empty_tables(spark):
    docs = documents(fx.table(spark, []))
    h = token_counts.length_histogram(docs)
    assert token_counts.context_table(h).collect() == []
    assert [tuple(r) for r in token_counts.at_limits(h, [5]).collect()] == [(5, 0, 0)]
    assert packing.pack_documents(docs).collect() == []
    assert wavelet.digest_shards(spark, wavelet.write_shards(docs)).collect() == []


def test_packing(spark):
    rows = fx.awkward() + [(900 + k, " ".join(fx.words(random.Random(k), 700, 9000))) for k in range(20)]
    lib = library(BYTE_BPE)
    wanted = defaultdict(list)
    for d, t in rows:
        wanted[d].append([*lib(t), 0])
    got = packing.pack_documents(documents(fx.table(spark, rows)), with_ids=True).collect()
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        assert 1 <= r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(packed(r.ids))
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:k]) for k in range(len(rs))]
        assert sum(r.length for r in rs) <= 1024
    # every id of every row lies in exactly one piece
    total = sum(len(ids) for v in wanted.values() for ids in v)
    assert sum(r.length for r in got) == total
    for d, texts in wanted.items():
        if len(texts) > 1:
            continue
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(texts[0]) and list(r.ids) == texts[0][at : at + r.length]
            at += r.length
        assert at == len(texts[0])
    # at most one sequence of padding for each task
    assert len(sequences) * 1024 - total <= 4 * 1024


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_balance(lengths):
    parts = packing.balance(lengths, 64, 10)
    assert [sum(p[2] for p in ps) for ps in parts] == lengths
    by = defaultdict(list)
    for ps in parts:
        for s, offset, length in ps:
            by[s].append((offset, length))
    assert len(by) == -(-sum(lengths) // 64)
    for ps in by.values():
        at = 0
        for offset, length in sorted(ps):
            assert offset == at
            at += length
        assert at <= 64


def test_balance_evens_costs():
    """Descending pieces go to the cheapest sequence with room."""
    assert packing.balance([6, 5, 4, 3, 1, 1], 10, 1) == [[(0, 0, 6)], [(1, 0, 5)], [(1, 5, 4)], [(0, 6, 3)], [(1, 9, 1)], [(0, 9, 1)]]


def test_wavelet_file():
    rng = random.Random(2)
    for size, top in ((0, 1), (1, 1), (700, 2), (5000, 300), (3000, 49_408), (2000, 90_000)):
        ids = [rng.randrange(top) for _ in range(size)]
        s = wavelet.Shard(wavelet.build(np.array(ids, np.uint32), [5, None], [size, 0]))
        assert s.ids().tolist() == ids and s.doc_ids == [5, None] and s.lengths.tolist() == [size, 0]
        for i in rng.sample(range(size), min(size, 40)):
            assert s.access(i) == ids[i]
            assert s.rank(ids[i], i) == ids[:i].count(ids[i])
            assert s.select(ids[i], ids[:i].count(ids[i])) == i
            assert s.count(ids[i], size // 3) == ids[size // 3 :].count(ids[i])
        if size:
            assert s.occurrences(ids[0]) == [i for i, x in enumerate(ids) if x == ids[0]]
        assert s.rank(10**7, size) == 0 and s.rank(-1, size) == 0
        with pytest.raises(IndexError):
            s.access(size)
        with pytest.raises(IndexError):
            s.select(0, size + 1)


def test_wavelet_needs_its_own_files():
    with pytest.raises(ValueError):
        wavelet.Shard(b"PAR1 something else")


@pytest.mark.parametrize("shard_tokens", [50, 2_000_000])
def test_shards(spark, shard_tokens):
    rows = [r for r in fx.awkward() if r[0] is not None]
    rows = [r for k, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:k]}]
    lib = library(WORD_BPE)
    at, wanted = 0, []
    for d, t in sorted(rows):
        ids = [*lib(t), 2]
        wanted.append((d, zlib.crc32(packed(ids)), len(ids), at))
        at += len(ids)
    path = wavelet.write_shards(documents(fx.table(spark, rows)), shard_tokens=shard_tokens)
    assert fx.found(wavelet.digest_shards(spark, path)) == fx.by_row(wanted)
    shards = spark.read.parquet(path).orderBy("range", "part").collect()
    held = [d for r in shards for d in wavelet.Shard(bytes(r.shard)).doc_ids]
    assert held == [d for d, _ in sorted(rows)]
    assert sum(r.tokens for r in shards) == at


def test_shards_take_null_and_repeated_ids(spark):
    rows = fx.awkward()
    lib = library(WORD_BPE)
    path = wavelet.write_shards(documents(fx.table(spark, rows)))
    got = wavelet.digest_shards(spark, path)
    assert Counter((r.doc_id, r.ids_crc32) for r in got.collect()) == Counter((d, zlib.crc32(packed([*lib(t), 2]))) for d, t in rows)
    last = got.orderBy(F.desc("start")).first()
    assert last.start + last.n_tokens == sum(len(lib(t)) + 1 for _, t in rows)


def test_lost_ends_change_nothing(pair):
    """Parts whose ids don't end with their chunks are joined with marks instead."""
    own, lib = pair
    texts = ["some words, Words 12 it's", "é É H̱ n\x01o  x y", " “quoted”  \x1c \x85a", "a" * 3000 + " b\n\nc"]
    want = [packed(lib(t)) for t in texts]
    assert own.encode_all([t.encode() for t in texts]) == want
    broken = ChunkEncoder.__new__(ChunkEncoder)
    broken.__dict__.update(own.__dict__ | {"sizes": own.sizes * 0, "fresh": {}, "older": {}})
    assert broken.encode_all([t.encode() for t in texts]) == want


def test_texts_lie_apart(pair):
    own, lib = pair
    texts = ["", "ab", "", "cd ", " ef", "\n", "gh\n", "", "ij", ""]
    assert own.encode_all([t.encode() for t in texts]) == [packed(lib(t)) for t in texts]
    assert own.encode_all([]) == []
    assert own.encode_all([b"", b""]) == [b"", b""]
