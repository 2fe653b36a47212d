import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tonewright.llm import piece_codec as pc
from tonewright.llm.common import documents, tokenizer_path

from . import fixtures as fx

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return pc.PieceCodec(PATH)


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_whole_operator(spark, lib):
    rows = fx.awkward()
    wanted = []
    for d, t in rows:
        ids = lib.encode(t or "")
        wanted.append((sha(lib.decode(ids)), d, sha(",".join(map(str, ids))), len(ids)))
    got = pc.round_trip(documents(fx.table(spark, rows)))
    assert fx.found(got, "decoded_sha256", "doc_id", "ids_sha256", "n_tokens") == fx.by_row(wanted)


def test_agenda_needs_no_library(own, lib):
    """The agenda alone gives the library's ids, and its decoder the library's texts."""
    for _, t in fx.awkward():
        if t and "\0" not in t:
            assert own.encode(t) == lib.encode(t)
            assert own.decode(own.encode(t)) == lib.decode(lib.encode(t))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t▁aeinrst.,中😀\xa0é", max_size=50)))
def test_any_text(own, lib, text):
    ids = lib.encode(text)
    n, ids_sha, text_sha, _ = own.digest([text.encode()])[0]
    assert (n, ids_sha, text_sha) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))


def test_memory_turns_over(lib):
    own = pc.PieceCodec(PATH, cache_runs=40)
    rng = random.Random(1)
    for _ in range(30):
        t = " ".join(fx.words(rng, 25, 400))
        assert own.digest([t.encode()])[0][1] == sha(",".join(map(str, lib.encode(t))))


def test_disagreement_goes_to_the_library(lib):
    own = pc.PieceCodec(PATH)
    own.agendas = lambda runs: [[5] for _ in runs]  # a codec that is wrong about everything
    got = own.digest([b"some words here", b""])
    assert got[0][0] == len(lib.encode("some words here")) and got[0][3] is True
    assert got[1] == (0, sha(""), sha(""), False)


def test_round_trip_of_documents(spark, lib):
    rows = [r for r in fx.awkward() if r[1] and "\0" not in r[1]]
    encoded = pc.encode_documents(documents(fx.table(spark, rows)))
    back = pc.decode_documents(encoded)
    assert fx.found(back) == fx.by_row((d, lib.decode(lib.encode(t))) for d, t in rows)


def test_empty_table(spark):
    assert pc.round_trip(documents(fx.table(spark, []))).collect() == []
