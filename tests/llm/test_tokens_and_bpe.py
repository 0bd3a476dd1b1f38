from __future__ import annotations

import hashlib
import random

import pytest
from public_tokenizers import path

from patternmill.llm import bpe, tokens
from patternmill.llm.tokens import SplicedEncoder

PIECES = ["a", "b", " ", "  ", "\n", "é", "the ", "ing", "日本", "😀", "▁", "\x00", "0", "12", "   ", "<s>", "<|endoftext|>", "'s", "\x85", "　", "ß", "aaaa"]


def texts(n, longest, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("chunk, overlap", [(64, 8), (40, 39), (200, 1)])
def test_spliced_ids_equal_the_librarys(chunk, overlap):
    own = SplicedEncoder(path("piece_bpe_32k.model"), chunk, overlap)
    for t in [*texts(300, 200), "a" * 3000, " " * 500, "\U0001f600" * 300]:
        assert own.encode(t) == own.model.encode(t)
    assert own.chunks > 500 and own.widened > 0


def test_overlap_must_fit():
    with pytest.raises(ValueError):
        SplicedEncoder(path("piece_bpe_32k.model"), 10, 10)


def test_token_counts(edges, nothing):
    model = path("piece_bpe_32k.model")
    library = SplicedEncoder(model).model
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in tokens.count_tokens(edges, model, chunk=500, overlap=20).collect())
    assert got == sorted((str(r["doc_id"]), len(library.encode(r["text"] or ""))) for r in edges.collect())
    assert tokens.count_tokens(edges, model, out="n_bytes").columns.count("n_bytes") == 1
    assert tokens.count_tokens(nothing, model).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path("byte_bpe_50k.json"))


def test_pair_index_equals_the_library(library):
    own = bpe.PairIndexBPE(path("byte_bpe_50k.json"), remember=50)
    sample = texts(1500, 60, 2)
    for start in range(0, len(sample), 100):
        part = sample[start : start + 100]
        ids = [x.tolist() for x in own.encode(part)]
        assert ids == [x.ids for x in library.encode_batch(part, add_special_tokens=False)]
        assert [own.decode(x) for x in ids] == [library.decode(x, skip_special_tokens=False) for x in ids] == part


def test_repeated_pairs_merge_from_the_left(library):
    own = bpe.PairIndexBPE(path("byte_bpe_50k.json"))
    words = ["a" * k for k in range(1, 40)] + ["ab" * k for k in range(1, 20)] + ["--" * k for k in range(1, 30)]
    assert [x.tolist() for x in own.encode(words)] == [x.ids for x in library.encode_batch(words, add_special_tokens=False)]


def test_no_new_words():
    own = bpe.PairIndexBPE(path("byte_bpe_50k.json"))
    assert own.encode_words([]) == [] and own.encode(["", ""])[1].tolist() == []
    assert own.encode(["a b", "a b"])[0].tolist() == own.encode(["a b"])[0].tolist()


def test_encode_and_decode_columns(edges, nothing, library):
    both = bpe.decode_bpe(bpe.encode_bpe(edges, path("byte_bpe_50k.json")), path("byte_bpe_50k.json"))
    assert both.columns.count("ids") == 1
    rows = {str(r["doc_id"]): r for r in both.collect()}
    for r in edges.collect():
        t = r["text"] or ""
        assert rows[str(r["doc_id"])]["decoded"] == t and rows[str(r["doc_id"])]["ids"] == library.encode(t, add_special_tokens=False).ids
    digest = {str(r["doc_id"]): r for r in bpe.bpe_digests(edges, path("byte_bpe_50k.json")).collect()}
    assert digest["5"]["ids_sha256"] == digest["4"]["decoded_sha256"] == hashlib.sha256(b"").hexdigest() and digest["4"]["n_tokens"] == 0
    assert bpe.bpe_digests(nothing, path("byte_bpe_50k.json")).count() == 0
