import hashlib
import random
import time

import public_tokenizers
import pytest
import sentencepiece
from cases import none, odd, same_columns

from lakeloom.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.vocabulary(MODEL))


@pytest.fixture(scope="module")
def decoder():
    return pieces.Decoder(pieces.vocabulary(MODEL))


HARD = ["", " ", "   ", "a", " a", "a ", "\n", "a\n\n\tb", "▁", "a▁b ▁", "<s>", "<0x41>", "<unk> </s>", "\x00a\x00", "aaaaaaaaaaaaaaaaaaaaaaaaa", " " * 100, "-" * 50 + "=" * 33, "漢字 \U0001f600\U0001f601 힣", "é ﬁ Ａ", "​﻿", "12345678901234567890", "ha" * 300, "\r\n" * 20, "  　"]


def test_hard_texts(library, encoder, decoder):
    for t in HARD:
        ids = library.encode(t)
        assert encoder.encode(t).tolist() == ids, t
        assert decoder.decode(ids) == library.decode(ids), t


def test_random_texts(library, encoder, decoder):
    """Texts of random pieces, where ties and overlaps abound, and of few letters."""
    rng = random.Random(5)
    some = [p.replace(pieces.SPACE, " ") for p in encoder.ids]
    for n in range(3000):
        t = "".join(rng.choices(some, k=rng.randint(1, 30))) if n % 2 else "".join(rng.choices(rng.choice(["ab ", "eatin ", "é一 x\n", "=-*/", "01 "]), k=rng.randint(1, 60)))
        ids = library.encode(t)
        assert encoder.encode(t).tolist() == ids, t
        assert decoder.decode(ids) == library.decode(ids), t


def test_random_ids(library, decoder):
    """Bytes that are no UTF-8, control and unknown tokens anywhere."""
    rng = random.Random(6)
    for _ in range(3000):
        ids = [rng.randrange(rng.choice([3, 259, 32_000])) for _ in range(rng.randint(0, 12))]
        assert decoder.decode(ids) == library.decode(ids), ids


def test_one_last_token(encoder):
    """No other token that ends a prefix is compatible with the prefix before it."""
    text = pieces.SPACE + "the▁international▁banana▁sesses"
    for n in range(1, len(text) + 1):
        fits = []
        for k in range(1, n + 1):
            token = text[n - k : n]
            if token in encoder.ids and encoder.history(token):
                before = encoder.encoded(text[: n - k])
                fits += [token] if not before or encoder.compatible(before[-1], encoder.ids[token]) else []
        assert fits == [encoder.pieces[encoder.encoded(text[:n])[-1]]]


def test_long_words_take_time_that_grows_with_them(library, encoder):
    rng = random.Random(7)
    t = "".join(rng.choices("abcdefghij", k=200_000))
    began = time.time()
    got = encoder.encode(t).tolist()
    assert time.time() - began < 20 and got == library.encode(t)


def test_odd_rows(spark, library):
    docs = odd(spark)
    out = pieces.tokenised(docs, MODEL)
    same_columns(out, docs, ["ids", "decoded"])
    for r in out.collect():
        assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == library.decode(r["ids"])
    assert pieces.tokenised(none(spark), MODEL).collect() == []


def test_column_that_is_replaced(spark, library):
    """The text may be in a column of an output's name."""
    out = pieces.tokenised(spark.createDataFrame([("two words", 1)], "ids string, encoded int"), MODEL, text_col="ids").collect()
    assert [(r["ids"], r["encoded"], r["decoded"]) for r in out] == [(library.encode("two words"), 1, "two words")]


def test_query(spark, data, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(tuple(r) for r in pieces.query(spark, data).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(want)
