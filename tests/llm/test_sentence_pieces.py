"""SentencePiece encoding against the library, on whole texts of every kind."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lurewatch.llm import sentence_pieces as SP

ODD = [None, "", " ", "  ", "a", " a", "a ", "▁", "▁▁a", "\n", "\x00", "é😀", "中梦x", " " * 15, " " * 16, " " * 100 + "the", "aaaa", "<s></s><0x0A><unk>", "\t \n ", "é" * 900, "x" * 3000]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=SP.model_path())


@pytest.fixture(scope="module")
def own():
    return SP.Vocabulary(SP.model_path())


def same(own, library, texts):
    ids, first = own.encode(texts)
    raw, edge = own.decoded(ids, first)
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_eos=True)
        assert ids[first[i]: first[i + 1]].tolist() == want, text
        assert raw[edge[i]: edge[i + 1]].tobytes().decode() == library.decode(want) == own.decode(want)


def test_odd_texts(own, library):
    same(own, library, ODD)
    same(own, library, [])


def test_runs_of_one_character(own, library):
    same(own, library, [c * n for c in "aes=-#*. _0\n\t'/zl" for n in (*range(1, 36), 63, 64, 65, 500)])


def test_random_texts_and_pieces(own, library):
    rng = random.Random(1)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    same(own, library, ["".join(rng.choice("the an ss  io▁é中😀\n=-") for _ in range(rng.randrange(1, 300))) for _ in range(400)])
    same(own, library, ["".join(rng.choice(pieces) for _ in range(40)) for _ in range(400)])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, library, text):
    same(own, library, [text])


def test_long_texts_go_by_stretches(own, library, monkeypatch):
    monkeypatch.setattr(SP, "STRETCH", 50)
    monkeypatch.setattr(SP, "KNOWN", 20)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("the", "cat", " sat", "x" * 130, "é")) for _ in range(n)) for n in (0, 1, 40, 400, 3)] + [" " * 700, "x" * 700]
    for _ in range(3):  # the worker forgets words in between
        same(own, library, texts)


def test_any_ids_decode(own, library):
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.choice((1, 2, 28705, rng.randrange(3, 259), rng.randrange(259, 32000))) for _ in range(rng.randrange(8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_query(spark, library, tmp_path):
    schema = "doc_id long, text string, lang string, ids string, decoded int"
    rows = [(i, t, "en", "clash", 1) for i, t in enumerate(ODD)] + [(None, "no id", "en", "x", 2), (3, "again", "de", "x", 2), (3, "again", "de", "x", 2)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, SP.op11(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_eos=True)
        want.append((i, len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), library.decode(ids)))))
    assert got == sorted(want, key=repr)
    back = SP.encode_documents(spark.createDataFrame(rows, schema).where("text NOT LIKE '%▁%'"))
    assert back.where(F.col("decoded").isNull()).isEmpty()
    assert SP.encode_documents(spark.createDataFrame([], schema)).count() == 0
