import random

import pyarrow.parquet as pq
import pytest
from ledgerloom.llm import pieces

ODD = ["", " ", "  ", "\n", " \n ", "a", "  a  b ", "\t x", "▁a", "▁", " ▁ ", "▁▁x", "é" * 50, "x" * 5000, "日本語 😀😀 \U0001f9d1‍\U0001f680",
       "�", "a\x00b", "<0x0A> <s> </s> <unk>", "\r\n\r\n", " " * 33 + "x", "  a　b", "ab" * 40 + " " + "the" * 30]


@pytest.fixture(scope="module")
def own():
    return pieces.codec(pieces.default_model())


def test_encodes_and_decodes_as_the_library(own):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab  the\n\t▁éß日😀.,ing<>0x") for _ in range(rng.randint(1, 200))) for _ in range(400)]
    own.check(texts, [own.encode(t) for t in texts])
    for t in texts:
        ids = own.library.encode(t)
        assert own.digests([t]) == [(len(ids), pieces._sha(",".join(map(str, ids))), pieces._sha(own.library.decode(ids)))]


def test_all_small_documents_as_the_library(own):
    for t in [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]:
        ids = own.library.encode(t)
        assert own.encode(t) == ids
        assert own.digests([t]) == [(len(ids), pieces._sha(",".join(map(str, ids))), pieces._sha(own.library.decode(ids)))]


def test_decodes_any_ids_as_the_library(own):
    rng = random.Random(2)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(3, 32000), rng.randrange(3, 259), rng.choice([1, 2, 29871])]) for _ in range(rng.randint(1, 20))]
        assert own.decode(ids) == own.library.decode(ids), ids


def test_matrix_and_heap_agendas_agree(own):
    rng = random.Random(3)
    words = ["".join(rng.choice("abenthior▁é日") for _ in range(rng.randint(1, 60))) for _ in range(600)]
    assert own._merged_rows(words) == [own._merged_many(w) for w in words]


def test_forgetting_changes_nothing(own, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    texts = ["the cat sat on the mat", "a mat sat on the other cat", "the the the", "x" * 200 + " the"] * 3
    own.forget()
    one_by_one = [own.encode_many([t])[0] for t in texts]
    own.forget()
    assert own.encode_many(texts) == one_by_one


def test_a_cut_unlike_the_librarys_ends_the_job(own, monkeypatch):
    own.forget()
    monkeypatch.setattr(own, "_merged_rows", lambda words: [[5]] * len(words))
    with pytest.raises(AssertionError):
        own.encode("some other words")
    own.forget()


def test_columns_keep_rows_nulls_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], "doc_id long, text string, n_tokens string")
    ids = pieces.encode_column(df)
    back = pieces.decode_column(ids).collect()
    assert sorted((r.text or "", r.decoded) for r in back) == [("", ""), ("a b", "a b"), ("a b", "a b")]
    out = pieces.piece_digests(df).collect()
    assert sorted(r.n_tokens for r in out) == [0, 2, 2]
    assert pieces.piece_digests(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.encode_column(df, name="text")
