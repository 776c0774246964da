import unicodedata
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.fs
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronoloom.llm import chunks, piecefst, queries, tokencount, tokenstore
from chronoloom.llm.common import shared_dir

BYTE, WORD, PIECES = queries.BYTE_BPE, queries.WORD_BPE, queries.PIECES
HARD = ["", " ", "  ", "a  b", "a \n b", "\n a", "a\n ", "x\t y", "don't 's", "<|endoftext|>", "a <|endoftext|> b", "a \n<|endoftext|>  c", "é漢字🙂 x", "word " * 500, "y" * 3000, "a b\xa0 c", "\x1c \x1d a", "ΟΔΟΣ Σ. É", "<|startoftext|>x", " lead", "trail ", "i̇ ́x", "İ.", "DİYARBAKIRİ.", "TARİHİ, x", "x\n\n", "a.\n\n\n b", "a \n", "\n\na", "x<|endoftext|>y ,<|", "² a²", "(a) 'tis '"]
TEXTS = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "the", "é", "漢", "'s", ".", "<|endoftext|>", "▁", "1", "Σ", "́", "\xa0", "İ", "ẞ", "ǅ", "K", "²", "(", "<|"]), max_size=30).map("".join)


@pytest.fixture(scope="module")
def library():
    return {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in (BYTE, WORD)}


@pytest.fixture(scope="module")
def texts(sf):
    return HARD + list(pd.read_parquet(f"{sf}/documents.parquet").text)


def test_counts_equal_the_library(library, texts):
    want = [len(e.ids) for e in library[WORD].encode_batch(texts, add_special_tokens=False)]
    sizes, got = tokencount.counter(WORD)(texts)
    assert got == want and sizes == [len(t.encode()) for t in texts]


def test_ids_equal_the_library(library, texts):
    got = tokenstore.Encoder(BYTE, 2)(texts)
    for t, g, e in zip(texts, got, library[BYTE].encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(g, "<u2").tolist() == [*e.ids, 2], repr(t[:60])


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=8))
def test_any_texts(some):
    fresh = Tokenizer.from_file(public_tokenizers.path(BYTE))
    for g, t in zip(ENCODER(some), some, strict=True):
        assert np.frombuffer(g, "<u2").tolist() == [*fresh_ids(fresh, t), 2]
    assert COUNTER(some)[1] == [len(e.ids) for e in WORDS.encode_batch(some, add_special_tokens=False)]


def test_characters_whose_lower_case_differs(library):
    odd = [c for c in map(chr, range(0x80, 0x20000)) if len(c.lower()) > 1 or unicodedata.category(c) != unicodedata.category(c.lower())]
    some = [f"a{c}. {c}, {c}b {c}{c}\n{c}" for c in odd]
    assert COUNTER(some)[1] == [len(e.ids) for e in WORDS.encode_batch(some, add_special_tokens=False)]
    for t, g, e in zip(some, ENCODER(some), library[BYTE].encode_batch(some, add_special_tokens=False), strict=True):
        assert np.frombuffer(g, "<u2").tolist() == [*e.ids, 2], repr(t)


def test_long_texts_and_old_pieces(library):
    """Pieces leave the memo and come back; megabytes in one text."""
    some = [" ".join(f"w{(i * 7919 + j) % 9001}x." for j in range(3000)) for i in range(5)] + ["ab\n" * 400_000, "z" * 300_000]
    counts = chunks.WordCounts(chunks.load(WORD))
    counts.known.most = 500
    packed = chunks.ByteLevelPieces(chunks.load(BYTE), lambda ids: np.array(ids, "<u2").tobytes())
    packed.raw.most = packed.after.most = 500
    for t in some:
        assert counts([t]) == [len(library[WORD].encode(t, add_special_tokens=False))]
        assert np.frombuffer(packed(t), "<u2").tolist() == fresh_ids(library[BYTE], t)
    assert len(counts.known.older) + len(packed.after.older) > 0


def test_counts_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "A b", 5), (3, "A b", 5), (None, "x", 5)], "doc_id long, text string, N_TOKENS int")
    got = tokencount.with_counts(df, WORD, limit=1)
    assert set(got.columns) == {"doc_id", "text", "n_bytes", "n_tokens", "over_limit"}
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == [(0, 1, 1, False), (1, 0, 0, False), (2, 0, 0, False), (3, 3, 2, True), (3, 3, 2, True)]
    assert tokencount.with_counts(df.limit(0), WORD).count() == 0


def fresh_ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


ENCODER, COUNTER, WORDS = tokenstore.Encoder(BYTE, 2), tokencount.counter(WORD), Tokenizer.from_file(public_tokenizers.path(WORD))


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        perfect = tokenstore.PerfectHash.build(keys)
        assert sorted(perfect.slots(keys).tolist()) == list(range(len(keys)))


def test_shards_and_lookup(spark, library, sf):
    docs = spark.createDataFrame([(5, "b c"), (5, "a"), (-3, None), (None, "zz"), (9, "q" * 1000), (5, "a")], "doc_id long, text string").withColumn("PATH", pd_lit())
    manifest = tokenstore.write_shards(docs, shared_dir(spark, "t"), BYTE, 2)
    rows = tokenstore.read_records(manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, -3, 5, 5, 5, 9]
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    found = tokenstore.fetch(manifest, spark.createDataFrame([(5,), (7,), (-3,)], "doc_id long")).collect()
    assert sorted(r.key for r in found) == [-3, 5, 5, 5]
    assert [r.ids for r in found if r.key == -3] == [[2]]
    path = manifest.first().path
    fs, p = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(p) as f:
        assert tokenstore.Shard(f).lookup(np.array([123456789]))[0].tolist() == [-1]
    assert tokenstore.read_records(tokenstore.write_shards(docs.limit(0), shared_dir(spark, "t"), BYTE, 2)).count() == 0


def pd_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_query_equals_the_library(spark, library, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    got = queries.op2_token_shards(spark, sf).toPandas().sort_values("doc_id")
    ids = [[*e.ids, 2] for e in library[BYTE].encode_batch(list(docs.text), add_special_tokens=False)]
    n = [len(i) for i in ids]
    assert got.n_tokens.tolist() == n and got.start.tolist() == (np.cumsum(n) - n).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]
    counts = queries.op4_token_counts(spark, sf).toPandas().sort_values("doc_id")
    assert counts.n_tokens.tolist() == [len(e.ids) for e in library[WORD].encode_batch(list(docs.text), add_special_tokens=False)]
    assert (counts.over_limit == (counts.n_tokens > 2048)).all()


MACHINE = piecefst.PieceTransducer(PIECES)
MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))


def test_pieces_equal_the_library(texts):
    for t in texts:
        assert np.frombuffer(MACHINE.encode(t), "<u4").tolist() == MODEL.encode(t), repr(t[:60])
        assert MACHINE.decode(MACHINE.encode(t)) == t.replace("▁", " ")


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces_of_any_text(text):
    assert np.frombuffer(MACHINE.encode(text), "<u4").tolist() == MODEL.encode(text)


def test_round_trip_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a▁b", "x"), (3, "a▁b", "x")], "doc_id long, text string, N_PIECES string")
    got = piecefst.with_round_trip(df, PIECES).orderBy("doc_id").collect()
    assert [r.n_pieces for r in got][:2] == [0, 0] and [r.lossless for r in got] == [True, True, False, False]
    back = piecefst.with_decoded(piecefst.with_ids(df, PIECES), PIECES).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == ["", "", "a b", "a b"]
    clash = spark.createDataFrame([([MODEL.encode("ab")[0]], "j", None), (None, None, "k")], "ids array<int>, JOINED string, _ids_text string")
    got = piecefst.with_decoded(clash, PIECES)
    assert got.columns == ["ids", "JOINED", "_ids_text", "decoded"] and sorted((r.decoded, r.JOINED or "") for r in got.collect()) == [("", ""), ("ab", "j")]
    assert piecefst.with_round_trip(df.limit(0), PIECES).count() == 0
