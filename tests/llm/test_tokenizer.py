import random

import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm.tokenizer import TOKENIZER_DIR, WORD_PATTERN, Automaton, count_tokens, encode_texts, read_ranks

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module", params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def both(request):
    tokens = read_ranks(request.param)
    library = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return Automaton(tokens), library


def made_up(n, seed):
    rng = random.Random(seed)
    pools = ["aab ", "etaoin shrdlu", "0123 456", "\n\r\t  x", "éüñ漢字かな", "🙂‍́a", "=-_*{}\\", "'s't'll I'd", "<|endoftext|> "]
    for _ in range(n):
        yield "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60)))


def test_same_ids_as_the_library(both):
    automaton, library = both
    odd = ["", " ", "　", "<|endoftext|>", "a" * 3000, " " * 500, "\x00\x1c\x85", "﻿x", "ΑΣ İ ǅ", "x\r\n\r\n y", "\U000e0001", "10² Ⅳ"]
    for text in [*made_up(1500, 1), *odd]:
        ids = automaton.encode(text)
        assert ids == library.encode_ordinary(text)
        assert automaton.decode(ids) == text
        assert automaton.count(text) == len(ids)


def test_long_texts(both, monkeypatch):
    monkeypatch.setattr("strandloom.llm.tokenizer.HANDED_ON", 10)
    automaton, library = both
    for text in made_up(200, 9):
        assert automaton.encode(text) == library.encode_ordinary(text)


def test_accepts_only_what_the_merges_give(both):
    automaton, library = both
    rng = random.Random(2)
    for text in made_up(300, 3):
        for word in library.decode_batch([[t] for t in library.encode_ordinary(text)]):
            assert automaton.accepts(automaton.path(word.encode()))
    for token in rng.sample(range(256, len(automaton.tokens)), 500):
        data = automaton.tokens[token]
        assert automaton.path(data) == [token]
        assert not automaton.accepts(list(automaton.path(data[:1])) + list(automaton.path(data[1:]))) or len(data) == 1


def test_restored_automaton(both):
    automaton, _ = both
    again = Automaton(automaton.tokens, automaton.compiled())
    for text in made_up(200, 4):
        assert again.encode(text) == automaton.encode(text)


def test_small_merges():
    bytes_ = [bytes([i]) for i in range(256)]
    automaton = Automaton([*bytes_, b"aa", b"aaa"])  # aaa is aa + a
    a, aa, aaa = 97, 256, 257
    assert automaton.path(b"aaaa") == [aa, aa]
    assert automaton.path(b"aaaaa") == [aa, aaa]
    assert automaton.accepts([aa, aa]) and not automaton.accepts([a, a]) and not automaton.accepts([aa, a])
    with pytest.raises(ValueError):
        Automaton([*bytes_, b"abc"])


def test_whole_table(spark):
    documents = spark.read.parquet(DOCUMENTS)
    library = Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    expected = {i: e.ids for i, e in zip(texts, library.encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True)}
    got = {r.doc_id: list(r.ids) for r in encode_texts(documents, "doc_id", "text", "byte_bpe_50k").collect()}
    assert got == expected


def test_nulls_empty_and_clashing_names(spark, monkeypatch):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "hello world", "x", 1), (3, "hello world", "x", 1), (3, "hello world", "x", 1), (4, "a b " * 100_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, body string, text string, ids int").withColumn("id", F.lit(0))
    got = encode_texts(df, "doc_id", "body", "byte_bpe_50k")
    assert got.columns == ["doc_id", "ids"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(list(r.ids))
    assert by[1] == by[2] == [[]] and by[None] == [[31373, 995]] and by[3] == [[31373, 995]] * 2
    counts = {(r.doc_id, r.n_tokens) for r in count_tokens(df, "doc_id", "body", "byte_bpe_50k").collect()}
    assert counts == {(1, 0), (2, 0), (None, 2), (3, 2), (4, len(by[4][0]))}
    assert encode_texts(df.limit(0), "doc_id", "body", "byte_bpe_50k").collect() == []
