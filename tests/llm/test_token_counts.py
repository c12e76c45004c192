"""Token counts against the libraries' own counts of whole texts."""

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tradeweft.llm import token_counts

ODD = ["", None, "a  b", " lead", "trail ", "tab\tb \t c", "日本語 テキスト", "it's we'LL 'S", "\x00 \x01", "x <|endoftext|>y <|startoftext|>",
       "x" * 900, "💩👍🏽 é" * 40, "İstanbul ẞ Σας " * 20, "one two  three\n\nfour " * 60, "a ́b " * 50, "12 34, 5-6. " * 80, " \n" * 90,
       "a \ue000 b\ue000c", "\ue000\ue000 d \uf8ff \ue001"]


def brute(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = SentencePieceProcessor(model_file=path)
        return [len(model.encode(t or "")) for t in texts]
    whole = Tokenizer.from_file(path)
    return [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, monkeypatch, name):
    counter = token_counts.Counter(public_tokenizers.path(name))
    monkeypatch.setattr(token_counts, "PIECE", 7)
    monkeypatch.setattr(token_counts, "BATCH", 64)
    monkeypatch.setattr(token_counts, "KNOWN", 40)
    if name != "word_bpe_49k.json":
        assert sum(1 for _ in counter.pieces("one two three four " * 20)) > 10
    assert counter.count([(t or "").encode() for t in ODD]).tolist() == brute(name, ODD)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, public_tokenizers.path(name), 100).collect()}
    want = brute(name, ODD)
    assert [got[i].n_tokens for i in range(len(ODD))] == want
    assert all(r.over_limit == (r.n_tokens > 100) and r.n_bytes == len((ODD[i] or "").encode()) for i, r in got.items())


def test_long_texts_whole_tables_and_odd_rows(spark, small):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(300)
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: "word one, " * 40_000, -2: "y" * 50_000}
    more = spark.createDataFrame([(k, t) for k, t in texts.items() if k < 0], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs.select("doc_id", "text").union(more), path, 2048).collect()}
    assert got == dict(zip(texts, brute("word_bpe_49k.json", texts.values())))
    rows = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    assert sorted(map(repr, (tuple(r) for r in token_counts.count_tokens(rows, path, 1).collect()))) == sorted(map(repr, [
        (None, 3, 2, True), (None, 0, 0, False), (1, 3, 2, True), (1, 3, 2, True), (1, 1, 1, False)]))
    empty = token_counts.count_tokens(rows.limit(0), path, 1)
    assert empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and empty.count() == 0
