"""op8 against the unigram model of the tokenizers library on the same pieces and scores."""

from __future__ import annotations

import sentencepiece
from tokenizers import Tokenizer, models, normalizers

from brookcheck.llm import token_counts

PATH = "/opt/tokenizers/piece_bpe_32k.model"


def exact():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    vocab = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(token_counts.MARK), normalizers.Replace(" ", token_counts.MARK)])
    return t


def test_counts_equal_tokenizer(spark):
    t = exact()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PATH).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}


def test_odd_texts(spark):
    t = exact()
    texts = ["", " ", "  ", "a", " a", "a  b   c ", "\n\n", "a\n b\n\n  c", "▁x ▁▁y", "漢字かな 😀😀 ½", "x" * 5000, "\t tab\tx", "é" * 300, "a \n", "   lead", "trail   \n  "]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string"), PATH).collect()}
    assert got.pop(99) == 0
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_runs_of_unknown_characters_are_one_piece_without_bytes():
    model = token_counts.Unigram([("▁", -1.0), ("a", -2.0), ("▁a", -3.0)], -3.0, False)
    assert model.count("aXXa X") == 5
    assert model.best("▁a") == 1  # a tie goes to the piece that starts first


def test_odd_rows(spark):
    """Null ids and texts, repeated rows, names that clash, a very long text, an empty table."""
    long = "an unlikely sequence of words, é😀 and more\n" * 20000
    rows = [(None, "hello world"), (7, "hello world"), (7, "hello world"), (8, None), (9, ""), (10, long)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_tokens int, tokens string")
    t = exact()
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(df, PATH).collect())
    n = len(t.encode("hello world").ids)
    assert got == sorted([("None", n), ("7", n), ("7", n), ("8", 0), ("9", 0), ("10", len(t.encode(long).ids))])
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0
