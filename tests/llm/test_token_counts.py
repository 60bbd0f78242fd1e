import random

import pytest

tokenizers = pytest.importorskip("public_tokenizers")

from panelforge.llm.token_counts import count_long, counter, encoder, load, parts_at_spaces, piecewise, token_counts  # noqa: E402

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.mark.parametrize("name", NAMES)
def test_spliced_counts_equal_whole_counts(name):
    tokenizer = load(tokenizers.path(name))
    count, encode = counter(tokenizer), encoder(tokenizer)
    rng = random.Random(1)
    texts = ["a" * 9000, " " * 9000, "ab " * 2000 + "z" * 5000 + " q" * 2000, "é́" * 2000 + " x" * 2000, "", "!?" * 5000, "ΑΣ " * 2500]
    texts += ["don't " * 1500 + "<|endoftext|>" * 500 + "12345" * 700, "中文字" * 2500]
    texts += ["".join(rng.choice(["a", "b ", "'s", "é", "1", "!", "\n", "<|endoftext|>", "中", "<|end", "  "]) for _ in range(6000)) for _ in range(8)]
    for text in texts:
        for chunk, overlap in ((3000, 300), (500, 260)):
            assert count_long(text, encode, chunk, overlap) == count([text])[0]


def test_messy_rows(messy, nothing):
    path = tokenizers.path(NAMES[0])
    whole = counter(load(path))
    got = token_counts(messy, path, chunk=2000, overlap=400)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = messy.select("doc_id", "text").collect()
    want = []
    for r in rows:
        n = whole([r.text or ""])[0]
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert token_counts(nothing, path).count() == 0


def test_piece_model(documents):
    path = tokenizers.path("piece_bpe_32k.model")
    whole = counter(load(path))
    some = documents.filter("doc_id < 40")
    got = {r.doc_id: r.n_tokens for r in token_counts(some, path).collect()}
    assert got == {r.doc_id: whole([r.text])[0] for r in some.collect()}


def test_repeated_parts_are_encoded_once():
    tokenizer = load(tokenizers.path(NAMES[0]))
    count, sent = counter(tokenizer), []

    def counted(texts):
        sent.extend(texts)
        return count(texts)

    rng = random.Random(2)
    marks = ["a", "b ", " ", "  ", "\n", "\x1c", " ", " ́", "İ", "Σ", "'s", "é", "1", "!", "<|endoftext|>", "<|end", "中", "z" * 99]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 80))) for _ in range(3000)] + ["the same words again " * 500] * 3
    pieces = piecewise(counted, known=200)
    got = [n for i in range(0, len(texts), 50) for n in pieces(texts[i : i + 50])]
    assert got == count(texts)
    assert not any("same words" in t for t in sent)


def test_only_files_without_tokens_over_spaces_are_cut():
    names = [*NAMES, "piece_bpe_32k.model"]
    assert [parts_at_spaces(load(tokenizers.path(n))) for n in names] == [True, False, False]


def test_query_counts_by_pieces(spark, monkeypatch):
    from panelforge.llm import token_counts as module

    monkeypatch.setattr(module, "counter", lambda tokenizer: lambda texts: [len(t) for t in texts])
    df = spark.createDataFrame([(1, "ab ab ab")], "doc_id long, text string")
    assert module.token_counts(df, tokenizers.path(NAMES[0])).first().n_tokens == 6
