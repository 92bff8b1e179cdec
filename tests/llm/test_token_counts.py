"""Token counts beside the libraries' own, over whole tables and odd texts."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from odd import ODD, TWICE, frame

from emberline.llm.queries import op12_token_counts
from emberline.llm.token_counts import ChunkCounter, RunningCounter, count_tokens, counter_of

LETTERS = "aAbZé'ÉsS t.,!$<|>endoftext3٣ \n\tß…ñ×÷İİé≠’中文　 🙂-_()"
POOL = ["<|endoftext|>", "don't", "I'LL", "É.", "x²", "naïve", "<|ENDOFTEXT|>", "  ", " \n ", "abc def", "≠", "<s>", "</s>", "<unk>", "▁"]
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]


def plain(path):
    """Lengths as the library gives them for whole texts."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text or ""))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("name", FILES)
def test_random_texts(name):
    path, rnd = public_tokenizers.path(name), random.Random(3)
    counter, want = counter_of(path, cached=50, piece=7), plain(path)
    assert isinstance(counter, ChunkCounter if name.startswith("word") else RunningCounter)
    for _ in range(200):
        texts = ["".join(rnd.choice([rnd.choice(LETTERS), rnd.choice("abc 12 "), rnd.choice(POOL)]) for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 5))]
        assert counter.count(pa.array([*texts, None, ""])).tolist() == [*map(want, texts), 0, 0]


@pytest.mark.parametrize("name", FILES)
def test_odd_table(spark, name):
    path = public_tokenizers.path(name)
    want = plain(path)
    rows = [*ODD, *TWICE]
    got = [tuple(r) for r in count_tokens(frame(spark, rows), path, limit=60).collect()]
    expected = [(d, len((t or "").encode()), want(t), want(t) > 60) for d, t, *_ in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert count_tokens(frame(spark, []), path).count() == 0


def test_whole_table(spark):
    """The registered query on every document of a table, beside the library on whole texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = plain(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: tuple(r)[1:] for r in op12_token_counts(spark, "/root/testdata/sf0.01").collect()}
    assert got == {d: (len((t or "").encode()), (n := want(t)), n > 2048) for d, t in docs}
