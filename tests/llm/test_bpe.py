import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from skywright.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def ours():
    return bpe.WordBPE(PATH)


def check(ours, library, texts):
    for text, (ids, decoded) in zip(texts, ours.encode_batch(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert decoded == library.decode(want, skip_special_tokens=False) == ours.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60), max_size=4))
def test_any_text(ours, library, texts):
    check(ours, library, texts)


def test_hard_texts(ours, library):
    rng = random.Random(2)
    pool = "abcdeéÜßΣσςİı'’s \t\n\x1c\x1f\x85 　019½!?#$%&*|<>…😀漢かก็हि́\x00​ǅ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    texts += ["a" * 3000, "ab" * 2000, "hahaha" * 50, "<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "they're I'LL 'tis", "", None, "   "]
    check(ours, library, texts + texts)


def test_small_memo_gives_the_same(library):
    rng = random.Random(3)
    t = bpe.WordBPE(PATH, memo_words=20)
    for _ in range(5):
        check(t, library, ["".join(rng.choice("abcdef ") for _ in range(300)) for _ in range(4)])


def test_query_over_odd_rows(spark, library):
    rows = [(1, "Hello hello", "x"), (1, "Hello hello", "x"), (2, None, None), (3, "", "y"), (None, "word " * 20000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.encode(df, PATH).collect()
    assert len(got) == 5
    for r in got:
        text = next(t or "" for i, t, _ in rows if i == r["doc_id"])
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert {r["decoded"] for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()} == {r["decoded"] for r in got}
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_workers_keep_no_words_behind_a_stage(spark):
    """Python workers outlive their tasks: the memo of words is dropped when a task ends, and the next task encodes alike."""
    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{k}" for k in range(300))) for i in range(40)], "doc_id long, text string").repartition(4)
    path = public_tokenizers.path("word_bpe_49k.json")
    first = sorted(map(repr, bpe.encode(docs, path).collect()))

    def held(batches):
        import pyarrow as pa

        from skywright.llm import bpe

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(b.memo) - len(b.special) for b in bpe._LOADED.values()], pa.int64())], ["n"])

    got = [r["n"] for r in spark.range(0, 400, 1, 4).mapInArrow(held, "n long").collect()]
    assert got and max(got) == 0
    assert sorted(map(repr, bpe.encode(docs, path).collect())) == first
