from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evigraph.llm import tokens

LIBRARY = Tokenizer.from_file(tokens.TOKENIZER)


ENCODER = tokens.encoder(tokens.TOKENIZER)
PARTS = [" ", "  ", "\n", "a", "Größe", "don't", "42", "!!", "\u00a0", "\x1c", "<|endoftext|>", "é", ".", ",", "x.", "½", "中", "\u0301", "\U0001f600"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=20).map("".join), max_size=6))
def test_encoder_is_the_library(texts):
    found = ENCODER.many(pa.array(texts, pa.string()), 0)
    assert [x.tolist() for x in found] == [LIBRARY.encode(t, add_special_tokens=False).ids + [0] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoder_on_any_text(text):
    assert ENCODER.many(pa.array([text, f"x {text} y"]))[1].tolist() == LIBRARY.encode(f"x {text} y", add_special_tokens=False).ids


def test_encoder_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 3)
    monkeypatch.setattr(tokens, "LINE_WORDS", 2)
    own = tokens.Encoder(tokens.TOKENIZER)
    for text in ("one two three four five", "one, six. seven", "one two three four five "):
        assert own.many(pa.array([text]))[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=3000), st.integers(1, 50))
def test_coder_round_trip(ids, more):
    ids = np.array(ids * more, np.uint32)
    coder = tokens.Coder(tokens.frequencies(np.bincount(ids, minlength=50)))
    lanes, payload, points = coder.encode(ids)
    assert (coder.decode(len(ids), lanes, payload, points) == ids).all()
    steps = -(-len(ids) // lanes)
    for part in range(-(-steps // tokens.STEP_IDS)):
        want = ids[part * tokens.STEP_IDS * lanes : (part + 1) * tokens.STEP_IDS * lanes]
        assert (coder.decode(len(ids), lanes, payload, points, part, 1) == want).all()


def test_frequencies():
    counts = np.array([10**12, 1, 0] + [1] * 5000)
    freq = tokens.frequencies(counts)
    assert freq.sum() == 1 << tokens.SCALE_BITS and ((freq > 0) == (counts > 0)).all()


def test_files(spark, tmp_path):
    texts = ["", None, "Hello world", "x " * 5000, "tail\n\n", "Hello world"]
    data = [(i * 3, t, "e") for i, t in enumerate(texts)] + [(None, "null id", "e"), (6, "Hello world", "e"), (6, "again", "e")]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids string").repartition(3)
    path = str(tmp_path / "t")
    found = tokens.digest(tokens.token_files(docs, path, block_tokens=100)).collect()
    at, want = 0, []
    for i, t, _ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    assert tokens.token_files(docs.limit(0)).count() == 0
    broken = spark.read.parquet(f"{path}/blocks").selectExpr("* except (payload)", "cast('junk' as binary) payload")
    broken.write.parquet(str(tmp_path / "b" / "blocks"))
    spark.read.parquet(f"{path}/table").write.parquet(str(tmp_path / "b" / "table"))
    with pytest.raises(Exception, match="damaged"):
        tokens.read(spark, str(tmp_path / "b")).count()
