"""The encoder against the public library, over texts of every kind."""

import base64
import random
from pathlib import Path

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm.bpe import SPLIT_PATTERN, PrefixEncoder
from gleanery.llm.encoding import BYTE_BPE_50K, count_tokens, encode

RANKS = Path(BYTE_BPE_50K).with_suffix(".tiktoken")
pytestmark = pytest.mark.skipif(not RANKS.exists(), reason="no tokenizer files")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.read_bytes().splitlines())}
    known = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return PrefixEncoder(Path(BYTE_BPE_50K).read_bytes()), known


def test_every_token_encodes_to_itself(both):
    own, _ = both
    assert all(own.encodes_to_itself(k) for k in range(len(own.ids)))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(both, text):
    own, known = both
    assert own.encode(text) == known.encode_ordinary(text)


def test_hard_texts(both):
    own, known = both
    rng = random.Random(5)
    alphabet = "ab \n\t\x1c\x85\xa0　é中😀_-1٣ⅷ́​<|endoftext|>'s'll"
    texts = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(2000)]
    texts += ["a" * 100_000, "_" * 30_001, "ab" * 20_000, " " * 9_999 + "x", "中文" * 5_000]
    for t in texts:
        assert own.encode(t) == known.encode_ordinary(t)


def test_frames(spark, both):
    _, known = both
    rows = [(1, "one two", "x"), (2, None, None), (3, "", "y"), (4, "  \r\n", "z"), (None, "null key", "z"), (5, "w" * 50_000, "z"), (5, "again", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "key")
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in encode(df).collect())
    assert got == sorted((k or 0, known.encode_ordinary(t) if t else []) for k, t, _ in rows)
    sizes = sorted((r["doc_id"] or 0, r["tokens"]) for r in count_tokens(df, ["doc_id"]).collect())
    assert sizes == sorted((k or 0, len(known.encode_ordinary(t)) if t else 0) for k, t, _ in rows)
    assert encode(df.limit(0)).collect() == []
