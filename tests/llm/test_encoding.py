import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aerolith.llm.encoding import PATTERN, RANKS, Encoder, PerfectHash, encode

if not os.path.exists(RANKS):
    pytest.skip("no rank file here", allow_module_level=True)
E = Encoder(open(RANKS, "rb").read())


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    back = {v: k for k, v in E.ranks.items()}
    assert b"".join(back[i] for i in E.encode([text])[0]).decode("utf-8", "surrogatepass") == text


def test_same_as_the_public_encoder(public):
    r = random.Random(4)
    pool = [chr(c) for c in list(range(32, 127)) + list(range(0xA0, 0x250)) + [0x9, 0xA, 0xD, 0x85, 0x2003, 0x200B, 0x3000, 0x4E2D, 0x1F333, 0x1F9D1, 0x200D, 0x3E3B6, 0x301]]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 120))) for _ in range(3000)] + ["<|endoftext|>", "don't WE'VE", "a" * 50000, "é" * 20000, " \n\n  x", "  "]
    assert E.encode(texts) == [public.encode_ordinary(t) for t in texts]


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = PerfectHash(keys)
    assert sorted(h.numbers(keys)) == list(range(5000))


def test_rows(spark):
    rows = [(1, "hello world"), (2, ""), (3, None), (4, "hello world"), (4, "hello world")]
    got = [(r.doc_id, list(r.ids)) for r in encode(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()]
    assert sorted(got) == [(1, [31373, 995]), (2, []), (3, []), (4, [31373, 995]), (4, [31373, 995])]
    assert encode(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0
