import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import bpe, pretokens
from cadenza.llm.queries import op9_bpe

from .conftest import EDGE_TEXTS, pairs

PATTERN = regex.compile(P.PATTERN)
CODEC = bpe.load_codec(P.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
TEXTS = st.text(st.sampled_from("aab's \n\t're tlvmd12!.é漢 \r\x0b\x1cⅧ²ñ🙂AB\x85　") | st.characters(
    exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_pieces_are_the_pattern_s_matches(texts):
    assert pretokens.split_many(texts) == [PATTERN.findall(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_joined_pieces_are_the_pattern_s_matches(text):
    leaf, pretokens.LEAF = pretokens.LEAF, 5
    try:
        assert pretokens._tree(text) == PATTERN.findall(text)
    finally:
        pretokens.LEAF = leaf


def ids(text):
    return np.frombuffer(CODEC.encode_many([text])[0], np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(TEXTS | st.text(st.sampled_from("abcdeth"), max_size=200))
def test_ids_are_the_library_s(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=120), st.integers(0, 120))
def test_join_of_any_two_parts_is_the_whole(data, cut):
    whole = CODEC.merges(data)
    assert CODEC.join(CODEC.merges(data[:cut]), CODEC.merges(data[cut:])) == whole == CODEC._merges_by_heap(data)


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 9000 + "\n" * 3000, "don't " * 20000, "x'" * 9000])
def test_long_runs(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_decoding_unknown_ids():
    assert CODEC.decode([10 ** 6, ids("a")[0]]) == "�a".encode()


def test_edges(spark, edge_docs, no_docs):
    coded = bpe.encode_decode(edge_docs)
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in EDGE_TEXTS for _ in range(2))
    assert sorted(r.decoded_sha256 for r in bpe.digests(coded).collect()) == want
    assert bpe.encode_decode(no_docs).count() == 0
    one = edge_docs.select(bpe.decode(bpe.encode(edge_docs.text).cast("array<int>")).alias("d")).limit(1)
    assert one.first().d == b""


def test_query_against_the_library(spark, sf_small, documents):
    def sha(data):
        return hashlib.sha256(data).hexdigest()
    want = []
    for r in documents.collect():
        tokens = LIBRARY.encode_ordinary(r.text)
        want.append((r.doc_id, len(tokens), sha(",".join(map(str, tokens)).encode()), sha(r.text.encode())))
    assert pairs(op9_bpe(spark, sf_small), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_a_text_is_encoded_once(spark, documents):
    """The plan has one Python evaluation with one call in it, for the query and
    for the pipeline's stage."""
    import re

    import corpus_pipeline
    from cadenza.plans import inspect
    for df in (bpe.digests(bpe.encode_decode(documents)), corpus_pipeline.tokenize(spark, documents, "")):
        text = inspect.plan_text(df)
        assert re.findall(r"Arguments: (\[run\(.*?\)), ", text) or "run(" in text
        calls = re.findall(r"Arguments: \[(run\([^\n]*)\], \[", text)
        assert len(calls) == 1 and calls[0].count("run(") == 1, calls


def test_caches_of_other_operators_are_emptied():
    from cadenza.llm import common
    for name in ("one", "two"):
        common.worker_cache(name)["x"] = [0] * 1000
    common.keep_caches("two")
    assert not common.worker_cache("one") and common.worker_cache("two")
    common.keep_caches()
    assert not common.worker_cache("two")
