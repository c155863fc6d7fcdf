import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import records
from cadenza.llm.common import shared_path
from cadenza.llm.queries import op8_records

from .conftest import pairs

LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert records.crc32c_many([b"123456789"]).tolist() == [0xE3069283]
    rng = random.Random(1)
    rows = [rng.randbytes(rng.choice([4, 5, 255, 256, 257, 1500])) for _ in range(30)]
    assert records.crc32c_many(rows).tolist() == [slow_crc32c(r) for r in rows]
    assert records.crc32c_many([]).tolist() == []


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, records.END_ID]


@pytest.mark.parametrize("width", [2, 4])
def test_files_are_read_back_in_order(spark, edge_docs, width):
    folder = shared_path(spark, "records")
    manifest = records.write_texts(spark, edge_docs, folder, width=width)
    rows = records.with_start(records.read_records(manifest), manifest).orderBy("start").collect()
    assert [r.id for r in rows] == sorted((r.id for r in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r.start == at
        at += len(r.ids) // 4
    want = sorted(str(ids_of(r.text)) for r in edge_docs.collect())
    assert sorted(str(np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    # random access by the index
    shard = {r.shard: r.path for r in manifest.collect()}
    for r in rows[::3]:
        assert records.read_record(shard[r.shard], r.number) == (r.id, r.ids)


def test_a_changed_byte_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    manifest = records.write_texts(spark, docs, str(tmp_path / "out"))
    path = manifest.first().path
    data = bytearray(open(path, "rb").read())
    data[-6] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        records.read_record(path, 0)


def test_an_id_that_does_not_fit():
    with pytest.raises(ValueError):
        records._frames([1], [np.array([70000], "<u4").tobytes()], 2)


def test_added_tokens_in_a_text(spark):
    text = "a <|endoftext|> b"
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(records.tokenize(F.col("text"), end_id=None).alias("ids")).first().ids
    assert np.frombuffer(got, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_empty_table(spark, no_docs):
    manifest = records.write_texts(spark, no_docs, shared_path(spark, "records"))
    assert manifest.count() == 0
    assert records.with_start(records.read_records(manifest), manifest).count() == 0


def test_query_against_the_library(spark, sf_small, documents):
    want, start = [], 0
    for r in sorted(documents.collect(), key=lambda r: r.doc_id):
        ids = np.array(ids_of(r.text), "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert pairs(op8_records(spark, sf_small), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_checksums_of_strings_of_one_size():
    rng = random.Random(2)
    for size in (4, 8, 16, 18):
        rows = [rng.randbytes(size) for _ in range(7)]
        assert records.crc32c_many(rows).tolist() == [slow_crc32c(r) for r in rows]


def test_a_piece_is_merged_once_and_the_cache_is_bounded(monkeypatch):
    asked = []
    known = records._Merged(lambda letters: asked.append(letters) or LIBRARY.model.tokenize(letters))
    monkeypatch.setattr(records, "CACHE_ENTRIES", 3)
    for piece in (" the", " é\n", " the", "\t", " the"):
        want = LIBRARY.encode(piece, add_special_tokens=False).ids
        assert np.frombuffer(known[piece], "<u4").tolist() == want
    assert len(asked) == 3
    assert known["x"] and len(known) == 1


def test_the_class_table_is_built_without_a_list_of_all_characters(monkeypatch):
    import tracemalloc

    from cadenza.llm import pretokens
    monkeypatch.setattr(pretokens, "worker_cache", lambda name: {})
    tracemalloc.start()
    table = pretokens._classes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20          # 130 MB before
    assert [table[ord(c)] for c in "  aé1.中"] == [0, 0, 1, 1, 2, 3, 1] and table[0xD800] == 3
