import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import simhash
from cadenza.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42)
              for i in range(max(1, len(words) - k + 1))] if words else []
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def brute_components(items, linked):
    """Smallest member reachable for each item."""
    left, out = set(items), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if linked(x, y)}
            left -= near
            todo += near
        out.update({x: min(group) for x in group})
    return out


def distance(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b C d É e\x0bf g", "x " * 500])
def test_fingerprint_of_a_text(text):
    assert simhash.text_fingerprint(text, 3) == brute_print(text)


def test_slabs_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(str(i * i) for i in range(300))
    whole = simhash.text_fingerprint(text, 3)
    monkeypatch.setattr(simhash, "SLAB", 7)
    assert simhash.text_fingerprint(text, 3) == whole == brute_print(text)


@pytest.mark.parametrize("max_bits,hot", [(0, 2), (1, 2), (2, 0), (2, 2), (2, 1000), (3, 2)])
def test_links_keep_exactly_the_components(spark, max_bits, hot):
    rng = random.Random(max_bits)
    prints = set()
    for _ in range(12):         # chains and bundles of near fingerprints, negative ones too
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            prints.add(x - (1 << 64) if x >> 63 else x)
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    edges = simhash.links(df, max_bits, hot)
    for u, v in edges.collect():
        assert distance(u, v) <= max_bits
    got = {r.node: r.component for r in components(edges).collect()}
    want = brute_components(prints, lambda a, b: distance(a, b) <= max_bits)
    assert {x: got.get(x, x) for x in prints} == want


def test_links_of_a_large_bundle_are_linear(spark):
    prints = [0] + [1 << i for i in range(63)] + [1 << i | 1 << j for i in range(30) for j in range(i)]
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    edges = simhash.links(df, 2)
    assert edges.count() <= (65 + 2 * simhash.HOT * 33) * len(prints)
    assert simhash.dense_links(df, 2).count() <= 65 * len(prints)
    assert components(edges).select("component").distinct().count() == 1


def test_components_of_chains_and_self_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (7, 7), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


def test_near_duplicates_against_brute_force(spark, documents):
    docs = documents.collect()
    fp = {r.doc_id: brute_print(r.text) for r in docs}
    lowest = brute_components(set(fp.values()), lambda a, b: distance(a, b) <= 2)
    first = {}
    for i in sorted(fp):
        first.setdefault(lowest[fp[i]], i)
    got = {r.id: (r.fp, r.component_id) for r in simhash.near_duplicates(documents).collect()}
    assert got == {i: (f, first[lowest[f]]) for i, f in fp.items()}


def test_edges(spark, edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert {r.component_id for r in rows if r.fp == 0} == {0}
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert ids.count(None) == edge_docs.filter("doc_id is null").count()
    assert simhash.keep_one(no_docs).count() == 0


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(3, text), (1, text), (1, text), (5, text.upper()), (9, "other words here")],
                                 "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 9]
    hexes = simhash.near_duplicates(docs).select(simhash.hex_fingerprint(F.col("fp")).alias("h")).collect()
    assert all(re.fullmatch("[0-9a-f]{16}", r.h) for r in hexes)


def test_keep_one_by_id_and_text(spark):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"thing{i}" for i in range(60))
    rows = [(1, text, "a"), (1, other, "b"), (2, other, "c"), (2, other, "b"), (None, text, "d"), (None, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").selectExpr("*", "1 AS fp", "2 AS least")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    # one id with two texts keeps both; copies of a text keep the smallest id
    assert sorted(((r.doc_id, r.text, r.digest) for r in got.collect()), key=str) == sorted(
        [(1, text, "a"), (1, other, "b"), (None, text, "d"), (None, None, "e")], key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(5, text, "z"), (5, text, "y")], "doc_id long, text string, digest string")
    assert [r.digest for r in simhash.keep_one(copies).collect()] == ["y"]


def test_a_pair_is_fetched_by_its_segments(spark):
    """Far fingerprints meet in a segment's table and are turned down by the whole
    distance; near ones are found on either segment."""
    a = 0x0123456789ABCDEF
    rows = [a, a ^ 1 << 40 ^ 1 << 41, a ^ 1 << 3 ^ 1 << 60, a ^ 0xFFFF, a ^ 0xFFFF << 40, a ^ 7 << 20]
    edges = {tuple(sorted((r.u, r.v))) for r in simhash.links(spark.createDataFrame([(x,) for x in rows], "fp long"), 2).collect()}
    assert edges == {tuple(sorted(p)) for p in ((a, rows[1]), (a, rows[2]))}
