"""Quality, language and toxicity: held-out accuracy on the given tables, and
the parts against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import langid, learn, quality, toxicity
from cadenza.llm.queries import op3_quality, op6_language, op7_toxicity

SF = "/root/testdata/sf0.01"


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op3_quality(spark, SF).filter("held_out").join(labels, "doc_id").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.85


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op6_language(spark, SF).filter("held_out").join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"      # the smaller tables have some 30 toxic documents
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op7_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r.score for r in rows if r.toxic == 1]
    clean = [r.score for r in rows if r.toxic == 0]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.9
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def test_no_labels(spark, edge_docs, no_docs):
    none = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, quality int").withColumn("toxic", F.col("quality"))
    assert {r.score for r in quality.quality(edge_docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity(edge_docs, none).collect()} == {0.0}
    out = langid.identify(edge_docs, no_docs)
    assert {(r.lang_pred, r.score) for r in out.collect()} == {("und", 0.0)}
    assert len(set(out.columns)) == len(out.columns)


def test_edges(spark, edge_docs, no_docs):
    docs = spark.createDataFrame(
        [(i, ("fine words here. " if i % 2 else "awful idiot ### ") * 9, "en" if i % 2 else "fr") for i in range(40)],
        "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"),
                         (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    labels = labels.unionByName(labels).unionByName(spark.createDataFrame([(0, 1, 0)], labels.schema))
    n = edge_docs.count()
    for op in (quality.quality, toxicity.toxicity):
        both = edge_docs.select("doc_id", "text", "score").unionByName(docs.select("doc_id", "text", F.lit(0.5).alias("score")))
        out = op(both, labels)
        assert out.count() == n + 40 and out.columns == ["doc_id", "text", "score", "predicted"]
        assert all(0 <= r.score <= 1 for r in out.collect())
        assert op(no_docs, labels).count() == 0
    out = langid.identify(edge_docs, docs).collect()
    assert {r.lang_pred for r in out if not any(c.isalpha() for c in r.text or "")} == {"und"}
    assert {r.lang_pred for r in out if any(c.isalpha() for c in r.text or "")} <= {"en", "fr"}


def test_context_table_does_not_depend_on_partitions(spark, documents):
    a = quality.context_table(documents.repartition(1))
    b = quality.context_table(documents.repartition(7))
    assert (a == b).all() and a[:, 0].sum() > 0
    # each neighbour within reach adds its nonzero entries
    one = quality.context_table(spark.createDataFrame([("aa bb",), ("cc",)], "text string"))
    assert one[:, 0].sum() == 3 and np.abs(one[:, 1:]).sum() <= 2 * quality.NONZERO


def test_pooling_does_not_depend_on_packs(monkeypatch):
    from cadenza.llm import common
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1 << quality.BUCKET_BITS, 4)).astype(np.float32)
    texts = [b"some words " * 50, b"", b"other words, too " * 30]
    whole = quality.pooled(texts, vectors)
    monkeypatch.setattr(common, "PACK_BYTES", 100)
    np.testing.assert_allclose(quality.pooled(texts, vectors), whole)
    monkeypatch.setattr(common, "PIECE_BYTES", 64)      # neighbours over a cut of a long text don't count
    np.testing.assert_allclose(quality.pooled(texts, vectors)[:, :8], whole[:, :8])
    assert (whole[1] == 0).all()


def test_temperature():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 20000)
    y = (rng.random(20000) < learn.sigmoid(z)).astype(int)
    assert learn.fit_temperature(3 * z, y, np.ones(20000)) == pytest.approx(3, rel=0.1)


@pytest.mark.parametrize("learned", ["abracadabra", "aaaa bb a", "the cat the hat"])
def test_cross_parsing(learned):
    table = langid.Table(langid.joined(langid._letters(learned)))
    for text in ("abra", "cadabraabra", "zzz", "a cat", "the the hat bb", ""):
        assert parsed(table, text) == plain_phrases(text, learned)


def plain_phrases(text, learned):
    """Greedy longest matches; a character that isn't there ends a phrase."""
    phrases, phrase = 1, ""
    for c in text:
        if phrase + c in learned:
            phrase += c
        else:
            phrases, phrase = phrases + 1, c if c in learned else ""
    return phrases if text else 0


def parsed(table, *texts):
    codes = [langid.joined(langid._letters(t)) for t in texts]
    out = table.phrases(np.concatenate(codes), np.array([len(c) for c in codes], np.int64))
    return int(out[0]) if len(texts) == 1 else out.tolist()


@pytest.mark.parametrize("wide", [0, 256])
@pytest.mark.parametrize("block", [1, 7, 512])
def test_long_texts_are_parsed_whole(monkeypatch, wide, block):
    """Over 5,000 characters, as arrays and as sorted keys, in blocks of any size."""
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeé漢字仮"), rng.integers(1, 7))) for _ in range(60)]
    learned = " ".join(rng.choice(words, 700))
    table = langid.Table(langid.joined(langid._letters(learned)), wide)
    texts = [" ".join(rng.choice(words, 1500)), learned + " ", "", "a" * 3000, "zq" * 40, " ".join(rng.choice(words, 3)), learned[5:900]]
    assert len(texts[0]) > 5000
    assert parsed(table, *texts) == [plain_phrases(t, learned) for t in texts]
    # a stretch of the learned text is one phrase, however many blocks it has
    assert parsed(table, learned[5:1500]) == 1


def test_gradients():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{rng.integers(40)}" for _ in range(n)).encode() for n in (5, 40, 90)] * 4
    y = np.array([0, 1, 1] * 4)
    model = {k: v.copy() for k, v in toxicity.train(texts, y, np.ones(12)).items()}
    for name in ("word", "gram"):        # a vector for some buckets
        model[name] = rng.normal(size=(5, toxicity.WIDTH)).astype(np.float32)
        model[name][0] = 0
        model[name + "_row"] = rng.integers(0, 5, len(model[name + "_row"]))
    words = toxicity.Words(texts[:3])
    rows = np.arange(len(words.first))
    target = (rows % 2).astype(np.float32)
    grads = toxicity.gradients(model, words, rows, target)

    def loss():
        z = toxicity.window_logits(model, words).astype(float)
        return np.mean(np.logaddexp(0, z) - target * z)
    for name, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        keep, out = model[name][at], []
        for step in (0.01, -0.01):
            model[name][at] = keep + step
            out.append(loss())
        model[name][at] = keep
        assert (out[0] - out[1]) / 0.02 == pytest.approx(g[at], rel=0.05, abs=1e-4), name


@pytest.mark.parametrize("n", [1, 31, 32, 33, 56, 57, 300])
def test_windows_cover_every_word(n):
    words = toxicity.Words([b"zz", b" ".join(b"w%d" % i for i in range(n))])
    mine = words.owner == 1
    covered = sorted({int(f) + k for f, s in zip(words.first[mine], words.size[mine]) for k in range(s)})
    assert covered == list(range(1, n + 1))
    firsts = np.sort(words.first[mine])
    assert (np.diff(firsts) < toxicity.WINDOW).all()


def test_languages_whose_first_documents_teach_nothing_are_learned(spark):
    from pyspark.sql import Window
    texts = {"aa": "the cat sat on the mat", "bb": "der hund lief durch den wald"}
    docs = spark.range(400).selectExpr("id AS doc_id", "if(id % 2 = 0, 'aa', 'bb') AS lang").withColumn(
        "n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"))))
    for low, bad in ((0, F.lit(None)), (40, F.lit("")), (60, F.repeat(F.lit("xy "), 7000))):
        docs = docs.withColumn("text", F.when((F.col("n") > low) & (F.col("n") <= 150), bad).otherwise(
            F.col("text") if "text" in docs.columns else F.when(F.col("lang") == "aa", texts["aa"]).otherwise(texts["bb"])))
    got = langid.learned_texts(docs.select("doc_id", "lang", "text"))
    assert set(got) == set(texts) and all(set(got[k].splitlines()) == {t} for k, t in texts.items())


def test_scoring_holds_little_beside_the_texts(monkeypatch):
    import tracemalloc

    import numpy as np

    from cadenza.llm import common, toxicity
    rng = np.random.default_rng(1)
    f32, h, w = np.float32, toxicity.HIDDEN, toxicity.WIDTH
    model = {k: rng.normal(0, 0.3, s).astype(f32) for k, s in {
        "w": (2 * w + 2, 6 * h), "b": 6 * h, "u": (2, h, 3 * h), "att": (2 * h, h), "att_b": h, "att_v": h, "out": 2 * h,
        "out_b": 1, "word": (50, w), "gram": (50, w), "word_odds": 1 << toxicity.WORD_BITS,
        "gram_odds": 1 << toxicity.GRAM_BITS}.items()}
    for name, bits in (("word", toxicity.WORD_BITS), ("gram", toxicity.GRAM_BITS)):
        model[name + "_row"] = rng.integers(0, 50, 1 << bits).astype(np.int32)
    texts = [" ".join(f"word{i}" for i in rng.integers(0, 9999, 300)).encode() for _ in range(900)] + [b"", b"x y" * 20_000]

    def scored(size):
        monkeypatch.setattr(common, "worker_cache", lambda name, store={}: store)
        common.worker_cache("powers").clear()
        monkeypatch.setattr(toxicity, "HASHED_BYTES", size)
        tracemalloc.start()
        z = toxicity.document_logits(model, texts)
        used = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return z, used
    parts, now = scored(toxicity.HASHED_BYTES)
    whole, before = scored(1 << 30)
    assert np.array_equal(parts, whole) and now < 80 << 20 < before
