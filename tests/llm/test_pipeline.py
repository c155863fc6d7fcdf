import hashlib

import pytest

import corpus_pipeline
from cadenza.llm import bpe, pii, simhash



@pytest.fixture(scope="module")
def steps(spark, sf_small, tmp_path_factory):
    """Input and output of every stage on the smallest tables."""
    docs, out = spark.read.parquet(f"{sf_small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_small).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out))


def test_stages_keep_the_columns(steps):
    for name, (before, after) in list(steps.items())[:-1]:
        assert after.columns == before.columns, name


def test_toxicity_only_rejects(steps):
    before, after = steps["toxicity"]
    assert after.exceptAll(before).count() == 0 and 0 < after.count() <= before.count()


def test_simhash_keeps_the_smallest_of_each_group(steps):
    before, after = steps["simhash"]
    want = {r.component_id for r in simhash.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)


def test_pii_changes_only_entities(steps):
    before, after = ({r.doc_id: r for r in df.collect()} for df in steps["pii"])
    assert set(before) == set(after)
    for i, r in before.items():
        spans = pii.find(r.text)
        assert (after[i].text == r.text) == (not spans)
        assert after[i].n_chars == len(after[i].text)
        assert not any(r.text[s:e] in after[i].text for s, e, *_ in spans)


def test_mixing_selects_documents(steps):
    before, after = steps["mixing"]
    texts = {r.doc_id: r.text for r in before.collect()}
    cut = [r for r in after.collect() if r.text != texts[r.doc_id]]
    assert all(texts[r.doc_id].split()[:len(r.text.split())] == r.text.split() for r in cut)

    def tokens(df):
        out = {}
        for r in df.collect():
            lang = "en" if r.lang == "en" else "other"
            out[lang] = out.get(lang, 0) + len(r.text.split())
        return out
    had, has = tokens(before), tokens(after)
    # the target: other languages a quarter more weight, a budget of 5/4
    total = 1.25 * sum(had.values())
    weight = had["en"] + 1.25 * had["other"]
    assert abs(has["en"] - total * had["en"] / weight) < 100
    assert abs(has["other"] - total * 1.25 * had["other"] / weight) < 100


def test_bpe_decodes_to_the_text(steps):
    before, after = steps["bpe"]
    codec = bpe.load_codec(bpe._default_path())
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in before.collect())
    rows = after.collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in rows) == want
    assert all(hashlib.sha256(codec.decode(r.ids)).hexdigest() == r.decoded_sha256 and len(r.ids) == r.n_tokens
               for r in rows)


def test_run(spark, sf_small, steps):
    out = corpus_pipeline.run(spark, sf_small)
    assert out.columns == steps["bpe"][1].columns
    assert out.select("doc_id", "ids_sha256").exceptAll(steps["bpe"][1].select("doc_id", "ids_sha256")).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_edges(spark, sf_small, edge_docs, stage):
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars", "score", "id", "kept")
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, sf_small)
    out.collect()
    assert name == "bpe" or out.columns == docs.columns
    assert run(spark, docs.limit(0), sf_small).count() == 0


@pytest.mark.parametrize("hot", ["src0", "src7", None])
def test_mixing_keeps_every_document(spark, hot):
    # 20 sources in three languages; the hot one has ten times the documents
    docs = spark.range(20 * 3 * 12).selectExpr(
        "id AS doc_id", "concat('src', id % 20) AS source", "element_at(array('en', 'de', 'xx'), int(id div 20 % 3) + 1) AS lang",
        "array_join(transform(sequence(0, int(id % 7)), i -> concat('w', i)), ' ') AS text")
    if hot:
        more = docs.filter(docs.source == hot)
        docs = docs.unionByName(more.crossJoin(spark.range(1, 10)
                                             .withColumnRenamed("id", "n")).selectExpr(
            "n * 1000 + doc_id AS doc_id", "source", "lang", "text"))
    docs = docs.selectExpr("*", "length(text) AS n_chars")
    out = corpus_pipeline.mix_sources(spark, docs, "")
    # every document at least once and whole; none of the other languages less than before
    whole = out.select(*docs.columns).intersect(docs.withColumn("n_chars", docs.n_chars.cast("long")))
    assert whole.count() == docs.count() and out.count() > docs.count()


def test_mixing_keeps_every_document_of_the_stage(steps):
    before, after = steps["mixing"]
    with_words = {r.doc_id for r in before.collect() if (r.text or "").split()}
    assert {r.doc_id for r in after.collect()} == with_words


@pytest.mark.parametrize("rows", [
    [("src0", "de", "a b c d e f g h"), ("src5", "fr", "w"), ("src5", "en", "one")],
    [("src0", "en", "word"), ("src0", "de", "wort")],
    [("src1", "en", "one two three"), ("src2", "en", "four"), ("src1", "de", "eins"), ("src1", "es", "uno dos")]])
def test_mixing_keeps_every_document_of_small_leaves(spark, rows):
    # shares rounded down on their way to the leaf left it less than it has
    docs = spark.createDataFrame([(i, *r, len(r[2])) for i, r in enumerate(rows)],
                                 "doc_id long, source string, lang string, text string, n_chars long")
    out = [tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, "").select(*docs.columns).collect()]
    assert {tuple(r) for r in docs.collect()} <= set(out)
    # and no more than the budget
    assert sum(len(r[3].split()) for r in out) <= sum(len(r[2].split()) for r in rows) * 5 // 4
