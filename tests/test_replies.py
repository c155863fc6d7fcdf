"""L4-L6 on the FIXTURES.md edge rows: F1, F2, F3, F3b, F4, F5, W7."""

from pyspark.sql import functions as F

from cadenza.functions.columns import FALLBACK_QUERY, clamp_seeds
from cadenza.operators import responses as R
from cadenza.schemas import LLM_ATTEMPTS


def _attempts(spark, rows):
    return spark.createDataFrame(rows, LLM_ATTEMPTS)


def _typed(spark, texts):
    rows = [(i, "criteria", 1, t) for i, t in enumerate(texts)]
    return {r.request_id: r for r in R.typed_attempts(_attempts(spark, rows)).collect()}


def test_fences_are_stripped(spark):
    texts = ['```json\n{"limit": 5}\n```', '{"limit": 6}', '{"limit": 7, "note": "a ``` b"}',
             '  ```\n{"limit": 8}\n```  ']
    got = _typed(spark, texts)
    assert [got[i].track_limit for i in range(4)] == [5, 6, 7, 8]
    assert all(got[i].ok for i in range(4))


def test_empty_object_takes_defaults(spark):
    r = _typed(spark, ["{}"])[0]
    assert r.ok and r.market == "FR" and r.track_limit == 30 and r.seed_genres == [] and r.year_min is None


def test_invalid_values(spark):
    got = _typed(spark, ['{"limit": null}', '{"limit": 0}', '{"limit": 101}', '{"target_energy": 1.2}',
                         '{"year_min": 2010.5}', '{"seed_genres": ["a", 1]}', '["a"]', "not json",
                         '{"market": null}', '{"seed_genres": ["a", null]}'])
    assert not any(r.ok for r in got.values())
    assert got[0].error == "invalid:limit" and got[6].error == "not_object" and got[7].error == "not_json"


def test_lax_values_are_accepted(spark):
    got = _typed(spark, ['{"year_min": null, "extra": 1}', '{"year_min": "2010"}', '{"year_min": 2010.0}',
                         '{"target_tempo": "120.5", "target_energy": 1}'])
    assert all(r.ok for r in got.values())
    assert (got[0].year_min, got[1].year_min, got[2].year_min) == (None, 2010, 2010)
    assert (got[3].target_tempo, got[3].target_energy) == (120.5, 1.0)


def test_seed_clamp(spark):
    got = _typed(spark, ['{"seed_genres": ["a","b","c"], "seed_artists": ["1","2","3","4"]}',
                         '{"seed_genres": ["a","b","c","d","e","f","g"], "seed_artists": ["1","2"]}'])
    assert (got[0].seed_genres, got[0].seed_artists) == (["a", "b", "c"], ["1", "2"])
    assert (got[1].seed_genres, got[1].seed_artists) == (["a", "b", "c", "d", "e"], [])


def test_seed_clamp_artists_only_variant(spark):
    df = spark.createDataFrame([(list("abcdefg"), ["1", "2"])], "g array<string>, a array<string>")
    g, a = clamp_seeds(F.col("g"), F.col("a"), trim_genres=False)
    r = df.select(g.alias("g"), a.alias("a")).first()
    assert len(r.g) == 7 and r.a == []


def test_first_valid_attempt(spark):
    bad = '{"limit": 0}'
    good = '{"limit": 9}'
    rows = [(1, "criteria", 1, bad), (1, "criteria", 2, bad), (1, "criteria", 3, good),
            (2, "criteria", 1, bad), (2, "criteria", 2, bad), (2, "criteria", 3, "oops"),
            (3, "criteria", 1, bad), (3, "criteria", 2, bad), (3, "criteria", 3, bad), (3, "criteria", 4, good)]
    got = {r.request_id: r for r in R.criteria_table(_attempts(spark, rows)).collect()}
    assert (got[1].status, got[1].attempt, got[1].track_limit) == ("ok", 3, 9)
    assert (got[2].status, got[2].error) == ("failed", "not_json")
    assert got[3].status == "failed"


def test_query_lists(spark):
    rows = [(1, "queries", 1, '["q1","q2","q3","q4","q5","q6","q7","q8"]'), (2, "queries", 1, '["q", 1]'),
            (3, "queries", 1, '{"q": ["a"]}'), (4, "queries", 1, "[]"), (5, "queries", 1, "nope")]
    out = R.query_rows(_attempts(spark, rows)).collect()
    by = {}
    for r in out:
        by.setdefault(r.request_id, []).append((r.query_idx, r.query))
    assert [q for _, q in sorted(by[1])] == ["q1", "q2", "q3", "q4", "q5", "q6"]
    assert by[2] == by[3] == by[5] == [(1, FALLBACK_QUERY)]
    assert 4 not in by


def test_titles(spark):
    rows = [(1, "title", 1, '{"title": "t"}'), (2, "title", 1, "broken {")]
    got = {r.request_id: r for r in R.titles(_attempts(spark, rows)).collect()}
    assert got[1].title == "t" and got[1].description == "Generated playlist"
    assert (got[2].title, got[2].description) == ("My Playlist", "Generated playlist")


def test_integers_beyond_32_and_64_bits(spark):
    got = _typed(spark, ['{"year_min": 3000000000}', '{"year_min": "3000000000"}', '{"limit": 3000000000}',
                         '{"year_min": 99999999999999999999}', '{"year_min": "99999999999999999999"}',
                         '{"year_min": "2010.0"}', '{"year_min": "2010.5"}', '{"limit": "7"}'])
    assert [got[i].ok for i in range(8)] == [True, True, False, False, False, True, False, True]
    assert got[0].year_min == got[1].year_min == 3000000000 and got[5].year_min == 2010
    assert got[2].error == "invalid:limit" and got[3].error == got[4].error == "invalid:year_min"
    assert got[7].track_limit == 7


def test_titles_of_other_types(spark):
    rows = [(i, "title", 1, t) for i, t in enumerate(
        ['{"title": "a", "description": "b"}', '["a"]', '{"title": null}', '{"title": 42, "description": ["x"]}', "no"])]
    got = {r.request_id: (r.title, r.description) for r in R.titles(_attempts(spark, rows)).collect()}
    assert got[0] == ("a", "b") and len({got[i] for i in range(1, 5)}) == 1
