"""Scalar columns: F7 long date, F8 artist join, F9 link fallback, P11
saved flag, P3 first image, F1 fence strip."""

import datetime as dt

from pyspark.sql import functions as F

from cadenza.functions.columns import (TRACK_LINK_BASE, first_image_url, is_saved, join_artists, long_date,
                                       long_date_of, strip_fence, track_link)


def test_long_date_english_and_french(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 5, 13, 0),), (dt.datetime(2023, 8, 31),)], "ts timestamp")
    r = df.select(long_date(F.col("ts")).alias("en"), long_date(F.col("ts"), french=True).alias("fr")).collect()
    assert [(x.en, x.fr) for x in r] == [("5 February 2024", "5 février 2024"), ("31 August 2023", "31 août 2023")]


def test_artist_join_and_link_fallback(spark):
    df = spark.createDataFrame([(["A", "B"], None, 7), (["C"], "", 8), (["D"], "https://x/9", 9)],
                               "a array<string>, url string, id long")
    r = df.select(join_artists(F.col("a"), " · ").alias("j"), track_link(F.col("url"), F.col("id")).alias("l")).collect()
    assert [x.j for x in r] == ["A · B", "C", "D"]
    assert [x.l for x in r] == [TRACK_LINK_BASE + "7", TRACK_LINK_BASE + "8", "https://x/9"]


def test_saved_flag_and_first_image(spark):
    df = spark.createDataFrame([(None, []), ("", [("u1",)]), ("https://p", [("u2",), ("u3",)])],
                               "url string, images array<struct<url:string>>")
    r = df.select(is_saved(F.col("url")).alias("s"), first_image_url(F.col("images")).alias("i")).collect()
    assert [(x.s, x.i) for x in r] == [(False, None), (False, "u1"), (True, "u2")]


def test_fence_strip_only_when_fenced(spark):
    texts = ["```json\n{\"a\": 1}\n```", "  ```\n[1]\n```\n", "{\"s\": \"```x```\"}", "text ```json"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s for r in df.select(strip_fence(F.col("t")).alias("s")).collect()]
    assert got == ['{"a": 1}', "[1]", '{"s": "```x```"}', "text ```json"]


def test_long_date_of_a_text(spark):
    rows = ["2026-03-05T14:23:00", "2026-03-05", "soon", "2026", "2026-13-05", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "d string").coalesce(1)
    got = [tuple(r) for r in df.select(long_date_of(F.col("d")), long_date_of(F.col("d"), french=True)).collect()]
    assert got == [("5 March 2026", "5 mars 2026")] * 2 + [(r, r) for r in rows[2:]]
