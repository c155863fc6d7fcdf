import pytest
from pyspark.sql import functions as F

from cadenza.llm import lines


@pytest.mark.parametrize("line,fails", [
    ("A plain sentence.", False), ("No end", True), ("Home | News | About.", True), ("Login!", True),
    ("Some words, licensed under the MIT License.", True), ("a### b$$$ c%%% d&&&.", True),
    ("WOW!! SO!! MUCH!!", True), ("Really good, isn't it?!", False), ("  «Oui.»  ", False)])
def test_rules(spark, line, fails):
    assert spark.range(1).select(lines.line_fails(F.lit(line)).alias("f")).first().f is fails


def test_repeated_windows(spark):
    def brute(words):
        seen = {}
        for i in range(len(words) - 4):
            seen.setdefault(tuple(words[i:i + 5]), []).append(i)
        return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})
    texts = ["a b c d e a b c d e f", "a a a a a a a", "a b c d", "a b c d e f g a b c d e x f g a b c d e",
             " ".join("abcdefghij"[i * i % 10] for i in range(200))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.n_repeat_words for r in lines.clean_lines(df).collect()}
    assert got == {t: brute(t.split()) for t in texts}


def test_edges(spark, edge_docs, no_docs):
    out = lines.clean_lines(edge_docs)
    assert out.count() == edge_docs.count() and len(set(out.columns)) == len(out.columns)
    assert {r.clean_text for r in out.filter("text is null").collect()} == {""}
    assert lines.clean_lines(no_docs).count() == 0
    text = "A first line of words that stays as it is.\nMenu | Home | Login\nA second line that stays, too."
    clean = lines.clean_lines(spark.createDataFrame([(text,)], "text string")).first()
    assert clean.clean_text.split("\n") == text.split("\n")[::2] and clean.kept
