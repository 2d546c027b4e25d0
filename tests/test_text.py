"""Text functions against hand-checked values and plain Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from cartoweave.functions import text as X

SAMPLES = ["I am Pat!", "", None, "hahahahahaha okkkkkay", "RT @you see #this http://x.y/z 12 $3.50 -4 end", "Ünïcödé çafé   tab\tand\nline", "&lt;3 &amp; 'quote' \"two\"", "0a0b", "éééééé ñandú", "x" * 5000]


def values(spark, column, samples=SAMPLES):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_trigrams_of_the_documented_sentence(spark):
    # The documented sentence and its trigrams.
    one = ["I am Pat!"]
    assert values(spark, X.trigrams("s", "word_aware"), one) == [["<I>", "<am", "am>", "<Pa", "Pat", "at>"]]
    assert values(spark, X.trigrams("s", "word_aware_lc"), one) == [["<i>", "<am", "am>", "<pa", "pat", "at>"]]
    assert values(spark, X.trigrams("s", "lowercase"), one) == [[" i ", "i a", " am", "am ", "m p", " pa", "pat", "at!", "t! "]]
    assert values(spark, X.trigrams("s", "lowercase_depunctuated"), one) == [[" i ", "i a", " am", "am ", "m p", " pa", "pat", "at "]]


def test_trigrams_of_own_sentences(spark):
    two = ["Go, Ed: up!", "@you a-b #no http://x.y ok 12"]
    assert values(spark, X.trigrams("s", "word_aware"), two) == [["<Go", "Go>", "<Ed", "Ed>", "<up", "up>"], ["<a-", "a-b", "-b>", "<ok", "ok>"]]
    assert values(spark, X.trigrams("s", "word_aware_lc"), two) == [["<go", "go>", "<ed", "ed>", "<up", "up>"], ["<a-", "a-b", "-b>", "<ok", "ok>"]]
    assert values(spark, X.trigrams("s", "lowercase"), two)[1] == [" a-", "a-b", "-b ", "b o", " ok", "ok "]
    assert values(spark, X.trigrams("s", "lowercase_depunctuated"), two)[0] == [" go", "go ", "o e", " ed", "ed ", "d u", " up", "up "]


REPEAT = re.compile(rb"(..??)\1\1\1+")
NUMBER = re.compile(rb"^-?\$?\d+\.?\d*$")


def lower_bytes(s: bytes) -> bytes:
    return s.lower()


def plain_lc(s: str) -> bytes:
    words = [w for w in s.encode().lower().split() if not w.startswith(b"http") and w[:1] not in (b"#", b"@") and w != b"rt" and not NUMBER.match(w)]
    joined = b" ".join(words).replace(b"&lt;", b"<").replace(b"&gt;", b">")
    return REPEAT.sub(rb"\1\1\1", joined)


def test_sanitise_against_python(spark):
    got = values(spark, X.sanitise_string_lc("s"))
    assert got == [None if s is None else plain_lc(s).decode("latin-1") for s in SAMPLES]


def test_collapse_against_python(spark):
    got = values(spark, X.collapse_repeats(X.byte_view("s")))
    assert got == [None if s is None else REPEAT.sub(rb"\1\1\1", s.encode()).decode("latin-1") for s in SAMPLES]


@pytest.mark.parametrize("mode", list(X.MODES))
def test_trigrams_are_linear_and_null_safe(spark, mode):
    got = values(spark, X.trigrams("s", mode), [None, "", "a", "word " * 20000])
    assert got[0] in (None, []) and got[1] == []
    assert len(got[3]) in (80000, 99999)


def test_domains(spark):
    urls = ["http://www.foo.bar.com/asdf", "http://WWW.Site.org", "no url", None, "http://one", "mailto:x@y.z"]
    assert values(spark, X.get_domains("s"), urls) == [["http://bar.com", "http://foo.bar.com"], ["http://site.org"], [], [], [], []]
    assert values(spark, X.get_domain("s"), urls)[:3] == ["http://foo.bar.com", "http://site.org", None]


def test_counted_words_split_at_zero(spark):
    assert values(spark, X.counted_words("s"), ["abc0def Ab #tag!", None, ""]) == [["abc", "def", "#tag"], None, []]


def test_raw_tweet_tokens(spark):
    from cartoweave.sources.readers import ENTITIES

    rows = [("Hello @Me http://t.co/1", '{"user_mentions":[{"screen_name":"Me"}],"hashtags":[{"text":"Tag"}],"urls":[{"url":"http://t.co/1","expanded_url":"http://www.a.b.org/x"}]}'), ("plain", None), (None, "{}")]
    df = spark.createDataFrame(rows, "text string, entities string")
    got = [r[0] for r in df.select(X.raw_tweet_tokens("text", F.from_json("entities", ENTITIES))).collect()]
    assert got == [["@me", "#tag", "http://t.co/1", "http://www.a.b.org/x", "http://b.org", "http://a.b.org", "http://t.co", "hello"], ["plain"], []]


def test_normalise_and_file_names(spark):
    assert values(spark, X.normalise_token("s"), ["tea", "Tea", "", None]) == ["Tea", "Tea", "", None]
    assert values(spark, X.clean_filename("s"), ["a1-b_Ç"]) == ["ab"]
