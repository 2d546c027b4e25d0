"""Text functions as column expressions (F01-F15, F25, F27): no Python runs per row.

Scores and trigrams are defined over UTF-8 bytes: ``byte_view`` turns a string into one character per byte, so all string
functions then work on bytes. Null gives null everywhere; the empty text gives the empty text or an empty array.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and marks that define the results.
BLANKS = r"[ \t\n\x0B\f\r]+"
NUMBER = r"^-?\$?\d+\.?\d*\z"
PUNCTUATION = r"[!@#$%^&*_+|}{;\":?><,./ ]+"
REPEATED = r"(?d)(..??)\1\1\1+"
NOT_WORD = r"[^\w]+"
NOT_COUNTED = r"[^a-z@#_1-9A-Z]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often a lambda inside uses it."""
    return F.transform(F.array(value), body)[0]


def byte_view(c: Column | str) -> Column:
    """One character per UTF-8 byte."""
    return F.decode(F.encode(_col(c), "UTF-8"), "ISO-8859-1")


def from_bytes(c: Column | str) -> Column:
    """The text of a byte view."""
    return F.decode(F.encode(_col(c), "ISO-8859-1"), "UTF-8")


def byte_hex(c: Column | str) -> Column:
    """The bytes of a byte view in hexadecimal."""
    return F.hex(F.encode(_col(c), "ISO-8859-1"))


def ascii_lower(c: Column | str) -> Column:
    """Lower case of the letters A-Z only, as for byte strings."""
    return F.translate(_col(c), string.ascii_uppercase, string.ascii_lowercase)


def blank_words(c: Column | str) -> Column:
    """The blank-separated words."""
    return F.filter(F.split(_col(c), BLANKS), lambda x: x != "")


def host(url: Column | str) -> Column:
    """Lower-case host of a URL without labels equal to 'www', as an array of labels; null without a host."""
    name = F.lower(F.try_parse_url(_col(url), F.lit("HOST")))
    labels = F.filter(F.split(name, r"\."), lambda x: x != "www")
    return F.when(F.length(name) > 0, labels)


def get_domain(url: Column | str) -> Column:
    """'http://' and the host without 'www' labels; null without a host."""
    return F.concat(F.lit("http://"), F.array_join(host(url), "."))


def get_domains(url: Column | str) -> Column:
    """the suffixes of at least two labels of the host, shortest first; empty without a host."""

    def suffixes(labels: Column) -> Column:
        n = F.size(labels)
        made = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.concat(F.lit("http://"), F.array_join(F.slice(labels, -i, i), ".")))
        return F.when(n >= 2, made).otherwise(F.array().cast("array<string>"))

    return let(host(url), suffixes)


def collapse_repeats(c: Column | str) -> Column:
    """four or more repetitions of one or two characters become three ('hahahahaha' to 'hahaha')."""
    return F.regexp_replace(_col(c), REPEATED, "$1$1$1")


def _plain_word(x: Column) -> Column:
    return ~x.startswith("http") & ~F.substring(x, 1, 1).isin("#", "@")


def strip_sanitize_lc(c: Column | str) -> Column:
    """marks unescaped, quotes dropped, repeats collapsed, lower case, without links, tags and mentions (byte view)."""
    s = F.replace(F.replace(F.replace(byte_view(c), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    s = collapse_repeats(F.translate(s, "'\"", ""))
    return F.array_join(F.filter(blank_words(ascii_lower(s)), _plain_word), " ")


def sanitise_string(c: Column | str) -> Column:
    """words without links, tags, mentions, 'RT' and numbers; case kept (byte view)."""
    return F.array_join(F.filter(blank_words(byte_view(c)), lambda x: _plain_word(x) & (x != "RT") & ~x.rlike(NUMBER)), " ")


def sanitise_string_lc(c: Column | str) -> Column:
    """as ``sanitise_string`` in lower case; then &lt; and &gt; unescaped and repeats collapsed (byte view)."""
    s = F.array_join(F.filter(blank_words(ascii_lower(byte_view(c))), lambda x: _plain_word(x) & (x != "rt") & ~x.rlike(NUMBER)), " ")
    return collapse_repeats(F.replace(F.replace(s, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")))


def _trigrams(padded: Column) -> Column:
    """Every run of three characters; the characters are cut up once, so the work is linear in the text."""
    three = lambda a: F.when(F.size(a) > 2, F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 3, F.lit(0))), lambda i: F.concat(a[i], a[i + 1], a[i + 2]))).otherwise(F.array().cast("array<string>"))
    return let(F.filter(F.split(padded, ""), lambda x: x != ""), three)


def _joined_trigrams(s: Column) -> Column:
    return _trigrams(F.when(F.length(s) > 0, F.concat(F.lit(" "), s, F.lit(" "))).when(s.isNotNull(), ""))


def _word_trigrams(s: Column) -> Column:
    words = F.filter(F.split(s, PUNCTUATION), lambda x: x != "")
    return F.flatten(F.transform(words, lambda w: _trigrams(F.concat(F.lit("<"), w, F.lit(">")))))


def _depunctuated(s: Column) -> Column:
    return F.array_join(F.filter(F.split(s, PUNCTUATION), lambda x: x != ""), " ")


#: The trigram modes by name (F06-F09); each gives the byte trigrams of a text, their number is the mode's length.
MODES = {
    "lowercase": lambda c: _joined_trigrams(sanitise_string_lc(c)),
    "lowercase_depunctuated": lambda c: _joined_trigrams(_depunctuated(sanitise_string_lc(c))),
    "word_aware": lambda c: _word_trigrams(sanitise_string(c)),
    "word_aware_lc": lambda c: _word_trigrams(sanitise_string_lc(c)),
}


def trigrams(c: Column | str, mode: str = "word_aware_lc") -> Column:
    """The byte trigrams of a text in one of the four modes."""
    return MODES[mode](c)


def simple_words(c: Column | str) -> Column:
    """runs of ASCII word characters."""
    return F.filter(F.split(_col(c), NOT_WORD), lambda x: x != "")


def user_key(name: Column | str) -> Column:
    """'@' and the lower-case name."""
    return F.concat(F.lit("@"), F.lower(_col(name)))


def counted_words(c: Column | str) -> Column:
    """lower-case words of more than two characters; the digit 0 separates words as every mark does."""
    return F.filter(F.split(F.lower(F.regexp_replace(_col(c), NOT_COUNTED, " ")), " "), lambda x: F.length(x) > 2)


def token_type(c: Column | str) -> Column:
    """tag, mention or word, by the first character."""
    first = F.substring(_col(c), 1, 1)
    return F.when(first == "#", "tag").when(first == "@", "mention").otherwise("word")


def normalise_token(c: Column | str) -> Column:
    """a token all in lower case gets a capital; others stay."""
    c = _col(c)
    return F.when(F.lower(c) == c, F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))).otherwise(c)


def clean_filename(c: Column | str) -> Column:
    """ASCII letters only."""
    return F.regexp_replace(_col(c), "[^a-zA-Z]", "")


def raw_tweet_tokens(text: Column | str, entities: Column) -> Column:
    """tokens of a raw tweet: mentions, tags, links and their domains, then words; absent values give no token.

    ``entities`` is struct<user_mentions:array<struct<screen_name>>, hashtags:array<struct<text>>,
    urls:array<struct<url,expanded_url>>>.
    """
    none = F.array().cast("array<string>")
    some = lambda a: F.coalesce(a, none)
    mentions = F.transform(entities["user_mentions"], lambda m: F.concat(F.lit("@"), F.lower(m["screen_name"])))
    tags = F.transform(entities["hashtags"], lambda t: F.concat(F.lit("#"), F.lower(t["text"])))
    links = F.flatten(F.transform(entities["urls"], lambda u: F.when(F.length(u["expanded_url"]) > 0, F.concat(F.array(u["url"], u["expanded_url"]), get_domains(u["expanded_url"]), F.array(get_domain(u["url"])))).otherwise(F.concat(F.array(u["url"]), get_domains(u["url"])))))
    words = F.transform(simple_words(strip_sanitize_lc(text)), from_bytes)
    return F.filter(F.concat(some(mentions), some(tags), some(links), some(words)), lambda x: x.isNotNull())


def munged_tweet_tokens(text: Column | str, entities: Column) -> Column:
    """tokens of a reshaped tweet whose entities are plain strings: these in lower case, then words."""
    none = F.array().cast("array<string>")
    words = F.transform(simple_words(strip_sanitize_lc(text)), from_bytes)
    return F.filter(F.concat(F.coalesce(F.transform(entities, F.lower), none), F.coalesce(words, none)), lambda x: x.isNotNull())
