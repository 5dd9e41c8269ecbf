"""Text functions as Column expressions: tokens, aliases, normal forms, hashes, paging, snippets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Token characters are ASCII letters, digits and composed Hangul.
WORD = "[0-9A-Za-z가-힣]+"
# A base and a script with a word in it. No class that negates Hangul: Java takes over ten times as long for one.
BASE = WORD + r"+[\t\n\f\r ]*+"
BRACE = BASE + r"[_^]\{(?>[^}]*?[0-9A-Za-z가-힣])[^}]*+\}"
TAGGED = "(?i)(" + WORD + r"+)[\t\n\f\r ]*+<(?:sub|sup)>((?>[^<]*?[0-9A-Za-z가-힣])[^<]*+)</(?:sub|sup)>"
#: ASCII characters that are in no token.
BESIDE = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
SPACE = r"[\t\n\f\r ]+"
#: What Unicode counts as white space, for trims that must go beyond blanks.
ANY_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DIGEST = "^[0-9a-f]{64}$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: Column | str) -> Column:
    """Trim all Unicode white space (Spark's own trims blanks only)."""
    return F.regexp_replace(_c(x), f"^{ANY_SPACE}+|{ANY_SPACE}+$", "")


def blank(x: Column | str) -> Column:
    return F.coalesce(trim(x), F.lit("")) == ""


def first_non_empty(*xs: Column | str) -> Column:
    """The first value that is not blank, trimmed; else empty."""
    return F.coalesce(*[F.when(~blank(x), trim(x)) for x in xs], F.lit(""))


def _all_words(x: Column) -> Column:
    return F.array_join(F.regexp_extract_all(x, F.lit(f"({WORD})"), F.lit(1)), "")


def _only_words(found: Column) -> Column:
    """What is in no token goes from each string: ASCII by a table, all else by a pattern, which runs only if there is any in one of them."""
    plain = F.transform(found, lambda m: F.translate(m, BESIDE, ""))
    rest = lambda ms: F.when(F.array_join(ms, "").rlike(f"^{WORD[:-1]}*+$"), ms).otherwise(F.transform(ms, _all_words))
    return F.element_at(F.transform(F.array(plain), rest), 1)  # bound by a lambda, so that it is worked out once


def script_aliases(x: Column | str) -> Column:
    """What sub- and superscripts spell out: S_{0} and S<sub>0</sub> give S0; brace forms come first."""
    x = F.coalesce(_c(x), F.lit(""))
    brace, base, script = (F.regexp_extract_all(x, F.lit(p), F.lit(i)) for p, i in ((BRACE, 0), (TAGGED, 1), (TAGGED, 2)))
    return F.concat(_only_words(brace), _only_words(F.zip_with(base, script, lambda b, s: F.concat(b, s))))


def _lower(x: Column) -> Column:
    return F.lower(F.replace(x, F.lit("İ"), F.lit("i")))


def is_hangul(x: Column) -> Column:
    return x.rlike("^[가-힣]+$")


def _grams(x: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))
    return F.when(F.length(x) >= n, grams).otherwise(none)


def index_tokens(x: Column | str) -> Column:
    """Tokens with repeats: words, and for all-Hangul words every 2-gram, then every 3-gram, even if equal to the word."""
    x = F.coalesce(_c(x), F.lit(""))
    marked = F.when(x.rlike(r"[_^]\{|(?i)<su[bp]>"), F.concat_ws(" ", x, F.array_join(script_aliases(x), " "))).otherwise(x)
    words = F.regexp_extract_all(_lower(marked), F.lit(f"({WORD})"), F.lit(1))
    spread = F.flatten(F.transform(words, lambda w: F.when(is_hangul(w), F.concat(F.array(w), _grams(w, 2), _grams(w, 3))).otherwise(F.array(w))))
    kept = F.filter(spread, lambda t: (F.length(t) > 1) | t.rlike("^[0-9A-Za-z]$"))
    return F.when(x.rlike("[가-힣]"), kept).otherwise(words)  # without Hangul every word is a token as it is


def tokens(x: Column | str) -> Column:
    """Distinct tokens in order of first occurrence."""
    return F.array_distinct(index_tokens(x))


def lexicon_key(x: Column | str) -> Column:
    """Lower-cased letters and decimal digits only."""
    return F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{Nd}]", "")


def is_short_acronym(x: Column | str) -> Column:
    return F.trim(_c(x)).rlike("^[A-Z]{2,4}$")


def nfc(x: Column | str) -> Column:
    """Unicode NFC, which Spark has no function for. Made on use, for a module has no session when it is imported."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata

        for values in batches:
            yield values.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))

    return run(_c(x))


def newlines(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), "\r\n?", "\n")


def canonical(x: Column | str, normal: bool = True) -> Column:
    """Line feeds, NFC, trimmed. ``normal=False`` skips NFC where text is known to be normal."""
    x = newlines(x)
    return trim(nfc(x) if normal else x)


def text_hash(x: Column | str, normal: bool = True) -> Column:
    return F.sha2(canonical(x, normal), 256)


def is_digest(x: Column | str) -> Column:
    return trim(x).rlike(DIGEST)


def slug(x: Column | str) -> Column:
    """Lower-case, separators to dashes, other characters dropped; never empty."""
    low = F.regexp_replace(trim(F.lower(_c(x))), r"[/\\ _.:]", "-")
    kept = F.regexp_replace(low, "[^0-9a-z가-힣-]", "")
    out = F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", "untitled").otherwise(out)


def _language(x: Column | str) -> Column:
    return F.lower(trim(F.replace(F.coalesce(_c(x), F.lit("")), F.lit("_"), F.lit("-"))))


# Spellings of the two languages.
KOREAN = ("ko", "kor", "korean", "ko-kr")
ENGLISH = ("en", "eng", "english", "en-us", "en-gb")


def stored_language(x: Column | str) -> Column:
    """Storage side: everything that is not English is Korean."""
    return F.when(_language(x).isin(*ENGLISH), "en").otherwise("ko")


def filter_language(x: Column | str) -> Column:
    """Filter side: null where a language is not known, so that it matches nothing."""
    return F.when(_language(x).isin(*ENGLISH), "en").when(_language(x).isin(*KOREAN), "ko")


def uri(kind: Column | str, ident: Column | str, scheme: str = "corpus") -> Column:
    return F.concat(F.lit(f"{scheme}://"), F.when(_c(kind) == "notice", "notices/").when(_c(kind) == "attachment", "attachments/").otherwise("rules/"), _c(ident))


def page(x: Column | str, offset: int, size: int) -> Column:
    """Struct of a text's code points from ``offset``: content, total, truncated, next_offset (0: none)."""
    x = F.coalesce(_c(x), F.lit(""))
    total, end = F.length(x), F.least(F.lit(offset + size), F.length(x))
    more = (end < total) & (F.lit(offset) < total)
    return F.struct(F.substring(x, offset + 1, size).alias("content"), total.alias("total"), more.alias("truncated"), F.when(more, end).otherwise(0).alias("next_offset"))


def limited(x: Column | str, size: int) -> Column:
    x = _c(x)
    return x if size <= 0 else F.when(F.length(x) > size, F.concat(F.substring(x, 1, size), F.lit("\n\n[truncated]"))).otherwise(x)


def windows(x: Column | str, size: int) -> Column:
    """Array of consecutive windows of ``size`` code points, each trimmed."""
    x = F.coalesce(_c(x), F.lit(""))
    count = F.greatest(F.ceil(F.length(x) / size), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: trim(F.substring(x, i * size + 1, F.lit(size))))
    return F.when(F.length(x) > 0, cut).otherwise(F.array().cast("array<string>"))


def snippet(x: Column | str, query_tokens: Column, size: int = 300, lead: int = 40) -> Column:
    """``size`` code points from ``lead`` before the first query token found; cut ends are marked by dots."""
    text = F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), SPACE, " "))
    found = F.filter(F.transform(query_tokens, lambda t: F.instr(F.lower(text), t)), lambda i: i > 0)
    at = F.greatest(F.coalesce(F.get(found, F.lit(0)), F.lit(1)) - 1, F.lit(0))
    start = F.when(at > lead, at - lead).otherwise(0)
    body = F.substring(text, start + 1, F.lit(size))
    return F.when(text == "", "").otherwise(F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(start + size < F.length(text), "...").otherwise("")))


def is_iso_date(x: Column | str) -> Column:
    """A real day in YYYY-MM-DD; empty passes."""
    x = F.coalesce(_c(x), F.lit(""))
    return (x == "") | F.coalesce(x.rlike(r"^\d{4}-\d\d-\d\d$") & F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def set_digest(ids: Column) -> Column:
    """SHA-256 of the sorted JSON list of some ids: the same for the same set, in whatever order."""
    return F.sha2(F.to_json(F.array_sort(F.collect_list(ids))), 256)
