"""Text functions as native column expressions (no Python UDF).

The character classes reproduce Python's Unicode-aware ``\\s``, ``\\d`` and
``string.punctuation`` so that the cleaning rules give the same result as the
plain-Python rules they stand for, in Java regex (Spark) and in RE2.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from polarity import resources

# ---------------------------------------------------------------------------
# Regular-expression classes.
# Every character that Python's str.isspace() accepts (29 code points):
# \t \n \x0b \x0c \r, \x1c-\x1f, space, \x85, \xa0, \u1680, \u2000-\u200a, \u2028, \u2029, \u202f, \u205f, \u3000.
# Written as an explicit list for RE2 (the SQL oracle) and, equal as a set but
# cheaper to test in Java regex, as Java's white space plus the four
# characters Java leaves out (\x85, \xa0, \u2007, \u202f).
_SPACE_CHARS_LIST = (r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                     r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
_SPACE_CHARS_JAVA = r"\p{javaWhitespace}\x{85}\x{a0}\x{2007}\x{202f}"
SPACE_SQL = f"[{_SPACE_CHARS_LIST}]"
NON_SPACE_SQL = f"[^{_SPACE_CHARS_LIST}]"
SPACE = f"[{_SPACE_CHARS_JAVA}]"
NON_SPACE = f"[^{_SPACE_CHARS_JAVA}]"
# The 32 ASCII punctuation characters: ! to /, : to @, [ to `, { to ~.
PUNCT = r"[!-/:-@\[-`{-~]"
# Decimal digits of every script.
DIGITS = r"\p{Nd}+"
URL_SQL = rf"https?://{NON_SPACE_SQL}+|www\.{NON_SPACE_SQL}+"
EMAIL_SQL = rf"{NON_SPACE_SQL}+@{NON_SPACE_SQL}+"
URL = rf"https?://{NON_SPACE}+|www\.{NON_SPACE}+"
# Same matches as ``\S+@\S+`` in linear time for a backtracking engine: a
# match can only begin where a run of non-space characters begins (and then
# spans the run), so attempts inside a run are cut by the look-behind.
EMAIL = rf"(?<!{NON_SPACE}){NON_SPACE}+@{NON_SPACE}+"
# Character tables for ``translate`` (one pass, no regex): the punctuation
# above, and, built by rule from Python's Unicode data, every white-space
# character (str.isspace) and every decimal digit (category Nd), the sets that
# Python's ``\s`` and ``\d`` match.
PUNCT_CHARS = string.punctuation
SPACE_CHARS = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and chr(c).isspace())
DIGIT_CHARS = "".join(chr(c) for c in range(0x110000)
                      if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) == "Nd")
# scheme (optional) followed by '//' and the network location up to / ? #
NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
# ---------------------------------------------------------------------------


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_whitespace(c: str | Column) -> Column:
    """Runs of white space to one space, trimmed; null to ''."""
    t = F.translate(F.coalesce(_col(c), F.lit("")), SPACE_CHARS, " " * len(SPACE_CHARS))
    return F.trim(F.regexp_replace(t, " +", " "))


def url_domain(c: str | Column) -> Column:
    """Network location of a URL (keeps port and user); null or none to ''."""
    return F.coalesce(F.regexp_extract(_col(c), NETLOC, 1), F.lit(""))


def compose_text(title: str | Column, description: str | Column) -> Column:
    """``title + '. ' + description``; a null title gives null."""
    return F.concat(_col(title), F.lit(". "), F.coalesce(_col(description), F.lit("")))


def date_or(ts: str | Column, as_of: str | None = None) -> Column:
    """T4: calendar date, in UTC, of a timestamp string (ISO 8601), else ``as_of``."""
    d = F.date_from_unix_date(F.floor(F.unix_seconds(utc_timestamp(ts)) / 86400).cast("int"))
    return d if as_of is None else F.coalesce(d, F.lit(as_of).cast("date"))


def utc_timestamp(ts: str | Column) -> Column:
    """Instant of a timestamp string; one without a zone is taken as UTC,
    whatever the session's time zone is. Null if it can't be read."""
    c = F.trim(_col(ts))
    zoned = c.rlike(r"(?i)([zZ]|[+-]\d{1,2}(:?\d{2})?|\s(utc|gmt)([+-]\d{1,2}(:\d{2})?)?|[a-z]+/[a-z_]+)$") & c.contains(":")
    dated = F.when(c.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?$"), F.concat(c, F.lit(" 00:00:00"))).otherwise(c)
    return F.try_to_timestamp(F.when(F.coalesce(zoned, F.lit(False)), c).otherwise(F.concat(dated, F.lit(" UTC"))))


def basic_clean(c: str | Column) -> Column:
    """Lower case, drop URLs, drop e-mail addresses, punctuation to space,
    drop digits, collapse white space, trim. Null gives ''."""
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    # the URL and e-mail rules only run on texts that can hold a match
    t = F.when(t.contains("http") | t.contains("www."), F.regexp_replace(t, URL, "")).otherwise(t)
    t = F.when(t.contains("@"), F.regexp_replace(t, EMAIL, "")).otherwise(t)
    # one pass: punctuation and white space to a space, digits deleted (the
    # characters of ``matching`` beyond ``replace`` are removed); then runs
    # of spaces collapse. Same result as punctuation -> space, digits -> '',
    # white-space runs -> one space.
    t = F.translate(t, PUNCT_CHARS + SPACE_CHARS + DIGIT_CHARS, " " * (len(PUNCT_CHARS) + len(SPACE_CHARS)))
    t = F.regexp_replace(t, " +", " ")
    return F.trim(t)


def tokenize(c: str | Column) -> Column:
    """T7 on cleaned text (single spaces, trimmed): split on the spaces; the
    empty text gives no token."""
    return F.array_remove(F.split(F.coalesce(_col(c), F.lit("")), " "), "")


def tokenize_raw(c: str | Column) -> Column:
    """T7 on uncleaned text: punctuation becomes its own token."""
    t = F.regexp_replace(F.coalesce(_col(c), F.lit("")), "(" + PUNCT + ")", " $1 ")
    t = F.trim(F.regexp_replace(t, SPACE + "+", " "))
    return tokenize(t)



def stopword_filter(tokens: str | Column, stop_words: Iterable[str] | None = None,
                    extra_stopwords: Iterable[str] = ()) -> Column:
    """T8 on a token array. A given list replaces the default; extras are added.

    The membership test is an ``IN`` list, which the optimizer turns into a
    hash-set lookup (``InSet``); repeated tokens are kept (not a set difference).
    """
    words = list(resources.english_stopwords() if stop_words is None else stop_words)
    words += [w for w in extra_stopwords if w not in words]
    if not words:
        return _col(tokens)
    return F.filter(_col(tokens), lambda t: ~t.isin(words))


def remove_stopwords(c: str | Column, stop_words: Iterable[str] | None = None,
                     extra_stopwords: Iterable[str] = (), cleaned: bool = True) -> Column:
    """T8 on text: tokens without stop words joined by one space."""
    toks = tokenize(c) if cleaned else tokenize_raw(c)
    return F.array_join(stopword_filter(toks, stop_words, extra_stopwords), " ")


def preprocess(c: str | Column, clean: bool = True, remove_stops: bool = True,
               custom_stopwords: Sequence[str] | None = None,
               extra_stopwords: Iterable[str] = (), lemmas: dict[str, str] | None = None) -> Column:
    """Clean, drop stop words, and, with a dictionary ``lemmas`` (token to
    lemma), put each token's lemma for it. The library has no dictionary of its
    own, so the last step is off unless one is given."""
    t = basic_clean(c) if clean else F.coalesce(_col(c), F.lit(""))
    if remove_stops:
        t = remove_stopwords(t, custom_stopwords, extra_stopwords, cleaned=clean)
    if lemmas:
        from polarity.operators.lemma import lemmas_of
        t = F.array_join(lemmas_of(tokenize(t), lemmas), " ")
    return t


def truncate_tokens(tokens: str | Column, n: int) -> Column:
    """First ``n`` tokens."""
    return F.slice(_col(tokens), 1, n)


def encode_label(c: str | Column, labels: Sequence[str]) -> Column:
    """Label name to class id (position in ``labels``); unknown to null."""
    m = F.create_map(*[x for i, name in enumerate(labels) for x in (F.lit(name), F.lit(i))])
    return F.try_element_at(m, _col(c))


def decode_label(c: str | Column, labels: Sequence[str]) -> Column:
    """Class id to label name; unknown to null."""
    m = F.create_map(*[x for i, name in enumerate(labels) for x in (F.lit(i), F.lit(name))])
    return F.try_element_at(m, _col(c).cast("int"))


def preview(c: str | Column, n: int = 100) -> Column:
    """First ``n`` characters followed by '...'."""
    return F.concat(F.substring(_col(c), 1, n), F.lit("..."))
