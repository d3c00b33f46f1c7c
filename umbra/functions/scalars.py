"""Scalar column functions of the detectors and their neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .tlds import ROOT_ZONE

# How secret keys end.
DOTENV_ENDS = ("KEY", "SECRET", "TOKEN", "PASSWORD", "PASSWD", "PWD", "CREDENTIAL", "CREDENTIALS", "AUTH", "DSN", "CONNECTION_STRING")
FIELD_ENDS = ("password", "passwd", "secret", "token", "apikey", "accesskey", "secretkey", "privatekey", "credential", "credentials", "connectionstring")
FLAG_WORDS = ("true", "false", "yes", "no", "null", "0", "1")


def shannon(value: Column) -> Column:
    """Bits of entropy a character; characters in ascending order, so that equal texts sum equally."""
    chars = F.array_sort(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")))
    n = F.length(value).cast("double")
    parts = F.transform(chars, lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(0.0), lambda h, p: h - p * F.log2(p)))


def wordish(value: Column) -> Column:
    """The share of a text in runs of three and more lower-case letters."""
    runs = F.regexp_extract_all(value, F.lit("[a-z]{3,}"), F.lit(0))
    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(F.aggregate(runs, F.lit(0), lambda n, r: n + F.length(r)) / F.length(value))


def high_entropy(value: Column) -> Column:
    """Whether a long run looks random: mixed classes, no plain word as a path segment, high entropy, few word-like runs."""
    mixed = value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")
    path_word = value.contains("/") & value.rlike("(?:^|/)[a-z]{3,}(?:/|$)")
    return F.when(mixed & ~path_word, (shannon(value) >= 4.0) & (wordish(value) < 0.6)).otherwise(F.lit(False))


def among(word: Column, words: Sequence[str]) -> Column:
    """Whether a word without blanks is one of ``words``: one literal, where a list would put each into every plan."""
    return F.lit(f" {' '.join(words)} ").contains(F.concat(F.lit(" "), word, F.lit(" ")))


def is_tld(label: Column, tlds: Sequence[str] | None = None) -> Column:
    """Whether a label is one of ``tlds`` (the root zone's) or names a private network."""
    return among(F.lower(label), [t.lower() for t in (ROOT_ZONE if tlds is None else tlds)] + P.PRIVATE_TLDS)


def is_domain(text: Column, start: Column, value: Column, tlds: Sequence[str] | None = None) -> Column:
    """Whether a host-like match is a host where it stands; ``start`` counts from 0."""
    labels = F.split(value, r"\.")
    tld = F.element_at(labels, -1)
    before = F.when(start > 0, F.substring(text, start, 1)).otherwise("")
    scheme = F.when(start > 2, F.substring(text, start - 2, 3)).otherwise("")
    after = F.substring(text, start + F.length(value) + 1, 1)
    refused = (before == ".") | (after == "(") | ((F.size(labels) == 2) & among(F.lower(tld), P.AMBIGUOUS_TLDS)) | ((tld != F.lower(tld)) & (tld != F.upper(tld)))
    return is_tld(tld, tlds) & ((scheme == "://") | (before == "@") | ~refused)


def is_ipv4(value: Column) -> Column:
    return value.rlike(P.STRICT_IPV4) & ~value.isin(*P.ALLOWED_IPS)


def skips_value(value: Column) -> Column:
    """Values that are no secrets: empty, references, assignments, flags."""
    return (value == "") | value.rlike(r"^[$=]") | F.lower(value).isin(*FLAG_WORDS)


def field_is_secret(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[_.-]", "").rlike("(?:" + "|".join(FIELD_ENDS) + ")$")


def dotenv_is_secret(key: Column) -> Column:
    return F.upper(key).rlike("(?:^|[_.-])(?:" + "|".join(DOTENV_ENDS) + ")$")


def secret_field(key: Column, value: Column) -> Column:
    return field_is_secret(key) & ~skips_value(value) & ~value.rlike(P.PLACEHOLDER)


def whole_word(text: Column, start: Column, end: Column) -> Column:
    """Neither edge cuts a word; an edge that is no word character itself has none to cut."""
    word = r"[\p{L}\p{Nd}\p{M}_]"
    char = lambda at: F.when(at >= 1, F.substring(text, at, 1)).otherwise("")
    glued = lambda a, b: char(a).rlike(word) & char(b).rlike(word)
    return ~(glued(start + 1, start) | glued(end, end + 1))


def kind_of_placeholder(placeholder: Column) -> Column:
    return F.regexp_extract(placeholder, r"^\[REDACTED_(.*)_\d+\]$", 1)


def squeeze(text: Column) -> Column:
    """White space normalised to single blanks."""
    return F.trim(F.regexp_replace(text, r"[\p{Z}\s]+", " "))


def strip_comment(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"(^|[ \t])#.*", "$1"))


def escape_label(value: Column) -> Column:
    """A metric label's value."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def shortest(number: Column) -> Column:
    """A double as the fewest digits that say it: plain from 0.0001 up to below a million, with a two-digit exponent beyond."""
    text, size = number.cast("string"), F.abs(number)
    head, power = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1).cast("int")
    plain = F.regexp_replace(head, r"\.0$", "")
    sign = F.when(number < 0, "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(head, "[-.]", ""), "0+$", "")
    whole = F.length(F.substring_index(F.ltrim(head, F.lit("-")), ".", 1))
    tail = F.substring(digits, F.lit(2), F.length(digits))
    mantissa = F.concat(sign, F.substring(digits, 1, 1), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""))
    with_power = lambda p: F.concat(mantissa, F.when(p < 0, "e-").otherwise("e+"), F.when(F.abs(p) < 10, "0").otherwise(""), F.abs(p).cast("string"))
    return (
        F.when(number.isNull() | F.isnan(number) | (size == float("inf")), F.when(number == float("inf"), "+Inf").when(number == -float("inf"), "-Inf").when(F.isnan(number), "NaN"))
        .when(number == 0, "0")
        .when((size >= 1e-3) & (size < 1e6), plain)
        .when((size >= 1e-4) & (size < 1e-3), F.concat(sign, F.lit("0.000"), digits))
        .when((size >= 1e6) & (size < 1e7), with_power(whole - 1))
        .otherwise(with_power(power))
    )
