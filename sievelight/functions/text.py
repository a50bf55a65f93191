"""Text folds, decoders, tokens, shingles and identifiers, as column expressions; Unicode folds as Arrow functions."""

from __future__ import annotations

import html
import random
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import INVISIBLE_CHARACTERS

#: Look-alikes of Latin letters, Cyrillic then Greek.
HOMOGLYPHS = ("аеорсухіјАВЕКМНОРСΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijABEKMHOPCZHIKMNOPTYX")
#: Unicode's space separators.
SPACES = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Zs")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x, f) -> Column:
    """f of a value that is computed once. (A column named in a lambda function would be computed for each element.)"""
    return F.element_at(F.transform(F.array(_c(x)), f), 1)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t.casefold())


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(t))


def strip_invisible(t) -> Column:
    return F.translate(_c(t), INVISIBLE_CHARACTERS, "")


def fold_unicode(t) -> Column:
    """Invisible characters out, compatibility forms composed, look-alikes to Latin."""
    return F.translate(nfkc(strip_invisible(t)), *HOMOGLYPHS)


def canonical(t) -> Column:
    """The key by which datasets are deduplicated."""
    return F.trim(F.regexp_replace(casefold(fold_unicode(t)), r"(?U)\s+", " "))


def canonical_plain(t) -> Column:
    """The same for texts without compatibility forms, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(_c(t)), r"\s+", " "))


def tokens(t) -> Column:
    return F.regexp_extract_all(F.lower(_c(t)), F.lit("[a-z0-9]+"), F.lit(0))


def shingle_fold(t) -> Column:
    """Letters and digits in lower case, apart by single spaces."""
    return F.trim(F.regexp_replace(F.lower(_c(t)), r"[^\p{L}\p{Nd}]+", " "))


def grams(words, size: int) -> Column:
    """Distinct runs of ``size`` words; all words of a shorter text as one; none without words."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(F.size(w) >= size, F.array_distinct(runs)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return let(words, of)


def char_grams(text, size: int) -> Column:
    """Distinct runs of ``size`` characters of a text without its spaces."""

    def of(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))  # overlapping ones, in one pass
        return F.when(F.length(t) >= size, F.array_distinct(runs)).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))

    return let(F.replace(_c(text), F.lit(" "), F.lit("")), of)


def fold_words(t) -> Column:
    return F.array_remove(F.split(shingle_fold(t), " "), "")


def minhash_pairs(count: int) -> list[tuple[int, int]]:
    """The fixed pairs (a, b) of the signatures."""
    r, p = random.Random(97), (1 << 31) - 1
    return [(r.randrange(1, p), r.randrange(p)) for _ in range(count)]


def minhash(items, count: int = 128) -> Column:
    """Signature of an array of strings: the least of (h a + b) mod p for each of ``count`` fixed pairs; p for none."""
    p = (1 << 31) - 1
    pairs = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in minhash_pairs(count)])
    h = F.transform(_c(items), lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % p)
    return let(h, lambda h: F.transform(pairs, lambda ab: F.coalesce(F.array_min(F.transform(h, lambda x: (x * ab["a"] + ab["b"]) % p)), F.lit(p).cast("long"))))


def bands(signature, count: int = 16, rows: int = 8) -> Column:
    return let(signature, lambda s: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substring(F.md5(F.concat_ws("/", i.cast("string"), F.array_join(F.slice(s, i * rows + 1, rows), "/"))), 1, 16)))


# --- decoders ---


def plausible(t: Column) -> Column:
    """At least 8 characters, 90 % printable ones, and a run of 64 (taken every 32) with 40 % letters."""
    printable = F.regexp_count(t, F.lit(r"[^\p{C}]|[\r\n\t]")).cast("double") / F.length(t)
    starts = F.sequence(F.lit(1), F.length(t), F.lit(32))
    window = F.exists(starts, lambda i: F.length(F.regexp_replace(F.substring(t, i, F.lit(64)), r"[^\p{L}]", "")) >= 0.4 * F.length(F.substring(t, i, F.lit(64))))
    return (F.length(t) >= 8) & (printable >= 0.9) & window


def _kept(raw: Column) -> Column:
    return let(F.try_validate_utf8(raw.cast("string")), lambda t: F.when(plausible(t), t))


def decode_base64(t) -> Column:
    """The text of each token of at least 16 characters that decodes to plausible text, url-safe or not."""
    found = F.regexp_extract_all(_c(t), F.lit(r"[A-Za-z0-9+/_-]{16,}={0,2}"), F.lit(0))
    plain = F.transform(found, lambda x: F.translate(F.rtrim(x, F.lit("=")), "-_", "+/"))
    padded = F.transform(plain, lambda x: F.concat(x, F.repeat(F.lit("="), F.pmod(-F.length(x), F.lit(4)))))
    return F.array_compact(F.transform(padded, lambda x: _kept(F.try_to_binary(x, F.lit("base64")))))


def decode_hex(t) -> Column:
    found = F.regexp_extract_all(_c(t), F.lit(r"(?:0x)?((?:[0-9a-fA-F]{2}){8,})"), F.lit(1))
    return F.array_compact(F.transform(found, lambda x: _kept(F.try_to_binary(x, F.lit("hex")))))


def decode_escapes(t) -> Column:
    found = F.regexp_extract_all(_c(t), F.lit(r"(?:\\x[0-9a-fA-F]{2}){4,}"), F.lit(0))
    return F.array_compact(F.transform(found, lambda x: _kept(F.try_to_binary(F.replace(x, F.lit("\\x"), F.lit("")), F.lit("hex")))))


def decode_percent(t) -> Column:
    """The text with percent escapes decoded, if it has at least 3; plus signs stay."""
    n = F.regexp_count(_c(t), F.lit("%[0-9a-fA-F]{2}"))
    return F.when(n >= 3, F.try_url_decode(F.replace(F.replace(_c(t), F.lit("+"), F.lit("%2B")), F.lit("% "), F.lit("%25 "))))


def encoded_layer(t) -> Column:
    """Whether a text is nothing but one more encoding, and spaces of any kind around it."""
    s = F.btrim(_c(t), F.lit(SPACES))
    whole = s.rlike(r"^(?:(?:0x)?(?:[0-9a-fA-F]{2}){8,}|[A-Za-z0-9+/_-]{16,}={0,2}|(?:\\x[0-9a-fA-F]{2}){4,})\z")
    return (F.length(s) >= 8) & (whole | ((F.regexp_count(s, F.lit("%[0-9a-fA-F]{2}")) >= 3) & ~s.rlike("%(?![0-9a-fA-F]{2})")))


# --- identifiers ---


def short_id(*parts) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u0000", *[_c(p).cast("string") for p in parts]), 256), 1, 16)


def host(url) -> Column:
    """The lower-case host of a url without user, default port and final dot."""
    h = F.lower(F.regexp_extract(_c(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(h, r":(?:80|443)?$", ""), r"\.$", "")
