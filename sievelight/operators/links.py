"""Links of a text and why they are suspicious, with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shorteners, credential shapes in the order in which they are looked for, look-alike letters, brands.
SHORTENERS = ("bit.ly", "buff.ly", "cutt.ly", "is.gd", "ow.ly", "rb.gy", "rebrand.ly", "shorturl.at", "t.co", "tiny.cc", "tinyurl.com")
CREDENTIALS = (
    r"(?<![A-Za-z0-9])sk-(?:live|test|ant|proj)-[A-Za-z0-9-]{8,}",
    r"(?<![A-Za-z0-9])sk-[A-Za-z0-9-]{12,}",
    r"(?<![A-Za-z0-9])gh[posru]_[A-Za-z0-9]{20,}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])xox[baprs]-[A-Za-z0-9-]{10,}",
    r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])",
)
BRANDS = ("amazon", "apple", "binance", "coinbase", "github", "google", "metamask", "microsoft", "okx", "paypal")
LOOKALIKES = ("\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0458\u0455\u04bb\u04cf\u03b1\u03b5\u03b9\u03ba\u03bd\u03bf\u03c1\u03c4\u03c5\u03c7", "aeopcyxijshlaeikvoptux")
LINK = (
    r"(?i)(?:\b(?:https?://[^\s<>'\")]+|file:[^\s<>'\")]*|data:[^\s<>'\")]+)"
    r"|(?<![\w@.-])www\.[^\s<>'\")]+"
    r"|(?<![-\w+./:\\])(?:j[\t\r\n]*a[\t\r\n]*v[\t\r\n]*a[\t\r\n]*s[\t\r\n]*c[\t\r\n]*r[\t\r\n]*i[\t\r\n]*p[\t\r\n]*t"
    r"|v[\t\r\n]*b[\t\r\n]*s[\t\r\n]*c[\t\r\n]*r[\t\r\n]*i[\t\r\n]*p[\t\r\n]*t):[^\s<>'\")]*)"
)


BARE_SHORTENER = r"(?i)(?<![\w@./-])(?:" + "|".join(h.replace(".", r"\.") for h in SHORTENERS) + r")/[^\s<>'\")]+"


def urls(text: str | Column) -> Column:
    """Links of a text, then shorteners that stand there without a scheme."""
    t = F.col(text) if isinstance(text, str) else text
    found = F.concat(*[F.regexp_extract_all(t, F.lit("(?U)" + p), F.lit(0)) for p in (LINK, BARE_SHORTENER)])
    return F.when(t.contains(":") | t.contains("/") | F.lower(t).contains("www."), found).when(t.isNotNull(), F.array().cast("array<string>"))  # what any link has


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z]+://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))


def legacy_ip(h: Column) -> Column:
    """IPv4 in hexadecimal, octal or short form."""
    part = r"(?:0x[0-9a-f]+|[0-9]+)"
    numeric = h.rlike(rf"^{part}(?:\.{part}){{0,3}}$")
    plain = h.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$")
    return numeric & ~plain


def confusable(h: Column) -> Column:
    """A label that isn't ASCII and becomes so once look-alikes are Latin, if it has Latin letters beside them, or reads as a
    brand, alone or before a hyphen."""
    brand = F.lit("^(?:" + "|".join(BRANDS) + ")(?:-|$)")

    def odd(x: Column) -> Column:
        read = F.translate(x, *LOOKALIKES)
        ascii_ = lambda c: F.octet_length(c) == F.length(c)
        return ~ascii_(x) & ascii_(read) & (x.rlike("[A-Za-z]") | F.regexp_like(read, brand))

    return F.exists(F.split(F.regexp_replace(h, r"\.+$", ""), r"\."), odd)


def confidence(url: Column) -> Column:
    """How suspicious a link is; null if it isn't."""
    h, u = host(url), F.lower(F.regexp_replace(url, r"[\t\r\n]", ""))
    plain = h.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    out = F.when(u.rlike("^(?:javascript|vbscript|file):"), 0.95).when(u.startswith("data:"), 0.85).when(legacy_ip(h), 0.90).when(plain, 0.85)
    return out.when(h.rlike(r"(?:^|\.)xn--"), 0.85).when(confusable(h), 0.85).when(h.rlike(r"\p{IsCyrillic}") & h.rlike("[a-z]"), 0.75).when(h.isin(*SHORTENERS), 0.75)


def suspicious(text: str | Column) -> Column:
    return F.filter(F.transform(urls(text), lambda u: F.struct(u.alias("match"), confidence(u).alias("confidence"))), lambda x: x["confidence"].isNotNull())


def credentials(text: str | Column) -> Column:
    """Tokens in the shape of credentials."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in CREDENTIALS])))


def seed_run(words: Column, listed: Column, least: int = 12) -> Column:
    """Whether ``least`` words in a row are all listed."""
    step = lambda a, w: F.when(F.array_contains(listed, w), F.struct((a["run"] + 1).alias("run"), F.greatest(a["most"], a["run"] + 1).alias("most"))).otherwise(F.struct(F.lit(0).alias("run"), a["most"].alias("most")))
    return F.aggregate(words, F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")), step, lambda a: a["most"] >= least)


#: IPv4 addresses that aren't public, and IPv6 literals that are.
NOT_PUBLIC = (
    r"^(?:(?:0|10|127)\.[0-9]+\.[0-9]+\.[0-9]+|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.[0-9]+\.[0-9]+|169\.254\.[0-9]+\.[0-9]+"
    r"|172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9]+\.[0-9]+|192\.168\.[0-9]+\.[0-9]+|192\.0\.[02]\.[0-9]+|198\.1[89]\.[0-9]+\.[0-9]+|198\.51\.100\.[0-9]+"
    r"|203\.0\.113\.[0-9]+|(?:22[4-9]|23[0-9]|24[0-9]|25[0-5])\.[0-9]+\.[0-9]+\.[0-9]+)$"
)
PUBLIC_V6 = r"^\[[23][0-9a-f]{3}:"


def refused(url: str | Column) -> Column:
    """Why a url may not be fetched: scheme, credentials, host, blocked (an address that isn't public, or the machine
    itself); null if it may. Names are not resolved."""
    u = F.col(url) if isinstance(url, str) else url
    authority = F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]*)", 1)
    name = F.lower(F.regexp_extract(F.regexp_replace(authority, r"^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))
    inner = name.rlike(NOT_PUBLIC) | (name.startswith("[") & (~name.rlike(PUBLIC_V6) | name.startswith("[2001:db8:"))) | name.isin("localhost") | legacy_ip(name)
    out = F.when(~F.lower(u).rlike("^https?://") | u.isNull(), "scheme").when(authority.contains("@"), "credentials").when(name == "", "host")
    return out.when(inner, "blocked")


def seed_phrases(words: Column, listed: Column, size: int = 12) -> Column:
    """Runs of ``size`` listed words in a row, one after another, without overlap: array of phrases."""
    none = F.array().cast("array<string>")

    def step(a: Column, w: Column) -> Column:
        run = F.when(F.array_contains(listed, w), F.concat(a["run"], F.array(w))).otherwise(none)
        full = F.size(run) == size
        return F.struct(F.when(full, none).otherwise(run).alias("run"), F.when(full, F.concat(a["out"], F.array(F.array_join(run, " ")))).otherwise(a["out"]).alias("out"))

    return F.aggregate(words, F.struct(none.alias("run"), none.alias("out")), step, lambda a: a["out"])
