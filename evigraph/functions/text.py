"""Scalar text functions as Column expressions; only the numbers of trigrams are made in tasks."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.constants import ID_PREFIXES


def _accents() -> tuple[str, str]:
    """Letters below U+0250 that decompose to one base letter, and those bases."""
    pairs = [(chr(i), d[0]) for i in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(i))) > 1 and all(unicodedata.combining(c) for c in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def strip_accents(c) -> Column:
    """Latin letters without their diacritics; free-standing combining marks go."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}", ""), _FROM, _TO)


def words(c) -> Column:
    """Terms of the word channel: lower-cased letter and digit runs without diacritics."""
    return F.regexp_extract_all(F.lower(strip_accents(c)), F.lit(r"[\p{L}\p{N}]+"), 0)


def trigrams(c) -> Column:
    """Terms of the trigram channel; empty below three characters.

    The characters are split once and bound, so the work is linear in the text.
    """
    of = lambda ch: F.transform(F.sequence(F.lit(0), F.size(ch) - 3), lambda i: F.concat(F.get(ch, i), F.get(ch, i + 1), F.get(ch, i + 2)))
    low = F.lower(c)
    return F.when(F.length(low) >= 3, F.element_at(F.transform(F.array(F.split(low, "")), of), 1)).otherwise(F.array().cast("array<string>"))


def trigram_numbers(lowered: pa.Array) -> list[np.ndarray]:
    """The trigrams of lower-cased texts as numbers: 21 bits a code point, so no two trigrams share one."""
    out = []
    for text in lowered:
        ch = np.frombuffer((text.as_py() or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        out.append((ch[:-2] << 42) | (ch[1:-1] << 21) | ch[2:])
    return out


# What an index of trigrams reads instead of lists of strings.
trigrams.prepared, trigrams.numbers = F.lower, trigram_numbers


def normalize_name(c) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def normalized_hash(c) -> Column:
    return F.sha2(normalize_name(c), 256)


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def filename(name, public_id, ext: str) -> Column:
    return F.concat(slug(name), F.lit("--"), F.right(public_id, F.lit(8)), F.lit(f".{ext}"))


def id_valid(c) -> Column:
    return c.rlike(f"^({'|'.join(ID_PREFIXES)})_[0-9A-HJKMNP-TV-Z]{{26}}$")


def citations(c) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[@(evd_[A-Za-z0-9]+)\]"), 1)


def node_links(c) -> Column:
    """Targets of [[target]] and [[target|text]]."""
    return F.regexp_extract_all(c, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), 1)


def token_estimate(c) -> Column:
    """A token per four characters, and one per Han, kana or hangul character."""
    wide = F.regexp_count(c, F.lit(r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"))
    return F.ceil((F.length(c) - wide) / 4 + wide).cast("long")


def occurrences(text, quote) -> Column:
    """Non-overlapping occurrences of a quote that is not empty."""
    return ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).cast("long")


def span(text, start, end) -> Column:
    """Code points start (from 0) to end (exclusive)."""
    return F.substring(text, start + 1, end - start)


def canonical_map(c) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def redact(text, secrets) -> Column:
    """Every occurrence of every secret (array column, no empty ones) replaced."""
    return F.aggregate(secrets, text, lambda acc, s: F.replace(acc, s, F.lit("[REDACTED]")))


def url_allowed(c) -> Column:
    """http(s) without user info, not to a loopback, private or link-local host."""
    host = F.lower(F.regexp_extract(c, r"^[a-zA-Z]+://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.|\[)")
    return c.rlike(r"^https?://") & ~c.rlike(r"^[a-zA-Z]+://[^/?#]*@") & (host != "") & ~private


def html_text(c) -> Column:
    """Visible text: no scripts, styles, comments or tags; the five XML entities decoded; white space folded."""
    x = F.regexp_replace(c, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def backoff(base: float, attempt, cap: float, jitter=None) -> Column:
    """Seconds to wait after an attempt (from 0): doubling up to the cap; ``jitter`` (0 to 1) takes up to half of it off."""
    full = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(cap))
    return full if jitter is None else full * (F.lit(1.0) - jitter / 2)


def cursor(*parts) -> Column:
    """Opaque page cursor."""
    return F.base64(F.to_json(F.struct(*parts)).cast("binary"))


def cursor_parts(c, schema: str) -> Column:
    """struct of a cursor's parts; null if it is no cursor."""
    return F.from_json(F.try_to_binary(c, F.lit("base64")).cast("string"), schema)


def timestamp(c) -> Column:
    """A time in UTC of its RFC 3339 form; null if it isn't one."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(c))


def rfc3339(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def valid_at(at, since, until) -> Column:
    """Whether a time lies in [since, until); an open end is null."""
    return (since.isNull() | (at >= since)) & (until.isNull() | (at < until))


MAX_PATTERN = 200


def pattern_error(pattern: str) -> str | None:
    """Why a user's pattern is not run: too long, not valid, or a repeated group that repeats inside."""
    import re

    if len(pattern) > MAX_PATTERN:
        return "too_long"
    try:
        re.compile(pattern)
    except re.error:
        return "invalid"
    return "nested_repeat" if re.search(r"\((?:[^()\\]|\\.)*[*+}](?:[^()\\]|\\.)*\)[*+{]", pattern) else None


# Fixed value: the digits of an id.
ID_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def id_time(c) -> Column:
    """The time in an id: its first ten digits (base 32) are milliseconds."""
    digit = lambda i: (F.instr(F.lit(ID_DIGITS), F.substring(F.split_part(c, F.lit("_"), F.lit(2)), i, 1)) - 1).cast("long")
    millis = F.lit(0).cast("long")
    for i in range(1, 11):
        millis = millis * 32 + digit(i)
    return F.when(id_valid(c), F.timestamp_millis(millis))
