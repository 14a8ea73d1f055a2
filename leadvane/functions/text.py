"""String functions as native column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadvane.config import (BOILERPLATE_SIMILARITY, BOILERPLATE_SNIPPETS, BRAND_TERM, CHANNEL_SOURCES,
                             COPY_PASTE_PREFIXES, FREE_EMAIL_DOMAINS, LEAD_ADS_MEDIUM, LEGAL_SUFFIXES,
                             MID_TITLE_PATTERN, SENIOR_TITLE_PATTERN, SPECIFIC_TEXT_PATTERN, VAGUE_TEXTS)

# fixed values: redaction patterns and tokens
EMAIL_PATTERN = r"[A-Za-z0-9._%+'-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"
IPV4_PATTERN = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
_HEX = "[0-9A-Fa-f]{1,4}"
MIN_PHONE_DIGITS = 7


def strip(c: Column) -> Column:
    """Without leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_or_null(c: Column) -> Column:
    """Stripped text, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column, numeric: bool = False) -> Column:
    """Null, NaN or the empty string; whitespace alone is not blank."""
    return c.isNull() | F.isnan(c) if numeric else c.isNull() | (c == "")


def normalised_email(email: Column) -> Column:
    return F.lower(strip(email))


def email_type(email_l: Column) -> Column:
    """``free`` when the part after the first ``@`` is a free-mail domain."""
    domain = F.try_element_at(F.split(email_l, "@"), F.lit(2))
    return F.when(F.coalesce(domain.isin(*FREE_EMAIL_DOMAINS), F.lit(False)), "free").otherwise("business")


def normalised_company(name: Column) -> Column:
    """Company name for exact matching: lower case, no dots or apostrophes, words only, no trailing legal forms."""
    words = F.regexp_replace(F.regexp_replace(F.lower(name), "[.'’]", ""), r"(?U)[^\w]+|_", " ")
    squeezed = strip(F.regexp_replace(words, r"(?U)\s+", " "))
    suffixes = "|".join(LEGAL_SUFFIXES)
    return F.nullif(F.regexp_replace(squeezed, rf"(^|\s)(({suffixes})(\s|$))+$", ""), F.lit(""))


def tokens(text: Column) -> Column:
    """Distinct lower-case alphanumeric words; empty for null."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united distinct tokens; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    united = F.size(a) + F.size(b) - shared
    return F.when(united > 0, shared / united).otherwise(0.0)


def best_similarity(text: Column, snippets: tuple[str, ...] = BOILERPLATE_SNIPPETS) -> Column:
    """Largest Jaccard similarity to a fixed snippet list: a projection, no join and no shuffle.

    ``text`` is tokenised once; the snippets' token sets are folded to literals by the optimiser.
    """
    lists = F.array(*[tokens(F.lit(s)) for s in snippets])
    each = F.transform(F.array(tokens(text)),
                       lambda t: F.array_max(F.transform(lists, lambda s: jaccard(t, s))))
    return each.getItem(0)


def is_boilerplate(text: Column, threshold: float = BOILERPLATE_SIMILARITY) -> Column:
    """Similar to a fixed snippet; a pair whose token counts alone rule the threshold out is not intersected."""
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold must be in (0, 1], got {threshold}")
    lists = F.array(*[tokens(F.lit(s)) for s in BOILERPLATE_SNIPPETS])

    def close(a: Column, b: Column) -> Column:
        return ((F.size(a) >= F.size(b) * threshold) & (F.size(b) >= F.size(a) * threshold)
                & (jaccard(a, b) >= threshold))
    return F.exists(F.array(tokens(text)), lambda t: F.exists(lists, lambda s: close(t, s)))


def _normal(text: Column) -> Column:
    return F.coalesce(F.lower(strip(text)), F.lit(""))


def text_class(text: Column) -> Column:
    """``copy_paste`` by opening phrase, else ``vague`` / ``specific`` / ``neutral``."""
    s = _normal(text)
    pasted = F.lit(False)
    for prefix in COPY_PASTE_PREFIXES:
        pasted = pasted | s.startswith(prefix)
    return F.when(pasted, "copy_paste").otherwise(_vague_or_specific(s))


def text_class_v2(text: Column) -> Column:
    """Like ``text_class`` but ``copy_paste`` means similar to a known boilerplate snippet."""
    return F.when(is_boilerplate(text), "copy_paste").otherwise(_vague_or_specific(_normal(text)))


def _vague_or_specific(s: Column) -> Column:
    return (F.when(s.isin(*VAGUE_TEXTS), "vague").when(s.rlike(SPECIFIC_TEXT_PATTERN), "specific")
            .otherwise("neutral"))


def seniority(title: Column) -> Column:
    t = F.lower(title)
    return (F.when(F.coalesce(strip(title), F.lit("")) == "", "not_asked/blank")
            .when(t.rlike("student|intern"), "student")
            .when(t.rlike(SENIOR_TITLE_PATTERN), "senior")
            .when(t.rlike(MID_TITLE_PATTERN), "mid").otherwise("junior/ic"))


def channel(medium: Column, source: Column) -> Column:
    """UTM medium and source to a marketing channel, first match wins."""
    out = F.when(medium == LEAD_ADS_MEDIUM, "meta_leadads")
    for name, sources in CHANNEL_SOURCES.items():
        out = out.when(source.isin(*sources), name)
    return out.otherwise("organic_direct")


def search_term(channel_: Column, term: Column) -> Column:
    brand = F.coalesce(F.lower(term).contains(BRAND_TERM), F.lit(False))
    return F.when(channel_ != "google", "not_google").when(brand, "brand").otherwise("generic")


def word_count(text: Column) -> Column:
    """Whitespace-separated words."""
    s = F.coalesce(strip(text), F.lit(""))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"(?U)\s+")))


def _ipv6_pattern() -> str:
    """Full and ``::``-shortened IPv6 forms of at most seven colons, so that no Python check per row is needed."""
    forms = [rf"(?:{_HEX}:){{7}}{_HEX}", rf"(?:{_HEX}:){{1,6}}:"]
    forms += [rf"(?:{_HEX}:){{1,{7 - n}}}(?::{_HEX}){{1,{n}}}" for n in range(1, 7)]
    forms += [rf":(?:(?::{_HEX}){{1,6}}|:)"]
    return rf"(?<![0-9A-Za-z:])(?:{'|'.join(forms)})(?![0-9A-Za-z:])"


IPV6_PATTERN = _ipv6_pattern()
# A digit run with separators holding at least seven digits, unless the whole run is an ISO date (with an hour).
PHONE_PATTERN = (r"(?:\+\(?|\(|)(?<![\d])(?!\d{4}-\d{2}-\d{2}(?:\s\d{1,2})?(?![\d\s().\-/]*\d))"
                 r"\d(?:[\s().\-/]*\d){6,}")


def redact(text: Column) -> Column:
    """Text with e-mail addresses, IP addresses and phone-like digit runs replaced by tokens, in that order."""
    out = F.regexp_replace(text, EMAIL_PATTERN, "<email>")
    out = F.regexp_replace(out, IPV4_PATTERN, "<ip>")
    out = F.regexp_replace(out, IPV6_PATTERN, "<ip>")
    return F.regexp_replace(out, PHONE_PATTERN, "<phone>")
