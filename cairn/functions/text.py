"""Text column expressions: cleaning, masking, keyword search, short generated texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import fixed_values as fv
from cairn.functions.columns import as_col, let, not_empty, round_to, strings

# Java needs the flag for \w and \b to know letters beyond ASCII
UNICODE = "(?U)"
ANY_CASE = "(?iU)"


def _strip(value: Column) -> Column:
    """Trim all leading and trailing white space."""
    return F.trim(value, F.lit(fv.WHITE_SPACE))


def words(value) -> Column:
    """Distinct lower-case words."""
    parts = F.split(F.lower(F.coalesce(as_col(value), F.lit(""))), r"\s+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def name_similarity(a, b) -> Column:
    """Shared words over the smaller word set; 0 when either side has no words."""
    left, right = words(a), words(b)
    smaller = F.least(F.size(left), F.size(right))
    return F.when(smaller == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / smaller)


def searchable(name="name", description="description", tags="tags", osm_tags="osm_tags") -> Column:
    """Lower-case blob of everything that keywords are looked up in."""
    pairs = F.transform(F.map_entries(as_col(osm_tags)),
                        lambda e: F.concat_ws(" ", e["key"], e["value"]))
    return F.lower(F.concat_ws(" ", not_empty(name), not_empty(description), as_col(tags), pairs))


def keyword_hits(blob: Column, keywords: dict[str, list[str]]) -> Column:
    """``array<struct<keyword, categories>>`` of the keywords that occur in the text."""
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), strings(c).alias("categories"))
                      for k, c in keywords.items()])
    return let(blob, lambda t: F.filter(table, lambda r: F.contains(t, r["keyword"])))


def intent(message) -> Column:
    """``struct<categories, mood>`` of a free-text request, by multilingual keywords."""
    def read(hits: Column) -> Column:
        found = F.array_sort(F.array_distinct(F.flatten(F.transform(
            hits, lambda h: h["categories"]))))
        return F.struct(
            F.when(F.size(hits) > 0, found).otherwise(
                F.array_sort(strings(fv.INTENT_DEFAULT))).alias("categories"),
            F.transform(hits, lambda h: h["keyword"]).alias("mood"))

    return let(keyword_hits(F.lower(as_col(message)), fv.INTENT_KEYWORDS), read)


def research_categories(value, hint) -> Column:
    """Categories guessed from a text and an optional explicit hint."""
    hint = F.coalesce(as_col(hint), F.lit(""))
    blob = F.lower(F.concat(as_col(value), F.lit(" "), hint))
    table = {k: [c] for k, c in fv.RESEARCH_KEYWORDS.items()}
    named = F.replace(F.lower(_strip(hint)), F.lit(" "), F.lit("_"))
    explicit = F.filter(strings(fv.CATEGORIES), lambda c: c == named)
    guessed = F.flatten(F.transform(keyword_hits(blob, table), lambda h: h["categories"]))
    return F.array_sort(F.array_distinct(F.concat(explicit, guessed)))


def language(value) -> Column:
    """``ru`` when more than 30 % of the characters are Cyrillic, else ``en``."""
    blob = F.lower(as_col(value))
    cyrillic = F.length(F.regexp_replace(blob, "[^Ѐ-ӿ]", ""))
    return F.when(cyrillic > F.length(blob) * 0.3, "ru").otherwise("en")


def is_suspicious(value) -> Column:
    """Does the text look like an attempt to instruct a model?

    Patterns run on lower-cased text, each only where a plain search finds the word it needs.
    """
    def test(blob: Column) -> Column:
        found = F.lit(False)
        for pattern, anchor in zip(fv.INJECTION_PATTERNS, fv.INJECTION_ANCHORS):
            plain = pattern.lower().replace(r"\s", r"[\s\x1c-\x1f\x85\p{Z}]")
            found = found | (F.contains(blob, F.lit(anchor)) & F.rlike(blob, F.lit(plain)))
        return found

    return let(F.lower(F.regexp_replace(as_col(value), fv.CONTROL_CHARS, "")), test)


def sanitize_input(value) -> Column:
    """Strip control characters; remove role tags and special tokens from suspicious text; trim."""
    clean = F.regexp_replace(as_col(value), fv.CONTROL_CHARS, "")
    neutral = F.regexp_replace(F.regexp_replace(clean, ANY_CASE + fv.ROLE_TAGS, ""),
                               ANY_CASE + fv.SPECIAL_TOKENS, "")
    return _strip(F.when(is_suspicious(value), neutral).otherwise(clean))


def mask_personal(value, limit: int = 200) -> Column:
    """Mask e-mail addresses and phone numbers, then shorten for log output."""
    masked = F.regexp_replace(F.regexp_replace(as_col(value), UNICODE + fv.EMAIL, "[EMAIL]"),
                              UNICODE + fv.PHONE, "[PHONE]")
    return F.when(F.length(masked) > limit,
                  F.concat(F.substring(masked, 1, limit), F.lit("..."))).otherwise(masked)


def clean_note(value, limit: int = 10_000) -> Column:
    """Note text: no control characters, limited length, trimmed."""
    return _strip(F.substring(F.regexp_replace(as_col(value), fv.CONTROL_CHARS, ""), 1, limit))


def clean_tags(tags, limit: int = 100) -> Column:
    """Lower-case tags of letters, digits, ``_`` and ``-``; empty ones are dropped, long ones shortened."""
    cleaned = F.transform(as_col(tags), lambda t: F.substring(F.regexp_replace(
        F.lower(_strip(t)), fv.TAG_CHARS_REMOVED, ""), 1, limit))
    return F.filter(cleaned, lambda t: t != "")


def clean_urls(urls, limit: int = 2000) -> Column:
    """Only http, https and relative URLs, limited to ``limit`` characters."""
    trimmed = F.transform(as_col(urls), _strip)

    def allowed(url: Column) -> Column:
        test = F.lit(False)
        for prefix in fv.URL_PREFIXES:
            test = test | F.startswith(url, F.lit(prefix))
        return test

    return F.transform(F.filter(trimmed, allowed), lambda u: F.substring(u, 1, limit))


def html_escape(value) -> Column:
    escaped = as_col(value)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(entity))
    return escaped


def xml_escape(value) -> Column:
    escaped = as_col(value)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(entity))
    return escaped


def is_safe_id(value) -> Column:
    return F.rlike(as_col(value), F.lit(fv.SAFE_ID))


def cache_key(value) -> Column:
    """File-name sized hash of a cache key."""
    return F.substring(F.sha2(as_col(value), 256), 1, 24)


def short_hash(value) -> Column:
    return F.substring(F.md5(as_col(value)), 1, 8)


def coordinate_key(prefix: str, lat, lng, radius_km, digits: int, radius_digits: int) -> Column:
    """Fixed-precision key such as ``atlas_42.441_18.771_5.0``."""
    return F.format_string(f"{prefix}_%.{digits}f_%.{digits}f_%.{radius_digits}f",
                           round_to(lat, digits), round_to(lng, digits),
                           round_to(as_col(radius_km).cast("double"), radius_digits))


def file_name(value, extension: str) -> Column:
    return F.concat(F.replace(as_col(value), F.lit(" "), F.lit("_")), F.lit("." + extension))


def duration_label(seconds) -> Column:
    """``2h 5min`` or ``45min``."""
    seconds = as_col(seconds)
    hours, minutes = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60)
    return F.when(hours > 0, F.format_string("%dh %dmin", hours, minutes)).otherwise(
        F.format_string("%dmin", minutes))


# --- short generated texts ----------------------------------------------------------------------


def _by_language(lang: Column, texts: dict[str, str], *args: Column) -> Column:
    def fill(pattern: str) -> Column:
        return F.format_string(pattern, *args) if args else F.lit(pattern)
    return F.when(lang == "ru", fill(texts["ru"])).otherwise(fill(texts["en"]))


def results_reply(lang, count) -> Column:
    """Reply of the chat when no model is available."""
    lang, count = as_col(lang), as_col(count)
    return F.when(count > 0, _by_language(lang, fv.RESULTS_TEXT, count)).otherwise(
        _by_language(lang, fv.NO_RESULTS_TEXT))


def place_description(name, categories) -> Column:
    joined = F.array_join(as_col(categories), ", ")
    return F.format_string(fv.DESCRIPTION_TEXT, F.coalesce(not_empty(name), F.lit("This place")),
                           F.coalesce(not_empty(joined), F.lit("interesting")))


def place_story(name, categories, lang) -> Column:
    return _by_language(as_col(lang), fv.STORY_TEXT,
                        F.coalesce(not_empty(name), F.lit("This place")),
                        F.array_join(as_col(categories), ", "))


def route_story(names, lang) -> Column:
    """Connecting text for an ordered list of stop names."""
    shown = F.transform(as_col(names), lambda n: F.coalesce(not_empty(n), F.lit("unnamed stop")))
    return _by_language(as_col(lang), fv.ROUTE_STORY_TEXT, F.size(as_col(names)),
                        F.array_join(shown, ", "))


def suggestions(lang, has_results, categories) -> Column:
    """Up to three follow-up questions."""
    lang, has_results, categories = as_col(lang), as_col(has_results), as_col(categories)

    def options(code: str, found: bool) -> Column:
        texts = fv.SUGGESTIONS[code, found]
        if not found:
            return strings(texts)
        asked = {1: "abandoned", 2: "viewpoint"}
        items = [F.when(~F.array_contains(categories, asked[i]), F.lit(t)) if i in asked
                 else F.lit(t) for i, t in enumerate(texts)]
        return F.filter(F.array(*items), lambda t: t.isNotNull())

    picked = F.when(lang == "ru", F.when(has_results, options("ru", True)).otherwise(
        options("ru", False))).otherwise(F.when(has_results, options("en", True)).otherwise(
            options("en", False)))
    return F.slice(picked, 1, 3)
