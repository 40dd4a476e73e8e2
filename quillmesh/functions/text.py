"""Text functions as columns: normalization, names, tokens, content hashes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def collapsed(c) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x{A0}]+", " "))


def normalized(c) -> Column:
    """Lines with collapsed white space, blank ones dropped; null is the empty text."""
    lines = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), r"[\n\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]")
    return F.array_join(F.filter(F.transform(lines, collapsed), lambda x: x != ""), "\n")


def content_hash(c) -> Column:
    """SHA-256, as hex, of a normalized text."""
    return F.sha2(c, 256)


def tokens(c) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def category_key(c) -> Column:
    return F.lower(F.trim(c))


def project_key(c) -> Column:
    return F.lower(collapsed(c))


def compared(c) -> Column:
    """As answers and locators are compared: case folded, white space collapsed, accents kept."""
    return F.lower(F.translate(F.upper(collapsed(c)), "Σ", "σ"))  # upper case unfolds what has several small forms; sigma would be lowered by its place


def without_accents(text: str, fold: bool) -> str:
    bare = "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x))
    return " ".join((bare.casefold() if fold else bare.lower()).split())


@F.pandas_udf(StringType())
def tag_key(names):
    """Tags are equal without regard to case and accents."""
    return names.map(lambda x: None if x is None else without_accents(x, False))


@F.pandas_udf(StringType())
def privacy_key(names):
    """As tag_key, case folded."""
    return names.map(lambda x: None if x is None else without_accents(x, True))


def safe_uri(uri, kind, title) -> Column:
    """Local paths are shown by their last part only."""
    local = F.col(uri).startswith("file:") | F.col(uri).startswith("/")
    name = F.regexp_extract(F.col(uri), r"([^/]+)/*$", 1)
    name = F.regexp_replace(name, "^file:", "")
    return F.when(local, F.concat(F.col(kind), F.lit(":"), F.when(name != "", name).otherwise(F.col(title)))).otherwise(F.col(uri))


#: The metadata keys that may be shown.
PUBLIC_KEYS = ("client_id", "note_type")


def public_metadata(c) -> Column:
    """The metadata of a JSON object that may be shown: whitelisted keys with string values."""
    kept = [F.when(F.get_json_object(c, f"$.metadata.{k}").isNotNull() & _is_string(c, k), F.struct(F.lit(k).alias("key"), F.get_json_object(c, f"$.metadata.{k}").alias("value"))) for k in PUBLIC_KEYS]
    return F.map_from_entries(F.filter(F.array(*kept), lambda x: x.isNotNull()))


def _is_string(c, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), f"$.metadata.{key}", "variant")) == "STRING"


#: What marks a message that may hold a credential, and what is shown in its place.
CREDENTIAL_MARKS = ("Bearer ", "api_key=", "password=", "token=")
REDACTED = "[redacted]"


def redacted_error(c, most: int = 1000) -> Column:
    """A message in one line of at most ``most`` characters; one that may hold a credential is not shown."""
    line = F.replace(c, F.lit("\n"), F.lit(" "))
    marked = F.exists(F.array(*map(F.lit, CREDENTIAL_MARKS)), lambda m: F.contains(line, m))
    return F.when(marked, F.lit(REDACTED)).otherwise(F.left(line, F.lit(most)))


def optional_int(c) -> Column:
    """A whole number from text, or null."""
    return F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast("long"))


def optional_str(c) -> Column:
    """Text without outer white space; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


#: Lines of a page layout that are no text.
PAGE_COUNTER = r"(?U)^\s*\d+\s*/\s*\d+\s*$"
GENERATOR_FOOTER = r"(?i)^\s*powered\s+by\s+tcpdf(?:\s*\([^)]*\))?\s*$"


def normalized_pages(c) -> Column:
    """Text of a page layout: hyphenated words joined, lines of a paragraph by a space, counters and footers dropped."""
    plain = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), "\u00a0", " ")
    whole = F.regexp_replace(plain, r"(?U)(?<=\w)-\n(?=\w)", "")

    def paragraph(p: Column) -> Column:
        lines = F.filter(F.split(p, "\n"), lambda x: ~x.rlike(PAGE_COUNTER) & ~x.rlike(GENERATOR_FOOTER))
        return F.array_join(F.filter(F.transform(lines, collapsed), lambda x: x != ""), " ")

    return F.array_join(F.filter(F.transform(F.split(whole, r"\n{2,}"), paragraph), lambda x: x != ""), "\n\n")


def plain_terms(c) -> Column:
    """The set of a text's ASCII letter-and-digit runs, accents off and lower-cased."""
    return F.array_distinct(F.regexp_extract_all(unaccented(c), F.lit("[a-z0-9]+"), F.lit(0)))


@F.pandas_udf(StringType())
def unaccented(values):
    """Lower case without combining marks; white space as it is."""
    return values.map(lambda x: None if x is None else "".join(k for k in unicodedata.normalize("NFKD", x) if not unicodedata.combining(k)).lower())


def has_text(c, asked) -> Column:
    """Whether a text holds another, without regard to case and accents."""
    return F.contains(F.collate(c, "UNICODE_CI_AI"), F.collate(asked, "UNICODE_CI_AI"))


NAME_LOCALE = "pt"


def by_name(c, locale: str = NAME_LOCALE) -> Column:
    """What names are ordered by in a language: letters first, then accents, then case."""
    return F.collate(c, locale)


def unsupported_keys(metadata) -> Column:
    """The keys of a JSON object, in order, that may not be stored; none for what is no object."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(metadata), F.array().cast("array<string>")), F.array(*map(F.lit, PUBLIC_KEYS))))


def reference(title, page, section, chunk_index, content) -> Column:
    """A chunk as people cite it: its title, where it is, and its text. A page of 0 and a blank section are not shown."""
    parts = F.array(F.when(F.col(page) != 0, F.concat(F.lit("Página "), F.col(page).cast("string"))), F.nullif(F.col(section), F.lit("")), F.concat(F.lit("Trecho "), (F.col(chunk_index) + 1).cast("string")))
    return F.concat_ws("\n", title, F.array_join(parts, " · "), content)


def name_uuid(namespace: str, c) -> Column:
    """The UUID of a name in a namespace (version 5), so that a backfill that is run again gives the same."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(c, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def location(metadata, content) -> Column:
    """struct<chunk_index, page, section, start_char, end_char> of stored metadata; what is missing or no JSON has defaults."""
    at = lambda k: F.get_json_object(metadata, f"$.location.{k}")
    index = F.coalesce(optional_int(at("chunk_index")), optional_int(F.get_json_object(metadata, "$.chunk_index")), F.lit(0))
    end = optional_int(at("end_char"))
    size = F.length(content).cast("long")
    return F.struct(
        index.cast("long").alias("chunk_index"),
        optional_int(at("page")).alias("page"),
        optional_str(at("section")).alias("section"),
        F.coalesce(optional_int(at("start_char")), F.lit(0)).cast("long").alias("start_char"),
        F.when(F.coalesce(end, F.lit(0)) == 0, size).otherwise(end).alias("end_char"),
    )
