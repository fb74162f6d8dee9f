"""Pseudonyms and sanitised values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a string with a slash or backslash, or that ends as an image file does.
PATH_LIKE = r"(?i)[/\\]|\.(?:jpe?g|png|tif?f|bmp)$"
#: Fixed value: parameter that may hold personal text.
SENSITIVE = ("texto_original",)


def document_id(value: Column, salt: str = "") -> Column:
    """First 16 hex digits of the SHA-256 of the UTF-8 text; `salt` goes in front."""
    text = F.concat(F.lit(salt), value) if salt else value
    return F.substring(F.sha2(text, 256), 1, 16)


def path_like(value: Column) -> Column:
    return value.rlike(PATH_LIKE)


def sanitize_value(value: Column) -> Column:
    """A path-like string as its pseudonym; any other as it is."""
    return F.when(path_like(value), document_id(value)).otherwise(value)


def sanitize_map(values: Column) -> Column:
    """A map of strings with sanitised values; keys stay."""
    return F.transform_values(values, lambda k, v: sanitize_value(v))


def sanitize_file_name(name: Column, doc_id: Column) -> Column:
    """doc_id, two underscores, and what follows the name's first two underscores, or else its last path part."""
    at = F.instr(name, "__")
    rest = F.when(at > 0, F.substring(name, at + 2, F.length(name))).otherwise(F.regexp_extract(name, r"([^/]*)/*$", 1))
    return F.concat(doc_id, F.lit("__"), rest)


def drop_sensitive(values: Column, keys: tuple[str, ...] = SENSITIVE) -> Column:
    """A map without the sensitive keys of its top level."""
    return F.map_filter(values, lambda k, v: ~k.isin(*keys))


#: Tokens of JSON text: a string, with the colon behind it if it is a key, or what stands between strings.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|[^"]++'


def _clean_strings(text: Column) -> Column:
    """sanitize_json() of what is known to be JSON.

    The text is read as a sequence of strings and what stands between them, so that depth doesn't matter and nothing
    leaves the JVM. A string is judged by its characters, its escapes resolved.
    """

    def clean(t: Column) -> Column:
        resolved = F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0]
        plain = F.when(F.contains(t, F.lit("\\")), resolved).otherwise(F.substring(t, F.lit(2), F.length(t) - 2))
        return F.when(t.startswith('"') & t.endswith('"') & path_like(plain), F.concat(F.lit('"'), document_id(plain), F.lit('"'))).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), 0), clean), "")


def sanitize_json(text: Column) -> Column:
    """JSON text with every path-like string in it, at any depth, as its pseudonym; keys and all else stay
    as they are written. Null for a text that is not JSON."""
    return F.when(F.try_parse_json(text).isNotNull(), _clean_strings(text))


def sanitize_parameters(value: Column, keys: tuple[str, ...] = SENSITIVE) -> Column:
    """A VARIANT as sanitize_json has it, and without the sensitive keys of its top level."""
    top = F.try_variant_get(value, "$", "map<string,variant>")
    text = F.when(top.isNotNull(), F.to_json(F.map_filter(top, lambda k, v: ~k.isin(*keys)))).otherwise(F.to_json(value))
    return F.try_parse_json(_clean_strings(text))
