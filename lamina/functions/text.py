"""Text expressions: Column in, Column out. Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

# The white space that trimming removes (tab to CR, space, no-break and Unicode spaces, line and paragraph separators, byte order mark).
SPACE = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# CJK unified ideographs.
HAN = r"\x{4e00}-\x{9fff}"


def trim(c: Column) -> Column:
    """Without leading and trailing Unicode white space; built-in trim takes U+0020 alone."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def uri_parts(uri: Column) -> Column:
    """struct(kind, key) of a memory:// address; kind 'root' without any, null for other addresses."""
    parts = F.filter(F.split(F.substr(uri, F.lit(10)), "/"), lambda p: p != "")
    kind = F.coalesce(F.get(parts, F.lit(0)), F.lit("root"))
    key = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    return F.when(uri.startswith("memory://"), F.struct(kind.alias("kind"), key.alias("key")))


def slug(name: Column) -> Column:
    """Key of a topic name: trimmed, white space to -, everything but ASCII letters, digits, ideographs, - and _ removed. Case stays."""
    return F.regexp_replace(F.regexp_replace(trim(name), f"{SPACE}+", "-"), f"[^a-zA-Z0-9{HAN}\\-_]", "")


def turn_id(seq: Column) -> Column:
    """turn_0001 and so on; wider beyond 9999."""
    return F.format_string("turn_%04d", seq)


def fragment_id(date: Column, number: Column) -> Column:
    return F.concat(date, F.format_string("/frag_%03d", number))


def tokens(text: Column) -> Column:
    """Distinct tokens: ideographs, pairs of ideographs that follow each other among the ideographs, and lower-cased words [A-Za-z_]\\w*."""
    text = F.coalesce(text, F.lit(""))
    han = F.regexp_extract_all(text, F.lit(f"[{HAN}]"), F.lit(0))

    def with_pairs(h: Column) -> Column:
        pairs = F.greatest(F.size(h) - 1, F.lit(0))
        return F.concat(h, F.zip_with(F.slice(h, F.lit(1), pairs), F.slice(h, F.lit(2), pairs), lambda a, b: F.concat(a, b)))

    # Bound once, as the element of a one-element array: each use of an expression inside a higher-order function is evaluated again.
    ideographs = F.transform(F.array(han), with_pairs)[0]
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, r"[^\x00-\x7F]+", " ")), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0))
    return F.array_distinct(F.concat(ideographs, words))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def keyword_text(task: Column, result: Column, turns: Column) -> Column:
    """What keyword search reads: task, result and the first 2000 characters of the turns."""
    return F.concat_ws(" ", F.coalesce(task, F.lit("")), F.coalesce(result, F.lit("")), F.substring(F.coalesce(turns, F.lit("")), 1, 2000))


def embed_text(task: Column, result: Column, turns: Column) -> Column:
    """What the encoder reads, for new fragments and for backfill alike."""
    return F.concat_ws("\n", F.coalesce(task, F.lit("")), F.coalesce(result, F.lit("")), F.coalesce(turns, F.lit("")))


def turn_line(role: Column, content: Column) -> Column:
    return F.concat(F.when(role == "user", fixed.USER).otherwise(fixed.AI), content)


def stored_role(role: Column) -> Column:
    return F.when(role == "assistant", "assistant").otherwise("user")


def message_text(raw: Column) -> Column:
    """Text of a third-party message: message.content of a JSON object if message.role is set and the content is a
    non-empty string; the trimmed input if it is not JSON or is null; otherwise, and for anything empty, null."""
    v = F.try_parse_json(raw)
    plain = F.nullif(trim(raw), F.lit(""))
    role = F.coalesce(F.try_variant_get(v, "$.message.role", "string"), F.lit(""))
    content = F.try_variant_get(v, "$.message.content", "variant")
    text = F.when((role != "") & (F.schema_of_variant(content) == "STRING"), F.nullif(F.try_variant_get(v, "$.message.content", "string"), F.lit("")))
    return F.when(v.isNull() | F.is_variant_null(v), plain).otherwise(text)
