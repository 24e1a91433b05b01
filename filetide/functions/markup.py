"""Markup to plain text, by expressions only."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col

# Tags that separate words; every other tag joins its neighbours.
BLOCK_TAGS = r"(?i)</*(?:w:p|w:tr|w:tc|row|a:p|si|v|c )[^>]*>|</*c>"


def strip_tags(xml: Column | str) -> Column:
    """Block tags become a space, inline tags vanish, white space collapses."""
    text = F.regexp_replace(col(xml), BLOCK_TAGS, " ")
    text = F.regexp_replace(text, "<[^>]*>", "")
    text = F.regexp_replace(text, "<[^>]*$|>", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _from_code(code: Column) -> Column:
    """A character from its code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def decode_entities(text: Column | str) -> Column:
    """Character references, named (the HTML 4 set of the standard library) or numeric."""
    names = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))])
    pieces = F.split(col(text), "&", -1)

    def decode(piece: Column) -> Column:
        body = F.regexp_extract(piece, "^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        rest = F.substring(piece, F.length(body) + 2, F.length(piece))
        code = F.when(F.rlike(body, F.lit("^#[xX]")), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10)).when(
            F.startswith(body, F.lit("#")), F.substring(body, F.lit(2), F.length(body))
        ).cast("long")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        value = F.when(valid, _from_code(code)).when(code.isNull(), F.when(body == "apos", "'").otherwise(F.try_element_at(names, body)))
        return F.when((body != "") & value.isNotNull(), F.concat(value, rest)).otherwise(F.concat(F.lit("&"), piece))

    tail = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), decode)
    decoded = F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))
    return F.when(F.contains(col(text), F.lit("&")), decoded).otherwise(col(text))


def markup_to_text(xml: Column | str, max_chars: int | None = None) -> Column:
    """Plain text of a whole document; a length cap only where the caller asks for one."""
    text = decode_entities(strip_tags(xml))
    return text if max_chars is None else F.left(text, F.lit(max_chars))
