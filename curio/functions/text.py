"""Scalar functions over text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def year(value: Column) -> Column:
    """Leading integer of a year given as text or number; null where there is none."""
    return F.regexp_extract(value.cast("string"), r"^\s*(-?\d{1,6})", 1).try_cast("int")


def present(value: Column) -> Column:
    """The value as text, null for the empty text; blanks stay."""
    return F.nullif(value.cast("string"), F.lit(""))


def authority_urls(urls: Column) -> Column:
    """A JSON array of the distinct, not empty URLs in their order; null without any."""
    kept = F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (u != "")))
    return F.when(F.size(kept) > 0, F.to_json(kept))


def _code_point(hex_digits: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32")


def unescape_html(value: Column) -> Column:
    """The five XML entities and numeric references, in a single pass; all else stays as it is."""
    pieces = F.regexp_extract_all(value, F.lit(r"&(?:amp|lt|gt|quot|apos|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});|[^&]+|&"), F.lit(0))

    def one(p: Column) -> Column:
        decimal = F.regexp_extract(p, r"^&#(\d+);$", 1)
        hexadecimal = F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]+);$", 1)
        number = F.when(decimal != "", decimal.try_cast("bigint")).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).try_cast("bigint"))
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        named = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
        out = F.when(valid, _code_point(F.hex(number)))
        for entity, ch in named.items():
            out = out.when(p == entity, F.lit(ch))
        return out.otherwise(p)

    # only texts that hold a reference are taken apart
    return F.when(F.contains(value, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(value)


def fold_ascii(value: Column) -> Column:
    return F.translate(value, UPPER, LOWER)


def fold(text: str) -> str:
    """As :func:`fold_ascii`, of a plain text."""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def like_pattern(text: str) -> str:
    """``%text%``, folded, for :func:`contains_like`; a backslash is an ordinary character."""
    return "%" + fold(text).replace("\\", "\\\\") + "%"


def contains_like(value: Column, *patterns: str) -> Column:
    """Whether the text matches ``%pattern%`` for any pattern, A-Z case folded; % and _ are wildcards, nothing escapes them."""
    folded = fold_ascii(value)
    out = F.lit(False)
    for p in patterns:
        out = out | folded.like(like_pattern(p))
    return F.coalesce(out, F.lit(False))


def joined(values: Column, separator: str) -> Column:
    """The texts of an array, nulls left out; the empty text for a null array."""
    return F.array_join(F.coalesce(values, F.array().cast("array<string>")), separator)


def caption(artist: Column, title: Column, date: Column, medium: Column, credit: Column) -> Column:
    """What a viewer shows below an item."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (artist, title, date, medium, credit)]
    return F.concat(parts[0], F.lit("<br><strong>"), parts[1], F.lit("</strong><br><small>"), parts[2], F.lit("<br>"), parts[3], F.lit("<br>"), parts[4], F.lit("</small>"))


def image_path(image_id: Column, size: str | None = None, root: str = "./public/images") -> Column:
    """Path of a cached image, without a leading dot."""
    return F.regexp_replace(F.concat(F.lit(f"{root}/"), image_id.cast("string"), F.lit(f".{size}.jpg" if size else ".jpg")), r"^\.", "")


def iso_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
