"""Text expressions: number labels, names, keys, redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import fixed


def humanize_number(value: Column) -> Column:
    """'-' for null, billions and millions with one decimal, else two decimals."""
    return (
        F.when(value.isNull(), "-")
        .when(F.abs(value) >= 1e9, F.concat(fixed(value / 1e9, 1), F.lit("B")))
        .when(F.abs(value) >= 1e6, F.concat(fixed(value / 1e6, 1), F.lit("M")))
        .otherwise(fixed(value, 2))
    )


def money_label(value: Column) -> Column:
    """Whole dollars, in thousands from 10,000 up."""
    return F.when(
        F.abs(value) >= 10_000, F.concat(F.lit("$"), F.format_number(value / 1000, 0), F.lit("k"))
    ).otherwise(F.concat(F.lit("$"), F.format_number(value, 0)))


def short_list_label(items: Column, limit: int = 2) -> Column:
    """The first few items, then how many more; a dash for none."""
    head = F.array_join(F.slice(items, 1, limit), " ")
    size = F.size(items)
    return (
        F.when(items.isNull() | (size == 0), "—")
        .when(size <= limit, head)
        .otherwise(F.concat(head, F.lit(" +"), (size - limit).cast("string")))
    )


def title_from_slug(display: Column, slug: Column) -> Column:
    """Display name, or the slug in title case with spaces for dashes.

    A letter is upper case where no letter stands before it, so also behind digits and apostrophes.
    """
    shown = F.when(display != "", display)
    name = F.replace(slug, F.lit("-"), F.lit(" "))
    letters = F.split(name, "")
    cased = F.transform(
        letters,
        lambda c, i: F.when((i > 0) & F.try_element_at(letters, i).rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c)),
    )
    return F.coalesce(shown, F.array_join(cased, ""))


def content_key(*parts: Column) -> Column:
    """First 24 hex digits of the SHA-256 of the parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def row_key(columns: Sequence[str]) -> Column:
    """Content key of a row over the listed columns; leave as_of out to reuse unchanged rows."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 24)


def redact(text: Column, secret: str) -> Column:
    """Every occurrence of a secret in a document's text replaced."""
    return F.replace(text, F.lit(secret), F.lit("[REDACTED]"))


def flatten_blocks(content: Column, sep: str = "\n") -> Column:
    """Text of a message given as JSON: a string, or a list of strings and typed blocks.

    Only strings and blocks of type text are kept. Text that is not JSON passes through.
    """
    blocks = F.from_json(content, "array<variant>")

    def block_text(b: Column) -> Column:
        typed = F.try_variant_get(b, "$.type", "string") == "text"
        return F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")).when(
            typed, F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))
        )

    joined = F.array_join(F.array_compact(F.transform(blocks, block_text)), sep)
    is_list = F.ltrim(content).startswith("[") & F.try_parse_json(content).isNotNull()
    as_string = F.try_variant_get(F.try_parse_json(content), "$", "string")
    quoted = F.ltrim(content).startswith('"')
    return (
        F.when(content.isNull(), "")
        .when(is_list, joined)
        .when(quoted, F.coalesce(as_string, content))
        .otherwise(content)
    )
