"""Looking inside JSON text without leaving the row."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, functions as F

from tablewarden.functions.values import as_number

# A key with its colon, a string, a number, or a literal.
_TOKEN = r'"(?:[^"\\]|\\.)*+"(?:\s*:)?|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null'


def leaf_tokens(text: Column) -> Column:
    """All scalar values at any depth, as JSON text; keys are left out.

    Each token is itself a JSON scalar. No depth limit and no explode: the
    tokens of a document stay in its row.
    """
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return F.filter(tokens, lambda t: ~t.endswith(":"))


def any_leaf(text: Column, matches: Callable[[Column, Column], Column]) -> Column:
    """True when ``matches(kind, plain text)`` holds for some leaf.

    ``kind`` is string, number, boolean or null.
    """

    def test(token: Column) -> Column:
        kind = (
            F.when(token.startswith('"'), "string")
            .when(token == "null", "null")
            .when(token.isin("true", "false"), "boolean")
            .otherwise("number")
        )
        # only strings need their escapes resolved
        plain = F.when(
            token.startswith('"'), F.try_variant_get(F.try_parse_json(token), "$", "string")
        ).otherwise(token)
        return matches(kind, plain)

    return F.exists(leaf_tokens(text), test)


# A key with its colon, a string, a structural character, or anything between those.
_PIECE = r'"(?:[^"\\]|\\.)*+":?|[{}\[\],]|[^{}\[\],"]+'


#: A key that is data, not a name: a number, a UUID, a date or time, 16 or more hexadecimal digits.
DATA_KEY = (
    r"-?[0-9]+|[0-9]{4}-[0-9]{2}(-[0-9]{2}([T ][0-9:.]+Z?)?)?"
    r"|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{16,}"
)


def skeleton(text: Column, data_key: str | None = None) -> Column:
    """JSON text without its values: each becomes one fixed value of its kind.

    Expects text without blanks outside of strings, as ``to_json`` writes it.
    Keys that are ``data_key`` from end to end become ``{*}`` and a number, which
    tells where in the text they stand and so keeps them apart.
    """

    def bare(piece: Column, at: Column) -> Column:
        first = F.substring(piece, 1, 1)
        key = piece if data_key is None else F.when(
            piece.rlike(f'^"(?:{data_key})":$'), F.concat(F.lit('"{*}'), at, F.lit('":'))
        ).otherwise(piece)
        return (
            F.when(piece.endswith(":"), key)
            .when(first == '"', F.lit('""'))
            .when(first.isin("t", "f"), F.lit("true"))
            .when(first.isin(*"-0123456789"), F.lit("0"))
            .otherwise(piece)
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), bare), "")


def hint(text: Column, value: str, raw: bool = True) -> Column | None:
    """A cheap test that holds for all JSON text in which some value can match.

    None when there is no such test. Text as it came (``raw``) may spell
    characters as escapes and numbers with exponents; those always pass.
    """
    if not value.isascii() or any(c in value for c in '"\\') or not value.isprintable() or not value:
        return None
    lowered = F.lower(text)
    found = lowered.contains(value.lower())
    number = as_number(value)
    if number is not None:
        if number != 0 and not Decimal("0.001") <= abs(number) < 10_000_000:
            return None
        # equal numbers are written with these digits, if perhaps more zeros
        found = found | lowered.contains(format(number.normalize(), "f"))
    return found | text.contains("\\") | text.rlike("[0-9][eE][-+]?[0-9]") if raw else found


def variant_path(parts: list[str]) -> str:
    """A VARIANT path from field names and array positions."""
    steps = []
    for part in parts:
        if part.isdigit():
            steps.append(f"[{part}]")
        else:
            quote = '"' if "'" in part else "'"
            if quote in part:
                raise ValueError(f"a field name cannot hold both kinds of quotes: {part}")
            steps.append(f"[{quote}{part}{quote}]")
    return "$" + "".join(steps)
