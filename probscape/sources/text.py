"""Scalar parsing rules shared by the text readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an integer and as a decimal number in problem text.
INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL = r"^[+-]?(?i:nan|inf|infinity)$"


def tokens(line: Column) -> Column:
    """Whitespace-separated tokens; a line without any gives an empty array."""
    text = F.btrim(line, F.lit(" \t\r\n\f\x0b"))
    return F.when(text != "", F.split(text, r"\s+")).otherwise(F.array().cast("array<string>"))


def integer(tok: Column) -> Column:
    return F.when(tok.rlike(INTEGER), tok.try_cast("int"))


def decimal(tok: Column) -> Column:
    return F.when(tok.rlike(DECIMAL) | tok.rlike(SPECIAL), tok.try_cast("double"))


def fortran_decimal(tok: Column) -> Column:
    """A decimal whose exponent may be marked D instead of E."""
    return decimal(F.translate(tok, "Dd", "Ee"))


def fortran_integer(tok: Column) -> Column:
    """A decimal of any notation that has an integer value."""
    x = fortran_decimal(tok)
    whole = (~F.isnan(x)) & (F.abs(x) < 9e15) & (F.floor(x) == x)
    # plain integers, nearly all there are, take the short way
    return F.when(tok.rlike(INTEGER), tok.try_cast("bigint")).when(whole, x.cast("bigint"))


def is_relevant(line: Column, comment: tuple[str, ...] = ('"', "*")) -> Column:
    """Neither blank nor a comment: the first visible character is no comment mark."""
    return line.rlike(r"^\s*[^\s" + "".join(comment) + "]")


def strip_brackets(line: Column) -> Column:
    return F.regexp_replace(line, r"[{}(),]", " ")


def parse_block_sizes(line: Column) -> Column:
    """``{2, 3, -5}`` → array of int; fails on a token that is no integer, or on none at all."""
    toks = tokens(strip_brackets(line))
    sizes = F.transform(
        toks,
        lambda t: F.coalesce(
            integer(t), F.raise_error(F.concat(F.lit("bad block size: "), t)).cast("int")
        ),
    )
    return F.when(F.size(toks) > 0, sizes).otherwise(
        F.raise_error(F.lit("no block sizes")).cast("array<int>")
    )
