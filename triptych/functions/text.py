"""Text rules: whitespace, missing marks, truthiness, quoting of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Cell texts that count as missing when a table is read.
NA_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def exact(name: str) -> Column:
    """The column called `name`, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def na_to_null(text: Column) -> Column:
    return F.when(~text.isin(*NA_TEXTS), text)


def truthy(text: Column) -> Column:
    """Neither NULL nor empty; never NULL itself."""
    return F.coalesce(text, F.lit("")) != ""


def is_number_text(text: Column) -> Column:
    return text.rlike(r"^\s*[+-]?(?i:\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf|infinity)\s*$")
