"""Strict JSON objects out of model replies, with built-in columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.functions.text import strip

_END = "\u2402triptych-end\u2403"
_FENCE = "```"


def remove_fences(text: Column) -> Column:
    """Drop an opening fence line at the very start and a fence at the end.

    Without a line break after it, an opening fence stays.
    """
    line_end = F.locate("\n", text)
    opened = strip(F.when(text.startswith(_FENCE) & (line_end > 0), _from(text, line_end + 1))
                   .otherwise(text))
    return F.when(opened.endswith(_FENCE), F.left(opened, F.length(opened) - len(_FENCE))
                  ).otherwise(opened)


def _from(text: Column, position: Column) -> Column:
    return F.substring(text, position, F.length(text))


def trailing_object(text: Column) -> Column:
    """From the first `{` to the end, NULL without one."""
    start = F.locate("{", text)
    return F.when(start > 0, _from(text, start))


def _marked(text: Column) -> Column:
    """The text and a closing marker object, as an array of objects."""
    return F.from_json(F.concat(F.lit("["), text, F.lit(f',{{"{_END}":""}}]')),
                       "array<map<string,string>>", {"allowSingleQuotes": "false"})


def _whole(marked: Column, text: Column) -> Column:
    """The first object, if nothing but the marker follows it."""
    one = ((F.size(marked) == 2) & F.map_contains_key(F.get(marked, F.lit(1)), _END)
           & ~text.contains(_END))
    return F.when(one, F.get(marked, F.lit(0)))


def strict_object(text: Column) -> Column:
    """The whole text as one JSON object (text to text), else NULL.

    Spark's parser ignores what follows the first value. Put into an array
    before a closing marker object, a text that is more or less than one
    object shows: the array is broken, or it has not just that object and the
    marker.
    """
    return _whole(_marked(text), text)


def candidate_object(reply: Column) -> Column:
    """The part of a reply that has to be one JSON object.

    The reply without fences may itself be the object, or end with it: prose
    before the object is fine, prose after it is not. A text that is an object
    starts with its first brace, so in both cases it is the end from there.
    """
    return trailing_object(remove_fences(reply))


def extract_object(reply: Column) -> Column:
    """The JSON object in a reply, else NULL."""
    return strict_object(candidate_object(reply))


def with_object(df: DataFrame, reply: Column, name: str) -> DataFrame:
    """Add `extract_object(reply)`.

    The steps are columns of their own: the JSON parser is outside generated
    code, and whatever is nested in it would be computed again and again.
    """
    text, marked = f"_{name}_text", f"_{name}_marked"
    return (df.withColumn(text, candidate_object(reply))
            .withColumn(marked, _marked(F.col(text)))
            .withColumn(name, _whole(F.col(marked), F.col(text)))
            .drop(text, marked))


def usable(reply_object: Column, required: tuple[str, ...] = ()) -> Column:
    """Whether a parsed reply counts: not empty, required keys present."""
    found = F.coalesce(F.size(reply_object) > 0, F.lit(False))
    for key in required:
        found = found & F.coalesce(F.map_contains_key(reply_object, key), F.lit(False))
    return found


def field(reply_object: Column, key: str) -> Column:
    """The value of `key`, NULL when absent."""
    return F.element_at(reply_object, key)
