import json
import random

import pytest
from pyspark.sql import functions as F

from triptych.functions.replies import extract_object, field, strict_object, usable, with_object

REPLIES = [
    ('{"a": "1"}', {"a": "1"}),
    ('  {"a": "1"}\n', {"a": "1"}),
    ('```json\n{"a": "1"}\n```', {"a": "1"}),
    ('```\n{"a": "1"}\n```', {"a": "1"}),
    ('```{"a": "1"}```', {"a": "1"}),
    ('```json {"a": "1"}\n```', None),  # the fence line takes the object with it
    ('Sure:\n{"a": "1"}', {"a": "1"}),
    ('Sure:\n```json\n{"a": "1"}\n```', {"a": "1"}),
    ('{"a": "1"} Done.', None),
    ('a set {x} and {"a": "1"}', None),
    ("{}", {}),
    ("[1]", None),
    ('[{"a": "1"}]', None),
    ('"text"', None),
    ("", None),
    (None, None),
    ("{'a': '1'}", None),
    ('{"a": "1", "a": "2"}', {"a": "2"}),
    ('{"a": NaN}', {"a": '"NaN"'}),
    ('{"a": "1",}', None),
    ('{"a": "x\ny"}', None),
    ('{"a": "1"}]', None),
    ('{"a": "1"}}', None),
    ('{"a": "1"},{}]', None),
    ('{"a": "1"} {"b": "2"}', None),
    ('{"a": null}', {"a": None}),
    ('{"a": {"b": [1, "}"]}}', {"a": '{"b":[1,"}"]}'}),
    ('{"a": "جل بن مچھلی"}', {"a": "جل بن مچھلی"}),
]


def parsed(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    staged = with_object(df, F.col("t"), "o").select(
        "i", "o", extract_object(F.col("t")).alias("again"), usable(F.col("o")).alias("ok"))
    return staged.orderBy("i").collect()


def test_reply_table(spark):
    rows = parsed(spark, [t for t, _ in REPLIES])
    for (text, want), row in zip(REPLIES, rows, strict=True):
        assert row.o == want, text
        assert row.again == want, text
        assert row.ok is bool(want), text


def in_python(text):
    """The rule in plain Python, over the standard JSON parser."""
    if text.startswith("```") and "\n" in text:
        text = text[text.index("\n") + 1:]
    text = text.strip().removesuffix("```")
    ending = text[text.index("{"):] if "{" in text and text.rstrip().endswith("}") else "x"
    for part in (text, ending):
        try:
            value = json.loads(part)
        except ValueError:
            continue
        return value if isinstance(value, dict) else None
    return None


def test_random_texts_agree_with_python(spark):
    atoms = ["{", "}", '"a"', ":", "1", ",", "[", "]", " ", "\n", "```", "```json\n", '{"a":1}',
             '{"b":{"c":[1]}}', '"x}"', "\xa0", "text", "null", "NaN", "'a'", "\t", "\\", '""', "{}"]
    draw = random.Random(5)
    texts = ["".join(draw.choice(atoms) for _ in range(draw.randint(0, 7))) for _ in range(8000)]
    wanted = [in_python(t) for t in texts]
    assert sum(w is not None for w in wanted) > 300
    for text, want, row in zip(texts, wanted, parsed(spark, texts), strict=True):
        assert (row.o is None) == (want is None), text
        assert want is None or set(want) == set(row.o), text


def test_fields_and_required_keys(spark):
    df = spark.createDataFrame([('{"a": "1"}',), ('{"b": null}',)], "t string").select(
        strict_object(F.col("t")).alias("o"))
    rows = df.select(field(F.col("o"), "a").alias("a"), usable(F.col("o"), ("b",)).alias("ok")).collect()
    assert [(r.a, r.ok) for r in rows] == [("1", False), (None, True)]


@pytest.mark.parametrize("junk", ["x", "]", "}", ",", '"'])
def test_strict_object_takes_nothing_after_the_object(spark, junk):
    df = spark.createDataFrame([('{"a": "1"}' + junk,)], "t string")
    assert df.select(strict_object(F.col("t")).alias("o")).first().o is None
