import math

import pytest
from pyspark.sql import functions as F

from vecshelf.functions import text, vector


def one(spark, expression, **columns):
    names = list(columns) or ["_"]
    frame = spark.createDataFrame([tuple(columns.values()) or (1,)], names)
    return frame.select(expression.alias("x")).first()["x"]


def doc(spark, json, expression):
    frame = spark.createDataFrame([(json,)], "json string")
    return frame.withColumn("doc", F.try_parse_json("json")).select(expression.alias("x")).first()["x"]


def vectors(spark, a, b=None):
    schema = "a array<double>, b array<double>"
    return spark.createDataFrame([(a, b)], schema)


@pytest.mark.parametrize(
    "value, year",
    [("May 1984", 1984), ("1984", 1984), ("n.d.", None), (None, None), ("c. 20011", 2001), ("", None)],
)
def test_extract_year(spark, value, year):
    frame = spark.createDataFrame([(value,)], "d string")
    assert frame.select(text.extract_year("d")).first()[0] == year


@pytest.mark.parametrize(
    "json, expected",
    [
        ('{"description": {"type": "/type/text", "value": "told"}}', "told"),
        ('{"description": "plain"}', "plain"),
        ('{"description": "{not an object}"}', "{not an object}"),
        ('{"description": null}', None),
        ('{"description": {"type": "/type/text"}}', None),
        ("{}", None),
    ],
)
def test_unwrap_text(spark, json, expected):
    assert doc(spark, json, text.unwrap_text("doc", "description")) == expected


@pytest.mark.parametrize(
    "json, substring, whole",
    [
        ('{"subjects": ["Science Fiction"]}', True, True),
        ('{"subjects": ["Nonfiction"]}', True, False),
        ('{"subjects": "FICTION, general"}', True, True),
        ('{"subjects": ["History"]}', False, False),
        ('{"title": "fiction"}', False, False),
    ],
)
def test_subject_match(spark, json, substring, whole):
    assert doc(spark, json, text.subject_match("doc")) is substring
    assert doc(spark, json, text.subject_match("doc", whole_word=True)) is whole


def test_json_arrays_and_fields(spark):
    assert doc(spark, '{"s": ["x", 1]}', text.json_string_array("doc", "$.s")) == ["x", "1"]
    assert doc(spark, '{"s": "x"}', text.json_string_array("doc", "$.s")) is None
    assert doc(spark, '{"a": {"b": [5, 6]}}', text.json_field("doc", "$.a.b[1]")) == "6"
    assert doc(spark, '{"a": null}', text.json_field("doc", "$.a")) is None


def test_text_match_is_literal_and_case_insensitive(spark):
    frame = spark.createDataFrame([("100% Dune", None), ("a\\b", "x_y")], "t string, u string")
    hits = lambda q: [r[0] for r in frame.select(text.text_match(["t", "u"], q)).collect()]
    assert hits("DUNE") == [True, False]
    assert hits("%") == [True, False]
    assert hits("_") == [False, True]
    assert hits("\\") == [False, True]


def test_input_text_and_keys(spark):
    frame = spark.createDataFrame([("A", "T"), (None, "T")], "a string, t string")
    rows = frame.select(text.input_text("a", "t"), text.content_key("t")).collect()
    assert rows[0][0] == "Book|A|T" and rows[1][0] is None
    assert len(rows[0][1]) == 64
    assert one(spark, text.strip_prefix(F.lit("/works/OL1W"))) == "OL1W"


def test_vector_functions(spark):
    row = vectors(spark, [3.0, 4.0], [4.0, 3.0]).select(
        vector.dot("a", "b"), vector.cosine("a", "b"), vector.l2_distance("a", "b"), vector.l2_norm("a")
    ).first()
    assert row[0] == 24 and row[3] == 5
    assert math.isclose(row[1], 0.96) and math.isclose(row[2], math.sqrt(2))


def test_zero_vector(spark):
    frame = vectors(spark, [0.0, 0.0], [1.0, 2.0])
    row = frame.select(vector.l2_normalize("a"), vector.cosine("a", "b"), vector.l2_normalize("b")).first()
    assert row[0] == [0.0, 0.0] and row[1] is None
    assert math.isclose(sum(x * x for x in row[2]), 1.0)
