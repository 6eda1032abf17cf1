"""Issues by a schema against a plain walk over the parsed JSON."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrykit.operators.schema_check import DATE_TIME, schema_issues

SCHEMA = {
    "title": "a record", "type": "object", "required": ["id", "at", "config"],
    "properties": {
        "id": {"type": "integer", "minimum": 1, "maximum": 100}, "at": {"type": "string", "format": "date-time"},
        "config": {"type": "object", "required": ["on"], "properties": {"on": {"type": "boolean"}, "level": {"enum": [1, 2.5, "high", None, True]}}},
        "tags": {"type": "array", "items": {"type": "string", "minLength": 2, "pattern": "^[a-z]"}, "minItems": 1, "maxItems": 3},
        "audit": {"type": ["array", "null"], "items": {"type": "object", "required": ["by"], "properties": {"by": {"type": "string"}, "at": {"type": "number"}}}},
        "extra": {"type": "object", "properties": {"x": {"type": "string"}}, "additionalProperties": {"type": "number"}}, "none": {"additionalProperties": False},
    },
}
VALUES = [None, True, False, 0, 1, 7, 1.0, 2.5, -3, 1e300, "", "a", "ab", "Zb", "high", "2024-02-30T10:00:00Z", "2024-02-29T10:00:00Z", "2024-02-29", [], ["ab"], ["ab", None, 3], ["a", "b", "c", "d"], {}, {"on": 1}]


def kind(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, int | float):
        return "integer" if x == int(x) else "number"
    return {str: "string", list: "array", dict: "object"}[type(x)]


def issues(x, schema, path="$"):
    out, k = [], kind(x)
    if schema is False:
        return [f"{path}: not allowed"]
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        if k not in names and not (k == "integer" and "number" in names):
            out.append(f"{path}: not of type {' or '.join(names)}")
    if "enum" in schema and not any(x == y and isinstance(x, bool) == isinstance(y, bool) for y in schema["enum"]):
        out.append(f"{path}: not one of the allowed values")
    if k in ("integer", "number"):
        out += [f"{path}: beyond the {w} {schema[w]}" for w, bad in (("minimum", x < schema.get("minimum", x)), ("maximum", x > schema.get("maximum", x))) if bad]
    if k == "string":
        if len(x) < schema.get("minLength", 0):
            out.append(f"{path}: beyond the minLength {schema['minLength']}")
        if "pattern" in schema and not re.search(schema["pattern"], x):
            out.append(f"{path}: doesn't match the pattern")
        if "format" in schema and (not re.search(DATE_TIME, x) or x.startswith("2024-02-30")):
            out.append(f"{path}: no date-time")
    if k == "array":
        out += [f"{path}: beyond the {w} {schema[w]}" for w, bad in (("minItems", len(x) < schema.get("minItems", 0)), ("maxItems", len(x) > schema.get("maxItems", 99))) if bad]
        if "items" in schema:
            out += [i for n, y in enumerate(x) for i in issues(y, schema["items"], f"{path}[{n}]")]
    if k == "object":
        out += [f"{path}: missing {r}" for r in schema.get("required", []) if r not in x]
        for name, inner in schema.get("properties", {}).items():
            if name in x:
                out += issues(x[name], inner, f"{path}.{name}")
        more = schema.get("additionalProperties", True)
        if more is not True:
            out += [i for each in sorted(issues(x[n], more, f"{path}.{n}") for n in x if n not in schema.get("properties", {})) for i in each]
    return out


def made(rng, depth=0):
    if depth == 0 and rng.random() < 0.95:
        good = {"id": 5, "at": "2024-02-29T10:00:00+01:00", "config": {"on": True}, "tags": ["ab"], "audit": [{"by": "x", "at": 1.5}], "extra": {"x": "s", "y": 2}}
        for _ in range(rng.randrange(4)):
            good[rng.choice(list(SCHEMA["properties"]))] = made(rng, 1)
        if rng.random() < 0.3:
            good.pop(rng.choice(list(good)))
        return good
    if depth < 3 and rng.random() < 0.4:
        return {rng.choice(["on", "level", "by", "at", "x", "y", "z"]): made(rng, depth + 1) for _ in range(3)} if rng.random() < 0.6 else [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice(VALUES)


def test_issues_against_a_walk(spark):
    rng = random.Random(2)
    values = [made(rng) for _ in range(250)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "n long, raw string")
    got = {r.n: r.issues for r in df.select("n", schema_issues(F.col("raw"), SCHEMA).alias("issues")).collect()}
    for i, v in enumerate(values):
        assert got[i] == issues(v, SCHEMA), json.dumps(v)
    assert 20 < sum(not x for x in got.values()) < 230


def test_what_is_no_json(spark):
    df = spark.createDataFrame([(t,) for t in (None, "", " ", "{", '{"a": 1, "a": 2}', "nul", "null")], "raw string")
    assert [r.i for r in df.select(schema_issues(F.col("raw"), {"type": "null"}).alias("i")).collect()] == [["$: not JSON"]] * 6 + [[]]


def test_unknown_keywords_raise(spark):
    for schema in ({"oneOf": []}, {"properties": {"a": {"format": "email"}}}):
        with pytest.raises(ValueError, match="isn't known"):
            schema_issues(F.col("raw"), schema)


def test_a_text_is_parsed_once_and_asked_only_for_the_kinds_that_its_schema_tells_apart(spark):
    assert str(schema_issues(F.col("raw"), SCHEMA)).count("try_parse_json(raw)") == 1
    flat = str(schema_issues(F.col("raw"), {"type": "number", "maximum": 45}))
    assert "array<variant>" not in flat and "floor" not in flat.lower()
    assert "schema_of_variant" not in str(schema_issues(F.col("raw"), {"type": "object", "required": ["a"]}))
    rows = [("[1]", {"type": "number"}, 1), ('{"a": 1}', {"enum": [1]}, 1), ("1.0", {"type": "integer"}, 0), ("1.5", {"type": "integer"}, 1), ("1.5", {"type": ["integer", "number"]}, 0), ("1", {"required": ["a"]}, 0)]
    for raw, schema, n in rows:
        assert spark.range(1).select(F.size(schema_issues(F.lit(raw), schema))).first()[0] == n, (raw, schema)
