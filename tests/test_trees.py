import json

import pytest

from sheafline.functions import trees
from sheafline.plans import handlers

ONE = {"body": [{"cells": [{"text": "a"}, {"text": "b"}]}]}


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ([["a ", "b"], [" "]], ONE),
        ({"rows": [["a", "b"]]}, ONE),
        ({"cells": ["a", {"text": " b "}]}, ONE),
        ({"body": [{"cells": ["a", {"text": "b"}, {"text": " "}]}, {"cells": []}]}, ONE),
        ({"table_ast": {"table": {"rows": [["a", "b"]]}}}, ONE),
        ({"title": " T ", "rows": [{"cells": ["a", "b"]}]}, {"caption": "T", **ONE}),
        ({"header": [["h"]], "body": [{"text": "x"}], "metadata": {"k": 1}}, {"header": [{"cells": [{"text": "h"}]}], "body": [{"cells": [{"text": "x"}]}], "metadata": {"k": 1}}),
        ({"body": [{"cells": [{"text": "x", "scope": "row", "colspan": 2, "rowspan": 0, "header": True}, {"text": "y", "scope": "odd", "colspan": True}]}]}, {"body": [{"cells": [{"text": "x", "header": True, "scope": "row", "colspan": 2}, {"text": "y"}]}]}),
        ({"header": [["h"]]}, None),
        ({"body": []}, None),
        ("text", None),
        (None, None),
        ([], None),
        ({"body": [{"rows": [["a", "b"], ["c"]]}]}, ONE),
    ],
)
def test_table_forms(given, want):
    assert trees.table(given) == want


def test_find_table():
    assert trees.find_table({"grid": [["a", "b"]], "rows": [["z"]]}) == ONE
    assert trees.find_table({"text": "x", "dump": {"data": 1, "cells": ["a", "b"]}}) == ONE
    assert trees.find_table({"text": "x"}) is None


def test_links_and_hash():
    assert trees.local_links({"a": "#/t/1", "b": ["#x", "#/y", {"c": "#/z", "n": 3}]}) == {"a": "/t/1", "b": ["#x", "/y", {"c": "/z", "n": 3}]}
    assert trees.canonical_hash({"b": 1, "a": "é"}) == trees.canonical_hash(json.loads('{"a": "é", "b": 1}'))
    assert trees.canonical_hash({"a": 1}) != trees.canonical_hash({"a": "1"})


SCHEMA = {"type": "object", "required": ["id", "n"], "additionalProperties": False, "properties": {"id": {"type": "string", "pattern": "^x"}, "n": {"type": "integer", "minimum": 1}, "kind": {"enum": ["a", "b"]}, "items": {"type": "array", "minItems": 1, "items": {"type": ["string", "null"]}}}}


def test_schema():
    assert trees.schema_errors({"id": "x1", "n": 2, "kind": "a", "items": ["q", None]}, SCHEMA) == []
    got = trees.schema_errors({"id": "y", "n": 0, "kind": "c", "items": [1], "more": 1}, SCHEMA)
    assert got == ["/: has more", "/id: is no such text", "/items/0: is no string or null", "/kind: is none of the values", "/n: is out of range"]
    assert trees.schema_errors({"id": "x", "n": True, "items": []}, SCHEMA) == ["/items: is too short", "/n: is no integer"]
    assert trees.schema_errors([], SCHEMA) == ["/: is no object"]


def test_over_json(spark):
    df = spark.createDataFrame([(1, '{"rows": [["a", "b"]]}'), (2, "no json"), (3, None), (4, "[]")], "id int, j string")
    got = {r.id: r.j for r in trees.over_json(df, "j", trees.table).collect()}
    assert json.loads(got[1]) == ONE and got[2] is None and got[3] is None and got[4] is None


def test_registry():
    r = handlers.Registry()
    r.add("a")(len)
    assert r.get("a")("xy") == 2
    with pytest.raises(KeyError):
        r.get("b")
    with pytest.raises(ValueError):
        r.add(" ")(len)
    assert handlers.PLANNERS.get("no such planner") is handlers.PLANNERS.get("internal")
    assert set(handlers.EXPORTERS.known) == {"txt", "html", "ast", "docx", "pdf"}


def test_outcomes():
    row = {"pos": 1, "deps": [], "selected": True, "satisfied": False, "lifecycle": "queued", "best": {"cost": 7, "method": "m"}}
    handlers.PLANNERS.add("broken")(lambda rows: 1 / 0)
    got = handlers.outcomes([row], ("internal", "broken"))
    assert (got[0]["status"], got[0]["steps"], got[0]["cost"]) == ("solved", 3, 7)
    assert got[1]["status"] == "failed" and got[1]["error"].startswith("ZeroDivisionError")
    assert handlers.outcomes([{**row, "best": None}], ("internal",))[0]["error"] == "no-method"


def test_describe(spark):
    df = spark.createDataFrame([(bytearray(b"abc"), "image", "old"), (None, "table", None)], "c binary, k string, f string")
    assert [r.description for r in handlers.describe(df, "size", "c", "k", "f").collect()] == ["image of 3 bytes", "table of 0 bytes"]
    assert [r.description for r in handlers.describe(df, "none", "c", "k", "f").collect()] == ["old", ""]
