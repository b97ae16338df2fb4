"""JSON schemas whose references lead to other parts, other files and back."""

import json

import pytest

from factloom.sources import extract


def fields(spark, **kw):
    def run(docs):
        f = spark.createDataFrame([(p, d if isinstance(d, str) else json.dumps(d)) for p, d in docs.items()], "path string, text string")
        out = {}
        for r in extract.schema_fields(f, **kw).collect():
            out.setdefault(r.path, set()).add(r.field)
        return out

    return run


def test_references(spark):
    got = fields(spark)({
        "s/order.json": {"type": "object", "properties": {
            "id": {"type": "string"}, "buyer": {"$ref": "../common/person.json"}, "seller": {"$ref": "../common/person.json"}, "lines": {"type": "array", "items": {"$ref": "#/definitions/line"}},
            "lost": {"$ref": "nowhere.json"}, "grid": {"type": "array", "items": {"type": "array", "items": {"type": "number"}}}, "empty": {"properties": {}}, "odd": "text"},
            "definitions": {"line": {"properties": {"sku": {}, "parent": {"$ref": "#/definitions/line"}}}}},
        "common/person.json": {"properties": {"name": {}, "friend": {"$ref": "./person.json"}, "order": {"$ref": "s/order.json#/definitions/line"}}},
        "plain.json": {"type": "String"}, "list.json": {"type": "array", "items": {"properties": {"a": {}}}}, "broken.json": "{", "not.txt": "{}",
    })
    person = lambda p: {f"{p}", f"{p}.name", f"{p}.order", f"{p}.order.sku"}
    assert got["s/order.json"] == {"id", "lines", "lines[]", "lines[].sku", "grid", "grid[]", "grid[][]", "empty"} | person("buyer") | person("seller")
    # a reference back to the schema it starts in is followed once
    assert got["common/person.json"] == {"name", "order", "order.sku", "friend", "friend.name", "friend.order", "friend.order.sku"}
    assert got["plain.json"] == {"string"} and got["list.json"] == {"[]", "[].a"} and set(got) == {"s/order.json", "common/person.json", "plain.json", "list.json"}


@pytest.mark.parametrize(("most", "want"), [(2, {"a", "a[]"}), (3, {"a", "a[]", "a[].b"}), (12, {"a", "a[]", "a[].b", "a[].b.c"})])
def test_items_take_a_level(spark, most, want):
    doc = {"properties": {"a": {"type": "array", "items": {"properties": {"b": {"properties": {"c": {}}}}}}}}
    assert fields(spark, most_depth=most)({"x.json": doc}) == {"x.json": want}


def test_operation_schemas(spark):
    body = lambda ref, kind="application/json": {"content": {kind: {"schema": {"$ref": ref}}}}
    spec = {"paths": {"/a/{id}": {
        "get": {"responses": {"404": body("./err.json"), "200": {"description": "none"}, "201": body("./a.json")}}, "post": {"requestBody": {"content": {"a/x": {"schema": {"$ref": "x.json"}}, "application/json": {"schema": {"items": {"$ref": "in.json"}}}}}, "responses": {"500": body("../e.json", "z")}},
        "delete": {}, "parameters": {}}}}
    f = spark.createDataFrame([("api/offers-spec.json", json.dumps(spec)), ("api/x.bundled.json", json.dumps(spec))], "path string, text string")
    got = {(r.operation_id, r.request_schema, r.response_schema) for r in extract.operation_schemas(f).collect()}
    assert got == {("offers|GET|/a/{*}", None, "api/a.json"), ("offers|POST|/a/{*}", "in.json", "e.json"), ("offers|DELETE|/a/{*}", None, None)}
