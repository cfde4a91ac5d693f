"""API collection flattening and chunk text on the nested fixture."""

import json

from storyloom.operators import endpoints

COLLECTION = {"item": [
    {"name": "Folder A", "item": [
        {"name": "Folder B", "item": [{"name": "Get one", "request": {
            "method": "GET",
            "url": {"protocol": "https", "host": ["api", "x", "com"], "path": ["2", "items", ":id"],
                    "query": [{"key": "q", "description": "text"}, {"key": "off", "disabled": True}],
                    "variable": [{"key": "id", "description": "item id"}]},
            "description": "from request"},
            "response": [{"name": "ok", "code": 200, "status": "OK"}]}]},
        {"name": "Post one", "request": {"method": "POST", "url": "https://x/y"}}]},
    {"name": "Neither folder nor request"},
    {"name": "Root endpoint", "request": {}}]}


def test_collection_to_endpoints(spark):
    df = spark.createDataFrame([(1, json.dumps(COLLECTION))], "collection_id long, json string")
    eps = {r.name: r for r in endpoints.extract_endpoints(df).collect()}
    assert set(eps) == {"Get one", "Post one", "Root endpoint"}
    g = eps["Get one"]
    assert (g.category, g.method, g.url, g.description) == ("Folder A > Folder B", "GET", "https://api.x.com/2/items/:id", "from request")
    assert [(p.key, p.disabled) for p in g.parameters] == [("q", False), ("off", True)]
    assert [(v.key, v.type) for v in g.path_variables] == [("id", "string")]
    assert [(x.name, x.code) for x in g.response_examples] == [("ok", 200)]
    assert (eps["Post one"].category, eps["Post one"].url) == ("Folder A", "https://x/y")
    r = eps["Root endpoint"]
    assert (r.category, r.method, r.url) == ("General", "GET", "https:///")
    chunks = {c.metadata.endpoint_name: c.text for c in endpoints.endpoint_chunks(endpoints.extract_endpoints(df)).collect()}
    assert "  - q: text" in chunks["Get one"] and "off" not in chunks["Get one"]
    assert chunks["Get one"].startswith("Endpoint: Get one\nCategory: Folder A > Folder B\nMethod: GET\nURL: https://api.x.com/2/items/:id\n\nDescription: from request")
    assert "\n\nResponse Examples:\n  - ok (HTTP 200)" in chunks["Get one"]
