from __future__ import annotations

import json

from brookcheck.operators import documents as D

GOOD = {"metadata": {"name": " meters ", "labels": {" site ": " north ", " ": "y", "z": " "}}, "bindings": [{"name": "gauges", "topic": "plant.gauges"}],
        "fields": [{"name": "gauge", "type": "STRING", "required": True}, {"name": "unit", "type": "string"}, {"name": "level", "type": "number"}, {"name": "taken", "type": "timestamp"}],
        "rules": [{"name": "has_level", "field": "level", "operator": "required"}, {"name": "in_bar", "field": "unit", "operator": "equals", "expected_value": "bar", "severity": "warn"}]}


def verdicts(spark, *docs):
    rows = [(i, f, c if isinstance(c, str) else json.dumps(c)) for i, (f, c) in enumerate(docs)]
    df = D.validate_documents(spark.createDataFrame(rows, "i int, format string, content string"))
    return [r.asDict(recursive=True) for r in df.orderBy("i").collect()]


def test_one_document_in_json_and_yaml(spark):
    yaml = "metadata:\n  name: meters\n  labels: {site: north}\nbindings:\n  - {topic: plant.gauges, name: gauges}\nfields:\n  - {type: string, name: gauge, required: true}\n  - {type: string, name: unit}\n  - {type: number, name: level}\n  - {type: timestamp, name: taken}\nrules:\n  - {name: has_level, operator: required, field: level}\n  - {name: in_bar, operator: equals, field: unit, expected_value: bar, severity: warn}\n"
    a, b = verdicts(spark, (" JSON ", GOOD), ("yaml", yaml))
    assert a["valid"] and b["valid"] and a["definition_checksum"] == b["definition_checksum"]
    assert a["metadata"] == {"name": "meters", "description": "", "labels": {"site": "north"}}


def test_canonical_json(spark):
    import hashlib

    doc = GOOD | {"metadata": {"name": "a<b&c>", "description": 'q"\n'}}
    want = ('{"metadata":{"name":"a\\u003cb\\u0026c\\u003e","description":"q\\""},"bindings":[{"name":"gauges","topic":"plant.gauges"}],"fields":[{"name":"gauge","type":"string","required":true},{"name":"unit","type":"string"},{"name":"level","type":"number"},{"name":"taken","type":"timestamp"}],'
            '"rules":[{"name":"has_level","field":"level","operator":"required"},{"name":"in_bar","field":"unit","operator":"equals","expected_value":"bar","severity":"warn"}]}')
    assert verdicts(spark, ("json", doc))[0]["definition_checksum"] == hashlib.sha256(want.encode()).hexdigest()


# Paths and messages of diagnostics.
def test_diagnostics(spark):
    bad = {"metadata": {"name": ""}, "bindings": [{"name": "b", "topic": "t"}, {"name": "b", "topic": "t"}, {"name": " ", "topic": ""}], "fields": [{"name": "x", "type": "money"}, {"name": "x", "type": "string"}],
           "rules": [{"name": "r", "field": "status", "operator": "required"}, {"name": "r", "field": "", "operator": "like", "severity": "fatal"}, {"name": "q", "field": "x", "operator": "equals"}]}
    got = [(d["field"], d["message"]) for d in verdicts(spark, ("json", bad))[0]["diagnostics"]]
    assert got == [("metadata.name", "must not be empty"), ("bindings[1].name", "must be unique"), ("bindings[1].topic", "must be unique"), ("bindings[2].name", "must not be empty"), ("bindings[2].topic", "must not be empty"),
                   ("fields[0].type", "must be one of string, integer, number, boolean or timestamp"), ("fields[1].name", "must be unique"), ("rules[0].field", "must reference an existing field"), ("rules[1].field", "must not be empty"),
                   ("rules[1].operator", "must be one of required, not_empty or equals"), ("rules[1].severity", "must be one of error or warn"), ("rules[1].name", "must be unique"), ("rules[2].expected_value", "must not be empty when operator is equals")]


def test_bad_sources(spark):
    got = verdicts(spark, ("json", "{bad"), ("json", "[1]"), ("yaml", "a: [1"), ("toml", "x"), ("json", "  "), ("json", "{}"), ("json", '{"rules": 3}'))
    assert [d["diagnostics"][0]["message"] for d in got] == ["must be valid JSON", "must be valid JSON", "must be valid YAML", "must be one of json or yaml", "must not be empty", "must not be empty", "must be valid JSON"]
    assert [d["field"] for d in got[5]["diagnostics"]] == ["metadata.name", "bindings", "fields", "rules"]


def test_a_document_is_parsed_once(spark, capsys):
    """However many members, diagnostics and checksums are read from it, and filters on them too."""
    df = D.validate_documents(spark.createDataFrame([("s", "v", "json", json.dumps(GOOD))], "set_id string, version_id string, format string, content string"))
    D.compile_versions(df.where("valid")).explain()
    plan = capsys.readouterr().out
    assert plan.count("from_json(") == 1 and plan.count("parse_json(") + plan.count("ParseJson") <= 2


def test_yaml_reads_the_same_in_both_loaders():
    import yaml

    def read(text, loader):
        try:
            return yaml.load(text, Loader=loader)
        except yaml.YAMLError:
            return "bad"

    for text in ("a: {b: [1, 2.5, 1e3, yes, ~, 2024-01-01]}", 'x: "\\u00e9 \\" q"\ny: |\n  two\n  lines\n', "k: \u00e9 \U0001f600", "k: a\u2028b", "a: [1", "a: &x {b: 1}\nc: *x\n", json.dumps(GOOD)):
        assert read(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) == read(text, yaml.SafeLoader)
