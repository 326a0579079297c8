"""Fact documents end to end: a hinted canonical, its boundary, a shadow type, conversions, a leak, literals and facts."""

import json

import pytest

from girder.plans import decide
from girder.plans.policy import Policy
from girder.plans.rules import RULES, Facts
from girder.sources.fact_json import JsonFacts, write_facts


def span(a, b=None, file="src/identity.rs"):
    return {"file": file, "line_start": a, "line_end": b or a}


def typ(name, symbol, a, fields, file="src/identity.rs", **more):
    fs = [{"name": f, "type_text": "String", "visibility": "Public"} for f in fields]
    return {"kind": "Type", "type_kind": "Struct", "name": name, "symbol": symbol, "visibility": "Public", "fields": fs, "variants": [], "decorators": [], "span": span(a, a + 5, file), "doc": None} | more


USER = ["id", "email", "display_name"]
DOC = {
    "schema_version": 14,
    "packages": [
        {"name": "sample", "version": "0.1.0", "root_dir": ".", "files": [
            {"path": "src/dto.rs", "module_path": "sample::dto", "line_count": 40, "parse_error": None, "hints": [{"kind": {"category": "boundary", "concept": "user"}, "raw": "", "span": span(1), "target_span": span(3, file="src/dto.rs")}],
             "items": [typ("UserDto", "sample::dto::UserDto", 2, USER, "src/dto.rs"), {"kind": "Conversion", "from": "UserDto", "to": "User", "mechanism": "TryFrom", "symbol": "sample::dto::try_from", "span": span(20, 24, "src/dto.rs")}]},
            {"path": "src/handler.rs", "module_path": "sample::handler", "line_count": 20, "parse_error": None, "hints": [],
             "items": [{"kind": "Function", "name": "create_user", "symbol": "sample::handler::create_user", "visibility": "Public", "params": [["dto", "UserDto"]], "return_type": "User", "span": span(1, 60, "src/handler.rs"), "line_count": 60, "doc": None, "decorators": []},
                       {"kind": "TruthAction", "action": "construct", "target": "User", "function": "sample::handler::create_user", "span": span(4, 5, "src/handler.rs"), "confidence": 0.9, "reasons": []},
                       {"kind": "str", "value": "\"gpt-9\"", "context": "match_arm", "function": "sample::handler::create_user", "span": span(6, 6, "src/handler.rs")}]},
            {"path": "src/identity.rs", "module_path": "sample::identity", "line_count": 20, "parse_error": None, "hints": [{"kind": {"category": "canonical"}, "raw": "", "span": span(1), "target_span": span(2)}], "items": [typ("User", "sample::identity::User", 2, USER)]},
            {"path": "src/shadow.rs", "module_path": "sample::shadow", "line_count": 8, "parse_error": None, "hints": [], "items": [typ("UserModel", "sample::shadow::UserModel", 1, USER, "src/shadow.rs")]},
            {"path": "src/broken.rs", "module_path": None, "line_count": 1, "parse_error": "unexpected", "hints": [], "items": []},
        ]}
    ],
    "facts": [{"kind": "spawned_work", "target": {"scope": "Function", "symbol": "sample::handler::create_user"}, "source": "s", "confidence": 0.9, "reasons": [], "evidence": "spawn"}],
}
CONCEPTS = {"user": {"canonical": "sample::identity::User", "boundaries": ["sample::dto::UserDto"], "converters": []}}


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("facts") / "workspace.json"
    p.write_text(json.dumps(DOC))
    return str(p)


def subjects(spark, path, rule, sections):
    policy = Policy(sections)
    return [r["subject"] for r in RULES[rule].observe(Facts(JsonFacts(spark, path, policy), policy)).collect()]


def test_before_and_after_concepts_are_declared(spark, path):
    assert subjects(spark, path, "OT002", {}) == ["sample::shadow::UserModel"]
    for quiet in ("OT001", "OT003", "OT004", "OT006"):
        assert subjects(spark, path, quiet, {}) == []
    ot = {"OT": {"concepts": CONCEPTS}}
    assert subjects(spark, path, "OT003", ot) == ["sample::handler::create_user"]
    assert subjects(spark, path, "OT004", ot) == ["sample::handler::create_user"]
    assert subjects(spark, path, "OT006", ot) == ["sample::dto::try_from"]
    known = {"user": CONCEPTS["user"] | {"converters": [{"symbol": "sample::dto::try_from", "from": "UserDto", "to": "User"}]}}
    assert subjects(spark, path, "OT006", {"OT": {"concepts": known}}) == []


def test_budgets_literals_and_facts(spark, path):
    assert subjects(spark, path, "CX001", {}) == ["sample::handler::create_user"]
    assert subjects(spark, path, "CX001", {"CX": {"fn_lines": 80}}) == []
    assert subjects(spark, path, "CF003", {"CF": {"id_patterns": ["gpt-*"]}}) == []  # silent until a config layer is named
    assert subjects(spark, path, "CF003", {"CF": {"id_patterns": ["gpt-*"], "config_paths": ["sample::config"]}}) == ["sample::handler::create_user"]
    assert subjects(spark, path, "RW001", {"RW": {"owner_paths": ["sample::dto"]}}) == ["sample::handler::create_user"]


def test_every_rule_runs_on_documents(spark, path):
    policy = Policy({"OT": {"concepts": CONCEPTS}})
    found = decide.observe(Facts(JsonFacts(spark, path, policy), policy))
    assert found.count() == found.select("finding_id").distinct().count() > 0


def test_written_documents_read_the_same(spark, path, tmp_path):
    facts = JsonFacts(spark, path)
    write_facts(facts, str(tmp_path / "out"))
    again = JsonFacts(spark, str(tmp_path / "out"))
    for t in ("air_file", "air_type", "air_field", "air_param", "air_literal", "air_fact", "air_hint"):
        assert sorted(map(str, again[t].collect())) == sorted(map(str, facts[t].collect())), t
