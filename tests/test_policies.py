"""Rules without a policy, files without a module path, registries, inventories and documents on small tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from girder import catalogue
from girder.operators import shared
from girder.operators.graph import strong_components, trimmed
from girder.plans import decide, report, survey
from girder.plans.policy import Policy
from girder.plans.rules import RULES, Facts
from girder.sources.projection import StarFacts

DATA = "/root/testdata/sf0.001"
#: Rules that say nothing before the policy names an owner, a path or a pattern.
SILENT = [
    "FL001", "FL002", "FL003", "FL004", "FL005", "FL006", "FL007", "FL010", "FL011", "FL012", "FL013", "RW001", "RW002", "RW003", "RW004", "CF001", "CF002", "CF003", "OB001", "OB002", "OB003", "ER005",
    "CX008", "DG001", "DG003", "DG004", "BO001", "BO002", "BO004", "BO005", "CR001", "CR002", "ER003", "PA002", "PA003", "PA004", "RM001", "RM002", "RM003", "RM004", "RM005", "RM006", "FO001", "FO004",
    "TA001", "TA002", "TA003", "TA004", "UT001", "UT002", "UT003", "UT004", "UT005", "CL001", "DC001", "DA001", "DA002", "DA007",
]
NEEDS = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@NEEDS
def test_rules_are_silent_without_a_policy(spark):
    x = Facts(StarFacts(spark, DATA), Policy())
    rows = decide.observe(x, SILENT)
    assert rows.count() == 0


@NEEDS
def test_files_without_a_module_path_are_passed_over(spark):
    """Every place of the facts put into a file without one: what remains is of rules that read no module path."""
    tables = StarFacts(spark, DATA)

    class Lost:
        def __getitem__(self, name):
            df = tables[name]
            return df.withColumn("module_path", F.lit(None).cast("string")) if "module_path" in df.columns else df

    placed = ["CX001", "CX002", "FL002", "FL005", "FL013", "MO001", "MO002", "MO003", "MO004", "RW003", "RW004", "CF002", "CF003", "OB002", "OB003", "ER005"]
    assert decide.observe(Facts(Lost(), catalogue.SAMPLE), placed).count() == 0


def test_rule_ids_begin_with_their_family():
    from girder.plans.policy import DEFAULTS

    assert len(RULES) == 90 and all(i[:2] in DEFAULTS and i[2:].isdigit() for i in RULES)


def test_strict_mode_raises_what_is_narrowed(spark):
    rows = [("CX001", "Warning", True), ("CX001", "Warning", False), ("FL002", "Warning", True), ("DC002", "Advisory", True)]
    got = decide.elevate(spark.createDataFrame(rows, "rule_id string, severity string, narrowed boolean")).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [("CX001", "Fatal", True), ("CX001", "Warning", False), ("DC002", "Advisory", True), ("FL002", "Fatal", True)]


def test_path_pairs(spark):
    a = spark.createDataFrame([("src/lib.rs",), ("x/b.rs",), ("lib.rs",)], "p string")
    b = spark.createDataFrame([("b.rs",), ("lib.rs",), ("deep/x/b.rs",), ("",)], "p string")
    assert sorted(tuple(r) for r in shared.path_pairs(a, b).collect()) == [("lib.rs", "b.rs"), ("lib.rs", "lib.rs"), ("src/lib.rs", "b.rs"), ("src/lib.rs", "lib.rs"), ("x/b.rs", "b.rs"), ("x/b.rs", "deep/x/b.rs")]
    assert sorted(tuple(r) for r in shared.path_pairs(a, b, at_boundary=True).collect()) == [("lib.rs", "lib.rs"), ("src/lib.rs", "lib.rs"), ("x/b.rs", "b.rs"), ("x/b.rs", "deep/x/b.rs")]


def test_a_decision_twice_or_never_is_reported(spark):
    f = spark.createDataFrame([(1,), (2,), (3,)], "finding_id long")
    d = spark.createDataFrame([(1,), (2,), (2,)], "finding_id long")
    assert sorted(tuple(r) for r in decide.undecided(f, d).collect()) == [(2, 2), (3, 0)]


def test_materialise(spark):
    f = spark.createDataFrame([(1, "CX001", None, None, None, "s", "d"), (2, "FL002", "a.rs", 3, 4, "s", None), (3, "FL002", "a.rs", 5, 6, "s", None)], "finding_id long, rule_id string, path string, line_start int, line_end int, subject string, detail string")
    d = spark.createDataFrame([(1, "Active", "Fatal", "GOV009", "why"), (2, "Advisory", "Advisory", None, None), (3, "Suppressed", "Warning", None, None)], "finding_id long, status string, severity string, code string, why string")
    got = sorted((r["rule_id"], r["severity"], r["path"], r["line_start"], r["detail"]) for r in decide.materialise(f, d).collect())
    assert got == [("FL002", "Advisory", "a.rs", 3, ""), ("GOV009", "Fatal", "policy.json", 1, "d; why")]


def test_cycles_are_found_after_trimming(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(30)]
    e = spark.createDataFrame([*chain, ("n30", "n28"), ("x", "n0"), ("y", "y")], "src string, dst string")
    assert sorted(tuple(r) for r in trimmed(e).collect()) == [("n28", "n29"), ("n29", "n30"), ("n30", "n28")]
    assert sorted(tuple(r) for r in strong_components(e).collect()) == [("n28", "n28", 3), ("n29", "n28", 3), ("n30", "n28", 3)]


DIAG = "rule_id string, severity string, path string, line_start int, line_end int, subject string, detail string"


def test_documents(spark, tmp_path):
    rows = [("FL002", "Warning", "b.rs", 0, 0, 'say "x"', None), ("CX001", "Fatal", "a.rs", 3, 9, "f", "70/50"), ("CX001", "Fatal", "a.rs", 1, 2, "g", "60/50")]
    d = spark.createDataFrame(rows, DIAG)
    made = {"text": report.text_document(d), "json": report.json_document(d), "sarif": report.sarif_document(d)}
    text = {}
    for name, lines in made.items():
        report.write_document(lines, str(tmp_path / name))
        parts = [p for p in (tmp_path / name).iterdir() if p.name.startswith("part")]
        assert len(parts) == 1
        text[name] = parts[0].read_text()
    assert text["text"].splitlines()[-1] == "2 fatal, 1 warning, 0 advisory" and text["text"].splitlines()[0].startswith("FATAL    CX001 a.rs:1 g")
    doc = json.loads(text["json"])
    assert doc["schema_version"] == 1 and len(doc["diagnostics"]) == 3 and doc["summary"] == {"fatal": 2, "warning": 1, "advisory": 0} and "detail" not in doc["diagnostics"][2]
    run = json.loads(text["sarif"])["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["CX001", "FL002"] and len(run["results"]) == 3
    assert run["results"][2]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "endLine": 1}
    none = d.where("false")
    assert json.loads("".join(r["line"] for r in report.json_document(none).orderBy("ix").collect()))["diagnostics"] == []
    assert [r["line"] for r in report.text_document(none).collect()] == ["clean: nothing found"]


def test_unknown_kind(spark):
    with pytest.raises(ValueError, match="unknown kind"):
        survey.by_kind(None, "colour")


def test_runtime_calls(spark):
    calls = [
        ("std::process::Command::spawn", "Function"), ("std::process::Command::wait_with_output", "Function"), ("fs::open", "Function"), ("fs::create", "Function"), ("fs::symlink", "Function"),
        ("my::println", "Meta"), ("println", "Meta"), ("log::warn", "Meta"), ("fs::write", "Method"), ("respawn", "Function"),
    ]
    df = spark.createDataFrame([(0, 0, i, "a.rs", 1, 1, "f", c, k) for i, (c, k) in enumerate(calls)], "pkg_ix int, file_ix int, item_ix long, path string, line_start int, line_end int, function string, callee string, call_kind string")
    got = sorted((r["evidence"], r["kind"]) for r in shared.classify_calls(df).collect())
    assert got == sorted([
        ("std::process::Command::spawn", "SpawnedWork"), ("std::process::Command::spawn", "ExternalIo"), ("std::process::Command::wait_with_output", "ExternalIo"), ("std::process::Command::wait_with_output", "BlockingCall"),
        ("fs::open", "BlockingCall"), ("fs::symlink", "PersistenceWrite"), ("println", "Logging"), ("log::warn", "Logging"),
    ])
