"""Suppression, policy diff, cycles, clusters and the hint scanner on literal rows."""

import pytest
from pyspark.sql import functions as F

from girder.operators import shared
from girder.operators.graph import strong_components
from girder.plans import decide
from girder.plans.policy import DEFAULTS, Policy
from girder.catalogue import BASELINE, LOOSER
from girder.scratch import materialize

DIAG = "finding_id long, rule_id string, severity string, path string, line_start int, line_end int, subject string, detail string"
HINT = "pkg_ix int, file_ix int, item_ix long, path string, category string, rule string, expires string, target_start int, target_end int"
EXC = "rule string, target string, reason string, expires string, ix long"


def run(spark, diags, hints=(), excs=()):
    d = spark.createDataFrame([(i, *x, "s", None) for i, x in enumerate(diags)], DIAG)
    h = spark.createDataFrame([(0, 0, i, *x) for i, x in enumerate(hints)], HINT)
    e = spark.createDataFrame([(*x, i) for i, x in enumerate(excs)], EXC)
    return sorted((r["rule_id"], r["path"], r["line_start"], r["detail"]) for r in decide.suppress(d, h, e, "2024-06-01").collect())


D = ("OT004", "Fatal", "src/a.rs", 10, 12)


def test_today_is_live_and_prefix_is_case_sensitive(spark):
    assert run(spark, [D], [("src/a.rs", "allow", "OT", "2024-06-01", 11, 11)]) == []
    assert run(spark, [D], [("src/a.rs", "allow", "ot", None, 11, 11)]) == [("OT004", "src/a.rs", 10, None)]
    assert run(spark, [D], [("src/a.rs", "allow", "ot004", None, 11, 11)]) == []


def test_expired_then_live_notes_and_suppresses(spark):
    hints = [("src/a.rs", "allow", "OT004", "2024-05-31", 10, 10), ("src/a.rs", "allow", "*", None, 12, 14), ("src/a.rs", "allow", "*", "2020-01-01", 12, 14)]
    assert run(spark, [D], hints) == [("GOV001", "src/a.rs", 10, "2024-05-31")]


def test_exception_targets(spark):
    assert run(spark, [D], excs=[("OT004", "a.rs:11", "r", "2030-01-01")]) == []
    assert run(spark, [D], excs=[("OT004", "a.rs:13", "r", "2030-01-01")]) == [("OT004", "src/a.rs", 10, None)]
    assert run(spark, [D], excs=[("*", "*", "r", "2030-01-01")]) == []


def test_policy_diff_codes(spark):
    codes = sorted(r["code"] for r in decide.policy_diff(spark, LOOSER, BASELINE).collect())
    assert set(codes) == {"PG001", "PG002", "PG003", "PG004", "PG006", "PG007", "PG008", "PG009"}
    assert [r["code"] for r in decide.policy_diff(spark, LOOSER, None).collect()] == ["PG000"]
    soft = {r["code"]: r["severity"] for r in decide.policy_diff(spark, LOOSER, BASELINE, calibration=True).collect()}
    assert soft["PG001"] == "Advisory" and soft["PG006"] == "Fatal"
    assert decide.policy_diff(spark, Policy(), BASELINE).count() == 0  # an absent section shows no change


def test_policy_document():
    p = Policy.parse('{"sections": {"CX": {"fn_lines": 10}, "DG": "broken"}, "acknowledged": ["CF"]}')
    assert p.section("CX")["fn_lines"] == 10 and p.section("CX")["module_lines"] == 400
    assert p.section("DG") == DEFAULTS["DG"] and "CF" not in p.vacant() and "DG" in p.vacant()
    assert Policy.parse(p.text()) == p


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f"), ("f", "e")], "src string, dst string")
    assert sorted(tuple(r) for r in strong_components(e).collect()) == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("e", "e", 2), ("f", "e", 2)]
    assert strong_components(e.where("false")).count() == 0


def test_hint_scanner(spark):
    text = '// girder: ot canonical reason="main"\n#[derive(X)]\n\npub struct A;\nlet s = r#"\n// girder: allow FL\n"#;\n// girder: HotPath expires="2030-01-01"\nfn f() {}'
    got = shared.scan_hints(spark.createDataFrame([("a.rs", text)], "path string, text string")).orderBy("line_no").collect()
    assert [(r["line_no"], r["target_line"], r["words"], r["reason"], r["expires"]) for r in got] == [(1, 4, "ot canonical", "main", None), (8, 9, "hot_path", None, "2030-01-01")]


@pytest.mark.parametrize("path,module", [("src/lib.rs", "my_pkg"), ("src/a/mod.rs", "my_pkg::a"), ("x/src/a/b.rs", "my_pkg::a::b"), ("build.rs", None), ("src/main.rs", "my_pkg")])
def test_module_path(spark, path, module):
    row = spark.createDataFrame([(path, "my-pkg")], "p string, k string").select(shared.module_path(F.col("p"), F.col("k"))).first()
    assert row[0] == module


def test_changed_files_need_a_path_boundary(spark):
    d = spark.createDataFrame([(0, "X", "Fatal", "src/a.rs", 1, 1, "s", None), (1, "X", "Fatal", "src/ba.rs", 1, 1, "s", None)], DIAG)
    c = spark.createDataFrame([("a.rs",)], "path string")
    assert [r["path"] for r in decide.changed_only(d, c).collect()] == ["src/a.rs"]


def test_crowded_files_meet_their_marks_as_others_do(spark, monkeypatch):
    diags = [("OT004", "Fatal", "src/a.rs", i, i + 2) for i in range(1, 40)] + [("FL002", "Fatal", "src/b.rs", None, None), D]
    hints = [("src/a.rs", "allow", rule, expires, at, at + width) for at, (rule, expires, width) in enumerate([("OT", "2024-05-31", 3), ("*", None, 0), ("ot004", "2020-01-01", 1), ("FL", None, 9)] * 5)]
    excs = [("OT004", "a.rs:31", "r", "2030-01-01"), ("ot", "src/a.rs", "r", "2020-01-01"), ("fl002", "b.rs", "r", "2023-01-01"), ("*", "*", "r", "2022-01-01")]
    few = run(spark, diags, hints, excs)
    monkeypatch.setattr(decide, "CROWD", 0)
    assert run(spark, diags, hints, excs) == few and ("GOV001", "src/b.rs", None, "2023-01-01") in few


def test_findings_of_one_place_are_looked_at_once(spark):
    """200,000 findings of one place and one hint: as many allowances as places."""
    d = spark.range(200_000).selectExpr("id as finding_id", "'OT004' as rule_id", "'Fatal' as severity", "'src/a.rs' as path", "10 as line_start", "12 as line_end", "concat('s', id) as subject", "cast(null as string) as detail")
    h = spark.createDataFrame([(0, 0, 1, "src/a.rs", "allow", "OT", None, 11, 11)], HINT)
    assert decide.allowances(d, h, spark.createDataFrame([], EXC), "2024-06-01").count() == 1


def test_decisions_meet_findings_without_a_broadcast(spark):
    """Ids are a few bytes a row on disk and many in memory, so a table's files say little of what the driver would hold."""
    f = materialize(spark.createDataFrame([(1, "X", "Fatal", "a.rs", 1, 1, "s", None)], DIAG), "few")
    d = materialize(decide.passed(f), "few")
    left = decide.pass_through().decide(f, None, d)
    for df in (decide.materialise(f, d), left, decide.undecided(f, d)):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
