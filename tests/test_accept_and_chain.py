"""Acceptance of proposals, pattern tables, the policy chain, explained rules and the workspace source on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from girder.functions.patterns import segments
from girder.operators.pattern_join import first_patterns
from girder.operators.shared import scan_hints
from girder.plans import accept, decide, report
from girder.sources.workspace import read_workspace

CONCEPTS = "concept string, role string, symbol string, boundary string, source string"
PROPOSALS = "ix long, role string, symbol string, concept string, boundary string, force boolean"


def test_proposals(spark):
    types = spark.createDataFrame([("a::User", "User"), ("b::UserDto", "UserDto"), ("c::Order", "Order"), ("d::OrderDto", "OrderDto"), ("e::Order", "Order"), ("f::User", "User")], "symbol string, name string")
    now = spark.createDataFrame([("user", "canonical", "a::User", None, "Hinted"), ("user", "boundary", "b::UserDto", "v1", "Hinted")], CONCEPTS)
    rows = [
        (1, "canonical", "a::User", None, None, False), (2, "canonical", "f::User", "user", None, False), (3, "boundary", "b::UserDto", "user", "v2", False), (4, "canonical", "c::Order", None, None, False),
        (5, "canonical", "e::Order", None, None, False), (6, "boundary", "d::OrderDto", "order", "wire", None), (7, "boundary", "d::OrderDto", "order", "wire", None), (8, "boundary", "d::OrderDto", "gone", None, None),
        (9, "boundary", "", "order", None, None), (10, "boundary", "x::Y", "order", None, None), (11, "boundary", "a::User", "user", None, None), (12, "boundary", "b::UserDto", "order", None, None), (13, "boundary", None, None, None, None),
    ]
    said = accept.outcomes(spark.createDataFrame(rows, PROPOSALS), now, types)
    got = {x.ix: x.outcome for x in said.collect()}
    assert got == {1: "confirmed", 2: "conflict", 3: "refreshed", 4: "added", 5: "conflict", 6: "added", 7: "duplicate", 8: "unknown concept", 9: "empty", 10: "unknown symbol", 11: "already canonical", 12: "in another concept", 13: "empty"}
    after = {tuple(x) for x in accept.merged(now, said).collect()}
    assert after == {("user", "canonical", "a::User", None, "Accepted"), ("user", "boundary", "b::UserDto", "v2", "Accepted"), ("order", "canonical", "c::Order", None, "Accepted"), ("order", "boundary", "d::OrderDto", "wire", "Accepted")}


@pytest.mark.parametrize("force,outcome", [(True, "replaced"), (False, "canonical already set")])
def test_another_canonical_type_needs_force(spark, force, outcome):
    types = spark.createDataFrame([("a::User", "User"), ("f::User", "User")], "symbol string, name string")
    now = spark.createDataFrame([("user", "canonical", "a::User", None, "Hinted")], CONCEPTS)
    said = accept.outcomes(spark.createDataFrame([(1, "canonical", "f::User", "user", None, force)], PROPOSALS), now, types)
    assert [x.outcome for x in said.collect()] == [outcome]
    assert {x.symbol for x in accept.merged(now, said).collect()} == {"f::User" if force else "a::User"}


def test_pattern_table_is_the_dialect(spark):
    r = random.Random(3)
    seg = lambda: r.choice(["a", "b", "c", "dd", "e_e"])
    paths = sorted({"::".join(seg() for _ in range(r.randint(1, 5))) for _ in range(60)})
    body = lambda: "::".join(seg() for _ in range(r.randint(1, 3)))
    patterns = ["*::", "::*", "*::*", *(r.choice(["{}", "{}::*", "*::{}", "*::{}::*"]).format(body()) for _ in range(50))]
    for extra in ([], ["*"]):
        every = patterns + extra
        table = spark.createDataFrame(list(enumerate(every)), "ix long, pattern string")
        df = spark.createDataFrame([(p,) for p in [*paths, None]], "path string")
        hits = df.select("path", *[F.coalesce(segments(F.col("path"), p), F.lit(False)).alias(str(i)) for i, p in enumerate(every)]).collect()
        want = {x.path: next(i for i in range(len(every)) if x[str(i)]) for x in hits if x.path is not None and any(x[1:])}
        assert {x.path: x.ix for x in first_patterns(df, table).collect()} == want


def test_many_patterns_need_no_large_expression(spark):
    table = spark.range(10_000).selectExpr("id as ix", "concat('*::m', id, '::*') as pattern")
    df = spark.range(500).selectExpr("concat('p::m', id * 7, '::x') as path")
    got = first_patterns(df, table)
    assert got.count() == 500 and got.where("path <> concat('p::m', ix, '::x')").count() == 0


def test_chain_order_and_numbers(spark):
    spec = "finding_id long, rule_id string, severity string, path string, line_start int, line_end int, subject string, detail string"
    found = spark.createDataFrame([(1, "AA001", "Fatal", "p", 1, 1, "s", None), (2, "ZZ009", "Advisory", "p", 1, 1, "s", None), (3, "ZZ009", "Warning", "p", 2, 2, "s", None)], spec)
    seen = []
    watch = decide.Step("watch", lambda f, d: seen.append((f.count(), d.count())), lambda f, new, d: decide.passed(f.where("rule_id = 'AA001'")))
    rows, made = decide.chain(found, [decide.integrity(["AA001"]), watch, decide.pass_through()])
    assert seen == [(4, 1)]  # the later policy sees what the earlier one added and decided
    assert [(x.finding_id, x.subject, x.detail) for x in rows.where("rule_id = 'GOV003'").collect()] == [(4, "ZZ009", "2")]
    assert sorted((x.finding_id, x.policy, x.status) for x in made.collect()) == [(1, "watch", "Active"), (2, "default", "Advisory"), (3, "default", "Active"), (4, "registry-integrity", "Active")]
    assert decide.undecided(rows, made).count() == 0


def test_numbers_over_ranges(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 5), r.choice("abc"), i) for i in range(400)]
    got = decide.numbered(spark.createDataFrame(rows, "a int, b string, i int").repartition(5), "n", "a", "b", "i", after=7).collect()
    assert [(x.a, x.b, x.i) for x in sorted(got, key=lambda x: x.n)] == sorted(rows) and sorted(x.n for x in got) == list(range(8, 408))


def test_sections(spark):
    text = "\n## X\n#### OT004 - Name\nline a\nline b\n\n  #### DG001 - Next\nline c\n#### OT004 again\nx\n####nothing\n#### bare"
    got = {(x.path, x.name): x.text for x in report.sections(spark.createDataFrame([("d", text), ("e", None), ("f", "no heading")], "path string, text string")).collect()}
    assert got == {("d", "OT004"): "#### OT004 - Name\nline a\nline b", ("d", "DG001"): "#### DG001 - Next\nline c"}


def test_workspace(spark, tmp_path):
    root = tmp_path / "some where"
    files = {
        "my-pkg/src/lib.rs": "fn f() {}\n", "my-pkg/src/a/mod.rs": "mod x { fn g() { let s = \"}\"; // {\n } }", "my-pkg/src/generated/x.rs": "struct G;", "my-pkg/src/b_generated.rs": "struct G;",
        "my-pkg/build/src/x.rs": "struct G;", "my-pkg/notes.rs": "outside", "my-pkg/src/notes.txt": "text", "other/src/main.rs": "// girder: allow FL\nfn broken( {", "other/src/empty.rs": "",
    }
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / "other/src/bytes.rs").write_bytes(b"fn h() {} // \xff\xfe")
    df = read_workspace(spark, str(root))
    got = {x.path: (x.package, x.module_path, x.line_count, x.error) for x in df.collect()}
    assert got == {
        "my-pkg/src/lib.rs": ("my-pkg", "my_pkg", 1, None), "my-pkg/src/a/mod.rs": ("my-pkg", "my_pkg::a", 2, None), "other/src/main.rs": ("other", "other", 2, "unbalanced brackets"),
        "other/src/bytes.rs": ("other", "other::bytes", 1, "not UTF-8"),
    }
    assert [(x.path, x.line_no, x.target_line, x.rule) for x in scan_hints(df).collect()] == [("other/src/main.rs", 1, 2, "FL")]


def test_numbering_shuffles_each_row_once_and_keeps_its_columns_once(spark):
    df = spark.range(1000).selectExpr("id % 7 as a", "id as b", "concat('s', id) as c")
    out = decide.numbered(df, "n", "a", "b")
    held, before = out.parts
    assert set(held.columns) == {"a", "b", "c", "_part", "_rn"} and before.count() == held.select("_part").distinct().count()
    assert [tuple(r)[:2] for r in out.orderBy("n").select("a", "b", "n").collect()] == sorted((i % 7, i) for i in range(1000))
    assert "Exchange" not in out._jdf.queryExecution().sparkPlan().toString().replace("BroadcastExchange", "") and "Window" not in out._jdf.queryExecution().sparkPlan().toString()
