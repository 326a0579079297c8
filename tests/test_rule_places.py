"""Where rules report, and what lets a place off, on literal facts."""

from girder.plans.policy import Policy
from girder.plans.rules import RULES, Facts, all_hits

AT = "pkg_ix int, file_ix int, item_ix long, path string, module_path string, line_start int, line_end int"
FN = f"{AT}, symbol string, name string, return_type string, line_count int, visibility string, doc string"
ACT = f"{AT}, function string, action string, target string"


def ask(rule, tables, sections):
    rows = RULES[rule].observe(Facts(tables, Policy(sections))).collect()
    return sorted((r.path, r.line_start, r.line_end, r.subject, r.detail) for r in rows)


def fn(ix, symbol, path="a.rs", module="p::a", lines=(10, 30), ret=None):
    return (0, 0, ix, path, module, *lines, symbol, symbol.rsplit("::", 1)[-1], ret, lines[1] - lines[0] + 1, "Public", None)


def test_fl013_stands_at_the_call_and_knows_inline_modules(spark):
    fns = spark.createDataFrame([fn(1, "p::a::f", ret="Result<A, String>"), fn(2, "p::a::tests::g", ret="Result<A, &str>"), fn(3, "p::a::h", ret="Result<A, E>")], FN)
    calls = spark.createDataFrame([(0, 0, 10 + i, "a.rs", "p::a", ln, ln + 1, f, "x::to_string", "Method") for i, (f, ln) in enumerate([("p::a::f", 15), ("p::a::f", 12), ("p::a::tests::g", 20), ("p::a::h", 25)])], f"{AT}, function string, callee string, call_kind string")
    got = ask("FL013", {"air_function": fns, "air_call_site": calls}, {"FL": {"invariant_owner_paths": ["*::tests::*"]}})
    assert got == [("a.rs", 15, 16, "p::a::f", "x::to_string@15")]


def test_ot004_looks_at_the_file_not_the_module(spark):
    acts = spark.createDataFrame([(0, 0, 1, "conv", "p::other", 3, 3, "p::x::f", "Construct", "m::User"), (0, 1, 2, "b.rs", "conv", 4, 4, "p::x::g", "Construct", "User"), (0, 1, 3, "b.rs", "q", 5, 5, None, "Construct", "User"), (0, 2, 4, "own.rs", "q", 5, 5, "z", "Construct", "User")], ACT)
    tables = {
        "air_truth_action": acts, "policy_concept": spark.createDataFrame([("user", "canonical", "m::User", "User", "own.rs")], "concept string, role string, symbol string, name string, path string"),
        "policy_converter": spark.createDataFrame([], "concept string, symbol string, from_type string, to_type string"),
    }
    assert [x[:2] for x in ask("OT004", tables, {"OT": {"converter_paths": ["conv"]}})] == [("b.rs", 4), ("b.rs", 5)]


def test_pa001_accepts_short_names(spark):
    types = spark.createDataFrame([(0, 0, i, "a.rs", "p::a", 1, 9, "Trait", n, f"p::a::{n}") for i, n in enumerate(["Port", "Gate", "Door"])], f"{AT}, kind string, name string, symbol string")
    impls = spark.createDataFrame([(0, 0, 10 + i, "a.rs", "p::a", 20, 21, "T", n) for i, n in enumerate(["p::a::Port", "Gate", "Door"])], f"{AT}, target_type string, interface string")
    assert [x[3] for x in ask("PA001", {"air_type": types, "air_impl": impls}, {"PA": {"accepted_colocated": ["Gate", "*::Door"]}})] == ["p::a::Port"]


def test_rm001_falls_back_to_the_first_action(spark):
    acts = spark.createDataFrame([(0, 1, 9 - i, "b.rs", "p::b", 40 - i, 41 - i, f, a, "t") for f in ("p::a::f", "p::b::gone") for i, a in enumerate(["Construct", "Validate", "Normalize"])], ACT)
    got = ask("RM001", {"air_truth_action": acts, "air_function": spark.createDataFrame([fn(1, "p::a::f")], FN)}, {"RM": {"max_action_kinds": 2}})
    assert got == [("a.rs", 10, 30, "p::a::f", "3"), ("b.rs", 38, 39, "p::b::gone", "3")]
    exempt = {"RM": {"max_action_kinds": 2, "exempt_paths": ["p::b"]}}
    assert [x[3] for x in ask("RM001", {"air_truth_action": acts, "air_function": spark.createDataFrame([fn(1, "p::a::f")], FN)}, exempt)] == ["p::a::f"]


def test_ob004_names_unknown_places(spark):
    facts = spark.createDataFrame([("Function", k, s) for k, s in [("BoundaryEntry", "p::a::f"), ("BoundaryEntry", "p::b::g"), ("BoundaryEntry", "gone"), ("BoundaryEntry", "p::a::ok"), ("Logging", "p::a::ok")]], "scope string, kind string, symbol string")
    fns = spark.createDataFrame([fn(1, "p::a::f"), fn(2, "p::b::g", path="b.rs", module=None), fn(3, "p::a::ok")], FN)
    assert ask("OB004", {"air_fact": facts, "air_function": fns}, {}) == [("<unknown>", 0, 0, "gone", None), ("<unknown>", 0, 0, "p::b::g", None), ("a.rs", 10, 30, "p::a::f", None)]


def test_rules_of_one_table_share_a_pass(spark):
    """What the rules say one by one and in one pass over their table is the same, under no policy and a full one."""
    rows = [(0, 0, i, f"f{i}.rs", m, i, i + 1, f, c, k) for i, (m, f, c, k) in enumerate([("p::domain", "p::domain::f", "x::unwrap", "Method"), ("p::infra", "p::infra::g", "unwrap", "Method"), (None, "h", "expect", "Meta"), ("p::api", "p::api::h", "metrics::counter", "Meta"), ("p::api", None, "ok", "Method")])]
    calls = spark.createDataFrame(rows, f"{AT}, function string, callee string, call_kind string")
    ids = [i for i, r in RULES.items() if r.source == "air_call_site"]
    assert len(ids) == 4
    for sections in ({}, {"FL": {"invariant_owner_paths": ["*::infra::*"]}, "OB": {"metric_owner_paths": ["x"], "event_owner_paths": ["y"]}}):
        x = Facts({"air_call_site": calls}, Policy(sections))
        apart = [tuple(r) for i in ids for r in RULES[i].observe(x).collect()]
        assert sorted(map(str, apart)) == sorted(str(tuple(r)) for r in all_hits(x, "air_call_site", ids).collect())
        assert bool(apart) == bool(sections)


def test_cr002_names_no_function_where_there_is_none(spark):
    acts = spark.createDataFrame([(0, 0, i, "a.rs", "p::root", 3 + i, 3 + i, None, "Construct", "m::User") for i in range(2)], ACT)
    assert ask("CR002", {"air_truth_action": acts}, {"CR": {"root_paths": ["p::root"], "wiring_density": 2}}) == [("a.rs", 3, 3, None, "2")]
