"""The rule catalogue: each rule is a DataFrame of findings over the fact tables.

Rules are lazy, but for OT001, OT002 and DG002, whose clusters and cycles are
computed when the frame is built. Rules over single rows say so (``row_rule``),
so that those of one table can share its scan.

A rule takes a ``Facts`` (tables by name, policy) and returns the columns of
``FINDING`` but rule_id and severity, which its registration adds. "First" is
always the smallest ordinal (pkg_ix, file_ix, item_ix), never arrival order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions.patterns import any_pattern, first_pattern, first_value, fragments, name_glob, name_suffix, path_or_name, segments, segments_or_name, single_star, trailing_segments, type_text_glob
from girder.functions.text import containing_module, is_primitive, jaccard, result_error, short_name, snake_to_pascal, starts_with_any
from girder.operators.concepts import clusters, distinct_conversions
from girder.operators.graph import strong_components
from girder.operators.intervals import stab

from girder.scratch import materialize

from .policy import DEFAULTS, Policy

FINDING = ["rule_id", "severity", "path", "line_start", "line_end", "subject", "detail", "pkg_ix", "file_ix", "item_ix", "narrowed"]
ORD = ["pkg_ix", "file_ix", "item_ix"]


class Facts:
    """Fact tables by name (any mapping) with the policy that questions are asked under."""

    def __init__(self, tables: Mapping[str, DataFrame], policy: Policy):
        self.tables, self.policy, self.kept, self.lock = tables, policy, {}, Lock()

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def section(self, family: str) -> dict:
        return self.policy.section(family)

    def clusters(self) -> DataFrame:
        with self.lock:  # rules may be planned side by side
            if "clusters" not in self.kept:
                found = clusters(self["air_type"], self["air_field"], self["air_variant"], self["air_hint"], self["policy_concept"], self["air_conversion"])
                self.kept["clusters"] = materialize(found, "clusters")  # read several times by each question
            return self.kept["clusters"]


@dataclass(frozen=True)
class Hit:
    """What a rule that looks at single rows says of one: whether it is found, and as what."""

    when: Column
    subject: Column | str
    detail: Column | str | None = None
    narrowed: Column | None = None


def off() -> Hit:
    """Of a rule that is off."""
    return Hit(F.lit(False), F.lit(None).cast("string"))


@dataclass(frozen=True)
class Rule:
    """``source`` and ``hit`` are set of rules over single rows: those of one source share its scan when all are asked."""

    id: str
    severity: str
    body: Callable[[Facts], DataFrame]
    source: str | None = None
    hit: Callable[[Facts], Hit] | None = None

    def observe(self, facts: Facts) -> DataFrame:
        """Findings with the rule's severity, unless the body sets one; ``narrowed`` is whether strict mode may raise them."""
        df = self.body(facts)
        given = lambda name, else_: F.col(name) if name in df.columns else F.lit(else_)
        return df.withColumns({"rule_id": F.lit(self.id), "severity": given("severity", self.severity), "narrowed": given("narrowed", True)}).select(*FINDING)


RULES: dict[str, Rule] = {}


def rule(id_: str, severity: str):
    def add(body: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        assert id_ not in RULES and id_[:2] in DEFAULTS  # ids are unique and begin with their family
        RULES[id_] = Rule(id_, severity, body)
        return body

    return add


def row_rule(id_: str, severity: str, source: str):
    """A rule over the single rows of a source, a fact table or one of ``SOURCES``."""

    def add(hit: Callable[[Facts], Hit]) -> Callable[[Facts], Hit]:
        def body(x: Facts) -> DataFrame:
            h = hit(x)
            return found(rows_of(x, source).where(h.when), h.subject, h.detail, *([] if h.narrowed is None else [h.narrowed.alias("narrowed")]))

        assert id_ not in RULES and id_[:2] in DEFAULTS
        RULES[id_] = Rule(id_, severity, body, source, hit)
        return hit

    return add


#: Sources of row rules that are no fact tables themselves.
SOURCES: dict[str, Callable[[Facts], DataFrame]] = {}


def source(body: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
    SOURCES[body.__name__] = body
    return body


def rows_of(x: Facts, name: str) -> DataFrame:
    return SOURCES[name](x) if name in SOURCES else x[name]


def all_hits(x: Facts, name: str, ids: list[str]) -> DataFrame:
    """Findings of several row rules over one source in one pass: each row explodes to what the rules say of it."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    said = []
    for id_ in ids:
        r, h = RULES[id_], RULES[id_].hit(x)
        detail = F.lit(None).cast("string") if h.detail is None else col(h.detail).cast("string")
        narrowed = F.lit(True) if h.narrowed is None else h.narrowed
        said.append(F.when(h.when, F.struct(F.lit(id_).alias("rule_id"), F.lit(r.severity).alias("severity"), col(h.subject).cast("string").alias("subject"), detail.alias("detail"), narrowed.alias("narrowed"))))
    each = rows_of(x, name).select("path", F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), *ORD, F.explode(F.array_compact(F.array(*said))).alias("h"))
    return each.select("h.*", "path", "line_start", "line_end", *ORD).select(*FINDING)


def found(df: DataFrame, subject: Column | str, detail: Column | str | None = None, *more: Column) -> DataFrame:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    det = F.lit(None).cast("string") if detail is None else c(detail).cast("string")
    return df.select("path", F.col("line_start").cast("int"), F.col("line_end").cast("int"), c(subject).alias("subject"), det.alias("detail"), *ORD, *more)


def module(alias: str = "module_path") -> Column:
    return F.col(alias)


def placed(x: Facts, table: str) -> DataFrame:
    """Rows of files that have a module path; most rules pass over the others."""
    return x[table].where("module_path is not null")


def first_by(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """For each key the row of smallest ordinal; keeps ``values`` and the ordinals. A partial aggregation, no window."""
    out = df.groupBy(*keys).agg(F.min(F.struct(*ORD, *values)).alias("_f"))
    return out.select(*keys, *[F.col(f"_f.{v}").alias(v) for v in [*ORD, *values]])


def fact_functions(facts: Facts, *kinds: str) -> DataFrame:
    """Facts about functions with the first function of that symbol; none if that one's file has no module path."""
    fn = first_by(facts["air_function"], ["symbol"], "path", "module_path", "line_start", "line_end")
    fn = fn.where("module_path is not null")
    f = facts["air_fact"].where((F.col("scope") == "Function") & F.col("kind").isin(*kinds)).select("symbol", "kind", "evidence", F.col("item_ix").alias("fact_ix"))
    return f.join(fn, "symbol")


@source
def function_facts(x: Facts) -> DataFrame:
    """All facts about functions; ``hot`` where one of them marks the function as a hot path."""
    fn = first_by(x["air_function"], ["symbol"], "path", "module_path", "line_start", "line_end").where("module_path is not null")
    f = x["air_fact"].where("scope = 'Function'").select("symbol", "kind", "evidence", F.col("item_ix").alias("fact_ix"))
    hot = f.where("kind = 'HotPath'").select("symbol").distinct().withColumn("hot", F.lit(True))
    return f.join(fn, "symbol").join(hot, "symbol", "left")


# --- complexity budgets ---------------------------------------------------


def over_budget(subject: str, override: Column, default: int, written: int | None) -> Hit:
    """Rows above their line budget; strict mode raises those whose budget an override or the policy itself sets."""
    override = override.cast("int")
    budget = F.coalesce(override, F.lit(default))
    over = F.col("module_path").isNotNull() & (F.col("line_count") > budget)
    return Hit(over, subject, F.concat_ws("/", "line_count", budget), override.isNotNull() | F.lit(written is not None))


@row_rule("CX001", "Warning", "air_function")
def cx001(x: Facts) -> Hit:
    p = x.section("CX")
    return over_budget("symbol", first_value(module(), p["fn_overrides"], trailing_segments), p["fn_lines"], (x.policy.explicit("CX") or {}).get("fn_lines"))


@row_rule("CX002", "Warning", "files")
def cx002(x: Facts) -> Hit:
    p = x.section("CX")
    return over_budget("module_path", first_value(module(), p["module_overrides"]), p["module_lines"], (x.policy.explicit("CX") or {}).get("module_lines"))


@source
def files(x: Facts) -> DataFrame:
    return file_rows(x["air_file"])


def file_rows(df: DataFrame) -> DataFrame:
    return df.withColumns({"line_start": F.lit(1), "line_end": F.lit(1), "item_ix": F.lit(-1).cast("long")})


@rule("CX007", "Warning")
def cx007(x: Facts) -> DataFrame:
    p = x.section("CX")
    cols = ["pkg_ix", "file_ix", "item_ix", "path", "module_path", "line_start", "line_end", "visibility"]
    items = x["air_type"].select(*cols).unionByName(x["air_function"].select(*cols)).where("visibility = 'Public'")
    items = items.where(F.col("module_path").isNotNull() & ~any_pattern(module(), p["exempt_paths"]))
    g = items.groupBy("pkg_ix", "file_ix", "path", "module_path").agg(F.count("*").alias("n"), F.min(F.struct("item_ix", "line_start", "line_end")).alias("f"))
    return found(g.where(F.col("n") > p["max_public_items"]).select("*", "f.*"), "module_path", "n")


@rule("CX008", "Warning")
def cx008(x: Facts) -> DataFrame:
    p = x.section("CX")
    if not p["orchestration_paths"]:
        return empty(x)
    calls = x["air_call_site"].where("function is not null").groupBy("function").agg(F.count("*").alias("n")).where(F.col("n") > p["max_fan_out"])
    fn = first_by(x["air_function"], ["symbol"], "path", "module_path", "line_start", "line_end")
    df = fn.join(calls, F.col("symbol") == F.col("function")).where(F.col("module_path").isNotNull() & ~any_pattern(module(), p["orchestration_paths"]))
    return found(df, "symbol", "n")


def empty(x: Facts) -> DataFrame:
    return found(x["air_function"].where(F.lit(False)), "symbol")


# --- dependencies ---------------------------------------------------------


@row_rule("DG001", "Fatal", "air_import")
def dg001(x: Facts) -> Hit:
    edge = F.lit(None).cast("string")
    for a, b in reversed(x.section("DG")["edges"]):
        edge = F.when(segments(module(), a) & segments(F.col("import_path"), b), F.lit(f"{a} -> {b}")).otherwise(edge)
    return Hit(edge.isNotNull(), "import_path", edge)


def package_edges(x: Facts) -> DataFrame:
    """First-segment edges of imports with the first evidence."""
    df = x["air_import"].where("module_path is not null").withColumns({"src": F.substring_index("module_path", "::", 1), "dst": F.substring_index("import_path", "::", 1)})
    return first_by(df.where("src <> dst and src <> '' and dst <> ''"), ["src", "dst"], "path", "line_start", "line_end")


@rule("DG002", "Fatal")
def dg002(x: Facts) -> DataFrame:
    edges = package_edges(x)
    comp = strong_components(edges.select("src", "dst")).where("size > 1")
    a, b = comp.select(F.col("node").alias("src"), F.col("component").alias("ca")), comp.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    return found(edges.join(a, "src").join(b, "dst").where("ca = cb"), F.concat_ws(" -> ", "src", "dst"), "ca")


def feature_of(col: Column, features: list) -> Column:
    """First feature, in the order declared, one of whose patterns matches."""
    out = F.lit(None).cast("string")
    for f in reversed(features):
        out = F.when(any_pattern(col, f[1]), F.lit(f[0])).otherwise(out)
    return out


@row_rule("DG003", "Fatal", "air_import")
def dg003(x: Facts) -> Hit:
    fs = x.section("DG")["features"]
    if len(fs) < 2:
        return off()
    of, to, open_ = feature_of(module(), fs), feature_of(F.col("import_path"), fs), F.lit(False)
    for f in fs:
        open_ = open_ | ((to == f[0]) & any_pattern(F.col("import_path"), f[2]))
    return Hit(of.isNotNull() & to.isNotNull() & (of != to) & ~open_, "import_path", F.concat_ws(" -> ", of, to))


@row_rule("DG004", "Fatal", "air_import")
def dg004(x: Facts) -> Hit:
    p = x.section("DG")
    shared, to = first_pattern(module(), p["shared_paths"]), feature_of(F.col("import_path"), p["features"])
    return Hit(shared.isNotNull() & to.isNotNull(), "import_path", F.concat_ws(" -> ", shared, to))


# --- one owner of a concept -----------------------------------------------


@rule("OT001", "Fatal")
def ot001(x: Facts) -> DataFrame:
    w = Window.partitionBy("stem").orderBy(*ORD)
    c = x.clusters().where("role = 'Canonical'").withColumns({"rn": F.row_number().over(w), "incumbent": F.first("symbol").over(w)})
    return found(c.where("rn > 1"), "symbol", "incumbent")


@rule("OT002", "Warning")
def ot002(x: Facts) -> DataFrame:
    c = x.clusters()
    canon = first_by(c.where("role = 'Canonical'").withColumn("canonical", F.col("symbol")), ["stem"], "canonical").select("stem", "canonical")
    half = F.lit(0.5).cast("float")
    tier = F.when(F.col("overlap") >= F.lit(0.9).cast("float"), "High").when(F.col("overlap") >= F.lit(0.7).cast("float"), "Medium").otherwise("Low")
    return found(c.where((F.col("role") == "Unknown") & (F.col("overlap") >= half)).join(canon, "stem"), "symbol", tier)


def accepted(x: Facts, role: str) -> DataFrame:
    return x["policy_concept"].where(F.col("role") == role).select("concept", F.col("symbol").alias("accepted"), F.col("name").alias("short"), F.col("path").alias("owner"))


def named_in(texts: DataFrame) -> DataFrame:
    """Each text's whole identifiers (ASCII boundary) as ``short``, to meet names by equality."""
    return texts.withColumn("short", F.explode(F.array_distinct(F.split("text", "[^A-Za-z0-9_]+")))).where("short <> ''")


@rule("OT003", "Fatal")
def ot003(x: Facts) -> DataFrame:
    fn = x["air_function"].join(x["policy_concept"].where("role = 'boundary'").select("path").distinct(), "path", "left_anti")
    fn = fn.join(x["policy_converter"].select("symbol").distinct(), "symbol", "left_anti")
    texts = fn.select(*ORD, F.col("return_type").alias("text")).unionByName(x["air_param"].select(*ORD, F.col("type_text").alias("text"))).where("text is not null")
    hits = named_in(texts).join(accepted(x, "boundary").select("short").distinct(), "short").select(*ORD, "short").distinct()
    return found(fn.join(hits, ORD), "symbol", "short")


@rule("OT004", "Fatal")
def ot004(x: Facts) -> DataFrame:
    patterns = x.section("OT")["converter_paths"]
    canon = accepted(x, "canonical").groupBy("short").agg(F.min(F.struct("concept", "owner")).alias("c")).select("short", "c.owner")
    df = x["air_truth_action"].where("action = 'Construct'").withColumn("short", short_name(F.col("target"))).join(canon, "short").where("path <> owner")
    df = df.join(x["policy_converter"].select("symbol").distinct(), F.col("function") == F.col("symbol"), "left_anti")
    return found(df.where(~any_pattern(F.col("function"), patterns) & ~any_pattern(F.col("path"), patterns)), "function", "short")


@rule("OT005", "Fatal")
def ot005(x: Facts) -> DataFrame:
    conv = x["policy_converter"].select(F.explode(F.array(short_name(F.col("from_type")), short_name(F.col("to_type")))).alias("short")).distinct()
    lone = accepted(x, "boundary").join(conv, "short", "left_anti")
    spans = first_by(x["air_type"], ["symbol"], "path", "line_start", "line_end")
    df = lone.join(spans, F.col("accepted") == F.col("symbol"), "left")
    df = df.withColumns({"path": F.coalesce("path", "owner"), "line_start": F.coalesce("line_start", F.lit(1)), "line_end": F.coalesce("line_end", F.lit(1))})
    return found(df, "accepted", "concept")


def endpoint(x: Facts, col: str, name: str) -> DataFrame:
    """Accepted symbols by what an endpoint's text may say: the symbol or its last segment; the first by concept, then symbol."""
    c = x["policy_concept"].select(F.explode(F.array("symbol", "name")).alias(col), F.struct("concept", "symbol").alias("s"))
    return c.groupBy(col).agg(F.min("s").alias("s")).select(col, F.col("s.concept").alias(name))


@rule("OT006", "Warning")
def ot006(x: Facts) -> DataFrame:
    c = distinct_conversions(x["air_conversion"]).withColumns({"f": F.trim("from_type"), "t": F.trim("to_type")})
    df = c.join(endpoint(x, "f", "fc"), "f").join(endpoint(x, "t", "tc"), "t").where("fc = tc")
    return found(df.join(x["policy_converter"].select(F.col("concept").alias("fc"), "symbol").distinct(), ["fc", "symbol"], "left_anti"), "symbol", "fc")


@rule("OT007", "Fatal")
def ot007(x: Facts) -> DataFrame:
    names = accepted(x, "boundary").select("short").distinct()
    c = distinct_conversions(x["air_conversion"]).withColumns({"a": short_name(F.col("from_type")), "b": short_name(F.col("to_type"))})
    c = c.join(names.withColumnRenamed("short", "a"), "a").join(names.withColumnRenamed("short", "b"), "b")
    hints = x["air_hint"].where("category = 'protocol_translation'").select("path", F.col("target_start").alias("at"))
    held = stab(hints, c.select(*ORD, "path", "line_start", "line_end"), ["path"], "at", "line_start", "line_end").select(*ORD).distinct()
    c = c.join(held, ORD, "left_anti")
    return found(c, "symbol", F.concat_ws(" -> ", "a", "b"))


# fixed values: methods that belong on a boundary type
BOUNDARY_METHODS = [
    "from", "try_from", "into", "try_into", "serialize", "deserialize", "fmt", "display", "new", "default", "builder", "build", "clone",
    "as_ref", "as_mut", "as_str", "as_bytes", "into_inner", "inner", "len", "is_empty",
]
BOUNDARY_METHOD_PREFIXES = ["as_", "to_", "into_", "from_", "try_", "with_"]


@rule("OT008", "Warning")
def ot008(x: Facts) -> DataFrame:
    m = x["air_impl_method"].where("interface is null").withColumn("short", short_name(F.col("target_type"))).join(accepted(x, "boundary").select("short").distinct(), "short")
    ok = F.col("method").isin(*BOUNDARY_METHODS) | starts_with_any(F.col("method"), BOUNDARY_METHOD_PREFIXES).isNotNull()
    return found(m.where(~ok), F.concat_ws("::", "target_type", "method"), "short")


# fixed values: prefixes of validating and normalising functions
VALIDATING = ["validate_", "is_valid_", "check_", "verify_", "ensure_", "normalize_", "sanitize_", "canonicalize_", "parse_", "clean_"]


@rule("OT009", "Warning")
def ot009(x: Facts) -> DataFrame:
    fn = x["air_function"].withColumn("prefix", starts_with_any(F.col("name"), VALIDATING)).where("prefix is not null")
    fn = fn.join(x["policy_converter"].select("symbol").distinct(), "symbol", "left_anti")
    texts = fn.select(*ORD, F.col("return_type").alias("text")).unionByName(x["air_param"].select(*ORD, F.col("type_text").alias("text"))).where("text is not null")
    first = named_in(texts).join(accepted(x, "canonical").select("short", "owner"), "short").groupBy(*ORD).agg(F.min(F.struct("short", "owner")).alias("c")).select(*ORD, "c.*")
    return found(fn.join(first, ORD).where("path <> owner"), "symbol", "short")


@rule("OT010", "Warning")
def ot010(x: Facts) -> DataFrame:
    names = x["air_variant"].groupBy(*ORD, "symbol").agg(F.array_sort(F.collect_set("name")).alias("names"))
    enums = x["air_type"].where("kind = 'Enum'").join(names.drop("symbol"), ORD)
    canon = accepted(x, "canonical").join(first_by(enums, ["symbol"], "names"), F.col("accepted") == F.col("symbol")).select("concept", "accepted", F.col("names").alias("own"))
    other = enums.join(x["policy_concept"].select("symbol").distinct(), "symbol", "left_anti")
    # half of the union shared is at least one name shared: pairs meet by a name, once each
    pairs = other.select(*ORD, F.explode("names").alias("v")).join(canon.select("accepted", F.explode("own").alias("v")), "v").select(*ORD, "accepted").distinct()
    near = other.join(pairs, ORD).join(canon, "accepted").where(jaccard(F.col("names"), F.col("own")) >= F.lit(0.5).cast("float"))
    best = near.groupBy(*ORD, "path", "line_start", "line_end", "symbol").agg(F.min(F.struct("concept", "accepted")).alias("c"))
    return found(best, "symbol", "c.accepted")


@rule("OT011", "Warning")
def ot011(x: Facts) -> DataFrame:
    one = x["air_field"].groupBy(*ORD).agg(F.count("*").alias("n")).where("n = 1")
    t = x["air_type"].where("kind = 'Struct'").join(one, ORD).join(x["policy_concept"].select("symbol").distinct(), "symbol", "left_anti")
    canon = accepted(x, "canonical").groupBy("short").agg(F.min(F.struct("concept", "accepted")).alias("c"))
    return found(t.join(canon, F.col("name") == F.col("short")).where("symbol <> c.accepted"), "symbol", "c.concept")


@rule("OT012", "Warning")
def ot012(x: Facts) -> DataFrame:
    f = x["air_field"].where("kind = 'Struct'").join(x["policy_concept"].select("symbol").distinct(), "symbol", "left_anti")
    f = f.withColumn("short", snake_to_pascal(F.col("name"))).where(is_primitive(F.col("type_text")))
    return found(f.join(accepted(x, "canonical").select("short").distinct(), "short"), F.concat_ws(".", "symbol", "name"), "short")


# --- failures -------------------------------------------------------------


def outside_owners(x: Facts, key: str = "invariant_owner_paths") -> Column:
    """Whether a place's file and its function's module are no owner's; never while no owner is named."""
    owners = x.section("FL")[key]
    return F.col("module_path").isNotNull() & F.lit(bool(owners)) & ~any_pattern(module(), owners) & ~any_pattern(containing_module(F.col("function")), owners)


@row_rule("FL001", "Fatal", "air_function")
def fl001(x: Facts) -> Hit:
    p = x.section("FL")
    hit = first_pattern(result_error(F.col("return_type")), p["boundary_error_patterns"])
    return Hit(any_pattern(module(), p["domain_paths"]) & F.col("return_type").contains("Result<") & hit.isNotNull(), "symbol", hit)


@row_rule("FL002", "Warning", "air_call_site")
def fl002(x: Facts) -> Hit:
    hit = first_pattern(short_name(F.col("callee")), x.section("FL")["forbidden_callees"])
    return Hit(F.col("call_kind").isin("Method", "Meta") & hit.isNotNull() & outside_owners(x), "function", hit)


@row_rule("FL003", "Warning", "air_call_site")
def fl003(x: Facts) -> Hit:
    hit = first_pattern(F.col("callee"), x.section("FL")["silent_discard_callees"])
    return Hit((F.col("call_kind") == "Method") & hit.isNotNull() & outside_owners(x), "function", hit)


@row_rule("FL004", "Warning", "air_silent_discard")
def fl004(x: Facts) -> Hit:
    told = F.expr("discard_kind <> 'Other' and callee is not null")
    return Hit(outside_owners(x) & told & ~any_pattern(F.col("callee"), x.section("FL")["silent_discard_allowed"]), "function", "callee")


@row_rule("FL005", "Warning", "air_partial_match")
def fl005(x: Facts) -> Hit:
    return Hit(outside_owners(x), "function", "variant")


@row_rule("FL006", "Warning", "air_closure_call")
def fl006(x: Facts) -> Hit:
    return Hit(outside_owners(x) & F.expr("callee = 'map_err' and closure_discards_arg"), "function", "callee")


SILENT = ["Empty", "Literal", "Call"]


@row_rule("FL007", "Warning", "air_match_arm")
def fl007(x: Facts) -> Hit:
    t = F.trim("pattern")
    err = (t == "Err(_)") | t.startswith("Err(_)") | t.contains(" Err(_)") | t.contains("|Err(_)") | t.contains("::Err(_)")
    return Hit(outside_owners(x) & F.col("pattern_has_wildcard") & err & F.col("body_shape").isin(*SILENT), "function", "pattern")


@row_rule("FL010", "Warning", "air_fallback")
def fl010(x: Facts) -> Hit:
    return Hit(outside_owners(x) & F.expr("callee in ('unwrap_or', 'or') and default_shape in ('Literal', 'Call')"), "function", "callee")


@row_rule("FL011", "Warning", "air_match_arm")
def fl011(x: Facts) -> Hit:
    t = F.trim("pattern")
    bare = (t == "_") | t.startswith("_ if ") | t.startswith("_ @ ")
    return Hit(outside_owners(x) & bare & F.col("body_shape").isin(*SILENT), "function", "pattern")


@row_rule("FL012", "Warning", "air_retry_loop")
def fl012(x: Facts) -> Hit:
    return Hit(outside_owners(x, "retry_policy_owner_paths") & F.expr("propagates and has_break"), "function", "loop_kind")


@rule("FL013", "Warning")
def fl013(x: Facts) -> DataFrame:
    owners = x.section("FL")["invariant_owner_paths"]
    outside = ~any_pattern(module(), owners) & ~any_pattern(containing_module(F.col("symbol")), owners)  # inline modules too
    fn = placed(x, "air_function").where(F.lit(bool(owners)) & outside).where(F.regexp_replace(result_error(F.col("return_type")), "^&", "").isin("String", "str"))
    calls = x["air_call_site"].where(short_name(F.col("callee")).isin("to_string", "format!", "format", "display"))
    first = first_by(calls, ["path", "function"], "callee", "line_start", "line_end").select("path", F.col("function").alias("symbol"), "callee", "line_start", "line_end")
    return found(fn.drop("line_start", "line_end").join(first, ["path", "symbol"]), "symbol", F.concat_ws("@", "callee", "line_start"))


# --- ownership of modules -------------------------------------------------


@rule("MO001", "Warning")
def mo001(x: Facts) -> DataFrame:
    p = x.section("MO")
    budget = F.coalesce(first_value(module(), p["overrides"]), F.lit(p["max_public_types"]))
    g = x["air_type"].where("visibility = 'Public' and module_path is not null").groupBy("pkg_ix", "file_ix", "path", "module_path")
    g = g.agg(F.count("*").alias("n"), F.min(F.struct("item_ix", "line_start", "line_end")).alias("f")).withColumn("budget", budget)
    return found(g.where("n > budget").select("*", "f.*"), "module_path", F.concat_ws("/", "n", "budget"))


@rule("MO002", "Warning")
def mo002(x: Facts) -> DataFrame:
    p = x.section("MO")
    hints = x["air_hint"].where("category in ('canonical', 'boundary', 'converter')").select("pkg_ix", "file_ix", F.col("category").alias("role"))
    fns = x["air_function"].where(any_pattern(F.col("name"), p["handler_names"], name_glob)).select("pkg_ix", "file_ix", F.lit("handler").alias("role"))
    imports = x["air_import"].where(any_pattern(F.col("import_path"), p["persistence_imports"])).select("pkg_ix", "file_ix", F.lit("persistence").alias("role"))
    calls = x["air_call_site"].where(any_pattern(F.col("callee"), p["io_callees"])).select("pkg_ix", "file_ix", F.lit("io").alias("role"))
    roles = hints.unionByName(fns).unionByName(imports).unionByName(calls).groupBy("pkg_ix", "file_ix").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    df = roles.where(F.size("roles") >= p["entropy_threshold"]).join(placed(x, "air_file"), ["pkg_ix", "file_ix"])
    return found(file_rows(df), "path", F.array_join("roles", ","))


@rule("MO003", "Warning")
def mo003(x: Facts) -> DataFrame:
    g = x["air_hint"].groupBy("pkg_ix", "file_ix").agg(F.bool_or(F.col("category") == "canonical").alias("c"), F.bool_or(F.col("category") == "boundary").alias("b"))
    return found(file_rows(g.where("c and b").join(placed(x, "air_file"), ["pkg_ix", "file_ix"])), "path")


@rule("MO004", "Warning")
def mo004(x: Facts) -> DataFrame:
    canon = x["air_hint"].where("category = 'canonical'").select("pkg_ix", "file_ix").distinct()
    fns = placed(x, "air_function").where(any_pattern(F.col("name"), x.section("MO")["handler_names"], name_glob)).join(canon, ["pkg_ix", "file_ix"], "left_semi")
    g = fns.groupBy("pkg_ix", "file_ix", "path").agg(F.min(F.struct("item_ix", "line_start", "line_end", "symbol")).alias("f"))
    return found(g.select("*", "f.*"), "symbol")


@rule("MO005", "Warning")
def mo005(x: Facts) -> DataFrame:
    p = x.section("MO")
    tail, stem_ = F.substring_index("module_path", "::", -1), F.regexp_extract("path", r"([^/]+)\.rs$", 1)
    kind = F.when(tail.isin("main", "mod", "lib"), tail).when(stem_.isin("main", "mod", "lib"), stem_)
    files = x["air_file"].withColumn("entry", kind).where("entry is not null and module_path is not null").select("pkg_ix", "file_ix", "entry", F.col("module_path").alias("mp"))
    base = ["pkg_ix", "file_ix", "item_ix", "path", "line_start", "line_end"]
    none = F.lit(None).cast("string")
    fields = x["air_field"].select(*ORD).distinct().withColumn("has_fields", F.lit(True))
    types = x["air_type"].join(fields, ORD, "left").select(*base, F.lit("type").alias("what"), "symbol", F.col("name"), "visibility", F.lit(0).alias("lines"), ((F.col("kind") == "Struct") & F.col("has_fields").isNull()).alias("unit"), none.alias("interface"))
    impls = x["air_impl"].select(*base, F.lit("impl").alias("what"), F.col("target_type").alias("symbol"), short_name(F.col("target_type")).alias("name"), F.lit("Public").alias("visibility"), (F.col("line_end") - F.col("line_start") + 1).cast("int").alias("lines"), F.lit(False).alias("unit"), "interface")
    convs = distinct_conversions(x["air_conversion"]).select(*base, F.lit("conversion").alias("what"), "symbol", none.alias("name"), F.lit("Public").alias("visibility"), F.lit(0).alias("lines"), F.lit(False).alias("unit"), none.alias("interface"))
    fns = x["air_function"].select(*base, F.lit("function").alias("what"), "symbol", "name", "visibility", F.col("line_count").cast("int").alias("lines"), F.lit(False).alias("unit"), none.alias("interface"))
    decl = types.unionByName(impls).unionByName(convs).unionByName(fns).join(files, ["pkg_ix", "file_ix"])
    shape = decl.groupBy("pkg_ix", "file_ix").agg(F.count_if(F.col("visibility") == "Public").alias("public"))
    wires = x["air_import"].where("visibility = 'Public'").groupBy("pkg_ix", "file_ix").agg(F.count("*").alias("wires"))
    units = decl.where("unit").select("pkg_ix", "file_ix", "name").distinct().withColumn("is_unit", F.lit(True))
    host_trait = p["host_trait"]
    hosts = decl.where((F.col("what") == "impl") & segments(F.col("interface"), f"*::{host_trait}") & (F.col("lines") <= p["host_impl_lines"]))
    hosts = hosts.join(units, ["pkg_ix", "file_ix", "name"], "left_semi").select("pkg_ix", "file_ix", "name").distinct().withColumn("host", F.lit(True))
    df = decl.join(shape, ["pkg_ix", "file_ix"]).join(wires, ["pkg_ix", "file_ix"], "left").join(hosts, ["pkg_ix", "file_ix", "name"], "left")
    declared = first_value(F.col("mp"), p["lib_kinds"]).isNotNull()
    skipped = (F.col("entry") == "lib") & (declared | F.col("wires").isNull() | (F.col("public") <= p["lib_decl_budget"]))
    glue = (F.col("what") == "function") & F.col("name").isin(*p["entrypoint_fns"]) & (F.col("lines") <= p["thin_fn_lines"])
    is_host_impl = (F.col("what") == "impl") & F.coalesce(segments(F.col("interface"), f"*::{host_trait}"), F.lit(False)) & (F.col("lines") <= p["host_impl_lines"])
    hosted = (F.col("entry") == "mod") & F.coalesce("host", F.lit(False)) & (((F.col("what") == "type") & F.col("unit")) | is_host_impl)
    return found(df.where(~skipped & ~glue & ~hosted), "symbol", F.concat_ws(":", "entry", "what"))


# --- abstractions ---------------------------------------------------------


@rule("AB001", "Warning")
def ab001(x: Facts) -> DataFrame:
    traits = x["air_type"].where("kind = 'Trait'")
    counts = x["air_impl"].where("interface is not null").groupBy("interface").agg(F.count("*").alias("n"))
    exact = counts.select(F.col("interface").alias("symbol"), F.col("n").alias("exact"))
    loose = counts.groupBy(short_name(F.col("interface")).alias("name")).agg(F.sum("n").alias("loose"))
    one_name = traits.groupBy("name").agg(F.count("*").alias("same"))
    df = traits.join(exact, "symbol", "left").join(loose, "name", "left").join(one_name, "name")
    n = F.when(F.col("exact") > 0, F.col("exact")).when(F.col("same") == 1, F.col("loose"))
    return found(df.where((n == 1) & ~any_pattern(F.col("symbol"), x.section("AB")["accepted_traits"], trailing_segments)), "symbol")


@row_rule("AB002", "Warning", "air_type")
def ab002(x: Facts) -> Hit:
    p = x.section("AB")
    hit = first_pattern(F.col("name"), p["suspect_names"], name_suffix)
    ok = any_pattern(F.col("symbol"), p["accepted_traits"], trailing_segments) | any_pattern(F.col("name"), p["accepted_names"], name_suffix)
    return Hit(F.col("kind").isin("Trait", "Struct") & hit.isNotNull() & ~ok, "symbol", hit)


@source
def documented(x: Facts) -> DataFrame:
    cols = [*ORD, "path", "module_path", "line_start", "line_end", "symbol", "visibility", "doc"]
    return x["air_type"].select(*cols).unionByName(x["air_function"].select(*cols))


#: References of a documentation text: URLs without closing marks, and numbers behind a hash at a word's start.
REFERENCE = r"https?://[^\s<>\"']+|(?<![A-Za-z0-9_])#[0-9]+"


@row_rule("CL001", "Warning", "documented")
def cl001(x: Facts) -> Hit:
    p = x.section("CL")
    if not p["enabled"]:
        return off()
    refs = F.regexp_extract_all("doc", F.lit(REFERENCE), 0)
    rest = F.filter(F.split(F.regexp_replace("doc", REFERENCE, " "), r"\s+"), lambda w: w.rlike("[A-Za-z0-9]"))
    said = F.col("doc").isNotNull() & ~any_pattern(module(), p["exempt_paths"]) & (F.size(refs) > 0) & (F.size(rest) < p["least_words"])
    return Hit(said, "symbol", F.regexp_replace(F.try_element_at(refs, F.lit(1)), r"[.,)`]+$", ""))


# --- boundaries -----------------------------------------------------------


def two_sided_import(where: list[str], what: list[str]) -> Hit:
    a, b = first_pattern(module(), where), first_pattern(F.col("import_path"), what)
    return Hit(a.isNotNull() & b.isNotNull(), "import_path", F.concat_ws(" -> ", a, b))


@row_rule("BO001", "Fatal", "air_import")
def bo001(x: Facts) -> Hit:
    p = x.section("BO")
    return two_sided_import(p["domain_paths"], p["forbidden_in_domain"])


@rule("BO002", "Fatal")
def bo002(x: Facts) -> DataFrame:
    p = x.section("BO")
    fn = x["air_function"].where(any_pattern(module(), p["domain_paths"]))
    texts = x["air_param"].select(*ORD, F.col("pos").cast("int").alias("pos"), F.col("type_text").alias("text")).unionByName(fn.select(*ORD, F.lit(1 << 30).alias("pos"), F.col("return_type").alias("text")))
    first = texts.where(any_pattern(F.col("text"), p["persistence_types"], fragments)).groupBy(*ORD).agg(F.min(F.struct("pos", "text")).alias("f"))
    return found(fn.join(first, ORD), "symbol", "f.text")


@rule("BO004", "Warning")
def bo004(x: Facts) -> DataFrame:
    p = x.section("BO")
    d = x["air_decorator"].where((F.col("source") == "Derive") & any_pattern(module(), p["canonical_paths"]))
    d = d.where(F.col("name").isin(*p["forbidden_derives"]) | short_name(F.col("name")).isin(*p["forbidden_derives"]))
    g = d.groupBy(*ORD, "path", "line_start", "line_end", "symbol").agg(F.min(F.struct("pos", "name")).alias("f"))
    return found(g, "symbol", "f.name")


def by_function(kinds: list[str], patterns: list[str], detail: Column | str, module_only: bool = False) -> Hit:
    """Facts of the kinds about functions whose module, or symbol, matches."""
    hit = any_pattern(module(), patterns)
    return Hit(F.col("kind").isin(*kinds) & (hit if module_only else hit | any_pattern(F.col("symbol"), patterns)), "symbol", detail)


@row_rule("BO005", "Fatal", "function_facts")
def bo005(x: Facts) -> Hit:
    return by_function(["PersistenceWrite"], x.section("BO")["domain_paths"], "fact_ix")


@row_rule("CR001", "Fatal", "air_truth_action")
def cr001(x: Facts) -> Hit:
    p = x.section("CR")
    if not p["root_paths"]:
        return off()
    hit = first_pattern(short_name(F.col("target")), ["*" + s for s in p["service_suffixes"]], name_suffix)
    outside = ~any_pattern(F.coalesce("module_path", F.lit("")), p["root_paths"], trailing_segments)
    return Hit((F.col("action") == "Construct") & outside & hit.isNotNull(), "function", "target")


@rule("CR002", "Warning")
def cr002(x: Facts) -> DataFrame:
    p = x.section("CR")
    if not p["root_paths"] or not p["wiring_density"]:
        return empty(x)
    df = x["air_truth_action"].where("action = 'Construct'").where(any_pattern(F.coalesce("module_path", F.lit("")), p["root_paths"], trailing_segments))
    g = df.groupBy("pkg_ix", "file_ix", "path", "function").agg(F.count("*").alias("n"), F.min(F.struct("item_ix", "line_start", "line_end")).alias("f"))
    return found(g.where(F.col("n") >= p["wiring_density"]).select("*", "f.*"), "function", "n")


# --- documentation --------------------------------------------------------


@row_rule("DC001", "Warning", "documented")
def dc001(x: Facts) -> Hit:
    p = x.section("DC")
    if not p["require_public_docs"]:
        return off()
    return Hit(F.expr("visibility = 'Public' and doc is null") & ~any_pattern(module(), p["exempt_paths"], trailing_segments), "symbol")


@rule("DC002", "Warning")
def dc002(x: Facts) -> DataFrame:
    arms = []
    low = F.lower("doc")
    for phrase, confidence, aliases in x.section("DC")["phrases"]:
        if confidence < 0.5:
            continue
        hit = F.lit(None).cast("string")
        for text in reversed([phrase, *aliases]):
            hit = F.when(low.contains(text.lower()), F.lit(text)).otherwise(hit)
        severity = "Fatal" if confidence >= 0.9 else "Warning" if confidence >= 0.7 else "Advisory"
        arms.append(F.when(hit.isNotNull(), F.struct(hit.alias("hit"), F.lit(severity).alias("severity"))))
    df = documented(x).where("visibility = 'Public' and doc is not null").withColumn("h", F.explode(F.array(*arms))).where("h is not null")
    return found(df, "symbol", "h.hit", F.col("h.severity").alias("severity"))


@rule("DC004", "Warning")
def dc004(x: Facts) -> DataFrame:
    marks = "|".join(x.section("DC")["markers"])
    df = documented(x).where("visibility = 'Public'").withColumn("m", F.explode(F.regexp_extract_all("doc", F.lit(rf"(?i)({marks})(?!\()"), 0)))
    return found(df, "symbol", "m")


# --- errors ---------------------------------------------------------------


@rule("ER001", "Warning")
def er001(x: Facts) -> DataFrame:
    w = Window.partitionBy("pkg_ix", "file_ix").orderBy("item_ix")
    t = x["air_type"].where("visibility = 'Public' and (name like '%Error' or name like '%Err')")
    return found(t.withColumns({"rn": F.row_number().over(w), "first": F.first("name").over(w)}).where("rn > 1"), "symbol", "first")


@row_rule("ER002", "Fatal", "air_function")
def er002(x: Facts) -> Hit:
    bare = lambda s: s[1:] if s.startswith("&") else s
    e = F.regexp_replace(result_error(F.col("return_type")), "^&", "")
    hit = first_pattern(e, [bare(p) for p in x.section("ER")["string_error_patterns"]], single_star)
    return Hit(F.col("return_type").contains("Result<") & hit.isNotNull(), "symbol", e)


@row_rule("ER003", "Fatal", "air_variant")
def er003(x: Facts) -> Hit:
    p = x.section("ER")
    hit = first_pattern(F.col("field_type"), p["boundary_error_patterns"])
    return Hit(any_pattern(module(), p["domain_paths"]) & hit.isNotNull(), F.concat_ws("::", "symbol", "name"), hit)


@row_rule("ER005", "Warning", "air_match_arm")
def er005(x: Facts) -> Hit:
    owners = x.section("ER")["collapse_owner_paths"]
    t = F.trim("pattern")
    err = F.col("pattern_has_wildcard") & (t.startswith("Err") | t.contains("Err(")) & F.col("body_shape").isin(*SILENT)
    outside = F.col("module_path").isNotNull() & F.lit(bool(owners)) & ~any_pattern(module(), owners) & ~any_pattern(F.col("function"), owners)
    return Hit(outside & err, "function", "pattern")


@rule("ER007", "Warning")
def er007(x: Facts) -> DataFrame:
    v = x["air_variant"].where("type_name like '%Error' or type_name like '%Err'")
    first = v.groupBy("name").agg(F.min(F.struct(*ORD, "pos", "type_name", "path")).alias("f"))
    return found(v.join(first, "name").where("not (type_name = f.type_name and path = f.path)"), F.concat_ws("::", "symbol", "name"), "f.type_name")


# --- ports and adapters ---------------------------------------------------


@rule("PA001", "Warning")
def pa001(x: Facts) -> DataFrame:
    impls = x["air_impl"].where("interface is not null").groupBy(short_name(F.col("interface")).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("impl_path"))
    df = x["air_type"].where("kind = 'Trait'").join(impls.where("n = 1"), "name").where("path = impl_path")
    accepted = x.section("PA")["accepted_colocated"]
    return found(df.where(~any_pattern(F.col("symbol"), accepted) & ~any_pattern(F.col("name"), accepted)), "symbol")


@row_rule("PA002", "Fatal", "air_import")
def pa002(x: Facts) -> Hit:
    p = x.section("PA")
    return two_sided_import(p["application_paths"], p["adapter_paths"])


@row_rule("PA003", "Fatal", "function_facts")
def pa003(x: Facts) -> Hit:
    return by_function(["ExternalIo"], x.section("PA")["application_paths"], "fact_ix")


@row_rule("PA004", "Fatal", "air_truth_action")
def pa004(x: Facts) -> Hit:
    p = x.section("PA")
    outside = ~any_pattern(F.coalesce("module_path", F.lit("")), p["construction_paths"])
    return Hit((F.col("action") == "Construct") & outside & any_pattern(F.col("target"), p["adapter_types"]), "function", "target")


# --- runtime work ---------------------------------------------------------


def outside_runtime(x: Facts, kind: str) -> Hit:
    owners = x.section("RW")["owner_paths"]
    return Hit((F.col("kind") == kind) & F.lit(bool(owners)) & ~any_pattern(module(), owners) & ~any_pattern(F.col("symbol"), owners), "symbol", "fact_ix")


@row_rule("RW001", "Fatal", "function_facts")
def rw001(x: Facts) -> Hit:
    return outside_runtime(x, "SpawnedWork")


@row_rule("RW002", "Warning", "function_facts")
def rw002(x: Facts) -> Hit:
    return outside_runtime(x, "BlockingCall")


@rule("RW003", "Warning")
def rw003(x: Facts) -> DataFrame:
    p = x.section("RW")
    f = placed(x, "air_field").where(F.lit(bool(p["owner_paths"])) & ~any_pattern(module(), p["owner_paths"]) & any_pattern(F.col("type_text"), p["state_types"], type_text_glob))
    g = f.groupBy(*ORD, "path", "line_start", "line_end", "symbol").agg(F.min(F.struct("pos", "name")).alias("f"))
    return found(g, "symbol", "f.name")


@rule("RW004", "Warning")
def rw004(x: Facts) -> DataFrame:
    p = x.section("RW")
    one = x["air_field"].groupBy(*ORD).agg(F.count("*").alias("n"), F.min("type_text").alias("text")).where("n = 1")
    df = placed(x, "air_type").where(F.lit(bool(p["owner_paths"])) & ~any_pattern(module(), p["owner_paths"])).join(one, ORD, "left")
    named, held = any_pattern(F.col("name"), p["singleton_names"], type_text_glob), (F.col("kind") == "Struct") & any_pattern(F.col("text"), p["state_types"], type_text_glob)
    return found(df.where(named | held), "symbol", F.when(named, "name").otherwise("field"))


def on_hot_path(kind: str) -> Hit:
    return Hit((F.col("kind") == kind) & F.col("hot"), "symbol", "fact_ix")


@row_rule("RW005", "Fatal", "function_facts")
def rw005(x: Facts) -> Hit:
    return on_hot_path("BlockingCall")


@row_rule("RW006", "Fatal", "function_facts")
def rw006(x: Facts) -> Hit:
    return on_hot_path("SpawnedWork")


# --- demand ---------------------------------------------------------------


@rule("DA001", "Warning")
def da001(x: Facts) -> DataFrame:
    p = x.section("DA")
    if not p["enabled"]:
        return empty(x)
    last = x["air_type"].where("kind = 'Trait'").groupBy("symbol").agg(F.max(F.struct(*ORD, "path", "line_start", "line_end", "name")).alias("t"))
    traits = last.select("symbol", "t.*")
    names = traits.select(F.explode(F.array("symbol", "name")).alias("as"), "symbol").groupBy("as").agg(F.min("symbol").alias("credited"))
    impls = x["air_impl"].where("interface is not null").select(*ORD, F.trim(F.regexp_replace("interface", "<.*$", "")).alias("as"))
    # exact or by short name: the first trait by symbol gets the credit
    both = impls.select(*ORD, F.explode(F.array_distinct(F.array("as", short_name(F.col("as"))))).alias("as"))
    credit = both.join(names, "as").groupBy(*ORD).agg(F.min("credited").alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n")).where("n = 1")
    return found(traits.join(credit, "symbol").where(~any_pattern(F.col("symbol"), p["accepted"], trailing_segments)), "symbol")


@rule("DA002", "Warning")
def da002(x: Facts) -> DataFrame:
    p = x.section("DA")
    if not p["enabled"]:
        return empty(x)
    acts = x["air_truth_action"].where("action = 'Construct'").groupBy("function").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1")
    fn = x["air_function"].where(any_pattern(F.col("name"), p["factory_names"], name_glob))
    return found(fn.join(acts, F.col("symbol") == F.col("function")), "symbol", "target")


@rule("DA007", "Warning")
def da007(x: Facts) -> DataFrame:
    p = x.section("DA")
    if not p["enabled"]:
        return empty(x)
    one = x["air_variant"].groupBy(*ORD).agg(F.count("*").alias("n"), F.min("name").alias("variant")).where("n = 1")
    return found(x["air_type"].where((F.col("kind") == "Enum") & any_pattern(F.col("name"), p["strategy_names"], name_glob)).join(one, ORD), "symbol", "variant")


# --- responsibilities -----------------------------------------------------


@rule("RM001", "Warning")
def rm001(x: Facts) -> DataFrame:
    p = x.section("RM")
    if not p["max_action_kinds"]:
        return empty(x)
    place = ["path", "module_path", "line_start", "line_end"]
    # sites of one line and action become one row before any sort: a smallest number is kept in place, a struct is not
    sites = x["air_truth_action"].where("function is not null").groupBy("function", "action", "pkg_ix", "file_ix", *place).agg(F.min("item_ix").alias("item_ix"))
    first = F.min(F.struct(*ORD, *place)).alias("a")
    acts = sites.groupBy("function").agg(F.count_distinct("action").alias("n"), first).where(F.col("n") > p["max_action_kinds"])
    fn = x["air_function"].groupBy(F.col("symbol").alias("function")).agg(F.min(F.struct(*ORD, *place)).alias("f"))
    # without a function of that symbol the first action gives the place
    at = acts.join(fn, "function", "left").withColumn("at", F.coalesce("f", "a")).select("function", "n", "at.*")
    return found(at.where(~any_pattern(module(), p["exempt_paths"])), "function", "n")


@row_rule("RM002", "Warning", "function_facts")
def rm002(x: Facts) -> Hit:
    return by_function(["SpawnedWork", "Logging", "ConfigRead"], x.section("RM")["converter_paths"], F.concat_ws(":", "kind", "fact_ix"), True)


def branch_rich(x: Facts, patterns: list[str], cap: int) -> DataFrame:
    acts = x["air_truth_action"].where("action in ('StringCompare', 'DiscriminatedMatch')").groupBy("function").agg(F.count("*").alias("n")).where(F.col("n") > cap)
    fn = first_by(x["air_function"], ["symbol"], "path", "module_path", "line_start", "line_end")
    return found(acts.join(fn, F.col("function") == F.col("symbol")).where(any_pattern(module(), patterns)), "symbol", "n")


@rule("RM003", "Warning")
def rm003(x: Facts) -> DataFrame:
    p = x.section("RM")
    return branch_rich(x, p["handler_paths"], p["handler_cap"])


@rule("RM004", "Warning")
def rm004(x: Facts) -> DataFrame:
    p = x.section("RM")
    return branch_rich(x, p["repository_paths"], p["repository_cap"])


@row_rule("RM005", "Warning", "function_facts")
def rm005(x: Facts) -> Hit:
    return by_function(["ExternalIo", "PersistenceWrite"], x.section("RM")["validator_paths"], F.concat_ws(":", "kind", "fact_ix"))


@row_rule("RM006", "Warning", "function_facts")
def rm006(x: Facts) -> Hit:
    parts = F.split("symbol", "::")
    method = F.exists(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda s: s.rlike(r"^\p{Lu}"))
    written = by_function(["PersistenceWrite"], x.section("RM")["domain_paths"], "fact_ix")
    return Hit(written.when & (F.size(parts) >= 3) & method, "symbol", "fact_ix")


# --- features -------------------------------------------------------------


@rule("FO001", "Fatal")
def fo001(x: Facts) -> DataFrame:
    t = x["air_type"].where("visibility = 'Public'").withColumn("feature", feature_of(module(), x.section("FO")["features"])).where("feature is not null")
    first = t.groupBy("name").agg(F.min(F.struct(*ORD, F.col("feature").alias("ff"))).alias("f"))
    return found(t.join(first, "name").where("feature <> f.ff"), "symbol", F.concat_ws(" -> ", "f.ff", "feature"))


@row_rule("FO004", "Warning", "air_field")
def fo004(x: Facts) -> Hit:
    p = x.section("FO")
    tokens = F.filter(F.split("type_text", r"[^\p{L}\p{N}_:]+"), lambda w: w != "")
    hits = F.filter(F.transform(tokens, lambda w: feature_of(w, p["features"])), lambda h: h.isNotNull())
    hit = F.try_element_at(hits, F.lit(1))
    return Hit(any_pattern(module(), p["shared_paths"]) & hit.isNotNull(), F.concat_ws(".", "symbol", "name"), hit)


# --- observability and configuration --------------------------------------


@row_rule("OB001", "Warning", "function_facts")
def ob001(x: Facts) -> Hit:
    p = x.section("OB")
    hit = first_pattern(F.col("evidence"), p["log_targets"])
    outside = F.lit(bool(p["observer_paths"])) & ~any_pattern(module(), p["observer_paths"])
    return Hit((F.col("kind") == "Logging") & hit.isNotNull() & outside, "symbol", F.concat_ws(":", hit, "fact_ix"))


def emission(macros: list[str], owners: list[str]) -> Hit:
    hit = first_pattern(F.col("callee"), macros)
    outside = F.col("module_path").isNotNull() & F.lit(bool(owners)) & ~any_pattern(module(), owners)
    return Hit((F.col("call_kind") == "Meta") & hit.isNotNull() & outside, "function", hit)


@row_rule("OB002", "Warning", "air_call_site")
def ob002(x: Facts) -> Hit:
    p = x.section("OB")
    return emission(p["metric_macros"], p["metric_owner_paths"])


@row_rule("OB003", "Warning", "air_call_site")
def ob003(x: Facts) -> Hit:
    p = x.section("OB")
    return emission(p["event_macros"], p["event_owner_paths"])


@rule("OB004", "Warning")
def ob004(x: Facts) -> DataFrame:
    f = x["air_fact"].where("scope = 'Function'")
    entries = f.where("kind = 'BoundaryEntry'").select("symbol").distinct().join(f.where("kind = 'Logging'").select("symbol"), "symbol", "left_anti")
    fn = first_by(x["air_function"], ["symbol"], "path", "module_path", "line_start", "line_end").where("module_path is not null")
    df = entries.join(fn, "symbol", "left").withColumns({"path": F.coalesce("path", F.lit("<unknown>")), **{c: F.coalesce(c, F.lit(0)) for c in ("line_start", "line_end")}})
    return found(df, "symbol")


@row_rule("CF001", "Fatal", "function_facts")
def cf001(x: Facts) -> Hit:
    paths = x.section("CF")["config_paths"]
    return Hit((F.col("kind") == "ConfigRead") & F.lit(bool(paths)) & ~any_pattern(module(), paths, segments_or_name), "symbol", "fact_ix")


@row_rule("CF002", "Warning", "air_literal")
def cf002(x: Facts) -> Hit:
    p = x.section("CF")
    outside = F.col("module_path").isNotNull() & F.lit(bool(p["config_paths"])) & ~any_pattern(module(), p["config_paths"], segments_or_name)
    return Hit(outside & F.lower("kind").isin(*p["literal_kinds"]), "function", "value")


@row_rule("CF003", "Warning", "air_literal")
def cf003(x: Facts) -> Hit:
    p = x.section("CF")
    outside = F.col("module_path").isNotNull() & F.lit(bool(p["config_paths"])) & ~any_pattern(module(), p["config_paths"], segments_or_name)
    hit = first_pattern(F.regexp_replace("value", '^"(.*)"$', "$1"), p["id_patterns"], segments_or_name)
    return Hit((F.col("kind") == "Str") & outside & hit.isNotNull(), "function", hit)


# --- tests and utilities --------------------------------------------------


@row_rule("TA001", "Warning", "air_type")
def ta001(x: Facts) -> Hit:
    hit = first_pattern(module(), x.section("TA")["test_paths"])
    return Hit((F.col("visibility") == "Public") & hit.isNotNull(), "symbol", hit)


@row_rule("TA002", "Warning", "air_type")
def ta002(x: Facts) -> Hit:
    p = x.section("TA")
    hit = first_pattern(F.col("name"), p["canonical_names"], path_or_name)
    return Hit(any_pattern(module(), p["test_paths"]) & hit.isNotNull(), "symbol", hit)


@rule("TA003", "Warning")
def ta003(x: Facts) -> DataFrame:
    p = x.section("TA")
    names = x["air_field"].groupBy(*ORD).agg(F.collect_set("name").alias("own"))
    t = x["air_type"].where((F.col("kind") == "Struct") & any_pattern(module(), p["test_paths"])).join(names, ORD)
    echo = F.lit(False)
    for n in p["canonical_names"]:
        echo = echo | F.col("name").contains(n.strip("*"))
    sets = [F.struct(jaccard(F.col("own"), F.array(*map(F.lit, fs))).alias("j"), F.lit(-i).alias("i"), F.lit(n).alias("of")) for i, (n, fs) in enumerate(p["canonical_fields"])]
    if not sets:
        return empty(x)
    df = t.where(echo).withColumn("best", F.array_max(F.array(*sets)))
    return found(df.where(F.col("best.j") >= F.lit(0.5).cast("float")), "symbol", "best.of")


@row_rule("TA004", "Warning", "air_impl")
def ta004(x: Facts) -> Hit:
    p = x.section("TA")
    i, s = F.col("interface"), short_name(F.col("interface"))
    hit = any_pattern(i, p["port_traits"]) | any_pattern(s, p["port_traits"]) | any_pattern(i, p["port_traits"], path_or_name) | any_pattern(s, p["port_traits"], path_or_name)
    return Hit(i.isNotNull() & any_pattern(module(), p["test_paths"]) & ~any_pattern(module(), p["adapter_paths"]) & hit, "target_type", "interface")


@row_rule("UT001", "Warning", "air_type")
def ut001(x: Facts) -> Hit:
    hit = first_pattern(module(), x.section("UT")["utility_paths"])
    return Hit((F.col("visibility") == "Public") & hit.isNotNull(), "symbol", hit)


@row_rule("UT002", "Fatal", "air_import")
def ut002(x: Facts) -> Hit:
    p = x.section("UT")
    return two_sided_import(p["utility_paths"], p["forbidden_imports"])


@row_rule("UT003", "Warning", "files")
def ut003(x: Facts) -> Hit:
    p = x.section("UT")
    hit = first_pattern(module(), p["generic_patterns"])
    return Hit(hit.isNotNull() & ~any_pattern(module(), p["accepted_modules"]), "module_path", hit)


def utility_actions(x: Facts, actions: list[str], canonical: bool) -> Hit:
    p = x.section("UT")
    hit = any_pattern(F.col("target"), p["canonical_constructs"])
    within = F.col("action").isin(*actions) & any_pattern(module(), p["utility_paths"])
    return Hit(within & (hit if canonical else ~hit), "function", F.concat_ws(":", "action", "target"))


@row_rule("UT004", "Warning", "air_truth_action")
def ut004(x: Facts) -> Hit:
    return utility_actions(x, ["Construct", "Validate", "Normalize"], True)


@row_rule("UT005", "Warning", "air_truth_action")
def ut005(x: Facts) -> Hit:
    return utility_actions(x, ["Validate", "Normalize"], False)
