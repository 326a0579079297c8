"""Inventories, surveys and onboarding suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.functions.text import concept_id, matched_suffix, stem
from girder.operators.concepts import elect
from girder.operators.shared import hint_targets, layers, percentile, top_modules

from .decide import expired
from .policy import DEFAULTS
from .rules import Facts, feature_of, package_edges

# fixed values: what may be asked for, with the fact kind of those that are no hints
KINDS = {
    "canonical": None, "boundary": None, "converter": None, "spawned-work": "SpawnedWork", "config-read": "ConfigRead", "logging": "Logging", "external-io": "ExternalIo",
    "persistence-write": "PersistenceWrite", "blocking-call": "BlockingCall", "hot-path": "HotPath", "request-context": "RequestContext", "boundary-entry": "BoundaryEntry",
    "runtime-state-owner": "RuntimeStateOwner", "background-worker": "BackgroundWorker",
}
HINT_KINDS = ("canonical", "boundary", "converter", "allow", "protocol_translation", "marker")


def by_kind(facts: Facts, kind: str) -> DataFrame:
    """(symbol, path, line) of a hint or fact kind, by symbol and path. Converters are hinted ones and conversions, once each. An unknown kind raises."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}; known: {', '.join(KINDS)}")
    kind = KINDS[kind] or kind
    items = facts["air_type"].select("pkg_ix", "file_ix", "item_ix", "symbol", "line_start", "line_end").unionByName(
        facts["air_function"].select("pkg_ix", "file_ix", "item_ix", "symbol", "line_start", "line_end")
    )
    if kind in HINT_KINDS:
        h = hint_targets(facts["air_hint"].where(F.col("category") == kind), items)
        out = h.select(F.coalesce("target_symbol", "module_path", "path").alias("symbol"), "path", F.col("target_start").cast("int").alias("line"))
        if kind == "converter":
            c = facts["air_conversion"].select("symbol", "path", F.col("line_start").cast("int").alias("line"))
            out = out.unionByName(c)
        return out.distinct().orderBy("symbol", "path", "line")
    fn = facts["air_function"].groupBy("symbol").agg(F.min(F.struct("pkg_ix", "file_ix", "item_ix", "path", "line_start")).alias("first"))
    # a symbol's facts are equal rows: they are counted before the join and the sort, and written out after
    f = facts["air_fact"].where(F.col("kind") == kind).groupBy("symbol").agg(F.count("*").alias("n")).join(fn, "symbol", "left")
    f = f.select("symbol", F.coalesce("first.path", F.lit("")).alias("path"), F.coalesce("first.line_start", F.lit(1)).cast("int").alias("line"), "n").orderBy("symbol", "path")
    return repeated(f, "n")


#: Copies of a row that are made of one array.
BLOCK = 4096


def repeated(rows: DataFrame, n: str) -> DataFrame:
    """Each row as often as its column ``n`` says, in the order of the rows; two steps, so that no array is as long as a large ``n``."""
    left = F.least(F.lit(BLOCK), F.col(n) - F.col("_block") * BLOCK)
    df = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / BLOCK))))
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), left.cast("int")))).drop(n, "_block", "_copy")


#: In the order of the inventory.
STATUSES = ["Expired", "LegacyNoMetadata", "Unbounded", "Active"]


def debt(facts: Facts, today: str) -> DataFrame:
    """Every suppression (origin, rule, target, reason, expires, status): hints, exceptions, exempt paths and acknowledged families.

    A hint without a date is Unbounded. Exempt paths and acknowledged families
    that lack a reason, date or owner are LegacyNoMetadata; exempt paths count
    where the policy has a CX section, the default ones too.
    """
    spark = facts["air_file"].sparkSession
    line = F.coalesce("target_start", "line_start").cast("int")
    h = facts["air_hint"].where("category = 'allow'").select(F.lit("hint").alias("origin"), "rule", F.concat_ws(":", "path", line).alias("target"), "reason", "expires", F.lit(True).alias("complete"))
    e = facts["policy_exception"].select(F.lit("exception").alias("origin"), "rule", "target", "reason", "expires", F.lit(True).alias("complete"))

    def row(origin: str, rule: str, target: str, entry: dict) -> tuple:
        return origin, rule, target, entry.get("reason"), entry.get("expires"), all(entry.get(k) for k in ("reason", "expires", "owner"))

    exempt = facts.section("CX")["exempt_paths"] if facts.policy.explicit("CX") is not None else []
    rows = [row("exempt", "CX007", "paradigms.CX.exempt_paths:" + (p if isinstance(p, str) else p["path"]), {} if isinstance(p, str) else p) for p in exempt]
    rows += [row("acknowledged", "GOV002", "acknowledged_empty:" + (x if isinstance(x, str) else x["prefix"]), {} if isinstance(x, str) else x) for x in facts.policy.acknowledged]
    fixed = spark.createDataFrame(rows, "origin string, rule string, target string, reason string, expires string, complete boolean")
    status = F.when(~F.col("complete"), "LegacyNoMetadata").when(F.col("expires").isNull(), "Unbounded").when(expired(F.col("expires"), today), "Expired").otherwise("Active")
    return h.unionByName(e).unionByName(fixed).withColumn("status", status).drop("complete")


def in_order(inventory: DataFrame) -> DataFrame:
    """The inventory as it is shown: by status, rule and target."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return inventory.orderBy(rank, "rule", "target")


def debt_by_rule(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("rule").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def prune(exceptions: DataFrame, today: str) -> DataFrame:
    """Exceptions that have not expired."""
    return exceptions.where(F.col("expires") >= today)


def pruned(exceptions: DataFrame, today: str) -> DataFrame:
    """One row (kept, removed) of what ``prune`` does."""
    return exceptions.agg(F.count_if(F.col("expires") >= today).alias("kept"), F.count_if(~F.coalesce(F.col("expires") >= today, F.lit(False))).alias("removed"))


def largest_files(facts: Facts, n: int = 5) -> DataFrame:
    return facts["air_file"].select("path", "line_count").orderBy(F.desc("line_count"), "path").limit(n)


def largest_clusters(facts: Facts, n: int = 5) -> DataFrame:
    c = facts.clusters()
    return c.groupBy("stem").agg(F.count("*").alias("members"), F.count_distinct("name").alias("names"), F.round(F.max("confidence"), 4).alias("confidence")).orderBy(F.desc("members"), "stem").limit(n)


def internal_edges(facts: Facts) -> DataFrame:
    """Package edges whose two ends are packages of the workspace."""
    e = package_edges(facts)
    names = facts["air_file"].select(F.translate("package", "-", "_").alias("p")).distinct()
    return e.join(names, F.col("src") == F.col("p"), "left_semi").join(names, F.col("dst") == F.col("p"), "left_semi").select("src", "dst")


def pressure(findings: DataFrame) -> DataFrame:
    """Diagnostics by family and rule, all as advice."""
    return findings.groupBy(F.left("rule_id", F.lit(2)).alias("family"), "rule_id").agg(F.count("*").alias("n"))


def suggested_concepts(facts: Facts) -> DataFrame:
    """Concepts to declare: clusters without an accepted concept, their canonical hinted or elected, with a confidence tier.

    Of a hinted canonical the hinted boundaries go with it, of an elected one
    the members that look like one; a cluster without any is passed over, as is one below .7.
    """
    c = facts.clusters()
    known = facts["policy_concept"].select(concept_id(F.col("concept")).alias("concept")).distinct()
    open_ = c.join(known, "concept", "left_anti")
    hinted = open_.where("role = 'Canonical'").groupBy("stem").agg(F.min(F.struct("pkg_ix", "file_ix", "item_ix", "symbol")).alias("h")).select("stem", F.col("h.symbol").alias("hinted"))
    chosen = elect(open_, facts["air_conversion"]).select("stem", F.col("symbol").alias("elected"))
    canon = hinted.join(chosen, "stem", "full").select("stem", "hinted", F.coalesce("hinted", "elected").alias("canonical"))
    looks = matched_suffix(F.col("name")).isNotNull() | F.exists(F.split("symbol", "::"), lambda s: s.isin("api", "dto", "dtos", "transport")) | (F.col("overlap") >= F.lit(0.5).cast("float"))
    bound = F.when(F.col("hinted").isNotNull(), F.col("role") == "Boundary").otherwise((F.col("symbol") != F.col("canonical")) & looks)
    g = open_.join(canon, "stem").groupBy("stem", "concept", "canonical", "hinted").agg(F.count("*").alias("members"), F.count_if(bound).alias("boundaries"), F.max("confidence").alias("confidence"))
    score = F.round(F.col("confidence") - F.when(F.col("hinted").isNull(), 0.1).otherwise(0.0), 6)
    df = g.withColumn("score", score).where("boundaries > 0 and score >= 0.7")
    return df.select("concept", "canonical", "members", "boundaries", F.when(F.col("score") >= 0.95, "High").otherwise("Medium").alias("tier"))


def bootstrap(facts: Facts) -> DataFrame:
    """A first policy from hints (concept, role, symbol, from_type, to_type): clusters with a hinted canonical, its boundaries and the
    conversions between them, then hinted canonicals of no cluster, where their concept is still free."""
    c = facts.clusters()
    none = F.lit(None).cast("string")
    canon = c.where("role = 'Canonical'").groupBy("concept", "stem").agg(F.min(F.struct("pkg_ix", "file_ix", "item_ix", "symbol")).alias("f")).select("concept", "stem", F.col("f.symbol").alias("symbol"))
    bound = c.where("role = 'Boundary'").join(canon.select("stem"), "stem", "left_semi").select("concept", "symbol")
    ends = canon.select("concept", "symbol").unionByName(bound)
    named = ends.select("concept", F.explode(F.array("symbol", F.substring_index("symbol", "::", -1))).alias("end")).distinct()
    conv = facts["air_conversion"].withColumns({"f": F.trim("from_type"), "t": F.trim("to_type")})
    conv = conv.join(named.toDF("concept", "f"), "f").join(named.toDF("c2", "t"), "t").where("concept = c2")
    types, hints = facts["air_type"], facts["air_hint"].where("category = 'canonical'").select("pkg_ix", "file_ix", "target_start")
    single = types.join(hints, ["pkg_ix", "file_ix"]).where("target_start between line_start and line_end").join(canon.select("symbol"), "symbol", "left_anti")
    single = single.withColumn("concept", concept_id(stem(F.col("name")))).join(canon.select("concept"), "concept", "left_anti")
    single = single.groupBy("concept").agg(F.min(F.struct("pkg_ix", "file_ix", "item_ix", "symbol")).alias("f")).select("concept", F.col("f.symbol").alias("symbol"))
    row = lambda df, role: df.select("concept", F.lit(role).alias("role"), "symbol", none.alias("from_type"), none.alias("to_type"))
    return row(canon, "canonical").unionByName(row(bound, "boundary")).unionByName(conv.select("concept", F.lit("converter").alias("role"), "symbol", "from_type", "to_type")).unionByName(row(single, "canonical"))


def suggested_api(facts: Facts, least: int = 3) -> DataFrame:
    """Features without a public api that other features reach ``least`` times or more."""
    fs = facts.section("DG")["features"]
    closed = [f[0] for f in fs if not f[2]]
    df = facts["air_import"].withColumns({"of": feature_of(F.col("module_path"), fs), "to": feature_of(F.col("import_path"), fs)})
    return df.where(F.col("to").isin(*closed) & (F.col("of") != F.col("to"))).groupBy("to").agg(F.count("*").alias("reaches")).where(F.col("reaches") >= least)


def suggested_thresholds(facts: Facts) -> DataFrame:
    """Budgets whose 95th percentile is over one and a half times the default (of kinds of work: over 3): (family, value, default)."""
    act = facts["air_truth_action"]
    per_file = facts["air_type"].where("visibility = 'Public'").groupBy("pkg_ix", "file_ix").agg(F.count("*").alias("v"))
    wiring = act.where("action = 'Construct'").groupBy("function").agg(F.count("*").alias("v"))
    kinds = act.groupBy("function").agg(F.count_distinct("action").alias("v"))
    parts = [
        ("CX", percentile(facts["air_function"], "line_count", 0.95), DEFAULTS["CX"]["fn_lines"], 1.5),
        ("MO", percentile(per_file, "v", 0.95), DEFAULTS["MO"]["max_public_types"], 1.5),
        ("CR", percentile(wiring, "v", 0.95), DEFAULTS["CR"]["wiring_density"], 1.5),
        ("RM", percentile(kinds, "v", 0.95), 3, 1.0),
    ]
    out = None
    for family, df, default, factor in parts:
        row = df.where(F.col("value") > default * factor).select(F.lit(family).alias("family"), F.col("value").cast("long").alias("value"), F.lit(default).cast("long").alias("default"))
        out = row if out is None else out.unionByName(row)
    return out


def suggested_layers(facts: Facts) -> DataFrame:
    """Globs of detected layers for families whose own list is empty."""
    wanted = {"composition": ("CR", "root_paths"), "config": ("CF", "config_paths"), "tests": ("TA", "test_paths"), "utilities": ("UT", "utility_paths"), "domain": ("BO", "domain_paths")}
    known = {x if isinstance(x, str) else x.get("prefix") for x in facts.policy.acknowledged}
    names = [k for k, (fam, key) in wanted.items() if not facts.section(fam)[key] and fam not in known]
    family = F.create_map(*[F.lit(x) for k, (fam, _) in wanted.items() for x in (k, fam)])
    return layers(facts["air_file"]).where(F.col("layer").isin(*names)).select(family[F.col("layer")].alias("family"), "glob")


def cross_family(facts: Facts) -> DataFrame:
    """(family, value): domain globs for the four families that need a domain, modules as features for the two that partition, while none of them has any."""
    spark = facts["air_file"].sparkSession
    out = spark.createDataFrame([], "family string, value string")
    each = lambda df, families: df.select(F.explode(F.array(*map(F.lit, families))).alias("family"), "value")
    if not any((facts.policy.explicit(f) or {}).get("domain_paths") for f in ("BO", "ER", "FL", "RM")):
        out = out.unionByName(each(layers(facts["air_file"]).where("layer = 'domain'").select(F.col("glob").alias("value")), ["BO", "ER", "FL", "RM"]))
    if not any((facts.policy.explicit(f) or {}).get("features") for f in ("DG", "FO")):
        out = out.unionByName(each(top_modules(facts["air_file"]).select(F.col("module").alias("value")), ["DG", "FO"]))
    return out


# fixed values: families that an unset section seeds a suggestion for
SEEDED = ["AB", "BO", "CF", "CR", "DA", "DC", "DG", "ER", "FL", "FO", "OB", "PA", "RM", "RW", "TA", "UT"]


def _bare(value: object) -> bool:
    """Nothing configured: null, or a list or object of nothing but such."""
    return value is None or isinstance(value, (dict, list)) and all(map(_bare, value.values() if isinstance(value, dict) else value))


def vacancy_seeds(facts: Facts, covered: DataFrame) -> DataFrame:
    """(family): seeded families with an empty section that are neither acknowledged nor in ``covered`` (family)."""
    known = {x if isinstance(x, str) else x.get("prefix") for x in facts.policy.acknowledged}
    open_ = [f for f in SEEDED if f not in known and _bare(facts.policy.explicit(f))]
    seeds = facts["air_file"].sparkSession.createDataFrame([(f,) for f in open_], "family string")
    return seeds.join(covered.select("family").distinct(), "family", "left_anti")


def merge_suggestions(suggestions: DataFrame) -> DataFrame:
    """Suggestions (family, headline, commands, why) of equal commands as one: families and reasons joined in order."""
    g = suggestions.groupBy("commands").agg(F.array_sort(F.collect_list(F.struct("family", "headline", "why"))).alias("s"))
    return g.select(F.col("s").getItem(0)["headline"].alias("headline"), F.array_distinct(F.transform("s", lambda x: x["family"])).alias("families"), F.array_distinct(F.transform("s", lambda x: x["why"])).alias("why"), "commands")
