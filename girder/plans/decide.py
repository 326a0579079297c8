"""From findings to diagnostics: strict severities, policy rows, suppression, scope, policy diff."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.operators.intervals import overlap
from girder.operators.shared import path_pairs

from girder.scratch import at_once, made_of, materialize, together

from .policy import ACKNOWLEDGED, DEFAULTS, VACANCY, Policy
from .rules import FINDING, RULES, Facts, all_hits

#: Order of evaluation, which numbers findings.
ORDER = {r: i for i, r in enumerate(RULES)}
#: Rules planned as one job: enough to keep executors busy, few enough for the driver, which plans all that is left of a job
#: anew whenever a stage ends, so that its garbage grows with the square of the batch.
BATCH = 3


def observe(facts: Facts, rules: list[str] | None = None) -> DataFrame:
    """All findings of the rules (all of the catalogue, if none are named); finding_id numbers them by rule and ordinal."""
    return in_order(found(facts, rules))


def found(facts: Facts, rules: list[str] | None = None) -> DataFrame:
    """All findings of the rules, in no order.

    Rules over single rows share one pass over their source, whose rows explode
    to what the rules say of them. The others, which join or aggregate, run in
    batches. All these jobs are handed to Spark at once and written to the
    shared folder, as every later step reads them several times.
    """
    ids = rules or list(RULES)
    shared: dict[str, list[str]] = {}
    for i in ids:
        if RULES[i].source:
            shared.setdefault(RULES[i].source, []).append(i)
    apart = [i for i in ids if not RULES[i].source]
    jobs = [lambda n=n, own=own: all_hits(facts, n, own) for n, own in shared.items()]
    jobs += [lambda some=apart[lo : lo + BATCH]: reduce(DataFrame.unionByName, [RULES[i].observe(facts) for i in some]) for lo in range(0, len(apart), BATCH)]
    parts = at_once([lambda make=make: materialize(make(), "findings") for make in jobs])
    return together(*parts)


def in_order(findings: DataFrame) -> DataFrame:
    """Findings with their places by rule and ordinal as finding_id."""
    rank = F.create_map(*[F.lit(x) for i in ORDER for x in (i, ORDER[i])])
    return numbered(findings, "finding_id", rank[F.col("rule_id")], "pkg_ix", "file_ix", "item_ix", "subject", "detail")


def numbered(df: DataFrame, name: str, *order: Column | str, after: int = 0) -> DataFrame:
    """``df`` with the rows' places in the order as ``name``, from ``after`` + 1.

    Rows are dealt to ranges of the order, sorted there and written once with
    their places in the range: one shuffle, and no task orders more than a
    range, whatever a rule finds. The rows of the ranges before are added when read.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()  # the partition's number in the upper bits, the row's place in the lower 33
    held = materialize(dealt.withColumns({"_part": F.shiftright(place, 33).cast("int"), "_rn": place.bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    sizes = held.groupBy("_part").agg(F.count("*").alias("n"))
    before = materialize(sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before")), "ranges")  # a row a range
    out = held.join(F.broadcast(before), "_part").withColumn(name, F.lit(after + 1) + F.col("_before") + F.col("_rn")).select(*df.columns, name)
    return made_of(out, held, before)


def elevate(findings: DataFrame) -> DataFrame:
    """Strict mode: warnings become fatal; of the line budgets only those that an override or the policy itself narrows."""
    return findings.withColumn("severity", F.when((F.col("severity") == "Warning") & F.col("narrowed"), "Fatal").otherwise(F.col("severity")))


def decide(findings: DataFrame) -> DataFrame:
    """One decision a finding: advisory ones stay advisory, others are active."""
    return findings.withColumn("status", F.when(F.col("severity") == "Advisory", "Advisory").otherwise("Active"))


#: A decision: which finding, by which policy, with what outcome; ``code`` stands in the diagnostic in place of the rule's id.
DECISION = "finding_id long, policy string, status string, severity string, code string, why string"


@dataclass(frozen=True)
class Step:
    """A policy of the chain: from all findings and the decisions so far to new findings (or None) and what it decides of all that then stand.

    New findings have the columns of ``NEW``; ``decide`` gets the findings,
    numbered, the new ones included, those new ones alone, and the decisions so
    far, and returns ``DECISION`` but the policy's name.
    """

    name: str
    observe: Callable[[DataFrame, DataFrame], DataFrame | None]
    decide: Callable[[DataFrame, DataFrame | None, DataFrame], DataFrame]


NEW = ["rule_id", "severity", "path", "line_start", "line_end", "subject", "detail"]


def chain(findings: DataFrame, steps: list[Step]) -> tuple[DataFrame, DataFrame]:
    """Findings and decisions after all policies, in order: each sees what the earlier ones added and decided, in one pass.

    New findings are numbered after the last. Each step's tables are written, so
    the plan of a later one does not hold those before it.
    """
    spark = findings.sparkSession
    found, decisions = findings.select("finding_id", *NEW), spark.createDataFrame([], DECISION)
    for step in steps:
        new = step.observe(found, decisions)
        if new is not None:
            last = found.agg(F.coalesce(F.max("finding_id"), F.lit(0))).first()[0]
            new = materialize(numbered(new.select(*NEW), "finding_id", "rule_id", "subject", "detail", after=last), "added")
            found = found.unionByName(new.select("finding_id", *NEW))
        made = step.decide(found, new, decisions).withColumn("policy", F.lit(step.name))
        decisions = materialize(decisions.unionByName(made.select(*decisions.columns)), "decisions")
    return found, decisions


def _new(df: DataFrame, code: str, severity: str | Column, subject: Column | str, detail: Column | str) -> DataFrame:
    """Governance findings, which stand at the policy's file."""
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(code).alias("rule_id"), severity.alias("severity"), F.lit("policy.json").alias("path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), text(subject).alias("subject"), text(detail).alias("detail"))


def _all_new(found: DataFrame, new: DataFrame | None, decisions: DataFrame) -> DataFrame:
    """A policy that adds findings decides just these: advice stays advice, the rest is active."""
    return passed(new)


def passed(findings: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return decide(findings).select("finding_id", "status", "severity", none.alias("code"), none.alias("why"))


def integrity(known: list[str]) -> Step:
    """GOV003, a warning a code that no registered rule has."""
    return Step("registry-integrity", lambda found, _: _new(registry_rows(found, known), "GOV003", "Warning", "subject", "n"), _all_new)


def coherent(rows: Callable[[], DataFrame]) -> Step:
    """GOV004, an advice a row (name, what) of a drift between declaration and registry."""
    return Step("registry-coherence", lambda found, _: _new(rows(), "GOV004", "Advisory", "name", "what"), _all_new)


def source_of_truth(declared: dict[str, str], known: dict[str, list[str]]) -> Step:
    """GOV005 for identifiers that findings use and no registry holds; governance findings are the policies' own."""

    def observe(found: DataFrame, _: DataFrame) -> DataFrame:
        gov = F.col("rule_id").startswith("GOV")
        o = found.select(F.when(gov, "policy").otherwise("rule").alias("origin"), F.when(~gov, F.col("rule_id")).alias("rule_id"), F.when(~gov, F.left("rule_id", F.lit(2))).alias("family"), F.lit(None).cast("string").alias("policy"), F.when(gov, F.col("rule_id")).alias("code"))
        return _new(concept_bypasses(o, declared, known), "GOV005", F.col("severity"), "identifier", "concept")

    return Step("concept-source-of-truth", observe, _all_new)


def pass_through() -> Step:
    """Decides whatever no earlier policy has."""
    return Step("default", lambda found, _: None, lambda found, new, decisions: passed(found.join(decisions.select("finding_id").hint("merge"), "finding_id", "left_anti")))


def undecided(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Finding ids without exactly one decision: must be empty."""
    n = decisions.groupBy("finding_id").agg(F.count("*").alias("n"))
    return findings.select("finding_id").join(n.hint("merge"), "finding_id", "left").where("n is null or n <> 1").select("finding_id", F.coalesce("n", F.lit(0)).alias("n"))


def expired(expires: Column, today: str) -> Column:
    """Dates are texts and compared as such; none never expires, today is still live."""
    return F.coalesce(expires < today, F.lit(False))


def rule_keys(rule: Column) -> Column:
    """What a pattern may say to match a rule, as equal keys: ``*``, the rule without regard to case, or its two letters exactly."""
    family = F.when(F.length(rule) >= 2, F.concat(F.lit("2"), F.left(rule, F.lit(2))))
    return F.array_compact(F.array(F.lit("*"), F.concat(F.lit("="), F.lower(rule)), family))


def pattern_keys(pattern: Column) -> Column:
    exact = F.concat(F.lit("="), F.lower(pattern))
    return F.when(pattern == "*", F.array(F.lit("*"))).when(F.length(pattern) == 2, F.array(exact, F.concat(F.lit("2"), pattern))).otherwise(F.array(exact))


#: What an allowance looks at: findings that agree in these share their allowances.
PLACE = ["rule_id", "path", "line_start", "line_end"]
#: Marks up to which a file's places meet them one by one; beyond, they meet by the tiles of a tree.
CROWD = 256


def marks(hints: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Hints and exceptions as (file, key, low, high, whole, expires, seq): lines or a whole file, in scan order; of those that differ in their order alone the first counts."""
    h = hints.where("category = 'allow' and target_start is not null").select(
        F.col("path").alias("file"), F.explode(pattern_keys(F.col("rule"))).alias("key"), F.col("target_start").cast("int").alias("low"), F.col("target_end").cast("int").alias("high"), F.lit(False).alias("whole"), "expires",
        F.struct(F.lit(0).alias("k"), F.col("pkg_ix").cast("int").alias("a"), F.col("file_ix").cast("int").alias("b"), F.col("item_ix").cast("long").alias("c")).alias("seq"),
    )
    target = F.regexp_extract("target", r"^(.*):(\d+)$", 1)
    at = F.expr(r"try_cast(nullif(regexp_extract(target, '^(.*):(\\d+)$', 2), '') as int)")
    e = exceptions.select(
        F.when(target != "", target).otherwise(F.col("target")).alias("file"), F.explode(pattern_keys(F.col("rule"))).alias("key"), at.alias("low"), at.alias("high"), at.isNull().alias("whole"), "expires",
        F.struct(F.lit(1).alias("k"), F.col("ix").cast("int").alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("c")).alias("seq"),
    )
    # a target of "*" fits any file, whatever line it names
    any_file = (F.col("file") == "*") & (F.col("seq.k") == 1)
    both = h.unionByName(e).withColumns({"any": any_file, "whole": F.col("whole") | any_file, "low": F.when(~any_file, F.col("low")), "high": F.when(~any_file, F.col("high"))})
    return both.groupBy("file", "key", "low", "high", "whole", "expires", "any").agg(F.min("seq").alias("seq"))


def allowances(diagnostics: DataFrame, hints: DataFrame, exceptions: DataFrame, today: str) -> DataFrame:
    """Hints and exceptions that apply to the places of diagnostics, in scan order: (rule_id, path, line_start, line_end, expires, seq, live).

    Only the distinct places are looked at, not every finding. A file's places
    meet its marks by the whole path; in files with more marks than ``CROWD``
    rules meet patterns by equal keys and lines meet by the tiles of a tree, so
    that a crowded file is not the square of what stands in it. Both ways are exact.
    """
    m = materialize(marks(hints, exceptions), "marks")
    places = materialize(diagnostics.select(*PLACE).distinct(), "places")
    same = path_pairs(places.select("path"), m.where("not any").select("file")).toDF("path", "file")
    own = materialize(m.where("not any").join(same, "file").drop("file", "any"), "marks")
    crowd = own.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("path")
    cols = [*PLACE, "expires", "seq"]
    fits = F.col("whole") | F.expr("low <= high and line_start <= line_end and low <= line_end and line_start <= high")
    few = own.join(crowd, "path", "left_anti").join(places, "path").where(F.array_contains(rule_keys(F.col("rule_id")), F.col("key")) & fits)
    keyed = lambda df: df.withColumn("key", F.explode(rule_keys(F.col("rule_id"))))
    there, many = keyed(places.join(crowd, "path", "left_semi")), own.join(crowd, "path", "left_semi")
    by_file = there.join(many.where("whole"), ["path", "key"])
    by_line = overlap(there, many.where("not whole"), ["path", "key"], ("line_start", "line_end"), ("low", "high"))
    by_any = keyed(places).join(m.where("any").select("key", "expires", "seq"), "key")
    return reduce(DataFrame.unionByName, [x.select(*cols) for x in (few, by_file, by_line, by_any)]).withColumn("live", ~expired(F.col("expires"), today))


def suppress(diagnostics: DataFrame, hints: DataFrame, exceptions: DataFrame, today: str) -> DataFrame:
    """Diagnostics without those that a live allowance covers, and a GOV001 row for every expired one met before it."""
    a = allowances(diagnostics, hints, exceptions, today).repartition(*PLACE).groupBy(*PLACE, "expires", "live").agg(F.min("seq").alias("seq"))
    a = a.withColumn("stop", F.min(F.when(F.col("live"), F.col("seq"))).over(Window.partitionBy(*PLACE)))
    a = materialize(a.select(*PLACE, "expires", "live", F.col("stop").isNotNull().alias("stopped"), (F.col("stop").isNull() | (F.col("seq") < F.col("stop"))).alias("told")), "allowances")  # read twice
    stopped = a.where("live and stopped").select(*[F.col(c).alias(f"_{c}") for c in PLACE]).distinct()
    kept = diagnostics.join(stopped.hint("merge"), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLACE]), "left_anti")
    notes = a.where("not live and told").select("rule_id", "path", "line_start", "expires").distinct()
    notes = notes.select(F.lit("GOV001").alias("rule_id"), F.lit("Warning").alias("severity"), "path", "line_start", F.col("line_start").alias("line_end"), F.col("rule_id").alias("subject"), F.col("expires").alias("detail"))
    cols = ["rule_id", "severity", "path", "line_start", "line_end", "subject", "detail"]
    return kept.select(*cols).unionByName(notes.select(*cols))


def changed_only(diagnostics: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows whose file equals a changed path or ends with it, or it with the file, at a path boundary."""
    same = path_pairs(diagnostics.select("path"), changed.select("path"), at_boundary=True).select(F.col("a").alias("path")).distinct()
    return diagnostics.join(same, "path", "left_semi")


def vacancies(entries: DataFrame, policy_file: str = "policy.json") -> DataFrame:
    """GOV002, one advisory a family with nothing to check: none of its telling members has an entry that says something, and no entry acknowledges it."""
    spark = entries.sparkSession
    members = spark.createDataFrame([(f, k) for f, keys in VACANCY.items() for k in keys], "family string, key string")
    filled = entries.where("name is not null or coalesce(value, 0) <> 0").join(members, ["family", "key"], "left_semi").select("family")
    known = entries.where(F.col("key") == ACKNOWLEDGED).select(F.col("name").alias("family"))
    vacant = members.select("family").distinct().join(filled.unionByName(known), "family", "left_anti")
    rows = vacant.select(F.lit("GOV002").alias("rule_id"), F.lit("Advisory").alias("severity"), F.lit(policy_file).alias("path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.col("family").alias("subject"))
    return rows.withColumn("detail", F.lit(None).cast("string"))


POLICY_ROWS = "rule_id string, severity string, path string, line_start int, line_end int, subject string, detail string"


def materialise(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Diagnostics of decided findings but the suppressed ones; a decision's code comes before the rule's id, a missing place becomes the policy file's first line.

    ``findings`` need finding_id, rule_id, path, lines, subject and detail, ``decisions`` finding_id, status, severity, code and why.
    """
    d = decisions.select("finding_id", "status", F.col("severity").alias("decided"), "code", "why")
    df = findings.join(d.hint("merge"), "finding_id").where(~F.col("status").isin("Suppressed", "SuppressedByPolicy"))
    return df.select(
        "finding_id", F.coalesce("code", "rule_id").alias("rule_id"), F.col("decided").alias("severity"), F.coalesce("path", F.lit("policy.json")).alias("path"),
        F.coalesce("line_start", F.lit(1)).alias("line_start"), F.coalesce("line_end", F.lit(1)).alias("line_end"), "subject",
        F.concat_ws("; ", "detail", "why").alias("detail"), "status",
    )


def legacy_wrap(rows: DataFrame, registered: list[str]) -> DataFrame:
    """Rows of older entry points whose code no registered rule has: the rest are the registry's own."""
    return rows.where(~F.col("rule_id").isin(*registered))


def coherence(declared: DataFrame | str | None, policies: DataFrame, rules: DataFrame, families: DataFrame) -> DataFrame:
    """GOV004 rows (subject, what): a declaration missing or unreadable, names on one side only, rules of no family, families' rules that are none.

    ``declared`` has the declared policies' names (name), or is None where there
    is no declaration and its error's text where it cannot be read. ``policies``
    (name) are registered; ``rules`` (rule, family) the rules with their family,
    ``families`` (family, rule) the rules that families list.
    """
    if declared is None or isinstance(declared, str):
        said = "missing" if declared is None else f"unreadable: {declared}"
        out = rules.sparkSession.createDataFrame([("declaration", said)], "subject string, what string")
    else:
        out = registry_drift(declared, policies).select(F.col("name").alias("subject"), "what")
    lone = rules.join(families.select("family"), "family", "left_anti").select(F.col("rule").alias("subject"), F.concat(F.lit("unknown family "), "family").alias("what"))
    strange = families.where("rule is not null").join(rules.select("rule"), "rule", "left_anti").select(F.col("family").alias("subject"), F.concat(F.lit("unknown rule "), "rule").alias("what"))
    return out.unionByName(lone.distinct()).unionByName(strange.distinct())


#: Concepts that a declaration may govern, with the observed column that must be registered.
CONCEPTS = {"rule": "rule_id", "family": "family", "policy": "policy", "governance-code": "code"}


def concept_bypasses(observed: DataFrame, declared: dict[str, str], known: dict[str, list[str]], strict: bool = False) -> DataFrame:
    """GOV005 rows (concept, identifier, severity): identifiers that findings use but no registry holds, once each.

    ``observed`` has origin (rule, policy or legacy), rule_id, family, policy
    and code; ``declared`` maps a concept to ``advisory`` or ``enforced``. Legacy rows do
    not count. Governance codes are those that begin with GOV. A concept that is none of the four is named itself, always as advice.
    """
    spark = observed.sparkSession
    own = observed.where("origin <> 'legacy'")
    parts = []
    for concept, force in declared.items():
        severity = "Advisory" if force == "advisory" or concept not in CONCEPTS else "Fatal" if strict else "Warning"
        if concept not in CONCEPTS:
            parts.append(spark.createDataFrame([(concept, concept, severity)], "concept string, identifier string, severity string"))
            continue
        rows = own.where("origin = 'rule'") if concept == "rule" else own.where("origin = 'policy'") if concept == "policy" else own
        rows = rows.select(F.col(CONCEPTS[concept]).alias("identifier")).where("identifier is not null").distinct()
        if concept == "governance-code":
            rows = rows.where("identifier like 'GOV%'")
        have = spark.createDataFrame([(x,) for x in known.get(concept, [])], "identifier string")
        parts.append(rows.join(have, "identifier", "left_anti").select(F.lit(concept).alias("concept"), "identifier", F.lit(severity).alias("severity")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "concept string, identifier string, severity string")


def registry_rows(diagnostics: DataFrame, known: list[str]) -> DataFrame:
    """GOV003: a count of the rows of each code that no registered rule has."""
    return diagnostics.where(~F.col("rule_id").isin(*known)).groupBy(F.col("rule_id").alias("subject")).agg(F.count("*").alias("n"))


def registry_drift(declared: DataFrame, registered: DataFrame) -> DataFrame:
    """GOV004 (name, what): names declared but not registered, and registered but not declared."""
    a, b = declared.select("name").distinct().withColumn("d", F.lit(True)), registered.select("name").distinct().withColumn("r", F.lit(True))
    both = a.join(b, "name", "full").where("d is null or r is null")
    return both.select("name", F.when(F.col("r").isNull(), "not registered").otherwise("not declared").alias("what"))


#: Members of a section that are plain numbers, those that list a budget a module, and those that list paths.
SCALARS = {"CX": ["fn_lines", "module_lines", "max_public_items", "max_fan_out"], "MO": ["max_public_types", "entropy_threshold"]}
OVERRIDES = [("CX", "fn_overrides"), ("CX", "module_overrides"), ("MO", "overrides")]
DRIFT = "code string, severity string, family string, subject string, detail string"


def entry_diff(current: DataFrame, baseline: DataFrame | None, calibration: bool = False, waived: bool = False) -> DataFrame:
    """How a policy was loosened against a baseline: (code, severity, family, subject, detail), from tables of entries (``policy.ENTRY``).

    The two tables meet by (family, key, name), the last entry of a name
    counting. Sections are read as written, without defaults for whole
    sections, so that an absent section shows no phantom change; a number that
    a written section leaves out is its default. No baseline is PG000, unless
    ``waived``.
    """
    spark, soft = current.sparkSession, "Advisory" if calibration else "Fatal"
    if baseline is None:
        return spark.createDataFrame([] if waived else [("PG000", "Fatal", "", "baseline", None)], DRIFT)
    said = ["value", "reason", "expires", "owner"]
    last = lambda df: df.groupBy("family", "key", "name").agg(F.max(F.struct("ix", *said)).alias("e")).select("family", "key", "name", *[f"e.{c}" for c in said])
    now, was = last(current), last(baseline)
    kinds = spark.createDataFrame(
        [(f, k, "override") for f, k in OVERRIDES] + [("CX", "exempt_paths", "exempt"), ("DC", "exempt_paths", "exempt"), ("OT", "converter_paths", "converter")], "family string, key string, kind string"
    )
    named = now.join(F.broadcast(kinds), ["family", "key"]).unionByName(now.where(F.col("key") == ACKNOWLEDGED).withColumn("kind", F.lit("acknowledged")))
    old = was.select("family", "key", "name", F.col("value").alias("old"), F.lit(True).alias("known"))
    met = named.join(old, ["family", "key", "name"], "left").withColumn("family", F.when(F.col("kind") == "acknowledged", F.col("name")).otherwise(F.col("family")))
    gaps = F.concat_ws(",", *[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in said[1:]])
    new, kind = F.col("known").isNull(), F.col("kind")
    row = lambda when, code, severity, detail: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail")))
    none = F.lit(None)
    found = F.array_compact(F.array(
        row((kind == "override") & ~new & (F.col("value") > F.col("old")), "PG001", soft, F.concat_ws(" -> ", "old", "value")),
        row((kind == "override") & new, "PG002", soft, F.col("value")),
        row((kind == "override") & new & (gaps != ""), "PG006", "Fatal", gaps),
        row((kind == "exempt") & new, "PG003", soft, none),
        row((kind == "exempt") & (F.col("family") == "CX") & new & (gaps != ""), "PG007", "Fatal", gaps),
        row((kind == "acknowledged") & new, "PG004", soft, none),
        row((kind == "acknowledged") & new & (gaps != ""), "PG009", "Fatal", gaps),
        row((kind == "converter") & new, "PG008", soft, none),
    ))
    loosened = met.select("family", F.col("name").alias("subject"), F.explode(found).alias("f")).select("f.code", "f.severity", "family", "subject", "f.detail")
    numbers = spark.createDataFrame([(f, k, DEFAULTS[f][k]) for f, keys in SCALARS.items() for k in keys], "family string, key string, preset long")
    numbers = F.broadcast(numbers).join(now.select("family").distinct(), "family")
    plain = lambda df, name: df.where("name is null").select("family", "key", F.col("value").alias(name))
    numbers = numbers.join(plain(now, "a"), ["family", "key"], "left").join(plain(was, "b"), ["family", "key"], "left")
    a, b = F.coalesce("a", "preset"), F.coalesce("b", "preset")
    raised = numbers.where(a > b).select(F.lit("PG001").alias("code"), F.lit(soft).alias("severity"), "family", F.col("key").alias("subject"), F.concat_ws(" -> ", b, a).alias("detail"))
    return loosened.unionByName(raised)


def policy_diff(spark, current: Policy, baseline: Policy | None, calibration: bool = False, waived: bool = False) -> DataFrame:
    """``entry_diff`` of two documents."""
    return entry_diff(current.entries(spark), None if baseline is None else baseline.entries(spark), calibration, waived)


def exit_status(diagnostics: DataFrame) -> DataFrame:
    """(fatal, status): 1 when any row is fatal."""
    n = F.count_if(F.col("severity") == "Fatal")
    return diagnostics.agg(n.alias("fatal"), F.when(n > 0, 1).otherwise(0).alias("status"))


__all__ = ["FINDING", "observe", "suppress", "policy_diff"]
