"""Operators over facts that are no rules themselves: look-ups, layers, percentiles, intervals, fact derivation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap, stab

ORD = ["pkg_ix", "file_ix", "item_ix"]

# fixed values: layers by the words of module segments
LAYERS: dict[str, list[str]] = {
    "domain": ["domain", "core", "model", "models"],
    "api": ["api", "dto", "dtos", "transport"],
    "application": ["application", "usecases", "handlers", "service", "services"],
    "composition": ["composition", "wiring", "bin", "main"],
    "tests": ["tests", "test_support", "fixtures"],
    "utilities": ["util", "utils", "common", "helpers"],
    "config": ["config", "settings"],
}


def layers(files: DataFrame) -> DataFrame:
    """(layer, glob): for each module segment of a layer's words the path up to its first occurrence, with ``::*``."""
    words = F.create_map(*[F.lit(x) for k, ws in LAYERS.items() for w in ws for x in (w, k)])
    parts = F.split("module_path", "::")
    seg = files.where("module_path is not null").select(parts.alias("parts"), F.explode(F.array_distinct(parts)).alias("s")).withColumn("layer", words[F.col("s")])
    glob = F.concat(F.array_join(F.slice("parts", F.lit(1), F.array_position("parts", F.col("s")).cast("int")), "::"), F.lit("::*"))
    return seg.where("layer is not null").select("layer", glob.alias("glob")).distinct()


def top_modules(files: DataFrame) -> DataFrame:
    """(module): package names with ``-`` as ``_`` if there are several, else the distinct second segments."""
    several = files.agg((F.count_distinct("package") > 1).alias("several"))
    names = files.crossJoin(F.broadcast(several)).select(
        F.when(F.col("several"), F.translate("package", "-", "_")).otherwise(F.try_element_at(F.split("module_path", "::"), F.lit(2))).alias("module")
    )
    return names.where("module is not null").distinct()


def percentile(df: DataFrame, col: str, q: float, *by: str) -> DataFrame:
    """Nearest-rank percentile as an ordered-set aggregate."""
    return df.groupBy(*by).agg(F.expr(f"percentile_disc({q}) within group (order by {col})").alias("value"))


def path_pairs(left: DataFrame, right: DataFrame, at_boundary: bool = False) -> DataFrame:
    """(a, b): distinct paths ``a`` of ``left`` and ``b`` of ``right`` of which one ends the other, by equal keys.

    Every path is taken apart into its endings, at path boundaries or at any
    letter, so that the two sides meet by whole texts: common base names cost
    nothing, and the work grows with the files, not with their pairs.
    """

    def endings(df: DataFrame, name: str) -> DataFrame:
        path = F.col(name)
        if at_boundary:
            parts = F.split(path, "/")
            tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        else:
            tails = F.transform(F.sequence(F.lit(1), F.length(path)), lambda i: F.substring(path, i, F.length(path)))
        return df.select(name, F.explode(tails).alias("key"))

    a = left.toDF("a").where("a <> ''").distinct()
    b = right.toDF("b").where("b <> ''").distinct()
    longer = endings(a, "a").join(b, F.col("key") == F.col("b")).select("a", "b")
    shorter = endings(b, "b").join(a, F.col("key") == F.col("a")).select("a", "b")
    return longer.unionByName(shorter).distinct()


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of closed line intervals of the same file: files are matched first, then lines by the tiles of a tree.

    Both sides need (file, from_line, to_line); the right one's come back with ``r_`` before them.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    same = path_pairs(left.select("file"), right.select("file"))
    one = left.join(same, F.col("file") == F.col("a")).drop("a").withColumnRenamed("b", "r_file")
    return overlap(one, r, ["r_file"], ("from_line", "to_line"), ("r_from_line", "r_to_line"))


def hint_targets(hints: DataFrame, items: DataFrame) -> DataFrame:
    """Each hint with the first item of its file whose lines hold the hint's target: adds target_symbol, null if there is none."""
    i = items.select("pkg_ix", "file_ix", F.col("item_ix").alias("t_ix"), F.col("symbol").alias("t_symbol"), F.col("line_start").alias("t_from"), F.col("line_end").alias("t_to"))
    j = stab(hints.select(*ORD, "target_start"), i, ["pkg_ix", "file_ix"], "target_start", "t_from", "t_to")
    best = j.groupBy(*ORD).agg(F.min(F.struct("t_ix", "t_symbol")).alias("b")).select(*ORD, F.col("b.t_symbol").alias("target_symbol"))
    return hints.join(best, ORD, "left")


# fixed values: verbs and types of the standard library's runtime
FS_WRITES = ["write", "create_dir", "create_dir_all", "remove_file", "remove_dir", "remove_dir_all", "copy", "rename", "hard_link", "soft_link", "symlink"]
FS_READS = ["read", "read_to_string", "read_dir", "metadata", "canonicalize", "open"]
PAUSES = ["sleep", "park", "park_timeout"]
RUNS = ["output", "status", "wait", "wait_with_output"]
NET = ["TcpStream", "TcpListener", "UdpSocket"]
PRINTS = ["println", "eprintln", "print", "eprint", "dbg"]
LEVELS = ["info", "warn", "error", "debug", "trace"]
#: Kinds that calls imply: logging by macros, the others by functions.
CALLED = ["SpawnedWork", "ConfigRead", "PersistenceWrite", "BlockingCall", "ExternalIo", "Logging"]


def call_kinds(callee: Column, call_kind: Column, only: str | None = None) -> Column:
    """Kinds of facts, of all or of ``only`` one, that a call implies, from its last path segments.

    The conditions read the segments from a bound variable: as plain columns they would repeat the expression
    that makes ``callee`` in every condition, a method too large for the virtual machine to compile.
    """

    def kinds(call: Column) -> Column:
        s, kind = call["s"], call["kind"]
        last, prev, third = F.element_at(s, -1), F.try_element_at(s, F.lit(-2)), F.try_element_at(s, F.lit(-3))
        fn, meta = kind == "Function", kind == "Meta"
        out = [
            (fn & (last == "spawn"), "SpawnedWork"),
            (fn & (prev == "env") & last.isin("var", "var_os"), "ConfigRead"),
            (fn & (prev == "fs") & last.isin(*FS_WRITES), "PersistenceWrite"),
            (fn & (prev == "fs") & last.isin(*FS_READS), "BlockingCall"),
            (fn & (prev == "thread") & last.isin(*PAUSES), "BlockingCall"),
            (fn & (third == "process") & (prev == "Command"), "ExternalIo"),
            (fn & (third == "process") & (prev == "Command") & last.isin(*RUNS), "BlockingCall"),
            (fn & (third == "net") & prev.isin(*NET), "ExternalIo"),
            (fn & (third == "net") & prev.isin(*NET), "BlockingCall"),
            (meta & (last.isin(*LEVELS) | ((F.size(s) == 1) & last.isin(*PRINTS))), "Logging"),
        ]
        found = [F.when(cond, F.lit(k)) for cond, k in out if only in (None, k)]
        return F.filter(F.array(*found, F.lit(None).cast("string")), lambda k: k.isNotNull())

    return F.flatten(F.transform(F.array(F.struct(F.split(callee, "::").alias("s"), call_kind.alias("kind"))), kinds))


def classify_calls(calls: DataFrame, only: str | None = None) -> DataFrame:
    """Facts that calls of the standard runtime imply: zero or more a call site. With ``only``, those of one kind."""
    if only:  # a plain condition, which Spark moves below the join that makes the call sites
        calls = calls.where((F.col("call_kind") == ("Meta" if only == "Logging" else "Function")) if only in CALLED else F.lit(False))
    df = calls.withColumn("kind", F.explode(call_kinds(F.col("callee"), F.col("call_kind"), only)))
    return df.select(*ORD, "path", "line_start", "line_end", "kind", F.when(F.col("function").isNull(), "Span").otherwise("Function").alias("scope"), F.col("function").alias("symbol"), F.col("callee").alias("evidence"), F.lit(0.9).alias("confidence"))


# fixed values: kinds that a marker may promote to a fact
MARKERS = [
    "spawned_work", "config_read", "logging", "external_io", "persistence_write", "blocking_call", "hot_path", "request_context", "boundary_entry",
    "runtime_state_owner", "background_worker",
]


def promote_markers(hints: DataFrame, functions: DataFrame, only: str | None = None) -> DataFrame:
    """Marker hints, of all or of ``only`` one kind, as facts about the first function whose lines hold the hint's target; unknown kinds and strays are left out."""
    named = F.array_join(F.transform(F.split("fact_kind", "_"), lambda p: F.initcap(p)), "")
    h = hints.where((F.col("category") == "marker") & F.col("fact_kind").isin(*MARKERS))
    if only:  # few hints: only the functions of their files are tiled
        h = h.where(named == only)
        functions = functions.join(h.select("pkg_ix", "file_ix"), ["pkg_ix", "file_ix"], "left_semi")
    m = hint_targets(h, functions)
    return m.where("target_symbol is not null").select(*ORD, named.alias("kind"), F.col("target_symbol").alias("symbol"), F.lit(1.0).alias("confidence"))


def load_facts(facts: DataFrame, calls: DataFrame, hints: DataFrame, functions: DataFrame, only: str | None = None) -> DataFrame:
    """All facts, or those of ``only`` one kind, as rules read them: those given, then what calls of the runtime imply, then what markers promote."""
    at = functions.groupBy("symbol").agg(F.min(F.struct(*ORD, "path", "line_start", "line_end")).alias("f"))
    cols = [*ORD, "scope", "kind", "symbol", "path", "line_start", "line_end", "evidence", "source", "confidence"]
    given = (facts.where(F.col("kind") == only) if only else facts).withColumnRenamed("fact_path", "path")
    called = classify_calls(calls, only).withColumns({"source": F.lit("runtime-calls")})
    marked = promote_markers(hints, functions, only).withColumns({"scope": F.lit("Function"), "evidence": F.lit(None).cast("string"), "source": F.lit("markers")})
    marked = marked.join(at, "symbol").withColumns({c: F.col(f"f.{c}") for c in ("path", "line_start", "line_end")})
    return given.select(*cols).unionByName(called.select(*cols)).unionByName(marked.select(*cols)).withColumnRenamed("path", "fact_path")


def endpoint_concepts(conversions: DataFrame, concepts: DataFrame) -> DataFrame:
    """Conversions with the accepted concept of either end: the first by (concept, symbol) whose symbol, or its last segment, is the end's text."""
    names = concepts.select(F.explode(F.array("symbol", "name")).alias("as"), F.struct("concept", "symbol").alias("s")).groupBy("as").agg(F.min("s").alias("s"))
    a = names.select(F.col("as").alias("fa"), F.col("s.concept").alias("from_concept"))
    b = names.select(F.col("as").alias("ta"), F.col("s.concept").alias("to_concept"))
    df = conversions.join(a, F.trim("from_type") == F.col("fa"), "left").join(b, F.trim("to_type") == F.col("ta"), "left")
    return df.select(*ORD, "symbol", "layer", "from_concept", "to_concept")


def module_path(path: Column, package: Column) -> Column:
    """Module path of a source file: null outside ``src``; main and lib at its root are the package, ``mod.rs`` is its folder."""
    inner = F.regexp_extract(path, r"(?:^|/)src/(.+)\.rs$", 1)
    parts = F.regexp_replace(F.regexp_replace(inner, r"(^|/)mod$", ""), "/", "::")
    root = F.translate(package, "-", "_")
    return F.when(inner == "", F.lit(None)).when(inner.isin("main", "lib") | (parts == ""), root).otherwise(F.concat(root, F.lit("::"), parts))


def scan_hints(sources: DataFrame, prefix: str = "// girder:") -> DataFrame:
    """Annotations of source texts (path, text): place, target, form and members.

    (path, line_no, target_line, raw, category, rule, concept, boundary,
    fact_kind, reason, expires, words). An annotation is a line that begins with
    ``prefix``, leading space aside, and lies in no raw string. Its target is
    the next line that is neither blank, a comment nor an attribute. Forms:
    ``allow RULE``, ``fact KIND`` (category marker), ``ot`` with ``canonical``,
    ``boundary [CONCEPT [BOUNDARY]]``, ``converter``, ``protocol-translation``
    or ``generated-boundary``; any other is ``unknown``. ``reason="..."`` and
    ``expires="..."`` may follow. Null texts have no annotations.
    """
    lines = sources.select("path", F.posexplode(F.split("text", "\n")).alias("ix", "line")).withColumn("line", F.regexp_replace("line", "\r$", ""))
    lines = lines.withColumn("line_no", (F.col("ix") + 1).cast("int"))
    w = Window.partitionBy("path").orderBy("ix")
    # the raw-string state as a running composition of the lines' maps of (outside, inside)
    opened = F.instr("line", 'r#"')
    rest = F.substring(F.col("line"), opened + 3, F.length("line"))
    lines = lines.withColumns({"from_out": (opened > 0) & ~rest.contains('"#'), "from_in": ~F.col("line").contains('"#')})
    lines = lines.withColumn("swaps", F.sum((F.col("from_out") & ~F.col("from_in")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    settled = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").cast("int").alias("at"), "swaps"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns({"last": F.last(settled, ignorenulls=True).over(before), "turned": F.last("swaps").over(before)})
    at = F.coalesce(F.col("last.at"), F.lit(0)) + F.coalesce("turned", F.lit(0)) - F.coalesce(F.col("last.swaps"), F.lit(0))
    inside = at % 2 == 1
    text = F.regexp_replace("line", r"^\s+", "")
    code = (text != "") & ~text.startswith("//") & ~text.startswith("#[") & ~text.startswith("#![")
    lines = lines.withColumns({"inside": inside, "target_line": F.min(F.when(code, F.col("line_no"))).over(w.rowsBetween(1, Window.unboundedFollowing))})
    # a line that opens a raw string is skipped as well
    hits = lines.where(~F.col("inside") & ~F.col("from_out") & text.startswith(prefix))
    hits = hits.withColumn("body", F.regexp_replace(F.substring(text, F.lit(len(prefix) + 1), F.length("line")), r"^\s+|\s+$", ""))
    hits = hits.withColumn("t", F.split("body", r"\s+"))
    token = lambda i: F.nullif(F.try_element_at("t", F.lit(i)), F.lit(""))
    kv = lambda key: F.when(F.col("body").rlike(rf'{key}="[^"]*"'), F.regexp_extract("body", rf'{key}="([^"]*)"', 1))
    form, of = token(1), token(2)
    plain = {"canonical": "canonical", "boundary": "boundary", "converter": "converter", "protocol-translation": "protocol_translation", "generated-boundary": "generated_boundary"}
    ot = F.lit("unknown")
    for word, category in plain.items():
        ot = F.when(of == word, category).otherwise(ot)
    category = F.when(form == "allow", "allow").when(form == "fact", "marker").when(form == "ot", ot).otherwise("unknown")
    hits = hits.withColumn("category", category)
    only = lambda kinds, c: F.when(F.col("category").isin(*kinds), c)
    head = F.trim(F.regexp_replace("body", r'\s*[a-z_]+="[^"]*"', ""))
    return hits.select(
        "path", "line_no", "target_line", text.alias("raw"), "category", only(["allow"], F.coalesce(of, F.lit(""))).alias("rule"), only(["boundary"], token(3)).alias("concept"),
        only(["boundary"], token(4)).alias("boundary"), only(["marker"], snake_case(F.coalesce(of, F.lit("")))).alias("fact_kind"),
        kv("reason").alias("reason"), kv("expires").alias("expires"), snake_case(head).alias("words"),
    )


def snake_case(text: Column) -> Column:
    """Kebab and Pascal case as snake case: hyphens become low lines, and capitals but the first letter get one before them."""
    return F.lower(F.regexp_replace(F.translate(text, "-", "_"), "(?<=[^_])(?=[A-Z])", "_"))
