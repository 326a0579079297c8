"""The rules once more as DuckDB SQL over the projected star tables, written apart from the Spark plans they check."""

from __future__ import annotations

from girder.plans.policy import SAMPLE
from girder.plans.rules import RULES
from girder.sources.projection import PROJECTION, ctes

P = SAMPLE.section
# fixed values, written out once more so that a slip in the plans shows
PRIMITIVES = ["String", "str", "i8", "i16", "i32", "i64", "i128", "isize", "u8", "u16", "u32", "u64", "u128", "usize", "f32", "f64", "bool", "char"]
BOUNDARY_SUFFIXES = ["Response", "Request", "Payload", "Schema", "Message", "Record", "Entity", "Model", "Reply", "View", "Body", "Resp", "Req", "Row", "Dto"]
BOUNDARY_METHODS = [
    "from", "try_from", "into", "try_into", "serialize", "deserialize", "fmt", "display", "new", "default", "builder", "build", "clone",
    "as_ref", "as_mut", "as_str", "as_bytes", "into_inner", "inner", "len", "is_empty",
]
BOUNDARY_METHOD_PREFIXES = ["as_", "to_", "into_", "from_", "try_", "with_"]
VALIDATING = ["validate_", "is_valid_", "check_", "verify_", "ensure_", "normalize_", "sanitize_", "canonicalize_", "parse_", "clean_"]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def seg(x: str, pattern: str) -> str:
    """Two-sided segment glob."""
    if pattern == "*":
        return f"({x} IS NOT NULL)"
    a, b = pattern.startswith("*::"), pattern.endswith("::*")
    body = pattern.removeprefix("*::") if a else pattern
    body = body.removesuffix("::*") if b else body
    if a and b:
        return f"contains('::' || {x} || '::', {q('::' + body + '::')})"
    if a:
        return f"({x} = {q(body)} OR suffix({x}, {q('::' + body)}))"
    if b:
        return f"({x} = {q(body)} OR prefix({x}, {q(body + '::')}))"
    return f"({x} = {q(pattern)})"


def tail(x: str, pattern: str) -> str:
    return f"({x} = {q(pattern[:-3])} OR prefix({x}, {q(pattern[:-1])}))" if pattern.endswith("::*") else f"({x} = {q(pattern)})"


def glob(x: str, pattern: str) -> str:
    """Name glob."""
    a, b, body = pattern.startswith("*"), pattern.endswith("*"), pattern.strip("*")
    return f"contains({x}, {q(body)})" if a and b else f"suffix({x}, {q(body)})" if a else f"prefix({x}, {q(body)})" if b else f"({x} = {q(body)})"


def star(x: str, pattern: str) -> str:
    head, _, end = pattern.partition("*")
    return f"(prefix({x}, {q(head)}) AND suffix({x}, {q(end)}) AND length({x}) >= {len(head) + len(end)})" if "*" in pattern else f"({x} = {q(pattern)})"


def named(x: str, pattern: str) -> str:
    return seg(x, pattern) if "::" in pattern else glob(x, pattern)


def either(x: str, pattern: str) -> str:
    return f"({seg(x, pattern)} OR {glob(x, pattern)})"


def some(x: str, patterns: list[str], match=seg) -> str:
    return "coalesce(" + (" OR ".join(match(x, p) for p in patterns) or "false") + ", false)"


def first(x: str, patterns: list[str], match=seg) -> str:
    return "CASE " + " ".join(f"WHEN {match(x, p)} THEN {q(p)}" for p in patterns) + " END" if patterns else "NULL"


def value(x: str, entries: list, match=seg) -> str:
    return "CASE " + " ".join(f"WHEN {match(x, p)} THEN {v}" for p, v in entries) + " END" if entries else "NULL"


def feature(x: str, features: list) -> str:
    return "CASE " + " ".join(f"WHEN {some(x, f[1])} THEN {q(f[0])}" for f in features) + " END"


def short(x: str) -> str:
    return f"trim(list_extract(string_split({x}, '::'), -1))"


def parent(x: str) -> str:
    return f"CASE WHEN contains({x}, '::') THEN array_to_string(list_slice(string_split({x}, '::'), 1, -2), '::') ELSE {x} END"


def error_of(x: str) -> str:
    """E of the projected Result texts: the part after the last comma at bracket depth zero, which is the first there."""
    body = f"regexp_extract({x}, '^Result<(.*)>$', 1)"
    flat = f"regexp_replace(regexp_replace({body}, '<[^<>]*>', '', 'g'), '\\([^()]*\\)', '', 'g')"
    return f"CASE WHEN contains({flat}, ',') THEN string_split({flat}, ',')[2] END"


def word(text: str, name: str) -> str:
    return f"regexp_matches({text}, '(^|[^A-Za-z0-9_])' || {name} || '($|[^A-Za-z0-9_])')"


M = "module_path"
SILENT = "body_shape IN ('Empty', 'Literal', 'Call')"
ORACLES: dict[str, str] = {}
#: The rules without the projected tables, for one statement over all of them.
BODIES: dict[str, str] = {}
PLACED = "module_path IS NOT NULL"


def add(id_: str, subject: str, detail: str, source: str, *tables: str, where: str = "true", severity: str | None = None, line_start: str = "line_start", line_end: str = "line_end", path: str = "path", extra: str = "") -> None:
    sev = severity or q(RULES[id_].severity)
    body = (
        f"SELECT {q(id_)} AS rule_id, {sev} AS severity, {path} AS path, CAST({line_start} AS INT) AS line_start, CAST({line_end} AS INT) AS line_end, "
        f"{subject} AS subject, CAST({detail} AS VARCHAR) AS detail FROM {source} WHERE {where}"
    )
    ORACLES[f"rule_{id_.lower()}"] = f"{ctes(*tables)}{extra}\n{body}"
    BODIES[id_] = f"{'WITH ' + extra[2:] if extra else ''} {body}"


def file_level(id_: str, subject: str, detail: str, source: str, *tables: str, where: str = "true") -> None:
    add(id_, subject, detail, source, *tables, where=where, line_start="1", line_end="1")


# first function of a symbol
FN = "(SELECT symbol AS fs, path, module_path, line_start, line_end FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pkg_ix, file_ix, item_ix) AS rn FROM air_function) WHERE rn = 1)"


def fact(id_: str, detail: str, kinds: list[str], where: str) -> None:
    src = f"air_fact a JOIN {FN} f ON a.symbol = f.fs"
    add(id_, "a.symbol", detail, src, "air_fact", "air_function", path="f.path", line_start="f.line_start", line_end="f.line_end",
        where=f"a.scope = 'Function' AND a.kind IN ({', '.join(map(q, kinds))}) AND f.module_path IS NOT NULL AND ({where})")


cx = P("CX")
b = f"coalesce({value(M, cx['fn_overrides'], tail)}, {cx['fn_lines']})"
add("CX001", "symbol", f"line_count || '/' || {b}", "air_function", "air_function", where=f"{PLACED} AND line_count > {b}")
b = f"coalesce({value(M, cx['module_overrides'])}, {cx['module_lines']})"
file_level("CX002", M, f"line_count || '/' || {b}", "air_file", "air_file", where=f"{M} IS NOT NULL AND line_count > {b}")
pub = "(SELECT pkg_ix, file_ix, item_ix, path, module_path, line_start, line_end FROM air_type WHERE visibility = 'Public' UNION ALL SELECT pkg_ix, file_ix, item_ix, path, module_path, line_start, line_end FROM air_function WHERE visibility = 'Public')"
add("CX007", M, "n", f"(SELECT *, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY item_ix) AS rn FROM {pub} AS u)", "air_type", "air_function",
    where=f"rn = 1 AND n > {cx['max_public_items']} AND {M} IS NOT NULL AND NOT {some(M, cx['exempt_paths'])}")
add("CX008", "fs", "n", f"{FN} f JOIN (SELECT function, count(*) AS n FROM air_call_site GROUP BY function) c ON c.function = f.fs", "air_call_site",
    where=f"n > {cx['max_fan_out']} AND {M} IS NOT NULL AND NOT {some(M, cx['orchestration_paths'])}")

dg = P("DG")
edge = "CASE " + " ".join(f"WHEN {seg(M, a)} AND {seg('import_path', z)} THEN {q(a + ' -> ' + z)}" for a, z in dg["edges"]) + " END"
add("DG001", "import_path", edge, "air_import", "air_import", where=f"{edge} IS NOT NULL")
DG002 = """e AS (
  SELECT src, dst, path, line_start, line_end FROM (
    SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY pkg_ix, file_ix, item_ix) AS rn FROM (
      SELECT *, split_part(module_path, '::', 1) AS src, split_part(import_path, '::', 1) AS dst FROM air_import WHERE module_path IS NOT NULL)
    WHERE src <> dst) WHERE rn = 1
), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
comp AS (SELECT a.src AS node, min(a.dst) AS c, count(*) AS n FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
SELECT 'DG002' AS rule_id, 'Fatal' AS severity, path, CAST(line_start AS INT) AS line_start, CAST(line_end AS INT) AS line_end, src || ' -> ' || dst AS subject, a.c AS detail
FROM e JOIN comp a ON a.node = src JOIN comp b ON b.node = dst WHERE a.c = b.c AND a.n > 1 AND b.n > 1
"""
ORACLES["rule_dg002"] = "WITH RECURSIVE " + ctes("air_import").removeprefix("WITH ") + ", " + DG002
BODIES["DG002"] = "WITH RECURSIVE " + DG002
of, to = feature(M, dg["features"]), feature("import_path", dg["features"])
api = " OR ".join(f"({to} = {q(f[0])} AND {some('import_path', f[2])})" for f in dg["features"])
add("DG003", "import_path", f"{of} || ' -> ' || {to}", "air_import", "air_import", where=f"{of} <> {to} AND NOT ({api})")
sh = first(M, dg["shared_paths"])
add("DG004", "import_path", f"{sh} || ' -> ' || {to}", "air_import", "air_import", where=f"{sh} IS NOT NULL AND {to} IS NOT NULL")

SUFFIX = "CASE " + " ".join(f"WHEN suffix(name, {q(s)}) AND length(name) > {len(s)} THEN {q(s)}" for s in BOUNDARY_SUFFIXES) + " END"
CLUSTER_TABLES = ("air_type", "air_field", "air_variant", "air_hint", "policy_concept", "air_conversion")
CLUSTERS = f""", shaped AS (
  SELECT t.* , coalesce(fs, vs) AS shape, coalesce(len(fn), 0) AS n_fields, left(name, length(name) - length(coalesce({SUFFIX}, ''))) AS stem,
    coalesce(pr.role, hr.role, 'Unknown') AS role
  FROM air_type t
  LEFT JOIN (SELECT item_ix, list_sort(list(DISTINCT name)) AS fs, list(name) AS fn FROM air_field GROUP BY item_ix) f ON f.item_ix = t.item_ix
  LEFT JOIN (SELECT item_ix, list_sort(list(DISTINCT name)) AS vs FROM air_variant GROUP BY item_ix) v ON v.item_ix = t.item_ix
  LEFT JOIN (SELECT symbol AS ps, CASE WHEN bool_or(role = 'canonical') THEN 'Canonical' ELSE 'Boundary' END AS role FROM policy_concept GROUP BY symbol) pr ON pr.ps = t.symbol
  LEFT JOIN (SELECT x.item_ix, CASE WHEN bool_or(h.category = 'canonical') THEN 'Canonical' ELSE 'Boundary' END AS role FROM air_type x JOIN air_hint h
    ON h.path = x.path AND h.category IN ('canonical', 'boundary') AND h.target_start BETWEEN x.line_start AND x.line_end GROUP BY x.item_ix) hr ON hr.item_ix = t.item_ix
  WHERE (kind IN ('Struct', 'Enum') AND fs IS NOT NULL) OR (kind = 'Enum' AND vs IS NOT NULL)
), ref AS (
  SELECT stem, shape AS ref_shape, symbol AS reference FROM (
    SELECT *, count(*) OVER (PARTITION BY stem) AS members, row_number() OVER (PARTITION BY stem ORDER BY CASE WHEN role = 'Canonical' THEN 0 ELSE 1 END,
      CASE WHEN role = 'Canonical' THEN pkg_ix END, CASE WHEN role = 'Canonical' THEN file_ix END, CASE WHEN role = 'Canonical' THEN item_ix END,
      n_fields DESC, pkg_ix DESC, file_ix DESC, item_ix DESC) AS rn FROM shaped) WHERE rn = 1 AND members > 1
), lapped AS (
  SELECT s.*, r.reference, CAST(len(list_intersect(shape, ref_shape)) AS DOUBLE) / len(list_distinct(list_concat(shape, ref_shape))) AS overlap FROM shaped s JOIN ref r USING (stem)
), member AS (
  SELECT l.* FROM lapped l JOIN (SELECT stem FROM lapped GROUP BY stem HAVING count(*) FILTER (WHERE overlap >= 0.5) >= 2) k USING (stem)
)"""
add("OT001", "symbol", "incumbent", "(SELECT *, row_number() OVER w AS rn, first_value(symbol) OVER w AS incumbent FROM member WHERE role = 'Canonical' WINDOW w AS (PARTITION BY stem ORDER BY pkg_ix, file_ix, item_ix))",
    *CLUSTER_TABLES, extra=CLUSTERS, where="rn > 1")
add("OT002", "symbol", "CASE WHEN overlap >= 0.9 THEN 'High' WHEN overlap >= 0.7 THEN 'Medium' ELSE 'Low' END", "member", *CLUSTER_TABLES, extra=CLUSTERS,
    where="role = 'Unknown' AND overlap >= 0.5 AND stem IN (SELECT stem FROM member WHERE role = 'Canonical')")
add("OT003", "symbol", "short", """(SELECT DISTINCT f.item_ix, f.path, f.line_start, f.line_end, f.symbol, b.name AS short FROM air_function f
   JOIN (SELECT item_ix, type_text AS t FROM air_param UNION ALL SELECT item_ix, return_type FROM air_function) x ON x.item_ix = f.item_ix
   JOIN policy_concept b ON b.role = 'boundary' AND """ + word("x.t", "b.name") + """
   WHERE f.path NOT IN (SELECT path FROM policy_concept WHERE role = 'boundary') AND f.symbol NOT IN (SELECT symbol FROM policy_converter))""",
    "air_function", "air_param", "policy_concept", "policy_converter")
CANON = "(SELECT name AS short, concept, symbol AS csym, path AS owner FROM policy_concept WHERE role = 'canonical')"
cp = P("OT")["converter_paths"]
add("OT004", "function", "short", f"air_truth_action a JOIN {CANON} c ON c.short = {short('target')}", "air_truth_action", "policy_concept", "policy_converter",
    where=f"action = 'Construct' AND path <> owner AND coalesce(function, '') NOT IN (SELECT symbol FROM policy_converter) AND NOT {some('function', cp)} AND NOT {some('path', cp)}")
add("OT005", "b.symbol", "concept", "policy_concept b LEFT JOIN (SELECT symbol, path AS tp, line_start AS ls, line_end AS le, row_number() OVER (PARTITION BY symbol ORDER BY pkg_ix, file_ix, item_ix) AS rn FROM air_type) t ON t.symbol = b.symbol AND rn = 1",
    "policy_concept", "policy_converter", "air_type", path="coalesce(tp, path)", line_start="coalesce(ls, 1)", line_end="coalesce(le, 1)",
    where=f"role = 'boundary' AND name NOT IN (SELECT {short('from_type')} FROM policy_converter UNION ALL SELECT {short('to_type')} FROM policy_converter)")
CONV = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, line_start, line_end, mechanism, """ + short("from_type") + ", " + short("to_type") + """
  ORDER BY CASE layer WHEN 'SemanticResolved' THEN 3 WHEN 'SourceHint' THEN 2 WHEN 'Syntactic' THEN 1 ELSE 0 END DESC, pkg_ix, file_ix, item_ix) AS rn FROM air_conversion) WHERE rn = 1)"""
END = "(SELECT e, min(concept) AS {c} FROM (SELECT symbol AS e, concept FROM policy_concept UNION ALL SELECT name, concept FROM policy_concept) GROUP BY e)"
add("OT006", "c.symbol", "fc", f"{CONV} c JOIN {END.format(c='fc')} f ON f.e = c.from_type JOIN {END.format(c='tc')} t ON t.e = c.to_type", "air_conversion", "policy_concept", "policy_converter",
    where="fc = tc AND NOT EXISTS (SELECT 1 FROM policy_converter k WHERE k.concept = fc AND k.symbol = c.symbol)")
BND = "(SELECT name FROM policy_concept WHERE role = 'boundary')"
add("OT007", "symbol", f"{short('from_type')} || ' -> ' || {short('to_type')}", f"{CONV} c", "air_conversion", "policy_concept", "air_hint",
    where=f"{short('from_type')} IN {BND} AND {short('to_type')} IN {BND} AND NOT EXISTS (SELECT 1 FROM air_hint h WHERE h.category = 'protocol_translation' AND h.path = c.path AND h.target_start BETWEEN c.line_start AND c.line_end)")
add("OT008", "target_type || '::' || method", short("target_type"), "air_impl_method", "air_impl_method", "policy_concept",
    where=f"interface IS NULL AND {short('target_type')} IN {BND} AND method NOT IN ({', '.join(map(q, BOUNDARY_METHODS))}) AND NOT ({' OR '.join(f'prefix(method, {q(p)})' for p in BOUNDARY_METHOD_PREFIXES)})")
add("OT009", "symbol", "short", f"""(SELECT f.item_ix, any_value(f.path) AS path, any_value(f.line_start) AS line_start, any_value(f.line_end) AS line_end, any_value(f.symbol) AS symbol, arg_min(owner, short) AS owner, min(short) AS short FROM air_function f
   JOIN (SELECT item_ix, type_text AS t FROM air_param UNION ALL SELECT item_ix, return_type FROM air_function) x ON x.item_ix = f.item_ix JOIN {CANON} b ON {word('x.t', 'b.short')}
   WHERE ({' OR '.join(f'prefix(f.name, {q(p)})' for p in VALIDATING)}) AND f.symbol NOT IN (SELECT symbol FROM policy_converter) GROUP BY f.item_ix)""",
    "air_function", "air_param", "policy_concept", "policy_converter", where="path <> owner")
add("OT010", "symbol", "csym", f"""(SELECT t.item_ix, any_value(t.path) AS path, any_value(t.line_start) AS line_start, any_value(t.line_end) AS line_end, any_value(t.symbol) AS symbol, arg_min(c.csym, c.concept) AS csym
   FROM enums t JOIN (SELECT c.concept, c.csym, e.names AS own FROM {CANON} c JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pkg_ix, file_ix, item_ix) AS rn FROM enums) e ON e.symbol = c.csym AND e.rn = 1) c
     ON CAST(len(list_intersect(t.names, c.own)) AS DOUBLE) / len(list_distinct(list_concat(t.names, c.own))) >= 0.5
   WHERE t.symbol NOT IN (SELECT symbol FROM policy_concept) GROUP BY t.item_ix)""", "air_type", "air_variant", "policy_concept",
    extra=", enums AS (SELECT t.*, v.names FROM air_type t JOIN (SELECT item_ix, list(DISTINCT name) AS names FROM air_variant GROUP BY item_ix) v ON v.item_ix = t.item_ix WHERE kind = 'Enum')")
add("OT011", "t.symbol", "concept", f"air_type t JOIN {CANON} c ON c.short = t.name", "air_type", "air_field", "policy_concept",
    where="kind = 'Struct' AND t.symbol NOT IN (SELECT symbol FROM policy_concept) AND (SELECT count(*) FROM air_field f WHERE f.item_ix = t.item_ix) = 1")
pascal = "list_aggregate(list_transform(string_split(name, '_'), lambda p: upper(p[1]) || p[2:]), 'string_agg', '')"
plain = "regexp_replace(type_text, '^(&|Option<)*|>*$', '', 'g')"
add("OT012", "symbol || '.' || name", pascal, "air_field", "air_field", "policy_concept",
    where=f"kind = 'Struct' AND symbol NOT IN (SELECT symbol FROM policy_concept) AND {plain} IN ({', '.join(map(q, PRIMITIVES))}) AND {pascal} IN (SELECT name FROM policy_concept WHERE role = 'canonical')")

fl = P("FL")
own = f"{PLACED} AND NOT {some(M, fl['invariant_owner_paths'])} AND NOT {some(parent('function'), fl['invariant_owner_paths'])}"
e = error_of("return_type")
add("FL001", "symbol", first(e, fl["boundary_error_patterns"]), "air_function", "air_function", where=f"{some(M, fl['domain_paths'])} AND {some(e, fl['boundary_error_patterns'])}")
add("FL002", "function", short("callee"), "air_call_site", "air_call_site", where=f"call_kind IN ('Method', 'Meta') AND {short('callee')} IN ({', '.join(map(q, fl['forbidden_callees']))}) AND {own}")
add("FL003", "function", "callee", "air_call_site", "air_call_site", where=f"call_kind = 'Method' AND callee IN ({', '.join(map(q, fl['silent_discard_callees']))}) AND {own}")
add("FL004", "function", "callee", "air_silent_discard", "air_silent_discard", where=f"discard_kind <> 'Other' AND callee NOT IN ({', '.join(map(q, fl['silent_discard_allowed']))}) AND {own}")
add("FL005", "function", "variant", "air_partial_match", "air_partial_match", where=own)
add("FL006", "function", "callee", "air_closure_call", "air_closure_call", where=f"callee = 'map_err' AND closure_discards_arg AND {own}")
add("FL007", "function", "pattern", "air_match_arm", "air_match_arm", where=f"pattern_has_wildcard AND regexp_matches(trim(pattern), '(^|[ |]|::)Err\\(_\\)') AND {SILENT} AND {own}")
add("FL010", "function", "callee", "air_fallback", "air_fallback", where=f"callee IN ('unwrap_or', 'or') AND default_shape IN ('Literal', 'Call') AND {own}")
add("FL011", "function", "pattern", "air_match_arm", "air_match_arm", where=f"regexp_matches(trim(pattern), '^_($| if | @ )') AND {SILENT} AND {own}")
ro = fl["retry_policy_owner_paths"]
add("FL012", "function", "loop_kind", "air_retry_loop", "air_retry_loop", where=f"{PLACED} AND propagates AND has_break AND NOT {some(M, ro)} AND NOT {some(parent('function'), ro)}")
add("FL013", "symbol", "callee || '@' || cl", f"""air_function f JOIN (SELECT path AS cp, function, arg_min(callee, item_ix) AS callee, arg_min(line_start, item_ix) AS cl, arg_min(line_end, item_ix) AS ce FROM air_call_site
   WHERE {short('callee')} IN ('to_string', 'format!', 'format', 'display') GROUP BY path, function) c ON c.cp = f.path AND c.function = f.symbol""", "air_function", "air_call_site",
    where=f"{PLACED} AND ltrim({e}, '&') IN ('String', 'str') AND NOT {some(M, fl['invariant_owner_paths'])} AND NOT {some(f"({parent('symbol')})", fl['invariant_owner_paths'])}",
    line_start="cl", line_end="ce")

mo = P("MO")
HERE = "path IN (SELECT path FROM air_file WHERE module_path IS NOT NULL)"
b = f"coalesce({value(M, mo['overrides'])}, {mo['max_public_types']})"
add("MO001", M, f"n || '/' || {b}", "(SELECT *, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY item_ix) AS rn FROM air_type WHERE visibility = 'Public')", "air_type", where=f"rn = 1 AND {M} IS NOT NULL AND n > {b}")
file_level("MO002", "path", "roles", f"""(SELECT path, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(DISTINCT role) AS n FROM (
   SELECT path, category AS role FROM air_hint WHERE category IN ('canonical', 'boundary', 'converter') UNION ALL SELECT path, 'handler' FROM air_function WHERE {some('name', mo['handler_names'], glob)}
   UNION ALL SELECT path, 'persistence' FROM air_import WHERE {some('import_path', mo['persistence_imports'])} UNION ALL SELECT path, 'io' FROM air_call_site WHERE {some('callee', mo['io_callees'])}) GROUP BY path)""",
    "air_hint", "air_import", "air_call_site", "air_function", where=f"n >= {mo['entropy_threshold']} AND {HERE}")
file_level("MO003", "path", "NULL", "(SELECT path FROM air_hint WHERE category = 'canonical' INTERSECT SELECT path FROM air_hint WHERE category = 'boundary')", "air_hint", where=HERE)
add("MO004", "symbol", "NULL", f"(SELECT *, row_number() OVER (PARTITION BY path ORDER BY item_ix) AS rn FROM air_function WHERE {some('name', mo['handler_names'], glob)} AND path IN (SELECT path FROM air_hint WHERE category = 'canonical'))", "air_function", "air_hint", where=f"rn = 1 AND {PLACED}")
add("MO005", "symbol", "entry || ':' || what", f"""(SELECT d.*, f.entry, (SELECT count(*) FROM air_import i WHERE i.path = d.path AND i.visibility = 'Public') AS wires, count(*) FILTER (WHERE d.visibility = 'Public') OVER (PARTITION BY d.path) AS public FROM (
   SELECT path, line_start, line_end, symbol, '' AS name, visibility, 'type' AS what, 0 AS lines FROM air_type
   UNION ALL SELECT path, line_start, line_end, target_type, '', 'Public', 'impl', 0 FROM air_impl UNION ALL SELECT path, line_start, line_end, symbol, '', 'Public', 'conversion', 0 FROM {CONV} c
   UNION ALL SELECT path, line_start, line_end, symbol, name, visibility, 'function', line_count FROM air_function) d
   JOIN (SELECT path, CASE WHEN list_extract(string_split(module_path, '::'), -1) IN ('main', 'mod', 'lib') THEN list_extract(string_split(module_path, '::'), -1) END AS entry FROM air_file) f ON f.path = d.path AND entry IS NOT NULL)""",
    "air_file", "air_function", "air_import", "air_impl", "air_conversion",
    where=f"NOT (entry = 'lib' AND (wires = 0 OR public <= {mo['lib_decl_budget']})) AND NOT (what = 'function' AND name IN ({', '.join(map(q, mo['entrypoint_fns']))}) AND lines <= {mo['thin_fn_lines']})")

ab = P("AB")
add("AB001", "symbol", "NULL", f"""(SELECT t.*, (SELECT count(*) FROM air_impl i WHERE i.interface = t.symbol) AS ex, (SELECT count(*) FROM air_impl i WHERE {short('i.interface')} = t.name) AS lo, count(*) OVER (PARTITION BY name) AS same
   FROM air_type t WHERE kind = 'Trait')""", "air_type", "air_impl", where="ex = 1 OR (ex = 0 AND same = 1 AND lo = 1)")  # fmt: skip
add("AB002", "symbol", first("name", ab["suspect_names"], glob), "air_type", "air_type", where=f"kind IN ('Trait', 'Struct') AND {some('name', ab['suspect_names'], glob)} AND name NOT IN ({', '.join(map(q, ab['accepted_names']))})")
DOC = "(SELECT item_ix, path, module_path, line_start, line_end, symbol, visibility, doc FROM air_type UNION ALL SELECT item_ix, path, module_path, line_start, line_end, symbol, visibility, doc FROM air_function)"
ref = "https?://[^[:space:]<>\"'']+|(?:^|[^A-Za-z0-9_])#[0-9]+"
left = f"list_filter(regexp_split_to_array(regexp_replace(doc, '{ref}', ' ', 'g'), '[[:space:]]+'), lambda w: regexp_matches(w, '[A-Za-z0-9]'))"
add("CL001", "symbol", f"regexp_replace(trim(regexp_extract(doc, '{ref}')), '[.,)`]+$', '')", DOC, "air_type", "air_function", where=f"regexp_matches(doc, '{ref}') AND len({left}) < {P('CL')['least_words']} AND NOT {some(M, P('CL')['exempt_paths'])}")


def imports(id_: str, where: list[str], what: list[str]) -> None:
    add(id_, "import_path", f"{first(M, where)} || ' -> ' || {first('import_path', what)}", "air_import", "air_import", where=f"{some(M, where)} AND {some('import_path', what)}")


bo = P("BO")
imports("BO001", bo["domain_paths"], bo["forbidden_in_domain"])
frag = lambda x: f"(list_bool_or(list_transform(regexp_split_to_array({x}, '[^A-Za-z0-9_:]+'), lambda w: {some('w', bo['persistence_types'])})))"
add("BO002", "f.symbol", "t", f"air_function f JOIN (SELECT item_ix, arg_min(t, pos) AS t FROM (SELECT item_ix, pos, type_text AS t FROM air_param UNION ALL SELECT item_ix, 99, return_type FROM air_function) WHERE {frag('t')} GROUP BY item_ix) x ON x.item_ix = f.item_ix",
    "air_function", "air_param", where=some(M, bo["domain_paths"]))
der = ", ".join(map(q, bo["forbidden_derives"]))
add("BO004", "symbol", "name", f"(SELECT *, row_number() OVER (PARTITION BY item_ix ORDER BY pos) AS rn FROM air_decorator WHERE source = 'Derive' AND {short('name')} IN ({der}))", "air_decorator", where=f"rn = 1 AND {some(M, bo['canonical_paths'])}")
both = lambda ps: f"{some('f.module_path', ps)} OR {some('a.symbol', ps)}"
fact("BO005", "a.item_ix", ["PersistenceWrite"], both(bo["domain_paths"]))

cr = P("CR")
sfx = " OR ".join(f"suffix({short('target')}, {q(s)})" for s in cr["service_suffixes"])
add("CR001", "function", "target", "air_truth_action", "air_truth_action", where=f"action = 'Construct' AND NOT {some(f'coalesce({M}, chr(0))', cr['root_paths'], tail)} AND ({sfx})")
add("CR002", "function", "n", "(SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY path, function ORDER BY item_ix) AS rn FROM air_truth_action WHERE action = 'Construct' WINDOW w AS (PARTITION BY path, function))", "air_truth_action",
    where=f"rn = 1 AND n >= {cr['wiring_density']} AND {some(M, cr['root_paths'], tail)}")

dc = P("DC")
add("DC001", "symbol", "NULL", DOC, "air_type", "air_function", where=f"visibility = 'Public' AND doc IS NULL AND NOT {some(M, dc['exempt_paths'], tail)}")
rows = ", ".join(f"({q(t.lower())}, {q(t)}, {i}, {j}, {q('Fatal' if c >= 0.9 else 'Warning' if c >= 0.7 else 'Advisory')})" for i, (p, c, al) in enumerate(dc["phrases"]) for j, t in enumerate([p, *al]))
add("DC002", "symbol", "hit", f"(SELECT path, line_start, line_end, symbol, arg_min(txt, j) AS hit, any_value(sev) AS sev FROM {DOC} d JOIN (VALUES {rows}) AS v(low, txt, i, j, sev) ON contains(lower(doc), low) WHERE visibility = 'Public' GROUP BY item_ix, path, line_start, line_end, symbol, i)",
    "air_type", "air_function", severity="sev")
add("DC004", "symbol", "m", f"(SELECT *, unnest(regexp_extract_all(regexp_replace(doc, '(?i)({'|'.join(dc['markers'])})\\(', '', 'g'), '(?i){'|'.join(dc['markers'])}')) AS m FROM {DOC} AS d WHERE visibility = 'Public')", "air_type", "air_function")

er = P("ER")
add("ER001", "symbol", "fst", "(SELECT *, row_number() OVER w AS rn, first_value(name) OVER w AS fst FROM air_type WHERE visibility = 'Public' AND regexp_matches(name, '(Error|Err)$') WINDOW w AS (PARTITION BY path ORDER BY item_ix))", "air_type", where="rn > 1")
le = f"ltrim({e}, '&')"
add("ER002", "symbol", le, "air_function", "air_function", where=some(le, [p.lstrip("&") for p in er["string_error_patterns"]], star))
add("ER003", "symbol || '::' || name", first("field_type", er["boundary_error_patterns"]), "air_variant", "air_variant", where=f"{some(M, er['domain_paths'])} AND {some('field_type', er['boundary_error_patterns'])}")
add("ER005", "function", "pattern", "air_match_arm", "air_match_arm", where=f"{PLACED} AND pattern_has_wildcard AND regexp_matches(trim(pattern), '^Err|Err\\(') AND {SILENT} AND NOT {some(M, er['collapse_owner_paths'])} AND NOT {some('function', er['collapse_owner_paths'])}")
add("ER007", "symbol || '::' || name", "ft", "(SELECT *, first_value(type_name) OVER w AS ft, first_value(path) OVER w AS fp FROM air_variant WHERE regexp_matches(type_name, '(Error|Err)$') WINDOW w AS (PARTITION BY name ORDER BY pkg_ix, file_ix, item_ix, pos))", "air_variant", where="type_name <> ft OR path <> fp")

pa = P("PA")
add("PA001", "symbol", "NULL", f"air_type t JOIN (SELECT {short('interface')} AS s, min(path) AS ip FROM air_impl WHERE interface IS NOT NULL GROUP BY 1 HAVING count(*) = 1) i ON i.s = t.name", "air_type", "air_impl",
    where=f"kind = 'Trait' AND ip = path AND NOT {some('symbol', pa['accepted_colocated'])} AND NOT {some('name', pa['accepted_colocated'])}")
imports("PA002", pa["application_paths"], pa["adapter_paths"])
fact("PA003", "a.item_ix", ["ExternalIo"], both(pa["application_paths"]))
add("PA004", "function", "target", "air_truth_action", "air_truth_action", where=f"action = 'Construct' AND {some('target', pa['adapter_types'])} AND NOT {some(M, pa['construction_paths'])}")

rw = P("RW")
fact("RW001", "a.item_ix", ["SpawnedWork"], f"NOT ({both(rw['owner_paths'])})")
fact("RW002", "a.item_ix", ["BlockingCall"], f"NOT ({both(rw['owner_paths'])})")
add("RW003", "symbol", "name", f"(SELECT *, row_number() OVER (PARTITION BY item_ix ORDER BY pos) AS rn FROM air_field WHERE {some('type_text', rw['state_types'], glob)})", "air_field", where=f"rn = 1 AND {PLACED} AND NOT {some(M, rw['owner_paths'])}")
sg = some("name", rw["singleton_names"], glob)
add("RW004", "symbol", f"CASE WHEN {sg} THEN 'name' ELSE 'field' END", "air_type t LEFT JOIN (SELECT item_ix AS fi, count(*) AS n, any_value(type_text) AS text FROM air_field GROUP BY item_ix) f ON fi = item_ix", "air_type", "air_field",
    where=f"{PLACED} AND NOT {some(M, rw['owner_paths'])} AND ({sg} OR (kind = 'Struct' AND n = 1 AND {some('text', rw['state_types'], glob)}))")
HOT = "a.symbol IN (SELECT symbol FROM air_fact WHERE kind = 'HotPath' AND scope = 'Function')"
fact("RW005", "a.item_ix", ["BlockingCall"], HOT)
fact("RW006", "a.item_ix", ["SpawnedWork"], HOT)

da = P("DA")
add("DA001", "symbol", "NULL", f"""(SELECT t.*, (SELECT count(*) FROM (SELECT i.item_ix, min(r.symbol) AS cr FROM air_impl i JOIN air_type r ON r.kind = 'Trait'
   AND (r.symbol IN (bare(i.interface), {short('bare(i.interface)')}) OR r.name IN (bare(i.interface), {short('bare(i.interface)')})) GROUP BY i.item_ix) c WHERE c.cr = t.symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY pkg_ix DESC, file_ix DESC, item_ix DESC) AS rn FROM air_type t WHERE kind = 'Trait')""".replace("bare(i.interface)", "trim(split_part(i.interface, '<', 1))"),
    "air_type", "air_impl", where="n = 1 AND rn = 1")
add("DA002", "symbol", "target", "air_function f JOIN (SELECT function, min(target) AS target FROM air_truth_action WHERE action = 'Construct' GROUP BY function HAVING count(*) = 1) c ON c.function = f.symbol", "air_function", "air_truth_action", where=some("name", da["factory_names"], glob))
add("DA007", "symbol", "variant", "air_type t JOIN (SELECT item_ix AS vi, min(name) AS variant FROM air_variant GROUP BY item_ix HAVING count(*) = 1) v ON vi = item_ix", "air_type", "air_variant", where=f"kind = 'Enum' AND {some('name', da['strategy_names'], glob)}")

rm = P("RM")
add("RM001", "a.function", "n", f"""(SELECT *, row_number() OVER (PARTITION BY function ORDER BY pkg_ix, file_ix, item_ix) AS rn FROM air_truth_action) a
   JOIN (SELECT function AS cf, count(DISTINCT action) AS n FROM air_truth_action GROUP BY 1) c ON c.cf = a.function AND a.rn = 1
   LEFT JOIN (SELECT symbol, path AS fp, module_path AS fm, line_start AS fl, line_end AS fe FROM air_function QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pkg_ix, file_ix, item_ix) = 1) f ON f.symbol = a.function""",
    "air_truth_action", "air_function", path="coalesce(fp, path)", line_start="CASE WHEN fp IS NULL THEN line_start ELSE fl END", line_end="CASE WHEN fp IS NULL THEN line_end ELSE fe END",
    where=f"n > {rm['max_action_kinds']} AND NOT {some('CASE WHEN fp IS NULL THEN module_path ELSE fm END', rm['exempt_paths'])}")
fact("RM002", "a.kind || ':' || a.item_ix", ["SpawnedWork", "Logging", "ConfigRead"], some("f.module_path", rm["converter_paths"]))
for id_, key, cap in (("RM003", "handler_paths", "handler_cap"), ("RM004", "repository_paths", "repository_cap")):
    add(id_, "function", "n", f"(SELECT function, count(*) AS n FROM air_truth_action WHERE action IN ('StringCompare', 'DiscriminatedMatch') GROUP BY function) c JOIN {FN} f ON f.fs = c.function", "air_truth_action", "air_function", where=f"n > {rm[cap]} AND {some(M, rm[key])}")
fact("RM005", "a.kind || ':' || a.item_ix", ["ExternalIo", "PersistenceWrite"], both(rm["validator_paths"]))
fact("RM006", "a.item_ix", ["PersistenceWrite"], f"({both(rm['domain_paths'])}) AND regexp_matches(a.symbol, '::[A-Z][^:]*::')")

fo = P("FO")
ff = feature(M, fo["features"])
add("FO001", "symbol", "fst || ' -> ' || ft", f"(SELECT *, first_value(ft) OVER (PARTITION BY name ORDER BY pkg_ix, file_ix, item_ix) AS fst FROM (SELECT *, {ff} AS ft FROM air_type WHERE visibility = 'Public') WHERE ft IS NOT NULL)", "air_type", where="ft <> fst")
tok = f"list_filter(list_transform(regexp_split_to_array(type_text, '[^A-Za-z0-9_:]+'), lambda w: {feature('w', fo['features'])}), lambda h: h IS NOT NULL)[1]"
add("FO004", "symbol || '.' || name", tok, "air_field", "air_field", where=f"{some(M, fo['shared_paths'])} AND {tok} IS NOT NULL")

ob = P("OB")
fact("OB001", "a.evidence || ':' || a.item_ix", ["Logging"], f"a.evidence IN ({', '.join(map(q, ob['log_targets']))}) AND NOT {some('f.module_path', ob['observer_paths'])}")
for id_, mac, own_ in (("OB002", "metric_macros", "metric_owner_paths"), ("OB003", "event_macros", "event_owner_paths")):
    add(id_, "function", "callee", "air_call_site", "air_call_site", where=f"{PLACED} AND call_kind = 'Meta' AND callee IN ({', '.join(map(q, ob[mac]))}) AND NOT {some(M, ob[own_])}")
add("OB004", "b.symbol", "NULL", f"""(SELECT DISTINCT symbol FROM air_fact WHERE scope = 'Function' AND kind = 'BoundaryEntry' AND symbol NOT IN (SELECT symbol FROM air_fact WHERE scope = 'Function' AND kind = 'Logging')) b
   LEFT JOIN (SELECT symbol AS fs, path, module_path, line_start, line_end, pkg_ix, file_ix, item_ix FROM air_function QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pkg_ix, file_ix, item_ix) = 1) f
     ON f.fs = b.symbol AND f.module_path IS NOT NULL""", "air_fact", "air_function", path="coalesce(path, '<unknown>')", line_start="coalesce(line_start, 0)", line_end="coalesce(line_end, 0)")  # fmt: skip

cf = P("CF")
cfg = some(M, cf["config_paths"], either)
fact("CF001", "a.item_ix", ["ConfigRead"], f"NOT {some('f.module_path', cf['config_paths'], either)}")
add("CF002", "function", "value", "air_literal", "air_literal", where=f"{PLACED} AND lower(kind) IN ({', '.join(map(q, cf['literal_kinds']))}) AND NOT {cfg}")
lit = "trim(value, '\"')"
add("CF003", "function", first(lit, cf["id_patterns"], either), "air_literal", "air_literal", where=f"{PLACED} AND kind = 'Str' AND {some(lit, cf['id_patterns'], either)} AND NOT {cfg}")

ta = P("TA")
add("TA001", "symbol", first(M, ta["test_paths"]), "air_type", "air_type", where=f"visibility = 'Public' AND {some(M, ta['test_paths'])}")
add("TA002", "symbol", first("name", ta["canonical_names"], named), "air_type", "air_type", where=f"{some(M, ta['test_paths'])} AND {some('name', ta['canonical_names'], named)}")
sets = ", ".join(f"({q(n)}, [{', '.join(map(q, fs))}], {i})" for i, (n, fs) in enumerate(ta["canonical_fields"]))
echo = " OR ".join(f"contains(name, {q(n.strip('*'))})" for n in ta["canonical_names"])
add("TA003", "symbol", "who", f"""(SELECT t.item_ix, any_value(path) AS path, any_value(line_start) AS line_start, any_value(line_end) AS line_end, any_value(symbol) AS symbol, max(j) AS j, arg_max(who, j * 100 - i) AS who FROM (
   SELECT t.*, v.who, v.i, CAST(len(list_intersect(own, fs)) AS DOUBLE) / len(list_distinct(list_concat(own, fs))) AS j FROM air_type t JOIN (SELECT item_ix AS fi, list(DISTINCT name) AS own FROM air_field GROUP BY item_ix) f ON fi = item_ix, (VALUES {sets}) AS v(who, fs, i)
   WHERE kind = 'Struct' AND {some(M, ta['test_paths'])} AND ({echo})) t GROUP BY t.item_ix)""", "air_type", "air_field", where="j >= 0.5")  # fmt: skip
pt = " OR ".join(some(x, ta["port_traits"], m) for x in ("interface", short("interface")) for m in (seg, named))
add("TA004", "target_type", "interface", "air_impl", "air_impl", where=f"{some(M, ta['test_paths'])} AND NOT {some(M, ta['adapter_paths'])} AND interface IS NOT NULL AND ({pt})")

ut = P("UT")
add("UT001", "symbol", first(M, ut["utility_paths"]), "air_type", "air_type", where=f"visibility = 'Public' AND {some(M, ut['utility_paths'])}")
imports("UT002", ut["utility_paths"], ut["forbidden_imports"])
file_level("UT003", M, first(M, ut["generic_patterns"]), "air_file", "air_file", where=f"{some(M, ut['generic_patterns'])} AND NOT {some(M, ut['accepted_modules'])}")
hit = some("target", ut["canonical_constructs"])
add("UT004", "function", "action || ':' || target", "air_truth_action", "air_truth_action", where=f"{some(M, ut['utility_paths'])} AND action IN ('Construct', 'Validate', 'Normalize') AND {hit}")
add("UT005", "function", "action || ':' || target", "air_truth_action", "air_truth_action", where=f"{some(M, ut['utility_paths'])} AND action IN ('Validate', 'Normalize') AND NOT {hit}")

# --- operators ------------------------------------------------------------

ROUND = "round(CAST({} AS DOUBLE), 4)"
CONF = CLUSTERS + f""", ends AS (SELECT stem, symbol AS e FROM member UNION SELECT stem, name FROM member), linked AS (
  SELECT DISTINCT a.stem FROM air_conversion c JOIN ends a ON c.from_type = a.e JOIN ends b ON c.to_type = b.e AND a.stem = b.stem
), graded AS (
  SELECT stem, least(1.0, 0.4 + CASE WHEN bool_or(role = 'Canonical') THEN 0.4 * coalesce(avg(CAST(overlap AS FLOAT)) FILTER (WHERE role <> 'Canonical'), 0) ELSE 0.3 * avg(CAST(overlap AS FLOAT)) END
    + CASE WHEN stem IN (SELECT stem FROM linked) THEN 0.2 ELSE 0 END) AS confidence FROM member GROUP BY stem
)"""
KEBAB = "lower(regexp_replace(stem, '(.)([A-Z])', '\\1-\\2', 'g'))"
ORACLES["concept_clusters"] = f"{ctes(*CLUSTER_TABLES)}{CONF}\nSELECT {KEBAB} AS concept, stem, symbol, role, reference, {ROUND.format('CAST(overlap AS FLOAT)')} AS overlap, round(confidence, 4) AS confidence FROM member m JOIN (SELECT stem AS gs, max(confidence) AS confidence FROM graded GROUP BY stem) g ON g.gs = m.stem"
SEGS = "list_sum(list_transform(string_split(symbol, '::'), lambda s: CASE WHEN s IN ('domain', 'core', 'model', 'models') THEN 3 WHEN s IN ('api', 'dto', 'dtos', 'transport') THEN -2 ELSE 0 END))"
SCORED = f""", scored AS (
  SELECT m.*, CASE WHEN lower(name) = lower(stem) THEN 3 ELSE 0 END - CASE WHEN {SUFFIX} IS NOT NULL THEN 3 ELSE 0 END + {SEGS}
    + (SELECT count(*) FROM air_conversion c WHERE {short('c.to_type')} = {short('m.symbol')}) AS score FROM {{members}} m
), ranked AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM scored WINDOW w AS (PARTITION BY stem ORDER BY score DESC, pkg_ix, file_ix, item_ix)),
elected AS (SELECT stem, symbol, CAST(score AS BIGINT) AS score FROM ranked WHERE rn = 1 AND (nxt IS NULL OR score - nxt >= 2))"""
ORACLES["canonical_election"] = f"{ctes(*CLUSTER_TABLES)}{CLUSTERS}{SCORED.format(members='member')}\nSELECT * FROM elected"
ORACLES["conversion_provenance"] = f"{ctes('air_conversion')}\nSELECT symbol, mechanism, layer, path, line_start FROM {CONV} c"
PICK = "(SELECT e, arg_min(concept, concept || chr(1) || symbol) AS c FROM (SELECT symbol AS e, concept, symbol FROM policy_concept UNION ALL SELECT name, concept, symbol FROM policy_concept) GROUP BY e)"
RESOLVED = """res AS MATERIALIZED (
  SELECT 'q' || k AS package, CASE WHEN k % 3 = 0 THEN 'u64' ELSE k || '::old::' || word END AS from_type, CASE WHEN k % 2 = 0 THEN 'p' || pkg_ix || '::' || word ELSE word END AS to_type,
    CASE WHEN k % 5 = 2 THEN 'TryFrom' ELSE 'From' END AS mechanism, CASE k % 5 WHEN 0 THEN 'core::convert::From' WHEN 1 THEN 'From' ELSE 'std::convert::TryFrom' END AS tr, path, line AS line_start, line + 3 AS line_end
  FROM part_file WHERE k % 13 > 0 AND k % 17 > 0 AND k % 6 <> 5 AND k % 7 <> 6 AND k % 11 <> 3 AND k % 5 < 3)"""
ORACLES["resolved_conversions"] = f"{ctes('part_file')}, {RESOLVED}\nSELECT package, from_type, to_type, mechanism, 'impl ' || tr || '<' || from_type || '> for ' || to_type AS symbol, path, line_start, line_end FROM res"
ORACLES["overlaid_conversions"] = f"""{ctes('part_file', 'air_conversion')}, {RESOLVED}, every AS (
  SELECT path, line_start, line_end, mechanism, {short('from_type')} AS f, {short('to_type')} AS t, layer FROM air_conversion
  UNION ALL SELECT path, line_start, line_end, mechanism, {short('from_type')}, {short('to_type')}, 'SemanticResolved' FROM res),
kept AS (SELECT mechanism, max(CASE layer WHEN 'Syntactic' THEN 1 WHEN 'SourceHint' THEN 2 WHEN 'SemanticResolved' THEN 3 ELSE 0 END) AS r FROM every GROUP BY path, line_start, line_end, mechanism, f, t)
SELECT CASE r WHEN 3 THEN 'SemanticResolved' ELSE 'Heuristic' END AS layer, mechanism, count(*) AS n FROM kept GROUP BY 1, 2"""
ORACLES["endpoint_lookup"] = f"{ctes('air_conversion', 'policy_concept')}\nSELECT v.symbol, layer, f.c AS from_concept, t.c AS to_concept FROM air_conversion v LEFT JOIN {PICK} f ON f.e = v.from_type LEFT JOIN {PICK} t ON t.e = v.to_type"
ORACLES["fact_function_lookup"] = f"{ctes('air_fact', 'air_function')}\nSELECT a.symbol, kind, a.item_ix AS fact_ix, f.path, f.line_start FROM air_fact a JOIN {FN} f ON f.fs = a.symbol WHERE scope = 'Function' AND f.module_path IS NOT NULL"
EDGES = """, e AS (SELECT src, dst, path, line_start FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY pkg_ix, file_ix, item_ix) AS rn FROM (
  SELECT *, split_part(module_path, '::', 1) AS src, split_part(import_path, '::', 1) AS dst FROM air_import WHERE module_path IS NOT NULL) WHERE src <> dst) WHERE rn = 1)"""
ORACLES["package_graph"] = f"{ctes('air_import')}{EDGES}\nSELECT * FROM e"
CLOSURE = "WITH RECURSIVE " + ctes("air_import").removeprefix("WITH ") + EDGES + ", r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"
ORACLES["package_reachability"] = f"{CLOSURE}\nSELECT src, dst FROM r"
ORACLES["package_cycles"] = f"{CLOSURE}\nSELECT a.src AS node, min(a.dst) AS component, count(*) AS size FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src"
ORACLES["feature_ownership"] = f"{ctes('air_file')}\nSELECT path, {feature(M, dg['features'])} AS feature FROM air_file WHERE {feature(M, dg['features'])} IS NOT NULL"
ORACLES["line_percentiles"] = f"{ctes('air_function')}\nSELECT visibility, CAST(quantile_disc(line_count, 0.95) AS BIGINT) AS value FROM air_function GROUP BY visibility"
ORACLES["interval_overlap"] = f"{ctes('air_type', 'air_conversion')}\nSELECT t.symbol, c.symbol AS conversion, c.layer, t.line_start AS from_line FROM air_type t JOIN air_conversion c ON (suffix(t.path, c.path) OR suffix(c.path, t.path)) AND t.line_start <= c.line_end AND c.line_start <= t.line_end"
TARGET = "(SELECT h.*, (SELECT arg_min(t.symbol, t.item_ix) FROM {} t WHERE t.path = h.path AND h.target_start BETWEEN t.line_start AND t.line_end) AS target_symbol FROM air_hint h)"
ORACLES["hint_target_lookup"] = f"{ctes('air_hint', 'air_type')}\nSELECT category, path, target_start, target_symbol FROM {TARGET.format('air_type')} x"
ORACLES["top_level_modules"] = f"{ctes('air_file')}\nSELECT DISTINCT replace(package, '-', '_') AS module FROM air_file"
LAYER_WORDS = ", ".join(f"({q(w)}, {q(k)})" for k, ws in {
    "domain": ["domain", "core", "model", "models"], "api": ["api", "dto", "dtos", "transport"], "application": ["application", "usecases", "handlers", "service", "services"],
    "composition": ["composition", "wiring", "bin", "main"], "tests": ["tests", "test_support", "fixtures"], "utilities": ["util", "utils", "common", "helpers"], "config": ["config", "settings"],
}.items() for w in ws)
LAYER_ROWS = f"(SELECT DISTINCT layer, array_to_string(list_slice(string_split(module_path, '::'), 1, list_position(string_split(module_path, '::'), w)), '::') || '::*' AS glob FROM (SELECT module_path FROM air_file) f JOIN (VALUES {LAYER_WORDS}) AS v(w, layer) ON contains('::' || module_path || '::', '::' || w || '::'))"
ORACLES["layer_detection"] = f"{ctes('air_file')}\nSELECT * FROM {LAYER_ROWS} x"
SEG = "list_extract(string_split(callee, '::'), {})".format
L1, L2, L3 = SEG(-1), SEG(-2), SEG(-3)
CALLED = "UNION ALL ".join(
    f"SELECT {q(kind)} AS kind, 'Function' AS scope, function AS symbol, callee AS evidence, item_ix FROM air_call_site WHERE {cond} "
    for kind, cond in [
        ("SpawnedWork", f"call_kind = 'Function' AND {L1} = 'spawn'"), ("ConfigRead", f"call_kind = 'Function' AND {L2} = 'env' AND {L1} IN ('var', 'var_os')"),
        ("PersistenceWrite", f"call_kind = 'Function' AND {L2} = 'fs' AND {L1} IN ('write', 'create_dir', 'create_dir_all', 'remove_file', 'remove_dir', 'remove_dir_all', 'copy', 'rename', 'hard_link', 'soft_link', 'symlink')"),
        ("BlockingCall", f"call_kind = 'Function' AND {L2} = 'fs' AND {L1} IN ('read', 'read_to_string', 'read_dir', 'metadata', 'canonicalize', 'open')"),
        ("BlockingCall", f"call_kind = 'Function' AND {L2} = 'thread' AND {L1} IN ('sleep', 'park', 'park_timeout')"),
        ("ExternalIo", f"call_kind = 'Function' AND {L3} = 'process' AND {L2} = 'Command'"),
        ("BlockingCall", f"call_kind = 'Function' AND {L3} = 'process' AND {L2} = 'Command' AND {L1} IN ('output', 'status', 'wait', 'wait_with_output')"),
        ("ExternalIo", f"call_kind = 'Function' AND {L3} = 'net' AND {L2} IN ('TcpStream', 'TcpListener', 'UdpSocket')"),
        ("BlockingCall", f"call_kind = 'Function' AND {L3} = 'net' AND {L2} IN ('TcpStream', 'TcpListener', 'UdpSocket')"),
        ("Logging", f"call_kind = 'Meta' AND (callee IN ('println', 'eprintln', 'print', 'eprint', 'dbg') OR {L1} IN ('info', 'warn', 'error', 'debug', 'trace'))"),
    ]
)
ORACLES["runtime_call_facts"] = f"{ctes('air_call_site')}\n{CALLED}"
MARKED_KINDS = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in [
    ("spawned_work", "SpawnedWork"), ("config_read", "ConfigRead"), ("logging", "Logging"), ("external_io", "ExternalIo"), ("persistence_write", "PersistenceWrite"), ("blocking_call", "BlockingCall"),
    ("hot_path", "HotPath"), ("request_context", "RequestContext"), ("boundary_entry", "BoundaryEntry"), ("runtime_state_owner", "RuntimeStateOwner"), ("background_worker", "BackgroundWorker"),
])
MARKED = f"SELECT CASE fact_kind {MARKED_KINDS} END AS kind, target_symbol AS symbol, item_ix FROM {TARGET.format('air_function')} x WHERE category = 'marker' AND target_symbol IS NOT NULL AND fact_kind <> 'metric_emission'"
ORACLES["marker_facts"] = f"{ctes('air_hint', 'air_function')}\n{MARKED}"


def loaded(*tables: str) -> str:
    """The WITH list with ``air_fact`` as rules read it: given, called and marked."""
    base = ctes("air_fact", "air_call_site", "air_hint", "air_function", *tables).replace("air_fact AS MATERIALIZED (", "given_fact AS MATERIALIZED (")
    return f"""{base}, air_fact AS MATERIALIZED (SELECT kind, scope, symbol, evidence, item_ix FROM given_fact UNION ALL {CALLED} UNION ALL SELECT kind, 'Function', symbol, NULL, item_ix FROM ({MARKED}) AS mk)"""


ORACLES["loaded_facts"] = f"{loaded()}\nSELECT * FROM air_fact"
_OPENS = "instr(l, 'r#\"') > 0 AND NOT contains(substr(l, instr(l, 'r#\"') + 3), '\"#')"
ORACLES["scanned_hints"] = rf"""{ctes('air_source')}, f AS (SELECT path, [regexp_replace(z, chr(13) || '$', '') FOR z IN string_split(text, chr(10))] AS ls FROM air_source),
st AS (SELECT path, ls, list_reduce(list_prepend('0', ls), lambda acc, l: acc || CASE WHEN right(acc, 1) = '1' THEN CASE WHEN contains(l, '"#') THEN '0' ELSE '1' END WHEN {_OPENS} THEN '1' ELSE '0' END) AS states FROM f),
n AS (SELECT path, i, ls[i] AS l, ltrim(ls[i], ' ' || chr(9)) AS t, substr(states, i, 1) AS state, ls FROM st, unnest(range(1, len(ls) + 1)) AS u(i)),
h AS (SELECT *, trim(substr(t, 11), ' ' || chr(9)) AS body, string_split(trim(regexp_replace(trim(substr(t, 11), ' ' || chr(9)), '\s+', ' ', 'g')), ' ') AS w FROM n
  WHERE state = '0' AND NOT ({_OPENS}) AND prefix(t, '// girder:')),
c AS (SELECT *, CASE WHEN w[1] = 'allow' THEN 'allow' WHEN w[1] = 'fact' THEN 'marker' WHEN w[1] = 'ot' AND w[2] IN ('canonical', 'boundary', 'converter', 'protocol-translation', 'generated-boundary') THEN replace(w[2], '-', '_') ELSE 'unknown' END AS category FROM h)
SELECT path, CAST(i AS INT) AS line_no, coalesce((SELECT CAST(min(j) AS INT) FROM n m WHERE m.path = c.path AND m.i > c.i AND trim(m.l, ' ' || chr(9)) <> '' AND NOT prefix(m.t, '//') AND NOT prefix(m.t, '#[') AND NOT prefix(m.t, '#![')), 0) AS target_line,
  category, CASE WHEN category = 'allow' THEN coalesce(w[2], '') END AS rule, CASE WHEN category = 'boundary' THEN w[3] END AS concept, CASE WHEN category = 'boundary' THEN w[4] END AS boundary,
  CASE WHEN category = 'marker' THEN lower(regexp_replace(replace(coalesce(w[2], ''), '-', '_'), '([^_])([A-Z])', '\1_\2', 'g')) END AS fact_kind,
  CASE WHEN contains(body, 'reason="') AND contains(substr(body, instr(body, 'reason="') + 8), '"') THEN string_split(substr(body, instr(body, 'reason="') + 8), '"')[1] END AS reason,
  CASE WHEN contains(body, 'expires="') THEN string_split(substr(body, instr(body, 'expires="') + 9), '"')[1] END AS expires FROM c""".replace("min(j)", "min(m.i)")
ORACLES["source_module_paths"] = f"{ctes('air_file')}\nSELECT path, package || '::' || replace(regexp_replace(regexp_extract(path, 'src/(.*)\\.rs$', 1), '/mod$', ''), '/', '::') AS module FROM air_file"

FOUND = f"{loaded(*PROJECTION)}, u AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM ({BODIES[r]}) AS r_{r.lower()}" for r in RULES) + ")"
COLS = "rule_id, severity, path, line_start, line_end, subject, detail"
ranks = " ".join(f"WHEN {q(r)} THEN {i}" for i, r in enumerate(RULES))
ORACLES["observed_findings"] = f"{FOUND}\nSELECT {COLS} FROM u"
ORACLES["finding_numbers"] = f"""{FOUND}
SELECT rule_id, n, CAST(upto - n + 1 AS BIGINT) AS first_id, CAST(upto AS BIGINT) AS last_id FROM (
  SELECT rule_id, n, sum(n) OVER (ORDER BY CASE rule_id {ranks} END) AS upto FROM (SELECT rule_id, count(*) AS n FROM u GROUP BY rule_id))"""
STRICT = """CASE WHEN severity = 'Warning' AND NOT (rule_id = 'CX001' AND split_part(detail, '/', 2) = '50') AND NOT (rule_id = 'CX002' AND split_part(detail, '/', 2) = '400') THEN 'Fatal' ELSE severity END"""
ORACLES["strict_severities"] = f"{FOUND}\nSELECT rule_id, {STRICT} AS severity, count(*) AS n FROM u GROUP BY rule_id, {STRICT}"
ORACLES["decisions"] = f"{FOUND}\nSELECT CASE WHEN severity = 'Advisory' THEN 'Advisory' ELSE 'Active' END AS status, severity, count(*) AS n FROM u GROUP BY severity"
ORACLES["undecided_findings"] = f"{FOUND}\nSELECT rule_id, CAST(CASE WHEN rule_id LIKE 'UT%' THEN 2 ELSE 0 END AS BIGINT) AS n, count(*) AS findings FROM u WHERE rule_id LIKE 'UT%' OR rule_id LIKE 'TA%' GROUP BY rule_id"
ORACLES["materialised_diagnostics"] = f"""{FOUND}
SELECT CASE WHEN rule_id = 'MO001' THEN 'GOV009' ELSE rule_id END AS rule_id, severity, coalesce(path, 'policy.json') AS path, coalesce(line_start, 1) AS line_start, coalesce(line_end, 1) AS line_end, subject,
  concat_ws('; ', detail, CASE WHEN rule_id = 'MO001' THEN 'too many types' END) AS detail, CASE WHEN severity = 'Advisory' THEN 'Advisory' ELSE 'Active' END AS status FROM u WHERE rule_id NOT LIKE 'UT%'"""
ORACLES["legacy_rows"] = f"{FOUND}\nSELECT rule_id, count(*) AS n FROM u WHERE left(rule_id, 2) IN ('CX', 'DG') GROUP BY rule_id"
MATCH = "(pat = '*' OR lower(pat) = lower(rule_id) OR (length(pat) = 2 AND prefix(rule_id, pat)))"
KEPT = f"""{FOUND}, d AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM u),
ends AS MATERIALIZED (SELECT a.path AS dp, b.f AS mf FROM (SELECT DISTINCT path FROM u) a JOIN (SELECT path AS f FROM air_hint UNION SELECT regexp_replace(target, ':[0-9]+$', '') FROM policy_exception) b ON suffix(a.path, b.f) OR suffix(b.f, a.path)),
cand AS MATERIALIZED (
  SELECT id, rule_id, path, line_start, expires, row(0, pkg_ix, file_ix, item_ix) AS seq FROM d JOIN ends ON dp = path JOIN (SELECT path AS hp, rule AS pat, expires, target_start, target_end, pkg_ix, file_ix, item_ix FROM air_hint WHERE category = 'allow') h
    ON hp = mf AND {MATCH} AND line_start <= target_end AND target_start <= line_end
  UNION ALL SELECT id, rule_id, path, line_start, expires, row(1, ix, 0, 0) FROM d JOIN ends ON dp = path JOIN (SELECT rule AS pat, expires, ix, regexp_replace(target, ':[0-9]+$', '') AS tf, nullif(regexp_extract(target, ':([0-9]+)$', 1), '') AS tl FROM policy_exception) e
    ON tf = mf AND {MATCH} AND (tl IS NULL OR CAST(tl AS INT) BETWEEN line_start AND line_end)
), live AS (SELECT id, min(seq) AS stop FROM cand WHERE expires IS NULL OR expires >= '1998-06-01' GROUP BY id),
kept AS MATERIALIZED (
  SELECT {COLS} FROM d WHERE id NOT IN (SELECT id FROM live)
  UNION ALL SELECT DISTINCT 'GOV001', 'Warning', path, line_start, line_start, rule_id, expires FROM cand LEFT JOIN live USING (id) WHERE expires < '1998-06-01' AND (stop IS NULL OR seq < stop)
)"""
ORACLES["suppressed_diagnostics"] = f"{KEPT}\nSELECT * FROM kept"
ORACLES["changed_diagnostics"] = f"{FOUND}\nSELECT {COLS} FROM u WHERE path IN (SELECT a.path FROM air_file a JOIN air_file b ON suffix(a.path, '/' || regexp_replace(b.path, '^p[0-9]+/', '')) WHERE b.line_count >= 200)"
ORACLES["exit_status"] = f"{FOUND}\nSELECT count(*) AS fatal, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS status FROM u WHERE severity = 'Fatal'"
# fixed values: the members that keep a family from being vacant
TELLING = {
    "BO": ["domain_paths", "forbidden_in_domain", "persistence_types", "canonical_paths"], "CF": ["config_paths"], "CR": ["root_paths"], "DA": ["enabled"], "DG": ["edges", "features", "shared_paths"],
    "ER": ["domain_paths", "string_error_patterns", "boundary_error_patterns", "collapse_owner_paths"], "FL": ["domain_paths", "boundary_error_patterns", "invariant_owner_paths", "retry_policy_owner_paths"],
    "FO": ["features", "shared_paths"], "PA": ["application_paths", "adapter_paths", "adapter_types"], "RM": ["max_action_kinds", "converter_paths", "handler_paths", "repository_paths", "validator_paths", "domain_paths"],
    "RW": ["owner_paths"], "TA": ["test_paths"], "UT": ["utility_paths", "generic_patterns"],
}
ORACLES["vacancy_rows"] = f"""{ctes('policy_entries')}, m AS (SELECT * FROM (VALUES {', '.join(f"('{f}', '{k}')" for f, ks in TELLING.items() for k in ks)}) AS v(f, k))
SELECT DISTINCT 'GOV002' AS rule_id, 'Advisory' AS severity, f AS subject FROM m
WHERE NOT EXISTS (SELECT 1 FROM policy_entries e JOIN m n ON e.family = n.f AND e.key = n.k WHERE e.doc = 'current' AND n.f = m.f AND (e.name IS NOT NULL OR coalesce(e.value, 0) <> 0))
  AND NOT EXISTS (SELECT 1 FROM policy_entries e WHERE e.doc = 'current' AND e.key = 'acknowledged' AND e.name = m.f)"""
ORACLES["unregistered_codes"] = f"{FOUND}\nSELECT rule_id AS subject, count(*) AS n FROM u WHERE rule_id IN ('UT003', 'MO001') GROUP BY rule_id"
NAMES = f"(VALUES {', '.join(f'({q(r)})' for r in RULES)}) AS v(name)"
ORACLES["registry_drift"] = f"""{ctes('air_hint', 'policy_exception')}, d AS (SELECT rule AS name FROM air_hint UNION SELECT rule FROM policy_exception), r AS (SELECT name FROM {NAMES})
SELECT name, 'not registered' AS what FROM d WHERE name NOT IN (SELECT name FROM r) UNION ALL SELECT name, 'not declared' FROM r WHERE name NOT IN (SELECT name FROM d)"""
ORACLES["registry_coherence"] = f"""{ctes('policy_entries', 'policy_exception')}, c AS (SELECT DISTINCT name FROM policy_entries WHERE doc = 'current' AND name IS NOT NULL), b AS (SELECT DISTINCT name FROM policy_entries WHERE doc = 'baseline' AND name IS NOT NULL),
r AS (SELECT DISTINCT rule, left(rule, 2) AS family FROM policy_exception), f AS (SELECT DISTINCT family FROM policy_entries WHERE doc = 'current' AND family <> ''),
odd AS (SELECT rule AS s, 'unknown family ' || family AS w FROM r WHERE family NOT IN (SELECT family FROM f) UNION ALL SELECT family, 'unknown rule ' || family || '001' FROM f WHERE family || '001' NOT IN (SELECT rule FROM r))
SELECT 'given' AS declaration, name AS subject, 'not registered' AS what FROM c WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT 'given', name, 'not declared' FROM b WHERE name NOT IN (SELECT name FROM c)
UNION ALL SELECT 'absent', 'declaration', 'missing' UNION ALL SELECT 'broken', 'declaration', 'unreadable: no object'
UNION ALL SELECT d, s, w FROM (VALUES ('given'), ('absent'), ('broken')) AS a(d), odd"""
ORACLES["policy_chain"] = f"""{FOUND}, total AS (SELECT count(*) AS t FROM u), r AS (SELECT name FROM {NAMES}), d AS (SELECT rule AS name FROM air_hint UNION SELECT rule FROM policy_exception),
added AS (
  SELECT 1 AS step, 'registry-integrity' AS policy, 'GOV003' AS rule_id, 'Active' AS status, rule_id AS subject, CAST(count(*) AS VARCHAR) AS detail FROM u WHERE rule_id IN ('UT003', 'MO001') GROUP BY rule_id
  UNION ALL SELECT 2, 'registry-coherence', 'GOV004', 'Advisory', name, 'not registered' FROM d WHERE name NOT IN (SELECT name FROM r)
  UNION ALL SELECT 2, 'registry-coherence', 'GOV004', 'Advisory', name, 'not declared' FROM r WHERE name NOT IN (SELECT name FROM d)
  UNION ALL SELECT DISTINCT 3, 'concept-source-of-truth', 'GOV005', 'Active', 'DC002', 'rule' FROM u WHERE rule_id = 'DC002'
  UNION ALL SELECT DISTINCT 3, 'concept-source-of-truth', 'GOV005', 'Advisory', 'TA', 'family' FROM u WHERE rule_id LIKE 'TA%'
  UNION ALL SELECT 3, 'concept-source-of-truth', 'GOV005', 'Active', 'GOV004', 'governance-code' WHERE EXISTS (SELECT 1 FROM r)
)
SELECT policy, rule_id, status, subject, CAST(1 AS BIGINT) AS n, CAST((SELECT t FROM total) + row_number() OVER (ORDER BY step, rule_id, subject, detail) AS BIGINT) AS first_id FROM added
UNION ALL SELECT 'default', rule_id, CASE WHEN severity = 'Advisory' THEN 'Advisory' ELSE 'Active' END, NULL, count(*), 0 FROM u GROUP BY ALL"""
ORACLES["concept_source_of_truth"] = f"""{KEPT}
SELECT DISTINCT 'rule' AS concept, rule_id AS identifier, 'Warning' AS severity FROM kept WHERE rule_id IN ('UT003', 'MO001')
UNION ALL SELECT DISTINCT 'family', left(rule_id, 2), 'Advisory' FROM kept WHERE rule_id LIKE 'TA%'
UNION ALL SELECT DISTINCT 'policy', 'expiry', 'Warning' FROM kept WHERE rule_id = 'GOV001'
UNION ALL SELECT DISTINCT 'governance-code', rule_id, 'Warning' FROM kept WHERE rule_id = 'GOV001'
UNION ALL SELECT 'widget', 'widget', 'Advisory'"""
_GAPS = "concat_ws(',', CASE WHEN c.reason IS NULL THEN 'reason' END, CASE WHEN c.expires IS NULL THEN 'expires' END, CASE WHEN c.owner IS NULL THEN 'owner' END)"
PAIR = f"""cur AS (SELECT * FROM policy_entries WHERE doc = 'current'), base AS (SELECT * FROM policy_entries WHERE doc = 'baseline'),
pair AS (SELECT c.*, b.value AS old, b.doc IS NULL AS fresh, {_GAPS} AS gaps FROM cur c LEFT JOIN base b ON b.family = c.family AND b.key = c.key AND b.name = c.name WHERE c.name IS NOT NULL),
preset AS (SELECT * FROM (VALUES ('CX', 'fn_lines', 50), ('CX', 'module_lines', 400), ('CX', 'max_public_items', 30), ('CX', 'max_fan_out', 25), ('MO', 'max_public_types', 5), ('MO', 'entropy_threshold', 3)) AS v(f, k, d)),
num AS (SELECT f, k, coalesce((SELECT value FROM cur WHERE family = f AND key = k AND name IS NULL), d) AS a, coalesce((SELECT value FROM base WHERE family = f AND key = k AND name IS NULL), d) AS b FROM preset WHERE f IN (SELECT family FROM cur)),
drift AS MATERIALIZED (
  SELECT 'PG001' AS code, 'Fatal' AS severity, f AS family, k AS subject, b || ' -> ' || a AS detail FROM num WHERE a > b
  UNION ALL SELECT 'PG001', 'Fatal', family, name, old || ' -> ' || value FROM pair WHERE key LIKE '%overrides' AND NOT fresh AND value > old
  UNION ALL SELECT 'PG002', 'Fatal', family, name, CAST(value AS VARCHAR) FROM pair WHERE key LIKE '%overrides' AND fresh
  UNION ALL SELECT 'PG006', 'Fatal', family, name, gaps FROM pair WHERE key LIKE '%overrides' AND fresh AND gaps <> ''
  UNION ALL SELECT 'PG003', 'Fatal', family, name, NULL FROM pair WHERE key = 'exempt_paths' AND fresh
  UNION ALL SELECT 'PG007', 'Fatal', family, name, gaps FROM pair WHERE key = 'exempt_paths' AND family = 'CX' AND fresh AND gaps <> ''
  UNION ALL SELECT 'PG004', 'Fatal', name, name, NULL FROM pair WHERE key = 'acknowledged' AND fresh
  UNION ALL SELECT 'PG009', 'Fatal', name, name, gaps FROM pair WHERE key = 'acknowledged' AND fresh AND gaps <> ''
  UNION ALL SELECT 'PG008', 'Fatal', family, name, NULL FROM pair WHERE key = 'converter_paths' AND fresh)"""
ORACLES["policy_drift"] = f"{ctes('policy_entries')}, {PAIR}\nSELECT * FROM drift"
FIXED = "(VALUES ('exempt', 'CX007', 'paradigms.CX.exempt_paths:*::tests::*', NULL, NULL), ('exempt', 'CX007', 'paradigms.CX.exempt_paths:*::gen::*', NULL, NULL), ('acknowledged', 'GOV002', 'acknowledged_empty:CF', NULL, NULL)) AS v(origin, rule, target, reason, expires)"
DEBT = f"""(SELECT *, CASE WHEN expires IS NULL THEN 'Unbounded' WHEN expires < '1998-06-01' THEN 'Expired' ELSE 'Active' END AS status FROM (
  SELECT 'hint' AS origin, rule, path || ':' || target_start AS target, reason, expires FROM air_hint WHERE category = 'allow' UNION ALL SELECT 'exception', rule, target, reason, expires FROM policy_exception)
  UNION ALL SELECT *, 'LegacyNoMetadata' FROM {FIXED}
  UNION ALL SELECT 'exempt', 'CX007', 'paradigms.CX.exempt_paths:*::d::*', 'r', 'e', 'Active' UNION ALL SELECT 'acknowledged', 'GOV002', 'acknowledged_empty:TA', 'none', '2030-01-01', 'Active') AS debt"""
_PM = """CASE WHEN pattern = '*' THEN true WHEN pattern IN ('*::', '::*', '*::*') THEN false
  WHEN prefix(pattern, '*::') AND suffix(pattern, '::*') THEN contains('::' || m || '::', substr(pattern, 2, length(pattern) - 2)) WHEN prefix(pattern, '*::') THEN suffix('::' || m, substr(pattern, 2))
  WHEN suffix(pattern, '::*') THEN prefix(m || '::', left(pattern, length(pattern) - 1)) ELSE m = pattern END"""
ORACLES["first_matching_pattern"] = f"""{ctes('air_file', 'policy_pattern')}, m AS (SELECT DISTINCT module_path AS m FROM air_file WHERE module_path IS NOT NULL)
SELECT m AS path, min(ix) AS ix, arg_min(pattern, ix) AS pattern FROM m JOIN policy_pattern ON {_PM} GROUP BY m"""
_STEM = f"left(n, length(n) - length(coalesce({SUFFIX.replace('name', 'n')}, '')))"
PROPOSED = f"""{ctes('policy_proposal', 'policy_accepted', 'air_type')}, n AS (SELECT symbol, min(name) AS n FROM air_type GROUP BY symbol),
q AS (SELECT p.*, n, coalesce(concept, CASE WHEN role = 'canonical' AND n IS NOT NULL THEN (SELECT {KEBAB} FROM (SELECT {_STEM} AS stem)) END) AS meant FROM policy_proposal p LEFT JOIN n USING (symbol)),
held AS (SELECT symbol, arg_min(concept, concept || role) AS hc, arg_min(role, concept || role) AS hr FROM policy_accepted GROUP BY symbol), can AS (SELECT concept AS cc, min(symbol) AS present FROM policy_accepted WHERE role = 'canonical' GROUP BY concept),
j AS (SELECT q.*, hc, hr, present, hc IS NOT NULL AND hc IS DISTINCT FROM meant AS away, coalesce(q.symbol, '') = '' AS bare, min(q.ix) OVER (PARTITION BY q.role, q.symbol, meant) AS one FROM q LEFT JOIN held ON held.symbol = q.symbol LEFT JOIN can ON cc = meant),
f AS (SELECT meant AS fm, arg_min(symbol, ix) AS fs FROM j WHERE role = 'canonical' AND NOT bare AND n IS NOT NULL AND NOT away GROUP BY meant),
said AS MATERIALIZED (SELECT ix, role, symbol, meant AS concept, boundary, CASE WHEN bare THEN 'empty' WHEN n IS NULL THEN 'unknown symbol' WHEN ix > one THEN 'duplicate' WHEN away THEN 'in another concept'
  WHEN role = 'canonical' THEN CASE WHEN symbol <> fs THEN 'conflict' WHEN present IS NULL THEN 'added' WHEN present = symbol THEN 'confirmed' WHEN force THEN 'replaced' ELSE 'canonical already set' END
  WHEN coalesce(present, fs) IS NULL THEN 'unknown concept' WHEN coalesce(present, fs) = symbol OR (hr = 'canonical' AND hc IS NOT NULL) THEN 'already canonical' WHEN hc IS NOT NULL THEN 'refreshed' ELSE 'added' END AS outcome
  FROM j LEFT JOIN f ON fm = meant)"""
ORACLES["proposal_outcomes"] = f"{PROPOSED}\nSELECT * FROM said"
ORACLES["accepted_concepts"] = f"""{PROPOSED}, done AS (SELECT * FROM said WHERE outcome IN ('added', 'replaced', 'confirmed', 'refreshed')),
kept AS (SELECT DISTINCT * FROM policy_accepted a WHERE NOT (role = 'canonical' AND concept IN (SELECT concept FROM done WHERE outcome = 'replaced')))
SELECT coalesce(k.concept, d.concept) AS concept, coalesce(k.role, d.role) AS role, coalesce(k.symbol, d.symbol) AS symbol, coalesce(d.boundary, k.boundary) AS boundary, CASE WHEN d.outcome IS NOT NULL THEN 'Accepted' ELSE k.source END AS source
FROM kept k FULL JOIN done d ON d.concept = k.concept AND d.role = k.role AND d.symbol = k.symbol"""
ORACLES["explained_rules"] = rf"""{ctes('rule_doc')}, l AS (SELECT path, i, regexp_replace(ls[i], chr(13) || '$', '') AS line FROM (SELECT path, string_split(text, chr(10)) AS ls FROM rule_doc), unnest(range(1, len(ls) + 1)) AS u(i)),
s AS (SELECT *, max(CASE WHEN prefix(ltrim(line), '#### ') THEN i END) OVER (PARTITION BY path ORDER BY i) AS a0 FROM l),
g AS (SELECT path, a0, string_agg(line, chr(10) ORDER BY i) AS text FROM s WHERE a0 IS NOT NULL GROUP BY path, a0), h AS (SELECT *, regexp_extract(text, '^\s*#### (\S+) ', 1) AS name FROM g)
SELECT path, name, regexp_replace(arg_min(text, a0), '^\s+|\s+$', '', 'g') AS text FROM h WHERE name <> '' GROUP BY path, name"""
ORACLES["debt_inventory"] = f"{ctes('air_hint', 'policy_exception')}\nSELECT * FROM {DEBT}"
ORACLES["debt_by_rule"] = f"{ctes('air_hint', 'policy_exception')}\nSELECT rule, count(*) AS total, {', '.join(f'count(*) FILTER (WHERE status = {q(t)}) AS {q(t)[1:-1]}' for t in ('Expired', 'LegacyNoMetadata', 'Unbounded', 'Active'))} FROM {DEBT} GROUP BY rule"
ORACLES["pruned_counts"] = f"{ctes('policy_exception')}\nSELECT count(*) FILTER (WHERE expires >= '1998-06-01') AS kept, count(*) FILTER (WHERE expires < '1998-06-01') AS removed FROM policy_exception"
ORACLES["pruned_exceptions"] = f"{ctes('policy_exception')}\nSELECT rule, target, expires FROM policy_exception WHERE expires >= '1998-06-01'"
ORACLES["largest_files"] = f"{ctes('air_file')}\nSELECT path, line_count FROM air_file ORDER BY line_count DESC, path LIMIT 5"
ORACLES["largest_clusters"] = f"{ctes(*CLUSTER_TABLES)}{CONF}\nSELECT stem, count(*) AS members, count(DISTINCT name) AS names, round(max(confidence), 4) AS confidence FROM member JOIN graded USING (stem) GROUP BY stem ORDER BY members DESC, stem LIMIT 5"
ORACLES["internal_edges"] = f"{ctes('air_import', 'air_file')}{EDGES}\nSELECT src, dst FROM e WHERE src IN (SELECT package FROM air_file) AND dst IN (SELECT package FROM air_file)"
ORACLES["rule_pressure"] = f"{KEPT}, {PAIR}\nSELECT left(rule_id, 2) AS family, rule_id, count(*) AS n FROM (SELECT rule_id FROM kept UNION ALL SELECT code FROM drift) GROUP BY rule_id"
OPEN = f", open AS (SELECT *, {KEBAB} AS cid FROM member WHERE {KEBAB} NOT IN (SELECT lower(regexp_replace(concept, '(.)([A-Z])', '\\1-\\2', 'g')) FROM policy_concept))"
NEAR = f"({SUFFIX} IS NOT NULL OR regexp_matches(symbol, '(^|::)(api|dto|dtos|transport)(::|$)') OR overlap >= 0.5)"
ORACLES["suggested_concepts"] = f"""{ctes(*CLUSTER_TABLES)}{CONF}{OPEN}{SCORED.format(members='open')}, chosen AS (
  SELECT stem, any_value(cid) AS cid, count(*) AS n, (SELECT arg_min(symbol, row(pkg_ix, file_ix, item_ix)) FROM open p WHERE p.stem = o.stem AND role = 'Canonical') AS h FROM open o GROUP BY stem
), named AS (SELECT c.*, coalesce(h, el.symbol) AS canonical FROM chosen c LEFT JOIN elected el ON el.stem = c.stem)
SELECT cid AS concept, canonical, n AS members, bs AS boundaries, CASE WHEN s >= 0.95 THEN 'High' ELSE 'Medium' END AS tier FROM (
  SELECT k.*, (SELECT count(*) FROM open p WHERE p.stem = k.stem AND CASE WHEN k.h IS NOT NULL THEN role = 'Boundary' ELSE symbol <> k.canonical AND {NEAR} END) AS bs,
    round(confidence - CASE WHEN h IS NULL THEN 0.1 ELSE 0 END, 6) AS s FROM named k JOIN graded USING (stem)) WHERE canonical IS NOT NULL AND bs > 0 AND s >= 0.7"""
ORACLES["policy_bootstrap"] = f"""{ctes(*CLUSTER_TABLES)}{CLUSTERS}, m AS (SELECT *, {KEBAB} AS concept FROM member),
canon AS (SELECT concept, stem, arg_min(symbol, row(pkg_ix, file_ix, item_ix)) AS symbol FROM m WHERE role = 'Canonical' GROUP BY concept, stem),
bound AS (SELECT concept, symbol FROM m WHERE role = 'Boundary' AND stem IN (SELECT stem FROM canon)),
ends AS (SELECT concept, symbol AS e FROM canon UNION SELECT concept, list_extract(string_split(symbol, '::'), -1) FROM canon UNION SELECT concept, symbol FROM bound UNION SELECT concept, list_extract(string_split(symbol, '::'), -1) FROM bound)
SELECT concept, 'canonical' AS role, symbol, NULL AS from_type, NULL AS to_type FROM canon UNION ALL SELECT concept, 'boundary', symbol, NULL, NULL FROM bound
UNION ALL SELECT a.concept, 'converter', c.symbol, c.from_type, c.to_type FROM air_conversion c JOIN ends a ON a.e = c.from_type JOIN ends b ON b.e = c.to_type AND a.concept = b.concept
UNION ALL SELECT concept, 'canonical', arg_min(symbol, row(pkg_ix, file_ix, item_ix)), NULL, NULL FROM (
  SELECT *, {KEBAB} AS concept FROM (SELECT t.*, left(name, length(name) - length(coalesce({SUFFIX}, ''))) AS stem FROM air_type t)) z
  WHERE EXISTS (SELECT 1 FROM air_hint h WHERE h.path = z.path AND h.category = 'canonical' AND h.target_start BETWEEN z.line_start AND z.line_end) AND symbol NOT IN (SELECT symbol FROM canon) AND concept NOT IN (SELECT concept FROM canon) GROUP BY concept"""
ORACLES["cross_family_suggestions"] = f"""{ctes('air_file')}
SELECT f AS family, "glob" AS value FROM {LAYER_ROWS} x, (VALUES ('BO'), ('ER'), ('FL'), ('RM')) AS v(f) WHERE layer = 'domain'
UNION ALL SELECT f, package FROM (SELECT DISTINCT package FROM air_file), (VALUES ('DG'), ('FO')) AS v(f)"""
ORACLES["vacancy_seeds"] = f"""{ctes('air_file')}
SELECT f AS family FROM (VALUES ('AB', ''), ('BO', 'domain'), ('CR', 'composition'), ('DA', ''), ('DG', ''), ('ER', ''), ('FL', ''), ('FO', ''), ('OB', ''), ('PA', ''), ('RM', ''), ('RW', ''), ('UT', 'utilities')) AS v(f, l)
WHERE l NOT IN (SELECT layer FROM {LAYER_ROWS} x)"""
ORACLES["suggested_api"] = f"{ctes('air_import')}\nSELECT {to} AS \"to\", count(*) AS reaches FROM air_import WHERE {to} = 'two' AND {of} <> {to} GROUP BY {to} HAVING count(*) >= 3"
ORACLES["suggested_thresholds"] = f"""{ctes('air_function', 'air_type', 'air_truth_action')}
SELECT * FROM (
  SELECT 'CX' AS family, CAST(quantile_disc(line_count, 0.95) AS BIGINT) AS value, CAST(50 AS BIGINT) AS "default" FROM air_function
  UNION ALL SELECT 'MO', quantile_disc(n, 0.95), 5 FROM (SELECT count(*) AS n FROM air_type WHERE visibility = 'Public' GROUP BY path)
  UNION ALL SELECT 'CR', quantile_disc(n, 0.95), 12 FROM (SELECT count(*) AS n FROM air_truth_action WHERE action = 'Construct' GROUP BY function)
  UNION ALL SELECT 'RM', quantile_disc(n, 0.95), 3 FROM (SELECT count(DISTINCT action) AS n FROM air_truth_action GROUP BY function)
) WHERE value > "default" * CASE WHEN family = 'RM' THEN 1.0 ELSE 1.5 END"""
ORACLES["suggested_layers"] = f"{ctes('air_file')}\nSELECT CASE layer WHEN 'composition' THEN 'CR' WHEN 'config' THEN 'CF' WHEN 'tests' THEN 'TA' WHEN 'utilities' THEN 'UT' ELSE 'BO' END AS family, \"glob\" FROM {LAYER_ROWS} x WHERE layer IN ('composition', 'config', 'tests', 'utilities', 'domain')"
ORACLES["merged_suggestions"] = f"""{ctes('air_file')}
SELECT arg_min("glob", layer || ' ' || "glob") AS headline, array_to_string(list_distinct_sorted, ',') AS families, array_to_string(list_transform(list_distinct_sorted, lambda l: 'a ' || l || ' layer'), ',') AS why, commands
FROM (SELECT *, 'add ' || split_part("glob", '::', 1) || '::' || split_part("glob", '::', 2) AS commands FROM {LAYER_ROWS} x)
JOIN (SELECT 'add ' || split_part("glob", '::', 1) || '::' || split_part("glob", '::', 2) AS c, list_sort(list(DISTINCT layer)) AS list_distinct_sorted FROM {LAYER_ROWS} y GROUP BY 1) ON c = commands GROUP BY commands, list_distinct_sorted"""
ORACLES["report_text"] = f"{KEPT}\nSELECT concat_ws(' ', rpad(upper(severity), 8, ' '), rule_id, concat_ws(':', path, line_start), subject, '(' || detail || ')') AS line FROM kept"
MEMBER = lambda name: f"CASE WHEN {name} IS NULL THEN '' ELSE ',\"{name}\":' || to_json({name}) END"
ORACLES["report_json"] = f"""{KEPT}
SELECT '{{"rule_id":' || to_json(rule_id) || ',"severity":' || to_json(severity) || ',"span":{{"file":' || to_json(path) || ',"line_start":' || line_start || ',"line_end":' || line_end || '}}' || {MEMBER('subject')} || {MEMBER('detail')} || '}}' AS json FROM kept"""
ORACLES["report_totals"] = f"{KEPT}\nSELECT severity, count(*) AS n FROM kept GROUP BY severity"
ORACLES["report_summary"] = f"""{KEPT}, c AS (SELECT count(*) FILTER (WHERE severity = 'Fatal') AS fatal, count(*) FILTER (WHERE severity = 'Warning') AS warning, count(*) FILTER (WHERE severity = 'Advisory') AS advisory FROM kept)
SELECT *, fatal || ' fatal, ' || warning || ' warning, ' || advisory || ' advisory' AS line FROM c"""
ORACLES["report_sarif_rules"] = f"{KEPT}\nSELECT rule_id, arg_min(subject, row(path, line_start, subject)) AS sample FROM kept GROUP BY rule_id"
ORACLES["report_sarif_results"] = f"{KEPT}\nSELECT rule_id, CASE severity WHEN 'Fatal' THEN 'error' WHEN 'Warning' THEN 'warning' ELSE 'note' END AS level, path AS uri, greatest(line_start, 1) AS start_line, greatest(line_end, line_start, 1) AS end_line, subject FROM kept"
ITEMS = "(SELECT path, item_ix, symbol, line_start, line_end FROM air_type UNION ALL SELECT path, item_ix, symbol, line_start, line_end FROM air_function)"
for kind in ("canonical", "boundary", "converter"):
    more = " UNION SELECT symbol, path, CAST(line_start AS INT) FROM air_conversion" if kind == "converter" else ""
    ORACLES[f"query_{kind}"] = f"{ctes('air_hint', 'air_type', 'air_function', 'air_conversion')}\nSELECT DISTINCT coalesce(target_symbol, module_path, path) AS symbol, path, CAST(target_start AS INT) AS line FROM {TARGET.format(ITEMS)} x WHERE category = {q(kind)}{more}"
for kind in ("SpawnedWork", "ConfigRead", "Logging", "ExternalIo", "PersistenceWrite", "BlockingCall", "HotPath", "RequestContext", "BoundaryEntry", "RuntimeStateOwner", "BackgroundWorker"):
    ORACLES[f"query_{kind.lower()}"] = f"{loaded()}\nSELECT a.symbol, coalesce(f.path, '') AS path, CAST(coalesce(f.line_start, 1) AS INT) AS line FROM air_fact a LEFT JOIN {FN} f ON f.fs = a.symbol WHERE kind = {q(kind)}"
