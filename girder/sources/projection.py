"""A deterministic projection of the star-schema tables onto the fact tables.

Integer arithmetic, CASE and ``||`` only, so that the same text runs in Spark
and in DuckDB; ``{name}`` stands for a table, ``{each_n}`` for a row each of the
numbers pos = 0..n-1, in the dialect's own way. Every fact table carries the
ordinals (pkg_ix, file_ix, item_ix), since order is part of many questions.
"""

from __future__ import annotations

from collections.abc import Callable
from threading import RLock

from pyspark.sql import DataFrame, SparkSession


#: Spark's own way of the choices that ``_pick`` writes: a look-up by place. Of dozens of arms the machine code is never
#: compiled, as their method is too large, and every row costs microseconds.
LOOKUPS: dict[str, str] = {}


def _pick(key: str, values: list[str | None]) -> str:
    texts = ["NULL" if v is None else chr(39) + v + chr(39) for v in values]
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(texts))
    text = f"CASE {key} % {len(values)} {arms} END"
    LOOKUPS[text] = f"get(array({', '.join(texts)}), CAST({key} % {len(values)} AS INT))"
    return text


LAYERS = ["domain", "api", "handlers", "tests", "utils", "config", "infra", "feature_one", "feature_two"]
STEMS = ["mod", "main", "lib", "model", "store", "client", "types", "service"]

#: Kinds that markers of the projection name.
MARKERS = ["spawned_work", "config_read", "logging", "external_io", "persistence_write", "blocking_call", "hot_path", "request_context", "boundary_entry", "runtime_state_owner", "background_worker"]

#: Star tables that the projection reads.
TABLES = ("nation", "supplier", "part", "orders", "customer", "lineitem", "events", "labels")

PROJECTION: dict[str, str] = {}

PROJECTION["air_file"] = f"""
SELECT s_nationkey AS pkg_ix, CAST(s_suppkey AS INT) AS file_ix, pkg AS package, layer, stem,
       pkg || '/src/' || layer || '/f' || sk || '/' || stem || '.rs' AS path,
       CASE WHEN s_suppkey % 23 <> 5 THEN pkg || '::' || layer || '::f' || sk || '::' || stem END AS module_path,
       CAST(50 + (s_suppkey * 37) % 900 AS INT) AS line_count
FROM (SELECT s_nationkey, s_suppkey, 'p' || CAST(s_nationkey AS STRING) AS pkg, CAST(s_suppkey AS STRING) AS sk,
             {_pick('s_suppkey', LAYERS)} AS layer, {_pick('(s_suppkey + s_nationkey)', STEMS)} AS stem FROM {{supplier}}) AS s
"""

# each part is a function and a type in one supplier's file
PROJECTION["part_file"] = """
SELECT p.p_partkey AS k, p.p_size AS size, upper(substr(w1, 1, 1)) || substr(w1, 2) || upper(substr(w2, 1, 1)) || substr(w2, 2) AS word,
       p.p_name AS phrase, f.pkg_ix, f.file_ix, f.path, f.module_path, coalesce(f.module_path, f.package) AS home, CAST(1 + (CAST((p.p_partkey - p.p_partkey % 50) / 50 AS INT) % 40) * 20 AS INT) AS line
FROM (SELECT p_partkey, p_size, p_name, substr(p_name, 1, position(' ' IN p_name) - 1) AS w1, substr(p_name, position(' ' IN p_name) + 1) AS w2,
             CAST((p_partkey * 7) % (SELECT count(*) FROM {supplier}) AS INT) AS file_of
      FROM {part}) AS p
JOIN {air_file} AS f ON f.file_ix = p.file_of
"""

_DOC = """CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'See https://example.com/' || CAST(k AS STRING) || ').'
  WHEN 2 THEN 'Keeps the order of the rows so that later readers see them as written, see #' || CAST(k AS STRING)
  WHEN 3 THEN 'TODO: ' || phrase WHEN 4 THEN 'TODO(me): for now ' || phrase || ' fixme'
  WHEN 5 THEN 'Closes #' || CAST(k AS STRING) ELSE 'As discussed, the old approach to ' || phrase || ' is temporary.' END"""

PROJECTION["air_function"] = f"""
SELECT pkg_ix, file_ix, k * 8 AS item_ix, path, module_path, name, home || CASE WHEN k % 29 = 3 THEN '::infra::inline::' ELSE '::' END || name AS symbol,
       CASE WHEN k % 2 = 0 THEN 'Public' ELSE 'Private' END AS visibility,
       {_pick('k', [None, 'Result<A,String>', 'Result<A,sqlx::Error>', 'Result<Map<K,V>,E>', 'Option<A>', 'Vec<ColdAnvilRow>', 'Result<A,&str>', 'Result<(A,B),reqwest::Error>'])} AS return_type,
       size * 3 AS line_count, line AS line_start, line + size * 3 - 1 AS line_end, doc
FROM (SELECT *, CASE WHEN k % 16 = 1 THEN 'main' ELSE {_pick('size', ['validate_', 'create_', 'handle_', 'parse_', 'Pg::write_'])} || CAST(k AS STRING) END AS name,
             {_DOC} AS doc FROM {{part_file}}) AS p
"""

PROJECTION["air_param"] = f"""
SELECT f.pkg_ix, f.file_ix, f.item_ix, f.path, f.module_path, f.symbol, i.pos, 'a' || CAST(i.pos AS STRING) AS name, f.line_start, f.line_end,
       {_pick('(f.item_ix / 8 + i.pos)', ['u64', 'ColdRodDto', 'Vec<sqlx::Row>', '&ColdRod', 'String']).replace('f.item_ix / 8', 'CAST(f.item_ix / 8 AS BIGINT)')} AS type_text
FROM {{air_function}} AS f {{each_2}} WHERE i.pos <= CAST(f.item_ix / 8 AS BIGINT) % 2
"""

PROJECTION["air_type"] = f"""
SELECT pkg_ix, file_ix, k * 8 + 1 AS item_ix, path, module_path, name, home || '::' || name AS symbol, kind,
       CASE WHEN k % 3 = 0 THEN 'Private' ELSE 'Public' END AS visibility, line AS line_start, line + 9 AS line_end, doc, k
FROM (SELECT *, CASE WHEN k % 77 = 0 THEN 'Port' || CAST(k AS STRING) ELSE word || {_pick('k', ['', 'Dto', 'Model', 'Row', '', 'Error', 'Service', 'Mode', 'Singleton', 'Manager'])} END AS name,
             CASE WHEN k % 11 = 0 THEN 'Trait' WHEN size % 3 = 0 OR k % 10 IN (5, 7) THEN 'Enum' ELSE 'Struct' END AS kind, {_DOC} AS doc FROM {{part_file}}) AS p
"""

PROJECTION["air_field"] = f"""
SELECT t.pkg_ix, t.file_ix, t.item_ix, t.path, t.module_path, t.symbol, t.name AS type_name, t.kind, t.line_start, t.line_end, i.pos,
       {_pick('i.pos', ['id', 'name', 'cold_rod', 'state', 'pool', 'cold_anvil'])} AS name,
       {_pick('(i.pos + t.k)', ['u64', 'String', 'Mutex<State>', 'Option<&str>', 'sqlx::Pool', 'p1::feature_one::f7::model::Thing'])} AS type_text
FROM {{air_type}} AS t {{each_6}} WHERE t.k % (i.pos + 2) = 0 AND t.kind = 'Struct'
"""

PROJECTION["air_variant"] = f"""
SELECT t.pkg_ix, t.file_ix, t.item_ix, t.path, t.module_path, t.symbol, t.name AS type_name, t.line_start, t.line_end, i.pos,
       {_pick('(i.pos * 3 + t.k % 4)', ['NotFound', 'Io', 'Parse', 'Db', 'Timeout', 'Denied', 'Other'])} AS name,
       {_pick('(i.pos + t.k)', [None, 'sqlx::Error', 'String', 'std::io::Error'])} AS field_type
FROM {{air_type}} AS t {{each_3}} WHERE t.k % 3 >= i.pos AND t.kind = 'Enum'
"""

PROJECTION["air_decorator"] = f"""
SELECT t.pkg_ix, t.file_ix, t.item_ix, t.path, t.module_path, t.symbol, t.name AS type_name, t.line_start, t.line_end, i.pos,
       CASE WHEN (t.k + i.pos) % 9 = 0 THEN 'Attribute' ELSE 'Derive' END AS source,
       {_pick('(i.pos * 2 + t.k)', ['Debug', 'Serialize', 'Clone', 'serde::Deserialize', 'PartialEq'])} AS name
FROM {{air_type}} AS t {{each_2}} WHERE t.k % 2 >= i.pos
"""

PROJECTION["air_impl"] = """
SELECT t.pkg_ix, t.file_ix, t.k * 8 + 2 AS item_ix, t.path, t.module_path, t.line_start + 10 AS line_start, t.line_start + 19 AS line_end, t.name AS target_type,
       CASE WHEN t.k % 3 = 0 THEN NULL WHEN t.k % 11 = 4 THEN r.symbol ELSE CASE WHEN t.k % 11 = 2 AND t.k % 5 = 0 THEN r.name || '<A>' ELSE 'std::fmt::Display' END END AS interface, t.k
FROM {air_type} AS t LEFT JOIN (SELECT k, symbol, name FROM {air_type} WHERE kind = 'Trait') AS r ON r.k = t.k - t.k % 11 WHERE t.kind <> 'Trait'
UNION ALL
SELECT pkg_ix, file_ix, k * 8 + 4 AS item_ix, path, module_path, line_start + 10 AS line_start, line_start + 19 AS line_end, name || 'Impl' AS target_type, symbol AS interface, k
FROM {air_type} WHERE kind = 'Trait' AND (k % 33 = 0 OR k % 77 = 0)
"""

PROJECTION["air_impl_method"] = f"""
SELECT m.pkg_ix, m.file_ix, m.item_ix, m.path, m.module_path, m.line_start, m.line_end, m.target_type, m.interface, i.pos,
       {_pick('(m.k + i.pos)', ['new', 'to_row', 'charge', 'as_ref', 'apply_discount'])} AS method
FROM {{air_impl}} AS m {{each_2}} WHERE i.pos <= m.k % 2
"""

PROJECTION["air_conversion"] = f"""
SELECT t.pkg_ix, t.file_ix, t.k * 8 + 3 AS item_ix, t.path, t.module_path, t.line_start + 5 AS line_start, t.line_start + 8 AS line_end,
       t.symbol AS from_type, t.word || {_pick('t.k', ['', 'Model', '', 'Dto', 'Row'])} AS to_type, {_pick('t.k', ['From', 'TryFrom', 'FreeFunction'])} AS mechanism,
       t.symbol || '::from' AS symbol, CASE i.pos WHEN 0 THEN 'Heuristic' ELSE 'SemanticResolved' END AS layer
FROM (SELECT t.*, p.word FROM {{air_type}} AS t JOIN {{part_file}} AS p ON p.k = t.k) AS t {{each_2}} WHERE i.pos <= t.k % 2 AND t.k % 4 > 0
"""

# each line of an order is a place in the body of its part's function
PROJECTION["air_site"] = """
SELECT f.pkg_ix, f.file_ix, 100000000 + l.l_orderkey * 8 + l.l_linenumber AS item_ix, f.path, f.module_path, f.symbol AS function,
       f.line_start + l.l_linenumber AS line_start, f.line_start + l.l_linenumber AS line_end, l.l_orderkey + l.l_linenumber AS k, l.l_linenumber AS n,
       l.l_partkey % 8 = 5 AND l.l_orderkey % 16 <> 3 AS plain
FROM {lineitem} AS l JOIN {air_function} AS f ON f.item_ix = l.l_partkey * 8
"""

_SITE = "pkg_ix, file_ix, item_ix, path, module_path, function, line_start, line_end"
#: Callees with their call's kind: every name that a rule or the runtime classifier knows, and near misses.
_CALLS = [
    ("unwrap", "Method"), ("ok", "Method"), ("std::fs::write", "Function"), ("tokio::spawn", "Function"), ("println", "Meta"), ("metrics::counter", "Meta"),
    ("std::thread::sleep", "Function"), ("to_string", "Method"), ("tracing::event", "Meta"), ("std::env::var", "Function"), ("todo", "Meta"), ("fs::create_dir", "Function"),
    ("std::fs::create_dir_all", "Function"), ("std::fs::remove_file", "Function"), ("fs::remove_dir", "Function"), ("std::fs::remove_dir_all", "Function"), ("std::fs::copy", "Function"),
    ("fs::rename", "Function"), ("std::fs::hard_link", "Function"), ("std::fs::soft_link", "Function"), ("std::os::unix::fs::symlink", "Function"), ("std::fs::read", "Function"),
    ("fs::read_to_string", "Function"), ("std::fs::read_dir", "Function"), ("std::fs::metadata", "Function"), ("std::fs::canonicalize", "Function"), ("tokio::fs::open", "Function"),
    ("std::thread::park", "Function"), ("std::thread::park_timeout", "Function"), ("std::process::Command::new", "Function"), ("std::process::Command::output", "Function"),
    ("std::process::Command::status", "Function"), ("std::process::Command::wait", "Function"), ("std::process::Command::wait_with_output", "Function"), ("std::process::Command::spawn", "Function"),
    ("std::net::TcpStream::connect", "Function"), ("std::net::TcpListener::bind", "Function"), ("std::net::UdpSocket::bind", "Function"), ("std::env::var_os", "Function"), ("spawn", "Function"),
    ("eprintln", "Meta"), ("print", "Meta"), ("eprint", "Meta"), ("dbg", "Meta"), ("tracing::info", "Meta"), ("log::warn", "Meta"), ("error", "Meta"), ("debug", "Meta"), ("tracing::trace", "Meta"),
    ("unwrap", "Method"), ("ok", "Method"), ("expect", "Method"), ("unwrap_or_else", "Method"), ("fs::write", "Method"), ("my::println", "Meta"), ("conf::var", "Function"), ("std::fs::set_permissions", "Function"),
]
_CALLEE, _KIND = [c for c, _ in _CALLS], [k for _, k in _CALLS]

PROJECTION["air_call_site"] = f"SELECT {_SITE}, {_pick('k', _CALLEE)} AS callee, {_pick('k', _KIND)} AS call_kind FROM {{air_site}} AS s"
# some functions construct little: their plain sites construct nothing; some actions stand in functions that no file declares, some in none
PROJECTION["air_truth_action"] = f"""
SELECT {_SITE.replace('function', "CASE WHEN k % 101 = 7 THEN NULL WHEN file_ix % 9 = 4 THEN function || '::inner' ELSE function END AS function")}, CASE WHEN plain AND n % 8 IN (1, 6, 7) THEN 'Other' ELSE {_pick('n', ['Other', 'Construct', 'DiscriminatedMatch', 'StringCompare', 'Validate', 'Normalize', 'Construct', 'Construct'])} END AS action,
       {_pick('k', ['p1::domain::SmallRing', 'RedWidget', 'OrderService', 'sqlx::Pool', 'p2::infra::PgAdapter', 'BlueBolt', 'HttpClient'])} AS target FROM {{air_site}} AS s
"""
PROJECTION["air_silent_discard"] = f"""
SELECT {_SITE}, {_pick('k', ['lock', 'save', 'send', 'flush', None])} AS callee, {_pick('n', ['Call', 'MethodCall', 'Other'])} AS discard_kind FROM {{air_site}} AS s WHERE k % 3 = 0
"""
PROJECTION["air_partial_match"] = f"SELECT {_SITE}, {_pick('k', ['Ok', 'Err'])} AS variant FROM {{air_site}} AS s WHERE k % 5 = 1"
PROJECTION["air_match_arm"] = f"""
SELECT {_SITE}, 'r' AS scrutinee, {_pick('k', ['Err(_)', '_', 'Ok(v)', 'Err (_)', '_ if late', 'Err(e)', 'e @ Err(_)', '_ @ x'])} AS pattern, k % 3 < 2 AS pattern_has_wildcard,
       {_pick('n', ['Empty', 'Literal', 'Call', 'Propagate', 'Block'])} AS body_shape FROM {{air_site}} AS s WHERE k % 4 < 2
"""
PROJECTION["air_closure_call"] = f"""
SELECT {_SITE}, {_pick('k', ['map_err', 'map', 'unwrap_or_else'])} AS callee, n % 2 = 0 AS closure_discards_arg FROM {{air_site}} AS s WHERE k % 6 < 2
"""
PROJECTION["air_fallback"] = f"""
SELECT {_SITE}, {_pick('k', ['unwrap_or', 'or', 'unwrap_or_default'])} AS callee, {_pick('n', ['Literal', 'Default', 'Call', 'Path'])} AS default_shape FROM {{air_site}} AS s WHERE k % 7 < 3
"""
PROJECTION["air_retry_loop"] = f"""
SELECT {_SITE}, {_pick('k', ['loop', 'for', 'while'])} AS loop_kind, n % 2 = 1 AS propagates, k % 2 = 0 AS has_break FROM {{air_site}} AS s WHERE k % 9 = 0
"""
PROJECTION["air_literal"] = f"""
SELECT {_SITE}, {_pick('k', ['"gpt-large"', '42', '3.5', 'true', '"topic.orders"'])} AS value, {_pick('k', ['Str', 'Int', 'Float', 'Bool', 'Str'])} AS kind,
       'Scrutinee' AS context FROM {{air_site}} AS s WHERE k % 8 < 3
"""

# a line of an order ties its supplier's file to a place in its customer's nation
PROJECTION["air_import"] = """
SELECT DISTINCT f.pkg_ix, f.file_ix, 50000000 + CAST(c.c_nationkey AS BIGINT) * 16 + l.l_partkey % 9 AS item_ix, f.path, f.module_path, 1 + CAST(l.l_partkey % 9 AS INT) AS line_start,
       1 + CAST(l.l_partkey % 9 AS INT) AS line_end, CASE WHEN l.l_partkey % 9 = 4 THEN 'Public' ELSE 'Private' END AS visibility,
       'p' || CAST(c.c_nationkey AS STRING) || '::' || g.layer || CASE WHEN l.l_partkey % 9 = 2 THEN '::sqlx::Pool' ELSE '::api' END AS import_path
FROM {lineitem} AS l JOIN {orders} AS o ON o.o_orderkey = l.l_orderkey JOIN {customer} AS c ON c.c_custkey = o.o_custkey
JOIN {air_file} AS f ON f.file_ix = l.l_suppkey JOIN {nation} AS a ON a.n_nationkey = f.pkg_ix JOIN {nation} AS b ON b.n_nationkey = c.c_nationkey
JOIN (SELECT DISTINCT file_ix % 9 AS j, layer FROM {air_file}) AS g ON g.j = l.l_partkey % 9
WHERE (a.n_regionkey = b.n_regionkey AND a.n_regionkey < 4) OR a.n_regionkey < b.n_regionkey
"""

# some functions never log: what they do there is read settings
PROJECTION["air_fact"] = f"""
SELECT f.pkg_ix, f.file_ix, e.event_id AS item_ix, CASE WHEN e.event_id % 17 = 0 THEN 'Span' ELSE 'Function' END AS scope,
       CASE e.event_type WHEN 'click' THEN 'SpawnedWork' WHEN 'view' THEN CASE WHEN e.user_id % 8 = 5 THEN 'ConfigRead' ELSE 'Logging' END WHEN 'purchase' THEN 'PersistenceWrite' WHEN 'signup' THEN 'BoundaryEntry'
         ELSE {_pick('e.event_id', ['BlockingCall', 'ExternalIo', 'ConfigRead', 'HotPath'])} END AS kind,
       f.symbol AS symbol, f.path AS fact_path, f.line_start, f.line_end, {_pick('e.event_id', ['println', 'tracing::info', 'dbg'])} AS evidence, 'std-runtime' AS source, CAST(0.9 AS DOUBLE) AS confidence
FROM {{events}} AS e JOIN {{air_function}} AS f ON f.item_ix = e.user_id * 8
"""

PROJECTION["air_hint"] = f"""
SELECT t.pkg_ix, t.file_ix, t.item_ix, t.path, t.module_path, {_pick('(t.k % 6 + t.k % 35)', ['canonical', 'boundary', 'allow', 'converter', 'protocol_translation', 'marker'])} AS category,
       'concept-' || CAST(t.k % 5 AS STRING) AS concept, {_pick('t.k', ['CX001', 'FL', 'OT004', '*', 'dg003', 'RW001'])} AS rule, 'kept' AS reason,
       {_pick('t.k', ['1998-06-01', '1998-05-31', None, '1999-01-01', '1997-01-01'])} AS expires, {_pick('t.k', [*MARKERS, 'metric_emission'])} AS fact_kind,
       t.line_start - 1 AS line_start, t.line_start - 1 AS line_end, t.line_start + CAST(t.k % 3 AS INT) * 4 AS target_start, t.line_start + CAST(t.k % 3 AS INT) * 4 AS target_end
FROM {{air_type}} AS t WHERE t.k % 7 < 4
"""

# each part is a small source text as well: annotations of every form, raw strings that open, close and do both, odd line ends
_LINES = {
    "k": ['// girder: allow CX001 reason="kept"', '  // girder: allow FL expires="1999-01-01" reason=""', "// girder: ot canonical", "\t// girder: ot boundary billing Dto", "// girder: ot converter",
          '// girder: ot protocol-translation reason="two wires"', "// girder: ot generated-boundary", "// girder: fact HotPath", "// girder: fact background-worker", "// girder: ot", "// girder: odd words", "// girder:", "//girder: allow X"],
    "(k + size)": ["", "#[derive(Debug)]", "// note", "#![allow(dead_code)]", 'let s = r#"', 'let s = r#"one line"#;', "   ", 'end"#; let t = r#"'],
    "(k * 3 + size)": ['// girder: allow "#', "fn f();", 'inside "# end', '"#; r#"', "// girder: ot boundary", "struct S;"],
    "(k + 2)": ['// girder: fact request_context', '"#', "// girder: allow * reason=\"late", "fn g();"],
}
PROJECTION["air_source"] = f"""
SELECT path || '#' || CAST(k AS STRING) AS path, 'use a::b;' || nl || {" || nl || ".join(_pick(key, rows) for key, rows in _LINES.items())} || CASE WHEN k % 5 = 0 THEN chr(13) ELSE '' END || nl || 'struct ' || word || ';' || nl || '// girder: allow RW001' AS text
FROM (SELECT *, chr(10) AS nl FROM {{part_file}}) AS p
"""

# the accepted concepts of the policy: for each word the first plain struct or enum and the first Dto and Row
PROJECTION["policy_concept"] = """
SELECT concept, role, symbol, name, path FROM (
  SELECT t.*, p.word AS concept, CASE WHEN t.name = p.word THEN 'canonical' ELSE 'boundary' END AS role,
         row_number() OVER (PARTITION BY p.word, t.name ORDER BY t.pkg_ix, t.file_ix, t.item_ix) AS rn
  FROM {air_type} AS t JOIN {part_file} AS p ON p.k = t.k WHERE t.kind <> 'Trait' AND p.word < 'P' AND t.name IN (p.word, p.word || 'Dto', p.word || 'Row')) AS x WHERE rn = 1
"""
PROJECTION["policy_converter"] = """
SELECT DISTINCT p.word AS concept, c.symbol, c.from_type, c.to_type FROM {air_conversion} AS c JOIN {part_file} AS p ON c.item_ix = p.k * 8 + 3 WHERE p.k % 5 = 1 AND p.word < 'P'
"""
PROJECTION["policy_exception"] = f"""
SELECT {_pick('o.o_orderkey', ['CX001', 'FL', 'DG003', '*', 'RW001'])} AS rule, f.path || CASE WHEN o.o_orderkey % 2 = 0 THEN ':' || CAST(f.line_start AS STRING) ELSE '' END AS target,
       'accepted' AS reason, {_pick('o.o_orderkey', ['1998-06-01', '1998-05-31', '1999-01-01'])} AS expires, o.o_orderkey AS ix
FROM {{orders}} AS o JOIN {{air_function}} AS f ON f.item_ix = o.o_orderkey * 8
"""

# two policy documents as entries: overrides of the parts' modules, paths of the files, numbers and acknowledged families of the nations
_META = f"{_pick('k', ['why', None, 'r', 'because'])} AS reason, {_pick('k', ['1999-01-01', 'never', None])} AS expires, {_pick('k', ['team', None, 'crew', 'team', 'x'])} AS owner"
_BUDGET, _NO = "CAST(40 + k % 60 AS BIGINT)", "CAST(NULL AS BIGINT)"
PROJECTION["policy_entry"] = f"""
SELECT d.doc, e.* FROM (
  SELECT k, {_pick('k', ['CX', 'CX', 'MO'])} AS family, {_pick('k', ['fn_overrides', 'module_overrides', 'overrides'])} AS key, home || '::' || CAST(k AS STRING) AS name, {_BUDGET} AS value, {_META}, k AS ix FROM {{part_file}}
  UNION ALL SELECT CAST(file_ix AS BIGINT) AS k, {_pick('file_ix', ['CX', 'DC', 'OT', 'BO', 'FL'])} AS family, {_pick('file_ix', ['exempt_paths', 'exempt_paths', 'converter_paths', 'domain_paths', 'retry_policy_owner_paths'])} AS key,
    package || '::' || layer || '::' || CAST(file_ix AS STRING) AS name, {_NO} AS value, {_META.replace('k %', 'file_ix %')}, 10000000 + CAST(file_ix AS BIGINT) AS ix FROM {{air_file}}
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey < 4 THEN 'CX' ELSE 'MO' END AS family, {_pick('n_nationkey', ['fn_lines', 'module_lines', 'max_public_items', 'max_fan_out', 'max_public_types', 'entropy_threshold'])} AS key,
    CAST(NULL AS STRING) AS name, CAST(3 + n_nationkey * 17 AS BIGINT) AS value, CAST(NULL AS STRING) AS reason, CAST(NULL AS STRING) AS expires, CAST(NULL AS STRING) AS owner, 20000000 + CAST(n_nationkey AS BIGINT) AS ix FROM {{nation}} WHERE n_nationkey < 6
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) AS k, '' AS family, 'acknowledged' AS key, {_pick('n_nationkey', ['CF', 'TA', 'RW', 'UT', 'DA', 'RM', 'FL'])} AS name, {_NO} AS value, {_META.replace('k %', 'n_nationkey %')}, 30000000 + CAST(n_nationkey AS BIGINT) AS ix FROM {{nation}} WHERE n_nationkey < 7
) AS e JOIN (SELECT DISTINCT CASE WHEN n_regionkey = 0 THEN 'baseline' ELSE 'current' END AS doc FROM {{nation}}) AS d
  ON (d.doc = 'baseline' AND e.k % 4 < 3) OR (d.doc = 'current' AND e.k % 5 < 4)
"""
# the present document's budgets differ from the baseline's, some up, some down
PROJECTION["policy_entries"] = """
SELECT doc, family, key, name, CASE WHEN doc = 'current' AND value IS NOT NULL THEN value + (k % 7) * 10 - 20 ELSE value END AS value, reason, expires, owner, ix FROM {policy_entry}
"""

# patterns of every form over the files' module paths, some of them no patterns at all
PROJECTION["policy_pattern"] = f"""
SELECT (file_ix * 37) % 10007 AS ix, CASE file_ix % 8 WHEN 0 THEN package || '::' || layer || '::*' WHEN 1 THEN '*::f' || CAST(file_ix AS STRING) || '::' || stem WHEN 2 THEN '*::f' || CAST(file_ix AS STRING) || '::*'
  WHEN 3 THEN module_path WHEN 4 THEN '*::' || layer || '::f' || CAST(file_ix AS STRING) || '::*' WHEN 5 THEN package WHEN 6 THEN {_pick('file_ix', ['*::', '::*', '*::*', 'p1::*::f3'])} ELSE '*::' || layer END AS pattern
FROM {{air_file}} WHERE file_ix % 3 > 0
"""

# proposals for the concept table: sound ones, strangers, empties, repeats and rivals
PROJECTION["policy_proposal"] = f"""
SELECT t.k * 4 + i.pos AS ix, CASE WHEN (t.k + i.pos) % 3 = 0 THEN 'canonical' ELSE 'boundary' END AS role,
       CASE t.k % 11 WHEN 1 THEN '' WHEN 2 THEN t.symbol || '::gone' WHEN 3 THEN NULL ELSE t.symbol END AS symbol,
       CASE WHEN t.k % 5 = 0 THEN NULL WHEN t.k % 7 = 1 THEN 'nowhere' ELSE p.word END AS concept, {_pick('t.k', ['api.v1', None, 'wire'])} AS boundary, t.k % 4 = 1 AS force
FROM {{air_type}} AS t JOIN {{part_file}} AS p ON p.k = t.k {{each_2}} WHERE t.k % 6 < 3 AND i.pos <= t.k % 2
"""
PROJECTION["policy_accepted"] = """
SELECT concept, role, symbol, CAST(NULL AS STRING) AS boundary, 'Hinted' AS source FROM {policy_concept}
"""

# each part has a small document with headed sections, some of them twice or without a name
_HEAD = _pick("k", ["OT004 — Name", "DG001 - Next", "CX001", "FL002 x"])
PROJECTION["rule_doc"] = f"""
SELECT path || '#' || CAST(k AS STRING) AS path, '# Rules' || nl || {_pick('k', ['', '#### ', 'text'])} || nl || '#### ' || {_HEAD} || nl || '' || nl || phrase || nl || nl || '  #### ' || {_pick('size', ['OT004 again', 'ER001 — Types', ' MO001 spaced'])}
       || nl || 'line of ' || word || CASE WHEN k % 3 = 0 THEN chr(13) ELSE '' END || nl || {_pick('k', ['##### deeper', '### upper', ''])} || nl AS text
FROM (SELECT *, chr(10) AS nl FROM {{part_file}}) AS p
"""

# each part's package document: a conversion that someone wrote, one of the compiler's own, and items of other kinds
_WRITTEN = _pick("k", ["core::convert::From", "From", "std::convert::TryFrom", "mycrate::From", "core::fmt::Display"])
PROJECTION["compiler_doc"] = f"""
SELECT 'q' || CAST(k AS STRING) AS package, CASE WHEN k % 13 = 0 THEN 'no json' WHEN k % 17 = 0 THEN NULL ELSE
  '{{{{"index":{{{{"1":{{{{"span":{{{{"filename":"' || path || '","begin":[' || CAST(line AS STRING) || ',1],"end":[' || CAST(line + 3 AS STRING) || ',2]}}}},"inner":{{{{"impl":{{{{"is_synthetic":' || CASE WHEN k % 6 = 5 THEN 'true' ELSE 'false' END
  || ',"blanket_impl":' || CASE WHEN k % 7 = 6 THEN '{{{{"generic":"T"}}}}' ELSE 'null' END || ',"trait":{{{{"path":"' || {_WRITTEN} || '","id":9,"args":{{{{"angle_bracketed":{{{{"args":[' || CASE WHEN k % 11 = 3 THEN '' ELSE
  CASE WHEN k % 4 = 0 THEN '{{{{"lifetime":"a"}}}},' ELSE '' END || '{{{{"type":' || CASE WHEN k % 3 = 0 THEN '{{{{"primitive":"u64"}}}}' ELSE '{{{{"resolved_path":{{{{"path":"Old","id":2}}}}}}}}' END || '}}}}' END
  || ']}}}}}}}}}}}},"for":{{{{"resolved_path":{{{{"path":"' || word || '","id":3}}}}}}}}}}}}}}}}}}}},"7":{{{{"span":null,"inner":{{{{"struct":{{{{"kind":"unit"}}}}}}}}}}}}}}}},"paths":{{{{"2":{{{{"path":["' || CAST(k AS STRING) || '","old","' || word || '"]}}}}'
  || CASE WHEN k % 2 = 0 THEN ',"3":{{{{"path":["' || package_of || '","' || word || '"]}}}}' ELSE '' END || '}}}}}}}}' END AS json
FROM (SELECT *, 'p' || CAST(pkg_ix AS STRING) AS package_of FROM {{part_file}}) AS p
"""


def dependencies(name: str) -> list[str]:
    """Projected tables that ``name`` needs, in order, itself last."""
    import string

    out: list[str] = []
    for _, ref, _, _ in string.Formatter().parse(PROJECTION[name]):
        if ref in PROJECTION:
            out += [x for x in dependencies(ref) if x not in out]
    return [*out, name]


EACH = {f"each_{n}": n for n in (2, 3, 6)}


def fields(text: str) -> set[str]:
    import string

    return {r for _, r, _, _ in string.Formatter().parse(text) if r}


#: Projected tables that joins make; those without are a pass over one of these.
JOINED = ("part_file", "air_impl", "air_conversion", "air_site", "air_import", "policy_concept", "policy_converter")


class StarFacts:
    """Fact tables over a folder of star-schema Parquet, each made once when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, store: Callable[[DataFrame, str], DataFrame] | None = None):
        self.spark, self.dir, self.store, self.made, self.lock = spark, sf_dir, store, {}, RLock()

    def storing(self, store: Callable[[DataFrame, str], DataFrame]) -> StarFacts:
        """The same, with the ``JOINED`` tables written when asked for, so that all that reads them joins once."""
        return StarFacts(self.spark, self.dir, store)

    def __getitem__(self, name: str) -> DataFrame:
        with self.lock:  # asked for side by side
            if name not in self.made:
                if name in TABLES:
                    self.made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
                else:
                    text = PROJECTION[name]
                    for choice, lookup in LOOKUPS.items():
                        text = text.replace(choice, lookup)
                    for k, n in EACH.items():
                        text = text.replace("{" + k + "}", f"LATERAL VIEW explode(sequence(0, {n - 1})) i AS pos")
                    df = self.spark.sql(text, **{r: self[r] for r in fields(text)})
                    self.made[name] = self.store(df, name) if self.store and name in JOINED else df
            return self.made[name]


def ctes(*names: str) -> str:
    """The same tables as a WITH list of SQL over views named like the star tables."""
    order: list[str] = []
    for n in names:
        order += [x for x in dependencies(n) if x not in order]
    known = {t: t for t in TABLES} | {x: x for x in PROJECTION} | {k: f", (SELECT unnest(range(0, {n})) AS pos) AS i" for k, n in EACH.items()}
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PROJECTION[n].strip().format(**known)})" for n in order)
