"""Fact documents: one JSON object a workspace, read into the fact tables and written back.

Order is part of many questions, so every table carries the positions of
package, file and item in the document (pkg_ix, file_ix, item_ix); several
documents are told apart by their packages' positions, which go on counting
in the order of the documents' names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girder.plans.policy import Policy

_SPAN = "struct<file:string,line_start:int,line_end:int>"
_FIELD = "struct<name:string,type_text:string,visibility:string>"
_DECORATOR = "struct<source:string,name:string,args:array<string>>"
#: All members that items of any kind have; absent ones are null.
_ITEM = f"""struct<kind:string,type_kind:string,name:string,symbol:string,visibility:string,fields:array<{_FIELD}>,variants:array<struct<name:string,fields:array<{_FIELD}>>>,
decorators:array<{_DECORATOR}>,span:{_SPAN},doc:string,params:array<array<string>>,return_type:string,line_count:int,interface:string,target_type:string,method_names:array<string>,
`from`:string,`to`:string,mechanism:string,provenance:struct<layer:string>,action:string,target:string,`function`:string,callee:string,call_kind:string,discard_kind:string,variant:string,
scrutinee:string,pattern:string,pattern_has_wildcard:boolean,body_shape:string,closure_discards_arg:boolean,default_shape:string,loop_kind:string,propagates:boolean,has_break:boolean,
value:string,context:string,path:string>"""
_HINT = f"struct<kind:struct<category:string,concept:string,boundary:string,rule:string,reason:string,expires:string,fact_kind:string>,raw:string,span:{_SPAN},target_span:{_SPAN}>"
_FILE = f"struct<path:string,module_path:string,items:array<{_ITEM}>,hints:array<{_HINT}>,parse_error:string,line_count:int>"
_FACT = "struct<kind:string,target:struct<scope:string,symbol:string,path:string,file:string,line_start:int,line_end:int>,source:string,confidence:double,evidence:string>"
WORKSPACE = f"schema_version int, packages array<struct<name:string,version:string,root_dir:string,files:array<{_FILE}>>>, facts array<{_FACT}>"


def camel(name: Column) -> Column:
    """``snake_case`` and ``kebab-case`` values as CamelCase; others as they are."""
    return F.array_join(F.transform(F.split(name, "[_-]"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000))), "")


class JsonFacts:
    """Fact tables of the JSON documents at ``path``, each a lazy view over the parsed documents."""

    def __init__(self, spark: SparkSession, path: str, policy: Policy | None = None):
        raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.from_json("value", WORKSPACE).alias("w"))
        self.spark, self.policy, self.made = spark, policy or Policy(), {}
        # positions of packages over all documents: a row a document is ranked, not the items
        sizes = raw.select("doc", F.size("w.packages").alias("n"))
        base = sizes.select("doc", (F.sum("n").over(Window.orderBy("doc")) - F.col("n")).alias("base"))
        self.docs = raw.join(base, "doc")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = getattr(self, f"_{name}")()
        return self.made[name]

    def _files(self) -> DataFrame:
        p = self.docs.select("base", F.posexplode("w.packages").alias("p_ix", "p"))
        return p.select((F.col("base") + F.col("p_ix")).cast("int").alias("pkg_ix"), F.col("p.name").alias("package"), F.posexplode("p.files").alias("file_ix", "f"))

    def _air_file(self) -> DataFrame:
        return self["files"].select("pkg_ix", "file_ix", "package", "f.path", "f.module_path", "f.line_count", "f.parse_error")

    def _items(self) -> DataFrame:
        it = self["files"].select("pkg_ix", "file_ix", F.col("f.path").alias("path"), F.col("f.module_path").alias("module_path"), F.posexplode("f.items").alias("item_ix", "i"))
        # a literal's own kind hides its tag, which it alone replaces by a context
        tag = F.when(F.col("i.context").isNotNull(), "ScrutineeLiteral").otherwise(F.col("i.kind"))
        return it.withColumns({"tag": tag, "item_ix": F.col("item_ix").cast("long"), "line_start": F.col("i.span.line_start"), "line_end": F.col("i.span.line_end")})

    def _of(self, tag: str, *cols: Column | str) -> DataFrame:
        return self["items"].where(F.col("tag") == tag).select("pkg_ix", "file_ix", "item_ix", "path", "module_path", "line_start", "line_end", *cols)

    def _air_type(self) -> DataFrame:
        return self._of("Type", "i.name", "i.symbol", F.col("i.type_kind").alias("kind"), "i.visibility", "i.doc")

    def _parts(self, column: str, of: str = "Type") -> DataFrame:
        df = self._of(of, F.col("i.name").alias("type_name"), "i.symbol", F.col("i.type_kind").alias("kind"), F.posexplode(f"i.{column}").alias("pos", "x"))
        return df

    def _air_field(self) -> DataFrame:
        return self._parts("fields").select("*", "x.name", "x.type_text").drop("x")

    def _air_variant(self) -> DataFrame:
        """A row a field of a variant; one without a type for a variant without fields."""
        return self._parts("variants").select("*", F.col("x.name").alias("name"), F.explode_outer("x.fields").alias("y")).select("*", F.col("y.type_text").alias("field_type")).drop("x", "y")

    def _air_decorator(self) -> DataFrame:
        return self._parts("decorators").select("*", camel(F.col("x.source")).alias("source"), F.col("x.name").alias("name")).drop("x")

    def _air_function(self) -> DataFrame:
        return self._of("Function", "i.name", "i.symbol", "i.visibility", "i.return_type", "i.line_count", "i.doc")

    def _air_param(self) -> DataFrame:
        p = self._of("Function", "i.symbol", F.posexplode("i.params").alias("pos", "x"))
        return p.select("*", F.try_element_at("x", F.lit(1)).alias("name"), F.try_element_at("x", F.lit(2)).alias("type_text")).drop("x")

    def _air_impl(self) -> DataFrame:
        return self._of("Impl", "i.interface", "i.target_type")

    def _air_impl_method(self) -> DataFrame:
        return self._of("Impl", "i.interface", "i.target_type", F.posexplode("i.method_names").alias("pos", "method"))

    def _air_conversion(self) -> DataFrame:
        return self._of("Conversion", F.col("i.from").alias("from_type"), F.col("i.to").alias("to_type"), "i.mechanism", "i.symbol", camel(F.coalesce("i.provenance.layer", F.lit("heuristic"))).alias("layer"))

    def _air_import(self) -> DataFrame:
        return self._of("Import", F.col("i.path").alias("import_path"), "i.visibility")

    def _air_truth_action(self) -> DataFrame:
        return self._of("TruthAction", camel(F.col("i.action")).alias("action"), "i.target", "i.function")

    def _air_call_site(self) -> DataFrame:
        return self._of("CallSite", "i.callee", camel(F.col("i.call_kind")).alias("call_kind"), "i.function")

    def _air_silent_discard(self) -> DataFrame:
        return self._of("SilentDiscard", "i.callee", camel(F.col("i.discard_kind")).alias("discard_kind"), "i.function")

    def _air_partial_match(self) -> DataFrame:
        return self._of("PartialResultMatch", camel(F.col("i.variant")).alias("variant"), "i.function")

    def _air_match_arm(self) -> DataFrame:
        return self._of("MatchArm", "i.scrutinee", "i.pattern", "i.pattern_has_wildcard", camel(F.col("i.body_shape")).alias("body_shape"), "i.function")

    def _air_closure_call(self) -> DataFrame:
        return self._of("ClosureMethodCall", "i.callee", "i.closure_discards_arg", "i.function")

    def _air_fallback(self) -> DataFrame:
        return self._of("FallbackCall", "i.callee", camel(F.col("i.default_shape")).alias("default_shape"), "i.function")

    def _air_retry_loop(self) -> DataFrame:
        return self._of("RetryLoop", "i.loop_kind", "i.propagates", "i.has_break", "i.function")

    def _air_literal(self) -> DataFrame:
        return self._of("ScrutineeLiteral", "i.value", camel(F.col("i.kind")).alias("kind"), camel(F.col("i.context")).alias("context"), "i.function")

    def _air_fact(self) -> DataFrame:
        f = self.docs.select("base", F.posexplode("w.facts").alias("item_ix", "x"))
        at = [F.col("base").cast("int").alias("pkg_ix"), F.lit(0).alias("file_ix"), F.col("item_ix").cast("long").alias("item_ix")]
        return f.select(*at, F.col("x.target.scope").alias("scope"), camel(F.col("x.kind")).alias("kind"), F.col("x.target.symbol").alias("symbol"), F.coalesce("x.target.path", "x.target.file").alias("fact_path"),
                        F.col("x.target.line_start").alias("line_start"), F.col("x.target.line_end").alias("line_end"), "x.evidence", "x.source", "x.confidence")

    def _air_hint(self) -> DataFrame:
        h = self["files"].select("pkg_ix", "file_ix", F.col("f.path").alias("path"), F.col("f.module_path").alias("module_path"), F.posexplode("f.hints").alias("item_ix", "h"))
        category = F.when(F.col("h.kind.category") == "marks-fact", "marker").otherwise(F.translate("h.kind.category", "-", "_"))
        return h.select("pkg_ix", "file_ix", F.col("item_ix").cast("long").alias("item_ix"), "path", "module_path", category.alias("category"), "h.kind.concept", "h.kind.rule", "h.kind.reason", "h.kind.expires", "h.kind.fact_kind",
                        F.col("h.span.line_start").alias("line_start"), F.col("h.span.line_end").alias("line_end"), F.col("h.target_span.line_start").alias("target_start"), F.col("h.target_span.line_end").alias("target_end"))

    def _policy_concept(self) -> DataFrame:
        """Accepted symbols of the policy with the file that defines them."""
        rows = []
        for concept, c in (self.policy.explicit("OT") or {}).get("concepts", {}).items():
            if c.get("canonical"):
                rows.append((concept, "canonical", c["canonical"]))
            rows += [(concept, "boundary", b) for b in c.get("boundaries", [])]
        named = self.spark.createDataFrame(rows, "concept string, role string, symbol string").withColumn("name", F.substring_index("symbol", "::", -1))
        first = self["air_type"].groupBy("symbol").agg(F.min(F.struct("pkg_ix", "file_ix", "item_ix", "path")).alias("f")).select("symbol", "f.path")
        return named.join(first, "symbol", "left").select("concept", "role", "symbol", "name", F.coalesce("path", F.lit("")).alias("path"))

    def _policy_converter(self) -> DataFrame:
        concepts = (self.policy.explicit("OT") or {}).get("concepts", {})
        rows = [(k, v["symbol"], v["from"], v["to"]) for k, c in concepts.items() for v in c.get("converters", [])]
        return self.spark.createDataFrame(rows, "concept string, symbol string, from_type string, to_type string")

    def _policy_exception(self) -> DataFrame:
        rows = [(e["rule"], e["target"], e.get("reason"), e.get("expires"), i) for i, e in enumerate(self.policy.exceptions)]
        return self.spark.createDataFrame(rows, "rule string, target string, reason string, expires string, ix long")


def write_facts(facts: JsonFacts, path: str) -> None:
    """The parsed documents as JSON, one a line; absent members are left out."""
    facts.docs.select(F.to_json("w", {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)
