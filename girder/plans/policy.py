"""Policy documents: a JSON object of sections by family, with defaults, exceptions and acknowledged-empty families."""

from __future__ import annotations

import json
from copy import deepcopy
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# fixed values: defaults of the sections
DEFAULTS: dict[str, dict] = {
    "CX": {"fn_lines": 50, "fn_overrides": [], "module_lines": 400, "module_overrides": [], "max_public_items": 30, "exempt_paths": ["*::tests::*", "*::test::*"], "orchestration_paths": [], "max_fan_out": 25},
    "DG": {"edges": [], "features": [], "shared_paths": []},
    "OT": {"converter_paths": []},
    "FL": {
        "domain_paths": [], "boundary_error_patterns": [], "invariant_owner_paths": [], "retry_policy_owner_paths": [],
        "forbidden_callees": ["unwrap", "expect", "unwrap_or_default", "panic", "todo", "unimplemented"],
        "silent_discard_callees": ["ok", "err", "unwrap_or_else"],
        "silent_discard_allowed": ["lock", "send", "drop", "set_logger", "subscribe", "try_init"],
    },
    "MO": {
        "max_public_types": 5, "overrides": [], "entropy_threshold": 3, "handler_names": ["*_handler", "handle_*"],
        "persistence_imports": ["*::sqlx::*", "*::diesel::*", "*::sea_orm::*"],
        "io_callees": ["*::fs::*", "*::net::*", "*::TcpStream::*", "*::TcpListener::*", "*::UdpSocket::*"],
        "thin_fn_lines": 25, "entrypoint_fns": ["main", "run", "init", "bootstrap", "start"], "host_impl_lines": 120, "lib_decl_budget": 5, "host_trait": "Paradigm", "lib_kinds": [],
    },
    "AB": {"accepted_traits": [], "accepted_names": [], "suspect_names": ["*Manager", "*Service", "*Processor", "*Coordinator", "*Orchestrator", "*Engine", "*Handler", "*Helper", "*Util"]},
    "CL": {"enabled": False, "exempt_paths": [], "least_words": 5},
    "BO": {"domain_paths": [], "forbidden_in_domain": [], "persistence_types": [], "canonical_paths": [], "forbidden_derives": ["Serialize", "Deserialize", "Schema", "ToSchema"]},
    "CR": {"root_paths": [], "service_suffixes": ["Service", "Client", "Repository", "Adapter", "Connection", "Pool", "Manager"], "wiring_density": 12},
    "DC": {
        "require_public_docs": False, "exempt_paths": [], "markers": ["TODO", "FIXME", "HACK", "XXX"],
        "phrases": [
            ["as discussed", 0.90, ["as we discussed", "as we've discussed", "as i discussed", "as we mentioned", "as i mentioned", "we discussed", "we've discussed", "we agreed", "as we agreed"]],
            ["the prompt", 0.95, ["per the prompt", "in the prompt", "from the prompt", "the original prompt", "your prompt"]],
            ["previously", 0.85, ["previously discussed", "previously mentioned", "as previously"]],
            ["mentioned earlier", 0.85, ["mentioned above", "noted earlier", "noted above", "discussed earlier", "discussed above", "as mentioned", "as noted"]],
            ["edge case above", 0.80, ["edge case mentioned", "edge case noted earlier"]],
            ["the user wanted", 0.85, ["the user requested", "you wanted", "you requested", "you asked for", "as the user said"]],
            ["this should fix", 0.80, ["this should resolve", "this should address", "this should handle", "this fixes"]],
            ["because of the issue", 0.75, ["due to the issue", "to handle the issue", "to fix the issue", "to address the issue", "because of this issue"]],
            ["new approach", 0.70, ["my new approach", "the new approach", "the new way", "this new approach"]],
            ["old approach", 0.75, ["the old approach", "the old way", "the previous approach", "old code", "legacy approach"]],
            ["from the previous version", 0.85, ["from the prior version", "from before", "from the earlier version", "before the refactor"]],
            ["for now", 0.75, ["for the time being", "for the moment", "until later", "as a stopgap"]],
            ["later", 0.65, ["in a later iteration", "in a later pass"]],
            ["temporary", 0.75, ["temp solution", "stopgap", "placeholder"]],
            ["clean this up", 0.75, ["clean up later", "cleanup needed", "needs cleanup", "needs a cleanup", "should be cleaned up"]],
            ["TODO", 0.70, []], ["FIXME", 0.80, []], ["HACK", 0.85, []], ["XXX", 0.80, []],
            ["let me know", 0.85, ["tell me if", "let me know if", "if you want"]],
            ["i think", 0.65, ["i believe", "i suspect", "in my opinion", "imho"]],
        ],
    },
    "ER": {"domain_paths": [], "string_error_patterns": [], "boundary_error_patterns": [], "collapse_owner_paths": []},
    "PA": {"application_paths": [], "adapter_paths": [], "adapter_types": [], "accepted_colocated": [], "construction_paths": ["*::main", "*::bootstrap::*", "*::composition::*"]},
    "RW": {"owner_paths": [], "state_types": ["Mutex<*", "RwLock<*", "Arc<Mutex<*", "Arc<RwLock<*", "OnceCell<*", "OnceLock<*"], "singleton_names": ["*Singleton", "*Globals"]},
    "DA": {"enabled": False, "accepted": [], "factory_names": ["create_*", "make_*", "*_factory", "build_*"], "strategy_names": ["*Strategy", "*Mode", "*Policy"]},
    "RM": {"max_action_kinds": None, "exempt_paths": [], "converter_paths": [], "handler_paths": [], "repository_paths": [], "validator_paths": [], "domain_paths": [], "handler_cap": 3, "repository_cap": 3},
    "FO": {"features": [], "shared_paths": []},
    "OB": {
        "observer_paths": [], "log_targets": ["println", "eprintln", "print", "eprint", "dbg"], "metric_macros": ["metrics::counter", "metrics::histogram", "metrics::gauge"], "metric_owner_paths": [],
        "event_macros": ["event", "emit", "publish", "tracing::event"], "event_owner_paths": [],
    },
    "CF": {"config_paths": [], "literal_kinds": ["str", "int", "float"], "id_patterns": []},
    "TA": {"test_paths": [], "canonical_names": [], "canonical_fields": [], "port_traits": [], "adapter_paths": []},
    "UT": {"utility_paths": [], "forbidden_imports": [], "generic_patterns": [], "accepted_modules": [], "canonical_constructs": []},
}

# fixed values: the members whose emptiness leaves a family vacant
VACANCY: dict[str, list[str]] = {
    "BO": ["domain_paths", "forbidden_in_domain", "persistence_types", "canonical_paths"],
    "CF": ["config_paths"],
    "CR": ["root_paths"],
    "DA": ["enabled"],
    "DG": ["edges", "features", "shared_paths"],
    "ER": ["domain_paths", "string_error_patterns", "boundary_error_patterns", "collapse_owner_paths"],
    "FL": ["domain_paths", "boundary_error_patterns", "invariant_owner_paths", "retry_policy_owner_paths"],
    "FO": ["features", "shared_paths"],
    "PA": ["application_paths", "adapter_paths", "adapter_types"],
    "RM": ["max_action_kinds", "converter_paths", "handler_paths", "repository_paths", "validator_paths", "domain_paths"],
    "RW": ["owner_paths"],
    "TA": ["test_paths"],
    "UT": ["utility_paths", "generic_patterns"],
}


#: A policy document as a table: ``name`` is null for a plain number, ``ix`` the place in the document.
ENTRY = "family string, key string, name string, value long, reason string, expires string, owner string, ix long"
#: The key of entries whose name is a family that is known to be empty.
ACKNOWLEDGED = "acknowledged"


@dataclass
class Policy:
    """``sections`` holds what a document says; ``section`` fills in the defaults, ``explicit`` does not."""

    sections: dict[str, dict] = field(default_factory=dict)
    exceptions: list[dict] = field(default_factory=list)
    acknowledged: list = field(default_factory=list)

    @staticmethod
    def parse(text: str | None) -> Policy:
        """An absent document is empty; a malformed one raises."""
        raw = json.loads(text) if text else {}
        return Policy(raw.get("sections", {}), raw.get("exceptions", []), raw.get("acknowledged", []))

    def explicit(self, family: str) -> dict | None:
        own = self.sections.get(family)
        return own if isinstance(own, dict) else None

    def section(self, family: str) -> dict:
        """A malformed section behaves as the default one."""
        return deepcopy(DEFAULTS[family]) | (self.explicit(family) or {})

    def entries(self, spark: SparkSession) -> DataFrame:
        """The document as a table of ``ENTRY``: a row a number, and a row a named thing that a list holds. A section without any shows by a row without a key."""
        rows: list[tuple] = []
        for fam in self.sections:
            own = self.explicit(fam)
            if own is None:
                continue
            rows.append((fam, None, None, None, None, None, None))
            for key, said in own.items():
                if isinstance(said, (bool, int)):
                    rows.append((fam, key, None, int(said), None, None, None))
                for x in said if isinstance(said, list) else []:
                    if isinstance(x, list):
                        x = {"name": str(x[0]), "budget": x[1] if len(x) > 1 else None, **(x[2] if len(x) > 2 and isinstance(x[2], dict) else {})}
                    elif not isinstance(x, dict):
                        x = {"name": str(x)}
                    budget = x.get("budget")
                    rows.append((fam, key, x.get("name") or x.get("path") or x.get("module"), budget if isinstance(budget, int) else None, x.get("reason"), x.get("expires"), x.get("owner")))
        for x in self.acknowledged:
            x = {"prefix": x} if isinstance(x, str) else x
            rows.append(("", ACKNOWLEDGED, x.get("prefix"), None, x.get("reason"), x.get("expires"), x.get("owner")))
        return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ENTRY)

    def vacant(self) -> list[str]:
        """Families with nothing to check, but for the acknowledged ones."""
        known = {x if isinstance(x, str) else x.get("prefix") for x in self.acknowledged}
        return [f for f, names in VACANCY.items() if f not in known and not any(self.section(f)[n] for n in names)]

    def text(self) -> str:
        return json.dumps({"sections": self.sections, "exceptions": self.exceptions, "acknowledged": self.acknowledged}, indent=2)


#: A policy for the projected star-schema facts, in which every rule has something to find.
SAMPLE = Policy(
    {
        "CX": {"fn_overrides": [["*::domain::*", 90], ["p1::*", 40]], "module_overrides": [["*::tests::*", 700]], "max_public_items": 12, "orchestration_paths": ["*::handlers::*"]},
        "DG": {
            "edges": [["*::domain::*", "*::infra::*"], ["*::domain::*", "*::api::*"], ["*::utils::*", "*::feature_one::*"]],
            "features": [["one", ["*::feature_one::*"], ["*::feature_one::api"]], ["two", ["*::feature_two::*"], []]],
            "shared_paths": ["*::utils::*", "*::config::*"],
        },
        "OT": {"converter_paths": ["*::tests::*", "*::config::*"]},
        "FL": {"domain_paths": ["*::domain::*", "*::feature_one::*"], "boundary_error_patterns": ["sqlx::*", "reqwest::*"], "invariant_owner_paths": ["*::infra::*"], "retry_policy_owner_paths": ["*::infra::*", "p2::*"]},
        "MO": {"max_public_types": 5, "overrides": [["*::api::*", 8]]},
        "AB": {"accepted_names": ["SmallRingService"]},
        "CL": {"enabled": True, "exempt_paths": ["*::infra::*"]},
        "BO": {"domain_paths": ["*::domain::*"], "forbidden_in_domain": ["*::sqlx::*", "*::api::*"], "persistence_types": ["sqlx::*"], "canonical_paths": ["*::domain::*", "*::model"]},
        "CR": {"root_paths": ["p1::*", "p4::*", "p15::*", "p20::*"], "wiring_density": 6},
        "DC": {"require_public_docs": True, "exempt_paths": ["p3::*"]},
        "ER": {"domain_paths": ["*::domain::*"], "string_error_patterns": ["String", "str", "&*str"], "boundary_error_patterns": ["sqlx::*", "std::io::*"], "collapse_owner_paths": ["*::infra::*"]},
        "PA": {"application_paths": ["*::handlers::*"], "adapter_paths": ["*::infra::*", "*::sqlx::*"], "adapter_types": ["*::PgAdapter", "sqlx::*"], "accepted_colocated": ["Port308", "*::Port539"]},
        "RW": {"owner_paths": ["*::infra::*"]},
        "DA": {"enabled": True},
        "RM": {
            "max_action_kinds": 4, "exempt_paths": ["*::tests::*"], "converter_paths": ["*::api::*", "*::domain::*"], "handler_paths": ["*::handlers::*"], "repository_paths": ["*::infra::*"],
            "validator_paths": ["*::domain::*", "*::api::*"], "domain_paths": ["*::domain::*"],
        },
        "FO": {"features": [["one", ["*::feature_one::*"]], ["two", ["*::feature_two::*"]]], "shared_paths": ["*::utils::*", "*::domain::*"]},
        "OB": {"observer_paths": ["*::infra::*"], "metric_owner_paths": ["*::config::*"], "event_owner_paths": ["*::api::*"]},
        "CF": {"config_paths": ["*::config::*"], "id_patterns": ["gpt-*", "topic.*"]},
        "TA": {"test_paths": ["*::tests::*"], "canonical_names": ["SmallRing", "*Dto"], "canonical_fields": [["RedGear", ["id", "name"]], ["SmallRing", ["id", "small_ring", "pool"]]], "port_traits": ["*::OldBolt", "*Gear*"], "adapter_paths": ["*::mod"]},
        "UT": {"utility_paths": ["*::utils::*"], "forbidden_imports": ["*::feature_one::*", "*::domain::*"], "generic_patterns": ["*::utils::*", "*::model"], "accepted_modules": ["p1::*"], "canonical_constructs": ["*::SmallRing", "RedWidget"]},
    }
)
