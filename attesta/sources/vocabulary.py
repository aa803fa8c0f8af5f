"""The closed vocabularies: predicates, their aliases and phrases, authorities and kinds.

All are fixed values that results depend on; each is small and ships with the code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Predicate, family, whether it has one value at a time.
PREDICATES = (
    ("calls", "dataflow", False), ("reads_from", "dataflow", False), ("writes_to", "dataflow", False), ("publishes_to", "dataflow", False),
    ("subscribes_to", "dataflow", False), ("caches_in", "dataflow", False), ("falls_back_to", "dataflow", False), ("primary_cache_of", "dataflow", True),
    ("lives_in_repo", "structure", True), ("provisioned_by", "infra", True), ("deployed_to", "infra", False), ("exposes_endpoint", "structure", False),
    ("owned_by", "structure", True), ("depends_on", "meta", False), ("connect_via", "access", False), ("secret_at", "access", False),
    ("ttl_seconds", "meta", True), ("note", "meta", False), ("written_in", "technology", False), ("uses_framework", "technology", False),
    ("built_with", "technology", False), ("tests_with", "technology", False), ("depends_on_package", "technology", False), ("implements", "capability", False),
    ("handles_data", "capability", False), ("part_of", "structure", False), ("contains_project", "structure", False), ("supersedes", "lifecycle", False),
    ("built_by", "delivery", False), ("monitors", "ops", False), ("serves_at", "structure", False), ("documented_at", "reference", False),
    ("composes", "structure", False), ("exports", "structure", False), ("variant_of", "structure", False), ("lints_with", "technology", False),
)

# Raw word, the predicate that it stands for.
ALIASES = (
    ("uses", "depends_on"), ("queries", "reads_from"), ("fetches_from", "reads_from"), ("fetches", "reads_from"), ("loads_from", "reads_from"),
    ("gets_data_from", "reads_from"), ("selects_from", "reads_from"), ("persists_to", "writes_to"), ("stores_in", "writes_to"), ("saves_to", "writes_to"),
    ("inserts_into", "writes_to"), ("calls_api", "calls"), ("requests", "calls"), ("invokes", "calls"), ("http_calls", "calls"), ("publishes", "publishes_to"),
    ("emits_to", "publishes_to"), ("consumes", "subscribes_to"), ("listens_to", "subscribes_to"), ("cached_in", "caches_in"), ("caches", "caches_in"),
    ("deployed_by", "provisioned_by"), ("provisioned_in", "provisioned_by"), ("managed_by", "provisioned_by"), ("terraformed_by", "provisioned_by"),
    ("in_repo", "lives_in_repo"), ("source_in", "lives_in_repo"), ("lives_in", "lives_in_repo"), ("runs_in", "deployed_to"), ("hosted_in", "deployed_to"),
    ("owned_by_team", "owned_by"), ("falls_back", "falls_back_to"), ("fallback_to", "falls_back_to"), ("language", "written_in"),
    ("written_using", "written_in"), ("coded_in", "written_in"), ("styled_with", "written_in"), ("framework", "uses_framework"),
    ("uses_react", "uses_framework"), ("build_tool", "built_with"), ("bundled_with", "built_with"), ("compiled_with", "built_with"),
    ("packaged_with", "built_with"), ("test_framework", "tests_with"), ("tested_with", "tests_with"), ("uses_library", "depends_on_package"),
    ("depends_on_library", "depends_on_package"), ("uses_package", "depends_on_package"), ("provides_feature", "implements"), ("feature", "implements"),
    ("provides", "implements"), ("stores_data", "handles_data"), ("processes_data", "handles_data"), ("accesses_data", "handles_data"),
    ("handles", "handles_data"), ("belongs_to", "part_of"), ("replaces", "supersedes"), ("supersedes_project", "supersedes"), ("ci_pipeline", "built_by"),
    ("pipeline", "built_by"), ("deployed_by_pipeline", "built_by"), ("alerts_on", "monitors"), ("watches", "monitors"), ("base_url", "serves_at"),
    ("hosted_at", "serves_at"), ("runbook", "documented_at"), ("docs_at", "documented_at"), ("uses_component", "composes"), ("renders", "composes"),
    ("wraps", "composes"), ("built_from", "composes"), ("includes_component", "composes"), ("exports_component", "exports"), ("provides_component", "exports"),
    ("publishes_component", "exports"), ("specialises", "variant_of"), ("specializes", "variant_of"), ("extends_component", "variant_of"),
    ("linted_with", "lints_with"), ("formatted_with", "lints_with"), ("checked_with", "lints_with"),
)

# Phrase, the predicate that it states.
PHRASES = (
    ("is written in", "written_in"), ("written in", "written_in"), ("is implemented in", "written_in"), ("is coded in", "written_in"),
    ("is styled with", "written_in"), ("styled with", "written_in"), ("uses the framework", "uses_framework"), ("is built on", "uses_framework"),
    ("is written using", "uses_framework"), ("written using", "uses_framework"), ("uses", "uses_framework"), ("is using", "uses_framework"),
    ("is built with", "built_with"), ("built with", "built_with"), ("is bundled with", "built_with"), ("bundled with", "built_with"),
    ("is packaged with", "built_with"), ("builds with", "built_with"), ("is compiled with", "built_with"), ("is tested with", "tests_with"),
    ("tested with", "tests_with"), ("tests with", "tests_with"), ("depends on the package", "depends_on_package"), ("uses the library", "depends_on_package"),
    ("depends on", "depends_on_package"), ("makes a request to", "calls"), ("sends requests to", "calls"), ("calls into", "calls"), ("calls", "calls"),
    ("hits", "calls"), ("requests", "calls"), ("reads from", "reads_from"), ("loads from", "reads_from"), ("fetches from", "reads_from"),
    ("gets data from", "reads_from"), ("queries", "reads_from"), ("reads", "reads_from"), ("writes to", "writes_to"), ("saves to", "writes_to"),
    ("stores in", "writes_to"), ("persists to", "writes_to"), ("inserts into", "writes_to"), ("publishes to", "publishes_to"), ("emits to", "publishes_to"),
    ("sends messages to", "publishes_to"), ("subscribes to", "subscribes_to"), ("consumes from", "subscribes_to"), ("listens to", "subscribes_to"),
    ("caches data in", "caches_in"), ("caches in", "caches_in"), ("falls back to", "falls_back_to"), ("falls back on", "falls_back_to"),
    ("lives in the repo", "lives_in_repo"), ("lives in repo", "lives_in_repo"), ("is in the repo", "lives_in_repo"), ("is in repo", "lives_in_repo"),
    ("source lives in", "lives_in_repo"), ("lives in", "lives_in_repo"), ("exposes the route", "exposes_endpoint"), ("defines the route", "exposes_endpoint"),
    ("exposes", "exposes_endpoint"), ("defines", "exposes_endpoint"), ("serves", "exposes_endpoint"), ("handles the route", "exposes_endpoint"),
    ("is provisioned by", "provisioned_by"), ("provisioned by", "provisioned_by"), ("is created by", "provisioned_by"), ("is managed by", "provisioned_by"),
    ("is terraformed by", "provisioned_by"), ("is deployed to", "deployed_to"), ("deployed to", "deployed_to"), ("runs in", "deployed_to"),
    ("runs on", "deployed_to"), ("is owned by", "owned_by"), ("owned by", "owned_by"), ("is part of", "part_of"), ("part of", "part_of"),
    ("implements", "implements"), ("provides", "implements"), ("is responsible for", "implements"), ("handles the data", "handles_data"),
    ("handles", "handles_data"), ("processes", "handles_data"), ("is the replacement for", "supersedes"), ("is replacing", "supersedes"),
    ("replaces", "supersedes"), ("supersedes", "supersedes"), ("is built by", "built_by"), ("is deployed by the pipeline", "built_by"),
    ("monitors", "monitors"), ("alerts on", "monitors"), ("watches", "monitors"), ("is documented at", "documented_at"), ("is reachable at", "serves_at"),
    ("is served at", "serves_at"), ("is hosted at", "serves_at"),
)

# Kinds that can be taken for one another, kinds without environments, identifying qualifiers, authorities.
KIND_FAMILIES = {
    "container": ("package", "repo", "domain", "system"),
    "unit": ("component", "service", "client", "endpoint", "iac_module", "pipeline"),
    "technology": ("technology",),
    "infra": ("datastore", "cache", "queue", "cloud_resource"),
    "concept": ("capability", "data_concept"),
    "org": ("team",),
    "ops": ("alert",),
}
ENVIRONMENTLESS = ("package", "repo", "component", "technology", "capability", "data_concept", "team", "domain", "iac_module", "pipeline", "endpoint")
IDENTIFYING = ("role", "key_pattern", "table", "topic", "path", "method", "index", "schema", "direction", "env_of_target")
AUTHORITIES = ("gitlab_project", "git_remote", "arn", "tf_address", "otel_service", "k8s", "url", "scip_symbol", "npm_package", "module_export")


def predicate_rows() -> list[tuple[str, str, bool]]:
    return list(PREDICATES)


def alias_rows() -> list[tuple[str, str]]:
    return list(ALIASES)


def phrase_rows() -> list[tuple[str, str]]:
    return list(PHRASES)


def predicates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(predicate_rows(), "name string, family string, functional boolean")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(alias_rows(), "raw string, maps_to string")
