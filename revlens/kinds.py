"""Kinds of defects: severity, family, and whether a model is offered the kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("HIGH", "MEDIUM", "LOW")
DEFAULT_LEVEL = "MEDIUM"

# Kind and family by severity, in the order of the public catalogue.
HIGH = """
missing_authz_check authz
crossfile_ownership authz
crossfile_data_exposure disclosure
crossfile_idempotency concurrency
sql_injection injection
command_injection injection
xss injection
hardcoded_credential secrets
weak_crypto_primitive crypto
unvalidated_passthrough correctness
secret_in_log secrets
ssrf_unvalidated_fetch ssrf
unsafe_deserialization deserialization
path_traversal injection
mass_assignment authz
dynamic_code_execution injection
insecure_transport crypto
insecure_randomness crypto
overly_permissive_permission authz
missing_transaction data_layer
check_then_act_race concurrency
missing_duplicate_guard concurrency
"""
MEDIUM = """
crossfile_error_propagation error_handling
crossfile_ordering concurrency
crossfile_unit_mismatch data_layer
error_detail_disclosure disclosure
open_redirect injection
wrong_argument correctness
wrong_data_source data_layer
wrong_state_check correctness
silent_overwrite data_layer
swallowed_exception error_handling
unclosed_resource resource_perf
work_in_loop resource_perf
removed_dependency config
null_deref edge_cases
off_by_one edge_cases
unguarded_dict_access edge_cases
missing_lock concurrency
unbounded_resource resource_perf
float_money correctness
naive_datetime correctness
blocking_call_in_async concurrency
mutable_default_argument correctness
regex_denial_of_service resource_perf
breaking_public_api maintainability
missing_migration data_layer
unsafe_default config
contradictory_setting config
removed_config_key config
removed_network_config config
missing_timeout resource_perf
retry_without_bound concurrency
unawaited_coroutine concurrency
global_state_mutation concurrency
lossy_conversion correctness
encoding_assumption correctness
unsafe_temp_file disclosure
ignored_return_value error_handling
stale_cache_write data_layer
loop_without_progress correctness
business_logic business_logic
"""
LOW = """
unreachable_code maintainability
unused_symbol maintainability
misleading_name maintainability
duplicated_block maintainability
duplicated_config config
duplicated_test_block test_quality
broad_except error_handling
redundant_work resource_perf
divergent_change maintainability
missing_assertion test_quality
hardcoded_endpoint test_quality
wrong_assertion_target test_quality
leaky_test_state test_quality
disabled_test test_quality
"""
#: Only answer keys use these two.
KEY_ONLY = ("removed_network_config", "business_logic")


def kinds() -> list[tuple[str, str, str, bool]]:
    """(kind, family, severity, in catalogue)"""
    levels = zip(LEVELS, (HIGH, MEDIUM, LOW), strict=True)
    return [(k, f, level, k not in KEY_ONLY) for level, text in levels for k, f in (x.split() for x in text.strip().split("\n"))]


def catalogue() -> list[str]:
    return [k for k, _, _, offered in kinds() if offered]


def dim_kind(spark: SparkSession) -> DataFrame:
    """One row a kind: 76 rows, whatever the data, so a join may broadcast it."""
    return spark.createDataFrame(kinds(), "kind string, family string, severity string, in_catalogue boolean")


def with_kind(df: DataFrame, kind: str = "type") -> DataFrame:
    """df and family (null for unknown kinds) and severity (MEDIUM for unknown kinds)."""
    dim = F.broadcast(dim_kind(df.sparkSession).select(F.col("kind").alias("_kind"), F.col("family").alias("_family"), F.col("severity").alias("_severity")))
    out = df.drop("family", "severity").join(dim, F.col(kind) == F.col("_kind"), "left")
    return out.withColumn("family", F.col("_family")).withColumn("severity", F.coalesce("_severity", F.lit(DEFAULT_LEVEL))).drop("_kind", "_family", "_severity")


def _lookup(at: int) -> Column:
    return F.create_map(*[F.lit(x) for row in kinds() for x in (row[0], row[at])])


def family(kind: Column) -> Column:
    return F.try_element_at(_lookup(1), kind)


def severity(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(2), kind), F.lit(DEFAULT_LEVEL))


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)
