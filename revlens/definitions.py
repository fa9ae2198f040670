"""One sentence for each kind that a model is offered; what it means here, and what a verifier is shown with the kind's name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .kinds import catalogue

TEXT = """
missing_authz_check: an action runs without asking whether this caller may perform it
crossfile_ownership: one file hands out a record that another file's rule reserves for its owner
crossfile_data_exposure: a field that one file keeps private leaves the system through another file
crossfile_idempotency: a step that another file may repeat has an effect each time
sql_injection: text from outside becomes part of a database statement
command_injection: text from outside becomes part of a shell command
xss: text from outside reaches a page without being escaped
hardcoded_credential: a working secret is written in the repository
weak_crypto_primitive: a broken or outdated algorithm protects something that matters
unvalidated_passthrough: input is handed on to a place that relies on its being checked
secret_in_log: a secret value is written to a log or a message
ssrf_unvalidated_fetch: the server fetches an address that a caller chose
unsafe_deserialization: data from outside is turned into objects by a format that can run code
path_traversal: a caller can name a file outside the intended folder
mass_assignment: a caller can set fields that were not meant to be set from outside
dynamic_code_execution: text is run as code
insecure_transport: data travels unencrypted, or a certificate goes unchecked
insecure_randomness: a guessable generator makes a value that must not be guessed
overly_permissive_permission: a file, role or resource is open to more than it needs
missing_transaction: writes that belong together can be left half done
check_then_act_race: a condition can change between its test and the act that relies on it
missing_duplicate_guard: the same request or message can take effect twice
crossfile_error_propagation: one file signals an error in a way that its caller in another file misses
crossfile_ordering: one file relies on an order of events that another file does not keep
crossfile_unit_mismatch: two files take the same number to be in different units
error_detail_disclosure: an error message tells outsiders about internals
open_redirect: a caller chooses where another user is sent
wrong_argument: a call passes a value that the parameter does not mean
wrong_data_source: a value is read from a place that does not hold what is needed
wrong_state_check: the test looks at a state other than the one that decides
silent_overwrite: existing data is replaced without anyone being told
swallowed_exception: an error is caught and lost
unclosed_resource: a file, connection or lock is not released on every path
work_in_loop: a costly step that could run once runs on every pass
removed_dependency: something that is still needed was taken out of the dependencies
null_deref: a value that can be absent is used as if it were there
off_by_one: a boundary is one too far or one too short
unguarded_dict_access: a key that can be missing is read without a default
missing_lock: shared data changes in several threads without protection
unbounded_resource: a queue, cache, read or batch can grow without limit
float_money: amounts of money are kept in binary fractions
naive_datetime: a time without zone is mixed with, or taken for, one with a zone
blocking_call_in_async: a call that waits holds up the event loop
mutable_default_argument: calls share one default object that they change
regex_denial_of_service: a pattern takes exponential time on some input
breaking_public_api: callers outside the change no longer work
missing_migration: the model of the data changes and the stored data does not
unsafe_default: the value that applies when nothing is set switches a bound or a protection off
contradictory_setting: two settings cannot both hold
removed_config_key: a setting that is still read was taken out
missing_timeout: a call that can hang may hang forever
retry_without_bound: a failing step is repeated without end or pause
unawaited_coroutine: an asynchronous call is started and its result never awaited
global_state_mutation: a function changes state that others share
lossy_conversion: a conversion drops part of the value
encoding_assumption: bytes are read as text in an encoding that is not given
unsafe_temp_file: a temporary file has a guessable name or lies open to others
ignored_return_value: a result that tells of failure is not looked at
stale_cache_write: a cache keeps or receives a value that is out of date
loop_without_progress: a pass of the loop can leave everything as it was
unreachable_code: no run can reach the code
unused_symbol: a name is defined and not used
misleading_name: a name says something that the code does not do
duplicated_block: the same code stands in two places
duplicated_config: the same setting is given in two places
duplicated_test_block: the same test code stands in two places
broad_except: a handler catches more than it can handle
redundant_work: a result is computed again or never used
divergent_change: copies of one piece of code were changed in one place only
missing_assertion: a test runs code and does not check the outcome
hardcoded_endpoint: an address is fixed in code that must run against several
wrong_assertion_target: a test checks something other than what it is about
leaky_test_state: a test leaves behind what can change another test
disabled_test: a test is switched off
"""


def definitions() -> dict[str, str]:
    found = dict(line.split(": ", 1) for line in TEXT.strip().split("\n"))
    return {kind: found[kind] for kind in catalogue()}


def definition_table(spark: SparkSession) -> DataFrame:
    """type, definition: 74 rows."""
    return spark.createDataFrame(list(definitions().items()), "type string, definition string")
