"""Content rules: deterministic findings on added lines. Each is a filter over lines; the weakened-test rule counts by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_code, is_test_file, strip
from . import diff
from .changes import Cases, Changes, files_of, listing
from .symbols import constants_modules

# Words and patterns that decide the rules.
OFF = ("0", "-1", "None", '""', "''", "False", "0.0")
BOUND = r"(?iu)(max|min|limit|batch|timeout|retry|retries|ttl|expire|size|count|attempts)"
GUARD = r"(?iu)(verify|ssl|tls|secure|auth|check|validate|debug|strict)"
PLURAL = r"(?iud)(statuses|codes|hosts|keys|origins|methods|users|paths|fields|names|ids)$"
ASSIGNMENT = r"(?dU)^( {0,4})([A-Za-z_][A-Za-z0-9_]*)\s*(?::\s*[^=#]+?)?\s*=\s*(.+?)(?:\s*#.*)?$"
ASSERT = r"(?dU)^\s*assert\b"
CONFIG_NAMES = ("settings.py", "defaults.py", "config.py", "profiles.py", "constants.py")
SECRET_NAME = r"(?iu)(password|passwd|secret|token|api[_-]?key|private[_-]?key|credential)"
SECRET_VALUE = r"""(?dU)[:=]\s*["']?([^"'\s]{6,})["']?\s*$"""
PLACEHOLDER = r"(?iu)(change[_-]?me|placeholder|example|xxx+|\.\.\.|<[^>]+>|\$\{|os\.environ|getenv|secrets\.|vault|\*\*\*)"
EXAMPLE_FILE = r"(?iud)(\.example$|\.sample$|\.template$|\.dist$|example\.|sample\.)"
#: A rule fired or it did not; above the publishing floor.
CONFIDENCE = 0.9


def named_config(path: Column) -> Column:
    """By the end of the path, so that my_settings.py counts."""
    out = F.lit(False)
    for name in CONFIG_NAMES:
        out = out | path.endswith(name)
    return out


def assignments(lines: DataFrame) -> DataFrame:
    """lines with `name` and `value` of those that assign at module or class level."""
    return lines.filter(F.col("text").rlike(ASSIGNMENT)).withColumn("name", F.regexp_extract("text", ASSIGNMENT, 2)).withColumn("value", strip(F.regexp_extract("text", ASSIGNMENT, 3)))


def _off_value() -> tuple[Column, Column]:
    """Names of limits and of checks whose value amounts to none: (condition, message)."""
    bound, guard = F.col("name").rlike(BOUND), F.col("name").rlike(GUARD)
    lost = F.when(bound, "there is no limit any more").otherwise("nothing is checked any more")
    return F.col("value").isin(*OFF) & (bound | guard), F.concat(F.lit("with `"), F.col("value"), F.lit("` as `"), F.col("name"), F.lit("` "), lost)


def _string_list() -> tuple[Column, Column]:
    """Plural names whose value is a string with separators in it."""
    text = F.left("value", F.lit(1)).isin('"', "'") & (F.col("value").contains(",") | F.col("value").contains(";"))
    message = F.concat(F.lit("a list is expected under `"), F.col("name"), F.lit("`, and `in` on the text that stands there would match any part of it"))
    return F.col("name").rlike(PLURAL) & text, message


def _secret() -> tuple[Column, Column]:
    """Lines in which a name of a secret is followed by its value."""
    text = F.col("text")
    return text.rlike(SECRET_NAME) & text.rlike(SECRET_VALUE) & ~text.rlike(PLACEHOLDER), F.lit("whoever can read the repository can read this secret")


def _only(rows: DataFrame, rule: tuple[Column, Column]) -> DataFrame:
    return rows.filter(rule[0]).withColumn("message", rule[1])


def off_values(assigned: DataFrame) -> DataFrame:
    return _only(assigned, _off_value())


def string_lists(assigned: DataFrame) -> DataFrame:
    return _only(assigned, _string_list())


def secret_lines(lines: DataFrame) -> DataFrame:
    return _only(lines, _secret())


def weakened(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """deleted, added: test lines (case_id, path, line_no, i, text). Files that lose more assertions than they gain: case_id, path, line_no and text of
    the first deleted one, with both counts in `message`."""
    gone = deleted.filter(F.col("text").rlike(ASSERT)).groupBy("case_id", "path").agg(
        F.count("*").alias("gone"), F.min_by("line_no", "i").alias("line_no"), F.min_by("text", "i").alias("text")
    )
    new = added.filter(F.col("text").rlike(ASSERT)).groupBy("case_id", "path").agg(F.count("*").alias("new"))
    both = gone.join(new, ["case_id", "path"], "left").na.fill(0, ["new"]).filter("gone > new")
    message = F.format_string("fewer checks than before: %d asserts went, %d came", "gone", "new")
    return both.withColumn("message", message)


#: rule -> kind, in the order in which findings are listed
RULES = {"config.off-value": "unsafe_default", "config.string-list": "unsafe_default", "test.weakened": "missing_assertion", "secret.literal": "hardcoded_credential"}


def _constants_files(cases: Cases, store: str | None) -> DataFrame:
    """case_id, path of changed files that hold nothing but constants, of those whose name doesn't tell that they are settings."""
    unnamed = ~named_config(F.col("path"))
    if isinstance(cases, Changes):
        rest = Changes(cases.cases, cases.files.filter("side = 'head'").filter(unnamed), cases.blobs)
    else:
        rest = files_of(cases, "head").filter(unnamed)
    return constants_modules(rest, store)


def run_rules(cases: Cases, rules: tuple[str, ...] = tuple(RULES), store: str | None = None) -> DataFrame:
    """All findings of the chosen rules, with `ord` in each case: rule by rule, then by file and line. The rules about single lines look at each added line once."""
    added = diff.added_rows(cases)
    by_name = is_code(F.col("path")) & named_config(F.col("path"))
    constants = _constants_files(cases, store).withColumn("config", F.lit(True))
    # Only lines of files whose name doesn't tell meet the files that were parsed.
    told = added.filter(by_name).withColumn("config", F.lit(True)).unionByName(added.filter(~by_name).join(constants, ["case_id", "path"], "left"))
    is_assignment = F.col("config") & F.col("text").rlike(ASSIGNMENT)
    lines = told.withColumns(
        {"name": F.when(is_assignment, F.regexp_extract("text", ASSIGNMENT, 2)), "value": F.when(is_assignment, strip(F.regexp_extract("text", ASSIGNMENT, 3)))}
    )
    no_example = ~F.col("path").rlike(EXAMPLE_FILE)
    secret, why = _secret()
    of_lines = {"config.off-value": _off_value(), "config.string-list": _string_list(), "secret.literal": (no_example & secret, why)}
    found = [F.when(of_lines[r][0], F.struct(F.lit(k).alias("rule_ord"), of_lines[r][1].alias("message"))) for k, r in enumerate(rules) if r in of_lines]
    parts = []
    if found:
        parts.append(lines.select("case_id", "path", "line_no", "text", F.inline(F.array_compact(F.array(*found)))))
    if "test.weakened" in rules:
        tests = is_test_file(F.col("path"))
        gone = diff.removed_lines(cases).filter(tests).join(listing(cases).filter("side = 'head'").filter(tests), ["case_id", "path"], "left_semi").withColumnRenamed("new_no", "line_no")
        parts.append(weakened(gone, added.filter(tests)).select("case_id", "path", "line_no", "text", F.lit(rules.index("test.weakened")).alias("rule_ord"), "message"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    of_rule = [F.array(*[F.lit(x) for x in xs]) for xs in ([RULES[r] for r in rules], [f"rules.{r}" for r in rules])]
    kind, detector = (F.get(xs, F.col("rule_ord")) for xs in of_rule)
    order = Window.partitionBy("case_id").orderBy("rule_ord", "file", "line")
    return out.select(
        "case_id", F.col("path").alias("file"), F.col("line_no").alias("line"), strip(F.col("text")).alias("quote"), kind.alias("type"), "message", F.lit(CONFIDENCE).alias("confidence"),
        detector.alias("detector"), F.lit("rules").alias("stage"), "rule_ord",
    ).withColumn("end_line", F.col("line")).withColumn("ord", F.row_number().over(order).cast("long")).drop("rule_ord")
