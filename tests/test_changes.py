"""Files by content: stored once, parsed once, and every operator gives what it gives for cases with their files in maps."""

import pytest
from pyspark.sql import functions as F

from revlens.operators import anchoring, changes, diff, packs, rules, symbols
from revlens.plans import reports, stages

from .cases import claims, frame, make_case
from .test_content import NEW, OLD


@pytest.fixture(scope="module")
def both(spark):
    cases = frame(spark, [make_case("p", OLD, NEW), make_case("q", OLD, NEW | {"app/core.py": "x = 1\n"}), make_case("clean", {"a.py": "x = 1\n"}, {"a.py": "x = 2\n"}), make_case("doc", {}, {"readme.md": "hi\n"}), make_case("none", {"a.py": "x"}, {})]).cache()
    return cases, changes.split(cases)


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.collect()), key=repr)


def test_split_and_back(both):
    cases, stored = both
    contents = [r["text"] for r in stored.blobs.collect()]
    assert len(contents) == len(set(contents)) < stored.files.count()
    assert rows_of(changes.files_of(stored)) == rows_of(changes.files_of(cases)) and rows_of(changes.listing(stored)) == rows_of(changes.listing(cases))
    back = changes.nested(stored)
    assert sorted(map(repr, back.select(*cases.columns).collect())) == sorted(map(repr, cases.collect()))
    some = changes.only(stored, cases.select("case_id").filter("case_id = 'p'"))
    assert {r["case_id"] for r in changes.files_of(some).collect()} == {"p"} == {r["case_id"] for r in some.select("case_id").collect()}


def test_operators_take_either_form(spark, both):
    cases, stored = both
    said = claims(spark, [(c, f, n, "x", 0.9, q) for c in ("p", "q", "doc") for f, n, q in (("app/core.py", 10, "def run(x):"), ("tests/test_core.py", 1, "assert 2"), ("lib/util.py", 1, "LIMIT_B = 77"), ("readme.md", 1, "hi there"))])
    evidence = said.select("case_id", "ord", F.lit("established").alias("verdict"), F.array(F.struct("file", "line", "quote")).alias("evidence"))
    for one in (
        lambda c: rules.run_rules(c), lambda c: symbols.facts(c), lambda c: packs.packs(c, with_facts=True, with_deletions=True), lambda c: diff.base_revision(c), lambda c: diff.added_rows(c), lambda c: diff.excerpts(c, said, 2, True),
        lambda c: anchoring.anchor(said, c, with_deletions=True), lambda c: anchoring.scope(said, c), lambda c: anchoring.settle(evidence, c), lambda c: reports.comments(c, said, "r", "m"), lambda c: stages.rules(c),
        lambda c: symbols.constants_modules(c if isinstance(c, changes.Changes) else changes.files_of(c)),
    ):
        assert rows_of(one(stored)) == rows_of(one(cases)) != []


def test_shared_files_are_parsed_once(spark, tmp_path):
    shared = {f"lib/m{k}.py": f"V_{k} = {k}\n\n\ndef f_{k}():\n    return V_{k}\n" for k in range(1000)}
    store = str(tmp_path / "symbols")

    def parsed():
        return spark.read.schema(symbols.BLOB_SCHEMA).option("recursiveFileLookup", True).parquet(store).filter("role = 'file'").count()

    two = changes.split(frame(spark, [make_case(c, shared, shared) for c in ("one", "two")]))
    assert two.files.count() == 2000 and two.blobs.count() == 1000
    found = symbols.symbols(two, store=store)
    assert parsed() == 1000 and found.count() == 2 * 1000 * 4  # V (assign, store, load) and f
    more = changes.split(frame(spark, [make_case("three", shared, shared | {"lib/m0.py": "V_0 = 9\n"}), make_case("four", {}, {"x.py": "not python (", "y.py": "", "z.txt": "V = 1"})]))
    again = symbols.symbols(more, store=store)
    assert parsed() == 1003  # what is new: three contents, of which one can't be parsed and one is empty
    assert rows_of(again) == rows_of(symbols.symbols(more)) and rows_of(symbols.symbols(two, store=store)) == rows_of(symbols.symbols(two))
    assert parsed() == 1003
    symbols.parse_blobs(more.blobs).write.parquet(f"{store}/by-another-run")
    assert rows_of(symbols.symbols(more, store=store)) == rows_of(again)


def test_saved_contents_are_added_once(spark, both, tmp_path):
    cases, stored = both
    folder = str(tmp_path / "store")
    changes.save(stored, folder)
    n = spark.read.parquet(f"{folder}/blobs").count()
    changes.save(changes.split(frame(spark, [make_case("p", OLD, NEW), make_case("new", {}, {"n.py": "fresh = 1"})])), folder)
    assert spark.read.parquet(f"{folder}/blobs").count() == n + 1
    back = changes.load(spark, folder)
    assert {r["case_id"] for r in back.select("case_id").collect()} == {"p", "new"}
    assert ("new", "n.py", "head", "fresh = 1") in {tuple(r) for r in changes.files_of(back).collect()}
    stored.blobs.write.mode("append").parquet(f"{folder}/blobs")  # a second writer at the same time
    assert rows_of(changes.files_of(changes.load(spark, folder))) == rows_of(changes.files_of(back))


def test_ingest_keeps_a_tree_once(spark):
    tree = {f"d/f{k}.py": f"x = {k}\n" for k in range(50)} | {"a.py": "x = 2\n"}
    text = make_case("z", {"a.py": "x = 1\n"}, {"a.py": "x = 2\n"})["diff"]
    kind = "id long, title string, description string, source struct<commit: struct<hash: string>, branch: struct<name: string>>, destination struct<commit: struct<hash: string>, branch: struct<name: string>>, links struct<html: struct<href: string>>"
    pulls = spark.createDataFrame([(k, "T", None, (("abc",), ("b",)), (("def",), ("main",)), (("u",),)) for k in range(20)], kind)
    diffs = spark.createDataFrame([(k, text) for k in range(20)], "pull_id long, diff string")
    trees = spark.createDataFrame([("abc", p, t) for p, t in tree.items()] + [("other", "x.py", "never used")], "commit string, path string, text string")
    from revlens import schemas

    keys = spark.createDataFrame([], f"pull_id long, head_commit string, is_defective boolean, findings array<{schemas.FINDING}>")
    got = stages.ingest_changes(pulls, diffs, trees, keys)
    assert got.blobs.count() == 50 and got.files.count() == 20 * 51  # f2 and a.py are alike, and nobody needs the other tree
    assert {tuple(r) for r in got.files.groupBy("side").count().collect()} == {("head", 20), ("context", 1000)}
    assert not {"head_files", "context_files"} & set(got.cases.columns)
    one = stages.ingest(pulls, diffs, trees, keys).filter("case_id = 'PR-3'").first()
    assert one["head_files"] == {"a.py": "x = 2\n"} and len(one["context_files"]) == 50
