"""Lines of a file are numbered while its splits are read, and a malformed one is named by the read itself."""

import json

import pytest

from revlens import schemas
from revlens.sources import tables

from .cases import make_case


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    yield
    spark.conf.set(key, before)


def test_numbers_over_several_splits(spark, small_splits, tmp_path):
    for name, n in (("a.txt", 2000), ("b.txt", 3), ("c.txt", 700)):
        (tmp_path / name).write_text("".join(f"{name} {k}{' ' * (k % 7)}\n" if k % 5 else "\n" for k in range(1, n + 1)))
    lines = tables.numbered_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 3
    rows = lines.collect()
    assert len(rows) == 2703 and all(r["value"].split() in ([], [r["file"].rpartition("/")[2], str(r["line_no"])]) for r in rows)
    assert sorted(r["line_no"] for r in rows if r["file"].endswith("a.txt")) == list(range(1, 2001))


def test_a_malformed_line_is_named(spark, small_splits, tmp_path):
    path = tmp_path / "cases.jsonl"
    case = make_case("c", {"a.py": "x = 1\n"}, {"a.py": "x = 2\n"})
    lines = [json.dumps(case | {"case_id": f"c{k}"}) for k in range(60)]
    path.write_text("\n".join(lines) + "\n")
    assert tables.load_cases(spark, str(path)).count() == 60
    for bad in ('{"case_id": ', '{"case_id": "x", "labelled": 3}', "[1]"):
        path.write_text("\n".join([*lines[:40], "", "  \r", bad, *lines[40:]]) + "\n")
        with pytest.raises(Exception, match=r"/cases\.jsonl:43: this line is malformed"):
            tables.load_cases(spark, str(path)).collect()
    (tmp_path / "p.jsonl").write_text('{"case_id": "a", "file": "f", "line": 1}\r\n\r\n{"case_id": "b", "file": "é"}\r\n')
    assert [(r["case_id"], r["file"]) for r in tables.read_jsonl(spark, str(tmp_path / "p.jsonl"), schemas.PREDICTIONS).collect()] == [("a", "f"), ("b", "é")]
    (tmp_path / "q.jsonl").write_text('{"case_id": "a"}\n{nope}\n')
    with pytest.raises(Exception, match=r"/q\.jsonl:2: this line"):
        tables.load_predictions(spark, str(tmp_path / "q.jsonl")).collect()
    (tmp_path / "none.jsonl").write_text("")
    assert tables.read_jsonl(spark, str(tmp_path / "none.jsonl"), schemas.PREDICTIONS).count() == 0
