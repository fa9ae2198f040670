"""Rules, symbols, anchoring, packs and answers."""

from revlens.functions import answers
from revlens.operators import anchoring, packs, rules, symbols
from revlens.operators.diff import files_of
from revlens.operators.workspace import Interview, Workspace

from .cases import claims, frame, make_case

OLD = {
    "app/settings.py": "MAX_BATCH = 50\nALLOWED = 1\n",
    "app/core.py": "import os\n\n\ndef run(x):\n    return x\n",
    "tests/test_core.py": "def test_a():\n    assert 1\n    assert 2\n    x = 3\n",
    "lib/util.py": "LIMIT_B = 77\n\n\ndef helper(a):\n    return run(a)\n",
}
NEW = {
    "app/settings.py": 'MAX_BATCH = 0\nALLOWED = 1\nverify_ssl: bool = False  # off\nretry_codes = "502,503"\ncount_total = 4\n',
    "app/core.py": "import os\n\nLIMIT_A = 77\n\n\ndef _unused():\n    return LIMIT_A\n\n\ndef run(x):\n    retries = 0\n    password = get()\n    return x\n",
    "tests/test_core.py": "def test_a():\n    assert 1\n    x = 3\n",
    "lib/util.py": OLD["lib/util.py"],
    "deploy.yml": 'api_key: "abcdef123"\ntoken: example-token\n',
    "deploy.yml.example": 'api_key: "abcdef123"\n',
    "consts.py": "import os\nA = 0\nB_TIMEOUT = None\nC = 2\n",
}


def _cases(spark):
    return frame(spark, [make_case("p", OLD, NEW), make_case("clean", {"a.py": "x = 1\n"}, {"a.py": "x = 2\n"}), make_case("doc", {}, {"readme.md": "hi\n"})])


def test_rules(spark):
    got = [(r["case_id"], r["detector"], r["file"], r["line"]) for r in rules.run_rules(_cases(spark)).orderBy("case_id", "ord").collect()]
    assert got == [
        ("p", "rules.config.off-value", "app/settings.py", 1),
        ("p", "rules.config.off-value", "app/settings.py", 3),
        ("p", "rules.config.off-value", "consts.py", 3),
        ("p", "rules.config.string-list", "app/settings.py", 4),
        ("p", "rules.test.weakened", "tests/test_core.py", 3),
        ("p", "rules.secret.literal", "deploy.yml", 1),
    ]


def test_patterns_agree_with_python(spark):
    import re

    from pyspark.sql import functions as F

    lines = ["MAX = 0", "    b: int = 3  # c", "     deep = 1", 'x = "a#b"', "password = 'ſecret1'", "paſſword: abcdefg", "token = “quoted66”", "a==b", "  assert x", "assertion", "ids=[1]", "K = 1 "]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    for java, py in ((rules.ASSIGNMENT, rules.ASSIGNMENT.replace("(?dU)", "")), (rules.ASSERT, rules.ASSERT.replace("(?dU)", "")), (rules.SECRET_VALUE, rules.SECRET_VALUE.replace("(?dU)", "")), (rules.SECRET_NAME, "(?i)" + rules.SECRET_NAME[5:])):
        got = [r[0] for r in df.select(F.col("t").rlike(java)).collect()]
        assert got == [bool(re.search(py, t)) for t in lines], java


def test_facts_and_lookups(spark):
    cases = _cases(spark)
    said = {(r["subject"]): r["statement"] for r in symbols.facts(cases).filter("case_id = 'p'").collect()}
    assert set(said) == {"A", "LIMIT_A", "MAX_BATCH", "_unused", "retries"}
    assert "LIMIT_B in lib/util.py" in said["LIMIT_A"]
    files = files_of(cases).filter("case_id = 'p'")
    assert [(r["path"], r["line"]) for r in symbols.find_definitions(files, "run").collect()] == [("app/core.py", 10)]
    assert [(r["path"], r["line"], r["text"]) for r in symbols.find_usages(files, "run").collect()] == [("lib/util.py", 5, "return run(a)")]
    assert symbols.search(files, "").count() == 0 and symbols.search(files, "LIMIT_").count() == 3
    assert [r["path"] for r in symbols.list_files(files, "app/").collect()] == ["app/core.py", "app/settings.py"]
    sources = {"yes.py": "'''d'''\nimport x\nA = 1\nB = C_2 = 2\nD: int = 3", "two.py": "A = 1\nB = 2", "bad.py": "def (", "low.py": "A = 1\nB = 2\nc = 3", "tuple.py": "A = 1\nB = 2\nC, D = 3, 4", "call.py": "A = 1\nB = 2\nC = 3\nf()", "attr.py": "A = 1\nB = 2\nx.C = 3"}
    texts = spark.createDataFrame([("c", p, "head", t) for p, t in sources.items()], "case_id string, path string, side string, text string")
    assert [r["path"] for r in symbols.constants_modules(texts).collect()] == ["yes.py"]


def test_anchor_verdicts(spark):
    df = claims(spark, [
        ("p", "app/core.py", 10, "x", 0.9, "def run(x):"), ("p", "app/core.py", 2, "x", 0.9, "   6 + | def _unused():"), ("p", "app/core.py", 1, "x", 0.9, "return"),
        ("p", "tests/test_core.py", 1, "x", 0.9, "assert 2"), ("p", "app/core.py", 4, "x", 0.9, "no such code"), ("p", "app/core.py", 1, "x", 0.9, ")"), ("p", "lib/util.py", 1, "x", 0.9, "LIMIT_B = 77"),
    ])
    cases = _cases(spark)
    got = [(r["verdict"], r["line"]) for r in anchoring.anchor(df, cases, with_deletions=True).orderBy("ord").collect()]
    assert got == [("anchored", 10), ("snapped", 6), ("ambiguous", 1), ("deleted-line", 3), ("unsupported", 4), ("unchecked", 1), ("unchecked", 1)]
    hidden = anchoring.anchor(df, cases).filter("ord = 3").first()
    assert hidden["verdict"] == "unsupported"


def test_scope(spark):
    df = claims(spark, [("p", "app/core.py", 999, "x", 0.9, ""), ("p", "lib/util.py", 1, "x", 0.9, ""), ("doc", "readme.md", 1, "x", 0.9, "")])
    assert [r["kept"] for r in anchoring.scope(df, _cases(spark)).orderBy("ord").collect()] == [True, False, False]


def test_settle(spark):
    kind = "case_id string, ord long, verdict string, evidence array<struct<file: string, line: int, quote: string>>"
    rows = [
        ("p", 1, "established", [("./app/core.py", 12, "def run(x):")]), ("p", 2, "established", [("app/core.py", 40, "def run(x):")]), ("p", 3, "contradicted", []),
        ("p", 4, "established", [("tests/test_core.py", 3, "assert 2")]), ("p", 5, "unsettled", [("app/core.py", 10, "def run(x):")]), ("p", 6, "established", [("app/core.py", None, "def run(x):")]),
    ]
    out = anchoring.settle(spark.createDataFrame(rows, kind), _cases(spark)).orderBy("ord").collect()
    assert [r["verdict"] for r in out] == ["established", "unsettled", "unsettled", "established", "unsettled", "unsettled"]
    assert [r["evidence_checked"] for r in out][:3] == [[True], [False], []]


def test_packs(spark):
    cases = _cases(spark)
    rows = {r["case_id"]: r for r in packs.packs(cases, with_facts=True, with_deletions=True).collect()}
    user = rows["p"]["user"]
    assert user.startswith("# Pull request\n\nA change\n\n" + packs.DELETED)
    assert "# FILE app/core.py\n\n```\n    1   | import os" in user and "      - |     assert 2" in user and "- `_unused`:" in user
    assert "deploy.yml" not in user and rows["doc"]["code_lines"] == 0
    assert rows["p"]["code_lines"] == sum(len(NEW[p].rstrip("\n").split("\n")) for p in ("app/settings.py", "app/core.py", "tests/test_core.py", "consts.py"))
    more = packs.continuation_packs(packs.packs(cases), claims(spark, [("p", "app/core.py", 3, "xss", 0.9, "")]), spark.createDataFrame([("p", "consts.py")], "case_id string, path string"))
    assert "- `app/core.py`:3 xss -- xss here" in more.first()["user"] and "- `consts.py`" in more.first()["user"]


def test_answers(spark):
    texts = [
        ("a", '{"findings": [{"file": " x\\\\y.py ", "line": 5.9, "type": "xss", "title": " t ", "confidence": 9.0, "quote": "q"}, {"file": "f", "line": "5"}, {"file": "f", "line": "5.9"}, {"file": "f", "line": 0}, {"line": 3}, 7, {"file": "f", "line": 2, "confidence": null}]}'),
        ("b", ""), ("c", "nope"), ("d", "[1]"), ("e", '{"x": 1}'), ("f", '{"findings": 3}'), ("g", '{"findings": []}'), ("h", None),
    ]
    found, rejects = answers.parse_answers(spark.createDataFrame(texts, "case_id string, text string"))
    got = [(r["file"], r["line"], r["type"], r["title"], r["confidence"], r["quote"]) for r in found.orderBy("ord").collect()]
    assert got == [("x/y.py", 5, "xss", "t", 1.0, "q"), ("f", 5, "", "", 1.0, ""), ("f", 2, "", "", 0.0, "")]
    bad = sorted((r["case_id"], r["stage"]) for r in rejects.collect())
    assert bad == [("a", "file"), ("a", "item"), ("a", "line"), ("a", "line"), ("b", "empty"), ("c", "json"), ("d", "shape"), ("e", "shape"), ("f", "shape"), ("h", "empty")]
    verdicts = answers.parse_verdicts(spark.createDataFrame([("1", '{"verdict": "established", "evidence": [{"file": "f", "line": 2, "quote": "q"}, 4], "reason": "r"}'), ("2", '{"verdict": "maybe"}'), ("3", "x"), ("4", "[]")], "case_id string, text string"))
    rows = verdicts.orderBy("case_id").collect()
    assert [r["verdict"] for r in rows] == ["established", "unsettled", "unsettled", "unsettled"] and len(rows[0]["evidence"]) == 1
    assert answers.response_schema()["properties"]["findings"]["items"]["required"][-1] == "quote"


def test_tool_loop():
    space = Workspace({"a.py": "def f():\n    return g()\n", "b.py": "x = f()\n"}, {"a.py": "def f():\n    pass\n"}, {"a.py": [2]})
    assert space.find_definition("f") == "a.py:1: def f():" and space.find_usages("f") == "b.py:1: x = f()"
    assert space.read_file("./a.py", 2, 2) == "a.py, 3 lines:\n    2 + |     return g()\n(1 further lines)"
    assert "perhaps a.py" in space.read_file("zz/a.py") and "not there before" in space.read_base("b.py") and "| def f" in space.read_base("a.py")
    assert space.search("") == "no hits" and space.list_files("b") == "b.py" and "unknown tool" in space.call("rm", {}) and "bad arguments" in space.call("search", {"q": 1})
    said = [{"error": "HTTPError 500"}, {"message": {"tool_calls": [{"function": {"name": "search", "arguments": '{"text": "x"}'}}] * 2}}, {"message": {"content": "done"}}, {"message": {"content": "{}"}}]
    talk = Interview(lambda *_, **k: said.pop(0), "q", space, 4)
    talk.look()
    assert (talk.answer({}), talk.calls) == ("{}", 2) and "resampled" in talk.steps[0] and "asked before" in talk.steps[2]["result"]
    endless = Interview(lambda *_, **k: {"message": {"content": "c", "tool_calls": [{"function": {"name": "list_files", "arguments": {}}}] * 3}}, "q", space, 4)
    endless.look()
    assert endless.calls == 4
