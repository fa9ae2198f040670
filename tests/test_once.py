"""What a stage does to each answer and each case is done once: answers are decoded once, claims are chosen after one exchange, and symbols that no fact may be about are not made."""

from __future__ import annotations

import random

from revlens.functions import answers
from revlens.operators import anchoring, changes, diff, symbols
from revlens.plans import stages
from revlens.sources import model
from tests.cases import claims, frame, make_case

SOURCE = """import os as _os, b._c
from x import _y as z, _w
_a = B = C.d = 1; _e[0] = [(_f := 2), 3]; (_g, H) = "s", _a
X: int = 3
@_deco
class K(_Base, metaclass=_M):
    _in = -1
    def _m(self, _p=lambda: _q, *, _r: _ann) -> _ret:
        try: _s = self._t.u
        except _Err as _name: V = 1.5
        else: del _s
        finally: [_i for _i in _j if not _k and _l < 3]
async def f():
    match _subject:
        case {"k": _v}: W = None
    return f"{_fs!r}" + (yield _z)
V = 'two'
"""


def test_what_facts_ask_is_found_in_the_order_of_all_symbols():
    every = [(n, r, line, top and r == "assign", t, v) for n, r, line, _, _, top, t, v, _ in symbols.symbols_of(SOURCE) if r in ("def", "assign") or (r in symbols.USES and n.startswith("_"))]
    asked = symbols._asked(SOURCE)
    assert [(n, r, line, top and r == "assign", t, v) for n, r, line, _, top, t, v in asked] == every and len(every) > 30
    assert [x[3] for x in asked] == sorted(x[3] for x in asked)
    assert symbols._asked("def (") == []


def test_symbols_that_no_fact_is_about_are_not_made():
    head, context = {"a.py": "x = f()\n_one = g()\nTWO = 2\n", "b.py": "Y = 2\nZ = 3\n_b = h()\n", "c.md": "_one"}, [("l.py", "print(_one, _two)"), ("m.py", "MANY = 3\n")]
    of = lambda added: [(x[0], x[2], x[3]) for x in symbols._asked_of_case(head, context, added)]
    assert of({}) == of({"a.py": [1]}) == of({"c.md": [1]}) == []
    assert of({"a.py": [2]}) == [("a.py", "_one", "assign"), ("a.py", "_one", "store"), ("l.py", "_one", "load")]
    assert of({"a.py": [3]}) == [("a.py", "TWO", "assign"), ("b.py", "Y", "assign")]


def test_an_answer_is_decoded_once(spark):
    rows = spark.createDataFrame([("c", '{"findings": [{"file": "a.py", "line": 1}, 3]}'), ("d", "[")], "case_id string, text string")
    for found, n in zip(answers.parse_answers(rows), (1, 2), strict=True):
        assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
        assert found.count() == n


def test_claims_are_chosen_after_one_exchange(spark):
    cases = frame(spark, [make_case(f"c{k}", {"a.py": "x = 1\n"}, {"a.py": "y = 1\n"}) for k in range(3)])
    got = stages.detect(changes.split(cases), model.SilentStub)
    assert got["claims"]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_scope_reads_the_kinds_of_files_in_the_row(spark):
    cases = frame(spark, [make_case("c", {"a.py": "x = 1\n"}, {"a.py": "y = 1\n"}), make_case("d", {"a.md": "x"}, {"a.md": "y"}), make_case("e", {"a.md": "x", "g.py": "x"}, {"a.md": "y"})])
    stored = changes.split(cases)
    made = claims(spark, [(k, "a.py", 1, "xss", 0.5, "q") for k in "cdex"])
    got = anchoring.scope(made, stored)
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    joined = anchoring.scope(made, changes.Changes(stored.cases, stored.files, stored.blobs))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, joined.collect()))


def test_deleted_lines_that_came_back_are_cancelled_one_by_one():
    rng = random.Random(3)
    for _ in range(200):
        rows = [rng.choice("+- ") + rng.choice(["a", " a", "b ", "b", ""]) for _ in range(rng.randrange(1, 12))]
        old, new = sum(r[0] != "+" for r in rows), sum(r[0] != "-" for r in rows)
        text = "\n".join([f"diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n@@ -1,{old} +1,{new} @@", *rows])
        back: dict[str, int] = {}
        for r in rows:
            if r[0] == "+":
                back[r[1:].strip()] = back.get(r[1:].strip(), 0) + 1
        left = []
        for k, r in enumerate(rows):
            if r[0] == "-":
                key = r[1:].strip()
                back[key] = back.get(key, 0) - 1
                if back[key] < 0:
                    left.append(("f.py", k + 4, r[1:]))
        assert [(p, i, t) for p, _, i, t in diff._gone_from(text)] == left


def test_names_that_nothing_can_be_said_of_are_not_shipped():
    of = lambda text, added: symbols._asked_of_case({"a.py": text}, [("l.py", "def f():\n    INNER = 2\nTWO = 2\n")], {"a.py": added})
    assert of("ONE = 1\nONE = 1\n", [1, 2]) == of("TWO = 2\n", [1]) == of("T = f()\n", [1]) == []
    assert len(of("ONE = 1\nTOO = 2\nONE = 2\n", [1])) == 0
    assert {x[2] for x in of("def g():\n    IN = 2\n", [2])} == {"IN", "TWO"}
    assert {x[2] for x in of("ONE = 1\nTOO = 2\nONE = 2\n", [1, 2])} == {"ONE", "TOO", "TWO"}


def test_rows_are_numbered_as_a_format_would(spark):
    from pyspark.sql import functions as F

    from revlens.functions.text import numbered

    rows = spark.createDataFrame([(n, a, t) for n in (1, 12345, 99_999, 100_000, 1_234_567) for a in (True, False, None) for t in ("", " x | y")], "n int, a boolean, t string")
    for r in rows.select("n", "a", "t", numbered(F.col("n"), F.col("a"), F.col("t")).alias("row")).collect():
        assert r["row"] == "%5d %s | %s" % (r["n"], "+" if r["a"] else " ", r["t"])


def test_plain_settings_are_read_without_the_parser(monkeypatch):
    rng = random.Random(5)
    pieces = ["A = 1", "_b = 20", "C = 'x'", 'D = "a b\'c"', 'E = ""', "", "F = 0", "_g = 007", "H = 1_0", "if = 2", "I = 3 # no", " J = 1", "K: int = 1", "_b = 20", "L = -1", 'M = "\\n"', "N  = 1", "__o = 2", "P = 1; Q = 2"]
    for _ in range(300):
        text = "\n".join(rng.choices(pieces, k=rng.randrange(5)))
        plain = symbols._asked_plainly(text)
        with monkeypatch.context() as m:
            m.setattr(symbols, "_asked_plainly", lambda _: None)
            parsed = symbols._asked.__wrapped__(text)
        assert plain is None or plain == parsed
    assert len(symbols._asked_plainly('_a = 1\n\nB = "x"\n')) == 3 and symbols._asked_plainly("x = f()") is None
    with monkeypatch.context() as m:
        m.setattr(symbols, "parsed", lambda _: 1 / 0)
        assert symbols._asked.__wrapped__("ONE = 1\n") == [("ONE", "assign", 1, 1, True, "int", "1")]


def test_files_that_hold_no_answer_are_not_parsed(monkeypatch):
    rng = random.Random(7)
    lines = ["x = 1", "_y = 1", "(z) = 1", "def _f():", "    w = _y", "    pass", "class K:", "    assert 3", "import os; v = 2", "u = \\", "  2", "t = [", "]", '"""', "@deco", "# _y = 1", "print(_y)", "s = r = 2.5", "é = 1"]
    cases = [{p: "\n".join(rng.choices(lines, k=rng.randrange(1, 7))) for p in ("a.py", "b.py")} for _ in range(2000)]
    added = [{"a.py": rng.sample(range(1, 8), 3)} for _ in cases]
    of = lambda: [sorted(symbols._asked_of_case({"a.py": c["a.py"]}, [("b.py", c["b.py"])], n)) for c, n in zip(cases, added, strict=True)]
    found = of()
    monkeypatch.setattr(symbols, "_may_define", lambda *_: True)
    monkeypatch.setattr(symbols, "_may_answer", lambda *_: True)
    assert found == of() and sum(map(bool, found)) > 60
    monkeypatch.undo()
    monkeypatch.setattr(symbols, "_asked", lambda _: 1 / 0)
    assert symbols._asked_of_case({"test_a.py": "def test_a():\n    assert 7\n"}, [], {"test_a.py": [2]}) == []


def test_claims_are_chosen_in_their_row_as_by_windows(spark):
    from pyspark.sql import functions as F

    from revlens.operators import claims as reduce

    rng = random.Random(9)
    rows = [(f"c{c}", k, rng.choice("ab"), rng.randrange(1, 5), rng.choice([0.1, 0.5, 0.5, 1.0])) for c in range(30) for k in range(rng.randrange(12))]
    table = spark.createDataFrame(rows, "case_id string, ord long, file string, line int, confidence double")
    by_case = table.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", "file", "line", "confidence"))).alias("claims"))
    for limit in (0, 3):
        chosen = by_case.select("case_id", F.inline(reduce.chosen(F.col("claims"), limit))).collect()
        assert sorted(chosen) == sorted(reduce.cap(reduce.best_per_line(table), limit).select("case_id", "ord", "file", "line", "confidence").collect())


class _Accuser:
    """Quotes what it is shown, and other things."""

    name = "stub"

    def complete(self, system, user, schema=None):
        rows = [x.partition(" | ")[2] for x in user.split("\n") if " | " in x]
        said = [{"file": f, "line": n % 5 + 1, "type": "xss", "title": "t", "confidence": 0.5 + n % 3 / 10, "quote": q} for n, q in enumerate([*rows, "no such row", "ab"]) for f in ("a.py", "b.md", "l.py", "g.py")]
        return model.Response(text=answers.render_answer(said) if "quiet" not in user else "nope")


def test_claims_are_held_to_the_change_beside_their_answers(spark, monkeypatch):
    texts = ["x = 1\n\ty  =  2 \n\n", "| a = 1\n  12 + | long\n  3 | \n \n", "a = '\\\\\\\\d'\r\nstraße = Σ  1 \r\n", "", "one()\ntwo()\n" * 4, "\n\n  deep = 1"]
    made = [make_case(f"c{k}", {"a.py": old, "b.md": "b", "l.py": "def f(): pass"}, {"a.py": new, "b.md": "c", "g.py": "new_one = 1\n", "l.py": "def f(): pass"}) for k, (old, new) in enumerate((o, n) for o in texts for n in texts if o != n)]
    made.append(make_case("quiet", {"a.py": "quiet = 1"}, {"a.py": "quiet = 2"}, pr_title="quiet"))
    stored = changes.split(frame(spark, made))
    joined = changes.Changes(stored.cases, stored.files, stored.blobs)
    parts = ("packs", "responses", "rejects", "claims", "scope", "anchors", "predictions")
    for limit in (0, 6):
        plain = stages.detect(joined, _Accuser, limit)
        want = {p: sorted(map(repr, plain[p].collect())) for p in parts}
        assert len(want["predictions"]) > 50 and len(want["rejects"]) == 1
        got = stages.detect(stored, _Accuser, limit)
        assert "Exchange" not in got["anchors"]._jdf.queryExecution().executedPlan().toString() and "Join" not in got["scope"]._jdf.queryExecution().executedPlan().toString()
        for p in parts:
            assert sorted(map(repr, got[p].select(*plain[p].columns).collect())) == want[p], p
    monkeypatch.setattr(diff, "LONG", 150)  # some of the cases are small
    got = stages.detect(stored, _Accuser)
    for p in parts[1:]:
        assert sorted(map(repr, got[p].select(*plain[p].columns).collect())) == want[p], p
