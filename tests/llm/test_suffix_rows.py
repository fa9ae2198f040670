"""op8 on many texts without doc_id."""

from revlens.llm import suffixdedup

from . import brute
from .conftest import doc, prose
from .test_operators import same


def test_texts_without_doc_id_are_told_apart(make_docs):
    passage = prose(1, 60)
    rows = [doc(None, prose(10 + k, 50) + " " + (passage if k % 3 else "") + " " + prose(9000 + k, 10)) for k in range(3000)]
    got = suffixdedup.remove_repeats(make_docs(rows)).collect()
    same([(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in got], brute.repeats(rows))


def test_very_long_texts(make_docs, edge_rows):
    shared = prose(3, 9000)
    rows = [*edge_rows, doc(100, shared + " " + prose(4, 40000)), doc(101, prose(5, 70) + " " + shared)]
    got = suffixdedup.remove_repeats(make_docs(rows)).collect()
    same([(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in got], brute.repeats(rows))


def test_repeated_rows_and_shared_doc_ids(make_docs):
    passage = prose(1, 60)
    rows = [doc(k % 40 if k % 3 else None, prose(10 + k, 50) + " " + (passage if k % 2 else "") + " " + prose(9000 + k, 10)) for k in range(400)]
    rows += rows[:30]
    got = suffixdedup.remove_repeats(make_docs(rows)).collect()
    same([(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in got], brute.repeats(rows))


def test_the_sort_decides_every_repeated_anchor(make_docs, monkeypatch):
    """Whatever occurs twice, whole copies too, goes through the suffix arrays."""
    seen = []
    kept = suffixdedup.materialize

    def spy(df, name):
        out = kept(df, name)
        if name == "contexts":
            seen.append((out.filter("large").count(), out.count()))
        return out

    monkeypatch.setattr(suffixdedup, "materialize", spy)
    text = prose(8, 300)
    rows = [doc(1, text), doc(2, text), doc(3, prose(9, 300))]
    got = {r["doc_id"]: r["n_removed"] for r in suffixdedup.remove_repeats(make_docs(rows)).collect()}
    assert got == {1: len(text), 2: len(text), 3: 0}
    assert seen[0][0] == 0 and seen[0][1] >= len(text) // 200
