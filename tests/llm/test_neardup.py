"""The pipeline's near-dedup against all pairs of texts."""

import random

import pytest

from revlens.llm import neardup

from .conftest import doc, prose


def _set(text):
    ws = (text or "").lower().split()
    return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}


def _kept(rows):
    """doc_ids that stay: of each component of pairs of similarity 0.8 the smallest."""
    sets, left, out = {r[0]: _set(r[1]) for r in rows}, {r[0] for r in rows}, set()
    while left:
        stack, group = [left.pop()], []
        while stack:
            group.append(stack.pop())
            near = {o for o in left if 5 * len(sets[o] & sets[group[-1]]) >= 4 * len(sets[o] | sets[group[-1]])}
            left -= near
            stack += near
        out.add(min(group))
    return out


@pytest.fixture(scope="module")
def near_rows():
    r, rows = random.Random(3), []
    for k in range(30):
        words = prose(k, r.randint(30, 150)).split()
        rows.append(doc(100 * k, " ".join(words)))
        for j in range(1, 12):  # on both sides of the limit, and chains of copies of copies
            base = words[:] if j % 3 else rows[-1][1].split()
            for _ in range(r.randint(0, 4)):
                base[r.randrange(len(base))] = r.choice(["other", "words", "here"])
            rows.append(doc(100 * k + j, " ".join(base)))
    return rows


def test_near_copies_go(make_docs, near_rows):
    rows = near_rows + [doc(9000, None), doc(9001, ""), doc(9002, "one two"), doc(9003, "One  two")]
    got = sorted(r["doc_id"] for r in neardup.keep_one(make_docs(rows)).collect())
    assert got == sorted(_kept(rows)) and len(got) < len(rows)
    assert neardup.keep_one(make_docs([])).count() == 0


def test_stage_drops_a_text_with_one_more_word(spark, make_docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [doc(k, prose(10 + k, 40 + k)) for k in range(6)]
    rows.append(doc(101, rows[4][1] + " lamp"))
    stage = [f for _, f in corpus_pipeline.STAGES][2]
    assert sorted(r["doc_id"] for r in stage(spark, make_docs(rows), str(tmp_path)).collect()) == list(range(6))


def test_covering_tables_find_all_fingerprints_within_two_bits():
    import numpy as np

    from revlens.llm.simhash import covering_masks

    r = random.Random(5)
    for _ in range(50):
        a = r.getrandbits(64)
        b = a ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
        assert any(a & m == b & m for m in covering_masks())
    one = neardup.shingles(prose(1, 300).encode())
    assert len(neardup.covers(one)) == 7 and neardup.covers(one) == neardup.covers(one.copy()) and neardup.covers(np.empty(0, np.uint64)) == []
    plain = [2 * sum(int(h) >> b & 1 for h in one) > len(one) for b in range(64)]
    fingerprint = sum(1 << b for b, x in enumerate(plain) if x)
    flipped = neardup.shingles((prose(1, 300) + " lamp").encode())
    near = bin(fingerprint ^ sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in flipped) > len(flipped))).count("1")
    assert near > 2 or set(neardup.covers(one)) & set(neardup.covers(flipped))
