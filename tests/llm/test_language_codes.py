"""op6's n-grams over pieces, its ambiguity flag, and the decoding against plain loops."""

import math
import random

import numpy as np

from revlens.llm import langid, queries

from .conftest import doc
from .test_operators import LANGS, _lang_rows


def test_pieces_do_not_change_the_counts(monkeypatch):
    r = random.Random(1)
    for _ in range(100):
        text = "".join(r.choice("abcé  1,\nßǅ") for _ in range(r.randint(0, 80))).encode()
        whole = langid.ngram_bins(text)
        for piece in (1, 2, 3, 7):
            monkeypatch.setattr(langid, "_PIECE", piece)
            cut = langid.ngram_bins(text)
            assert (whole is None) == (cut is None) and (whole is None or (whole == cut).all())
        monkeypatch.setattr(langid, "_PIECE", 1 << 20)


def test_decoding_and_ambiguity(make_docs, spark, tmp_path):
    rows = _lang_rows(400)
    half = [doc(5000 + k, " ".join("".join(random.Random(k * 50 + j).choice(LANGS["aa" if j % 2 else "bb"]) for _ in range(2)) for j in range(40))) for k in range(30)]
    model = langid.train(make_docs(rows))
    got = {r["doc_id"]: r for r in langid.predict(make_docs(rows + half), model).collect()}
    for doc_id, text, *_ in rows[:60] + half:
        counts = langid.ngram_bins(text.encode())
        mean = counts @ model.weights / counts.sum()
        loss = [sum(model.reliable[k][b] * math.log1p(math.exp(-model.code[k][b] * min(8, max(-8, model.scale * mean[b])))) for b in range(model.code.shape[1])) for k in range(len(model.languages))]
        best, second = sorted(loss)[:2]
        r = got[doc_id]
        assert r["lang_pred"] == model.languages[int(np.argmin(loss))] and r["ambiguous"] == (second - best < langid.MARGIN)
        assert abs(r["score"] - 1 / sum(math.exp(best - x) for x in loss)) < 1e-6
    plain = [got[r[0]]["ambiguous"] for r in rows if len(r[1].split()) > 20]
    mixed = [got[r[0]]["ambiguous"] for r in half]
    assert sum(plain) == 0 and sum(mixed) > 0
    strict = langid.train(make_docs(rows), margin=1e9)
    assert all(r["ambiguous"] for r in langid.predict(make_docs(rows[:20]), strict).collect())
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert "ambiguous" in queries.op6_language_id(spark, str(tmp_path)).columns
