"""Each operator on edge cases and on a generated corpus, held against a plain version of itself."""

import io
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from revlens.llm import decontam, html, langid, linededup, mixing, quality, simhash, suffixdedup, suffixsort, toxicity, warc

from . import brute
from .conftest import WORDS, doc, prose


def key(row):
    return tuple((x is None, str(x)) for x in row)


def same(got, wanted):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, wanted), key=key)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared lines and passages, a hot source."""
    r, rows = random.Random(4), []
    shared = [prose(100 + k, 45) for k in range(4)]
    for k in range(160):
        parts = [prose(1000 + k * 7 + j, r.randint(1, 70)) for j in range(r.randint(1, 4))]
        if r.random() < 0.5:
            parts.insert(r.randint(0, len(parts)), r.choice(shared))
        if r.random() < 0.2:
            parts.append(parts[0])
        rows.append(doc(k, "\n".join(parts), "en", "s0" if r.random() < 0.4 else f"s{r.randint(1, 5)}"))
    for k in range(160, 200):
        text = rows[r.randrange(20)][1]
        rows.append(doc(k, text if r.random() < 0.5 else text + " " + r.choice(WORDS), "en", "s9"))
    return rows


def test_mixing(make_docs, corpus, edge_rows):
    for rows in (corpus, [r for r in edge_rows if r[0] not in (2, None)]):
        got = mixing.mix_sources(make_docs(rows)).collect()
        wanted = brute.mix(rows)
        same([(r["doc_id"], r["source"], r["size"], round(r["target"], 6), r["taken"]) for r in got], [(a, b, c, round(d, 6), e) for a, b, c, d, e in wanted])
    assert mixing.mix_sources(make_docs(edge_rows)).count() == len(edge_rows)
    assert mixing.mix_sources(make_docs([])).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(make_docs([doc(1, None), doc(2, "")])).collect()] == [0, 0]


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5000), (None, 7)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 21 and got["b"] == 3000 and abs(got["c"] - (6017 - 3051)) < 1e-9
    assert mixing.source_targets(sizes.limit(0)).count() == 0


def test_quality(make_docs, corpus, edge_rows):
    rows = edge_rows + corpus
    got = quality.apply_rules(make_docs(rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same([(r["doc_id"], *[r[n] for n in names]) for r in got], [(r[0], *brute.quality(r[1])) for r in rows])
    assert all(r["kept"] == (not r["base_failed"] and not r["host_rejected"]) for r in got)
    kept = quality.keep_good(make_docs(rows))
    assert kept.columns == make_docs([]).columns
    same([(r["doc_id"], r["text"]) for r in kept.collect()], [(r[0], r[1]) for r, g in zip(rows, [brute.quality(r[1])[-1] for r in rows], strict=True) if not g and not _rejected(got, r)])
    assert quality.apply_rules(make_docs([])).count() == 0 == quality.keep_good(make_docs([])).count()


def _rejected(got, row):
    return next(r["host_rejected"] for r in got if r["host"] == row[3])


def test_hosts_are_shrunk(make_docs):
    rows = [doc(k, prose(k, 40), "en", f"h{k % 12}") for k in range(240)] + [doc(1000 + k, "short", "en", "junk") for k in range(60)] + [doc(2000, "short", "en", "tiny"), doc(3000, prose(1, 40), "en", "junk")]
    got = {r["host"]: r for r in quality.apply_rules(make_docs(rows)).collect()}
    assert got["junk"]["host_rejected"] and not got["tiny"]["host_rejected"] and not got["h1"]["host_rejected"]
    assert 0.8 < got["junk"]["host_rate"] < 60 / 61 and got["tiny"]["host_rate"] < 1
    assert quality.beta_prior(0, 0, 0, 0.0) == (0.5, 0.5)


def test_simhash(make_docs, corpus, edge_rows, monkeypatch):
    rows = edge_rows + corpus
    prints = [brute.simhash(r[1]) for r in rows]
    group = brute.components(prints)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[group[p]] = min(least.get(group[p], r[0]), r[0])
    wanted = [(r[0], p - (1 << 64) if p >> 63 else p, least.get(group.get(p))) for r, p in zip(rows, prints, strict=True)]
    for cap in (512, 1):  # with buckets of 1 every link comes from the values around fingerprints
        monkeypatch.setattr(simhash, "BUCKET", cap)
        got = simhash.near_duplicates(make_docs(rows)).collect()
        same([(r["doc_id"], r["fp"], r["component_id"]) for r in got], wanted)
    assert simhash.near_duplicates(make_docs([])).count() == 0
    kept = simhash.keep_one(make_docs(rows)).collect()
    rows_of = {}
    for r, p in zip(rows, prints, strict=True):
        rows_of.setdefault(group[p], set()).add((r[0] is None, r[0] or 0, r[1] or ""))
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == Counter(min(v)[:2] for v in rows_of.values())
    assert kept[0].asDict().keys() == set(make_docs([]).columns) and simhash.keep_one(make_docs([])).count() == 0


def test_simhash_links_within_two_bits(spark, monkeypatch):
    r = random.Random(8)
    prints = {r.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        for _ in range(12):
            prints.add(p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) * r.randint(0, 1))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    group, named = brute.components(prints), {}
    for p, s in zip(prints, signed, strict=True):
        named[group[p]] = min(s, named.get(group[p], s))
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    from revlens.llm.graph import components

    for cap in (512, 3, 1):
        monkeypatch.setattr(simhash, "BUCKET", cap)
        found = {x["node"]: x["component"] for x in components(simhash._links(df)).collect()}
        assert [found.get(s, s) for s in signed] == [named[group[p]] for p in prints]
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for a in range(64):
        for b in range(64):
            assert any(not (m >> a & 1 or m >> b & 1) for m in masks)


def test_components_of_a_long_chain(spark):
    from revlens.llm.graph import components

    links = [(k, k + 1) for k in range(200)] + [(300, 301), (301, 300), (302, 302)] + [(400, 500 + k) for k in range(50)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 201)} | {301: 300} | {500 + k: 400 for k in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(make_docs, corpus, edge_rows):
    for rows in (corpus, edge_rows + corpus):
        got = linededup.dedup_lines(make_docs(rows)).select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("text").cast("binary"), 256)).collect()
        same(got, brute.line_dedup(rows))
        assert sum(r["n_dropped"] for r in got) > 0
    assert linededup.dedup_lines(make_docs([])).count() == 0


def test_line_dedup_of_many_lines(make_docs):
    common = [prose(k, 12) for k in range(300)]
    rows = [doc(k, "\n".join(x if (n + k) % 3 else x.upper() for n, x in enumerate(common) if (n * 7 + k) % 5)) for k in range(9)]
    got = linededup.dedup_lines(make_docs(rows)).select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("text").cast("binary"), 256)).collect()
    same(got, brute.line_dedup(rows))


def test_suffix_sort():
    for t in range(200):
        r = random.Random(t)
        strings = [bytes(r.choice(b"ab\0\xff") for _ in range(r.choice([0, 3, 8, 16, 33, 70]))) for _ in range(r.randint(0, 40))]
        base = bytes(r.choice(b"ab") for _ in range(60))
        strings += [base + s for s in strings] + strings[:5]
        assert [strings[k] for k in suffixsort.deep_shallow_order(strings, range(len(strings)))] == sorted(strings)


def test_suffix_dedup(make_docs, corpus, edge_rows, monkeypatch):
    monkeypatch.setattr(suffixdedup, "_BLOCK", 700)  # long texts in several blocks
    rows = [r for r in edge_rows if r[0] not in (9, 10)] + corpus + [doc(900, "ab" * 900), doc(901, "ba" * 120 + "x"), doc(902, "é" * 150)]
    for cap in (4096, 2):  # a small cap sends most edges through the count of windows
        monkeypatch.setattr(suffixdedup, "GROUP", cap)
        got = suffixdedup.remove_repeats(make_docs(rows)).collect()
        same([(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in got], brute.repeats(rows))
    assert suffixdedup.remove_repeats(make_docs([])).count() == 0


def test_anchors_cover_every_window():
    text = prose(5, 4000).encode()
    runs = list(suffixdedup.anchors(text))
    assert [w for _, a, b, _ in runs for w in range(a, b + 1)] == list(range(len(text) - 199))
    assert all(b <= at <= a + 168 for at, a, b, _ in runs)


def test_decontamination(spark, make_docs, corpus, edge_rows, monkeypatch):
    items = [(1, corpus[3][1][:300]), (2, "ſtone 😀 river"), (3, prose(100, 45)), (4, ""), (5, None), (3, prose(55, 30)), (None, prose(101, 45)), (6, "word"), (7, "İ ſ"), (8, " ".join(prose(102, 45).split()[5:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = edge_rows + corpus
    wanted = brute.contamination(rows, [("null" if i is None else i, t) for i, t in items])
    columns = ("doc_id", "decon.n_words", "decon.n_hit", F.size("decon.items"), F.sha2(F.array_join("decon.items", ",").cast("binary"), 256), "decon.contaminated")
    for words in (decontam.BLOCK_WORDS, 40):  # the second: several blocks
        monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
        same(decontam.find_contamination(make_docs(rows), bench).select(*columns).collect(), wanted)
    clean = decontam.remove_contaminated(make_docs(rows), bench)
    assert clean.columns == make_docs([]).columns
    same([(r["doc_id"],) for r in clean.collect()], [(w[0],) for w in wanted if not w[-1]])
    assert decontam.find_contamination(make_docs([]), bench).count() == 0
    nothing = decontam.find_contamination(make_docs(rows), bench.limit(0)).select("decon.*").collect()
    assert len(nothing) == len(rows) and not any(r["contaminated"] for r in nothing)


def test_longest_matches_have_places(spark, make_docs):
    passage = prose(77, 40).split()
    rows = [doc(1, prose(1, 9) + " " + " ".join(passage[4:30]) + " " + prose(2, 300))]
    m = decontam.find_contamination(make_docs(rows), spark.createDataFrame([(5, " ".join(passage))], "item_id long, text string")).first()["decon"]
    longest = max(m["matches"], key=lambda x: x["n_words"])
    assert (longest["item"], longest["item_word"], longest["doc_word"], longest["n_words"]) == ("5", 4, 9, 26) and m["contaminated"]


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    pages = [(k, f"http://h/{k} ü\r\nX: y", "<p>" + prose(k % 7, 90)) for k in range(40)] + [(50, None, None), (51, "u", ""), (None, "v", "<p>" + prose(1, 90)), (39, "again", "<p>" + prose(4, 90)), (60, "w", "\x00€")]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, payload int, sha string")
    manifest = warc.write_archives(df)
    assert manifest.count() > 3
    read = warc.read_archives(manifest).collect()
    same([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read], brute.archive(pages))
    texts = {p[0]: p[2] or "" for p in pages if p[1] != "again"}
    assert all(bytes(r["payload"]).decode() == texts[r["page_id"]] for r in read if r["record_type"] == "response" and r["page_id"] is not None and r["page_id"] != 39)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    big = warc.read_archives(warc.write_archives(df, min_bytes=10_000))
    assert {r["record_type"] for r in big.collect()} == {"response"}


class _Memory:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, size, offset):
        return self.data[offset : offset + size]


def test_zip_directories(monkeypatch):
    def archive(comment=b""):
        out = io.BytesIO()
        w = warc.ArchiveWriter(out)
        for k in range(5):
            w.add(k, "u", b"payload %d" % k, "D", None)
        w.zip.comment = comment
        w.close()
        return out.getvalue()

    for data in (archive(), archive(b"PK a comment")):
        records = [warc.parse_record(r)[2] for r in warc.ArchiveReader(_Memory(data)).records()]
        assert records == [b"payload %d" % k for k in range(5)]
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    wide = archive()
    assert b"PK\x06\x06" in wide and b"PK\x06\x07" in wide
    assert len(list(warc.ArchiveReader(_Memory(wide)).records())) == 5
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.INDEX, "x" * 100)
    for bad in (packed.getvalue(), b"no zip", archive()[:-30]):
        with pytest.raises(ValueError):
            list(warc.ArchiveReader(_Memory(bad)).records())


def test_html_layouts(spark):
    layouts, right, total = html._Layouts(321), 0, 0
    for _ in range(120):
        page = html.parse(layouts.page())
        marginals, told = html.content_marginals(page, html.trained_model()), set()
        for node, text, _ in page.texts:
            if node >= 0 and text.strip() and node not in told:
                told.add(node)
                right += (marginals[node] >= 0.5) == bool(int(page.labels[node] or 0))
                total += 1
    assert right / total > 0.96
    pages = [(1, "u", "<body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two&nbsp;<b>th</b>ree.<br>four</p><p>Ok.</article><footer>&copy; x</footer>"), (2, None, None), (3, "u", ""), (4, "u", "no tags &lt;"), (1, "u", "<article><p>" + "x " * 40000), (None, "u", "<div>" * 3000 + "deep"), (5, "u", "<a href='x" + "<" * 500)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert len(got) == len(pages) and all(r["text"] is not None for r in got)
    by_id = {r["page_id"]: r["text"] for r in got if r["page_id"] in (2, 3, 4)}
    assert by_id == {2: "", 3: "", 4: "no tags <"}
    assert "A & B One two three. four Ok." in {r["text"] for r in got}
    assert html.extract(df.limit(0)).count() == 0


def test_tree_marginals_are_exact():
    """Sum-product against the sum over all labelings."""
    import itertools
    import math

    page = html.parse("<body><div><p>one, two.</p><ul><li>x</li></ul></div><nav><a href=/>y</a></nav></body>")
    model = html.TreeModel({"t:p": 1.0, "t:nav": -1.5, "t:div": 0.3, "bias": -0.2, "l:2": -0.7})
    features, n = html.node_features(page), len(page.tags)
    scores = [sum(model.unary.get(f, 0.0) for f in fs) for fs in features]
    tables = [model.pair[html._KIND.get(t, "other")] for t in page.tags]
    weight, on = 0.0, [0.0] * n
    for state in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(s * x for s, x in zip(scores, state, strict=True)) + sum(tables[k][2 * state[page.parents[k]] + state[k]] for k in range(1, n)))
        weight += w
        on = [a + w * x for a, x in zip(on, state, strict=True)]
    assert all(abs(a / weight - p) < 1e-9 for a, p in zip(on, html.content_marginals(page, model), strict=True))


LANGS = {"aa": "kala mona tiru sabe lofa neki".split(), "bb": "schtu grau ferk delm zwon pfit".split(), "cc": "ou eaux lle çai vré qué".split(), "dd": "ción ñar lla esto mente rra".split()}


def _lang_rows(n):
    r = random.Random(2)
    rows = []
    for k in range(n):
        lang = r.choice(list(LANGS))
        rows.append(doc(k, " ".join("".join(r.choice(LANGS[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(2, 60))), lang))
    return rows


def test_language_id(make_docs, edge_rows):
    rows = _lang_rows(400)
    df = make_docs(rows)
    model = langid.train(df)
    got = langid.predict(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 40 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = langid.predict(make_docs(edge_rows), model).collect()
    assert len(odd) == len(edge_rows)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in odd if r["doc_id"] in (3, 4, 5))
    none = langid.train(make_docs([]))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"} and langid.predict(make_docs([]), model).count() == 0
    one = langid.train(make_docs([r for r in rows if r[2] == "aa"]))
    assert {r["lang_pred"] for r in langid.predict(df, one).collect()} == {"aa"}
    for n in (2, 4, 7, 12):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code}) == n


def test_maximal_segments():
    def plain(scores):
        """All maximal segments by recursion on the best one (the first, the shortest of ties)."""
        best = (0.0, 0, 0)
        for a in range(len(scores)):
            for b in range(a + 1, len(scores) + 1):
                s = round(sum(scores[a:b]), 9)
                if s > best[0] + 1e-12:
                    best = (s, a, b)
        s, a, b = best
        if not s:
            return []
        return plain(scores[:a]) + [(a, b - 1, s)] + [(x + b, y + b, z) for x, y, z in plain(scores[b:])]

    for t in range(150):
        r = random.Random(t)
        marked = sorted(r.sample(range(24), r.randint(0, 12)))
        values = [(k, r.choice([0.5, 0.71, 1.3, 2.9])) for k in marked]
        dense = [dict(values).get(k, -0.3) for k in range(24)]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(values)]
        assert got == [(a, b, round(s, 6)) for a, b, s in plain(dense)]


def test_toxicity(spark, make_docs, edge_rows):
    r, rows, labels = random.Random(6), [], []
    bad = "vexor grumt blasp".split()
    for k in range(600):
        toxic = k % 4 == 0
        text = prose(k, r.randint(20, 200)).split()
        if toxic:
            for _ in range(r.randint(1, 6)):
                text.insert(r.randrange(len(text)), r.choice(bad) + r.choice(["", "", "ing", "ed"]))
        rows.append(doc(k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    labels += [(None, 1, 1), (5, 1, None), (6, None, 0)]
    df, told = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, told)
    got = toxicity.score(df, model).collect()
    held = [x for x in got if x["held_out"]]
    right = sum(x["predicted"] == int(x["doc_id"] % 4 == 0) for x in held)
    assert len(held) > 80 and right / len(held) > 0.97 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)
    odd = toxicity.score(make_docs(edge_rows), model).collect()
    assert len(odd) == len(edge_rows) and all(x["predicted"] == 0 for x in odd if x["doc_id"] in (3, 4, 5))
    long = toxicity.score(make_docs([doc(1, prose(3, 30000) + " vexor grumt blasp vexor " + prose(4, 30000))]), model).first()
    assert long["predicted"] == 1 and long["passages"][0]["first"] == 30000
    assert {x["score"] for x in toxicity.score(df, toxicity.train(df, told.limit(0))).collect()} == {0.0}
    assert toxicity.score(make_docs([]), model).count() == 0
