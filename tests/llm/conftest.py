import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, size long, row string, pos int, "
    "fp string, held_out int, score string, decon string, line_dedup string, _doc long, _row long, _lines string, cell string, host string"
)
EXTRA = (5, True, 9, "r", 7, "f", 3, "s", "d", "l", 1, 2, "x", "c", "h")
WORDS = "the and over lamp river stone quiet green market paper winter signal copper garden letter".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def doc(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: spark.createDataFrame([r if len(r) > 5 else doc(*r) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, one doc_id with two texts, odd characters."""
    long_line = prose(1, 30)
    return [
        doc(1, prose(2, 60)), doc(2, prose(2, 60)), doc(2, prose(2, 60)), doc(3, None), doc(4, ""), doc(5, " \t\n\x0b \n"), doc(None, prose(3, 40)), doc(None, None, None, None),
        doc(6, prose(4, 50), None, None), doc(6, prose(5, 50), "de", None), doc(7, "word"), doc(8, "ǅ İ ſ 😀   \x85   ẞ"), doc(9, prose(6, 60000)), doc(10, "a" * 300_000),
        doc(11, "\n".join([long_line] * 3 + ["x"])), doc(12, long_line.upper() + " \r\n" + long_line), doc(13, long_line), doc(14, "\t" + long_line), doc(15, long_line), doc(-3, long_line + "\n\n"),
        doc(16, "A\x00b\x1c \x1f c"), doc(2**62, prose(7, 30), "fr", "é"), doc(17, prose(7, 30), "fr", "z"),
    ]
