"""Small inputs that every operator must survive, and brute-force word lists."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, sequence_id long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, 1, 2) for i, t, lang in rows], DOCS)


ODD = [
    (0, None, None),
    (1, "", "en"),
    (2, "   \t\n", "en"),
    (3, "one two", None),
    (3, "one two", None),
    (4, "one two", "en"),
    (5, "1234 5678 !!", "en"),
    (6, "lorem ipsum dolor " * 3000, "la"),
    (None, "the cat sat on the mat and then the cat sat on the mat again today", "en"),
    (7, "éa ü \x0b ß\x85x  y", None),
]
