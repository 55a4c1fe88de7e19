"""Small tables of hard cases shared by the tests of this subpackage."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
LONG = ("alpha beta gamma delta, " * 12_000) + "end."

DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, score double, piece int, "
              "key long, target double, id long, spans string, _row long, held_out string")
HARD_TEXTS = [None, "", "   \n\t ", "one", "two words", LONG, "same text here now again", "same text here now again", "ünï çödé 一二三 👍"]


def hard_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and
    extra columns whose names the operators use inside."""
    def row(i, t, source):
        return (i, t, "en", source, len(t or ""), 7, 0.5, 3, 9, 1.5, 4, "x", 11, "y")
    rows = [row(i, t, f"s{i % 3}") for i, t in enumerate(HARD_TEXTS)]
    rows += [rows[6], rows[6]]                                    # whole rows repeated
    rows += [(None, "no id", None, None, *[None] * 10), (20, None, None, None, *[None] * 10)]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
