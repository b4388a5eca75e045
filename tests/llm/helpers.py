"""Rows that every operator on texts has to bear."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, block string, node int"
LONG = "ab cd " * 40_000 + "x" * 70_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44, 1, "b", 1),
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44, 1, "b", 1),
    (2, None, "en", "a", None, None, None, None),
    (3, "", None, None, 0, 0, "", 0),
    (4, " \n\t ", "de", "b", 4, 0, "", 0),
    (None, "Null ids keep their texts", "en", "a", 25, 0, "", 0),
    (5, LONG, "en", "a", len(LONG), 0, "", 0),
    (6, "Ünïcödé é́ 漢字 … <|endoftext|> it's 42", "fr", None, 36, 0, "", 0),
]


def documents(spark, rows=ROWS):
    """Documents with extra columns whose names operators might use themselves."""
    return spark.createDataFrame(rows, DOCUMENTS)


def by_text(rows, column="doc_id"):
    return sorted(rows, key=lambda r: (r[column] is None, r[column] or 0))
