"""Frames that hold the odd cases: nulls, empty and long texts, repeated rows, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _row string, _text string, kept string, _n_words long, size long, _key long, _host string"
PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone"


def frame(spark, rows):
    """rows: (doc_id, text[, source]); the other columns are there to clash."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "clash", "clash", "clash", "clash", 7, 7, 7, "clash") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (4, " \t\n "), (None, PROSE + " more"), (None, None), (5, PROSE, None), (6, long), (7, "é ü 漢字 \U0001f642\x00 x"), (8, "short")]
    return frame(spark, rows)
