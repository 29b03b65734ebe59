"""Rows every operator has to take: nulls, blanks, ties, repeats, long texts, clashing columns."""

LONG = "ein sehr langer text mit vielen worten " * 4000

DOCS = [
    (1, "The cat sat on the mat and looked at the dog", "en", "a"),
    (2, "the  cat sat\ton the mat and looked at the dog", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \t\n\x0b\x0c\r", "de", None),
    (6, "Ünïcode ▁ tëxt 🙂 mit Ääää und   anderem Raum", "de", "b"),
    (7, LONG, "de", "a"),
    (8, LONG, "de", "c"),
    (9, "one two", "en", "c"),
    (9, "one two", "en", "c"),
    (None, "one two", "en", "c"),
    (10, "1234 5678 !!", "en", "a"),
    (11, "<|endoftext|> " + "x" * 3000, "en", "a"),
]

# Names that operators use inside or give out.
CLASHES = "size, source_size, target, rate, copies, key, copy, lang_pred, score, rejected, letter, piece_ids, n_pieces, lossless, row_key, cls, token, hash, norm, kept, DOC"


def documents(spark, rows=DOCS):
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    clashing = [f"'x{i}' AS {name.strip()}" for i, name in enumerate(CLASHES.split(","))]
    return plain.selectExpr("*", *clashing, "1 AS `dotted.name`")


def by_id(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[df.columns[0]] is None, str(r)))
