"""Rows that every operator must bear: nulls, empty and long texts, ties, repeats, clashing names."""

LONG = "word " * 40_000 + "end"
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again"), (2, "The Quick brown fox jumps over the lazy dog again"),
    (3, None), (4, ""), (5, "   \n\t "), (None, "the quick brown fox jumps over the lazy dog again"), (6, LONG), (7, LONG),
    (2, "The Quick brown fox jumps over the lazy dog again"), (8, "Ünïcode Éa ée 漢字 ß ²½"), (9, None), (10, "x"),
]
NAMES = ("hash", "fp", "id", "row", "segment", "spans", "items", "key", "norm", "score", "kept", "topic", "weight", "path", "found__",
         "cell_source", "cell_lang", "source__", "lang__", "row_key_1__", "row_key_2__", "row_nth__")


def documents(spark, rows=TEXTS, clash=True):
    docs = spark.createDataFrame([(i, t, "en", "s1", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for name in NAMES if clash else ():
        docs = docs.withColumn(name, docs["n_chars"].cast("string"))
    return docs


def nothing(spark):
    return documents(spark, [])
