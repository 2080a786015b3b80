"""Edge rows that every operator over documents must handle."""

EDGES = [
    (900001, None, "en", "src0", 0, "x"), (900002, "", "en", None, 0, "x"), (900003, "a b", None, "src1", 3, None), (900004, "A  B\n", "zz", "src1", 5, "x"), (900004, "A  B\n", "zz", "src1", 5, "x"),
    (None, "a b", None, None, None, None), (900005, None, None, None, None, None), (900006, "x " * 30000 + "tail", "en", "src2", 60004, "x"), (900007, " \n\t ", "fr", "src2", 4, "x"),
]


def documents(spark, sf, n=None):
    """The small table with edge rows, and with columns whose names might clash."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "n_chars", "'c' as _row")
    if n:
        docs = docs.filter(f"doc_id < {n}")
    edges = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long, _row string")
    return docs.unionByName(edges).repartition(3)


def collected(df):
    return [r.asDict() for r in df.collect()]
