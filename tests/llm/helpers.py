"""Small tables for the tests of this folder."""

SF = "/root/testdata/sf0.001"
DOCS = f"{SF}/documents.parquet"
#: Texts that no operator may stumble over.
ODD = [None, "", " \t\n", "a", "é ß ñ 中文 🙂", "word " * 30_000, "x" * 200_000, "a b c\x85d", "\x00\x1f \x7f", "|||", "İΣς ﬁ"]


def documents(spark, rows):
    """documents of (doc_id, text), with columns whose names operators might use themselves."""
    return spark.createDataFrame(
        [(i, t, "en", f"src{n % 3}", len(t or ""), n, "u", n, n) for n, (i, t) in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n_chars long, id int, unit string, row int, spans int",
    )


def odd_documents(spark):
    return documents(spark, [(i, t) for i, t in enumerate(ODD)] + [(0, None), (3, "a"), (None, "a"), (None, None)])
