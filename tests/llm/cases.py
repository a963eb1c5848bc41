"""Small tables with the odd rows that every operator must take."""

from pyspark.sql import types as T

DOCS = T.StructType.fromJson(
    {
        "type": "struct",
        "fields": [
            {"name": n, "type": t, "nullable": True, "metadata": {}}
            for n, t in [
                ("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"),
                ("n_chars", "long"), ("n_words", "string"), ("_extra", "integer"), ("kept", "string"),
            ]
        ],
    }
)

PLAIN = "The sun is up and the birds of the wood sing to it with joy in the early light"


def doc(doc_id, text, source="a"):
    # columns beyond `documents`, named like results and internals
    return (doc_id, text, "en", source, None if text is None else len(text), "x", 7, "mine")


def odd_docs(spark):
    long_text = " ".join(f"word{i % 977} of{i}" for i in range(60_000))
    rows = [
        doc(1, PLAIN),
        doc(1, PLAIN),
        doc(2, None),
        doc(3, ""),
        doc(4, " \t\n\x0b\x0c\r "),
        doc(5, "one"),
        doc(None, PLAIN + " again"),
        doc(6, PLAIN, None),
        doc(7, long_text),
        doc(8, "x" * 30_000),
        doc(9, "Ünïcödé 漢字 \U0001f600 e\u0301 \x00 \x1c \u2003 İ ß"),
        doc(10, PLAIN.upper(), "b"),
        (None,) * 8,
    ]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]
