import golden
import pytest
from pyspark.sql import functions as F

from glossweave.functions import entries as E
from glossweave.functions import text as T
from glossweave.functions.variants import char_variants, variants


def column(spark, values, expr):
    """Values of `expr` over a one-column table, in input order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r.v for r in rows.select("i", expr.alias("v")).orderBy("i").collect()]


def test_split_and_clean(spark):
    blocks = [g[0] for g in golden.SPLITS]
    position = E.split_position(F.col("s"))
    words = column(spark, blocks, E.headword_at(F.col("s"), position))
    definitions = column(spark, blocks, E.definition_at(F.col("s"), position))
    assert words == [g[1] for g in golden.SPLITS]
    assert definitions == [g[2] for g in golden.SPLITS]
    assert all(column(spark, blocks, E.is_definition_line(F.col("s"))))


def test_variants(spark):
    got = column(spark, [g[0] for g in golden.VARIANTS], variants("s"))
    assert got == [g[1] for g in golden.VARIANTS]


def test_variant_details(spark):
    raw = ["Fátt[o] _or_ fátta", "Abcdé, x, y z", "Máre, xy, zw", "Bánd[o], u"]
    got = column(spark, raw, variants("s"))
    assert got == [
        ["Fátt[o]", "Fátta"],
        ["Abcdé", "X", "Y z"],
        ["Máre", "Xy", "Zw"],
        ["Bánd[o]", "V"],
    ]


def test_char_variants(spark):
    got = column(spark, ["u", "ú", "v", "à", "b", "["], char_variants("s"))
    assert [set(g) for g in got] == [
        set("uvú"), set("úvu"), set("vu"), set("àa"), set("b"), set("["),
    ]


def test_references(spark):
    got = column(
        spark, [g[0] for g in golden.REFERENCES], E.extract_references(F.col("s"))
    )
    assert got == [g[1] for g in golden.REFERENCES]


def test_references_parity_and_listing(spark):
    got = column(
        spark,
        ["plain _it_ rest", "_a_ a, b, c, d _x_ Word.", "_x_ One bit. Two", "_only._"],
        E.extract_references(F.col("s")),
    )
    assert got == [["it"], ["Word"], ["One bit. Two"], []]


@pytest.mark.parametrize(
    "rule, cases",
    [
        (T.printable, golden.PRINTABLE),
        (T.printable_normalised, golden.NORMALISED),
        (T.vector_key, [("Dissegnáre, &c.", "dissegnare c"), ("Ẻssere", "essere")]),
        (T.strip_marks, [("V´nǵeré", "Vngere"), ("áb", "ab"), ("ø đ", "ø đ")]),
        (T.capitalise, [("udíj", "Vdíj"), ("Uno", "V`no"), ("úno", "Úno"), ("", "")]),
        (T.italic_toggle, [("_as_ X, _y", "<i>as</i> X, <i>y</i>"), ("a", "a")]),
        (T.superscript_tags, [("M^r. x^2", "M<sup>r</sup>. x<sup>2</sup>")]),
        (T.html_brackets, [("c[o]sa", "c<em>o</em>sa")]),
        (T.decode_term, [("a+b%C3%A0", "a bà"), ("  ", None), ("%zz", None)]),
    ],
)
def test_text_rules(spark, rule, cases):
    assert column(spark, [c[0] for c in cases], rule(F.col("s"))) == [
        c[1] for c in cases
    ]


def test_markup_and_sparse_text(spark):
    runs = column(spark, ["_as_ X"], T.markup_runs(F.col("s")))[0]
    assert [tuple(r) for r in runs] == [(0, "as", True), (1, " X", False)]
    row = spark.range(1).select(
        T.sparse_text(F.array(*[F.lit(float(v)) for v in (0, 2, 0, 1.5)])).alias("t")
    )
    assert row.first().t == "[{1: 2}, {3: 1.5}]"


def test_superscript_list(spark):
    assert column(spark, ["M^r. x^2"], T.superscripts(F.col("s"))) == [["r", "2"]]
