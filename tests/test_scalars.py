import pytest
from pyspark.sql import functions as F

from moleval.functions import prompt as PR
from moleval.functions import scalars as S


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    (" 5.65.", 5.65), ("is 75.", 75.0), ("-5", 5.0), ("is -5.86.", -5.86), (".5x", 0.5),
    ("no number", None), (None, None),
])
def test_first_number(spark, text, expected):
    assert one(spark, S.first_number(F.col("x")), text) == expected


def test_first_number_last(spark):
    assert one(spark, S.first_number(F.col("x"), which="last"), "C1CC1 is 75.") == 75.0


def test_to_number(spark):
    assert one(spark, S.to_number(F.col("x")), "abc") is None
    assert one(spark, S.to_number(F.col("x")), "500.01") == 500.01


def test_count_letters(spark):
    assert one(spark, S.count_letter(F.col("x"), "n"), "CN(C)c1ncNn1") == 4
    assert one(spark, S.count_letter(F.col("x"), "o"), "O=C(O)co") == 3


def test_sum_list_and_answers(spark):
    assert one(spark, S.sum_list(F.col("x")), [1.5, 2.0], "x array<double>") == 3.5
    assert one(spark, S.sum_list(F.col("x")), [], "x array<double>") == 0.0
    js = '{"contributor_description": "a", "tpsa_numbers_list": [20.23, 17.07]}'
    assert abs(one(spark, S.parse_answer(F.col("x")), js) - 37.3) < 1e-12
    assert one(spark, S.parse_answer(F.col("x")), "85.4") == 85.4
    assert one(spark, S.parse_answer(F.col("x")), "junk") is None


def test_list_literal_roundtrip(spark):
    arr = one(spark, S.parse_list_literal(F.col("x")), "['Carbonyl group', 'Ether']")
    assert arr == ["Carbonyl group", "Ether"]
    assert one(spark, S.parse_list_literal(F.col("x")), None) is None
    txt = one(spark, S.list_literal(F.col("x")), ["a", "b"], "x array<string>")
    assert txt == "['a', 'b']"


def test_outlier_label_half_even(spark):
    df = spark.createDataFrame([(10.0, 7.325)], "c double, p double")
    assert df.select(S.outlier_label("c", "p")).first()[0].startswith("TPSA difference: 2.6")
    assert one(spark, S.label_base(F.col("x")), "m ($\\Delta$TPSA > 1)") == "m"


@pytest.mark.parametrize("smiles,ok", [
    ("CCO", True), ("c1ccncc1", True), ("CC(=O)[O-]", True), ("CCCl", False), ("C[Si](C)C", False),
    ("CS", False), ("", False), (None, False), ("[NH4+]", True), ("[13CH4]", True),
    ("ECONOMY", False), ("*CC", False), ("hello?!CO", False), ("CXYZ", False), ("CC(O", False), ("C)C(", False), ("C[NH3+", False), ("C%12CC", True),
])
def test_only_tokens(spark, smiles, ok):
    assert one(spark, S.only_tokens(F.col("x")), smiles) is ok


def test_prompt_components(spark):
    assert PR.components_of("tpsa_model_abcdef") == "bcdef"
    assert PR.components_of("tpsa_model_acf") == "cf"
    assert PR.components_of("direct_model") == ""
    assert PR.components_of("tpsa_model_abcdef_no_sig") == "bcdef"
    with pytest.raises(KeyError):
        PR.assemble_prompt("q", "bcdefz", "g", "n", "o", "t")
    df = spark.createDataFrame([("CCO", ["Alcohol"], 0, 1)], "q string, g array<string>, n int, o int")
    only_a = df.select(PR.assemble_prompt("q", "", "g", "n", "o", F.lit("t"))).first()[0]
    assert only_a == PR.PART_A.format(question="CCO")
    full = df.select(PR.assemble_prompt("q", "bd", "g", "n", "o", F.lit("t"))).first()[0]
    assert "comprising: ['Alcohol']. " in full and "each of the 0 nitrogen atoms, and 1 oxygen" in full
    with pytest.raises(KeyError):
        PR.assemble_prompt("q", "bz")
