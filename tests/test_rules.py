import random

from pyspark.sql import functions as F

from conftest import fixture_path
from moleval.operators import rules as R
from moleval.sources import tables as SRC

# rule order: Ether (rank 0), Alcohol (rank 1); pattern_rank 0 = original
CASES = [
    ([("Ether", 0, 0, [1, 2]), ("Alcohol", 0, 0, [2, 3])], None),
    ([("Ether", 0, 0, [1, 2]), ("Ether", 0, 1, [2, 3])], ["Ether"]),
    ([("Ether", 0, 0, [1, 2]), ("Alcohol", 1, 0, [2, 3])], ["Ether", "Alcohol"]),
    ([("Ether", 0, 0, [1, 2]), ("Ether", 1, 0, [2, 3])], ["Ether"]),
    ([("Ether", 0, 0, [1, 2]), ("Alcohol", 0, 0, [4]), ("Alcohol", 1, 0, [2, 4])], ["Ether", "Alcohol"]),
]
RANK = {"Ether": 0, "Alcohol": 1}


def matches_df(spark, cases):
    rows = []
    for i, (ms, _) in enumerate(cases):
        for g, pr, no, pos in ms:
            rows.append((f"m{i}", RANK[g], g, pr, no, pos))
    return spark.createDataFrame(rows, "row_id string, group_rank int, group string, pattern_rank int, "
                                       "match_no long, positions array<int>")


def test_assign_groups_fold_micro(spark):
    got = {r["row_id"]: r["groups"] for r in R.assign_groups_fold(matches_df(spark, CASES), "row_id").collect()}
    for i, (_, expected) in enumerate(CASES):
        assert got[f"m{i}"] == expected, i


def test_no_groups_sentinel(spark):
    m = matches_df(spark, CASES[:1]).where("false").select("row_id", "group_rank", "group", "pattern_rank",
                                                            "match_no", F.col("positions")[0].alias("pos"))
    rows = spark.createDataFrame([("x",)], "row_id string")
    got = R.assign_groups(m, "row_id", rows=rows).first()
    assert got["groups"] == [R.NO_GROUPS] and got["n_assigned"] == 0


def test_window_form_equals_fold_on_single_positions(spark):
    rnd = random.Random(5)
    rows = []
    for r in range(150):
        for g in range(4):
            for pr in range(3):
                for p in rnd.sample(range(12), rnd.randint(0, 3)):
                    rows.append((f"r{r}", g, f"G{g}", pr, p, p))
    m = spark.createDataFrame(rows, "row_id string, group_rank int, group string, pattern_rank int, "
                                    "match_no long, pos int")
    fold = m.withColumn("positions", F.array("pos"))
    a = {r["row_id"]: r["groups"] for r in R.assign_groups(m, "row_id").collect()}
    b = {r["row_id"]: r["groups"] for r in R.assign_groups_fold(fold, "row_id").collect()}
    assert a == b
    assert any(v is None for v in a.values()) and any(v for v in a.values())


def test_unassigned_positions(spark):
    df = spark.createDataFrame([([1, 2, 5], [2, 3])], "targets array<int>, assigned_positions array<int>")
    r = R.unassigned_positions(df, "targets").first()
    assert r["unassigned"] == [1, 5] and r["n_unassigned"] == 2


def test_rules_to_long_and_validation(spark):
    rules = spark.createDataFrame([
        (1, "^a$", "A", " ^b$ ", None, None),
        (2, "[bad", "B", None, None, None),
        (3, "  ", "A", "^c$", None, None),
        (4, "^d$", "D", "(x", None, None),
    ], "rule_index int, original string, group string, new_1 string, new_2 string, new_3 string")
    lr = R.rules_to_long(rules)
    got = sorted((r["group"], r["pattern"], r["pattern_rank"], r["is_valid"], r["group_rank"])
                 for r in lr.collect())
    assert got == sorted([("A", "^a$", 0, True, 0), ("A", "^b$", 1, True, 0), ("A", "^c$", 2, True, 0),
                          ("B", "[bad", None, False, 1), ("D", "^d$", 0, True, 2),
                          ("D", "(x", None, False, 2)])
    assert [r["group"] for r in R.dropped_groups(lr).collect()] == ["B"]
    assert R.invalid_report(lr).first()["n_invalid"] == 2
    toks = R.tokenize(spark.createDataFrame([(1, "a  b c d a")], "id int, text string"), "id", "text")
    m = R.match_rules(toks, lr, "id").orderBy("pos").collect()
    assert [(r["group"], r["pos"]) for r in m] == [("A", 0), ("A", 1), ("A", 2), ("D", 3), ("A", 4)]


def test_study_rule_table_loads(spark):
    rules = SRC.read_rules(spark, fixture_path("tpsa_smarts.csv"))
    lr = R.rules_to_long(rules, validate=False)
    import pandas as pd
    names = pd.read_csv(fixture_path("tpsa_smarts.csv"))["Functional_Group_Name"].nunique()
    assert lr.select("group").distinct().count() == names
    assert lr.where("pattern_rank = 0").count() == names


def test_target_flag_equals_target_table(spark):
    rules = spark.createDataFrame([(1, r"^\d+$", "Number", r"^\d+\.\d+$", None, None),
                                   (2, r"^[A-Z]\w*$", "Word", None, None, None)],
                                  "rule_index int, original string, group string, new_1 string, new_2 string, new_3 string")
    lr = R.rules_to_long(rules)
    docs = spark.createDataFrame([(1, "A 12 b3 1.5 x"), (2, "no match here"), (3, "B7 7")], "id int, text string")
    toks = R.tokenize(docs, "id", "text")
    tflag = F.col("token").rlike(r"\d")
    a = R.assign_groups(R.match_rules(toks, lr, "id", flag=tflag), "id", rows=docs.select("id"),
                        target_flag="is_target")
    b = R.assign_groups(R.match_rules(toks, lr, "id"), "id", rows=docs.select("id"),
                        targets=toks.where(tflag).select("id", "pos"))
    rows_a = {r["id"]: tuple(r) for r in a.collect()}
    rows_b = {r["id"]: tuple(r) for r in b.collect()}
    assert rows_a == rows_b
    assert rows_a[1][3:] == (3, 1)          # targets 12, b3, 1.5; b3 is not covered


def test_phrase_matches_and_fold(spark):
    rules_df = spark.createDataFrame([(1, r"^\d+ \d+$", "Number pair", None, None, None),
                                      (2, r"^[A-Z][a-z]+$", "Capitalized", None, None, None)],
                                     "rule_index int, original string, group string, new_1 string, new_2 string, new_3 string")
    lr = R.rules_to_long(rules_df)
    docs = spark.createDataFrame([(1, "Acme makes 12 34 56"), (2, "x")], "id int, text string")
    ph = R.match_phrases(docs, "id", "text", lr.where("group = 'Number pair'"))
    got = sorted((r["id"], r["group"], r["positions"]) for r in ph.collect())
    assert got == [(1, "Number pair", [2, 3]), (1, "Number pair", [3, 4])]
    toks = R.match_rules(R.tokenize(docs, "id", "text"), lr.where("group = 'Capitalized'"), "id")
    single = toks.select("id", "group_rank", "group", "pattern_rank", "match_no",
                         F.array("pos").alias("positions"))
    res = {r["id"]: r["groups"] for r in R.assign_groups_fold(ph.unionByName(single), "id").collect()}
    assert res == {1: ["Number pair", "Capitalized"]}
    assert R.phrase_length(r"^[A-Z]\w+ \d{4}$") == 2 and R.phrase_length("^a[ ]b$") == 1


def test_phrase_matches_short_and_empty_rows(spark):
    rules_df = spark.createDataFrame([(1, r"^a b c$", "Triple", None, None, None),
                                      (2, r"^a b$", "Pair", None, None, None)],
                                     "rule_index int, original string, group string, new_1 string, new_2 string, new_3 string")
    docs = spark.createDataFrame([(1, "a"), (2, ""), (3, "a b"), (4, "a b c")], "id int, text string")
    got = sorted((r["id"], r["group"], r["positions"]) for r in
                 R.match_phrases(docs, "id", "text", R.rules_to_long(rules_df)).collect())
    assert got == [(3, "Pair", [0, 1]), (4, "Pair", [0, 1]), (4, "Triple", [0, 1, 2])]


def test_tagging_inside_the_row_equals_match_and_assign(spark):
    from moleval.plans import text_tagging as TT
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(9001, None), (9002, ""), (9003, "2020 Widget 10.0.0.1")], "doc_id bigint, text string"))
    rules = TT.long_rules(spark)
    m = R.match_rules(R.tokenize(docs, "doc_id", "text"), rules, "doc_id", flag=F.col("token").rlike(TT.TARGET_PATTERN))
    want = R.assign_groups(m, "doc_id", rows=docs.select("doc_id"), target_flag="is_target")
    got = R.tag_rows(docs, "doc_id", "text", rules, target=TT.TARGET_PATTERN)
    key = lambda r: r["doc_id"]
    assert [tuple(x) for x in sorted(got.collect(), key=key)] == [tuple(x) for x in sorted(want.collect(), key=key)]
    text = got._jdf.queryExecution().executedPlan().toString()
    final = text.split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and final.count("RLIKE") <= 4     # one scan; tests of the target and of the rules
