"""Whole jobs and round trips over the test tables.

Jobs chain the operators as a user runs them (tagged curation; prompt, predict,
parse, evaluate).  Round trips write a table through a sink into the shared
scratch folder, read it back through the matching reader and return what came
back.  The ``*_nullkey`` queries run grouped operators over keys that are NULL
for part of the rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from moleval.functions import prompt as PR
from moleval.functions import scalars as S
from moleval.operators import curate as C
from moleval.operators import filters as FL
from moleval.operators import joins as J
from moleval.operators import metrics as M
from moleval.operators import ordered as O
from moleval.operators import predict as P
from moleval.operators import rank as RK
from moleval.operators import rules as R
from moleval.operators import split as SP
from moleval.plans import evaluation as EV
from moleval.plans import landed as LD
from moleval.plans import testdata as TD
from moleval.plans import text_tagging as TT
from moleval.plans.testdata import r, table
from moleval.session import cut_lineage
from moleval.sources import sinks as SK
from moleval.sources import tables as SRC
from moleval.streaming.runner import scratch_path

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    """Register a query under its name (without ``q_``) with its oracle."""
    def add(fn):
        name = fn.__name__.removeprefix("q_")
        QUERIES[name], ORACLE_SQL[name] = fn, sql
        return fn
    return add


# ---------------------------------------------------------------- NULL keys
@query(f"""
SELECT nullif(model, 'A') AS model, CAST(count(*) AS BIGINT) AS n,
       round(sqrt(avg((pred - calculated) * (pred - calculated))), 6) + 0.0 AS rmse,
       round(avg(abs(pred - calculated)), 6) + 0.0 AS mae, round(median(pred - calculated), 6) + 0.0 AS median_error
FROM {TD.PRICED_SQL} GROUP BY 1""")
def q_error_metrics_nullkey(spark, sf_dir):
    d = TD.priced_lines(spark, sf_dir).withColumn("model", F.nullif("model", F.lit("A")))
    m = M.error_metrics(d, "model", "calculated", "pred")
    return m.select("model", F.col("n").cast("bigint").alias("n"), r("rmse").alias("rmse"), r("mae").alias("mae"),
                    r("median_error").alias("median_error"))


@query("""
WITH d AS (SELECT nullif(l_returnflag, 'N') AS flag, CASE WHEN l_linenumber <= 4 THEN 0.0 ELSE l_extendedprice - 1000 * l_linenumber END AS x FROM lineitem)
SELECT flag, round(median(x), 6) + 0.0 AS median_x, count(*) AS n FROM d GROUP BY 1""")
def q_median_ties(spark, sf_dir):
    """Exact median where most values of a group are one and the same."""
    from moleval.operators.common import exact_median
    d = table(spark, sf_dir, "lineitem").select(
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        F.when(F.col("l_linenumber") <= 4, F.lit(0.0)).otherwise(F.col("l_extendedprice") - 1000 * F.col("l_linenumber")).alias("x"))
    return exact_median(d, ["flag"], "x").select("flag", r("median").alias("median_x"), F.col("_n").alias("n"))


@query("""
WITH e AS (SELECT nullif(event_type, 'view') AS kind, value AS x FROM events),
g AS (SELECT kind, min(x) AS lo, max(x) AS hi FROM e GROUP BY 1),
b AS (SELECT kind, i + 1 AS bin, lo + i * (hi - lo) / 10 AS a, CASE WHEN i = 9 THEN hi ELSE lo + (i + 1) * (hi - lo) / 10 END AS z,
             i = 9 AS last FROM g, range(0, 10) t(i)),
c AS (SELECT b.kind, b.bin, count(*) AS n FROM b JOIN e ON e.kind IS NOT DISTINCT FROM b.kind AND e.x >= b.a AND (e.x < b.z OR b.last) GROUP BY 1, 2)
SELECT b.kind, CAST(b.bin AS INTEGER) AS bin, round(b.a, 6) AS bin_lo, round(b.z, 6) AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM b LEFT JOIN c ON c.kind IS NOT DISTINCT FROM b.kind AND c.bin = b.bin""")
def q_histogram_by(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("view")).alias("kind"), "value")
    return M.histogram(e, "value", bins=10, by="kind").select("kind", "bin", r("bin_lo").alias("bin_lo"), r("bin_hi").alias("bin_hi"), "count")


@query("""
WITH e AS (SELECT event_type AS kind, CASE WHEN event_type <> 'view' THEN value END AS x FROM events),
g AS (SELECT kind, min(x) AS lo, max(x) AS hi, count(x) AS n FROM e GROUP BY 1)
SELECT kind, CAST(10 AS BIGINT) AS n_bins, n AS n_values, round(lo, 6) AS lo, round(hi, 6) AS hi FROM g WHERE n > 0""")
def q_histogram_all_null(spark, sf_dir):
    """a group without values has no bins, the others have all of theirs."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.when(F.col("event_type") != "view", F.col("value")).alias("v"))
    h = M.histogram(e, "v", bins=10, by="kind")
    return h.groupBy("kind").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("count").alias("n_values"), F.round(F.min("bin_lo"), 6).alias("lo"), F.round(F.max("bin_hi"), 6).alias("hi"))


_NULL_CUST = "CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END"


@query(f"""
WITH RECURSIVE o AS (SELECT o_orderkey, {_NULL_CUST} AS cust FROM orders),
g AS (SELECT cust, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, cust NULLS FIRST) AS rn FROM o GROUP BY 1),
cap AS (SELECT CAST(floor(sum(n) * 0.8 + 1e-9) AS BIGINT) AS c FROM g),
t AS (SELECT rn, cust, CASE WHEN n <= c THEN n ELSE 0 END AS used, n <= c AS train FROM g, cap WHERE rn = 1
      UNION ALL SELECT g.rn, g.cust, CASE WHEN t.used + g.n <= c THEN t.used + g.n ELSE t.used END, t.used + g.n <= c
      FROM t JOIN g ON g.rn = t.rn + 1, cap)
SELECT o_orderkey, o.cust, CASE WHEN train THEN 'train' ELSE 'test' END AS split FROM o JOIN t ON o.cust IS NOT DISTINCT FROM t.cust""")
def q_group_split_nullkey(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_NULL_CUST).alias("cust"))
    return SP.group_split(o, "cust", 0.8)


_NULL_USER = "CASE WHEN user_id % 5 <> 0 THEN user_id END"


@query(TD.SQL_LONGEST_RUN.replace("FROM events", f"FROM (SELECT * REPLACE ({_NULL_USER} AS user_id) FROM events)")
       .replace("LEFT JOIN m USING (user_id)", "LEFT JOIN m ON u.user_id IS NOT DISTINCT FROM m.user_id"))
def q_longest_run_nullkey(spark, sf_dir):
    e = TD.event_edges(spark, sf_dir).withColumn("user_id", F.expr(_NULL_USER))
    return O.longest_connected_run(e, "user_id", ["ts", "event_id"], "b", "e", "flag")


@query(TD.SQL_RECENT_DEDUP.replace("SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS k",
                                   f"SELECT coalesce({_NULL_USER}, -1) AS user_id, event_id, coalesce(nullif(CAST(floor(value) AS BIGINT) % 10, 3), -1) AS k")
       .replace("PARTITION BY user_id ORDER BY", f"PARTITION BY {_NULL_USER} ORDER BY")
       .replace("SELECT user_id, event_id, outcome FROM r", "SELECT nullif(user_id, -1) AS user_id, event_id, outcome FROM r"))
def q_recent_dedup_nullkey(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.expr(_NULL_USER).alias("user_id"), "event_id", "ts", F.nullif(F.floor("value").cast("bigint") % 10, F.lit(3)).alias("k"),
        (F.col("value") - 50.0).alias("err"))
    return O.recent_dedup(ev, "user_id", ["ts", "event_id"], "k", error="err", keep=["event_id"])


# ---------------------------------------------------------------- rules
BACKREF_RULES = [(1, r"^([a-zA-Z])\1", "Double start", None, None, None), (2, r"^(?<a>[A-Z])[a-z]$", "Short name", None, None, None),
                 (3, r"^(?<a>[0-9])[0-9]*$", "Number", r"^([0-9])\1[0-9]*[.]$", None, None)]


@query(r"""
WITH t AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[ \t\n\r\f\v]+')) AS token,
                  generate_subscripts(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), 1) - 1 AS pos FROM conversations),
m AS (SELECT conv_id, turn, pos, 'Double start' AS "group" FROM t WHERE regexp_matches(token, '^[a-zA-Z]') AND substr(token, 1, 1) = substr(token, 2, 1)
      UNION ALL SELECT conv_id, turn, pos, 'Short name' FROM t WHERE regexp_matches(token, '^[A-Z][a-z]$')
      UNION ALL SELECT conv_id, turn, pos, 'Number' FROM t WHERE regexp_matches(token, '^[0-9]+$')
      UNION ALL SELECT conv_id, turn, pos, 'Number' FROM t WHERE regexp_matches(token, '^[0-9]{2,}[.]$') AND substr(token, 1, 1) = substr(token, 2, 1))
SELECT conv_id || ':' || turn AS row_id, "group", CAST(pos AS INTEGER) AS pos FROM m""")
def q_rule_matches_backref(spark, sf_dir):
    """Rules with back references and a group name used twice."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("row_id"), "text")
    rules = R.rules_to_long(spark.createDataFrame(BACKREF_RULES, TT.RULE_SCHEMA))
    return R.match_rules(R.tokenize(c, "row_id", "text"), rules, "row_id").select("row_id", "group", "pos")


ORACLE_SQL["phrase_groups"] = f"""
WITH RECURSIVE m AS ({TT.ORACLE_SQL["phrase_matches"]}),
o AS (SELECT doc_id, group_rank AS g, "group" AS name, pattern_rank AS pr, range(pos, pos + n_tokens) AS ps,
             row_number() OVER (PARTITION BY doc_id ORDER BY group_rank, pattern_rank, pos) AS rn FROM m),
s AS (SELECT doc_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(g INTEGER, p BIGINT)[]) AS st, CAST([] AS VARCHAR[]) AS names, false AS bad
      FROM (SELECT DISTINCT doc_id FROM o)
      UNION ALL
      SELECT s.doc_id, o.rn,
        CASE WHEN take THEN list_concat(s.st, list_transform(o.ps, lambda p: {{'g': o.g::INTEGER, 'p': p::BIGINT}})) ELSE s.st END,
        CASE WHEN take THEN list_append(s.names, o.name) ELSE s.names END, s.bad OR fail
      FROM s JOIN o ON o.doc_id = s.doc_id AND o.rn = s.rn + 1,
      LATERAL (SELECT list_filter(s.st, lambda x: list_contains(o.ps, x.p)) AS over) v,
      LATERAL (SELECT len(over) > 0 AS hit, len(list_filter(over, lambda x: x.g = o.g)) > 0 AS own) w,
      LATERAL (SELECT NOT s.bad AND (NOT hit OR (NOT own AND o.pr > 0)) AS take, NOT s.bad AND hit AND NOT own AND o.pr = 0 AS fail) y),
e AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rn DESC) = 1)
SELECT d.doc_id, CASE WHEN e.bad THEN NULL WHEN e.doc_id IS NULL OR len(e.names) = 0 THEN 'No functional groups assigned.'
                      ELSE array_to_string(e.names, '|') END AS groups_text,
       CAST(coalesce(len(list_distinct(list_transform(e.st, lambda x: x.p))), 0) AS BIGINT) AS n_positions
FROM documents d LEFT JOIN e USING (doc_id)"""

# one rule reaches positions that other groups hold: its original pattern rejects the record
SMILES_RULES = [(1, "^C$", "Carbon", None, None, None), (2, "^[no]$", "Aromatic", None, None, None), (3, "^O$", "Oxygen", None, None, None),
                (4, "^N$", "Nitrogen", "^C$", None, None), (5, "^=$", "Bond", None, None, None), (6, "^[=O]$", "Carbonyl", None, None, None)]


def smiles_tagger(spark):
    rules = R.rules_to_long(spark.createDataFrame(SMILES_RULES, TT.RULE_SCHEMA))

    def tag(records):
        return R.tag_rows(records, "CID", "CanonicalSMILES", rules, split="", keep=records.columns)
    return tag


def _count(text: str, letters: str) -> str:
    return f"(length({text}) - length(translate({text}, '{letters}', '')))"


@query(f"""
SELECT CID, CanonicalSMILES, repeat('Carbon|', {_count('CanonicalSMILES', 'C')}::BIGINT) || repeat('Aromatic|', {_count('CanonicalSMILES', 'no')}::BIGINT)
       || repeat('Nitrogen|', ({_count('CanonicalSMILES', 'N')} + {_count('CanonicalSMILES', 'C')})::BIGINT) AS groups_text
FROM ({LD.SQL_CURATED_RECORDS}) WHERE NOT regexp_matches(CanonicalSMILES, '[=O]')""")
def q_curated_tagged(spark, sf_dir):
    """Curation as one job: parse, key, alphabet, tagging, acceptance, limits."""
    c = C.curate(LD.property_responses(spark, sf_dir), tagger=smiles_tagger(spark))
    return c.select("CID", "CanonicalSMILES", F.concat(F.array_join("groups", "|"), F.lit("|")).alias("groups_text"))


# ---------------------------------------------------------------- prediction
def answer_by_length(prompts: pd.Series) -> pd.Series:
    """Stand-in for a model: a number that depends on the whole prompt."""
    return prompts.str.len() * 1.5


def direct_answer(prompts: pd.Series) -> pd.Series:
    return prompts.str.len() + 700.0


_ENTRY = ("lpad('group', {w1}, ' ') || '  ' || lpad('tpsa_contribution', {w2}, ' ') || chr(92) || 'n' || lpad(w, {w1}, ' ') || '  ' || lpad(v, {w2}, ' ')"
          .format(w1="greatest(5, length(w))::INTEGER", w2="greatest(17, length(v))::INTEGER"))
_PREDICT_FROM = f"""(SELECT p.*, l.tbl FROM part p JOIN (
  SELECT p_partkey, '[' || chr(39) || string_agg(entry, chr(39) || ', ' || chr(39) ORDER BY rk) || chr(39) || ']' AS tbl FROM (
    SELECT DISTINCT u.p_partkey, x.rk, {_ENTRY} AS entry
    FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) u
    JOIN (SELECT w, min(p_partkey) AS rk, CAST(CAST(length(w) * 1.5 AS DOUBLE) AS VARCHAR) AS v FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w) x USING (w))
  GROUP BY 1) l USING (p_partkey))"""


@query(LD.SQL_PROMPT_PARTS.replace("@groups", "'[' || chr(39) || replace(p_name, ' ', chr(39) || ', ' || chr(39)) || chr(39) || ']'")
       .replace("@table", "tbl").replace("@from", _PREDICT_FROM) + """,
y AS (SELECT 'tpsa_model_abcdef' AS model, p_retailprice, length(a || b || c || d || e || f) * 1.5 AS pred FROM x
      UNION ALL SELECT 'tpsa_model_ae', p_retailprice, length(a || e) * 1.5 FROM x
      UNION ALL SELECT 'direct_model', p_retailprice, length(direct) + 700.0 FROM x)
SELECT model, count(*) AS n, round(sqrt(avg((pred - p_retailprice) * (pred - p_retailprice))), 6) + 0.0 AS rmse,
       round(avg(abs(pred - p_retailprice)), 6) + 0.0 AS mae, round(median(pred - p_retailprice), 6) + 0.0 AS median_error FROM y GROUP BY 1""")
def q_predict_evaluate(spark, sf_dir):
    """One plan: tags, value table, counts, prompts of three models, predictors, numbers, metrics."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", F.split("p_name", " ").alias("groups"))
    words = p.select("p_partkey", F.explode("groups").alias("group"))
    values = words.groupBy("group").agg(F.min("p_partkey").alias("rank")).withColumn("tpsa_contribution", F.length("group") * 1.5)
    rows = J.attach_value_table(p, "groups", values)
    parts = {"groups": F.col("groups"), "num_n": S.count_letter("p_name", "n"), "num_o": S.count_letter("p_name", "o"), "table": S.list_literal("data_table")}
    inputs = {m: PR.model_prompt(m, "p_name", **parts) for m in ("tpsa_model_abcdef", "tpsa_model_ae", "direct_model")}
    predictors = {m: direct_answer if m == PR.DIRECT_MODEL else answer_by_length for m in inputs}
    # written once: the metrics look at the answers twice, the models are asked once
    long = cut_lineage(P.with_model_predictions(rows, predictors, inputs, keep=["p_partkey", "p_retailprice"]))
    m = M.error_metrics(long, "model", "p_retailprice", "pred")
    return m.select("model", "n", r("rmse").alias("rmse"), r("mae").alias("mae"), r("median_error").alias("median_error"))


@query("""
WITH m AS (SELECT user_id, avg(value) AS user_mean FROM events GROUP BY user_id),
a AS (SELECT event_type AS candidate, count(*) AS n, avg(CASE WHEN abs(value - user_mean) < 10 THEN 1.0 ELSE 0.0 END) AS s
      FROM events JOIN m USING (user_id) GROUP BY event_type)
SELECT candidate, n AS n_trials, round(s, 6) + 0.0 AS mean_score, CAST(rank() OVER (ORDER BY s DESC) AS INTEGER) AS rank,
       row_number() OVER (ORDER BY s DESC, candidate) = 1 AS is_best FROM a""")
def q_leaderboard_score(spark, sf_dir):
    """A15 with a score of the user's own (U3): the share of near hits."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    trials = ev.join(ev.groupBy("user_id").agg(F.avg("value").alias("user_mean")), "user_id")
    near = F.when(F.abs(F.col("value") - F.col("user_mean")) < 10, F.lit(1.0)).otherwise(F.lit(0.0))
    lb = RK.leaderboard(trials, "event_type", "value", "user_mean", score=near)
    return lb.select("candidate", "n_trials", r("mean_score").alias("mean_score"), F.col("rank").cast("int").alias("rank"), "is_best")


# ---------------------------------------------------------------- sources and sinks
@query(f"""
SELECT p_partkey AS "CID", {LD.SQL_SMILES} AS "CanonicalSMILES", round(p_retailprice / 100.0, 6) AS "XLogP", CAST(p_size * 2.0 AS DOUBLE) AS "TPSA",
       CAST(p_size AS BIGINT) AS "HBondDonorCount" FROM part""")
def q_molecule_csv(spark, sf_dir):
    """A table written with its index column is read back without it."""
    path = scratch_path(spark, "molecules")
    p = table(spark, sf_dir, "part")
    SK.write_table(p.select(F.col("p_partkey").alias("_c0"), F.col("p_partkey").alias("CID"), LD.smiles_of("p_partkey").alias("CanonicalSMILES"),
                            (F.col("p_retailprice") / 100.0).alias("XLogP"), F.lit(None).cast("double").alias("ExactMass"),
                            (F.col("p_size") * 2.0).alias("TPSA"), F.col("p_size").alias("HBondDonorCount"), F.lit(0).alias("HBondAcceptorCount")),
                   path, "csv")
    back = SRC.require_columns(SRC.read_molecules(spark, path), ["CID", "CanonicalSMILES", "TPSA"])
    return back.select("CID", "CanonicalSMILES", r("XLogP").alias("XLogP"), "TPSA", "HBondDonorCount")


@query("""SELECT CAST(p_partkey AS INTEGER) AS rule_index, p_type AS original, p_brand AS "group", nullif(p_name, 'x') AS new_1 FROM part""")
def q_rule_csv(spark, sf_dir):
    """A rule file under other header names gets the fixed ones."""
    path = scratch_path(spark, "rules")
    p = table(spark, sf_dir, "part")
    SK.write_table(p.select(F.col("p_partkey").alias("Unnamed: 0"), F.col("p_type").alias("SMARTS"), F.col("p_brand").alias("Name"), F.col("p_name").alias("a"),
                            F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("c")), path, "csv")
    return SRC.read_rules(spark, path).select("rule_index", "original", "group", "new_1")


MODELS = ("alpha", "beta", "gamma")


def _prediction_set(spark, sf_dir):
    folder = scratch_path(spark, "predictions")
    p = table(spark, sf_dir, "part")
    for k, m in enumerate(MODELS[:2], 1):
        d = p.select(F.col("p_name").alias("smiles"), F.col("p_retailprice").alias("calculated"), (F.col("p_size") * float(k)).alias(f"{m}_pred"),
                     S.list_literal(F.array("p_type", "p_brand")).alias("group_descriptions"))
        SK.write_table(d if k == 1 else d.drop("group_descriptions"), f"{folder}/{m}_predictions.csv", "csv")
    return SRC.read_prediction_set(spark, folder, MODELS)


@query("""
SELECT 'alpha' AS model, p_name AS smiles, p_retailprice AS calculated, CAST(p_size AS DOUBLE) AS pred, p_type || '|' || p_brand AS groups_text FROM part
UNION ALL SELECT 'beta', p_name, p_retailprice, p_size * 2.0::DOUBLE, NULL FROM part""")
def q_prediction_set(spark, sf_dir):
    """One file per model, one long table; an absent column is NULL."""
    return _prediction_set(spark, sf_dir).select("model", "smiles", "calculated", "pred", F.array_join("group_descriptions", "|").alias("groups_text"))


@query("""
SELECT DISTINCT p_brand AS model FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48 AND p_type = 'ECONOMY')
UNION ALL SELECT 'Brand#none'""")
def q_missing_models(spark, sf_dir):
    """Expected models (one per brand, and one more) without any row among the predictions read back."""
    folder = scratch_path(spark, "some-predictions")
    p = table(spark, sf_dir, "part")
    some = p.where("p_size > 48 AND p_type = 'ECONOMY'").select(F.col("p_brand").alias("model"), F.col("p_size").cast("double").alias("pred"))
    SK.write_table(some, folder, "csv")
    expected = [x["p_brand"] for x in p.select("p_brand").distinct().collect()] + ["Brand#none"]      # names of models
    return SRC.missing_models(SRC.read_csv(spark, folder, "model string, pred double"), expected)


PROGRAM_BLOCK = 100             # consecutive part numbers of one program


@query(f"""
SELECT CAST(row_number() OVER (PARTITION BY p_brand, p_partkey // {PROGRAM_BLOCK} ORDER BY p_partkey) - 1 AS INTEGER) AS demo_no, true AS augmented, p_name AS question,
       CAST(p_size AS VARCHAR) AS answer, 'Use ' || p_brand AS instructions, 'Question:' AS first_prefix FROM part""")
def q_program_json(spark, sf_dir):
    """Saved programs give their demonstrations and signature.  A program holds the parts of one
    brand and one block of numbers, so programs grow in number and not in size."""
    path = scratch_path(spark, "programs")
    demos = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))), lambda x: F.struct(
        F.lit(True).alias("augmented"), x["p_name"].alias("question"), x["p_size"].cast("string").alias("answer")))
    g = table(spark, sf_dir, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / PROGRAM_BLOCK).alias("block")).agg(demos.alias("demos"))
    fields = F.array(F.struct(F.lit("Question:").alias("prefix"), F.lit("the question").alias("description")))
    signature = F.struct(F.concat(F.lit("Use "), F.col("p_brand")).alias("instructions"), fields.alias("fields"))
    body = F.to_json(F.struct(F.struct("demos", signature.alias("signature")).alias("prog.predictor")))
    # a record of JSON per line and many lines a file: a program is one line
    g.select(body.alias("value")).write.text(path)
    back = SRC.read_programs(spark, path, multi_line=False)
    return back.select(F.col("demo_no").cast("int").alias("demo_no"), "augmented", "question", "answer", "instructions",
                       F.get("fields", F.lit(0))["prefix"].alias("first_prefix"))


@query("""
SELECT p_name AS question, 'True TPSA: ' || CAST(CAST(p_size AS DOUBLE) AS VARCHAR) AS true_text, 'Predicted TPSA: ' || CAST(CAST(p_size * 2.0 AS DOUBLE) AS VARCHAR) AS pred_text
FROM part""")
def q_log_append(spark, sf_dir):
    """A log made empty, appended to in two parts, with the texts of its rows."""
    path = scratch_path(spark, "log")
    p = table(spark, sf_dir, "part")
    true, pred = S.log_texts(F.col("p_size").cast("double"), F.col("p_size") * 2.0)
    rows = p.select("p_partkey", F.col("p_name").alias("question"), true.alias("true_text"), pred.alias("pred_text"))
    SK.ensure_table(spark, path, "question string, true_text string, pred_text string")
    SK.append_log(rows.where("p_partkey % 2 = 0").drop("p_partkey"), path)
    SK.ensure_table(spark, path, "question string, true_text string, pred_text string")
    SK.append_log(rows.where("p_partkey % 2 = 1").drop("p_partkey"), path)
    return spark.read.parquet(path)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def q_materialize(spark, sf_dir):
    """The second call reads the finished copy and does not build."""
    path = scratch_path(spark, "once")
    SK.materialize_once(spark, path, lambda: table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")))

    def never():
        raise AssertionError("built twice")
    return SK.materialize_once(spark, path, never)


@query("""
WITH t AS (SELECT event_type, user_id % 3 AS part, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, CAST(part AS INTEGER) AS part, n FROM t""")
def q_append_batches(spark, sf_dir):
    """V4: batches landed one after the other are one table."""
    path = scratch_path(spark, "batches")
    ev = table(spark, sf_dir, "events").withColumn("part", (F.col("user_id") % 3).cast("int"))
    for k in range(3):
        SK.append_log(ev.where(F.col("part") == k).select("event_type", "part"), path, "json")
    return spark.read.schema("event_type string, part int").json(path).groupBy("event_type", "part").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1""")
def q_append_once(spark, sf_dir):
    """Batches by key, each handed over twice and once more with other rows, count once."""
    path = scratch_path(spark, "batches-once")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    for _ in range(2):
        for k in range(3):
            SK.append_batch(p.where(F.pmod("p_partkey", F.lit(3)) == k), path, f"batch {k}")
    SK.append_batch(p, path, "batch 1")
    return SK.read_batches(spark, path, "p_partkey bigint, p_brand string, p_size int").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total"))


@query("""
SELECT CASE WHEN p_partkey % 10 = 3 THEN 'bad number' WHEN p_partkey % 10 = 6 THEN 'too few' WHEN p_partkey % 10 = 8 THEN 'too many' ELSE 'fits' END AS kind,
       count(*) AS n, CAST(sum(CASE WHEN p_partkey % 10 NOT IN (3, 6, 8) THEN p_size ELSE 0 END) AS BIGINT) AS total FROM part GROUP BY 1""")
def q_csv_bad_records(spark, sf_dir):
    """Damaged lines made from ``part`` are reported with their text, the others are rows."""
    path = scratch_path(spark, "damaged-csv")
    k = F.col("p_partkey") % 10
    size = F.when(k == 3, F.concat(F.lit("x"), F.col("p_size"))).otherwise(F.col("p_size").cast("string"))
    line = F.concat(F.col("p_partkey"), F.lit(","), F.col("p_brand"), F.when(k == 6, F.lit("")).otherwise(F.concat(F.lit(","), size)), F.when(k == 8, F.lit(",extra")).otherwise(F.lit("")))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    good, bad = SRC.read_csv_checked(spark, path, "p_partkey bigint, p_brand string, p_size int")
    commas = F.length("text") - F.length(F.replace("text", F.lit(","), F.lit("")))
    kinds = bad.select(F.when(commas < 2, "too few").when(commas > 2, "too many").otherwise("bad number").alias("kind"), F.lit(0).alias("p_size"))
    return (good.select(F.lit("fits").alias("kind"), "p_size").unionByName(kinds).groupBy("kind")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").cast("bigint").alias("total")))


@query("""
WITH g AS (SELECT floor(p_partkey / 10) AS chunk, max(p_size) AS mx, min(p_size) AS mn, count(*) AS n FROM part GROUP BY 1),
k AS (SELECT *, CASE WHEN mx = 50 THEN NULL WHEN mn = 1 THEN 'unreadable' WHEN mn = 2 THEN 'no property table' ELSE 'fits' END AS reason FROM g)
SELECT reason, CAST(sum(CASE WHEN reason = 'fits' THEN n ELSE 1 END) AS BIGINT) AS n FROM k WHERE reason IS NOT NULL GROUP BY 1""")
def q_property_bad_records(spark, sf_dir):
    """Records of the bodies that can be read, and the others by reason."""
    sizes = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 10).cast("bigint").alias("_chunk")).agg(F.min("p_size").alias("_mn"))
    r = LD.property_responses(spark, sf_dir)
    first = F.split("cid_list", ",")[0].cast("bigint")
    r = r.withColumn("_chunk", F.floor(first / 10).cast("bigint")).join(sizes, "_chunk")
    r = r.withColumn("body", F.when(F.col("_mn") == 1, F.substring("body", 1, 40)).when(F.col("_mn") == 2, F.lit('{"Fault": 1}')).otherwise(F.col("body")))
    good, bad = SRC.parse_property_responses_checked(r)
    return good.select(F.lit("fits").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _fussy(s: pd.Series) -> pd.Series:
    """Answers with the length, and refuses a batch with a text that ends in 7."""
    texts = s.tolist()
    if any(t is not None and t.endswith("7") for t in texts):
        raise ValueError("refused")
    return pd.Series([math.nan if t is None else float(len(t)) for t in texts], index=s.index)


@query("""
SELECT CASE WHEN o_orderkey % 10 = 7 THEN 'failed' ELSE 'answered' END AS outcome, count(*) AS n,
       CAST(sum(CASE WHEN o_orderkey % 10 = 7 THEN 0 ELSE length(CAST(o_orderkey AS VARCHAR)) END) AS DOUBLE) AS total FROM orders GROUP BY 1""")
def q_predict_resume(spark, sf_dir):
    """U1 in two runs: the first answers half of the orders, the second the rest; refused rows are reported."""
    path = scratch_path(spark, "answers")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("text"))
    P.resume_predictions(o.where("o_orderkey % 2 = 0"), _fussy, "text", "length", path, "o_orderkey", steps=2)
    ok, failed = P.resume_predictions(o, _fussy, "text", "length", path, "o_orderkey", steps=2, max_tries=1)
    return (ok.select(F.lit("answered").alias("outcome"), "pred").unionByName(failed.select(F.lit("failed").alias("outcome"), F.lit(0.0).alias("pred")))
            .groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("pred").alias("total")))


@query("""
WITH c AS (SELECT 'alpha' AS model, abs(p_retailprice - p_size * 30.0) AS e FROM part UNION ALL SELECT 'beta', abs(p_retailprice - p_size * 60.0) FROM part)
SELECT model, CAST(count_if(e <= 500) AS BIGINT) AS good, CAST(count_if(e > 500) AS BIGINT) AS outliers, count(*) AS total FROM c GROUP BY 1""")
def q_outlier_job(spark, sf_dir):
    """The report job from prediction files on: read (S1), partition (F3), count (A2)."""
    folder = scratch_path(spark, "prediction-files")
    p = table(spark, sf_dir, "part")
    for k, m in enumerate(MODELS[:2], 1):
        SK.write_table(p.select(F.col("p_name").alias("smiles"), F.col("p_retailprice").alias("calculated"), (F.col("p_size") * (30.0 * k)).alias(f"{m}_pred"),
                                F.col("p_size").alias("num_n"), F.lit(0).alias("num_o")), f"{folder}/{m}_predictions.csv", "csv")
    c = EV.outlier_reports(SRC.read_prediction_set(spark, folder, MODELS), threshold=500.0)["counts"]
    return c.select("model", F.col("n_good").alias("good"), F.col("n_outlier").alias("outliers"), F.col("n_total").alias("total"))


# ---------------------------------------------------------------- small operators
@query("SELECT event_id, event_type FROM events WHERE NOT (event_type IN ('view', 'error'))")
def q_exclude_values(spark, sf_dir):
    return FL.exclude_values(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["view", "error"])


@query("SELECT n_nationkey, n_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_remap_codes(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("code"))
    d = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("code"), "r_name")
    return J.remap_codes(n, d, "code", "r_name", out="region").select("n_nationkey", "n_name", "region")


@query("SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS row_no FROM events")
def q_renumber(spark, sf_dir):
    return O.renumber(table(spark, sf_dir, "events").select("event_id", "value"), [F.col("value").desc(), "event_id"]).select("event_id", "row_no")


@query("""SELECT p_partkey, p_type || '|' || p_brand AS items, 2 AS n_items FROM part""")
def q_list_literal(spark, sf_dir):
    """A list saved as text is a list again."""
    back = S.parse_list_literal(S.list_literal(F.array("p_type", "p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(back, "|").alias("items"), F.size(back).alias("n_items"))
