"""Bindings of the operators to the driver's test tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over whole
tables; ``ORACLE_SQL`` holds the DuckDB twin of each query that SQL can
express.  Every computed column is aliased identically on both sides,
doubles are rounded to a fixed number of decimals on both sides and
``-0.0`` is normalised, so results compare by value hash.

Analogues (the test tables are a star schema, not molecules):
  model       = ``l_returnflag``;  calculated = ``l_extendedprice``;
  prediction  = ``l_quantity * p_retailprice``  (lineitem joined with part)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moleval.functions import scalars as S
from moleval.functions.tdist import t_two_sided_p_sql
from moleval.operators import filters as FL
from moleval.operators import joins as J
from moleval.operators import metrics as M
from moleval.operators import ordered as O
from moleval.operators import stats as ST

OUTLIER_T = 10000.0        # error threshold of the lineitem analogue
R6 = 6                     # decimals kept for doubles in compared outputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts (how it is split into tasks follows from
    ``spark.sql.files.maxPartitionBytes``)."""
    return table(spark, sf_dir, name)


def r(c, d: int = R6):
    """Round for comparison and turn -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, d) + F.lit(0.0)


def priced_lines(spark, sf_dir) -> DataFrame:
    """lineitem joined with part: the (model, calculated, pred) analogue."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return (li.join(pa, li.l_partkey == pa.p_partkey)
              .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax",
                      F.col("l_returnflag").alias("model"),
                      F.col("l_extendedprice").alias("calculated"),
                      (F.col("l_quantity") * F.col("p_retailprice")).alias("pred")))


PRICED_SQL = """(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax,
       l_returnflag AS model, l_extendedprice AS calculated, l_quantity * p_retailprice AS pred
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


# ---------------------------------------------------------------- metrics
def q_error_metrics(spark, sf_dir):
    m = M.error_metrics(priced_lines(spark, sf_dir), "model", "calculated", "pred")
    return m.select("model", F.col("n").cast("bigint").alias("n"), r("rmse").alias("rmse"),
                    r("mae").alias("mae"), r("median_error").alias("median_error"))


SQL_ERROR_METRICS = f"""
SELECT model, CAST(count(*) AS BIGINT) AS n,
       round(sqrt(avg((pred - calculated) * (pred - calculated))), 6) + 0.0 AS rmse,
       round(avg(abs(pred - calculated)), 6) + 0.0 AS mae,
       round(median(pred - calculated), 6) + 0.0 AS median_error
FROM {PRICED_SQL} GROUP BY model"""


def classified_lines(spark, sf_dir):
    return FL.partition_by_error(priced_lines(spark, sf_dir), "calculated", "pred", OUTLIER_T)


CLASSIFIED_SQL = f"""(SELECT *, abs(calculated - pred) AS abs_error,
       CASE WHEN abs(calculated - pred) > {OUTLIER_T} THEN 'outlier'
            WHEN abs(calculated - pred) <= {OUTLIER_T} THEN 'good' END AS outcome
  FROM {PRICED_SQL})"""


def q_error_partition(spark, sf_dir):
    d = classified_lines(spark, sf_dir)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "model",
                    r("abs_error").alias("abs_error"), "outcome")


SQL_ERROR_PARTITION = f"""
SELECT l_orderkey, l_linenumber, l_partkey, model, round(abs_error, 6) + 0.0 AS abs_error, outcome
FROM {CLASSIFIED_SQL}"""


def q_outcome_counts(spark, sf_dir):
    return M.outcome_counts(classified_lines(spark, sf_dir), "model")


SQL_OUTCOME_COUNTS = f"""
SELECT model, CAST(count_if(outcome = 'good') AS BIGINT) AS n_good,
       CAST(count_if(outcome = 'outlier') AS BIGINT) AS n_outlier,
       CAST(count_if(outcome = 'good') + count_if(outcome = 'outlier') AS BIGINT) AS n_total
FROM {CLASSIFIED_SQL} GROUP BY model"""


def _summary_out(df):
    return df.select(*[c for c in df.columns if c not in ("n", "mean", "std")],
                     F.col("n").cast("bigint").alias("n"), r("mean").alias("mean"), r("std").alias("std"))


def q_feature_summary_pop(spark, sf_dir):
    d = classified_lines(spark, sf_dir).where(F.col("outcome") == FL.OUTLIER)
    return _summary_out(M.feature_summary(d, "model", "l_quantity", ddof=0))


SQL_FEATURE_SUMMARY_POP = f"""
SELECT model, CAST(count(l_quantity) AS BIGINT) AS n, round(avg(l_quantity), 6) + 0.0 AS mean,
       round(stddev_pop(l_quantity), 6) + 0.0 AS std
FROM {CLASSIFIED_SQL} WHERE outcome = 'outlier' GROUP BY model"""


def q_feature_summary_samp(spark, sf_dir):
    d = classified_lines(spark, sf_dir).where(F.col("outcome") == FL.OUTLIER)
    return _summary_out(M.feature_summary(d, "model", "l_discount", ddof=1))


SQL_FEATURE_SUMMARY_SAMP = f"""
SELECT model, CAST(count(l_discount) AS BIGINT) AS n, round(avg(l_discount), 6) + 0.0 AS mean,
       round(stddev_samp(l_discount), 6) + 0.0 AS std
FROM {CLASSIFIED_SQL} WHERE outcome = 'outlier' GROUP BY model"""


def q_feature_summary_all(spark, sf_dir):
    d = classified_lines(spark, sf_dir)
    s = M.feature_summary_with_all(d, "model", "l_quantity", all_models=["A"], ddof=0)
    return _summary_out(s)


SQL_FEATURE_SUMMARY_ALL = f"""
WITH c AS {CLASSIFIED_SQL},
lab AS (SELECT model || ' (outlier)' AS label, l_quantity FROM c WHERE outcome = 'outlier'
        UNION ALL SELECT model || ' (All)' AS label, l_quantity FROM c WHERE model IN ('A'))
SELECT label, CAST(count(l_quantity) AS BIGINT) AS n, round(avg(l_quantity), 6) + 0.0 AS mean,
       round(stddev_pop(l_quantity), 6) + 0.0 AS std
FROM lab GROUP BY label"""


def q_histogram20(spark, sf_dir):
    h = M.histogram(table(spark, sf_dir, "events"), "value", bins=20)
    return h.select(F.col("bin").cast("int").alias("bin"), r("bin_lo").alias("bin_lo"),
                    r("bin_hi").alias("bin_hi"), "count")


SQL_HISTOGRAM20 = """
WITH v AS (SELECT value AS x FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
rg AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
              CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v),
b0 AS (SELECT x, lo, hi, (hi - lo) / 20 AS step,
              least(CAST(floor((x - lo) * (20.0 / (hi - lo))) AS INTEGER), 19) AS i0 FROM v, rg),
b1 AS (SELECT x, lo, step, CASE WHEN x < lo + i0 * step THEN i0 - 1 ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT CASE WHEN x >= lo + (i1 + 1) * step AND i1 <> 19 THEN i1 + 1 ELSE i1 END + 1 AS bin FROM b1),
cnt AS (SELECT bin, count(*) AS c FROM b2 GROUP BY bin),
allb AS (SELECT CAST(range AS INTEGER) AS bin, lo, hi FROM rg, range(1, 21))
SELECT a.bin, round(lo + (a.bin - 1) * ((hi - lo) / 20), 6) + 0.0 AS bin_lo,
       round(CASE WHEN a.bin = 20 THEN hi ELSE lo + a.bin * ((hi - lo) / 20) END, 6) + 0.0 AS bin_hi,
       CAST(coalesce(c, 0) AS BIGINT) AS count
FROM allb a LEFT JOIN cnt USING (bin)"""


# ---------------------------------------------------------------- statistics
def q_paired_ttest(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    base = o.select(F.lit("quoted").alias("model"), F.col("o_orderkey").alias("key"),
                    F.col("o_totalprice").alias("pred"))
    per_order = li.groupBy(F.col("l_orderkey").alias("key")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"))
    models = per_order.select(
        "key", F.explode(F.array(
            F.struct(F.lit("revenue").alias("model"), F.col("revenue").alias("pred")),
            F.struct(F.lit("charge").alias("model"), F.col("charge").alias("pred")))).alias("m")
    ).select(F.col("m.model").alias("model"), "key", F.col("m.pred").alias("pred"))
    long = base.unionByName(models)
    pairs = J.pair_with_base(long, "quoted", "key")
    t = ST.paired_ttest(pairs, "model", "base_pred", "pred")
    return t.select("model", F.col("n_pairs").cast("bigint").alias("n_pairs"),
                    r("mean_diff", 4).alias("mean_diff"), r("t", 6).alias("t"), r("df", 6).alias("df"),
                    r("p_value", 6).alias("p_value"))


def _sql_paired():
    p = t_two_sided_p_sql("t", "df")
    return f"""
WITH po AS (SELECT l_orderkey AS key,
                   sum(l_extendedprice * (1 - l_discount)) AS revenue,
                   sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS charge
            FROM lineitem GROUP BY l_orderkey),
m AS (SELECT 'revenue' AS model, key, revenue AS pred FROM po
      UNION ALL SELECT 'charge' AS model, key, charge AS pred FROM po),
d AS (SELECT m.model, o.o_totalprice - m.pred AS dd FROM m JOIN orders o ON o.o_orderkey = m.key),
a AS (SELECT model, count(*) AS n, avg(dd) AS md, stddev_samp(dd) AS sd FROM d GROUP BY model),
tt AS (SELECT model, n, md, CASE WHEN n >= 2 AND sd / sqrt(n) > 0 THEN md / (sd / sqrt(n)) END AS t,
              CASE WHEN n >= 2 THEN CAST(n - 1 AS DOUBLE) END AS df FROM a)
SELECT model, CAST(n AS BIGINT) AS n_pairs, round(md, 4) + 0.0 AS mean_diff, round(t, 6) + 0.0 AS t,
       round(df, 6) + 0.0 AS df, round({p}, 6) + 0.0 AS p_value FROM tt"""


WELCH_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def q_welch_report(spark, sf_dir):
    rep = ST.report_table(classified_lines(spark, sf_dir), "model", WELCH_FEATURES)
    return rep.select("model", "property", F.col("n_good").cast("bigint").alias("n_good"),
                      F.col("n_outlier").cast("bigint").alias("n_outlier"),
                      r("mean_good").alias("mean_good"), r("mean_outlier").alias("mean_outlier"),
                      r("t").alias("t"), r("df", 4).alias("df"), r("p_value").alias("p_value"),
                      "significant", r("star_y").alias("star_y"))


def _sql_welch():
    p = t_two_sided_p_sql("t", "df")
    unions = "\n      UNION ALL ".join(
        f"SELECT model, outcome, '{f}' AS property, CAST({f} AS DOUBLE) AS value FROM c" for f in WELCH_FEATURES)
    return f"""
WITH c AS {CLASSIFIED_SQL},
l AS ({unions}),
a AS (SELECT model, property,
             count(CASE WHEN outcome = 'good' THEN value END) AS n1,
             avg(CASE WHEN outcome = 'good' THEN value END) AS m1,
             var_samp(CASE WHEN outcome = 'good' THEN value END) AS v1,
             count(CASE WHEN outcome = 'outlier' THEN value END) AS n2,
             avg(CASE WHEN outcome = 'outlier' THEN value END) AS m2,
             var_samp(CASE WHEN outcome = 'outlier' THEN value END) AS v2
      FROM l GROUP BY model, property),
w AS (SELECT *, v1 / n1 AS sa, v2 / n2 AS sb, (n1 >= 2 AND n2 >= 2 AND v1 / n1 + v2 / n2 > 0) AS ok FROM a),
tt AS (SELECT *, CASE WHEN ok THEN (m1 - m2) / sqrt(sa + sb) END AS t,
              CASE WHEN ok THEN ((sa + sb) * (sa + sb)) / ((sa * sa) / (n1 - 1) + (sb * sb) / (n2 - 1)) END AS df
       FROM w)
SELECT split_part(model, ' ($', 1) AS model, property, CAST(n1 AS BIGINT) AS n_good,
       CAST(n2 AS BIGINT) AS n_outlier,
       round(coalesce(m1, 0.0), 6) + 0.0 AS mean_good, round(coalesce(m2, 0.0), 6) + 0.0 AS mean_outlier,
       round(t, 6) + 0.0 AS t, round(df, 4) + 0.0 AS df, round({p}, 6) + 0.0 AS p_value,
       coalesce({p} < 0.05, false) AS significant,
       round(greatest(coalesce(m1, 0.0), coalesce(m2, 0.0)) * 1.05, 6) + 0.0 AS star_y
FROM tt"""


# ---------------------------------------------------------------- scalars
def q_first_number(spark, sf_dir):
    d = text_table(spark, sf_dir, "documents").select("doc_id", S.first_number("text").alias("first_num"))
    return d


SQL_FIRST_NUMBER = r"""
SELECT doc_id, TRY_CAST(NULLIF(regexp_extract(text, '[-+]?\d*\.\d+|\d+', 0), '') AS DOUBLE) AS first_num
FROM documents"""


def q_comparison_metrics(spark, sf_dir):
    """P2 -> F1 -> F2 -> A1 (the comparison flow): known value = n_chars/100,
    prediction = first number written in the text."""
    d = text_table(spark, sf_dir, "documents").select(
        (F.col("n_chars") / 100.0).alias("known"), S.first_number("text").alias("predicted"))
    d = FL.drop_extreme(FL.drop_missing(d, ["known", "predicted"]), "predicted", 1000.0)
    m = M.error_metrics(d, [], "known", "predicted")
    return m.select(F.col("n").cast("bigint").alias("n"), r("rmse").alias("rmse"), r("mae").alias("mae"),
                    r("median_error").alias("median_error"))


SQL_COMPARISON_METRICS = r"""
WITH d AS (SELECT n_chars / 100.0 AS known,
                  TRY_CAST(NULLIF(regexp_extract(text, '[-+]?\d*\.\d+|\d+', 0), '') AS DOUBLE) AS predicted
           FROM documents),
k AS (SELECT * FROM d WHERE known IS NOT NULL AND predicted IS NOT NULL AND predicted < 1000)
SELECT CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((predicted - known) * (predicted - known))), 6) + 0.0 AS rmse,
       round(avg(abs(predicted - known)), 6) + 0.0 AS mae, round(median(predicted - known), 6) + 0.0 AS median_error
FROM k"""


def q_priority_number(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.first_number("o_orderpriority").alias("priority_num"))


SQL_PRIORITY_NUMBER = r"""
SELECT o_orderkey, TRY_CAST(NULLIF(regexp_extract(o_orderpriority, '[-+]?\d*\.\d+|\d+', 0), '') AS DOUBLE)
       AS priority_num FROM orders"""


def q_letter_counts(spark, sf_dir):
    d = text_table(spark, sf_dir, "documents")
    n = S.count_letter("text", "n")
    o = S.count_letter("text", "o")
    return d.select("doc_id", n.alias("num_n"), o.alias("num_o"), (n + o).alias("total_hits"))


SQL_LETTER_COUNTS = """
WITH c AS (SELECT doc_id, CAST(length(text) - length(replace(replace(text, 'N', ''), 'n', '')) AS BIGINT) AS num_n,
                  CAST(length(text) - length(replace(replace(text, 'O', ''), 'o', '')) AS BIGINT) AS num_o
           FROM documents)
SELECT doc_id, num_n, num_o, num_n + num_o AS total_hits FROM c"""


def q_outlier_labels(spark, sf_dir):
    d = classified_lines(spark, sf_dir).where(F.col("outcome") == FL.OUTLIER)
    lab = F.concat(F.col("model"), F.lit(" ($\\Delta$TPSA > 1)"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey",
                    S.label_base(lab).alias("model"),
                    S.outlier_label("calculated", "pred").alias("label"))


SQL_OUTLIER_LABELS = f"""
SELECT l_orderkey, l_linenumber, l_partkey, split_part(model || ' ($\\Delta$TPSA > 1)', ' ($', 1) AS model,
       'TPSA difference: ' || CAST(abs(round_even(calculated - pred, 2)) AS VARCHAR) AS label
FROM {CLASSIFIED_SQL} WHERE outcome = 'outlier'"""


def q_token_alphabet(spark, sf_dir):
    """Chains, chains with bracket atoms (allowed or not), and texts that are no structure."""
    k = F.col("p_partkey")
    chain = F.concat(F.lit("CC(=O)N"), F.translate(F.hex(k * 40503 + 7), "0123456789ABCDEF", "CNOcno=CCNOS()-x"))
    text = (F.when(k % 5 == 0, chain).when(k % 5 == 1, F.concat(chain, F.lit("[NH3+]"))).when(k % 5 == 2, F.concat(F.lit("[13CH4]"), chain))
            .when(k % 5 == 3, F.concat(chain, F.lit("[Na+]"))).otherwise(F.concat("p_type", F.lit(" "), chain)))
    return table(spark, sf_dir, "part").select("p_partkey", S.only_tokens(text).alias("only_cno"),
                                               S.only_tokens("p_type").alias("type_cno"), S.only_tokens(F.nullif(text, text)).alias("null_cno"))


SQL_TOKEN_ALPHABET = """
WITH t AS (SELECT p_partkey, p_type, 'CC(=O)N' || translate(upper(to_hex(p_partkey * 40503 + 7)), '0123456789ABCDEF', 'CNOcno=CCNOS()-x') AS s FROM part)
SELECT p_partkey, p_partkey % 5 < 3 AND regexp_full_match(s, '[-CNOcno=()]+')
       AND length(replace(s, '(', '')) = length(replace(s, ')', '')) AS only_cno,
       false AS type_cno, false AS null_cno
FROM t"""


def q_token_alphabet_texts(spark, sf_dir):
    """The alphabet check and the atoms of whole texts."""
    c = text_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", S.only_tokens("text").alias("only_cno"),
                    F.size(S.element_symbols("text")).cast("bigint").alias("n_atoms"))


SQL_TOKEN_ALPHABET_TEXTS = r"""
WITH t AS (SELECT conv_id, turn, text,
                  list_transform(regexp_extract_all(text, '\[[^\]]*\]|Br|Cl|[BCNOPSFI]|[bcnops]', 0),
                    lambda x: CASE WHEN starts_with(x, '[')
                                   THEN regexp_extract(x, '^\[\d*([A-Z][a-z]?|[a-z]{1,2})', 1) ELSE x END) AS raw
           FROM conversations),
s AS (SELECT *, list_transform(raw, lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))) AS syms FROM t)
SELECT conv_id, turn,
       coalesce(len(syms) > 0 AND len(list_filter(syms, lambda x: x NOT IN ('C', 'N', 'O'))) = 0
                AND regexp_full_match(text, '(\[\d*([A-Z][a-z]?|[a-z]{1,2})[^\[\]]*\]|Br|Cl|[BCNOPSFI]|[bcnops]|[-=#$:/\\~.()]|\d|%\d\d)+')
                AND length(replace(text, '(', '')) = length(replace(text, ')', ''))
                AND NOT regexp_matches(text, '^[^(]*\)'), false) AS only_cno,
       CAST(len(syms) AS BIGINT) AS n_atoms
FROM s"""


def q_range_exclusions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    d = p.select("p_partkey",
                 F.nullif(F.col("p_size"), F.lit(7)).alias("acceptors"),
                 S.to_number(F.regexp_extract("p_brand", r"#(\d+)", 1)).alias("donors"),
                 S.to_number(F.concat(F.col("p_retailprice").cast("string"),
                                      F.when(F.col("p_type") == "SMALL", F.lit("x")).otherwise(F.lit(""))))
                 .alias("mass"))
    return FL.exclude_above(d, {"acceptors": 40, "donors": 20, "mass": 1500})


SQL_RANGE_EXCLUSIONS = r"""
WITH d AS (SELECT p_partkey, nullif(p_size, 7) AS acceptors,
                  TRY_CAST(regexp_extract(p_brand, '#(\d+)', 1) AS DOUBLE) AS donors,
                  TRY_CAST(CAST(p_retailprice AS VARCHAR) || CASE WHEN p_type = 'SMALL' THEN 'x' ELSE '' END AS DOUBLE)
                  AS mass
           FROM part)
SELECT * FROM d WHERE NOT coalesce(acceptors > 40, false) AND NOT coalesce(donors > 20, false)
  AND NOT coalesce(mass > 1500, false)"""


# ---------------------------------------------------------------- joins
def q_semi_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    keys = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("o_custkey"))
    return J.semi_filter(o, keys, "o_custkey")


SQL_SEMI_SPLIT = """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""


def q_first_lookup(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    probe = ev.select("event_id", "user_id")
    build = ev.select("user_id", "value", F.struct("ts", "event_id").alias("_ord"))
    return J.first_match_lookup(probe, build, "user_id", "value", "_ord", name="first_value")


SQL_FIRST_LOOKUP = """
SELECT e.event_id, e.user_id, f.first_value FROM events e
LEFT JOIN (SELECT user_id, arg_min(value, (ts, event_id)) AS first_value FROM events GROUP BY user_id) f
USING (user_id)"""


# ---------------------------------------------------------------- ordered
def q_batch_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return O.batch_ids(c, "c_custkey", ["c_custkey"], k=10)


SQL_BATCH_IDS = """
WITH s AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS seq FROM customer)
SELECT CAST(floor(seq / 10) AS BIGINT) AS chunk, CAST(count(*) AS BIGINT) AS n_ids,
       string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY seq) AS id_list
FROM s GROUP BY 1"""


def event_edges(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("user_id", "ts", "event_id", (F.col("event_id") % 7).alias("b"),
                     (F.col("event_id") % 5).alias("e"), (F.col("event_type") != "error").alias("flag"))


def q_longest_run(spark, sf_dir):
    return O.longest_connected_run(event_edges(spark, sf_dir), "user_id", ["ts", "event_id"], "b", "e", "flag")


SQL_LONGEST_RUN = """
WITH f AS (SELECT user_id, ts, event_id, event_id % 7 AS b, event_id % 5 AS e FROM events
           WHERE event_type <> 'error'),
l AS (SELECT *, lag(b) OVER w AS pb, lag(e) OVER w AS pe FROM f
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, CASE WHEN pb IS NULL THEN 1 WHEN b IN (pb, pe) OR e IN (pb, pe) THEN 0 ELSE 1 END AS brk FROM l),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island
      FROM k),
rn AS (SELECT user_id, island, count(*) AS len FROM i GROUP BY 1, 2),
m AS (SELECT user_id, max(len) AS longest FROM rn GROUP BY 1)
SELECT u.user_id, CAST(coalesce(m.longest, 0) AS BIGINT) AS longest_run
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN m USING (user_id)"""


def q_recent_dedup(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", F.floor("value").cast("bigint").alias("k"),
        (F.col("value") - 50.0).alias("err"))
    return O.recent_dedup(ev, "user_id", ["ts", "event_id"], "k", error="err", window=5,
                          max_err=20.0, keep=["event_id"])


SQL_RECENT_DEDUP = """
WITH RECURSIVE ev AS (
  SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS k, abs(value - 50.0) < 20.0 AS ok,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
r AS (
  SELECT user_id, rn, event_id, CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS outcome,
         CASE WHEN ok THEN [k] ELSE CAST([] AS BIGINT[]) END AS st
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id,
         CASE WHEN NOT e.ok THEN 'rejected' WHEN list_contains(r.st, e.k) THEN 'duplicate' ELSE 'accepted' END,
         CASE WHEN e.ok AND NOT list_contains(r.st, e.k)
              THEN (CASE WHEN len(r.st) >= 5 THEN list_append(r.st[2:], e.k) ELSE list_append(r.st, e.k) END)
              ELSE r.st END
  FROM r JOIN ev e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, outcome FROM r"""


def q_positional_split(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    s = O.positional_split(ev, ["ts", "event_id"], 0.3)
    return s.select("event_id", F.col("seq").cast("bigint").alias("seq"), "part")


SQL_POSITIONAL_SPLIT = """
WITH s AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, count(*) OVER () AS n FROM events)
SELECT event_id, CAST(seq AS BIGINT) AS seq, CASE WHEN seq < floor(n * 0.3) THEN 'fit' ELSE 'val' END AS part FROM s"""


def q_sample_n(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return O.sample_n(ev, 100, "event_id", seed=42)


SQL_SAMPLE_N = "SELECT event_id, user_id, value FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id LIMIT 100"


QUERIES = {
    "error_metrics": q_error_metrics,
    "error_partition": q_error_partition,
    "outcome_counts": q_outcome_counts,
    "feature_summary_pop": q_feature_summary_pop,
    "feature_summary_samp": q_feature_summary_samp,
    "feature_summary_all": q_feature_summary_all,
    "histogram20": q_histogram20,
    "paired_ttest": q_paired_ttest,
    "welch_report": q_welch_report,
    "first_number": q_first_number,
    "comparison_metrics": q_comparison_metrics,
    "priority_number": q_priority_number,
    "letter_counts": q_letter_counts,
    "outlier_labels": q_outlier_labels,
    "token_alphabet": q_token_alphabet,
    "token_alphabet_texts": q_token_alphabet_texts,
    "range_exclusions": q_range_exclusions,
    "semi_split": q_semi_split,
    "first_lookup": q_first_lookup,
    "batch_ids": q_batch_ids,
    "longest_run": q_longest_run,
    "recent_dedup": q_recent_dedup,
    "positional_split": q_positional_split,
    "sample_n": q_sample_n,
}

ORACLE_SQL = {
    "error_metrics": SQL_ERROR_METRICS,
    "error_partition": SQL_ERROR_PARTITION,
    "outcome_counts": SQL_OUTCOME_COUNTS,
    "feature_summary_pop": SQL_FEATURE_SUMMARY_POP,
    "feature_summary_samp": SQL_FEATURE_SUMMARY_SAMP,
    "feature_summary_all": SQL_FEATURE_SUMMARY_ALL,
    "histogram20": SQL_HISTOGRAM20,
    "paired_ttest": _sql_paired(),
    "welch_report": _sql_welch(),
    "first_number": SQL_FIRST_NUMBER,
    "comparison_metrics": SQL_COMPARISON_METRICS,
    "priority_number": SQL_PRIORITY_NUMBER,
    "letter_counts": SQL_LETTER_COUNTS,
    "outlier_labels": SQL_OUTLIER_LABELS,
    "token_alphabet": SQL_TOKEN_ALPHABET,
    "token_alphabet_texts": SQL_TOKEN_ALPHABET_TEXTS,
    "range_exclusions": SQL_RANGE_EXCLUSIONS,
    "semi_split": SQL_SEMI_SPLIT,
    "first_lookup": SQL_FIRST_LOOKUP,
    "batch_ids": SQL_BATCH_IDS,
    "longest_run": SQL_LONGEST_RUN,
    "recent_dedup": SQL_RECENT_DEDUP,
    "positional_split": SQL_POSITIONAL_SPLIT,
    "sample_n": SQL_SAMPLE_N,
}
