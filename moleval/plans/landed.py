"""Bindings for landed API responses, prompts and answers.

Responses are built from ``part`` with ``to_json`` (one JSON text per
request of 10 ids, one id-scan page per 100 ids), so the parsing operators
run on real nested JSON whose size grows with the table.  Prompts and
example rows are built over ``part``; answers over ``events``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from moleval.functions import prompt as PR
from moleval.functions import scalars as S
from moleval.operators import curate as C
from moleval.operators import ordered as O
from moleval.plans.testdata import table
from moleval.sources import tables as SRC

REQ_SIZE = 10          # ids per property request
PAGE_SIZE = 100        # ids per id-scan page


def smiles_of(key):
    """A structure-like text of a whole number: some are plain C, N and O
    chains, some have other atoms, open branches or stray characters."""
    return F.concat(F.lit("C"), F.translate(F.hex(F.col(key) * 40503 + 7), "0123456789ABCDEF", "CNOcno=CCNOS()-x"))


SQL_SMILES = "('C' || translate(upper(to_hex(p_partkey * 40503 + 7)), '0123456789ABCDEF', 'CNOcno=CCNOS()-x'))"
# plain chains only: no bracket atoms occur here, so the check needs no atom pattern
SQL_PLAIN_CNO = ("regexp_full_match({0}, '[-CNOcno=()]+') AND length(replace({0}, '(', '')) = length(replace({0}, ')', '')) "
                 "AND NOT regexp_matches({0}, '^[^(]*[)]')")


def _records(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("CID"),
        F.when(F.col("p_brand") != "Brand#1", smiles_of("p_partkey")).alias("CanonicalSMILES"),
        (F.col("p_retailprice") / 100.0).alias("XLogP"),
        (F.col("p_retailprice") / 2.0).cast("string").alias("ExactMass"),
        (F.col("p_size") * 2.0).alias("TPSA"),
        F.floor(F.col("p_size") / 8).cast("bigint").alias("HBondDonorCount"),
        F.floor(F.col("p_size") / 4).cast("bigint").alias("HBondAcceptorCount"),
        F.col("p_size"))


def property_responses(spark, sf_dir):
    """(chunk, cid_list, status, body): a request fails (503) when one of its
    parts has size 50; absent SMILES keys are dropped by ``to_json``."""
    rec = _records(spark, sf_dir).withColumn("chunk", F.floor(F.col("CID") / REQ_SIZE).cast("bigint"))
    fields = ["CID", "CanonicalSMILES", "XLogP", "ExactMass", "TPSA", "HBondDonorCount", "HBondAcceptorCount"]
    g = rec.groupBy("chunk").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("props"),
        F.max("p_size").alias("_mx"))
    return g.select(
        "chunk",
        F.array_join(F.transform("props", lambda x: x["CID"].cast("string")), ",").alias("cid_list"),
        F.when(F.col("_mx") == 50, F.lit(503)).otherwise(F.lit(200)).alias("status"),
        F.to_json(F.struct(F.struct(F.col("props").alias("Properties")).alias("PropertyTable"))).alias("body"))


def id_scan_pages(spark, sf_dir):
    """(chunk, status, body): a page without any ECONOMY part is empty."""
    p = table(spark, sf_dir, "part").withColumn("chunk", F.floor(F.col("p_partkey") / PAGE_SIZE).cast("bigint"))
    g = p.groupBy("chunk").agg(F.collect_list(F.col("p_partkey")).alias("ids"),
                               F.count_if(F.col("p_type") == "ECONOMY").alias("_n_eco"))
    comp = F.transform("ids", lambda i: F.struct(F.struct(F.struct(i.alias("cid")).alias("id")).alias("id")))
    body = F.when(F.col("_n_eco") > 0, F.to_json(F.struct(comp.alias("PC_Compounds")))).otherwise(F.lit("{}"))
    return g.select("chunk", F.lit(200).alias("status"), body.alias("body"))


def q_property_records(spark, sf_dir):
    r = SRC.parse_property_responses(property_responses(spark, sf_dir))
    return r.select("CID", "CanonicalSMILES", F.round("XLogP", 6).alias("XLogP"), "ExactMass",
                    F.round("TPSA", 6).alias("TPSA"), "HBondDonorCount", "HBondAcceptorCount")


SQL_PROPERTY_RECORDS = """
WITH rec AS (SELECT p_partkey AS CID, CASE WHEN p_brand <> 'Brand#1' THEN @smiles END AS CanonicalSMILES,
                    p_retailprice / 100.0 AS XLogP, CAST(p_retailprice / 2.0 AS VARCHAR) AS ExactMass,
                    CAST(p_size AS DOUBLE) * 2.0 AS TPSA, CAST(floor(p_size / 8) AS BIGINT) AS HBondDonorCount,
                    CAST(floor(p_size / 4) AS BIGINT) AS HBondAcceptorCount, floor(p_partkey / 10) AS chunk,
                    p_size FROM part),
bad AS (SELECT chunk FROM rec GROUP BY chunk HAVING max(p_size) = 50)
SELECT CID, CanonicalSMILES, round(XLogP, 6) AS XLogP, ExactMass, round(TPSA, 6) AS TPSA, HBondDonorCount,
       HBondAcceptorCount
FROM rec WHERE chunk NOT IN (SELECT chunk FROM bad)""".replace("@smiles", SQL_SMILES)


def q_failed_requests(spark, sf_dir):
    return SRC.failed_requests(property_responses(spark, sf_dir))


SQL_FAILED_REQUESTS = """
SELECT string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS cid_list, 503 AS status
FROM part GROUP BY floor(p_partkey / 10) HAVING max(p_size) = 50"""


def q_max_id_scan(spark, sf_dir):
    return C.max_id_scan(id_scan_pages(spark, sf_dir), start=0)


SQL_MAX_ID_SCAN = """
WITH pg AS (SELECT floor(p_partkey / 100) AS chunk, max(p_partkey) AS mx, count(*) AS n,
                   count_if(p_type = 'ECONOMY') AS n_eco FROM part GROUP BY 1),
fb AS (SELECT min(chunk) AS first_bad FROM pg WHERE n_eco = 0),
kept AS (SELECT pg.* FROM pg, fb WHERE fb.first_bad IS NULL OR pg.chunk < fb.first_bad)
SELECT CAST(greatest(0, coalesce(max(mx), 0)) AS BIGINT) AS max_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_checked
FROM kept"""


def q_curated_records(spark, sf_dir):
    """Curation plan without a size cap: parse -> F5 -> P17 -> F4."""
    c = C.curate(property_responses(spark, sf_dir))
    return c.select("CID", "CanonicalSMILES", F.round("ExactMass", 6).alias("ExactMass"),
                    "HBondDonorCount", "HBondAcceptorCount")


SQL_CURATED_RECORDS = r"""
WITH rec AS (SELECT p_partkey AS CID, CASE WHEN p_brand <> 'Brand#1' THEN @smiles END AS CanonicalSMILES,
                    p_retailprice / 2.0 AS ExactMass, CAST(floor(p_size / 8) AS BIGINT) AS HBondDonorCount,
                    CAST(floor(p_size / 4) AS BIGINT) AS HBondAcceptorCount, floor(p_partkey / 10) AS chunk,
                    p_size FROM part),
bad AS (SELECT chunk FROM rec GROUP BY chunk HAVING max(p_size) = 50),
ok AS (SELECT * FROM rec WHERE chunk NOT IN (SELECT chunk FROM bad) AND CanonicalSMILES IS NOT NULL)
SELECT CID, CanonicalSMILES, round(ExactMass, 6) AS ExactMass, HBondDonorCount, HBondAcceptorCount FROM ok
WHERE @plain AND NOT coalesce(HBondAcceptorCount > 10, false) AND NOT coalesce(HBondDonorCount > 5, false)
  AND NOT coalesce(ExactMass > 500, false)""".replace("@smiles", SQL_SMILES).replace("@plain", SQL_PLAIN_CNO.format("CanonicalSMILES"))


def q_random_probe(spark, sf_dir):
    """P18 + A12 + J2: as many seeded random ids as ``part`` has rows, drawn
    from ``[1, max(p_partkey)]``, cut into request chunks of 10 in draw order,
    with the number of drawn ids that exist."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    stats = p.agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("mx")).first()   # two numbers
    draws = S.random_keys(spark, int(stats["n"]), int(stats["mx"]), seed=42)
    hits = draws.join(p.withColumn("_found", F.lit(1)), "key", "left")
    found = hits.groupBy(F.floor(F.col("draw") / REQ_SIZE).cast("bigint").alias("chunk")).agg(
        F.sum(F.coalesce("_found", F.lit(0))).cast("bigint").alias("n_found"))
    return O.batch_ids(draws, "key", ["draw"], k=REQ_SIZE).join(found, "chunk")


SQL_RANDOM_PROBE = """
WITH st AS (SELECT count(*) AS n, max(p_partkey) AS mx FROM part),
d AS (SELECT i AS draw, ('0x' || substr(md5(i || ':42'), 1, 15))::BIGINT % st.mx + 1 AS key FROM st, range(0, st.n) t(i)),
h AS (SELECT d.*, count(p.p_partkey) OVER (PARTITION BY draw) AS found FROM d LEFT JOIN part p ON p.p_partkey = d.key)
SELECT CAST(draw // 10 AS BIGINT) AS chunk, count(*) AS n_ids, string_agg(CAST(key AS VARCHAR), ',' ORDER BY draw) AS id_list,
       CAST(sum(found) AS BIGINT) AS n_found FROM h GROUP BY 1"""


# ---------------------------------------------------------------- prompts
PROMPT_MODELS = ["tpsa_model_abcdef", "tpsa_model_acf", "direct_model", "tpsa_model_abcdef_no_sig"]


def q_prompt_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    groups = F.array(F.col("p_type"), F.col("p_brand"))
    n = S.count_letter("p_name", "n")
    o = S.count_letter("p_name", "o")
    tbl = F.lit(PR.NO_TABLE_TEXT)
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), PR.model_prompt(m, "p_name", groups=groups, num_n=n, num_o=o, table=tbl).alias("prompt"))
                      for m in PROMPT_MODELS])
    return p.select("p_partkey", F.explode(pairs).alias("x")).select("x.model", "p_partkey", "x.prompt")


# the expected texts, written out; @groups, @table and @from are filled in below
SQL_PROMPT_PARTS = """
WITH p AS (SELECT p_partkey, p_name AS q, length(p_name) - length(replace(replace(p_name, 'N', ''), 'n', '')) AS n,
                  length(p_name) - length(replace(replace(p_name, 'O', ''), 'o', '')) AS o, @groups AS g, @table AS t, * FROM @from),
x AS (SELECT *,
 'Help predict the numerical value of the topological surface area, TPSA, for a molecule described by the SMILES code, ' || q || ', ' AS a,
 'which can be described as comprising: ' || g || '. ' AS b,
 'Return a text summary in the field contributor_description and ALWAYS end with a LIST of numbers in the variable tpsa_numbers_list that shows how each group contributes to the total TPSA value for the molecule. tpsa_numbers_list must be a list even for a single value. ' AS c,
 'provide one value from the table for each of the ' || n || ' nitrogen atoms, and ' || o || ' oxygen atoms. ' AS d,
 'Determine the contributions of each of those ' || (n + o) || ' groups to the TPSA value using this table: ' || t || ' . There may be multiple occurrences of some groups which should be treated additively. Groups containing just carbon, either aliphatic or aromatic, do not increase the TPSA value. ' AS e,
 'Respond with a single JSON object. You MUST use this format: ' AS f,
 'Predict the numerical value of the topological surface area, TPSA, for a molecule described by the SMILES code, ' || q || '. ' AS direct
 FROM p)
"""
SQL_PROMPT_TEXT = (SQL_PROMPT_PARTS.replace("@groups", "'[' || chr(39) || p_type || chr(39) || ', ' || chr(39) || p_brand || chr(39) || ']'")
                   .replace("@table", "'No data required. '").replace("@from", "part") + """
SELECT 'tpsa_model_abcdef' AS model, p_partkey, a || b || c || d || e || f AS prompt FROM x
UNION ALL SELECT 'tpsa_model_acf', p_partkey, a || c || f FROM x
UNION ALL SELECT 'direct_model', p_partkey, direct FROM x
UNION ALL SELECT 'tpsa_model_abcdef_no_sig', p_partkey, a || b || c || d || e || f FROM x""")


def q_examples(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return PR.to_examples(p, "p_name", "p_retailprice")


SQL_EXAMPLES = "SELECT true AS augmented, p_name AS question, CAST(p_retailprice AS VARCHAR) AS answer FROM part"


def q_parse_answers(spark, sf_dir):
    """P7 + P11: structured answers (JSON object with a number list) and
    plain numeric answers -> one number each."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    obj = F.to_json(F.struct(F.col("event_type").alias("contributor_description"),
                             F.array(F.col("value"), k).alias("tpsa_numbers_list")))
    answer = F.when(F.col("event_type") == "view", F.col("value").cast("string")).otherwise(obj)
    return ev.select("event_id", (F.round(S.parse_answer(answer), 6) + F.lit(0.0)).alias("answer_value"))


SQL_PARSE_ANSWERS = """
SELECT event_id, round(CASE WHEN event_type = 'view' THEN value
                            ELSE value + CAST(json_extract_string(props, '$.k') AS DOUBLE) END, 6) + 0.0
       AS answer_value FROM events"""


QUERIES = {
    "property_records": q_property_records,
    "failed_requests": q_failed_requests,
    "max_id_scan": q_max_id_scan,
    "curated_records": q_curated_records,
    "prompt_text": q_prompt_text,
    "examples": q_examples,
    "parse_answers": q_parse_answers,
    "random_probe": q_random_probe,
}

ORACLE_SQL = {
    "property_records": SQL_PROPERTY_RECORDS,
    "failed_requests": SQL_FAILED_REQUESTS,
    "max_id_scan": SQL_MAX_ID_SCAN,
    "curated_records": SQL_CURATED_RECORDS,
    "prompt_text": SQL_PROMPT_TEXT,
    "examples": SQL_EXAMPLES,
    "parse_answers": SQL_PARSE_ANSWERS,
    "random_probe": SQL_RANDOM_PROBE,
}
