"""Rule tagging bindings on ``documents`` (whole texts, every token).

The molecule study tags atoms with functional groups from an ordered rule
table; here the same operators tag whitespace tokens of every document with
token classes from an ordered rule table of regular expressions.  Tokens
holding a digit play the role of the target atoms (A16).
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from moleval.functions import scalars as S
from moleval.functions.prompt import NO_TABLE_TEXT
from moleval.operators import joins as J
from moleval.operators import rules as R
from moleval.plans.testdata import table

# --- fixed values: ordered text rule table (index, original, group, additional 1-3) ---
TEXT_RULES = [
    (1, r"^\d{1,3}(\.\d{1,3}){3}\W*$", "IP address", None, None, None),
    (2, r"^\d{13,19}\W*$", "Card number", None, None, None),
    (3, r"^\d+(\.\d+)+\.?$", "Version", None, None, None),
    (4, r"^\(\d{3}\)$", "Phone part", r"^\+\d{1,3}$", None, None),
    (5, r"^(19|20)\d{2}\W*$", "Year", None, None, None),
    (6, r"^\d{1,12}\W*$", "Number", r"^\d+[.,]\d+\W*$", None, None),
    (7, r"^\S*#{3,}$", "Junk", r"^[#*%]{3,}\S*$", None, None),
    (8, r"^[A-Z][a-z]+\W*$", "Capitalized", r"^[A-Z]{2,}\W*$", "  ", None),
    (9, r"[unclosed", "Broken rule", None, None, None),
    (10, r"^[=+*/<>-]+$", "Symbol", None, None, None),
    (11, "", "Number", r"^\d+%$", None, None),
]
# value table for the groups (one name differs in case from the rule table)
TEXT_VALUES = [
    ("IP address", 4.0), ("Card number", 8.0), ("Version", 1.5), ("Phone Part", 2.0), ("Year", 1.0),
    ("Number", 0.5), ("Junk", -1.0), ("Capitalized", 0.25), ("Symbol", 0.1),
]
TARGET_PATTERN = r"\d"
# ordered phrase rule table: a literal space separates consecutive tokens
PHRASE_RULES = [
    (1, r"^[A-Z][a-z]+ [A-Z][a-z]+\W*$", "Name pair", None, None, None),
    (2, r"^\d+ \d+\W*$", "Number pair", r"^\d+[.,]\d+ \d+\W*$", None, None),
    (3, r"^\S*### \S*###$", "Junk pair", None, None, None),
    (4, r"^[A-Z][a-z]+ [a-z]+ [A-Z][a-z]+\W*$", "Name triple", None, None, None),
]
# --- end of fixed values ---

RULE_SCHEMA = "rule_index int, original string, group string, new_1 string, new_2 string, new_3 string"
VALUE_SCHEMA = "group string, tpsa_contribution double"


def rule_table(spark):
    return spark.createDataFrame(TEXT_RULES, RULE_SCHEMA)


def value_table(spark):
    vals = [(g, v, i) for i, (g, v) in enumerate(TEXT_VALUES)]
    return spark.createDataFrame(vals, VALUE_SCHEMA + ", rank int")


def doc_tokens(spark, sf_dir):
    return R.tokenize(table(spark, sf_dir, "documents"), "doc_id", "text")


def long_rules(spark):
    return R.rules_to_long(rule_table(spark))


def doc_matches(spark, sf_dir):
    return R.match_rules(doc_tokens(spark, sf_dir), long_rules(spark), "doc_id")


def doc_groups(spark, sf_dir):
    return R.tag_rows(table(spark, sf_dir, "documents"), "doc_id", "text", long_rules(spark), target=TARGET_PATTERN)


def q_rule_matches(spark, sf_dir):
    return doc_matches(spark, sf_dir).select("doc_id", "group_rank", "group", "pattern_rank", "pos")


def q_assign_groups(spark, sf_dir):
    g = doc_groups(spark, sf_dir)
    return g.select("doc_id", F.array_join("groups", "|").alias("groups_text"), "n_assigned")


def q_unassigned(spark, sf_dir):
    g = doc_groups(spark, sf_dir)
    return g.select("doc_id", "n_targets", "unassigned")


def q_rule_coverage(spark, sf_dir):
    lr = long_rules(spark)
    counts = doc_matches(spark, sf_dir).groupBy("group_rank", "pattern_rank").agg(
        F.count(F.lit(1)).alias("n_matches"))
    return (lr.join(counts, ["group_rank", "pattern_rank"], "left")
              .select("group", "pattern", F.col("group_rank").cast("int").alias("group_rank"),
                      F.col("pattern_rank").cast("int").alias("pattern_rank"), "is_valid",
                      F.coalesce("n_matches", F.lit(0)).cast("bigint").alias("n_matches")))


def q_additive_score(spark, sf_dir):
    g = doc_groups(spark, sf_dir)
    s = R.additive_score(g, value_table(spark))
    return s.select("doc_id", (F.round("additive_score", 6) + F.lit(0.0)).alias("additive_score"))


def q_value_table_join(spark, sf_dir):
    g = doc_groups(spark, sf_dir)
    t = J.attach_value_table(g, "groups", value_table(spark))
    text = F.when(F.col("groups").isNull(), F.lit(NO_TABLE_TEXT)).otherwise(S.list_literal("data_table"))
    return t.select("doc_id", text.alias("data_table"))


def q_unmatched_names(spark, sf_dir):
    g = doc_groups(spark, sf_dir).select(F.explode("groups").alias("name"))
    return R.unmatched_names(g, value_table(spark), "name", "group")


def phrase_rules(spark):
    return R.rules_to_long(spark.createDataFrame(PHRASE_RULES, RULE_SCHEMA))


def q_phrase_matches(spark, sf_dir):
    m = R.match_phrases(table(spark, sf_dir, "documents"), "doc_id", "text", phrase_rules(spark))
    return m.select("doc_id", "group_rank", "group", "pattern_rank", F.col("match_no").alias("pos"),
                    F.size("positions").cast("int").alias("n_tokens"))


def q_phrase_groups(spark, sf_dir):
    """W3 over multi-position (phrase) matches: the ordered fold per document."""
    docs = table(spark, sf_dir, "documents")
    m = R.match_phrases(docs, "doc_id", "text", phrase_rules(spark))
    g = R.assign_groups_fold(m, "doc_id", rows=docs.select("doc_id"))
    return g.select("doc_id", F.array_join("groups", "|").alias("groups_text"),
                    F.size("assigned_positions").cast("bigint").alias("n_positions"))


def q_rule_reports(spark, sf_dir):
    """V1: invalid patterns and dropped groups of a rule table made from the types and brands of ``part``;
    every pattern of a third brand is broken."""
    p = table(spark, sf_dir, "part")
    broken = F.substring("p_brand", -1, 1).isin("3")
    rules = p.groupBy("p_brand", "p_type").agg(F.min("p_partkey").cast("int").alias("rule_index")).select(
        "rule_index", F.col("p_brand").alias("group"), F.when(broken, F.concat(F.lit("["), F.col("p_type"))).otherwise(F.concat(F.lit("^"), F.col("p_type"))).alias("original"),
        F.when(F.col("p_type") == "ECONOMY", F.lit("(open")).alias("new_1"), F.lit(None).cast("string").alias("new_2"), F.lit(" ").alias("new_3"))
    lr = R.rules_to_long(rules)
    bad = R.invalid_report(lr).select(F.explode("invalid").alias("x")).groupBy(F.col("x.group").alias("group")).agg(F.count(F.lit(1)).alias("n_invalid"))
    return bad.join(R.dropped_groups(lr).withColumn("dropped", F.lit(True)), "group", "left").select("group", "n_invalid", F.coalesce("dropped", F.lit(False)).alias("dropped"))


SQL_RULE_REPORTS = """
WITH r AS (SELECT p_brand, p_type, p_brand LIKE '%3' AS broken FROM part GROUP BY 1, 2),
n AS (SELECT p_brand, count(*) FILTER (WHERE broken) + count(*) FILTER (WHERE p_type = 'ECONOMY') AS n_invalid, bool_and(broken) AS dropped FROM r GROUP BY 1)
SELECT p_brand AS "group", CAST(n_invalid AS BIGINT) AS n_invalid, dropped FROM n WHERE n_invalid > 0"""


# ---------------------------------------------------------------- oracle SQL
def _lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def _invalid_patterns():
    bad = []
    for row in TEXT_RULES:
        for p in (row[1], row[3], row[4], row[5]):
            if p is None or not p.strip():
                continue
            try:
                re.compile(p.strip())
            except re.error:
                bad.append(p.strip())
    return bad


def _rules_sql():
    vals = ",\n    ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in TEXT_RULES)
    bad = ", ".join(_lit(b) for b in _invalid_patterns()) or "NULL"
    return f"""wide(rule_index, original, grp, new_1, new_2, new_3) AS (VALUES
    {vals}),
lw AS (SELECT rule_index, grp, trim(p) AS pattern, slot
       FROM (SELECT rule_index, grp, unnest([original, new_1, new_2, new_3]) AS p,
                    unnest(range(4)) AS slot FROM wide)
       WHERE p IS NOT NULL AND trim(p) <> ''),
lv AS (SELECT *, pattern NOT IN ({bad}) AS is_valid FROM lw),
gr AS (SELECT grp, dense_rank() OVER (ORDER BY min(rule_index), grp) - 1 AS group_rank FROM lv GROUP BY grp),
lr AS (SELECT lv.grp, lv.pattern, lv.is_valid, gr.group_rank,
              CASE WHEN lv.is_valid THEN row_number() OVER (PARTITION BY lv.grp, lv.is_valid
                                                            ORDER BY lv.rule_index, lv.slot) - 1 END
              AS pattern_rank
       FROM lv JOIN gr USING (grp)),
ur AS (SELECT * FROM lr WHERE is_valid),
s AS (SELECT doc_id, string_split_regex(text, '\\s+') AS toks FROM documents),
tk AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM s),
mt AS (SELECT tk.doc_id, ur.group_rank, ur.grp, ur.pattern_rank, tk.pos
       FROM tk JOIN ur ON regexp_matches(tk.token, ur.pattern))"""


def _assign_sql():
    return _rules_sql() + """,
d AS (SELECT *, min(group_rank) OVER (PARTITION BY doc_id, pos) AS first_g,
             row_number() OVER (PARTITION BY doc_id, pos, group_rank ORDER BY pattern_rank) AS rn FROM mt),
e AS (SELECT *, rn = 1 AND (group_rank = first_g OR pattern_rank > 0) AS assigned,
             rn = 1 AND group_rank <> first_g AND pattern_rank = 0 AS fail FROM d),
per AS (SELECT doc_id, bool_or(fail) AS failed,
               list(grp ORDER BY group_rank, pattern_rank, pos) FILTER (WHERE assigned) AS names
        FROM e GROUP BY doc_id),
tg AS (SELECT doc_id, pos FROM tk WHERE regexp_matches(token, '\\d')),
cov AS (SELECT DISTINCT doc_id, pos FROM e WHERE assigned),
ua AS (SELECT tg.doc_id, count(*) AS n_targets, count(*) FILTER (WHERE cov.pos IS NULL) AS unassigned
       FROM tg LEFT JOIN cov ON tg.doc_id = cov.doc_id AND tg.pos = cov.pos GROUP BY tg.doc_id),
g AS (SELECT doc_id,
             CASE WHEN coalesce(per.failed, false) THEN NULL
                  WHEN per.names IS NULL OR len(per.names) = 0 THEN ['No functional groups assigned.']
                  ELSE per.names END AS groups,
             CASE WHEN coalesce(per.failed, false) THEN NULL
                  ELSE CAST(coalesce(len(per.names), 0) AS BIGINT) END AS n_assigned,
             CAST(coalesce(ua.n_targets, 0) AS BIGINT) AS n_targets,
             CAST(coalesce(ua.unassigned, 0) AS BIGINT) AS unassigned
      FROM (SELECT doc_id FROM documents) docs LEFT JOIN per USING (doc_id) LEFT JOIN ua USING (doc_id))"""


def _values_sql():
    vals = ", ".join(f"({_lit(g)}, CAST({v!r} AS DOUBLE), {i})" for i, (g, v) in enumerate(TEXT_VALUES))
    return f"vt(grp, val, rnk) AS (VALUES {vals})"


SQL_RULE_MATCHES = "WITH " + _rules_sql() + """
SELECT doc_id, CAST(group_rank AS INTEGER) AS group_rank, grp AS "group", CAST(pattern_rank AS INTEGER) AS pattern_rank,
       CAST(pos AS INTEGER) AS pos FROM mt"""

SQL_ASSIGN_GROUPS = "WITH " + _assign_sql() + """
SELECT doc_id, array_to_string(groups, '|') AS groups_text, n_assigned FROM g"""

SQL_UNASSIGNED = "WITH " + _assign_sql() + """
SELECT doc_id, n_targets, unassigned FROM g"""

SQL_RULE_COVERAGE = "WITH " + _rules_sql() + """,
c AS (SELECT group_rank, pattern_rank, count(*) AS n FROM mt GROUP BY 1, 2)
SELECT lr.grp AS "group", lr.pattern, CAST(lr.group_rank AS INTEGER) AS group_rank,
       CAST(lr.pattern_rank AS INTEGER) AS pattern_rank, lr.is_valid, CAST(coalesce(c.n, 0) AS BIGINT) AS n_matches
FROM lr LEFT JOIN c ON lr.group_rank = c.group_rank AND lr.pattern_rank = c.pattern_rank"""

SQL_ADDITIVE_SCORE = "WITH " + _assign_sql() + ", " + _values_sql() + """,
x AS (SELECT doc_id, unnest(groups) AS grp FROM g WHERE groups IS NOT NULL),
sc AS (SELECT x.doc_id, sum(coalesce(vt.val, 0.0)) AS s FROM x LEFT JOIN vt USING (grp) GROUP BY x.doc_id)
SELECT g.doc_id, CASE WHEN g.groups IS NULL THEN NULL ELSE round(coalesce(sc.s, 0.0), 6) + 0.0 END AS additive_score
FROM g LEFT JOIN sc USING (doc_id)"""

SQL_VALUE_TABLE_JOIN = "WITH " + _assign_sql() + ", " + _values_sql() + """,
ent AS (SELECT g.doc_id, vt.rnk,
               '''' || lpad('group', CAST(greatest(5, length(vt.grp)) AS INTEGER), ' ') || '  '
               || lpad('tpsa_contribution', CAST(greatest(17, length(CAST(vt.val AS VARCHAR))) AS INTEGER), ' ') || '\\n'
               || lpad(vt.grp, CAST(greatest(5, length(vt.grp)) AS INTEGER), ' ') || '  '
               || lpad(CAST(vt.val AS VARCHAR), CAST(greatest(17, length(CAST(vt.val AS VARCHAR))) AS INTEGER), ' ') || '''' AS e
        FROM g JOIN vt ON list_contains(g.groups, vt.grp)),
agg AS (SELECT doc_id, string_agg(e, ', ' ORDER BY rnk) AS s FROM ent GROUP BY doc_id)
SELECT g.doc_id, CASE WHEN g.groups IS NULL THEN 'No data required. '
                      ELSE '[' || coalesce(agg.s, '') || ']' END AS data_table
FROM g LEFT JOIN agg USING (doc_id)"""

SQL_UNMATCHED_NAMES = "WITH " + _assign_sql() + ", " + _values_sql() + """,
a AS (SELECT DISTINCT unnest(groups) AS name FROM g WHERE groups IS NOT NULL),
b AS (SELECT DISTINCT grp AS name FROM vt)
SELECT name, 'left_only' AS side FROM a WHERE name NOT IN (SELECT name FROM b)
UNION ALL SELECT name, 'right_only' AS side FROM b WHERE name NOT IN (SELECT name FROM a)"""

def _phrase_sql():
    vals = ",\n    ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in PHRASE_RULES)
    lens = sorted({R.phrase_length(p) for r in PHRASE_RULES for p in (r[1], r[3], r[4], r[5]) if p})
    per_len = "\n  UNION ALL ".join(
        f"SELECT s.doc_id, i AS pos, {n} AS n, array_to_string(list_slice(s.toks, i + 1, i + {n}), ' ') AS g "
        f"FROM s, range(0, greatest(len(s.toks) - {n} + 1, 0)) t(i)" for n in lens)
    return f"""WITH wide(rule_index, original, grp, new_1, new_2, new_3) AS (VALUES
    {vals}),
lw AS (SELECT rule_index, grp, trim(p) AS pattern, slot
       FROM (SELECT rule_index, grp, unnest([original, new_1, new_2, new_3]) AS p,
                    unnest(range(4)) AS slot FROM wide)
       WHERE p IS NOT NULL AND trim(p) <> ''),
gr AS (SELECT grp, dense_rank() OVER (ORDER BY min(rule_index), grp) - 1 AS group_rank FROM lw GROUP BY grp),
lr AS (SELECT lw.grp, lw.pattern, gr.group_rank, length(lw.pattern) - length(replace(lw.pattern, ' ', '')) + 1 AS n,
              row_number() OVER (PARTITION BY lw.grp ORDER BY lw.rule_index, lw.slot) - 1 AS pattern_rank
       FROM lw JOIN gr USING (grp)),
s AS (SELECT doc_id, string_split_regex(text, '\\s+') AS toks FROM documents),
ng AS ({per_len})
SELECT ng.doc_id, CAST(lr.group_rank AS INTEGER) AS group_rank, lr.grp AS "group",
       CAST(lr.pattern_rank AS INTEGER) AS pattern_rank, CAST(ng.pos AS BIGINT) AS pos, CAST(ng.n AS INTEGER) AS n_tokens
FROM ng JOIN lr ON ng.n = lr.n AND regexp_matches(ng.g, lr.pattern)"""


SQL_PHRASE_MATCHES = _phrase_sql()

QUERIES = {
    "rule_matches": q_rule_matches,
    "assign_groups": q_assign_groups,
    "unassigned": q_unassigned,
    "rule_coverage": q_rule_coverage,
    "additive_score": q_additive_score,
    "value_table_join": q_value_table_join,
    "unmatched_names": q_unmatched_names,
    "phrase_matches": q_phrase_matches,
    "phrase_groups": q_phrase_groups,
    "rule_reports": q_rule_reports,
}

ORACLE_SQL = {
    "rule_matches": SQL_RULE_MATCHES,
    "assign_groups": SQL_ASSIGN_GROUPS,
    "unassigned": SQL_UNASSIGNED,
    "rule_coverage": SQL_RULE_COVERAGE,
    "additive_score": SQL_ADDITIVE_SCORE,
    "value_table_join": SQL_VALUE_TABLE_JOIN,
    "unmatched_names": SQL_UNMATCHED_NAMES,
    "phrase_matches": SQL_PHRASE_MATCHES,
    "rule_reports": SQL_RULE_REPORTS,
}
