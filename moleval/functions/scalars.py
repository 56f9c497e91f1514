"""Column-level helpers.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` only,
so it stays inside whole-stage code generation and can be pushed around by
Catalyst like any other expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values (must equal the studied code for identical results) ---
# first number in free text: a signed decimal, else an unsigned integer
NUMBER_PATTERN = r"[-+]?\d*\.\d+|\d+"
# quoted items of a list literal such as "['Ether', 'Alcohol']"
LIST_ITEM_PATTERN = r"'([^']*)'"
# atom tokens of a SMILES string (bracket atom, two-letter halogens, organic subset)
SMILES_TOKEN_PATTERN = r"\[[^\]]*\]|Br|Cl|[BCNOPSFI]|[bcnops]"
# a whole text of atom tokens, bonds, ring closures, branches and dots
SMILES_TEXT_PATTERN = r"^(?:\[\d*(?:[A-Z][a-z]?|[a-z]{1,2})[^\[\]]*\]|Br|Cl|[BCNOPSFI]|[bcnops]|[-=#$:/\\~.()]|\d|%\d\d)+$"
# element symbol inside a bracket atom, after an optional isotope number
BRACKET_SYMBOL_PATTERN = r"^\[\d*([A-Z][a-z]?|[a-z]{1,2})"
OUTLIER_LABEL_PREFIX = "TPSA difference: "
# --- end of fixed values ---

ANSWER_SCHEMA = T.StructType([
    T.StructField("contributor_description", T.StringType()),
    T.StructField("tpsa_numbers_list", T.ArrayType(T.DoubleType())),
])


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_number(c, which: str = "first") -> Column:
    """First number in a text as double; no number -> NULL.

    ``which='last'`` takes the last number instead (a ring-closure digit of
    an echoed SMILES is often the first number in an answer).
    """
    c = _c(c)
    if which == "first":
        hit = F.regexp_extract(c, NUMBER_PATTERN, 0)
    elif which == "last":
        hit = F.element_at(F.regexp_extract_all(c, F.lit(NUMBER_PATTERN), F.lit(0)), -1)
    else:
        raise ValueError("which must be 'first' or 'last'")
    return F.nullif(hit, F.lit("")).try_cast("double")


def to_number(c) -> Column:
    """Coerce to double; unparsable -> NULL (never an ANSI error)."""
    return _c(c).cast("string").try_cast("double")


def nan_to_null(c) -> Column:
    """NaN -> NULL so that comparisons and aggregates use three-valued logic."""
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def abs_error(calculated, pred) -> Column:
    """|calculated - pred|."""
    return F.abs(_c(calculated) - _c(pred))


def signed_error(calculated, pred) -> Column:
    """Pred - calculated."""
    return _c(pred) - _c(calculated)


def count_letter(c, letter: str) -> Column:
    """P5: occurrences of one letter in both cases (characters, not atoms)."""
    cls = f"[{letter.upper()}{letter.lower()}]"
    return F.regexp_count(_c(c), F.lit(cls)).cast("bigint")


def sum_list(c) -> Column:
    """Sum of an array of doubles; empty array -> 0.0, NULL -> NULL."""
    return F.aggregate(_c(c), F.lit(0.0), lambda acc, x: acc + x)


def list_literal(c) -> Column:
    """Array of strings -> "['a', 'b']" text (the form a list is saved in)."""
    return F.concat(F.lit("["), F.array_join(
        F.transform(_c(c), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def parse_list_literal(c) -> Column:
    """P9: "['a', 'b']" -> array('a','b'); NULL/empty cell -> NULL."""
    c = _c(c)
    return F.when(F.trim(c) == "", F.lit(None)).otherwise(
        F.regexp_extract_all(c, F.lit(LIST_ITEM_PATTERN), F.lit(1)))


def parse_answer(c) -> Column:
    """Answer text -> number.

    A JSON object ``{contributor_description, tpsa_numbers_list}`` gives the
    sum of its list; plain numeric text is taken as the number.
    """
    c = _c(c)
    parsed = F.from_json(c, ANSWER_SCHEMA)
    return F.coalesce(sum_list(parsed["tpsa_numbers_list"]), c.try_cast("double"))


def outlier_label(calculated, pred) -> Column:
    """P12: "TPSA difference: <|round(c - p, 2)|>" (half-even rounding)."""
    diff = F.abs(F.bround(_c(calculated) - _c(pred), 2))
    return F.concat(F.lit(OUTLIER_LABEL_PREFIX), diff.cast("string"))


def label_base(c, marker: str = " ($") -> Column:
    """Text before the first ``marker``."""
    return F.substring_index(_c(c), marker, 1)


def match_score(answer, pred) -> Column:
    """-|answer - pred| (higher is better)."""
    return -F.abs(_c(answer) - _c(pred))


def log_texts(answer, pred) -> tuple[Column, Column]:
    """The question/answer text of an example log row."""
    return (F.concat(F.lit("True TPSA: "), _c(answer).cast("string")),
            F.concat(F.lit("Predicted TPSA: "), _c(pred).cast("string")))


def clean_patterns(arr) -> Column:
    """Trim each pattern and drop NULL / blank ones."""
    return F.filter(F.transform(_c(arr), lambda x: F.trim(x)),
                    lambda x: x.isNotNull() & (x != ""))


def element_symbols(c) -> Column:
    """Element symbol of every atom token of a SMILES string, upper-cased
    first letter (aromatic ``c`` -> ``C``)."""
    toks = F.regexp_extract_all(_c(c), F.lit(SMILES_TOKEN_PATTERN), F.lit(0))
    return F.transform(toks, lambda t: F.initcap(F.when(
        F.startswith(t, F.lit("[")),
        F.regexp_extract(t, BRACKET_SYMBOL_PATTERN, 1)).otherwise(t)))


def only_tokens(c, allowed=("C", "N", "O")) -> Column:
    """True when the whole text is atom tokens, bonds, ring closures,
    branches and dots, and every atom token is in ``allowed``; NULL, empty,
    token-free text or any leftover -> False.  Brackets and parentheses must
    pair up; valence is not checked."""
    c = _c(c)
    syms = element_symbols(c)
    allowed_arr = F.array(*[F.lit(a) for a in allowed])
    branches = (F.regexp_count(c, F.lit(r"\(")) == F.regexp_count(c, F.lit(r"\)"))) & ~c.rlike(r"^[^(]*\)")
    ok = (c.rlike(SMILES_TEXT_PATTERN) & branches & (F.size(syms) > 0)
          & F.forall(syms, lambda s: F.array_contains(allowed_arr, s)))
    return F.coalesce(ok, F.lit(False))


def random_keys(spark, n: int, max_key: int, seed: int = 42):
    """``n`` ids drawn with replacement from ``[1, max_key]``,
    reproducible for a seed (md5 of draw number and seed, not ``rand``)."""
    text = F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return spark.range(n).select(F.col("id").alias("draw"), (number % F.lit(max_key) + 1).alias("key"))
