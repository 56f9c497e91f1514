"""Prompt text assembly (P8) and example projection helpers (P10).

The prompt is a concatenation of template parts chosen on the driver from
the component letters; each part is a Column expression over the row, so
the whole prompt is built JVM-side.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from moleval.functions.scalars import list_literal

# --- fixed values: prompt parts of the augmented predictor ---
PART_A = ("Help predict the numerical value of the topological surface area, TPSA, for a molecule "
          "described by the SMILES code, {question}, ")
PART_B = "which can be described as comprising: {groups}. "
PART_C = ("Return a text summary in the field contributor_description and ALWAYS end with a LIST of "
          "numbers in the variable tpsa_numbers_list that shows how each group contributes to the total "
          "TPSA value for the molecule. tpsa_numbers_list must be a list even for a single value. ")
PART_D = "provide one value from the table for each of the {num_n} nitrogen atoms, and {num_o} oxygen atoms. "
PART_E = ("Determine the contributions of each of those {total_hits} groups to the TPSA value using this "
          "table: {table} . There may be multiple occurrences of some groups which should be treated "
          "additively. Groups containing just carbon, either aliphatic or aromatic, do not increase the "
          "TPSA value. ")
PART_F = "Respond with a single JSON object. You MUST use this format: "
DIRECT_PROMPT = ("Predict the numerical value of the topological surface area, TPSA, for a molecule "
                 "described by the SMILES code, {question}. ")
NO_TABLE_TEXT = "No data required. "
MODEL_PREFIX = "tpsa_model_a"   # component letters follow it in a model name
DIRECT_MODEL = "direct_model"
# --- end of fixed values ---


def components_of(model_name: str) -> str:
    """Component letters encoded in a model name ('tpsa_model_acf' -> 'cf'):
    everything after the prefix up to the next underscore."""
    return model_name.removeprefix(MODEL_PREFIX).partition("_")[0] if model_name.startswith(MODEL_PREFIX) else ""


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Template with ``{name}`` slots -> concat of literals and columns."""
    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(values[piece].cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def groups_text(groups) -> Column:
    """Python-style rendering of the group list; NULL -> 'None'."""
    g = F.col(groups) if isinstance(groups, str) else groups
    return F.coalesce(list_literal(g), F.lit("None"))


def assemble_prompt(question, components: str | None, groups=None, num_n=None,
                    num_o=None, table=None) -> Column:
    """Part a, then the parts named by ``components`` in order.

    ``None``/'' gives part a only; every letter is used, and an unknown one
    raises ``KeyError`` before any job runs.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    q = col(question)
    values = {"question": q}
    if groups is not None:
        values["groups"] = groups_text(col(groups))
    if num_n is not None and num_o is not None:
        values["num_n"] = col(num_n)
        values["num_o"] = col(num_o)
        values["total_hits"] = col(num_n) + col(num_o)
    if table is not None:
        values["table"] = col(table)
    templates = {"b": PART_B, "c": PART_C, "d": PART_D, "e": PART_E, "f": PART_F}
    pieces = [_fill(PART_A, values)]
    for letter in components or "":
        if letter not in templates:
            raise KeyError(f"unknown prompt component {letter!r}")
        pieces.append(_fill(templates[letter], values))
    return F.concat(*pieces)


def direct_prompt(question) -> Column:
    q = F.col(question) if isinstance(question, str) else question
    return _fill(DIRECT_PROMPT, {"question": q})


def model_prompt(model: str, question, **parts) -> Column:
    """The prompt a model is sent: the direct one for the direct model, else
    the parts that its name asks for."""
    if model == DIRECT_MODEL:
        return direct_prompt(question)
    return assemble_prompt(question, components_of(model), **parts)


def table_entry(name, value) -> Column:
    """One value-table row rendered as a two-column text table
    (header line, then the row, columns right-aligned)."""
    n = F.col(name) if isinstance(name, str) else name
    v = (F.col(value) if isinstance(value, str) else value).cast("string")
    w1 = F.greatest(F.lit(len("group")), F.length(n))
    w2 = F.greatest(F.lit(len("tpsa_contribution")), F.length(v))
    return F.concat(F.lpad(F.lit("group"), w1, " "), F.lit("  "), F.lpad(F.lit("tpsa_contribution"), w2, " "),
                    F.lit("\\n"), F.lpad(n, w1, " "), F.lit("  "), F.lpad(v, w2, " "))


def to_examples(df, question: str, answer: str):
    """P10: (augmented=True, question, answer as text)."""
    return df.select(F.lit(True).alias("augmented"), F.col(question).alias("question"),
                     F.col(answer).cast("string").alias("answer"))
