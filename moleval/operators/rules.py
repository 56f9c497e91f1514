"""Ordered rule tables, rule matching and exclusive group assignment
(A13, V1, V2, J6, W3, A16).

A rule table is ordered: groups in order of first appearance, and inside a
group its patterns in row order; the first valid pattern of a group is its
*original* pattern (``pattern_rank = 0``), the others are *additional*.

Matching works on tokens (one position per match).  The assignment W3 is
given in two exact forms:

* :func:`assign_groups` for single-position matches -- the decision of a
  match only depends on the other matches at the same position, so it is a
  window over ``(row, position)`` (at most one entry per rule) followed by
  one aggregate per row: no sequential state, no hot task beyond one row.
* :func:`assign_groups_fold` for matches covering several positions (atom
  sets of a molecule): an ordered fold per row over its sorted matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from moleval.operators.common import col, null_safe_join
from moleval.operators.joins import matched_values
from moleval.operators.ordered import identity_text
from moleval.operators.patterns import HEAD, is_piece, key_kind, pattern_keys, text_keys, witness
from moleval.session import cut_lineage

# --- fixed values ---
NO_GROUPS = "No functional groups assigned."
# --- end of fixed values ---


def regex_valid(pattern) -> Column:
    """V1: True when ``pattern`` compiles as a Java regular expression (the
    engine ``rlike`` uses); evaluated natively, a failed compile gives NULL."""
    compiled = F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), col(pattern))
    return F.coalesce(compiled.isNotNull(), F.lit(False))


def rules_to_long(rules: DataFrame, group: str = "group", index: str = "rule_index",
                  original: str | None = "original", extra=("new_1", "new_2", "new_3"),
                  validate: bool = True) -> DataFrame:
    """A13 + V1: wide rule rows -> one row per pattern.

    Output ``(group_rank, group, pattern_rank, pattern, is_valid, rule_index, slot)``.
    Patterns are trimmed, blank/NULL ones dropped (P16); invalid ones keep
    ``is_valid = false`` and get no rank.  ``original=None`` ignores the
    original column (the studied curation step read it under another name).
    """
    slots = ([original] if original else []) + list(extra)
    arr = F.array(*[col(c).cast("string") for c in slots])
    long = (rules.select(col(index).alias("rule_index"), col(group).alias("group"),
                         F.posexplode(arr).alias("slot", "pattern"))
                 .withColumn("pattern", F.trim("pattern"))
                 .where(F.col("pattern").isNotNull() & (F.col("pattern") != "")))
    long = long.withColumn("is_valid", regex_valid("pattern") if validate else F.lit(True))
    first_seen = long.groupBy("group").agg(F.min("rule_index").alias("_first"))
    ranked_groups = first_seen.where(F.col("group").isNotNull()).select(
        "group", (F.dense_rank().over(Window.orderBy("_first", "group")) - 1).cast("int").alias("group_rank"))
    out = long.join(ranked_groups, "group", "left")
    pr = F.when(F.col("is_valid"), F.row_number().over(
        Window.partitionBy("group", "is_valid").orderBy("rule_index", "slot")) - 1).cast("int")
    return out.withColumn("pattern_rank", pr).select(
        "group_rank", "group", "pattern_rank", "pattern", "is_valid", "rule_index", "slot")


def usable_rules(long_rules: DataFrame) -> DataFrame:
    """Valid patterns of groups that have at least one valid pattern."""
    return long_rules.where(F.col("is_valid") & F.col("group_rank").isNotNull())


def dropped_groups(long_rules: DataFrame) -> DataFrame:
    """Groups without any valid pattern (reported, not used)."""
    return (long_rules.groupBy("group").agg(F.max(F.col("is_valid").cast("int")).alias("_ok"))
            .where(F.col("_ok") == 0).select("group"))


def invalid_report(long_rules: DataFrame) -> DataFrame:
    """V1: one row with the number and list of invalid patterns."""
    bad = long_rules.where(~F.col("is_valid"))
    return bad.agg(F.count(F.lit(1)).alias("n_invalid"),
                   F.sort_array(F.collect_list(F.struct("group", "pattern"))).alias("invalid"))


def unmatched_names(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """V2: names that occur on one side only (exact, case-sensitive).

    One full outer join of the two distinct name sets, so each input plan is
    evaluated once (two anti-joins would evaluate each side twice)."""
    a = (left.select(col(left_name).alias("name")).where(F.col("name").isNotNull()).distinct()
         .withColumn("_l", F.lit(True)))
    b = (right.select(col(right_name).alias("name")).where(F.col("name").isNotNull()).distinct()
         .withColumn("_r", F.lit(True)))
    j = a.join(b, "name", "full_outer").where(F.col("_l").isNull() | F.col("_r").isNull())
    return j.select("name", F.when(F.col("_r").isNull(), F.lit("left_only"))
                    .otherwise(F.lit("right_only")).alias("side"))


def tokenize(df: DataFrame, row_id: str, text: str, pattern: str = r"\s+") -> DataFrame:
    """Whole text -> ``(row_id, pos, token)``, positions 0-based."""
    return df.select(col(row_id).alias(row_id),
                     F.posexplode(F.split(col(text), pattern)).alias("pos", "token"))


MAX_BEGINS = 1_000              # first characters that a run of tokens is tested for
INDEX_BYTES = 64 << 20         # a rule index up to this size is broadcast; a larger one is joined by its keys


@dataclass(frozen=True)
class RuleIndex:
    """The usable rules by key: ``rows`` (_key, _n, group_rank, group, pattern_rank, pattern), written once.

    A rule stands under keys of which every matching text has one (see
    :mod:`moleval.operators.patterns`), and ``_n`` tokens are matched together.
    ``kinds`` and ``lengths`` are the few kinds of keys and numbers of tokens in use,
    ``witnesses`` characters of which every literal piece has one (None: too many).
    """
    rows: DataFrame
    size: int
    kinds: list[str]
    lengths: list[int]
    witnesses: list[str] | None

    def joined(self) -> DataFrame:
        return F.broadcast(self.rows) if self.size <= INDEX_BYTES else self.rows


def rule_index(rules: DataFrame, phrases: bool = False) -> RuleIndex:
    """Index of the usable rules.  A rule with a required literal stands under that piece of it
    that the fewest rules have; ``phrases`` takes a rule's literal spaces as breaks between tokens."""
    @arrow_udf("struct<keys: array<string>, n: int>")
    def read(patterns: pa.Array) -> pa.Array:
        keys = pa.array([pattern_keys(p) for p in patterns.to_pylist()], pa.list_(pa.string()))
        n = pa.array([phrase_length(p) if phrases else 1 for p in patterns.to_pylist()], pa.int32())
        return pa.StructArray.from_arrays([keys, n], ["keys", "n"])

    rule = ["group_rank", "pattern_rank"]
    keyed = (usable_rules(rules).select(*[F.col(c).cast("int").alias(c) for c in rule], "group", "pattern", read("pattern").alias("k"))
             .select(*rule, "group", "pattern", F.col("k.n").alias("_n"), F.explode("k.keys").alias("_key")))
    keyed = cut_lineage(keyed)
    literal = is_piece(F.col("_key"))
    often = keyed.where(literal).groupBy("_key").agg(F.count(F.lit(1)).alias("_often"))
    rarest = keyed.where(literal).join(often, "_key").groupBy(*rule, "group", "pattern", "_n").agg(F.min(F.struct("_often", "_key"))["_key"].alias("_key"))
    cols = ["_key", "_n", "group_rank", "group", "pattern_rank", "pattern"]
    rows = cut_lineage(keyed.where(~literal).select(*cols).unionByName(rarest.select(*cols)))
    one = rows.agg(F.sum(F.length("pattern") + F.length("group") + 80), F.sort_array(F.collect_set(key_kind(F.col("_key")))), F.sort_array(F.collect_set("_n")),
                   F.slice(F.sort_array(F.collect_set(F.when(literal, witness(F.col("_key"))))), 1, MAX_BEGINS + 1)).first()
    return RuleIndex(rows, one[0] or 0, one[1], one[2], one[3] if len(one[3]) <= MAX_BEGINS else None)


def _matches(texts: DataFrame, index: RuleIndex, keep_null: Column | None = None) -> DataFrame:
    """Rows of ``texts`` (``_text``, ``_n`` and others) with every rule that matches them.

    A text meets only the rules under one of its keys, and is then tested against each.  Rows
    with ``keep_null`` also come once without a rule.
    """
    none = F.array().cast("array<string>")
    keys = text_keys(F.col("_text"), index.kinds, index.witnesses)
    if keep_null is not None:
        keys = F.concat(keys, F.when(keep_null, F.array(F.lit(None).cast("string"))).otherwise(none))
    met = texts.select("*", F.explode(F.coalesce(keys, none) if keep_null is None else F.when(F.col("_text").isNull(), F.array(F.lit(None).cast("string"))).otherwise(keys)).alias("_key"))
    hit = F.rlike(F.col("_text"), F.col("pattern"))
    if keep_null is None:
        return met.join(index.joined(), ["_key", "_n"]).where(hit).drop("_key", "pattern")
    return met.join(index.joined(), ["_key", "_n"], "left").where(F.col("_key").isNull() | hit).drop("_key", "pattern")


def match_rules(tokens: DataFrame, rules: DataFrame, row_id: str, token: str = "token",
                pos: str = "pos", flag=None, flag_name: str = "is_target") -> DataFrame:
    """Every usable rule pattern against every token.

    Output ``(row_id, group_rank, group, pattern_rank, match_no, pos)`` where
    ``match_no`` orders a pattern's matches inside a row (the position).

    The rules are data: a token meets those that an index gives for its keys
    (:func:`rule_index`) in one equi-join, broadcast while the index is small and
    shuffled beyond that, so work follows the rules that can match and not their
    number.

    ``flag`` (a boolean Column over the token) adds a row without a rule for
    every flagged token and the flag as ``flag_name``, so target tokens (A16)
    come from the same scan as the matches.
    """
    flagged = [] if flag is None else [F.coalesce(flag, F.lit(False)).alias(flag_name)]
    t = tokens.select(col(row_id).alias(row_id), col(pos).alias("_pos"), col(token).alias("_text"), F.lit(1).alias("_n"), *flagged)
    m = _matches(t, rule_index(rules), None if flag is None else F.col(flag_name))
    return m.select(row_id, "group_rank", "group", "pattern_rank", F.col("_pos").cast("bigint").alias("match_no"),
                    F.col("_pos").cast("int").alias("pos"), *([flag_name] if flagged else []))


def phrase_length(pattern: str) -> int:
    """Tokens a pattern spans: one more than its literal spaces outside
    character classes (``^[A-Z]\\w+ \\d{4}$`` spans two tokens)."""
    n, in_class, esc = 1, False, False
    for ch in pattern:
        if esc:
            esc = False
        elif ch == "\\":
            esc = True
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == " ":
            n += 1
    return n


def match_phrases(df: DataFrame, row_id: str, text: str, rules: DataFrame, split: str = r"\s+") -> DataFrame:
    """J6 for phrase rules: a pattern with ``k`` literal spaces is matched
    against every run of ``k + 1`` consecutive tokens joined by one space.

    Output ``(row_id, group_rank, group, pattern_rank, match_no, positions)``
    with ``positions`` the token positions covered (input of
    :func:`assign_groups_fold`).  A run is built only where its first token begins
    like a rule of that length can (unless a rule may begin with anything), and
    meets the rules that the index gives for its keys.
    """
    index = rule_index(rules, phrases=True)
    begins = {r["_n"]: r["c"] for r in index.rows.groupBy("_n").agg(
        F.when(F.bool_and(F.col("_key").startswith(HEAD)), F.sort_array(F.slice(F.collect_set(F.substring("_key", len(HEAD) + 1, 1)), 1, MAX_BEGINS + 1))).alias("c")).collect()}
    none = F.array().cast("array<struct<p: int, n: int, t: string>>")

    def runs(n: int) -> Column:
        at = F.sequence(F.lit(0), F.size("_toks") - n)
        if begins.get(n) and len(begins[n]) <= MAX_BEGINS:
            # the run begins with the space behind an empty first token
            at = F.filter(at, lambda i: F.substring(F.concat(F.get("_toks", i), F.lit(" " if n > 1 else "")), 1, 1).isin(begins[n]))
        run = F.transform(at, lambda i: F.struct(i.alias("p"), F.lit(n).alias("n"), F.array_join(F.slice("_toks", i + 1, F.lit(n)), " ").alias("t")))
        return F.when(F.size("_toks") >= n, run).otherwise(none)

    base = df.select(col(row_id).alias(row_id), F.split(col(text), split).alias("_toks"))
    ex = base.select(row_id, F.explode(F.concat(none, *[runs(n) for n in index.lengths])).alias("_g"))
    m = _matches(ex.select(row_id, F.col("_g.p").alias("_p"), F.col("_g.n").alias("_n"), F.col("_g.t").alias("_text")), index)
    return m.select(row_id, "group_rank", "group", "pattern_rank", F.col("_p").cast("bigint").alias("match_no"),
                    F.sequence(F.col("_p"), F.col("_p") + F.col("_n") - 1).cast("array<int>").alias("positions"))


def assign_groups(matches: DataFrame, row_id: str, rows: DataFrame | None = None,
                  targets: DataFrame | None = None, pos: str = "pos",
                  target_flag: str | None = None, carry: str | None = None) -> DataFrame:
    """W3 (+A16) for single-position matches.

    For a position, the first match (rule order) is assigned.  A later group
    reaching an already assigned position: its *original* pattern makes the
    whole row NULL (conflict); an *additional* pattern is assigned anyway
    (overlap with other groups only); further matches of a group already
    holding the position are skipped.

    Output per row: ``groups`` (assigned group names in rule order, NULL on
    conflict, ``['No functional groups assigned.']`` when empty),
    ``n_assigned``; with ``targets`` (row_id, pos) also ``n_targets`` and
    ``unassigned`` (target positions not covered, A16).
    ``rows`` adds rows without any match.  Instead of ``targets``,
    ``target_flag`` names a boolean column of ``matches`` (see the ``flag``
    of :func:`match_rules`); rows with NULL rule columns are no matches.
    ``carry`` names a column that one row of every ``row_id`` has: it is kept.
    """
    is_match = F.col("group_rank").isNotNull()
    extra = ([F.col(target_flag).alias("_is_target")] if target_flag else []) + ([F.col(carry).alias("_carry")] if carry else [])
    m = matches.select(col(row_id).alias("_r"), col(pos).alias("_p"), "group_rank", "group",
                       "pattern_rank", "match_no", is_match.alias("_is_match"), *extra)
    parts = [m]
    if rows is not None:
        parts.append(rows.select(col(row_id).alias("_r")).withColumn("_is_match", F.lit(False)))
    if targets is not None:
        parts.append(targets.select(col(row_id).alias("_r"), col(pos).alias("_p"))
                     .withColumn("_is_target", F.lit(True)))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    u = u.repartition("_r")
    at_pos = Window.partitionBy("_r", "_p")
    in_group = Window.partitionBy("_r", "_p", "group_rank").orderBy("pattern_rank", "match_no")
    is_m = F.coalesce(F.col("_is_match"), F.lit(False))
    first_g = F.min(F.when(is_m, F.col("group_rank"))).over(at_pos)
    lead = F.when(is_m, F.row_number().over(in_group) == 1)
    d = (u.withColumn("_first_g", first_g).withColumn("_lead", F.coalesce(lead, F.lit(False)))
          .withColumn("_assigned", is_m & F.col("_lead") &
                      ((F.col("group_rank") == F.col("_first_g")) | (F.col("pattern_rank") > 0)))
          .withColumn("_fail", is_m & F.col("_lead") & (F.col("group_rank") != F.col("_first_g"))
                      & (F.col("pattern_rank") == 0)))
    d = d.withColumn("_covered", F.max(F.col("_assigned").cast("int")).over(at_pos) == 1)
    agg = [F.max(F.col("_fail").cast("int")).alias("_failed"),
           F.sort_array(F.collect_list(F.when(F.col("_assigned"),
                                              F.struct("group_rank", "pattern_rank", "match_no", "group"))))
           .alias("_hits")]
    tgt = F.coalesce(F.col("_is_target"), F.lit(False))
    uncovered = tgt & ~F.coalesce(F.col("_covered"), F.lit(False))
    if targets is not None:
        agg += [F.count_if(tgt).alias("n_targets"), F.count_if(uncovered).alias("unassigned")]
    elif target_flag:        # a target token may sit on several match rows: count positions
        agg += [F.size(F.collect_set(F.when(tgt, F.col("_p")))).alias("n_targets"),
                F.size(F.collect_set(F.when(uncovered, F.col("_p")))).alias("unassigned")]
    if carry:
        agg.append(F.first("_carry", ignorenulls=True).alias("_carry"))
    out = d.groupBy("_r").agg(*agg)
    names = F.transform(F.col("_hits"), lambda h: h["group"])
    groups = (F.when(F.coalesce(F.col("_failed"), F.lit(0)) == 1, F.lit(None))
               .when(F.size(names) == 0, F.array(F.lit(NO_GROUPS))).otherwise(names))
    cols = [F.col("_r").alias(row_id), *(["_carry"] if carry else []), groups.alias("groups"),
            F.when(F.coalesce(F.col("_failed"), F.lit(0)) == 1, F.lit(None))
             .otherwise(F.size(names)).cast("bigint").alias("n_assigned")]
    if targets is not None or target_flag:
        cols += [F.col("n_targets").cast("bigint").alias("n_targets"),
                 F.col("unassigned").cast("bigint").alias("unassigned")]
    return out.select(*cols)


def tag_rows(df: DataFrame, row_id: str, text: str, rules: DataFrame, split: str = r"\s+", target: str | None = None,
             keep: list | None = None) -> DataFrame:
    """J6 + W3 + A16 from one scan of ``df``: the ``keep`` columns (the id, else) with
    ``groups`` and ``n_assigned``, and with ``target`` (a pattern of target tokens)
    ``n_targets`` and ``unassigned``.

    Rows are told apart by a number of their own, so rows with a NULL or
    repeated id are tagged each by itself; one extra token of every row, without text,
    takes its columns through the shuffle of the matches.  The columns are the same
    whatever the rule table holds.
    """
    keep = keep or [row_id]
    src = df.select(F.struct(*keep).alias("_carry"), F.split(col(text), split).alias("_toks"), F.monotonically_increasing_id().alias("_rid"))
    kind = src.schema["_carry"].dataType
    no_carry = F.lit(None).cast(kind)
    word = lambda p, t, c: F.struct(p.cast("int").alias("p"), t.cast("string").alias("t"), c.alias("c"))
    words = F.coalesce(F.transform("_toks", lambda t, i: word(i, t, no_carry)), F.array().cast(f"array<struct<p: int, t: string, c: {kind.simpleString()}>>"))
    tokens = src.select("_rid", F.explode(F.concat(F.array(word(F.lit(-1), F.lit(None), F.col("_carry"))), words)).alias("_w"))
    is_target = F.coalesce(F.rlike(F.col("_w.t"), F.lit(target)), F.lit(False)) if target else F.lit(False)
    tokens = tokens.select("_rid", F.col("_w.p").alias("pos"), F.col("_w.t").alias("_text"), F.lit(1).alias("_n"), F.col("_w.c").alias("_carry"), is_target.alias("is_target"))
    m = _matches(tokens, rule_index(rules), F.col("is_target") | F.col("_text").isNull())
    m = m.withColumn("match_no", F.col("pos").cast("bigint"))
    tags = assign_groups(m, "_rid", target_flag="is_target" if target else None, carry="_carry")
    return tags.select("_carry.*", *[c for c in tags.columns if c not in ("_rid", "_carry")])


_MATCH_ORDER = ["group_rank", "pattern_rank", "match_no"]


class _Fold:
    """W3 over one row's matches in order; a position knows the groups that hold it, so a match costs its own positions."""

    def __init__(self):
        self.held: dict[int, set[int]] = {}
        self.names: list[str] = []
        self.failed = False

    def take(self, rank: int, name: str, pattern_rank: int, positions: list[int]) -> None:
        if self.failed:
            return
        holders = [self.held[p] for p in positions if p in self.held]
        if holders and any(rank in h for h in holders):
            return
        if holders and pattern_rank == 0:
            self.failed = True
            return
        self.names.append(name)
        for p in positions:
            self.held.setdefault(p, set()).add(rank)

    def result(self) -> tuple[list[str] | None, list[int]]:
        return None if self.failed else self.names or [NO_GROUPS], sorted(self.held)


def _fold_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (row, match order): one result per row."""
    last, fold, row = None, None, None

    def out():
        groups, positions = fold.result()
        return pa.RecordBatch.from_arrays([row, pa.array([groups], pa.list_(pa.string())), pa.array([positions], pa.list_(pa.int32()))],
                                          ["_row", "groups", "assigned_positions"])

    for b in batches:
        ids = b.column(b.schema.get_field_index("_row"))
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_key", "group_rank", "group", "pattern_rank", "positions")]
        for i, (key, rank, name, pattern_rank, positions) in enumerate(zip(*cols, strict=True)):
            if fold is None or key != last:
                if fold is not None:
                    yield out()
                last, fold, row = key, _Fold(), ids.slice(i, 1)
            fold.take(rank, name, pattern_rank, positions or [])
    if fold is not None:
        yield out()


def assign_groups_fold(matches: DataFrame, row_id: str, rows: DataFrame | None = None) -> DataFrame:
    """W3 (+A16) for matches covering several positions, as an ordered fold.

    ``matches``: ``(row_id, group_rank, group, pattern_rank, match_no,
    positions ARRAY<INT>)``; the fold walks a row's matches in
    (group_rank, pattern_rank, match_no) order.  A match without overlap is
    assigned; an overlap including its own group is skipped; an overlap with
    other groups only fails the row for an original pattern and is assigned
    for an additional one.

    Matches are shuffled by row and sorted (an external sort); the walk keeps
    the groups of every held position, so its time is linear in the row's
    matched positions and its memory is that of the held ones.  ``rows`` adds
    rows without any match (no-groups sentinel); NULL is an id like any other.
    """
    m = matches.select(col(row_id).alias("_row"), identity_text(matches.select(col(row_id).alias(row_id)), [row_id]).alias("_key"),
                       F.col("group_rank").cast("int").alias("group_rank"), F.col("pattern_rank").cast("int").alias("pattern_rank"),
                       F.col("match_no").cast("bigint").alias("match_no"), "group", F.col("positions").cast("array<int>").alias("positions"))
    srt = m.repartition("_key").sortWithinPartitions("_key", *_MATCH_ORDER, "group", "positions")
    schema = T.StructType([T.StructField("_row", m.schema["_row"].dataType), T.StructField("groups", T.ArrayType(T.StringType())),
                           T.StructField("assigned_positions", T.ArrayType(T.IntegerType()))])
    res = srt.mapInArrow(_fold_partition, schema).withColumnRenamed("_row", row_id)
    if rows is None:
        return res
    res = null_safe_join(rows.select(col(row_id).alias(row_id)), res.withColumn("_met", F.lit(True)), [row_id], "left")
    return res.select(row_id, F.when(F.col("_met").isNull(), F.array(F.lit(NO_GROUPS))).otherwise(F.col("groups")).alias("groups"),
                      F.coalesce("assigned_positions", F.array().cast("array<int>")).alias("assigned_positions"))


def unassigned_positions(assigned: DataFrame, target_positions: str,
                         assigned_positions: str = "assigned_positions") -> DataFrame:
    """Target positions no group covers, and their count."""
    rest = F.array_except(col(target_positions), F.coalesce(col(assigned_positions), F.array()))
    return assigned.withColumn("unassigned", rest).withColumn("n_unassigned", F.size(rest))


def additive_score(assigned: DataFrame, values: DataFrame, groups: str = "groups", name: str = "group",
                   value: str = "tpsa_contribution", out: str = "additive_score") -> DataFrame:
    """Sum of the value of every assigned group occurrence (unknown
    names and the 'no groups' sentinel add 0; NULL groups -> NULL).  A name
    with several value rows adds all of them."""
    v = (values.select(col(name).alias(name), col(value).cast("double").alias("v")).groupBy(name).agg(F.sum("v").alias("v")))
    hit = matched_values(assigned, groups, v, name, ["v"])
    score = F.aggregate(F.coalesce(F.col("_hits"), F.array()), F.lit(0.0),
                        lambda acc, x: acc + F.coalesce(x["v"], F.lit(0.0)) * x["times"])
    return hit.withColumn(out, F.when(col(groups).isNotNull(), score)).drop("_rid", "_hits")
