"""URL filter: rules first, then naive Bayes over the words of host and path.

Words: host labels and path parts are cut at everything but letters, and each
letter run is split into words by a unigram Viterbi search.  The unigram counts
come from all documents, all hyphenated names and all top-level names in the
URLs, and every seed word counts once more; an unknown run of letters costs ten
times more for each letter.  Every counted word of any length takes part: the
substrings of the distinct runs are joined with the counts, and each distinct
run is split beside its own matched words, so no lexicon is sent to tasks.

Classes: hosts that contain a seed word count as ``block``, all others as
``allow``; multinomial naive Bayes over all pages, with words hashed to
``2**BITS`` buckets, then weighs every word that stands with them, so a host
without a seed can be blocked by its company.

Null URLs and URLs without ``://`` have empty host and path, no words, and the
verdict of the larger class; equal weights allow; without documents URL names
and seeds are the known words; repeated rows are judged alike; an empty table gives
an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from moleval.llm.words import fields
from moleval.session import cut_lineage

BITS = 18
SMOOTHING = 0.1
SEEDS = ("adult", "ads", "bets", "casino", "escort", "gambling", "pills", "poker", "porn", "sex", "spam", "viagra", "warez", "xxx")
# (verdict, host/path prefix); a rule covers its host and all subdomains
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    h = F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit(""))
    return F.translate(h, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def word_counts(pages: DataFrame, docs: DataFrame | None, url: str = "url", text: str = "text", seeds=SEEDS) -> DataFrame:
    """Count ``n`` of every word ``w``, written once."""
    def words(c: Column) -> Column:
        return F.explode(F.split(F.lower(c), "[^a-z]+"))

    u = pages.select(F.concat(host_of(F.col(url)), path_of(F.col(url))).alias("u"))
    names = u.select(F.explode(F.regexp_extract_all(F.lower("u"), F.lit("[a-z]+(?:[-_][a-z]+)+"), 0)).alias("u"))
    found = names.select(words(F.col("u")).alias("w")).union(
        pages.select(F.regexp_extract(host_of(F.col(url)), r"\.([a-z]+)$", 1).alias("w")))
    if docs is not None:
        found = found.union(docs.select(words(F.col(text)).alias("w")))
    if seeds:
        found = found.union(pages.sparkSession.createDataFrame([(w,) for w in seeds], "w string"))
    return cut_lineage(found.where(F.length("w") > 0).groupBy("w").agg(F.count(F.lit(1)).alias("n")))


class Segmenter:
    """Most likely split of a run of letters under a unigram model: log10
    probabilities of words, '' holds the log10 of all counted words."""

    def __init__(self, words: dict[str, float]):
        self.words, self.total = words, words.get("", 0.0)
        self.lengths = sorted({len(w) for w in words if w})

    def split(self, run: str) -> list[str]:
        best, back = [0.0], [0]
        open_cost, open_at = 0.0, 0     # cheapest start of an unknown word: cost up to it less its position
        for end in range(1, len(run) + 1):
            cost, start = open_cost + self.total + end, open_at
            for n in self.lengths:
                if n > end:
                    break
                known = self.words.get(run[end - n:end])
                if known is not None:
                    cost, start = min((cost, start), (best[end - n] - known, end - n))
            best.append(cost)
            back.append(start)
            if cost - end < open_cost:
                open_cost, open_at = cost - end, end
        out, end = [], len(run)
        while end:
            out.append(run[back[end]:end])
            end = back[end]
        return out[::-1]

    def words_of(self, s: str) -> list[str]:
        return [w for run in "".join(c if "a" <= c <= "z" else " " for c in s.lower()).split() for w in self.split(run)]


def _letters(c: Column) -> Column:
    """The letter runs of a text with one space between."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " "))


def splits(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """``run`` and its words ``split``, for distinct ``run``s (the empty run has none)."""
    longest = runs.agg(F.max(F.length("run"))).first()[0] or 0
    of = counts.agg(F.sum("n").alias("n"), F.collect_set(F.when(F.length("w") <= longest, F.length("w"))).alias("lengths")).first()
    total, lengths = max(of.n or 0, 1), sorted(of.lengths)
    # one row per place, then per length a word has: no array grows with more than the number of such lengths
    places = runs.where("run <> ''").select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    parts = places.select("run", "at", F.explode(F.filter(F.lit(lengths).cast("array<int>"), lambda n: F.col("at") + n - 1 <= F.length("run"))).alias("len"))
    known = (parts.select("run", F.col("run").substr(F.col("at"), F.col("len")).alias("w")).join(counts, "w")
             .groupBy("run").agg(F.collect_set(F.struct("w", "n")).alias("known")))
    log_total = float(np.log10(total))

    @arrow_udf("array<string>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            out = [Segmenter({k["w"]: float(np.log10(k["n"] / total)) for k in known or ()} | {"": log_total}).split(run)
                   for run, known in zip(a.to_pylist(), b.to_pylist(), strict=True)]
            yield pa.array(out, pa.list_(pa.string()))

    return runs.join(known, "run", "left").select("run", cut(F.col("run"), F.col("known")).alias("split"))


def segmented(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """``words``, struct<host: array<string>, path: array<string>>, of each pair
    (``_h``, ``_q``) of host and path letters, with the number ``n`` of its pages."""
    keys = cut_lineage(parts.groupBy("_h", "_q").agg(F.count(F.lit(1)).alias("n")))
    each = keys.select("_h", "_q", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.split(c, " ").alias("runs")) for i, c in enumerate(("_h", "_q"))])).alias("p"))
    each = each.select("_h", "_q", "n", "p.part", F.posexplode("p.runs").alias("at", "run"))
    found = each.join(splits(cut_lineage(each.select("run").distinct()), counts), "run")

    def words(part: int) -> Column:
        of = F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("at", "split"))))
        return F.flatten(F.transform(of, lambda x: x["split"]))

    return cut_lineage(found.groupBy("_h", "_q").agg(F.first("n").alias("n"), F.struct(words(0).alias("host"), words(1).alias("path")).alias("words")))


def buckets(words: Column, bits: int = BITS) -> Column:
    """Hash buckets of host words and of path words (told apart)."""
    def of(part: str) -> Column:
        return F.transform(words[part], lambda w: F.pmod(F.xxhash64(F.lit(part), w), F.lit(1 << bits)).cast("int"))

    return F.concat(of("host"), of("path"))


def fit(words: DataFrame, seeds=SEEDS, bits: int = BITS, smoothing: float = SMOOTHING) -> tuple[np.ndarray, float]:
    """Weight of every bucket for ``block`` over ``allow``, and the prior's.

    Counts per bucket are combined before the shuffle; the result has at most
    ``2**bits`` rows.  ``words``: columns ``words`` and ``n`` as made by :func:`segmented`.
    """
    blocked = F.arrays_overlap(F.col("words.host"), F.array(*[F.lit(s) for s in seeds])).cast("bigint")
    rows = words.select((blocked * F.col("n")).alias("y"), "n", buckets(F.col("words"), bits).alias("b"))
    size = 1 << bits
    # -1 counts the pages themselves, for the prior
    counted = (rows.select("y", "n", F.explode(F.concat("b", F.array(F.lit(-1)))).alias("b")).groupBy("b")
               .agg(F.sum("y").alias("y"), F.sum("n").alias("n")).collect())
    c, pages = np.zeros((2, size)), np.ones(2)
    for r in counted:
        if r.b < 0:
            pages += (r.n - r.y, r.y)
        else:
            c[:, r.b] = (r.n - r.y, r.y)
    seen = c.sum(0) > 0          # smoothing goes to words that occur; others weigh nothing
    c = (c + smoothing) * seen
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log(c / c.sum(1, keepdims=True))
        return np.where(seen, logs[1] - logs[0], 0.0), float(np.log(pages[1] / pages[0]))


def weigh(b: Column, spark, model: tuple[np.ndarray, float]) -> Column:
    """Log odds of ``block`` of a bucket list."""
    sent = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def odds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, prior = sent.value
        for a in batches:
            ends = np.concatenate(([0], np.cumsum(np.array([len(x) if x is not None else 0 for x in a.to_pylist()], np.int64))))
            c = np.concatenate(([0.0], np.cumsum(weights[a.flatten().to_numpy(zero_copy_only=False).astype(np.int64)])))
            yield pa.array(c[ends[1:]] - c[ends[:-1]] + prior)

    return odds(b)


def judge(pages: DataFrame, docs: DataFrame | None = None, keep: list | None = None, url: str = "url", text: str = "text",
          rules=RULES, seeds=SEEDS) -> DataFrame:
    """``row`` (struct of ``keep``), ``host``, ``path``, ``words``, ``rule``, ``odds`` and ``verdict`` of every page."""
    spark = pages.sparkSession
    p = pages.select(fields(keep or pages.columns), host_of(F.col(url)).alias("host"),
                     path_of(F.col(url)).alias("path"))
    p = p.withColumn("_h", _letters(F.col("host"))).withColumn("_q", _letters(F.col("path")))
    found = segmented(p, word_counts(pages, docs, url, text, seeds))
    odds = weigh(buckets(F.col("words")), spark, fit(found, seeds))
    p = p.join(found.select("_h", "_q", "words", odds.alias("odds")), ["_h", "_q"])
    p = p.withColumn("_r", matching_rule(F.col("host"), F.col("path"), rules))
    learned = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return p.select("row", "host", "path", "words", F.col("_r.rule").alias("rule"), "odds",
                    F.coalesce(F.col("_r.verdict"), learned).alias("verdict"))
