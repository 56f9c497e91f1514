"""Quality rules with adaptive limits (DataFrame functions only).

Five measures per document, as whole numbers: words, letters per 1000 words
and, per 1000 words or lines, symbols, repeated lines and words in repeated
windows.  A quantile sketch per (language, source, measure) is a histogram over
log-linear buckets (exact powers of two cut into ``2**SUB_BITS`` parts, so a
value is off by under 1/64): sketches merge by adding counts, whatever the
partitioning, and one has a few hundred buckets at any input size.  A (language,
source) with fewer than ``MIN_DOCS`` documents takes the merged sketch of its
language, and a small language the merged sketch of all documents.

Limits are Tukey fences: upper quartile plus ``REACH`` times the spread of the
quartiles (and lower quartile minus it, for word length).  A spread below the
measure's resolution counts as the resolution, so that a measure which is
nearly always 0 does not reject the first document that differs.  The limits
are joined to the documents, and a document beyond one is dropped.

Null and empty texts have no words and fail the base rule; a null language or
source is a group of its own; documents are judged each on their own, so
repeated rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moleval.llm.words import SPACES, WORD_RE, fields
from moleval.session import cut_lineage

SUB_BITS = 6
MIN_DOCS = 200
REACH = 3.0
WINDOW = 5
SYMBOLS = "#*$%&|<>"
# measure -> (sides of the fence, resolution)
MEASURES = {"m_words": ("low", 10), "m_length": ("both", 500), "m_symbols": ("high", 100),
            "m_lines": ("high", 100), "m_repeats": ("high", 100)}
FENCED = list(MEASURES)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), "")


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """64-bit hash of every run of ``window`` words (of the words' hashes)."""
    def combine(g):
        return F.slice(F.transform(g, lambda x, i: F.xxhash64(x, *[F.get(g, i + k) for k in range(1, window)])),
                       1, F.size(g) - (window - 1))

    return F.when(F.size(words) >= window, let(F.transform(words, lambda w: F.xxhash64(w)), combine)
                  ).otherwise(F.array().cast("array<bigint>"))


def repeat_cover(hashes: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found at least twice in the text.

    Only texts with a repeated window (fewer distinct hashes than windows) take
    the second step: sort (hash, position), keep entries equal to a neighbour,
    and add up the union of their spans.
    """
    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def repeated(s):
        return F.filter(F.transform(s, lambda x, i: F.when(
            (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"])), lambda p: p.isNotNull())

    def cover(pos):
        return F.aggregate(F.transform(pos, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(pos, i + 1) - p, F.lit(window)))),
                           F.lit(0).cast("bigint"), lambda a, x: a + x)

    several = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(several, let(by_hash, lambda s: let(F.sort_array(repeated(s)), cover))).otherwise(F.lit(0).cast("bigint"))


def text_measures(docs: DataFrame, keep: list, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Base counts of every whole text: ``row`` (struct of ``keep``), ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_repeat_words``."""
    t = F.coalesce(F.col(text), F.lit(""))
    big = lambda c: c.cast("bigint")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_RE))
    d = docs.select(fields(keep), F.col(lang).alias("_lang"), F.col(source).alias("_source"),
                    words_of(F.col(text)).alias("_w"), lines.alias("_l"),
                    big(F.regexp_count(t, F.lit(f"[{SYMBOLS}]"))).alias("n_symbols"))
    d = d.withColumn("_h", window_hashes(F.col("_w")))
    return d.select("row", "_lang", "_source", big(F.size("_w")).alias("n_words"), big(F.length(F.array_join("_w", ""))).alias("word_chars"), "n_symbols",
                    big(F.size("_l")).alias("n_lines"),
                    big(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
                    repeat_cover(F.col("_h")).alias("n_repeat_words"))


def measures(d: DataFrame) -> DataFrame:
    """The whole-number measures that are fenced (null where there is no word)."""
    per = lambda n, of: F.when(F.col(of) > 0, F.expr(f"({n} * 1000) div {of}"))
    return d.withColumns({"m_words": F.when(F.col("n_words") > 0, F.col("n_words")),
                          "m_length": per("word_chars", "n_words"), "m_symbols": per("n_symbols", "n_words"),
                          "m_lines": per("n_dup_lines", "n_lines"), "m_repeats": per("n_repeat_words", "n_words")})


def bucket(v: Column, sub_bits: int = SUB_BITS) -> Column:
    """Lower bound of a whole number's sketch bucket: its leading ``sub_bits + 1`` bits."""
    drop = F.greatest(F.length(F.bin(v)) - (sub_bits + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(d: DataFrame) -> DataFrame:
    """One row per (language, source, measure, bucket) with its count."""
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), bucket(F.col(m)).alias("b")) for m in FENCED])
    return (d.where("n_words > 0").select("_lang", "_source", F.explode(pairs).alias("x"))
            .groupBy("_lang", "_source", F.col("x.m").alias("m"), F.col("x.b").alias("b"))
            .agg(F.count(F.lit(1)).alias("n")))


def quartiles(sketch: DataFrame, by: list) -> DataFrame:
    """Lower and upper quartile of every group's merged sketch, with its size."""
    merged = sketch.groupBy(*by, "m", "b").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "m")
    upto = w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    c = merged.withColumns({"c": F.sum("n").over(upto), "t": F.sum("n").over(w)})
    at = lambda q: F.min(F.when(F.col("c") * 4 >= F.col("t") * q, F.col("b")))
    return c.groupBy(*by, "m").agg(F.max("t").alias("t"), at(1).alias("q1"), at(3).alias("q3"))


def limits(sketch: DataFrame, min_docs: int = MIN_DOCS, reach: float = REACH) -> DataFrame:
    """One row per (language, source): ``<measure>_lo`` and ``<measure>_hi``."""
    own = quartiles(sketch, ["_lang", "_source"]).alias("o")
    lang = quartiles(sketch, ["_lang"]).alias("l")
    every = quartiles(sketch, []).alias("e")
    j = (own.join(lang, F.col("o._lang").eqNullSafe(F.col("l._lang")) & (F.col("o.m") == F.col("l.m")))
         .join(every, F.col("o.m") == F.col("e.m")))
    pick = lambda c: (F.when(F.col("o.t") >= min_docs, F.col(f"o.{c}"))
                      .when(F.col("l.t") >= min_docs, F.col(f"l.{c}")).otherwise(F.col(f"e.{c}")))
    j = j.select(F.col("o._lang").alias("_lang"), F.col("o._source").alias("_source"), F.col("o.m").alias("m"),
                 pick("q1").alias("q1"), pick("q3").alias("q3"))
    out = []
    for m, (side, step) in MEASURES.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(step)) * reach
        if side != "high":
            out.append(F.max(F.when(F.col("m") == m, F.col("q1") - spread)).alias(f"{m}_lo"))
        if side != "low":
            out.append(F.max(F.when(F.col("m") == m, F.col("q3") + spread)).alias(f"{m}_hi"))
    return j.groupBy("_lang", "_source").agg(*out)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def judge(docs: DataFrame, keep: list | None = None, text: str = "text", lang: str = "lang", source: str = "source",
          min_docs: int = MIN_DOCS, reach: float = REACH) -> DataFrame:
    """``row`` (struct of ``keep``), the base counts, ``base_failed`` and ``kept`` for every document.

    The measured rows and the sketches are written to the checkpoint folder, as
    both are read more than once: the texts are measured in one pass.
    """
    d = cut_lineage(measures(text_measures(docs, keep or docs.columns, text, lang, source)))
    lim = limits(cut_lineage(sketches(d)), min_docs, reach)
    j = d.alias("d").join(lim.alias("x"), F.col("d._lang").eqNullSafe(F.col("x._lang"))
                          & F.col("d._source").eqNullSafe(F.col("x._source")), "left")
    inside = F.lit(True)
    for m, (side, _) in MEASURES.items():
        if side != "high":
            inside = inside & (F.col(m) >= F.col(f"{m}_lo"))
        if side != "low":
            inside = inside & (F.col(m) <= F.col(f"{m}_hi"))
    return j.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base_failed().alias("base_failed"),
                    (~base_failed() & F.coalesce(inside, F.lit(False))).alias("kept"))


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the base rule and the adaptive limits keep."""
    return judge(docs, **options).where("kept").select("row.*")
