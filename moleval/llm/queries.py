"""The numbered queries over whole tables, and SQL for those that SQL can express.

Each query applies its operator with production settings and derives the
columns of its contract from what the operator returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moleval.llm import adaptive_rules, crf_toxicity, edit_decontam, kn_lm, knn_quality, langid_nb, mix_systematic, phrases, recompress, simhash_trie, token_files, url_filter, whitening
from moleval.llm.words import SPACES, remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, n: int, held_out: int) -> DataFrame:
    """Documents with the fold that no model learns from."""
    return _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder("doc_id", n) == held_out).alias("held_out"))


def _labels(spark: SparkSession, sf_dir: str, label: str, n: int, held_out: int) -> DataFrame:
    """Labels of the documents that a model may learn from."""
    return _table(spark, sf_dir, "labels").where(remainder("doc_id", n) != held_out).select("doc_id", F.col(label).alias("label"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = url_filter.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"), keep=["page_id"])
    return d.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "odds")


def op2_kn_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, 5, 1)
    model = kn_lm.fit(docs.where(~F.col("held_out")))
    return (docs.select("doc_id", "held_out", kn_lm.scores(F.col("text"), spark, model).alias("x"))
            .select("doc_id", "held_out", "x.n_tokens", "x.n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
                    "x.base_score", "x.score"))


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash_trie.near_classes(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return d.select(F.col("row.doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adaptive_rules.judge(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return d.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", "kept")


def op5_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, 4, 2)
    model = knn_quality.fit(docs, _labels(spark, sf_dir, "quality", 4, 2))
    return (docs.select("doc_id", "held_out", knn_quality.quality(F.col("text"), spark, model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.7).cast("int")))


def op6_langid_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, 3, 1)
    model = langid_nb.fit(docs.where(~F.col("held_out")))
    return docs.select("doc_id", "held_out", langid_nb.language(F.col("text"), spark, model).alias("x")).select("doc_id", "held_out", "x.*")


def op7_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix_systematic.systematic_copies(_table(spark, sf_dir, "documents"), payload=["doc_id"])
    return d.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
                    (F.col("copies") * F.col("size")).alias("taken"))


def op8_recompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = recompress.dedup_substrings(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), f"[{SPACES}]+", " "))
    return d.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def op9_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, 3, 1)
    model = crf_toxicity.fit(docs, _labels(spark, sf_dir, "toxic", 3, 1))
    return (docs.select("doc_id", "held_out", crf_toxicity.toxicity(F.col("text"), spark, model).alias("x"))
            .select("doc_id", "held_out", "x.score", (F.col("x.score") >= 0.7).cast("int").alias("predicted"), "x.spans"))


def op10_edit_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = edit_decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return d.select(F.col("row.doc_id").alias("doc_id"), "item_id", "distance", F.col("start").alias("match_start"),
                    F.col("end").alias("match_end"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = whitening.long_form(whitening.whiten(_table(spark, sf_dir, "embeddings"), keep=["vec_id"]))
    return d.select(F.col("row.vec_id").alias("vec_id"), *[c for c in d.columns if c != "row"])


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    frequent = phrases.frequent_phrases(_table(spark, sf_dir, "documents").select("lang", "text"))
    return phrases.top_phrases(phrases.collocations(frequent)).select(F.col("g").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = token_files.fresh_folder(spark)
    token_files.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    d = token_files.fetch(token_files.directory(spark, folder), folder)
    return d.select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_kn_lm": op2_kn_lm,
    "op3_simhash_trie": op3_simhash_trie,
    "op4_adaptive_rules": op4_adaptive_rules,
    "op5_knn_quality": op5_knn_quality,
    "op6_langid_nb": op6_langid_nb,
    "op7_systematic_mix": op7_systematic_mix,
    "op8_recompress": op8_recompress,
    "op9_crf_toxicity": op9_crf_toxicity,
    "op10_edit_decontam": op10_edit_decontam,
    "op11_whitening": op11_whitening,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_token_files": op13_token_files,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_NO_SPACE = "translate(%s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"

_OP4 = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length({_NO_SPACE % 'x'}) > 0) AS l FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM rep) GROUP BY 1),
m AS (SELECT d.doc_id, lang, source, len(w) AS n_words, length({_NO_SPACE % 't'}) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM d LEFT JOIN cov USING (doc_id)),
mm AS (SELECT *, CASE WHEN n_words > 0 THEN n_words END AS m_words,
              word_chars * 1000 // nullif(n_words, 0) AS m_length, n_symbols * 1000 // nullif(n_words, 0) AS m_symbols,
              n_dup_lines * 1000 // nullif(n_lines, 0) AS m_lines, n_repeat_words * 1000 // nullif(n_words, 0) AS m_repeats FROM m),
v AS (SELECT lang, source, m, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS b
      FROM (SELECT lang, source, unnest(['m_words', 'm_length', 'm_symbols', 'm_lines', 'm_repeats']) AS m,
                   unnest([m_words, m_length, m_symbols, m_lines, m_repeats]) AS v FROM mm WHERE n_words > 0)),
q_own AS (SELECT lang, source, m, count(*) AS t, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM v GROUP BY 1, 2, 3),
q_lang AS (SELECT lang, m, count(*) AS t, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM v GROUP BY 1, 2),
q_all AS (SELECT m, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM v GROUP BY 1),
q AS (SELECT o.lang, o.source, o.m,
             CASE WHEN o.t >= 200 THEN o.q1 WHEN l.t >= 200 THEN l.q1 ELSE a.q1 END AS q1,
             CASE WHEN o.t >= 200 THEN o.q3 WHEN l.t >= 200 THEN l.q3 ELSE a.q3 END AS q3
      FROM q_own o JOIN q_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.m = l.m JOIN q_all a ON a.m = o.m),
lim AS (SELECT lang, source,
               max(CASE WHEN m = 'm_words' THEN q1 - 3 * greatest(q3 - q1, 10) END) AS words_lo,
               max(CASE WHEN m = 'm_length' THEN q1 - 3 * greatest(q3 - q1, 500) END) AS length_lo,
               max(CASE WHEN m = 'm_length' THEN q3 + 3 * greatest(q3 - q1, 500) END) AS length_hi,
               max(CASE WHEN m = 'm_symbols' THEN q3 + 3 * greatest(q3 - q1, 100) END) AS symbols_hi,
               max(CASE WHEN m = 'm_lines' THEN q3 + 3 * greatest(q3 - q1, 100) END) AS lines_hi,
               max(CASE WHEN m = 'm_repeats' THEN q3 + 3 * greatest(q3 - q1, 100) END) AS repeats_hi
        FROM q GROUP BY 1, 2),
j AS (SELECT mm.*, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
             coalesce(m_words >= words_lo AND m_length >= length_lo AND m_length <= length_hi AND m_symbols <= symbols_hi
                      AND m_lines <= lines_hi AND m_repeats <= repeats_hi, false) AS inside
      FROM mm LEFT JOIN lim ON mm.lang IS NOT DISTINCT FROM lim.lang AND mm.source IS NOT DISTINCT FROM lim.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND inside AS kept
FROM j
"""

_OP7 = f"""
WITH d AS (SELECT doc_id, coalesce('a' || source, 'b') AS k, len({_WORDS}) AS size FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS words FROM d GROUP BY 1),
w AS (SELECT k, words, words * 3.0::DOUBLE AS cap, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY k) - 1) % 3 + 1]::DOUBLE AS w FROM s),
p AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cap0, coalesce(sum(w) OVER b, 0) AS w0, sum(words) OVER ()::DOUBLE AS t, sum(w) OVER () AS wt
      FROM w WINDOW b AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT *, (t - cap0) / (wt - w0) AS level FROM p),
fin AS (SELECT *, max(CASE WHEN level <= cap / w THEN level END) OVER () AS final FROM lv),
tg AS (SELECT k, words, CASE WHEN final IS NULL OR cap / w < final THEN cap ELSE final * w END AS target,
              ('0x' || substr(md5('7:' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM fin),
n AS (SELECT d.*, row_number() OVER (PARTITION BY k ORDER BY size, ((doc_id % 64) + 64) % 64, doc_id) AS i FROM d),
c AS (SELECT doc_id, size, words, target, i, u, CASE WHEN words > 0 THEN target / words ELSE 0 END AS e FROM n JOIN tg USING (k))
SELECT doc_id, size, words AS source_size, target,
       ((floor(i * e + u) - floor((i - 1) * e + u)) * size)::BIGINT AS taken
FROM c
"""

_OP12 = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
                       unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
g AS (SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase
      FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM w, (VALUES (1), (2), (3)) AS ks(k))),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.phrase, c.k, c.f AS a, cut, l.f AS l, r.f AS r,
                ((1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f))::BIGINT AS score
         FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
         JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
         JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM (
             SELECT lang, f, array_to_string(w[1:2], ' ') AS phrase FROM cand WHERE k = 3
             UNION ALL SELECT lang, f, array_to_string(w[2:3], ' ') FROM cand WHERE k = 3) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase AND b.k = 2
         WHERE o.f IS NULL OR 100 * o.f < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {
    "op12_phrase_mining": _OP12,
    "op4_adaptive_rules": _OP4,
    "op7_systematic_mix": _OP7,
}
