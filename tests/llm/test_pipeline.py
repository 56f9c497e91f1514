"""The five stages on a small corpus, each against brute force on its own input."""
import random

import pytest
from test_native_rules import targets_by_loop
from test_near_copies import classes, cut_by_loop, edit_distance, lower, simhash, WORD

import corpus_pipeline
import __spark_entry__ as E
from moleval.llm import edit_decontam

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3))
    vocabulary = [word() for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(20)) for i in range(6)]
    passage = text(60)
    docs, labels = [], []
    for i in range(120):
        t, toxic = text(rng.randrange(40, 120)), i % 6 == 0
        if toxic:
            t = t + "\nyou utter moron " + text(10)
        if i % 7 == 1:
            t += "\n" + passage + " " + text(9)
        if i % 11 == 2:
            t += " " + items[i % 6][1]
        docs.append((i, t, "en", rng.choice(("a", "b", None)), len(t)))
        labels.append((i, 1, int(toxic)))
    docs += [(200 + i, docs[i][1] + " end", "en", "a", 0) for i in range(1, 20, 2)]
    docs += [(300, None, None, None, None), (301, "", "en", "a", 0), (1, docs[1][1], "en", "a", 0), (None, text(50), "en", "b", 5), (302, text(30_000), "de", "a", 1)]
    return docs, labels, items


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    docs, labels, items = make()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_one_by_one(spark, sf, tmp_path):
    docs, _, items = make()
    at = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, sf)
        assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/{n}")
        at = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append(rows(at))
    kept, near, cut, clean, mixed = seen
    assert {r[0] for r in kept} == {r[0] for r in docs if r[1] is None or "moron" not in r[1]}
    low = classes([r[0] for r in kept], [simhash(r[1]) for r in kept])
    assert {r[0] for r in near} == {r if r is not None else None for r in low} and len(near) == len(set(low))
    assert set(near) <= set(kept)
    got = sorted((r[0], " ".join(WORD.findall(r[1] or ""))) for r in cut if r[0] is not None)
    assert got == sorted((i, t) for i, _, _, t in cut_by_loop(near, 20) if i is not None)
    bad = {r[0] for r in cut for _, x in items if r[1] and edit_distance(x, lower(r[1]).replace("\n", " ")) <= int(len(x) * edit_decontam.RATE)}
    assert bad and {r[0] for r in clean} == {r[0] for r in cut} - bad
    sizes, taken = {}, {}
    for r in clean:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    for r in mixed:
        taken[r[3]] = taken.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    longest = max(len(WORD.findall(r[1] or "")) for r in clean)
    assert set(mixed) <= set(clean) and all(mixed.count(r) <= 3 for r in set(mixed))
    for s, t in targets_by_loop(sizes).items():
        assert abs(taken.get(s, 0) - t) <= 2 * longest


def test_run_is_the_stages_in_order(spark, sf):
    assert E.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < out.count()
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_empty_tables_and_more_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 30").selectExpr(
        "*", "1 AS row", "'x' AS item_id", "2 AS label", "3 AS _id", "4 AS size", "5 AS root", "6 AS chunk", "7 AS h", "8 AS score")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs, sf).count() > 0, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
