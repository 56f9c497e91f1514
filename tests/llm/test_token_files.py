"""Token files: exact round trips, the cutting of texts against whole encodings, and single documents."""
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moleval.llm import queries, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = token_files.Encoder(PATH)
ODD = ["", None, " ", "  ", "a  b", " a", "a ", "a \n b", "x  y", "x  y", "it's  we're\t x", "　 z   q", "a <|endoftext|> b", "  <|endoftext|>",
       "\x1c a\x85 b", "é è ñ ß", "日本 語 テスト", "123 4 56", "....  ,,", "word " * 40_000, "nospace" * 30_000]


def plain(t):
    return WHOLE.encode(t or "", add_special_tokens=False).ids


def encoded(texts):
    first, ids = ENCODER.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]


def test_cut_texts_encode_like_whole_ones():
    assert encoded(ODD) == [plain(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x1c\x85  　'.,sdtvr<|>"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_cut_texts_encode_like_whole_ones_everywhere(texts):
    assert encoded(texts) == [plain(t) for t in texts]


def test_memory_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED", 40)
    rng, e = random.Random(4), token_files.Encoder(PATH)
    for _ in range(30):
        texts = [" ".join(rng.choice(["the", "of", f"w{rng.randint(0, 500)}x"]) for _ in range(20)) for _ in range(3)]
        first, ids = e.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [plain(t) for t in texts]
        assert len(e.known) <= 40 + 140


def written(spark, rows, tmp_path, **kw):
    folder = f"file://{tmp_path}/t"
    token_files.write(spark.createDataFrame(rows, "doc_id bigint, text string, ids string, name string"), folder, PATH, end_id=2, **kw)
    return folder


@pytest.mark.parametrize("frame_ids", [token_files.FRAME_IDS, 7])
def test_round_trip(spark, tmp_path, frame_ids):
    rng = random.Random(1)
    texts = [t for t in ODD if t is None or len(t) < 100_000] + ["word " * 3000]
    rows = [(i * 3 - 20, t, "x", "y") for i, t in enumerate(texts)] + [(None, "no id", None, None)] + [(7_000, "twice", "", "")] * 2
    rng.shuffle(rows)
    folder = written(spark, rows, tmp_path, frame_ids=frame_ids)
    got = sorted(token_files.fetch(token_files.directory(spark, folder), folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] + sorted(i for i, *_ in rows if i is not None)
    want = {(i, tuple(plain(t) + [2])) for i, t, *_ in rows}
    assert {(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got} == want
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4


def test_wanted_documents_are_read_alone_and_damage_is_found(spark, tmp_path):
    rows = [(i, f"text number {i}", "", "") for i in range(50)]
    folder = written(spark, rows, tmp_path)
    d = token_files.directory(spark, folder).where(F.col("doc_id").isin(3, 41))
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.fetch(d, folder).collect()} == {i: plain(f"text number {i}") + [2] for i in (3, 41)}
    # a plain zstandard reader sees all frames; one broken frame fails its own document only
    files = sorted((tmp_path / "t").glob("*.zst"))
    all_ids = b"".join(zstandard.ZstdDecompressor().stream_reader(f.read_bytes(), read_across_frames=True).read() for f in files)
    assert np.frombuffer(all_ids, "<u4").tolist() == [x for i in range(50) for x in plain(f"text number {i}") + [2]]
    row = d.where("doc_id = 3").first()
    path = tmp_path / "t" / row["name"]
    data = bytearray(path.read_bytes())
    data[row.offset + row.sizes[0] - 2] ^= 0xFF
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum|decompress"):
        token_files.fetch(token_files.directory(spark, folder).where("doc_id = 3"), folder).collect()
    assert token_files.fetch(token_files.directory(spark, folder).where("doc_id = 41"), folder).count() == 1


def test_documents_without_ids(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    token_files.write(spark.createDataFrame([(1, ""), (2, "some words here"), (3, None)], "doc_id bigint, text string").coalesce(1), folder, PATH, frame_ids=2)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.fetch(token_files.directory(spark, folder), folder).collect()}
    assert got == {1: [], 2: plain("some words here"), 3: []}


def test_empty_table(spark, tmp_path):
    folder = written(spark, [], tmp_path)
    assert token_files.fetch(token_files.directory(spark, folder), folder).count() == 0


def test_query_against_plain_encoding(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want, at = [], 0
    for i, t in rows:
        ids = plain(t) + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op13_token_files(spark, sf).collect())) == want
