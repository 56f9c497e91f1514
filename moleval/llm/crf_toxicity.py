"""Toxic spans by a linear-chain conditional random field.

Tokens are words without punctuation at their ends, lower-cased; a chain is a
line of a document.  A token's features are its hashed identity, prefixes of 3
to 7 characters, its last 3 characters and its neighbours' identities.

Labelled tokens come from document labels on a sample of ``MAX_LABELLED`` rows
at most (smallest hash of the id first): a word or prefix whose documents are
toxic in at least ``PRECISION`` of the cases, with ``MIN_TOXIC`` toxic ones,
marks tokens of toxic documents as toxic.  The field learns from every line of
the sample, whole and with all its tokens: lines stay in the checkpoint folder,
each round's tasks take gradient steps over their lines, and only weights, summed
in Spark, come to the driver.
Forward-backward marginals of the tokens give the document's score (a logistic
function of the highest marginal and the expected number of toxic tokens,
fitted on the same sample) and its offending spans.

Null and empty texts have no tokens and get the score of a text without any
sign; null labels are not learned from; without both labels in the sample every
score is the share of label 1 (0 without rows); repeated rows are scored alike;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from moleval.llm.sampling import labelled_sample
from moleval.llm.words import Words, _tables, blocks, mix
from moleval.session import cut_lineage

BITS = 18
PREFIXES = (3, 4, 5, 6, 7)
SUFFIX = 3
FEATURES = 2 + len(PREFIXES)    # identity, prefixes, suffix; two neighbours' identities come on top
MAX_LABELLED = 8192
MIN_TOXIC = 5
PRECISION = 0.8
BATCH_TOKENS = 1 << 13          # of whole lines, for one step of the fit
ROUNDS = 12                     # over all lines
RANGE = 1 << 14                 # weights added up together
CHUNK_BYTES = 32 << 20          # of training lines in a partition, and held by a task at a time
UNIT = 16                       # tokens that weigh as one example against the decay
BLOCK = 1 << 20

_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


class Tokens:
    """Tokens of a block of texts: byte spans, feature hashes, chains."""

    def __init__(self, texts: pa.Array):
        w = Words(pc.utf8_lower(texts.fill_null("")))
        self.words = w
        start, end = w.start.copy(), w.end.copy()
        while True:             # punctuation at the ends, one byte a step
            on = (start < end) & _PUNCT[w.buf[np.minimum(start, len(w.buf) - 1)]] if len(start) else np.zeros(0, bool)
            off = (start < end) & _PUNCT[w.buf[end - 1]] if len(start) else on
            if not (on.any() or off.any()):
                break
            start += on
            end -= off & (start < end)
        self.start, self.end = start, end
        lead = (w.buf & 0xC0) != 0x80
        self.char = np.concatenate(([0], np.cumsum(lead)))          # characters before a byte
        self._lead = np.concatenate((np.flatnonzero(lead), [len(w.buf)]))
        newline = np.concatenate(([0], np.cumsum(w.buf == 10)))
        n = len(start)
        head = np.ones(n, bool)
        if n:
            head[1:] = (w.doc[1:] != w.doc[:-1]) | (newline[w.start[1:]] != newline[w.end[:-1]])
        self.chain = np.flatnonzero(head)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """(FEATURES, tokens): hash of identity, each prefix and the suffix; 0 where a token is shorter."""
        n, buf = len(self), self.words.buf
        out = np.zeros((FEATURES, n), np.uint64)
        if not n:
            return out
        up, down = _tables(len(buf))
        c = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up, out=c[1:])

        def spans(a, b, salt):
            return mix((c[b] - c[a]) * down[np.minimum(a, len(buf) - 1)] + np.uint64(salt))

        first, last = self.char[self.start], self.char[self.end]
        out[0] = spans(self.start, self.end, 1)
        for k, size in enumerate(PREFIXES, 1):
            long = last - first >= size
            out[k, long] = spans(self.start[long], self._lead[first[long] + size], 100 + size)
        long = last - first >= SUFFIX
        out[-1, long] = spans(self._lead[last[long] - SUFFIX], self.end[long], 200)
        return out

    def features(self, bits: int = BITS) -> np.ndarray:
        """(FEATURES + 2, tokens): weight numbers; 0 is no feature."""
        n = len(self)
        out = np.zeros((FEATURES + 2, n), np.int32)
        if n:
            h = self.hashes()
            out[:FEATURES] = np.where(h == 0, 0, 1 + (h >> np.uint64(65 - bits)).astype(np.int64))
            before, after = mix(h[0] + np.uint64(3)), mix(h[0] + np.uint64(5))
            out[FEATURES, 1:] = 1 + (before[:-1] >> np.uint64(65 - bits)).astype(np.int64)
            out[FEATURES + 1, :-1] = 1 + (after[1:] >> np.uint64(65 - bits)).astype(np.int64)
            out[FEATURES, self.chain] = 0
            out[FEATURES + 1, self.chain[1:] - 1] = 0
            out[FEATURES + 1, -1] = 0
        return out


def marginals(e: np.ndarray, chain: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds of label 1 for every token by forward-backward.

    ``e``: each token's evidence for label 1 over 0; ``chain``: first tokens of
    the chains; ``t[a, b]``: weight of label a followed by b.  Chains are walked
    together, longest first, so step k touches the chains that have a token k.
    """
    n = len(e)
    length = np.diff(np.concatenate((chain, [n])))
    order = np.argsort(-length, kind="stable")
    begin, length = chain[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, (length[0] if n else 0) + 1), "right")   # chains with more than k tokens
    forward, backward = np.empty(n), np.zeros(n)
    for k, m in enumerate(alive):
        at = begin[:m] + k
        if k == 0:
            forward[at] = e[at]
        else:
            r = forward[at - 1]
            forward[at] = e[at] + np.logaddexp(t[0, 1], t[1, 1] + r) - np.logaddexp(t[0, 0], t[1, 0] + r)
    for k in range(len(alive) - 1, 0, -1):
        at = begin[:alive[k]] + k
        r = e[at] + backward[at]
        backward[at - 1] = np.logaddexp(t[1, 0], t[1, 1] + r) - np.logaddexp(t[0, 0], t[0, 1] + r)
    return forward + backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Model:
    """Weights (0: none), label steps, and the document score's logistic weights."""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 + (1 << (BITS - 1))))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, -50.0]))

    def token_odds(self, tokens: Tokens) -> np.ndarray:
        if not len(tokens):
            return np.zeros(0)
        e = self.weights[tokens.features()].sum(0)
        return marginals(e, tokens.chain, self.steps)

    def signs(self, tokens: Tokens, odds: np.ndarray) -> np.ndarray:
        """Per document: log odds of its most toxic token (-12 at least) and log of 1 + expected toxic tokens."""
        first = tokens.words.first
        out = np.zeros((len(first) - 1, 2))
        out[:, 0] = -12
        has = np.flatnonzero(np.diff(first))
        if len(has):
            out[has, 0] = np.clip(np.maximum.reduceat(odds, first[has]), -12, 12)
            out[has, 1] = np.log1p(np.add.reduceat(sigmoid(odds), first[has]))
        return out

    def scores(self, signs: np.ndarray) -> np.ndarray:
        return sigmoid(signs @ self.document[:2] + self.document[2])

    @staticmethod
    def spans(tokens: Tokens, odds: np.ndarray) -> list[list[dict]]:
        """Per document: runs of tokens of one chain that are more likely toxic than not, as character offsets."""
        w = tokens.words
        out: list[list[dict]] = [[] for _ in range(len(w.first) - 1)]
        hit = np.flatnonzero(odds > 0)
        if len(hit):
            number = np.zeros(len(odds), np.int64)
            number[tokens.chain] = 1
            number = np.cumsum(number)
            new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (number[hit[1:]] != number[hit[:-1]])))
            for a, b in zip(hit[new], hit[np.concatenate((np.flatnonzero(new)[1:], [len(hit)])) - 1], strict=True):
                base = tokens.char[w.offsets[w.doc[a]]]
                out[w.doc[a]].append({"start": int(tokens.char[tokens.start[a]] - base), "end": int(tokens.char[tokens.end[b]] - base)})
        return out


def _token_blocks(batches) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    for b in blocks(batches, "text", BLOCK):
        yield b, Tokens(b.column(b.schema.get_field_index("text")))


def toxic_marks(sample: DataFrame, min_toxic: int = MIN_TOXIC, precision: float = PRECISION) -> np.ndarray:
    """Hashes of words and prefixes that stand in toxic documents of the sample nearly only."""
    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in _token_blocks(batches):
            h = t.hashes()[:-1]
            label = np.asarray(b.column(1).to_numpy(zero_copy_only=False))[t.words.doc]
            doc = np.broadcast_to(t.words.doc, h.shape).ravel()
            order = np.lexsort((h.ravel(), doc))
            hs, ds = h.ravel()[order], doc[order]
            new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1]))) & (hs != 0) if len(hs) else np.zeros(0, bool)
            one = np.broadcast_to(label, h.shape).ravel()[order][new]
            u, inverse = np.unique(hs[new], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inverse, one, len(u)).astype(np.int64)),
                                              pa.array(np.bincount(inverse, minlength=len(u)))], ["h", "toxic", "n"])

    counts = (sample.mapInArrow(per_document, "h bigint, toxic bigint, n bigint").groupBy("h")
              .agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
              .where((F.col("toxic") >= min_toxic) & (F.col("toxic") >= precision * F.col("n"))))
    return np.sort(np.array([r.h for r in counts.select("h").collect()], np.int64).view(np.uint64))


def _training_lines(sample: DataFrame, marks) -> DataFrame:
    """(x, y): feature numbers (tokens x features) and gold labels of every line, in order of a hash."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = marks.value
        for b, t in _token_blocks(batches):
            if not len(t):
                continue
            label = np.asarray(b.column(1).to_numpy(zero_copy_only=False))
            toxic = (np.isin(t.hashes()[:-1], known).any(0) & (label[t.words.doc] == 1)).astype(np.int8)
            x = np.ascontiguousarray(t.features().T)
            ends = np.append(t.chain[1:], len(t))
            rows = [(x[a:z].tobytes(), toxic[a:z].tobytes()) for a, z in zip(t.chain, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, "binary") for c in zip(*rows, strict=True)], ["x", "y"])

    lines = cut_lineage(sample.mapInArrow(cut, "x binary, y binary").withColumn("k", F.xxhash64("x", "y")))
    size = lines.agg(F.sum(F.length("x"))).first()[0] or 0
    parts = 1 + size // CHUNK_BYTES
    # every partition sends a set of weights a round, so there are as few as their size asks for
    return cut_lineage(lines.repartitionByRange(parts, "k").sortWithinPartitions("k", "x", "y").select("x", "y")).coalesce(parts)


def _batches(lines: Iterator[tuple[bytes, bytes]], rng: np.random.Generator) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Lines as arrays, mixed within a chunk, ``BATCH_TOKENS`` or one longer line at a time."""
    def mixed(chunk):
        batch, tokens = [], 0
        for i in rng.permutation(len(chunk)):
            x, y = chunk[i]
            if batch and tokens + len(y) > BATCH_TOKENS:
                yield batch
                batch, tokens = [], 0
            batch.append((np.frombuffer(x, np.int32).reshape(-1, FEATURES + 2), np.frombuffer(y, np.int8).astype(np.float64)))
            tokens += len(y)
        if batch:
            yield batch

    chunk, size = [], 0
    for x, y in lines:
        chunk.append((bytes(x), bytes(y)))
        size += len(x)
        if size >= CHUNK_BYTES:
            yield from mixed(chunk)
            chunk, size = [], 0
    yield from mixed(chunk)


@dataclass
class Training:
    """Weights and label steps with the sums of their squared gradients."""
    w: np.ndarray
    sw: np.ndarray
    t: np.ndarray
    st: np.ndarray

    @classmethod
    def begin(cls) -> Training:
        model = Model()
        return cls(model.weights, np.full(len(model.weights), 1e-3), model.steps, np.full((2, 2), 1e-3))

    @classmethod
    def unpack(cls, v: np.ndarray) -> Training:
        n = (len(v) - 8) // 2
        return cls(v[:n].copy(), v[n:2 * n].copy(), v[2 * n:2 * n + 4].reshape(2, 2).copy(), v[2 * n + 4:].reshape(2, 2).copy())

    def pack(self) -> np.ndarray:
        return np.concatenate((self.w, self.sw, self.t.ravel(), self.st.ravel()))

    def learn(self, batches: Iterator[list[tuple[np.ndarray, np.ndarray]]], rate: float, decay: float) -> int:
        """Adaptive gradient steps on batches of whole lines; the number of tokens."""
        w, sw, t, st, tokens = self.w, self.sw, self.t, self.st, 0
        for pick in batches:
            x, y = np.concatenate([a for a, _ in pick]), np.concatenate([b for _, b in pick])
            tokens += len(y)
            lengths = np.array([len(b) for _, b in pick])
            chain = np.cumsum(lengths) - lengths
            e = w[x].sum(1)
            odds = marginals(e, chain, t)
            p = sigmoid(odds)
            gw = np.bincount(x.ravel(), np.repeat(p - y, x.shape[1]), len(w)) * (UNIT / len(y)) + decay * w
            gw[0] = 0
            inner = np.ones(len(y), bool)
            inner[chain] = False
            b = np.flatnonzero(inner)
            gt = np.zeros((2, 2))
            if len(b):
                pair = pair_marginals(e, chain, t, b, odds)
                for i in (0, 1):
                    for j in (0, 1):
                        gt[i, j] = (pair[i][j] - ((y[b - 1] == i) & (y[b] == j))).sum() * (UNIT / len(y))
            sw += gw * gw
            st += gt * gt
            w -= rate * gw / np.sqrt(sw)
            t -= rate * 0.25 * gt / np.sqrt(st)
        return tokens


def _add_up(table: pa.Table) -> pa.Table:
    """Rows of one range of values -> their sum weighted by tokens, in order of the partitions."""
    order = np.argsort(table.column("part").to_numpy())
    data, n = table.column("data").to_pylist(), table.column("n").to_pylist()
    total = np.sum([np.frombuffer(data[i], "<f4").astype(np.float64) * n[i] for i in order], axis=0)
    return pa.table({"block": table.column("block")[:1], "n": pa.array([sum(n)]), "data": pa.array([total.tobytes()], pa.binary())})


def train_field(lines: DataFrame, rounds: int = ROUNDS, rate: float = 0.2, decay: float = 1e-5) -> Model:
    """Maximum likelihood over (x, y) lines.  In each round every partition takes adaptive gradient
    steps over all its lines from the same broadcast weights; the results, weighted by tokens, are
    added up by ranges of weights in Spark.  The driver holds one set of weights and no line."""
    sc = lines.sparkSession.sparkContext
    state = Training.begin()
    for turn in range(rounds):
        sent = sc.broadcast(state.pack())

        def steps(batches: Iterator[pa.RecordBatch], turn=turn, sent=sent) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            own = Training.unpack(sent.value)
            rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            n = own.learn(_batches(rows, np.random.default_rng((turn, part))), rate, decay)
            if n:
                v = own.pack()
                cut = [v[i:i + RANGE].astype("<f4").tobytes() for i in range(0, len(v), RANGE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([part] * len(cut), pa.int32()), pa.array([n] * len(cut), pa.int64()), pa.array(cut, pa.binary())],
                                                 ["block", "part", "n", "data"])

        summed = lines.mapInArrow(steps, "block int, part int, n bigint, data binary").groupBy("block").applyInArrow(_add_up, "block int, n bigint, data binary")
        got = sorted(summed.collect(), key=lambda r: r.block)
        sent.unpersist()
        if not got:
            break
        state = Training.unpack(np.concatenate([np.frombuffer(r.data, "<f8") for r in got]) / got[0].n)
    return Model(weights=state.w, steps=state.t)


def pair_marginals(e: np.ndarray, chain: np.ndarray, t: np.ndarray, b: np.ndarray, odds: np.ndarray | None = None) -> list[list[np.ndarray]]:
    """P(label of b - 1 is i, label of b is j) for tokens b that do not begin a chain."""
    odds = marginals(e, chain, t) if odds is None else odds
    # one direction's message from its odds: backward[b - 1] is known from e[b] + backward[b]
    length = np.diff(np.concatenate((chain, [len(e)])))
    order = np.argsort(-length, kind="stable")
    begin, length = chain[order], length[order]
    back = np.zeros(len(e))
    for k in range(int(length[0]) - 1, 0, -1):
        at = begin[:np.searchsorted(-length, -k)] + k
        r = e[at] + back[at]
        back[at - 1] = np.logaddexp(t[1, 0], t[1, 1] + r) - np.logaddexp(t[0, 0], t[0, 1] + r)
    left, right = (odds - back)[b - 1], (e + back)[b]
    logs = [[t[i, j] + i * left + j * right for j in (0, 1)] for i in (0, 1)]
    z = np.logaddexp(np.logaddexp(logs[0][0], logs[0][1]), np.logaddexp(logs[1][0], logs[1][1]))
    return [[np.exp(v - z) for v in row] for row in logs]


def _fit_document(signs: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    x = np.column_stack((signs, np.ones(len(y))))
    w = np.zeros(3)
    ridge = np.diag([1e-2, 1e-2, 1e-4])
    for _ in range(30):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge @ w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-6 * np.eye(3), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", doc_id: str = "doc_id",
        max_labelled: int = MAX_LABELLED) -> Model:
    """Model of a bounded sample of the labelled documents (written once to the checkpoint folder)."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, max_labelled, doc_id, text, label).drop("h")
    sample = cut_lineage(sample.repartition(max(1, spark.sparkContext.defaultParallelism)))
    n, ones = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not 0 < ones < n:
        share = (ones or 0) / n if n else 0.0
        odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(document=np.array([0.0, 0.0, odds]))
    marks = spark.sparkContext.broadcast(toxic_marks(sample))
    lines = _training_lines(sample, marks)
    model = train_field(lines)
    sent = spark.sparkContext.broadcast(model)

    def sign_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in _token_blocks(batches):
            s = sent.value.signs(t, sent.value.token_odds(t))
            yield pa.RecordBatch.from_arrays([pa.array(s[:, 0]), pa.array(s[:, 1]), b.column(1)], ["a", "b", "label"])

    got = np.array(sorted(tuple(r) for r in sample.mapInArrow(sign_rows, "a double, b double, label int").collect()), np.float64)
    model.document = _fit_document(got[:, :2], got[:, 2])
    return model


def toxicity(text: Column, spark, model: Model) -> Column:
    """struct<score, spans: array<struct<start, end>>> of a text column (character offsets, end exclusive)."""
    sent = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @arrow_udf("struct<score:double,spans:array<struct<start:int,end:int>>>")
    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for a in batches:
            scores, spans = [np.zeros(0)], []
            for _, t in _token_blocks([pa.RecordBatch.from_arrays([a], ["text"])]):
                odds = m.token_odds(t)
                scores.append(m.scores(m.signs(t, odds)))
                spans += m.spans(t, odds)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), pa.array(spans, kind)], ["score", "spans"])

    return tag(text)
