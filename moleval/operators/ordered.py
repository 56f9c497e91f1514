"""Ordered operators.

Order is always an explicit column list with a unique tie-break; nothing
relies on file order.  Global positions come from the range-partitioned
:func:`moleval.operators.common.with_sequence_index`, never from a window
without ``partitionBy`` (which would move every row into one task).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moleval.operators.common import as_list, col, with_sequence_index
from moleval.session import cut_lineage

ACCEPTED = "accepted"
REJECTED = "rejected"
DUPLICATE = "duplicate"


def renumber(df: DataFrame, order, name: str = "row_no") -> DataFrame:
    """0-based row number in ``order`` (distributed)."""
    return with_sequence_index(df, as_list(order), name=name)


def batch_ids(df: DataFrame, id_col: str, order, k: int = 10) -> DataFrame:
    """Ids in order, cut into comma-joined chunks of ``k`` (last one
    shorter).  Each chunk collects at most ``k`` ids."""
    s = with_sequence_index(df.select(col(id_col).alias("_id"), *[col(c) for c in as_list(order)]),
                            as_list(order), name="_seq")
    return (s.groupBy(F.floor(F.col("_seq") / k).cast("bigint").alias("chunk"))
             .agg(F.count(F.lit(1)).alias("n_ids"),
                  F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "_id"))),
                                           lambda x: x["_id"].cast("string")), ",").alias("id_list")))


def positional_split(df: DataFrame, order, cut, gap: int = 0, name: str = "part",
                     first: str = "fit", second: str = "val") -> DataFrame:
    """Label rows by position: ``[0, cut)`` -> first, ``[cut+gap, n)`` ->
    second, positions inside the gap are dropped (``gap=1`` reproduces the
    studied ``[0:29]`` / ``[30:]`` slices).  ``cut`` may be a row count or a
    fraction of the rows."""
    s = with_sequence_index(df, as_list(order), name="seq")
    if isinstance(cut, float) and 0 < cut < 1:
        total = s.agg(F.count(F.lit(1))).scalar()
        s = s.withColumn("_cut", F.floor(total * cut))
    else:
        s = s.withColumn("_cut", F.lit(int(cut)))
    part = (F.when(F.col("seq") < F.col("_cut"), F.lit(first))
             .when(F.col("seq") >= F.col("_cut") + gap, F.lit(second)))
    return s.withColumn(name, part).where(F.col(name).isNotNull()).drop("_cut")


SAMPLE_DIGITS = 4               # hex digits of the hash that are counted: 65,536 counts at most


def sample_hash(key, seed: int = 42):
    """md5 of the key's text and the seed (any engine computes the same)."""
    text = [F.coalesce(col(c).cast("string"), F.lit("")) for c in as_list(key)]
    return F.md5(F.concat_ws(":", *text, F.lit(str(seed))))


def sample_n(df: DataFrame, n: int, key, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement, reproducible for a seed
    (smallest hash of the key).  Raises when the table has fewer rows.

    One grouped count over the hash's first digits (a bounded table) finds the
    digits up to which all rows are taken; only rows with the next digits, a
    small part of the table, are ranked.
    """
    key = as_list(key)
    h = df.withColumn("_h", sample_hash(key, seed)).withColumn("_d", F.substring("_h", 1, SAMPLE_DIGITS))
    counts = sorted((r["_d"], r["count"]) for r in h.groupBy("_d").count().collect())
    if n > sum(c for _, c in counts):
        raise ValueError(f"cannot take {n} rows from {sum(c for _, c in counts)} without replacement")
    edge, left = "", n
    for digits, c in counts:
        edge = digits
        if left <= c:
            break
        left -= c
    rank = F.row_number().over(Window.partitionBy("_d").orderBy("_h", *key))
    whole = h.where(F.col("_d") < edge)
    part = h.where(F.col("_d") == edge).withColumn("_r", rank).where(F.col("_r") <= left).drop("_r")
    return whole.unionByName(part).drop("_h", "_d")


def longest_connected_run(edges: DataFrame, id_col: str, order, begin: str, end: str,
                          flag, method: str = "global") -> DataFrame:
    """Per id, the longest run of flagged edges (in ``order``) in which
    each edge shares an endpoint with the previous flagged edge; 0 when no
    edge is flagged.  Order-dependent; not a graph longest path.

    ``method='global'`` (default, skew-safe): flagged edges are dealt out by
    ranges of (id, order), so a hot id has many partitions, and each partition
    is walked once: it gives its runs' lengths, the largest per id, and one
    row about its two ends.  The ends, one row per partition, are stitched
    to the runs that pass a border; the maximum per id is a partial aggregate.

    ``method='window'``: one window partitioned by id (one id's edges go
    through one task).
    """
    if method == "window":
        return _longest_run_window(edges, id_col, order, begin, end, flag)
    if method != "global":
        raise ValueError("method must be 'global' or 'window'")
    f = F.col(flag) if isinstance(flag, str) else flag
    order = [col(o).alias(f"_o{i}") for i, o in enumerate(as_list(order))]
    flagged = edges.where(F.coalesce(f, F.lit(False))).select(
        col(id_col).alias("_id"), identity_text(edges.select(col(id_col).alias("_id")), ["_id"]).alias("_key"),
        col(begin).alias("_b"), col(end).alias("_e"), *order)
    keys = ["_key", *[f"_o{i}" for i in range(len(order))]]
    srt = flagged.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_id", "_key", "_b", "_e")
    edge = T.StructType([srt.schema[c] for c in ("_id", "_key", "_b", "_e")])
    ends = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", edge), T.StructField("lead", T.LongType()),
                         T.StructField("last", edge), T.StructField("trail", T.LongType()), T.StructField("rows", T.LongType())])
    runs = cut_lineage(srt.mapInArrow(_run_lengths, T.StructType([srt.schema["_id"], T.StructField("best", T.LongType()), T.StructField("ends", ends)])))
    # one row per partition
    passing = _stitch([r["ends"] for r in runs.where(F.col("ends").isNotNull()).select("ends").collect()])
    more = edges.sparkSession.createDataFrame(passing, T.StructType([srt.schema["_id"], T.StructField("best", T.LongType())]))
    every = edges.select(col(id_col).alias("_id"), F.lit(0).cast("bigint").alias("best"))
    return (every.unionByName(runs.where(F.col("ends").isNull()).select("_id", "best")).unionByName(more)
            .groupBy(F.col("_id").alias(id_col)).agg(F.max("best").alias("longest_run")))


def _connected(b: pa.RecordBatch, before: pa.RecordBatch) -> np.ndarray:
    """Whether the edges of ``b`` belong to the id of those ``before`` and share an endpoint with them."""
    eq = lambda x, y: pc.equal(b.column(x), before.column(y)).fill_null(False)
    shares = pc.or_(pc.or_(eq("_b", "_b"), eq("_b", "_e")), pc.or_(eq("_e", "_b"), eq("_e", "_e")))
    return pc.and_(pc.and_(eq("_key", "_key"), shares), before.column("_b").is_valid()).to_numpy(zero_copy_only=False)


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition in order -> (id, longest closed run) rows, and one row about the partition's ends."""
    kinds = None
    first = last = None
    rows = lead = length = 0
    for b in batches:
        if not b.num_rows:
            continue
        kinds = b.schema
        start = np.ones(b.num_rows, bool)
        if b.num_rows > 1:
            start[1:] = ~_connected(b.slice(1), b.slice(0, b.num_rows - 1))
        if first is None:
            first = b.slice(0, 1)
        else:
            start[0] = not _connected(b.slice(0, 1), last)[0]
        at = np.flatnonzero(start)
        if len(at):
            # runs closed here: the one that was open, and all but the last that begin here
            lengths = np.diff(at)
            if rows:
                yield _runs_batch(kinds, last.column("_id"), np.array([length + at[0]]))
                lead = lead or length + int(at[0])
            elif len(lengths):
                lead = int(lengths[0])
            if len(lengths):
                keys = b.column("_key").take(pa.array(at[:-1])).dictionary_encode().indices.to_numpy()
                new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                yield _runs_batch(kinds, b.column("_id").take(pa.array(at[new])), np.maximum.reduceat(lengths, new))
            length = b.num_rows - int(at[-1])
        else:
            length += b.num_rows
        rows += b.num_rows
        last = b.slice(b.num_rows - 1, 1)
    if first is not None:
        yield _runs_batch(kinds, last.column("_id"), np.array([length]))
        ends = pa.array([{"part": TaskContext.get().partitionId(), "first": first.to_pylist()[0], "lead": lead or length,
                          "last": last.to_pylist()[0], "trail": length, "rows": rows}], _ends_type(kinds))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds.field("_id").type), pa.nulls(1, pa.int64()), ends], ["_id", "best", "ends"])


def _ends_type(schema: pa.Schema) -> pa.DataType:
    edge = pa.struct([schema.field(c) for c in ("_id", "_key", "_b", "_e")])
    return pa.struct([("part", pa.int32()), ("first", edge), ("lead", pa.int64()), ("last", edge), ("trail", pa.int64()), ("rows", pa.int64())])


def _runs_batch(schema: pa.Schema, ids: pa.Array, best: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int64()), pa.nulls(len(ids), _ends_type(schema))], ["_id", "best", "ends"])


def _stitch(ends: list) -> list[tuple]:
    """(id, length) of the runs that pass borders between partitions, from the partitions' ends."""
    out, before, length = [], None, 0
    for e in sorted(ends, key=lambda e: e["part"]):
        a, b = (before["last"], e["first"]) if before else (None, e["first"])
        joined = a is not None and a["_key"] == b["_key"] and a["_b"] is not None and any(
            x is not None and x == y for x in (b["_b"], b["_e"]) for y in (a["_b"], a["_e"]))
        if joined:
            out.append((b["_id"], length + e["lead"]))
        # the run that is open behind this partition
        length = length + e["rows"] if joined and e["lead"] == e["rows"] else e["trail"]
        before = e
    return out


def _longest_run_window(edges: DataFrame, id_col: str, order, begin: str, end: str, flag) -> DataFrame:
    """Window form of W1: the previous flagged edge is ``last(...,
    ignorenulls)`` over the rows before; a break starts a new island; island
    sizes and their maximum are aggregates on the same partitioning."""
    order = [col(c) for c in as_list(order)]
    f = F.col(flag) if isinstance(flag, str) else flag
    w = Window.partitionBy("_id").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = (edges.select(col(id_col).alias("_id"), *order, col(begin).alias("_b"), col(end).alias("_e"),
                      F.coalesce(f, F.lit(False)).alias("_f"))
         .withColumn("_p", F.last(F.when(F.col("_f"), F.struct("_b", "_e")), ignorenulls=True).over(before))
         .withColumns({"_pb": F.col("_p._b"), "_pe": F.col("_p._e")}))
    connected = (F.col("_b").isin(F.col("_pb"), F.col("_pe")) | F.col("_e").isin(F.col("_pb"), F.col("_pe")))
    brk = F.when(F.col("_f") & (F.col("_pb").isNull() | ~F.coalesce(connected, F.lit(False))), 1).otherwise(0)
    x = x.withColumn("_island", F.sum(brk).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy("_id", "_island").agg(F.count_if(F.col("_f")).alias("_len"))
    return runs.groupBy(F.col("_id").alias(id_col)).agg(
        F.coalesce(F.max("_len"), F.lit(0)).cast("bigint").alias("longest_run"))


def identity_text(df: DataFrame, columns) -> Column:
    """Text that is equal for equal column values: NULL equals NULL, NaN equals
    NaN, -0.0 equals 0.0, and whole numbers keep all their digits."""
    def plain(c):
        v = col(c)
        return (v + F.lit(0.0) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else v).alias(c)

    return F.to_json(F.struct(*[plain(c) for c in columns]))


def recency_walk(state: deque, values, rejected) -> list:
    """Outcome of each row in order; ``state`` holds the last accepted values."""
    out = []
    for v, bad in zip(values, rejected, strict=True):
        if bad:
            out.append(REJECTED)
        elif v in state:
            out.append(DUPLICATE)
        else:
            state.append(v)
            out.append(ACCEPTED)
    return out


def rejected_flag(df: DataFrame, error: str | None, max_err: float) -> Column:
    """|error| >= max_err, or no error value."""
    if error is None:
        return F.lit(False)
    e = col(error).cast("double")
    return F.coalesce(F.isnan(e) | (F.abs(e) >= max_err), F.lit(True))


def _segments(b: pa.RecordBatch) -> Iterator[tuple[int, str, int, int]]:
    """(piece, key, first row, end) of the runs of rows of one piece and key."""
    piece, key = b.column("_pid").to_numpy(zero_copy_only=False), b.column("_key").dictionary_encode()
    code = key.indices.to_numpy()
    new = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (code[1:] != code[:-1])))) if len(code) else np.zeros(0, np.int64)
    for a, z in zip(new.tolist(), [*new[1:].tolist(), len(code)], strict=True):
        yield int(piece[a]), key.dictionary[int(code[a])].as_py(), a, z


class _Piece:
    """What the walk over one piece of sorted rows leaves: its first and last key, the last key's window, and
    whether that window is known without the window that the piece began with.

    A value not met before in the piece is *fresh*.  After ``2 * window`` fresh values at least ``window``
    rows were accepted, so no value from before the piece counts any more; ``window`` fresh values in a row
    after that are the window, whatever came before.
    """

    def __init__(self, pid: int, key: str, entry: list, window: int):
        self.pid, self.first, self.last, self.window = pid, key, key, window
        self.recent: deque = deque(entry, maxlen=window)
        self.seen: set | None = set()
        self.fresh = self.row = 0

    def walk(self, key: str, values: list) -> list[bool]:
        if key != self.last:
            self.last, self.seen = key, None                    # the last key begins here: its window is known
            self.recent.clear()
        recent, out = self.recent, []
        for v in values:
            new = v not in recent
            if new:
                recent.append(v)
            out.append(new)
        for v in values if self.seen is not None else ():
            if v in self.seen:
                self.row = 0
                continue
            self.seen.add(v)
            self.fresh += 1
            self.row = self.row + 1 if self.fresh > 2 * self.window else 0
            if self.row >= self.window:
                self.seen = None
                break
        return out

    def report(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.pid], pa.int32()), pa.array([self.first]), pa.array([self.last]), pa.array([self.seen is None]),
                                           pa.array([list(self.recent)], pa.list_(pa.string()))], ["pid", "first", "last", "known", "window"])


_REPORT = "pid int, first string, last string, known boolean, window array<string>"


def _walk_pieces(entries: dict[int, list], window: int, cols: list | None):
    """Scan of rows sorted by (key, order), each with its piece.  A piece of the key that the task walked just before goes
    on from there, another begins with its entry.  Gives the rows' outcomes (``cols`` kept), or a report per piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: _Piece | None = None
        for b in batches:
            values, accepted = b.column("_value").to_pylist(), []
            for pid, key, a, z in _segments(b):
                if at is None or at.pid != pid:
                    if at is not None and cols is None:
                        yield at.report()
                    at = _Piece(pid, key, list(at.recent) if at is not None and at.last == key else entries.get(pid, []), window)
                accepted += at.walk(key, values[a:z])
            if cols is not None:
                outcome = pa.array([DUPLICATE, ACCEPTED]).take(pa.array(accepted, pa.bool_()).cast(pa.int8()))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], outcome], [*cols, "outcome"])
        if at is not None and cols is None:
            yield at.report()

    return run


ROUNDS = 8                      # jobs over pieces whose first window was a guess, before their keys are walked in one go


def _entries(pieces: DataFrame, order: list, window: int) -> dict[int, list]:
    """The window that each piece begins with, if its first key has rows in the piece before."""
    def reports(df: DataFrame, entries: dict) -> dict:
        return {r["pid"]: r for r in df.mapInArrow(_walk_pieces(entries, window, None), _REPORT).collect()}

    found = reports(pieces, {})                                 # one row per piece
    pids = sorted(found)
    before = {b: a for a, b in zip(pids, pids[1:]) if found[a]["last"] == found[b]["first"]}
    entry_of = lambda p: list(found[before[p]]["window"]) if p in before else []
    used = {p: [] for p in pids}
    for turn in range(ROUNDS + 1):
        open_ = [p for p in pids if not found[p]["known"] and used[p] != entry_of(p)]
        if not open_:
            break
        if turn < ROUNDS:
            used |= {p: entry_of(p) for p in open_}
            found |= reports(pieces.where(F.col("_pid").isin(open_)), used)
            continue
        # windows that never meet: what is left of such a key is walked from its first open piece on, one key a task
        rest, chained = [], set()
        for p in pids:
            if p in open_ or (p in before and before[p] in chained and not found[p]["known"]):
                chained.add(p)
                rest.append(p)
        used |= {p: entry_of(p) for p in rest if before.get(p) not in chained}
        found |= reports(pieces.where(F.col("_pid").isin(rest)).repartition("_key").sortWithinPartitions("_key", *order), used)
    return {p: entry_of(p) for p in before}


def recent_dedup(df: DataFrame, key, order, value: str, error: str | None = None,
                 window: int = 5, max_err: float = 20.0, keep=None) -> DataFrame:
    """Recency-window de-duplication per key.

    Walk each key's rows in ``order``: a row with ``|error| >= max_err`` (or a
    missing error) is 'rejected'; a row whose ``value`` is among the last
    ``window`` accepted values is a 'duplicate'; otherwise it is 'accepted'
    and enters the window.  ``value`` should already be rounded natively
    (``bround``).  NULL keys and NULL values are equal to each other.  No key
    (``[]``) makes the whole table one key.

    Rejected rows have no part in the walk and never leave the JVM.  The others
    are dealt out by ranges of (key, order), so a hot key has many pieces, and
    written once.  Every piece is walked for the window it ends with.  Where
    that depends on the window before the piece, it is walked again from the
    window that the piece before ended with, until no piece's first window
    differs from that (two jobs as a rule; a key whose windows have not met
    after ``ROUNDS`` jobs is finished by one task).  A last walk from the
    windows found gives the outcomes.  The driver gets ``window`` values per
    piece; a walk keeps the window and, until its window is known, the piece's
    distinct values.
    """
    key, order, keep = as_list(key), as_list(order), as_list(keep) or []
    cols = list(dict.fromkeys(key + keep))
    ordering = [f"_o{i}" for i in range(len(order))]
    src = df.select(*cols, *[col(o).alias(n) for o, n in zip(order, ordering, strict=True)], identity_text(df, key).alias("_key") if key else F.lit("").alias("_key"),
                    identity_text(df, [value]).alias("_value"), rejected_flag(df, error, max_err).alias("_bad"))
    out_schema = T.StructType([src.schema[c] for c in cols] + [T.StructField("outcome", T.StringType(), False)])
    pieces = cut_lineage(src.where(~F.col("_bad")).drop("_bad").repartitionByRange("_key", *ordering).sortWithinPartitions("_key", *ordering)
                         .withColumn("_pid", F.spark_partition_id()))
    walked = pieces.mapInArrow(_walk_pieces(_entries(pieces, ordering, window), window, cols), out_schema)
    return walked.unionByName(src.where("_bad").select(*cols, F.lit(REJECTED).alias("outcome")))
