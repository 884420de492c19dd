"""Best-fit packing (5) of token pieces by the sum-of-squares rule.

A text is encoded whole and closed by one end id; texts longer than
``capacity`` are cut into pieces of that many tokens, the last may be
shorter.  Pieces are dealt by hash into groups of about ``group_rows`` and
packed per group: each piece goes where the sum over all residual gaps of
the squared number of open sequences with that gap becomes smallest, a new
sequence included; ties keep the smaller gap.  A group's larger pieces come
first, in hash order, its smallest share last, which closes the gaps that
are open at the end.  Until the lower bound (tokens / capacity) is reached,
the orders of ``ORDERS`` are tried in turn and the best one is kept.

The number of groups follows the number of pieces, so that a group stays
bounded; each leaves a few sequences partly filled.

Cases: null and empty texts are one piece, the end id alone; repeated rows,
also of one id, are packed each for itself; an empty table gives no rows; a
null id is kept; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import slices, text_column
from .tables import written

CAPACITY = 4096
END_ID = 1
GROUP_ROWS = 40_000
ORDERS = ((0.3, False), (0.6, True), (0.5, False))  # share of late pieces, whether those come by falling length


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, placed in the given order."""
    count = np.zeros(capacity + 1, dtype=np.int64)   # open sequences by residual gap; gap 0 is closed, never counted
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    never = np.int64(1) << 40
    made = 0
    for i, size in enumerate(lengths.tolist()):
        best, gap = never, 0
        if size < capacity:
            have = count[size:capacity]
            # half the change of the sum, less one, when a sequence of gap g gets the piece
            change = np.where(have > 0, count[:capacity - size] - have, never)
            gap = int(change.argmin())
            best = change[gap]
            gap += size
        if size == capacity or best >= count[capacity - size]:
            seq, gap = made, capacity
            made += 1
        else:
            seq = open_at[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = seq, capacity - gap
        rest = gap - size
        if rest:
            count[rest] += 1
            open_at[rest].append(seq)
    return where, offset


def pieces(docs: DataFrame, doc_id: str, text: str, tokenizer_json: str, capacity: int, end_id: int,
           with_ids: bool) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32[, ids]) of every text."""
    from .word_ids import mergeable
    spark = docs.sparkSession
    sent, by_rank, key = spark.sparkContext.broadcast(tokenizer_json), mergeable(tokenizer_json), uuid.uuid4().hex
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        from driftrank.llm import worker_cache
        from driftrank.llm.word_ids import WordIds
        table = worker_cache.once(key, lambda: WordIds(sent.value, by_rank))
        end = np.uint32(end_id).astype("<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            for part in slices(batch, "text"):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, t in enumerate(text_column(part, "text").to_pylist()):
                    data = table.encode(t) + end
                    for k, at in enumerate(range(0, len(data), step)):
                        cut = data[at:at + step]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(np.frombuffer(cut, dtype="<i4"))
                out = [part.column(0).take(pa.array(row, type=pa.int64())),
                       part.column(1).take(pa.array(row, type=pa.int64())), pa.array(piece, type=pa.int32()),
                       *[pa.array(x, type=pa.int64()) for x in (start, length, crc)]]
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(ids, type=pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return (docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"),
                        F.col(text).alias("text"))
            .mapInArrow(run, f"uid long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
                             + ", ids array<int>" * with_ids))


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, group_rows: int = GROUP_ROWS, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece.

    ``tokenizer`` is the path of a tokenizer file on the driver.
    """
    with open(tokenizer, encoding="utf-8") as f:
        cut = written(pieces(docs, doc_id, text, f.read(), capacity, end_id, with_ids), "pieces")
    groups = max(1, -(-cut.count() // group_rows))

    def one_group(key, table):
        length = table["length"].to_numpy()
        turn = table["turn"].to_numpy()
        fewest = -(-int(length.sum()) // capacity)
        best = None
        for share, falling in ORDERS:
            late = length <= np.quantile(length, share)
            order = np.lexsort((turn, np.where(late & falling, -length, 0), late))
            seq, at = sum_of_squares(length[order], capacity)
            if best is None or seq.max() < best[0]:
                where, offset = np.empty_like(seq), np.empty_like(at)
                where[order], offset[order] = seq, at
                best = seq.max(), where, offset
            if best[0] + 1 <= fewest:
                break
        _, where, offset = best
        return pa.table({"uid": table["uid"], "piece": table["piece"],
                         "sequence_id": pa.array(where * groups + key[0].as_py()), "offset": pa.array(offset)})

    placed = (cut.select("uid", "piece", "length", F.xxhash64("uid", "piece").alias("turn"))
              .withColumn("g", F.expr(f"pmod(xxhash64(turn), {groups})")).groupBy("g")
              .applyInArrow(one_group, "uid long, piece int, sequence_id long, offset long"))
    return cut.join(placed, ["uid", "piece"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
