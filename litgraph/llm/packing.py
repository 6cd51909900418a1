"""Cost-balanced packing of token ids into training sequences.

A document's ids (and the end id) are cut into whole pieces of the sequence length and a rest. A whole piece is a
sequence of its own. Rests are spread over packing groups by a hash; inside a group they are taken in descending
order of estimated cost, ``linear * n + quadratic * n * n``, and each goes to the sequence of lowest cost so far that
has room. A group opens as many sequences as its tokens fill; a rest that fits nowhere is cut over the cheapest
sequences with room, so that one sequence of a group at most stays short.

Groups have a bounded number of rests and whole pieces pass through one by one, so a task's memory is bounded however
long the documents are and however many the table has. Everything depends on ids and lengths only, so a task that
runs again after a lost executor gives the same rows.

Cases: a null or empty text has the end id only. Repeated rows are packed each. Ties of cost go by id and position. An
empty table gives no rows. Other input columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import load
from .common import slices

GROUP_RESTS = 2048
PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                       T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
PACKED = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
                       T.StructField("cost", T.DoubleType())])


def pieces(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): whole pieces and the rest of each document, ids as unsigned 32-bit."""
    end, width = np.array([end_id], "<u4").tobytes(), 4 * seq_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for part, texts in slices(batch, text):
                out: tuple[list, ...] = ([], [], [], [], [])
                for d, ids in zip(part.column(doc_id).to_pylist(), bpe.encode(texts), strict=True):
                    ids += end
                    for at in range(0, len(ids), width):
                        piece = ids[at:at + width]
                        for col, v in zip(out, (d, at // 4, len(piece) // 4, len(ids) // 4, piece), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], PIECES.names)

    return docs.select(doc_id, text).mapInArrow(run, PIECES)


def assign(lengths: np.ndarray, seq_len: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Places rests given in descending order: (rest, start in it, length, sequence, offset) of each part."""
    n = -(-int(lengths.sum()) // seq_len)
    room, cost, out = np.full(n, seq_len), np.zeros(n), []
    for rest, size in enumerate(lengths.tolist()):
        start = 0
        while start < size:
            fits = room >= size - start
            open_ = fits if fits.any() else room > 0
            at = int(np.argmin(np.where(open_, cost, np.inf)))
            take = min(size - start, int(room[at]))
            out.append((rest, start, take, at, seq_len - int(room[at])))
            room[at] -= take
            cost[at] += linear * take + quadratic * take * take
            start += take
    return out


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 4096,
         group_rests: int = GROUP_RESTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset, cost): every id in exactly one piece; ``cost`` is
    the piece's estimated attention cost."""
    groups = max(1, -(-docs.count() // group_rests))
    whole = pieces(docs, tokenizer, seq_len, end_id, doc_id, text)
    # by place in its partition as well, so that rows that repeat an id, or have none, do not gather in one group
    group = F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups))
    dealt = (whole.withColumn("_group", group).repartition("_group")
             .sortWithinPartitions("_group", F.desc("length"), "doc_id", "start", "doc_tokens"))

    def placed(group: int, done: int, rests: list[tuple]) -> Iterator[tuple]:
        base = (group << 32) + done
        for rest, start, take, seq, offset in assign(np.array([r[2] for r in rests], np.int64), seq_len, linear, quadratic):
            d, begin, _, total, ids = rests[rest]
            yield d, begin + start, take, total, ids[4 * start:4 * (start + take)], base + seq, offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            cost = [linear * n + quadratic * n * n for n in cols[2]]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary()),
                                               *(pa.array(c, pa.int64()) for c in cols[5:]), pa.array(cost, pa.float64())], PACKED.names)

        now, done, rests, ready = None, 0, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                *piece, group = row
                if group != now:
                    if rests:
                        ready.extend(placed(now, done, rests))
                    now, done, rests = group, 0, []
                if piece[2] == seq_len:
                    ready.append((*piece, (group << 32) + done, 0))
                    done += 1
                else:
                    rests.append(tuple(piece))
                if len(ready) >= 2000:
                    yield out(ready)
                    ready = []
        if rests:
            ready.extend(placed(now, done, rests))
        if ready:
            yield out(ready)

    return dealt.mapInArrow(run, PACKED)


def with_crc(packed: DataFrame) -> DataFrame:
    """The digest column of the pieces, from their ids."""
    return packed.withColumn("ids_crc32", F.crc32("ids"))

