"""Operator 12: cost-balanced packing.

A piece of n tokens costs ``linear * n + quadratic * n * n``: the projections of a layer grow with the tokens, attention
with their square. Whole runs of ``capacity`` tokens are sequences of their own, dealt like the rest. What is left of each document, less than
``capacity`` tokens, is dealt in turn over blocks of about ``BLOCK`` documents, so that every block holds a fair sample of
all lengths. In a block the pieces go in descending order of cost, each to the sequence of the lowest cost that has room
for all of it; one that fits nowhere whole is cut into the roomiest ones. A block opens as many full sequences as its tokens
fill, and for the rest sequences of the powers of two that add up to it, which need no padding: so nothing is padded.

Blocks are independent and bounded (``BLOCK`` pieces of less than ``capacity`` ids), so tasks grow with the rows and no
key decides where a row goes: equal texts are dealt like others. The order of rows in a partition of ``docs`` must be
repeatable (a table, or ``stored`` rows), as the place of a row decides its block.

Defined cases: null or empty text is the closing id alone; repeated rows are packed separately, null ids too; an empty
table gives no rows; columns besides doc_id and text are not read. Offsets in a sequence are gapless.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import ByteBpe

CAPACITY, END, BLOCK = 1024, 0, 1024
#: A layer of width d costs about 24*d*d flops a token and 4*d for each pair of tokens: 6*d to 1, here for d = 1024.
LINEAR, QUADRATIC = 6 * 1024, 1
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost long"


def sizes_of(tokens: int, capacity: int) -> list[int]:
    """Capacities that ``tokens`` fill exactly: full ones, then powers of two."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def assign(lengths: list[int], capacity: int, linear: int = LINEAR, quadratic: int = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """(piece, start in it, length, sequence, offset) of each part, and the sequences' costs."""
    room = np.array(sizes_of(sum(lengths), capacity), np.int64)
    size, cost, none = room.copy(), np.zeros(len(room), np.int64), np.iinfo(np.int64).max
    out = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at, left = 0, lengths[k]
        while left:
            s = int(np.where(room >= left, cost, none).argmin())
            if room[s] < left:  # nowhere whole
                s = int(room.argmax())
            n = min(left, int(room[s]))
            out.append((k, at, n, s, int(size[s] - room[s])))
            room[s] -= n
            cost[s] += linear * n + quadratic * n * n
            at, left = at + n, left - n
    return out, cost


def pack_balanced(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.tiktoken", linear: int = LINEAR, quadratic: int = QUADRATIC, block: int = BLOCK) -> DataFrame:
    """One row for each part: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_cost."""
    blocks = max(1, -(-docs.count() // block))
    names = [x.split()[0] for x in PLACED.split(", ")]
    dealt = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("block", pa.int64()), ("turn", pa.int64())])
    placed = pa.schema([(n, pa.int64()) for n in names])
    crc = lambda ids: zlib.crc32(np.ascontiguousarray(ids, "<u4"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's full runs and its rest (with ids), dealt over the blocks in turn."""
        task = TaskContext.get().partitionId()
        encode, turn, first = ByteBpe(vocabulary).encode_whole, 0, task * 0x9E3779B1
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END))
                for at in range(0, len(ids), capacity):
                    own = ids[at : at + capacity]
                    whole = len(own) == capacity
                    rows.append((doc, at, len(own), len(ids), crc(own) if whole else None, None if whole else own.astype("<u2" if own.max() < 1 << 16 else "<u4").tobytes(), (first + turn) % blocks, task << 33 | turn))
                    turn += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(dealt), dealt)], schema=dealt)

    def fill(own: pa.Table) -> pa.Table:
        """One block: full runs as they are, then the rests by ``assign``."""
        own = own.sort_by("turn")
        base = own.column("block")[0].as_py() << 24
        whole = own.filter(pa.compute.is_null(own.column("ids")))
        n, full_cost = len(whole), linear * capacity + quadratic * capacity**2
        rows = [(*r, base + k, 0, full_cost) for k, r in enumerate(zip(*(whole.column(c).to_pylist() for c in names[:5])))]
        doc, start, length, total, ids = (own.filter(pa.compute.is_valid(own.column("ids"))).column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids"))
        parts, cost = assign(length, capacity, linear, quadratic)
        for k, at, m, s, offset in parts:
            cut = np.frombuffer(ids[k], "<u2" if len(ids[k]) == 2 * length[k] else "<u4")[at : at + m]
            rows.append((doc[k], start[k] + at, m, crc(cut), total[k], base + n + s, offset, int(cost[s])))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=placed)

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tokenise, "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary, block long, turn long")
    return rows.groupBy("block").applyInArrow(fill, PLACED)
