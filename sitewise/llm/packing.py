"""Best-fit packing of token sequences by exact complements of lengths."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewise.llm.common import fresh, settle

CAPACITY = 2048
END_ID = 0
SLICE = 1 << 16  # pieces of one length that are numbered in one window, on average
# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters a byte-level vocabulary writes bytes with: printable ones as they are, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_encoding(vocabulary: bytes):
    """An encoder with the ids of a byte-level BPE vocabulary (the JSON file of the `tokenizers` library).

    That library needs 1000 CPU seconds for a GB of these tables; this one gives the same ids, as the
    tests hold against it, in 300. Ids rise with merge order, so they serve as ranks.
    """
    import tiktoken

    spec, letters = json.loads(vocabulary), _byte_letters()
    special = {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in k): i for k, i in spec["model"]["vocab"].items() if k not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of the pieces of a document: whole, or full pieces after a first one that may be shorter."""
    first = len(ids) % capacity or min(capacity, len(ids))
    starts = [0, *range(first, len(ids), capacity)]
    return [(a, ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]


def token_pieces(
    docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, the columns `carry` and, if wanted, ids of every piece of every document.

    A text is its ids and then END_ID; null counts as empty, so it has one piece with END_ID alone.
    Strings that look like special tokens are ordinary text. Null ids and repeated rows stay.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry) + ", ids array<int>" * with_ids
    with open(vocabulary_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary, about 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = None
        for batch in batches:
            encoding = encoding or load_encoding(shared.value)
            at, out, ids = [], [], []
            for row, text in enumerate(batch.column(1)):
                got = np.array([*encoding.encode_ordinary(text.as_py() or ""), END_ID], "<u4")
                for i, (start, part) in enumerate(cut(got, capacity)):
                    at.append(row)
                    out.append((i, start, len(part), zlib.crc32(part.tobytes())))
                    ids.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(at, pa.int64()))]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns += [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            columns += [batch.column(2 + i).take(pa.array(at, pa.int64())) for i in range(len(carry))]
            names = [id_col, "piece", "start", "length", "ids_crc32", *carry]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col, *carry).mapInArrow(run, schema)


class _Stock:
    """Counts of the lengths still unpacked, with the present lengths in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = dict(counts)
        self.present = sorted(counts)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.count[x] -= times
        for x in set(lengths):
            if not self.count[x]:
                del self.count[x]
                del self.present[bisect_left(self.present, x)]

    def largest_within(self, room: int) -> int:
        at = bisect_left(self.present, room + 1)
        return self.present[at - 1] if at else 0

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(self.count[x] // lengths.count(x) for x in lengths)


def _exact(stock: _Stock, room: int) -> tuple[int, ...]:
    """One, two or three present lengths that fill `room` exactly, the largest ones first; () if there are none."""
    count, present = stock.count, stock.present
    if count.get(room):
        return (room,)
    upto = bisect_left(present, room)
    for i in range(upto - 1, -1, -1):  # pairs, by the complement of the larger one
        a = present[i]
        if 2 * a < room:
            break
        b = room - a
        if count[a] and count.get(b) and (a != b or count[a] > 1):
            return (a, b)
    for i in range(upto - 1, -1, -1):  # triples
        a = present[i]
        if 3 * a < room:
            break
        rest = room - a
        for j in range(min(i, bisect_left(present, rest) - 1), -1, -1):
            b = present[j]
            if 2 * b < rest:
                break
            c = rest - b
            if count.get(c):
                need = (a, b, c)
                if all(count[x] >= need.count(x) for x in need):
                    return need
    return ()


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up `counts` (length -> pieces).

    From the longest length down: if the gap it leaves is a single, pair or triple sum of lengths in
    stock, that combination is taken as often as the counts allow; else the longest length that fits
    goes in (best fit) and the gap that is left is tried again. The input has at most `capacity`
    lengths, whatever the number of pieces, and so has the work here.
    """
    stock, out = _Stock(counts), []
    while stock.present:
        head = stock.present[-1]
        pattern, room = (head,), capacity - head
        stock.count[head] -= 1  # the head is held back while its fillers are sought
        held = [head]
        while room:
            found = _exact(stock, room)
            if found:
                pattern += found
                break
            best = stock.largest_within(room)
            while best and not stock.count[best]:
                best = stock.present[bisect_left(stock.present, best) - 1] if stock.present[0] < best else 0
            if not best:
                break
            stock.count[best] -= 1
            held.append(best)
            pattern += (best,)
            room -= best
        for x in held:
            stock.count[x] += 1
        times = stock.times(pattern)
        stock.take(pattern, times)
        out.append((pattern, times))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset, in few sequences of at most `capacity` ids.

    pieces: length (1 to capacity) and any other columns. Pieces of one length are alike to the
    plan, so the driver gets a count per length (at most `capacity` rows) and gives back runs of
    numbers: the pieces numbered from a to b of a length go to place p of sequences s, s + 1, ...
    Numbers come in two levels, by a hash of the row and then inside its slice, so a length that
    a third of all pieces share is spread. The runs, a few per pattern, are broadcast: their number
    follows the number of lengths. Equal rows may swap. Columns named sequence_id or offset are
    replaced; an empty table gives no rows.
    """
    pieces = pieces.drop("sequence_id", "offset")
    part, number, first, lo, hi, base = fresh(pieces, "_part", "_number", "_first", "_lo", "_hi", "_base")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs, used, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, times in plan_patterns(counts, capacity):
        offset = 0
        for x in pattern:
            runs.append((x, used[x], used[x] + times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    plan = pieces.sparkSession.createDataFrame(runs, f"length long, {lo} long, {hi} long, {base} long, offset long")

    slices = max(1, sum(counts.values()) // SLICE)
    order = [c for c in pieces.columns if c not in ("length", "ids")]
    rows = pieces.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(slices)))
    sizes = rows.groupBy("length", part).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(first))
    inside = F.row_number().over(Window.partitionBy("length", part).orderBy(*order))
    rows = rows.withColumn(number, inside - 1).join(starts, ["length", part]).withColumn(number, F.col(number) + F.col(first))
    fits = (F.col(number) >= F.col(lo)) & (F.col(number) < F.col(hi))
    placed = rows.join(F.broadcast(plan.withColumnRenamed("length", f"{lo}l")), (F.col("length") == F.col(f"{lo}l")) & fits)
    return placed.select(*pieces.columns, (F.col(base) + F.col(number) - F.col(lo)).alias("sequence_id"), "offset")


def pack_documents(
    docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """token_pieces of docs, written to the shared folder once, and packed."""
    return pack(settle(token_pieces(docs, vocabulary_path, capacity, id_col, text_col, with_ids, carry)), capacity)
