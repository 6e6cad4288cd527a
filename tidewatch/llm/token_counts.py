"""Token counts of whole texts from counts of their pre-tokens, without making the texts' ids.

Texts are split into pre-tokens in chunks of about CHUNK_BYTES. A chunk gives its distinct
pre-tokens, numbered, and for every document the (number, frequency) pairs. Over all chunks each
distinct pre-token is encoded once; its count is joined to the chunks that have it, and the counts
of a chunk, packed by their numbers, meet the chunk's documents, where frequency x count is
summed. So what is shuffled grows with the distinct pre-tokens of a chunk, not with the words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, written
from .tokens import default_tokenizer, encoder

LIMIT, CHUNK_BYTES, CHUNKS_A_SALT, FLUSH_ROWS = 512, 16 << 20, 1000, 2_000_000
SPLIT = "chunk long, doc_id long, n_bytes long, pairs binary, piece string, number int"
COUNTED = "doc_id long, n_bytes long, n_tokens long"


def _planes(numbers: np.ndarray, values: np.ndarray) -> bytes:
    """Ordered distinct numbers, as differences, and a value for each, byte plane by byte plane."""
    both = np.r_[np.diff(numbers, prepend=numbers.dtype.type(0)), values].astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").ravel()
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.int64), both[half:].astype(np.int64)


def _pack(ids: list[int]) -> bytes:
    """The distinct numbers of a document with their frequencies."""
    return _planes(*np.unique(np.array(ids, np.uint32), return_counts=True))


def _split(path: str, chunk_bytes: int):
    """Rows of documents (pairs) and of a chunk's distinct pre-tokens (piece, number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, chunk = encoder(path), TaskContext.get().partitionId() << 32
        numbers: dict[str, int] = {}
        size = 0

        def rows(n: int, **columns) -> pa.RecordBatch:
            types = {"chunk": pa.int64(), "doc_id": pa.int64(), "n_bytes": pa.int64(), "pairs": pa.binary(), "piece": pa.string(), "number": pa.int32()}
            columns["chunk"] = np.full(n, chunk)
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()], names=list(types))

        def vocabulary() -> Iterator[pa.RecordBatch]:
            pieces = list(numbers)
            for a in range(0, len(pieces), 50_000):
                part = pieces[a : a + 50_000]
                yield rows(len(part), piece=part, number=np.arange(a, a + len(part)))

        for b in batches:
            docs, sizes, pairs = [], [], []
            for doc, n, text in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("text")):
                docs.append(doc)
                sizes.append(n)
                pairs.append(_pack([numbers.setdefault(p, len(numbers)) for p in enc.pieces(text.as_py())]))
                size += n
                if size >= chunk_bytes:
                    yield rows(len(docs), doc_id=docs, n_bytes=sizes, pairs=pairs)
                    yield from vocabulary()
                    docs, sizes, pairs, size = [], [], [], 0
                    numbers.clear()
                    chunk += 1
            yield rows(len(docs), doc_id=docs, n_bytes=sizes, pairs=pairs)
        yield from vocabulary()

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.ids(p.as_py())) // 4 for p in b.column("piece")]
            yield pa.RecordBatch.from_arrays([b.column("piece"), pa.array(n, pa.int64())], names=["piece", "n"])

    return run


def _pack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, counts): what a task knows of the counts of a chunk's pre-tokens, by number."""
    held: list = []
    size = 0

    def flush() -> pa.RecordBatch:
        chunk, number, n = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((number, chunk))
        chunk, number, n = chunk[order], number[order].astype(np.uint32), n[order]
        edge = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True])
        packed = [_planes(number[a:z], n[a:z]) for a, z in zip(edge, edge[1:])]
        return pa.RecordBatch.from_arrays([pa.array(chunk[edge[:-1]]), pa.array(packed, pa.binary())], names=["chunk", "counts"])

    for b in batches:
        if b.num_rows:
            held.append(tuple(b.column(c).to_numpy() for c in ("chunk", "number", "n")))
            size += b.num_rows
        if size >= FLUSH_ROWS:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _sum(docs: pa.Table, counts: pa.Table) -> pa.Table:
    parts = [_unpack(c.as_py()) for c in counts.column("counts")]
    n = np.zeros(sum(len(number) for number, _ in parts), np.int64)  # a chunk's numbers are 0, 1, ...
    for number, value in parts:
        n[number] = value
    totals = []
    for pairs in docs.column("pairs"):
        number, times = _unpack(pairs.as_py())
        totals.append(int((n[number] * times).sum()))
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(totals, pa.int64())})


def count_tokens(docs: DataFrame, tokenizer: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row.

    Null texts count as empty, with no tokens; a text longer than a chunk is a chunk of its own;
    repeated rows and null doc_ids stay as they are; an empty table gives none; columns other than
    doc_id and text are ignored.
    """
    path = tokenizer or default_tokenizer()
    texts = keyed_texts(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    split = written(texts.mapInArrow(_split(path, chunk_bytes), SPLIT), "pre-tokens", compression="zstd")
    chunks = split.filter("number = 0").count()
    # a pre-token that all chunks have is met in parts, each of about CHUNKS_A_SALT chunks
    salt = F.pmod(F.xxhash64("chunk"), F.lit(1 + chunks // CHUNKS_A_SALT)).alias("salt")
    used = split.filter("piece IS NOT NULL").select("piece", salt, "chunk", "number")
    pieces = used.select("piece", "salt").distinct()
    known = written(pieces.select("piece").distinct().mapInArrow(_encode(path), "piece string, n long"), "piece-counts", compression="zstd")
    of_chunk = used.join(pieces.join(known, "piece"), ["piece", "salt"]) if chunks >= CHUNKS_A_SALT else used.join(known, "piece")
    counts = written(of_chunk.select("chunk", "number", "n").mapInArrow(_pack_counts, "chunk long, counts binary"), "chunk-counts")
    of_docs = split.filter("pairs IS NOT NULL").select("chunk", "doc_id", "n_bytes", "pairs")
    return of_docs.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_sum, COUNTED)


def op5(docs: DataFrame) -> DataFrame:
    return count_tokens(docs).select("*", (F.col("n_tokens") > LIMIT).alias("over_limit"))
