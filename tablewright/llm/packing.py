"""Packing documents into sequences along a space-filling curve.

1. A document's words are hashed to signed coordinates: each word adds a fixed +-1
   pattern of DIMS coordinates, scaled by the document's length, so similar texts get
   near points.  The point is quantised and turned into a Hilbert curve index.
2. The documents are range-sorted by (index, digest of id, id): ranges are cut inside
   groups of equal texts as well, so no group lands in one task.
3. Each range is tokenised in order and its ids are laid end to end into sequences of
   LENGTH ids; a document is cut where a sequence is full.  The ids left at the end of
   a range are cut into sequences of powers of two, so no sequence needs padding.

Ranges are as many as the characters ask for, so that none grows with the corpus.
Nothing of a range is held but the current batch; sequence ids number the range in
their upper bits.  Defined results: null text counts as empty, and an empty document
is the end id alone; repeated rows are packed once each; null ids are packed too.
An empty table gives no rows; a very long text is cut into as many pieces as it takes.
Other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.session import prepared, table
from tablewright.llm.subwords import subwords
from tablewright.llm.words import U64, chunks, mix, segment

LENGTH = 4096
#: Characters a range holds on average.
RANGE_CHARS = 16_000_000
END_ID = 2
DIMS, BITS = 6, 10
TOKENIZER = "word_bpe_49k.json"


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows) with bits a coordinate.

    Each level rotates and reflects the cube by what the levels above have chosen
    (Gray code of the axes), after which the bits are read level by level.
    """
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def project(words) -> np.ndarray:
    """Quantised coordinates of each document, from signs that its words' hashes choose."""
    n = len(words.first) - 1
    h = mix(words.prefix_hash())
    point = np.zeros((n, DIMS))
    for k in range(DIMS):
        sign = ((h >> U64(k)) & U64(1)).astype(np.float64) * 2 - 1
        total = np.concatenate(([0.0], np.cumsum(sign)))
        point[:, k] = total[words.first[1:]] - total[words.first[:-1]]
    count = np.maximum(np.diff(words.first), 1)[:, None]
    # spread over the range whatever the length: signs of n words sum to about sqrt(n)
    return np.clip(((np.tanh(point / (2 * np.sqrt(count))) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def _place(batches):
    with np.errstate(over="ignore"):
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column("text")):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(hilbert_index(project(segment(raw, offsets))))], names=["doc_id", "text", "curve"])


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_ids(store, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all the texts in a row, each with the end id, and how many each has."""
    words = segment(raw, offsets)
    ids, size = store.ids(words)
    ends = np.concatenate(([0], np.cumsum(size)))[words.first]
    counts = np.diff(ends) + 1
    out = np.full(int(counts.sum()), END_ID, dtype=np.uint32)
    body = np.ones(len(out), dtype=bool)
    body[np.cumsum(counts) - 1] = False
    out[body] = ids
    return out, counts


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packer(name: str):
    """Packs one sorted range, batch by batch."""

    def pack(batches):
        from pyspark import TaskContext

        store = subwords(tokenizer_path(name))
        base = TaskContext.get().partitionId() << 32
        sequence, fill = 0, 0
        rows: list[tuple] = []
        open_: list[tuple] = []  # pieces of the sequence being filled: (doc_id, start, ids, doc_tokens)

        def close(pieces, number):
            at = 0
            for doc, start, ids, tokens in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, base | number, at))
                at += len(ids)

        def out():
            columns = list(zip(*rows)) if rows else [[]] * 7
            rows_ = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECE.split(", ")])
            rows.clear()
            return rows_

        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column("text")):
                docs = batch.column("doc_id").slice(a, b - a).to_pylist()
                with np.errstate(over="ignore"):
                    ids, counts = text_ids(store, raw, offsets)
                at = 0
                for doc, n in zip(docs, counts.tolist()):
                    start = 0
                    while start < n:
                        take = min(n - start, LENGTH - fill)
                        open_.append((doc, start, ids[at + start : at + start + take], n))
                        start += take
                        fill += take
                        if fill == LENGTH:
                            close(open_, sequence)
                            open_, fill, sequence = [], 0, sequence + 1
                    at += n
                open_ = [(d, s, i.copy(), n) for d, s, i, n in open_]  # lets the batch's ids go
                yield out()
        # the rest, in powers of two
        pieces = open_
        while fill:
            size = 1 << (fill.bit_length() - 1)
            now, later, room = [], [], size
            for d, s, i, n in pieces:
                k = min(len(i), room)
                if k:
                    now.append((d, s, i[:k], n))
                if k < len(i):
                    later.append((d, s + k, i[k:], n))
                room -= k
            close(now, sequence)
            pieces, fill, sequence = later, fill - size, sequence + 1
        yield out()

    return pack


def pack(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    prepared(docs.sparkSession)
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = at.mapInArrow(_place, "doc_id long, text string, curve long")
    spread = F.xxhash64("doc_id", F.lit(10))
    chars = at.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    return placed.repartitionByRange(int(chars // RANGE_CHARS) + 1, "curve", spread).sortWithinPartitions("curve", spread, "doc_id").select("doc_id", "text").mapInArrow(packer(name), PIECE)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(prepared(spark), sf_dir, "documents"))
