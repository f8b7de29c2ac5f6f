"""Token ids packed into fixed-length sequences, written as binary blocks.

Each input partition is tokenised and packed where it is read: no shuffle, and
a lost executor's partitions are simply redone. A task buffers the pieces of
about `Config.buffer_tokens` tokens, sorts them by length and packs them
best-fit-decreasing: a segment tree over remaining capacities finds the fullest
sequence that still takes a piece. A document longer than a sequence is split
losslessly into full-length pieces and a rest; nothing is dropped.

A block row holds up to `Config.block_rows` sequences:
  ids          little-endian id matrix, rows x length, padded with `pad_id`
  cu_seqlens   for each sequence its cumulative segment lengths, starting with 0
  resets       offsets in the flat matrix where positions restart at 0: the
               start of every segment and of the padding
  doc_ids, pieces, starts   for each segment the document, its piece number and
               the piece's first token in the document
Every document ends with the end token, so an empty or null text is one token.

Defined results: null doc_ids stay null; repeated rows are packed row by row;
pieces of equal length go in the order in which they were read, and of bins with
equal room the one filled last takes the piece; extra columns are ignored; an
empty table gives no blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.session import scratch_path

#: How the byte-level vocabulary splits a text into pieces (fixed value).
PIECE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BLOCK_SCHEMA = (
    "block long, n_seqs int, seq_len int, id_bytes int, ids binary, cu_seqlens array<array<int>>, resets array<int>, "
    "doc_ids array<array<long>>, pieces array<array<int>>, starts array<array<long>>"
)


@dataclass(frozen=True)
class Config:
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    end_id: int = 50_256
    pad_id: int = 50_256
    seq_len: int = 2048
    buffer_tokens: int = 1 << 21  # tokens packed together; bounds a task's memory
    block_rows: int = 64
    id_bytes: int = 2  # 2 while ids stay under 65,536, else 4
    cached_words: int = 150_000  # words whose ids a worker remembers; speed only


class Tokenizer:
    """Byte-level BPE ids. A text without adjoining white space is cut before
    each space, which is a piece boundary of the pattern, and words seen before
    are looked up; any other text is encoded whole. Both give the same ids."""

    def __init__(self, cfg: Config):
        import tiktoken

        with open(cfg.vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.dtype = np.dtype("<u2" if cfg.id_bytes == 2 else "<u4")
        if max(max(ranks.values()), cfg.end_id, cfg.pad_id) > np.iinfo(self.dtype).max:
            raise ValueError("ids do not fit id_bytes")
        self.encode = tiktoken.Encoding("own", pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.room = cfg.cached_words

    def _word(self, word: str) -> bytes:
        ids = np.array(self.encode(word), self.dtype).tobytes()
        if len(self.known) < self.room:
            self.known[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        parts = text.split(" ")
        if all(p and not p[0].isspace() and not p[-1].isspace() for p in parts):
            known, word = self.known.get, self._word
            first, *rest = parts
            return (known(first) or word(first)) + b"".join([known(p) or word(p) for p in [" " + p for p in rest]])
        return np.array(self.encode(text), self.dtype).tobytes()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each piece, and the number of bins. Pieces go in order of
    falling length to the fullest bin with room, found in a segment tree over
    the possible capacities (leaf c counts the open bins with c tokens left)."""
    size = 1 << int(capacity).bit_length()  # leaves 0..capacity
    tree = [0] * (2 * size)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    owner = np.empty(len(lengths), np.int64)
    n_bins = 0

    def add(c: int, d: int) -> None:
        node = c + size
        while node:
            tree[node] += d
            node >>= 1

    for k in np.argsort(-lengths, kind="stable"):
        n = int(lengths[k])
        node = n + size  # the least leaf >= n that counts a bin
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                node = 0
            else:
                node += 1
                while node < size:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
        if node:
            left = node - size
            b = open_bins[left].pop()
            add(left, -1)
        else:
            left, b = capacity, n_bins
            n_bins += 1
        owner[k] = b
        if left > n:
            open_bins[left - n].append(b)
            add(left - n, 1)
    return owner, n_bins


def pack_pieces(pieces: list[tuple], cfg: Config, dtype: np.dtype) -> Iterator[dict]:
    """Blocks of the buffered pieces (doc_id, piece number, first token, id bytes)."""
    lengths = np.array([len(p[3]) // dtype.itemsize for p in pieces], np.int64)
    owner, n_bins = best_fit_decreasing(lengths, cfg.seq_len)
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(n_bins + 1))
    for first in range(0, n_bins, cfg.block_rows):
        rows = range(first, min(n_bins, first + cfg.block_rows))
        matrix = np.full((len(rows), cfg.seq_len), cfg.pad_id, dtype)
        block = {"n_seqs": len(rows), "cu_seqlens": [], "resets": [], "doc_ids": [], "pieces": [], "starts": []}
        for r, b in enumerate(rows):
            members = [pieces[k] for k in order[bounds[b] : bounds[b + 1]]]
            flat = np.frombuffer(b"".join(m[3] for m in members), dtype)
            matrix[r, : len(flat)] = flat
            ends = np.cumsum([0, *(len(m[3]) // dtype.itemsize for m in members)]).astype(np.int32)
            block["cu_seqlens"].append(ends)
            block["resets"].append(r * cfg.seq_len + (ends if ends[-1] < cfg.seq_len else ends[:-1]))
            block["doc_ids"].append([m[0] for m in members])
            block["pieces"].append([m[1] for m in members])
            block["starts"].append([m[2] for m in members])
        block["resets"] = np.concatenate(block["resets"])
        block["ids"] = matrix.tobytes()
        yield block


def pack(documents: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Packed blocks of all documents (BLOCK_SCHEMA)."""
    lists = {"cu_seqlens": pa.list_(pa.list_(pa.int32())), "resets": pa.list_(pa.int32()), "doc_ids": pa.list_(pa.list_(pa.int64())), "pieces": pa.list_(pa.list_(pa.int32())), "starts": pa.list_(pa.list_(pa.int64()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, pieces, held, block_no, part = None, [], 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block_no
            for block in pack_pieces(pieces, cfg, tokenizer.dtype):
                block |= {"block": (part << 33) | block_no, "seq_len": cfg.seq_len, "id_bytes": cfg.id_bytes}
                block_no += 1
                scalar = {"block": pa.int64(), "n_seqs": pa.int32(), "seq_len": pa.int32(), "id_bytes": pa.int32(), "ids": pa.binary()}
                yield pa.RecordBatch.from_pydict({n: pa.array([block[n]], t) for n, t in (scalar | lists).items()})

        width = cfg.id_bytes
        end = cfg.end_id.to_bytes(width, "little")
        for batch in batches:
            tokenizer = tokenizer or Tokenizer(cfg)
            for doc_id, text, part in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("part").to_pylist()):
                ids = tokenizer(text or "") + end
                for k, at in enumerate(range(0, len(ids), cfg.seq_len * width)):
                    pieces.append((doc_id, k, at // width, ids[at : at + cfg.seq_len * width]))
                held += len(ids) // width
                if held >= cfg.buffer_tokens:
                    yield from flush()
                    pieces, held = [], 0
        if pieces:
            yield from flush()

    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, BLOCK_SCHEMA).select(*names)


def write_packed(documents: DataFrame, cfg: Config = Config(), path: str | None = None) -> DataFrame:
    """Writes the blocks as Parquet (to a new folder in the shared scratch if
    no path is given) and returns the table read back."""
    path = path or scratch_path(documents.sparkSession, "packed")
    blocks = pack(documents, cfg)
    blocks.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(blocks.schema).parquet(path)


def sequences(blocks: DataFrame) -> DataFrame:
    """One row a packed sequence, read from the blocks: its ids' crc32, its
    cumulative segment lengths, position resets, documents and pieces. The id
    matrix is cut inside the projection, so no row carries it further."""

    def row(i):
        width = F.col("seq_len") * F.col("id_bytes")
        low = i * F.col("seq_len")
        at = lambda c: F.element_at(c, i + 1)
        return F.struct(
            i.alias("row"),
            F.element_at(at("cu_seqlens"), -1).cast("long").alias("n_tokens"),
            F.size(at("doc_ids")).alias("n_segments"),
            at("doc_ids").alias("doc_ids"),
            at("pieces").alias("pieces"),
            at("starts").alias("starts"),
            at("cu_seqlens").alias("cu_seqlens"),
            F.transform(F.filter("resets", lambda x: (x >= low) & (x < low + F.col("seq_len"))), lambda x: x - low).alias("resets"),
            F.crc32(F.substring(F.col("ids"), i * width + 1, width)).alias("ids_crc32"),
        )

    rows = F.transform(F.sequence(F.lit(0), F.col("n_seqs") - 1), row)
    return blocks.select("block", F.explode(rows).alias("s")).select("block", "s.*")
