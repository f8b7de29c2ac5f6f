"""Language-model scores by prediction by partial matching (PPM).

The model is a byte-context trie: counts of every byte after every context of
up to `Config.order` bytes in the training texts (A-Z lower-cased, padded at the
start, closed by an end symbol). A byte is coded at the longest context that the
trie has; a byte not seen there costs an escape (method C: distinct followers
over total plus distinct), and the next shorter context is asked with the longer
one's symbols excluded. After the empty context the remaining symbols are equal.
A document's score is its log10 probability, end included.

Exclusion only needs the context just escaped from (its followers are followers
of every suffix), so its sums are precomputed for each trie node and a whole run
of bytes is scored by table lookups. The counts are summed by Spark over all
training texts and stored by the executors; the driver sees sizes only. The trie is cut
into slices of at most `Config.slice_edges` longest contexts' symbols by the byte
before the symbol; a byte with more of them is cut by the byte before it, and so
on. Every slice also has the whole counts of the contexts that were cut (at most
256 symbols each), so it answers all lengths of context for its positions and is
exact on its own; a worker holds one at a time.

The base score is an add-0.1 unigram model of words and one end token. Counts of
frequent words (at least a `frequent`th of all tokens, so at most `frequent`
words) are broadcast; each document's other distinct words are joined to the
counts by a shuffle, which needs no bound.

Defined results: null texts count as empty (one end token, one end symbol); a
null doc_id is held out; repeated rows are scored, and learned, row by row;
extra columns are ignored; without training rows every word is unknown and
every symbol equally likely.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import crc32_mod, record_batch, utf8
from revlens.session import materialize, scratch_path

#: Bytes that no UTF-8 text holds: start padding and end symbol. 255 symbols can follow.
PAD, END, SYMBOLS = 0xFE, 0xFF, 255
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


@dataclass(frozen=True)
class Config:
    order: int = 3  # longest context in bytes, 7 at most
    slice_edges: int = 2_000_000  # (context, symbol) pairs of the longest length in a slice (those of one context stay together)
    run_bytes: int = 1 << 19  # bytes scored at once
    held_bytes: int = 1 << 25  # text a worker holds while it goes through several slices
    frequent: int = 1 << 18  # bound of the broadcast word table
    held_words: int = 400_000  # distinct words a counting task holds before it passes them on
    fold_of: int = 10


def lowered(text: str | None) -> bytes:
    return utf8(text).translate(_LOWER)


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of the texts, ends included, the number made of its
    context and itself, and the text it belongs to."""
    pad, end = bytes([PAD]) * order, bytes([END])
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8)
    wide = np.uint32 if order <= 3 else np.uint64
    n = len(raw) - order
    keys = np.zeros(n, wide)
    for k in range(order + 1):
        keys = (keys << wide(8)) | raw[k : k + n].astype(wide)
    real = raw[order:] != PAD
    return keys[real], np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])


def runs(texts: list[bytes], most: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first text, texts) of about `most` bytes."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > most:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t) + 8
    if start < len(texts):
        yield start, texts[start:]


# --- the trie ---------------------------------------------------------------


class Table:
    """Open-addressing lookup from number to position in the sorted keys."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.size = np.uint64(64 - bits), 1 << bits
        self.keys = np.zeros(self.size, keys.dtype)
        self.at = np.full(self.size, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.at[slot[left]] < 0
            self.at[slot[left[free]]] = left[free]  # of several for one slot the last stays
            won = self.at[slot[left]] == left
            self.keys[slot[left[won]]] = keys[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (self.size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.at[slot]
        open_ = np.flatnonzero((self.keys[slot] != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.size - 1)
            at = self.at[slot[open_]]
            found[open_] = at
            open_ = open_[(self.keys[slot[open_]] != keys[open_]) & (at >= 0)]
        return found


#: By context length: pairs and their counts.
Whole = dict[int, tuple[np.ndarray, np.ndarray]]


class Trie:
    """Lookup tables of one slice: by context length, pairs and contexts. `whole`
    has, by context length, the pairs and counts of the contexts cut between slices."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, root: np.ndarray, order: int, whole: Whole | None = None):
        wide = np.uint32 if order <= 3 else np.uint64
        self.order, self.wide = order, wide
        n = counts.astype(np.float64)
        keys = keys.astype(wide)
        levels = []
        for k in range(order, 0, -1):
            if k < order:
                keys, inverse = np.unique(keys & wide((1 << 8 * (k + 1)) - 1), return_inverse=True)
                n = np.bincount(inverse, n, len(keys))
                if whole and k in whole:
                    own, known = keys, whole[k][0].astype(wide)
                    keys = np.union1d(own, known)
                    inverse = np.searchsorted(keys, own)[inverse]
                    sums, n = n, np.zeros(len(keys))
                    n[np.searchsorted(keys, own)] = sums
                    n[np.searchsorted(keys, known)] = whole[k][1]
                levels[-1]["suffix"] = inverse
            levels.append({"keys": keys, "n": n})
        symbols = np.flatnonzero(root)
        of_root = np.zeros(256, np.int64)
        of_root[symbols] = np.arange(len(symbols))
        levels[-1]["suffix"] = of_root[(levels[-1]["keys"] & wide(255)).astype(np.int64)]
        levels.append({"keys": symbols.astype(wide), "n": root[symbols].astype(np.float64)})
        for level in levels:
            level["contexts"], level["owner"] = np.unique(level["keys"] >> wide(8), return_inverse=True)
            level["total"] = np.bincount(level["owner"], level["n"], len(level["contexts"]))
            level["distinct"] = np.bincount(level["owner"], minlength=len(level["contexts"])).astype(np.float64)
        self.pairs, self.contexts, self.plain, self.log_n, self.escape, self.left, self.left_escape = [], [], [], [], [], [], []
        with np.errstate(divide="ignore", invalid="ignore"):
            for level, lower in zip(levels, [*levels[1:], None]):
                size = level["total"] + level["distinct"]
                self.pairs.append(Table(level["keys"]))
                self.contexts.append(Table(level["contexts"]))
                self.plain.append(np.log10(level["n"] / size[level["owner"]]))
                self.log_n.append(np.log10(level["n"]))
                self.escape.append(np.log10(level["distinct"] / size))
                if lower is not None:  # what is left of the next shorter context without this one's symbols
                    seen = np.bincount(level["owner"], lower["n"][level["suffix"]], len(level["contexts"]))
                    up = np.zeros(len(level["contexts"]), np.int64)
                    up[level["owner"]] = lower["owner"][level["suffix"]]
                    new = lower["distinct"][up] - level["distinct"]
                    size = lower["total"][up] - seen + new
                    self.left.append(np.log10(size))
                    self.left_escape.append(np.where(new > 0, np.log10(new / size), 0.0))
        rest = SYMBOLS - len(symbols)
        self.uniform = -np.log10(rest) if rest > 0 else 0.0

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of every symbol."""
        out = np.zeros(len(keys))
        pair = self.pairs[0].find(keys)
        hit = pair >= 0
        out[hit] = self.plain[0][pair[hit]]
        left = np.flatnonzero(~hit)
        keys = keys[left]
        before = np.full(len(left), -1, np.int64)  # the context escaped from
        for depth in range(self.order + 1):
            if not len(left):
                return out
            length = self.order - depth
            wide, bits = self.wide, 8 * length
            pair = self.pairs[depth].find(keys & wide((1 << bits + 8) - 1)) if depth else np.full(len(left), -1)
            context = self.contexts[depth].find((keys >> wide(8)) & wide((1 << bits) - 1))
            after = before >= 0
            hit = pair >= 0
            first, then = hit & ~after, hit & after
            out[left[first]] += self.plain[depth][pair[first]]
            out[left[then]] += self.log_n[depth][pair[then]] - self.left[depth - 1][before[then]]
            first, then = ~hit & (context >= 0) & ~after, ~hit & (context >= 0) & after
            out[left[first]] += self.escape[depth][context[first]]
            out[left[then]] += self.left_escape[depth - 1][before[then]]
            before = np.where(context >= 0, context, before)[~hit]
            left, keys = left[~hit], keys[~hit]
        out[left] += self.uniform
        return out


# --- counting ---------------------------------------------------------------


def training(documents: DataFrame, cfg: Config) -> DataFrame:
    return documents.where(crc32_mod("doc_id", cfg.fold_of) != 0).select("text")


def gram_counts(texts: DataFrame, cfg: Config) -> DataFrame:
    """key, n of every context of full length with its symbol; tasks sum first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["key", "n"])

        for batch in batches:
            for _, part in runs([lowered(t) for t in batch.column("text").to_pylist()], cfg.run_bytes):
                own, many = np.unique(grams(part, cfg.order)[0], return_counts=True)
                keys, inverse = np.unique(np.concatenate([keys, own.astype(np.uint64)]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([n, many]), len(keys)).astype(np.int64)
                if len(keys) > cfg.slice_edges:
                    yield rows()
                    keys, n = keys[:0], n[:0]
        if len(keys):
            yield rows()

    return texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def word_counts(texts: DataFrame, cfg: Config) -> DataFrame:
    """word, c of every training token; the empty word is the end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(lowered(text).split())
                found[b""] += 1
                if len(found) > cfg.held_words:
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "n"])
                    found.clear()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass(frozen=True)
class Slices:
    n: int
    root: np.ndarray  # counts of the single symbols
    units: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: sorted contexts, cut or not, and their slices
    whole: Whole  # counts after the contexts that were cut

    def of(self, contexts: np.ndarray) -> np.ndarray:
        """The slice that answers each context: that of its longest known unit."""
        found = np.zeros(len(contexts), np.int32)
        for length, (keys, slices) in sorted(self.units.items()):
            own = contexts.astype(np.uint64) & np.uint64((1 << 8 * length) - 1)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            found = np.where(keys[at] == own, slices[at], found)
        return found


def slices_of(counts: DataFrame, cfg: Config) -> Slices:
    """Deals contexts to slices. Only sizes come to the driver: 65,536 rows for
    the last byte, and as many at most for each context that has to be cut."""
    sizes: dict[int, int] = {}  # pairs by uncut context, with a 1 before it as its length
    cut: list[int] = []
    root, whole, length = np.zeros(256, np.int64), {}, 1
    rows = counts
    while True:
        symbol, context = F.col("key").bitwiseAND(255), F.shiftright("key", 8).bitwiseAND((1 << 8 * length) - 1)
        sums = rows.groupBy(symbol.alias("symbol"), context.alias("context")).agg(F.sum("n").alias("n"), F.count("*").alias("pairs")).toArrow()
        symbols, contexts, n, pairs = (sums[c].to_numpy() for c in ("symbol", "context", "n", "pairs"))
        if length == 1:
            np.add.at(root, symbols, n)
        own, inverse = np.unique(contexts, return_inverse=True)
        totals = np.bincount(inverse, pairs, len(own)).astype(np.int64)
        large = (totals > cfg.slice_edges) & (length < cfg.order)
        over = own[large]
        sizes.update((1 << 8 * length | int(c), int(t)) for c, t in zip(own[~large], totals[~large]))
        if not len(over):
            break
        cut += [1 << 8 * length | int(c) for c in over]
        mine = np.isin(contexts, over)
        keys = (contexts[mine] << 8) | symbols[mine]
        order = np.argsort(keys)
        whole[length] = keys[order].astype(np.uint64), n[mine][order]
        rows = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(int(c),) for c in over], "cut long")), context == F.col("cut"), "left_semi")
        length += 1
    slices, i, held = {}, 0, 0
    for unit, size in sorted(sizes.items()):
        if held and held + size > cfg.slice_edges:
            i, held = i + 1, 0
        slices[unit], held = i, held + size
    slices.update((unit, 0) for unit in cut)  # contexts unknown beyond a cut one: any slice has its whole counts
    units = {}
    for k in range(1, length + 1):
        at = sorted(u for u in slices if u >> 8 * k == 1)
        if at:
            units[k] = np.array([u & (1 << 8 * k) - 1 for u in at], np.uint64), np.array([slices[u] for u in at], np.int32)
    return Slices(i + 1, root, units, whole)


def train(documents: DataFrame, cfg: Config = Config()) -> tuple[str, Slices]:
    """Counts the training texts and has the executors store every slice's pairs
    as Parquet in the shared folder; returns that folder and the slices."""
    counts = materialize(gram_counts(training(documents, cfg), cfg), "ppm-counts")
    slices = slices_of(counts, cfg)
    folder = scratch_path(documents.sparkSession, "ppm")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = slices.of(batch.column("key").to_numpy().astype(np.uint64) >> np.uint64(8))
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column("key"), batch.column("n")], names=["slice", "key", "n"])

    dealt = counts.mapInArrow(deal, "slice int, key long, n long").repartition("slice").sortWithinPartitions("slice", "key")
    dealt.write.partitionBy("slice").parquet(folder)
    return folder, slices


def load(folder: str, i: int, slices: Slices, cfg: Config) -> Trie:
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector, FileSystem

    fs, base = FileSystem.from_uri(folder)
    files = [f.path for f in fs.get_file_info(FileSelector(f"{base}/slice={i}", allow_not_found=True)) if f.path.endswith(".parquet")]
    keys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for path in sorted(files):
        with fs.open_input_file(path) as f:
            stored = pq.ParquetFile(f).read(["key", "n"], use_threads=False)
        keys.append(stored["key"].to_numpy())
        n.append(stored["n"].to_numpy())
    keys, n = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(keys, kind="stable")
    return Trie(keys[order], n[order], slices.root, cfg.order, slices.whole)


def score_texts(texts: list[bytes], trie: Trie, own: tuple[int, Slices] | None, cfg: Config) -> np.ndarray:
    """log10 probability of each text, or the part at the slice's positions."""
    scores = np.zeros(len(texts))
    for first, part in runs(texts, cfg.run_bytes):
        keys, owner = grams(part, cfg.order)
        if own is not None:
            mine = own[1].of(keys >> trie.wide(8)) == own[0]
            keys, owner = keys[mine], owner[mine]
        scores[first : first + len(part)] = np.bincount(owner, trie.score(keys), len(part))
    return scores


# --- scoring ----------------------------------------------------------------

_SCORED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64())]
    + [("log_sum", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))]
)
_SCORED_DDL = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, score double, rare array<binary>, times array<int>"


def frequent_words(counts: DataFrame, total: int, cfg: Config) -> dict[bytes, int]:
    """Words with at least a `frequent`th of all tokens, and the end token."""
    return {bytes(r["word"]): r["c"] for r in counts.where((F.col("c") * cfg.frequent >= total) | (F.length("word") == 0)).collect()}


def score(documents: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark: SparkSession = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = materialize(word_counts(training(documents, cfg), cfg), "ppm-words")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums["n"], sums["v"]
    shared = spark.sparkContext.broadcast({w: (np.log10(c + 0.1), c) for w, c in frequent_words(counts, total, cfg).items()})
    folder, slices = train(documents, cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        trie = load(folder, 0, slices, cfg) if slices.n == 1 else None
        end = known.get(b"", (-1.0, 0))
        row = 0

        def scored(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal row
            texts = [lowered(t) for b in held for t in b.column("text").to_pylist()]
            if trie is not None:
                logs = score_texts(texts, trie, None, cfg)
            else:
                logs = sum(score_texts(texts, load(folder, i, slices, cfg), (i, slices), cfg) for i in range(slices.n))
            at = 0
            for b in held:
                part = b.column("part")[0].as_py() if b.num_rows else 0
                out = []
                for text in texts[at : at + b.num_rows]:
                    found = Counter(text.split())
                    n, seen, log_sum, rare = 1, int(end[1] > 0), float(end[0]), []
                    for w, k in found.items():
                        n += k
                        if (f := known.get(w)) is not None:
                            log_sum += k * f[0]
                            seen += k
                        else:
                            rare.append((w, k))
                    out.append((n, seen, log_sum, [w for w, _ in rare], [k for _, k in rare]))
                columns = list(map(list, zip(*out))) or [[]] * 5
                yield record_batch(
                    {
                        "row": [(part << 33) + row + i for i in range(b.num_rows)], "doc_id": b.column("doc_id"), "held_out": b.column("held_out"),
                        "n_tokens": columns[0], "n_known": columns[1], "log_sum": columns[2], "score": logs[at : at + b.num_rows],
                        "rare": columns[3], "times": columns[4],
                    },
                    _SCORED,
                )
                row += b.num_rows
                at += b.num_rows

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if trie is not None or size >= cfg.held_bytes:
                yield from scored(held)
                held, size = [], 0
        yield from scored(held)

    rows = documents.select("doc_id", (crc32_mod("doc_id", cfg.fold_of) == 0).alias("held_out"), "text", F.spark_partition_id().alias("part"))
    scored = materialize(rows.mapInArrow(run, _SCORED_DDL), "ppm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    others = (
        rare.join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(c + F.lit(0.1))).alias("rare_sum"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    )
    base = F.col("log_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + 0.1 * (distinct + 1)))
    return scored.drop("rare", "times").join(others, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
