"""Packing: exact round trip, best fit, and the written layout."""

import numpy as np
import pytest

from revlens.llm import packing
from revlens.llm.queries import QUERIES

CFG = packing.Config(seq_len=64, buffer_tokens=2000, block_rows=5)


def plain_best_fit(lengths, capacity):
    rooms, owner = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= lengths[k]]
        if fits:
            b = min(fits, key=lambda x: x[0])[1]
        else:
            rooms.append(capacity)
            b = len(rooms) - 1
        rooms[b] -= lengths[k]
        owner[k] = b
    return len(rooms), sorted(rooms)


def test_segment_tree_is_best_fit():
    rng = np.random.default_rng(3)
    for capacity in (1, 7, 64):
        lengths = rng.integers(1, capacity + 1, 300)
        owner, n = packing.best_fit_decreasing(lengths, capacity)
        loads = np.bincount(owner, lengths, n)
        assert (n, sorted((capacity - loads).astype(int).tolist())) == plain_best_fit(lengths.tolist(), capacity)


def plain_ids(texts):
    import base64

    import tiktoken

    with open(CFG.vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("t", pat_str=packing.PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return [encode(t or "") + [CFG.end_id] for t in texts]


def test_cached_words_give_the_same_ids():
    texts = ["a b", " a b", "a  b", "a \n b", "a\nb c", "x's don't 'll", "é ü z 12 3a !!", "\x1c a", "", " ", "a b ", "　x y", "<|endoftext|> a"]
    tok = packing.Tokenizer(CFG)
    for t, want in zip(texts, plain_ids(texts)):
        assert np.frombuffer(tok(t), "<u2").tolist() == want[:-1], repr(t)


def test_round_trip(spark, documents, corpus):
    blocks = packing.write_packed(documents, CFG)
    found, seqs = {}, 0
    for b in blocks.collect():
        ids = np.frombuffer(b.ids, "<u2").reshape(b.n_seqs, CFG.seq_len)
        want_resets = []
        for r in range(b.n_seqs):
            seqs += 1
            cu = b.cu_seqlens[r]
            assert cu[0] == 0 and cu == sorted(set(cu)) and cu[-1] <= CFG.seq_len
            want_resets += [r * CFG.seq_len + x for x in cu if x < CFG.seq_len]
            assert (ids[r, cu[-1] :] == CFG.pad_id).all()
            for doc, piece, start, low, high in zip(b.doc_ids[r], b.pieces[r], b.starts[r], cu, cu[1:]):
                found.setdefault((doc, piece, start), []).append(ids[r, low:high].tolist())
        assert b.resets == want_resets
    want = {}
    for row, ids in zip(corpus, plain_ids([r[1] for r in corpus])):
        for k, low in enumerate(range(0, len(ids), CFG.seq_len)):
            want.setdefault((row[0], k, low), []).append(ids[low : low + CFG.seq_len])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    rows = packing.sequences(blocks).collect()
    assert len(rows) == seqs and sum(r.n_tokens for r in rows) == sum(len(x) for v in want.values() for x in v)
    assert all(r.resets[0] == 0 and r.cu_seqlens[-1] == r.n_tokens for r in rows)


def test_query_and_edges(spark, sf_dir, no_documents):
    import zlib

    rows = QUERIES["op4_token_packing"](spark, sf_dir).collect()
    assert {63, 65} <= {d for r in rows for d in r.doc_ids}
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    (seq,) = packing.sequences(packing.write_packed(one)).collect()
    ids = plain_ids(["a b c"])[0]
    full = np.full(2048, CFG.pad_id, "<u2")
    full[: len(ids)] = ids
    assert seq.ids_crc32 == zlib.crc32(full.tobytes()) and seq.cu_seqlens == [0, len(ids)] and seq.resets == [0, len(ids)]
    assert packing.write_packed(no_documents).count() == 0
    with pytest.raises(ValueError):
        packing.Tokenizer(packing.Config(end_id=70_000))
