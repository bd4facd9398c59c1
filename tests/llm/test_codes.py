"""Encoders against their libraries and by exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from dubito.llm import flac, grammar, pieces
from dubito.llm.queries import PIECES, WORDS, vocabulary

ALPHABET = [*" \n\tabcdefghinorstuéñßＡ日本語の😀▁\x00.,!?0123456789---==\x0b\xa0İÅΣσ'’́̈", "the", "ing", "tion", " the", "  ", "and", "zz", "'s", "'LL", "<|", "▁▁"]
EDGES = ["", " ", "  a  ", None, "a\x00b\r", "\n", "\n a", " \n", "a\n\n  b", "日", " 日", "a" * 300, " " * 37, " " * 15, "\x00", "\x00\x00 a", " ▁", "<0x0A>", "<s> </s>", "﻿abc", "😀😀 x😀"]


def texts(n, seed=5, size=50, extra=()):
    rng = random.Random(seed)
    return ["".join(rng.choice([*ALPHABET, *extra]) for _ in range(rng.randrange(size))) for _ in range(n)] + EDGES


@pytest.fixture(scope="module")
def model():
    return pieces.load(vocabulary(PIECES))


def test_pieces_match_the_library(model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    for batch in (texts(3000), texts(200, 6, 400), []):
        ids, bounds = encoder.encode(pa.array(batch, pa.string()))
        back = decoder.decode(ids, bounds)
        for i, t in enumerate(batch):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t or ""), t
            assert back[i].decode() == (t or "").replace("▁", " ")


def test_drawn_out_words(model, monkeypatch):
    """Words of many characters are relaxed one edge at a time, with the same ids."""
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES)), random.Random(3)
    code = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    batch = ["".join(rng.choice(code) for _ in range(3000)), "the" * 700, "日本語の" * 400 + "😀" * 5, "ab c " + "x" * 2000 + " d", "".join(rng.choice([x for x in ALPHABET if x.strip() == x]) for _ in range(1500))]
    for least in (pieces.DRAWN_OUT, 3):
        monkeypatch.setattr(pieces, "DRAWN_OUT", least)
        ids, bounds = pieces.Encoder(model).encode(pa.array(batch))
        for i, t in enumerate(batch):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t)


def test_few_kept_words(model, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 3)
    monkeypatch.setattr(pieces, "TOGETHER", 2)
    a, b = pieces.Encoder(model), pieces.Encoder(model)
    for t in ("one two three four", "five six", "one seven"):
        assert a.encode(pa.array([t]))[0].tolist() == b.encode(pa.array([t]))[0].tolist()


def test_pieces_edges(spark, edge, edge_rows, nothing):
    got = sorted((r.doc_id, r.text, r.n) for r in pieces.encode_documents(edge, vocabulary(PIECES)).selectExpr("doc_id", "text", "size(ids) n").collect())
    assert [g[:2] for g in got] == sorted((i, (t or "").replace("▁", " ")) for i, t in edge_rows if i is not None)
    d = pieces.encode_digests(edge, vocabulary(PIECES)).collect()
    assert all(r.round_trip for r in d) and sorted((r.doc_id, r.n_tokens) for r in d) == sorted((g[0], g[2]) for g in got)
    assert pieces.encode_digests(nothing, vocabulary(PIECES)).count() == 0


def test_words_match_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(WORDS))
    with open(vocabulary(WORDS), encoding="utf-8") as f:
        encoder = grammar.WordEncoder(f.read())
    for batch in (texts(3000), texts(500, 7, 60, ["<|endoftext|>", "<|startoftext|>"]), []):
        ids, ends = encoder.encode(pa.array(batch, pa.string()))
        begin = 0
        for t, end, want in zip(batch, ends, library.encode_batch([t or "" for t in batch], add_special_tokens=False), strict=True):
            assert ids[begin:end].tolist() == want.ids + [2], t
            begin = end


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.int32), np.array([5]), np.array([5] * 7), np.tile([1, 2], 50), rng.integers(0, 40, 30_000), rng.integers(0, 49_000, 5000), np.repeat(rng.integers(0, 9, 300), 40)):
        ends = np.unique(np.r_[rng.integers(0, len(ids) + 1, 20), len(ids)])
        data = grammar.pack(np.arange(len(ends)), ends, ids.astype(np.int32), 49_408)
        s = grammar.Shard(data)
        assert (s.ids() == ids).all() and len(s.ids()) == len(ids)
        for i in range(len(ends)):
            lo = ends[i - 1] if i else 0
            if ends[i] > lo:
                assert (s.document(i) == ids[lo : ends[i]]).all()
    with pytest.raises(ValueError):
        grammar.Shard(data[:50] + bytes([data[50] ^ 1]) + data[51:])
    assert len(grammar.pack(np.array([1]), np.array([4000]), np.tile([1, 2, 3, 4], 1000), 49_408)) < 2000
    ids = np.r_[np.tile([99_999, 70_000, 5], 900), rng.integers(0, 100_000, 3000)]  # symbols of 32 bits
    data = grammar.pack(np.array([1]), np.array([len(ids)]), ids, 100_000)
    assert (grammar.Shard(data).ids() == ids).all() and len(data) < 4 * 3600


def test_grammar_of_either_end_alike():
    """Frequent pairs in the front of a shard and random ids behind them compress as well as the reverse."""
    rng = np.random.default_rng(8)
    parts = [np.tile([11, 12], 300_000), rng.integers(0, 49_000, 300_000)]
    a, b = (len(grammar.compress(np.concatenate(x), 49_408)[0]) for x in (parts, parts[::-1]))
    assert max(a, b) < 310_000 and abs(a - b) < 100


def test_grammar_files(spark, edge, edge_rows, nothing, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(WORDS))
    want, start = [], 0
    for i, t in sorted((i, t or "") for i, t in edge_rows if i is not None):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for shard in (grammar.SHARD, 100):
        grammar.write_ids(edge, vocabulary(WORDS), f"file://{tmp_path}/{shard}", shard)
        assert sorted(map(tuple, grammar.read_digests(spark, f"file://{tmp_path}/{shard}").collect())) == sorted(want)
        assert sorted((r.doc_id, r.start, len(r.ids)) for r in grammar.read_ids(spark, f"file://{tmp_path}/{shard}").collect()) == sorted(w[:3] for w in want)
    assert grammar.round_trip(nothing, vocabulary(WORDS)).count() == 0


def signals():
    rng = np.random.default_rng(2)
    return [
        flac.payload(b""), flac.payload(b"abc"), rng.integers(0, 256, 9000, dtype=np.uint8), (128 + 100 * np.sin(np.arange(20000) / 9)).astype(np.uint8),
        np.cumsum(rng.integers(-1, 2, 8192)).astype(np.uint8), np.full(5000, 77, np.uint8), (np.arange(70000) // 5).astype(np.uint8), rng.integers(0, 256, 1, dtype=np.uint8),
        rng.integers(100, 104, 4097, dtype=np.uint8), np.r_[np.full(4000, 128, np.uint8), rng.integers(0, 256, 96, dtype=np.uint8)], np.tile(np.array([0] * 63 + [255], np.uint8), 64),
    ]


def test_flac_round_trip():
    p = signals()
    streams = flac.encode(p)
    bare = []
    for s in streams:  # without the seek table
        if s[4] & 0x80:
            bare.append(s)
            continue
        n = int.from_bytes(s[43:46], "big")
        bare.append(s[:4] + bytes([0x80]) + s[5:42] + s[46 + n :])
    for coded in (streams, bare):
        for x, blocks in zip(p, flac.decode(coded), strict=True):
            assert (np.concatenate([b for _, b in blocks]) == x).all() and [at for at, _ in blocks] == list(range(0, len(x), flac.BLOCK))
    assert len(streams[3]) < 0.5 * len(p[3]) and len(streams[5]) < 200
    for at in (0, 20, 43, *range(60, len(streams[3]), 397)):
        bad = bytearray(streams[3])
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    with pytest.raises(ValueError):
        flac.decode([streams[3][:-300]])


def test_flac_partitions_and_escapes():
    """A frame put together by hand: order 1, two partitions, the second of plain 5-bit residuals."""
    x = np.array([10, 12, 11, 13, 13, 14, 3, 5], np.int64)
    r = np.diff(x)
    bits = "0" + f"{8 + 1:06b}" + "0" + f"{x[0] & 255:08b}" + "00" + "0001"
    bits += f"{2:04b}" + "".join("0" * ((u := int(2 * v if v >= 0 else -2 * v - 1)) >> 2) + "1" + f"{u & 3:02b}" for v in r[:3])
    bits += "1111" + f"{5:05b}" + "".join(f"{int(v) & 31:05b}" for v in r[3:])
    bits += "0" * (-len(bits) % 8)
    body = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    head = bytes([0xFF, 0xF8, 0x60, 0x02, 0x00, 7])
    raw = np.frombuffer(head, np.uint8)
    head += bytes([int(flac._crc8(raw, np.array([0]), np.array([6]))[0])])
    frame = np.frombuffer(head + body, np.uint8)
    crc = int(flac._crc16(frame, np.array([0]), np.array([len(frame)]))[0])
    out, end = flac.decode_frames(np.r_[frame, [crc >> 8, crc & 255], np.zeros(16, np.uint8)].astype(np.uint8), np.array([0]))
    assert out[0].tolist() == x.tolist() and end[0] == len(frame) + 2


def test_flac_edges(spark, edge, edge_rows, nothing):
    media = flac.encode_texts(edge)
    got = sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in flac.media_digests(media).collect())
    want = []
    for i, t in edge_rows:
        if i is not None:
            raw = (t or "").encode()
            p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
            want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want)
    blocks = flac.pcm_blocks(media).where("doc_id = 5").orderBy("offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks).rstrip(b"\0") == dict(edge_rows)[5].encode() and [b.offset for b in blocks] == list(range(0, len(blocks) * 4096, 4096))
    assert flac.round_trip(nothing).count() == 0


def test_flac_files(spark, edge, edge_rows, tmp_path):
    """What is stored is what is read: sizes and digests of the streams, blocks by sample offset, equal values for equal texts."""
    flac.store(flac.encode_texts(edge), f"file://{tmp_path}/media")
    media = flac.load(spark, f"file://{tmp_path}/media")
    streams = {}
    for r in media.collect():
        streams.setdefault(r.doc_id, set()).add((len(r.media), hashlib.sha256(bytes(r.media)).hexdigest()))
    rows = flac.round_trip(edge).collect()
    assert all((r.media_bytes, r.media_sha256) in streams[r.doc_id] for r in rows) and len(rows) == media.count()
    by_text = {}
    for r in rows:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature, r.tail_crc32))
        x = np.frombuffer(b"\0" * 64, np.uint8) if not r.n_bytes else None
        assert x is None or r.feature == flac.feature(x)
    assert all(len(v) == 1 for v in by_text.values())
    flac.write_blocks(media, f"file://{tmp_path}/pcm")
    whole = dict(edge_rows)[5].encode()
    for begin, end in ((0, 10), (4090, 4100), (9000, 30000), (len(whole) - 5, len(whole))):
        assert flac.read_samples(spark, f"file://{tmp_path}/pcm", 5, begin, end) == whole[begin:end]


def test_flac_streams_rest_on_their_own_text():
    p = signals()
    alone = [flac.encode([x])[0] for x in p]
    assert flac.encode(p) == alone and flac.encode(p[::-1])[::-1] == alone


def test_feature():
    assert flac.feature(np.array([128, 131, 124, 128], np.uint8)) == f"rms={(25 / 4) ** 0.5:.6f};peak=4;crossings=2"


def test_grammar_counts_pairs_of_the_whole_shard():
    rng = np.random.default_rng(4)
    front = np.tile(np.array([5, 6, 7, 8]), 5000)
    ids = np.concatenate([front, rng.integers(1000, 40_000, grammar.STRETCH + 10)])  # no pair of the front is in the last stretch
    symbols, rules = grammar.compress(ids, 49_152)
    assert [5, 6] in rules.tolist() and len(symbols) <= len(ids) - len(front) + 100
    out = {i: [i] for i in range(49_152)}
    for i, (a, b) in enumerate(rules.tolist()):
        out[49_152 + i] = out[a] + out[b]
    assert [x for y in symbols.tolist() for x in out[y]] == ids.tolist()
