"""Token alignment against the two libraries on whole texts and a walk over their tokens."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dubito.llm import alignment
from dubito.llm.queries import BYTES, PIECES, vocabulary


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary(BYTES))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))


def byte_texts(a, b, text):
    """Ids and bytes of both, or None if the bytes aren't those of the text."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    plain = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_a = [bytes(plain[c] for c in a.id_to_token(i)) for i in ids_a]
    of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    return (ids_a, of_a, ids_b, of_b) if b"".join(of_a) == b"".join(of_b) == (" " + text).encode() else None


def walked(a, b, text):
    """(groups, links) by stepping through both token lists."""
    if not text or (found := byte_texts(a, b, text)) is None:
        return None
    ids_a, of_a, ids_b, of_b = found
    i = j = at_a = at_b = 0
    groups, links, ga, gb = [], [], [ids_a[0]], [ids_b[0]]
    while i < len(ids_a):
        links.append((ids_a[i], ids_b[j]))
        end_a, end_b = at_a + len(of_a[i]), at_b + len(of_b[j])
        if end_a == end_b:
            groups.append((ga, gb))
            ga, gb = [], []
        if end_a <= end_b:
            i, at_a = i + 1, end_a
            ga += ids_a[i : i + 1]
        if end_b <= end_a:
            j, at_b = j + 1, end_b
            gb += ids_b[j : j + 1]
    return groups, links


def told(groups):
    return hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()


def brute(both, texts):
    found = [walked(*both, t) for t in texts]
    count = Counter(p for f in found if f for p in f[1])
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = f
        n = [sum(len(g[k]) for g in groups) for k in (0, 1)]
        rows.append((*n, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), told(groups)))
    return rows


def got(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=repr)


ODD = ["<|endoftext|> x", "a<s>b</s><unk>", "<0x41> y", "it's  two   blanks\t\n z", " lead", "trail ", "   ", "\n", "a  b 　c", "mark ▁ x", "▁", "x" * 3000, "日本語 テスト 中文", "é ́x", "👩‍👩‍👧 ok \x00 \x1f y", "don't I'll WE'RE 12345 678"]


def test_edges(spark, edge, edge_rows, both):
    extra = [(100 + i, t) for i, t in enumerate(ODD)]
    df = edge.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).repartition(4)
    every = edge_rows + extra
    want = sorted(((i, *r) for (i, _), r in zip(every, brute(both, [t for _, t in every]), strict=True)), key=repr)
    assert got(alignment.align(df, vocabulary(BYTES), vocabulary(PIECES))) == want


def test_clash_and_chunks(spark, edge, edge_rows, both, monkeypatch):
    """Columns of other names, and many chunks, change nothing."""
    monkeypatch.setattr(alignment, "CHUNK", 64)
    df = alignment.align(edge, vocabulary(BYTES), vocabulary(PIECES))
    assert got(df) == sorted(((i, *r) for (i, _), r in zip(edge_rows, brute(both, [t for _, t in edge_rows]), strict=True)), key=repr)


def test_empty(nothing):
    assert alignment.align(nothing, vocabulary(BYTES), vocabulary(PIECES)).count() == 0


_PARTS = st.sampled_from([" ", "  ", "\n", "\t ", " ", " ", "　", "a", "Hello", "world", "'s", "12", "-", "…", "ß", "日", "▁", "́", "<s>", "<|endoftext|>", "é", "😀", "\u0085", "\x1c", "\x00"])


@settings(max_examples=400, deadline=None)
@given(st.lists(_PARTS | st.text(max_size=3), max_size=24).map("".join))
def test_stretches_are_the_whole_text(both, text):
    """Ids of the stretches, put together, are those of the text at once; where the bytes differ they do in a stretch too."""
    by = _aligner()
    w = alignment._Cut(pa.array([text]))
    pieces = [w.word(i) for i in range(len(w.starts))]
    assert b"".join(pieces) == (" " + text).encode()
    whole = byte_texts(*both, text)
    known = by.aligned(pieces)
    assert bool(known.ok.all()) == (whole is not None)
    if whole is not None:
        a, b = by.codes(pieces)
        assert [i for x in a for i in x] == whole[0] and [i for x in b for i in x] == whole[2]


_HELD = []


def _aligner():
    if not _HELD:
        _HELD.append(alignment.load(vocabulary(BYTES), vocabulary(PIECES)).aligner())
    return _HELD[0]


def test_labels_are_scanned():
    """Groups and links of one stretch, by hand: A ends at 3 and 5, B at 4 and 5."""

    class By:
        import numpy as np

        length_a, length_b = np.array([3, 2]), np.array([4, 1])
        told = [f"{i}{end}".encode() for i in range(2) for end in ",|;"]
        told_length = np.full(6, 2)

    s = alignment.Stretches(alignment.np.array([True]), alignment.np.array([0]), [[0, 1]], [[0, 1]], By)
    assert (s.n_groups[0], s.n_links[0], s.text[0]) == (1, 3, b"0,1|0,1")
    assert [(x >> 32, x & 0xFFFFFFFF) for x in s.links.tolist()] == [(0, 0), (1, 0), (1, 1)]


def test_packed():
    for codes in ([], [0], [0, 0, 3, 300, 300, 70_000, 2**25]):
        x = alignment.np.array(codes, alignment.np.int64)
        assert alignment.unpacked(alignment.packed(x)).tolist() == codes
