"""Cross-tokenizer alignment against the libraries over whole texts and a loop over bytes, and on the odd cases."""

import bisect
import collections
import hashlib
import random

import numpy as np
import pytest

from ledgerlake.llm import alignment, queries

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    # The byte-level alphabet by its definition: printable bytes stand for themselves.
    values, free = {}, 0
    for b in range(256):
        if chr(b).isprintable() and b not in (32, 160, 173):
            values[chr(b)] = b
        else:
            values[chr(256 + free)] = b
            free += 1
    return a, sentencepiece.SentencePieceProcessor(model_file=B), values


def whole(tools, text):
    """Tokens (id, bytes) of the whole text, both sides; none where bytes differ."""
    a, b, values = tools
    if not text:
        return [], []
    e = a.encode(" " + text, add_special_tokens=False)
    one = [(i, bytes(values[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    said = (" " + text).encode()
    return (one, two) if b"".join(x for _, x in one) == said == b"".join(x for _, x in two) else ([], [])


def brute(tools, docs):
    found, count = [], collections.Counter()
    for doc, text in docs:
        one, two = whole(tools, text)
        spans = []
        for side in (one, two):
            at, own = 0, []
            for i, x in side:
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        owner = {p: k for k, (lo, hi, _) in enumerate(spans[1]) for p in range(lo, hi)}
        links = sorted({(k, owner[p]) for k, (lo, hi, _) in enumerate(spans[0]) for p in range(lo, hi)})
        count.update((spans[0][k][2], spans[1][m][2]) for k, m in links)
        cuts = sorted({hi for _, hi, _ in spans[0]} & {hi for _, hi, _ in spans[1]})
        sides = [[[] for _ in cuts] for _ in spans]
        for side, own in zip(sides, spans, strict=True):
            for _, hi, i in own:
                side[bisect.bisect_left(cuts, hi)].append(str(i))
        groups = ["|".join(map(",".join, g)) for g in zip(*sides, strict=True)]
        found.append((doc, spans, links, groups))
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for doc, spans, links, groups in found:
        pairs = [(spans[0][k][2], spans[1][m][2]) for k, m in links]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, len(spans[0]), len(spans[1]), len(groups), len(links), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), sha))
    return sorted(out, key=str)


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=str)


def odd_texts():
    rng = random.Random(4)
    bits = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "▁", "▁a", "a", "don't", "we'll", "É", "日本", "🙂", "\x00", "�", "9", "123", "!!", "<s>", "<unk>", "<0x41>", "<|endoftext|>", "é", "ß", "x" * 40, "ab" * 9, "\U000e0041", ".", "'s", "İ"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    out += [" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(800)]
    return out + [" ", "   ", "\n", " a", "a ", "  a", "a  b", "a \n b", "a\n b", "\n\n  a\n", "a" * 3000, " " * 500 + "a", "a" + " " * 500]


def test_query(spark, sf, tools):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op13_alignment(spark, sf)) == brute(tools, docs)


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 50, 0])
def test_odd_texts(spark, tools, hot):
    docs = [*enumerate(odd_texts()), (None, None), (5, ""), (7, "twice, twice."), (7, "twice, twice.")]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, n_a int, `pa.irs` string")
    assert got(alignment.digests(df, A, B, hot_pairs=hot)) == brute(tools, docs)


def test_every_character(tools):
    """Units at every character's sides: the tokens are those of the whole text."""
    store = alignment.Store(A, B)
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"b{chr(c)} a {chr(c)}{chr(c)} {chr(c)}\n" for c in points[k : k + 12]) for k in range(0, len(points), 12)]
    for k in range(0, len(texts), 400):
        part = texts[k : k + 400]
        x = alignment.Aligned(store, part)
        a, b = store.sides[0].model, store.sides[1].model
        for n, (t, e, f) in enumerate(zip(part, a.encode_batch([" " + t for t in part], add_special_tokens=False), b.encode(part), strict=True)):
            mine = [x.ids[s][x.first[s][n] : x.first[s][n + 1]].tolist() for s in (0, 1)]
            if mine[0]:
                assert mine == [e.ids, f], t
            else:
                side = store.sides[1]
                assert b"".join(side.bytes[i] for i in f) != (" " + t).encode(), t


def test_real_outputs(spark):
    df = spark.createDataFrame([(1, "Hello tokenizers, naïve façade"), (2, None)], "doc_id long, text string")
    one, two = sorted(alignment.aligned(df, A, B).collect(), key=lambda r: r.row.doc_id)
    assert (two.a_ids, two.b_ids, two.groups, two.links) == ([], [], [], [])
    ends = [list(np.cumsum([len(alignment.Store(A, B).sides[s].bytes[i]) for i in ids])) for s, ids in enumerate((one.a_ids, one.b_ids))]
    assert [(g.a_end, g.b_end) for g in one.groups] == [(ends[0].index(e) + 1, ends[1].index(e) + 1) for e in sorted(set(ends[0]) & set(ends[1]))]
    begins = [[0, *e[:-1]] for e in ends]
    assert [(x.a, x.b) for x in one.links] == [(k, m) for k in range(len(ends[0])) for m in range(len(ends[1])) if begins[0][k] < ends[1][m] and begins[1][m] < ends[0][k]]


def test_long_text_is_many_lanes(spark, tools):
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "naïve", "日本語", "x9", "q" * 30]) for _ in range(30_000))
    df = spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string")
    assert got(alignment.digests(df, A, B)) == brute(tools, [(1, text), (2, "a")])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.digests(df, A, B).count() == 0 and alignment.aligned(df, A, B).count() == 0


def test_store_starts_anew(monkeypatch):
    monkeypatch.setattr(alignment, "STORE_UNITS", 3)
    store = alignment.Store(A, B)
    for text in ("a b c d e f", "f e d", "zz"):
        assert alignment.Aligned(store, [text]).ids[1].tolist() == store.sides[1].model.encode(text)
