"""op12 against links counted token by token, with ids of the two libraries themselves."""

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from quarrylens.llm import op12_alignment as op12

TEXTS = [None, "", " ", "a", "a  b", " a", "a ", "  ", "a   ", "one two\nthree\t four", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "ﬁ ½ é é naïve", "x\x00y​", "日本語 テキスト 🙂🙂", "ab" * 400, "word " * 300, "1234567 89", "a\r\n\r\n b", " 　\xa0 c"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_decoder():
    """Characters of byte-level vocabularies, by their rule: printable bytes stand for themselves, the others follow 255 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def by_hand(rows, libraries):
    a_lib, b_lib = libraries
    char = byte_decoder()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            a = [(i, bytes(char[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()) for i in b_lib.encode(text)]
            want = (" " + text).encode()
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a = b = []
        ends = [list(np.cumsum([len(x) for _, x in side])) for side in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [[[t[0] for t, e in zip(side, end, strict=True) if low < e <= high] for side, end in ((a, ends[0]), (b, ends[1]))] for low, high in zip([0, *cuts], cuts, strict=False)]
        links = [(x[0], y[0]) for x, e in zip(a, ends[0], strict=True) for y, f in zip(b, ends[1], strict=True) if e - len(x[1]) < f and f - len(y[1]) < e]
        counts.update(links)
        text_of = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        docs.append((doc_id, len(a), len(b), len(groups), links, sha256(text_of.encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(i, na, nb, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), h) for i, na, nb, g, ls, h in docs], counts


def check(spark, rows, libraries, **options):
    df = spark.createDataFrame([(i, t, 1, "clash", b"x") for i, t in rows], "doc_id long, text string, slice int, docs string, keys binary").repartition(3)
    got, pairs = op12.align(df, **options)
    want, counts = by_hand(rows, libraries)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {(r.a_id, r.b_id): r.n for r in pairs.collect()} == counts


def test_odd_texts(spark, libraries):
    rows = [*enumerate(TEXTS), (None, "a null id"), (3, "a repeated id"), (3, "a repeated id")]
    check(spark, rows, libraries)
    check(spark, rows, libraries, head=3)  # most pairs come by the shuffled look-up
    check(spark, [], libraries)


def test_documents_of_the_table(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 6000]
    check(spark, rows, libraries, head=200)


def test_pieces_word_by_word_equal_whole_texts(libraries):
    pieces = op12.Pieces(public_tokenizers.path("piece_bpe_32k.model"), limit=50)
    assert pieces.by_word
    texts = [t for t in TEXTS if t] + ["long " * 5000, "   lead", "mid   dle", "▁▁ x ▁"]
    ids, offs = pieces.encode(texts)
    assert [ids[s:e].tolist() for s, e in zip(offs[:-1], offs[1:], strict=True)] == libraries[1].encode(texts)
    assert all(" ".join(op12.split(t)) == t for t in texts)
