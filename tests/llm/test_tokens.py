"""Token ids against whole-text encoding; packing and token files against plain versions."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from vitrine.llm import packing, token_files
from vitrine.llm.common import fresh_path
from vitrine.llm.tokens import ByteEncoder, Pieces, WordEncoder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PARTS = ["a", "B", "é", "'s", "'S", "'ll", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "1", "23", "!", "<|endoftext|>", "</w>",
         "é", "́", "İ", "Σ", "ß", "ſ", "K", "ﬁ", "漢字", "😀", "\x1c", "\x85", "​", " ", "_", "-", "…", "\x00", "ς", " '"]


def fuzz(n):
    r = random.Random(3)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("encoder", [WordEncoder(WORD), ByteEncoder(BYTE, P.PATTERN)])
def test_pieces_equal_whole_texts(spark, encoder):
    texts = fuzz(8000) + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        assert encoder.encode(t) == encoder.direct(t), repr(t)


def test_cache_forgets_but_stays_right():
    calls = []
    p = Pieces(lambda x: calls.append(x) or x.encode(), room=3)
    for x in "abcdefgabc" * 3:
        assert p[x] == x.encode()
    assert len(p) + len(p.old) <= 6 and len(calls) > 10


def docs(spark):
    r = random.Random(8)
    texts = [(i, " ".join(r.choice(["alpha", "Beta", "12", "été", "x.\ny"]) for _ in range(r.choice([0, 1, 30, 300, 4000])))) for i in range(120)]
    rows = texts + [(5, texts[5][1]), (5, "other"), (None, None), (None, "null id"), (500, None), (501, "")]
    r.shuffle(rows)
    return rows, spark.createDataFrame([(d, t, "q", 1) for d, t in rows], "doc_id bigint, text string, ids string, start int").repartition(4)


def ids(encoder, text, end):
    return np.concatenate([np.frombuffer(encoder.direct(text or ""), encoder.dtype), [end]]).astype("<u4")


def test_packing(spark):
    rows, table = docs(spark)
    encoder = ByteEncoder(BYTE, P.PATTERN)
    for group in (1024, 10):
        got = packing.pack(table, BYTE, P.PATTERN, capacity=256, group=group).collect()
        seqs, pieces = {}, {}
        for x in got:
            assert len(x.ids) == 4 * x.length
            seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
            pieces.setdefault((str(x.doc_id), x.doc_tokens), []).append((x.start, x.length, x.ids))
        for s in seqs.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 256
        total = sum(x.length for x in got)
        assert len(seqs) * 256 - total < 256 * (-(-len(rows) // group) + 8)
        want = {}
        for d, t in rows:
            want.setdefault((str(d), len(ids(encoder, t, 1))), []).append(ids(encoder, t, 1).tobytes())
        assert pieces.keys() == want.keys()
        for key, whole in want.items():
            starts = sorted(pieces[key])
            assert sum(n for _, n, _ in starts) == key[1] * len(whole)
            if len(whole) == 1:
                assert b"".join(x for _, _, x in starts) == whole[0]
    assert packing.pack(table.limit(0), BYTE, P.PATTERN).count() == 0


def test_assign_balances_cost():
    r = random.Random(1)
    lengths = [r.randint(1, 1500) for _ in range(600)]
    out = packing.assign(lengths)
    loads = [sum(packing.cost(n) for _, _, n, _ in s) for s in out]
    assert len(out) == -(-sum(lengths) // 2048) and max(loads) < 1.5 * sum(loads) / len(loads)
    assert packing.assign([]) == []


def test_token_files(spark):
    rows, table = docs(spark)
    encoder = WordEncoder(WORD)
    folder = fresh_path(spark, "test-files")
    parts = token_files.write(table, folder, WORD, 2)
    assert [p["base"] for p in parts] == [sum(p["n_ids"] for p in parts[:i]) for i in range(len(parts))]
    got = sorted(((r.start, r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in token_files.read(spark, folder, parts).collect()))
    assert len(got) == len(rows)
    at, last = 0, -1
    for start, doc_id, n, _ in got:
        assert start == at and (-1 if doc_id is None else doc_id) >= last
        at, last = at + n, -1 if doc_id is None else doc_id
    want = sorted((str(d), len(x := ids(encoder, t, 2)), zlib.crc32(x.tobytes())) for d, t in rows)
    assert sorted((str(d), n, c) for _, d, n, c in got) == want
    assert token_files.write(table.limit(0), fresh_path(spark, "none"), WORD, 2) == []
    assert token_files.read(spark, folder, []).count() == 0


@pytest.mark.parametrize("encoder, file", [(WordEncoder(WORD), WORD), (ByteEncoder(BYTE, P.PATTERN), BYTE)])
def test_added_tokens_as_from_the_library(encoder, file):
    """Ids of the library's plain call, by a tokenizer loaded as it is."""
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(file)
    hard = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y<|endoftext|>", "A <|ENDOFTEXT|>\n <|end oftext|>", "a <|", "é <|endoftext|>\n\n漢"]
    for t in hard + fuzz(3000):
        assert np.frombuffer(encoder.encode(t), encoder.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("encoder", [WordEncoder(WORD), ByteEncoder(BYTE, P.PATTERN)])
def test_every_low_character_in_a_word_and_after_one(encoder):
    """New pieces take short ways by their characters; each equals the whole-text call."""
    for c in map(chr, range(0x590)):
        for t in (c, f"a {c} b", f"a{c}b", f"x A{c}. y", f"x {c}{c}, y\nQ{c}? z"):
            assert encoder.encode(t) == encoder.direct(t), repr(t)


@pytest.mark.parametrize("kind, args", [(WordEncoder, (WORD,)), (ByteEncoder, (BYTE, P.PATTERN))])
def test_words_need_the_model_alone(kind, args):
    """Words, alone or before a sign, are no calls of the whole tokenizer, and few of its model."""
    encoder, seen = kind(*args), []
    text = "the wörd, the wörd. The wörd\nwörd wörd"
    want, word = encoder.direct(text), encoder.word
    encoder.word = encoder.words.encode = lambda w: seen.append(w) or word(w)
    encoder.tokenizer = None
    assert encoder.encode(text) == want and len(seen) <= 8


def test_packing_takes_few_rows_at_once():
    batch = pa.RecordBatch.from_pydict({"x": list(range(1203))})
    parts = list(packing.slices(batch, packing.ROWS))
    assert max(p.num_rows for p in parts) <= 500
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(1203))


@pytest.mark.parametrize("encoder", [WordEncoder(WORD), ByteEncoder(BYTE, P.PATTERN)])
def test_many_texts_are_looked_up_together(encoder, monkeypatch):
    """Each distinct piece of many texts is looked up once, whatever stands between them."""
    from vitrine.llm import tokens
    texts = ["the word the word"] * 50 + [None, "", "a  b", "漢 <|endoftext|> x", "the\n\nword", "x\x00y", "Word, the. word\nthe 12"] + fuzz(400)
    want = [encoder.direct(t or "") for t in texts]
    assert [x.tobytes() for x in encoder.encode_all(texts)] == want
    monkeypatch.setattr(tokens, "GROUP_CHARS", 30)
    assert [x.tobytes() for x in encoder.encode_all(texts)] == want
    assert list(encoder.encode_all([])) == []
    monkeypatch.undo()
    looked = []
    encoder.pieces.encode = lambda p, plain=encoder.pieces.encode: looked.append(p) or plain(p)
    encoder.pieces.clear()
    encoder.pieces.old.clear()
    list(encoder.encode_all(["the word the word"] * 50))
    assert len(looked) <= 3
