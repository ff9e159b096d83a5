"""Token counts, packing and BPE round trips against the tokenizers library itself."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cloudframe.llm import bpe, packing, tokens
from cloudframe.llm.bpe import encode_decode
from cloudframe.llm.packing import pack
from cloudframe.llm.tokens import count_tokens

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def texts():
    rng = random.Random(5)
    parts = [*"ab 's't'll\n\t  é中́١ 　\x1c\x85İΣς²9!#", "<|endoftext|>", "<|startoftext|>", " the", "Apple", "don't", "\r\n"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)]
    return [None, "", " ", "\0x", "x" * 5000, "word another " * 120_000, *out, out[3]]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(None if k == 9 else k, t, k, "clash") for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, length string").repartition(3)


def encoded(path):
    t = tokens.tokenizer(path)
    return {None if k == 9 else k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(texts())}


def test_plain_split_equals_the_library():
    t = tokens.tokenizer(BYTE)
    for c in range(0x250):
        for form in ("a%sb", "a %s b", " %s%s ", "1%s2", "a %s\n%sb", "!%s!"):
            x = form.replace("%s", chr(c))
            assert tokens._SPLIT.findall(x) == [x[s:e] for _, (s, e) in t.pre_tokenizer.pre_tokenize_str(x)]


def test_word_split_equals_the_library():
    t = tokens.tokenizer(WORD)
    for c in range(0x250):
        for form in ("a%sb", "A %s b", " %s%s ", "1%s2", "a'%s"):
            x = form.replace("%s", chr(c))
            ids = [i for found in bpe.words_of(x, WORD) for w in found for i in t.encode(w, add_special_tokens=False).ids]
            assert ids == t.encode(x, add_special_tokens=False).ids, hex(c)


def test_runs_split_once_equal_the_words():
    plain = [form.replace("%s", chr(c)) for c in range(0x180) if c != 0x130 for form in ("a%sb", "A %s b", " %s%s ", "1%s2", "a'%s", "%s")]
    words = bpe._Numbers()
    got = bpe.plain_numbers(plain, words)
    listed = list(words)[1:]
    for x, numbers in zip(plain, got, strict=True):
        assert [listed[k] for k in numbers] == [w for found in bpe.words_of(x, WORD) for w in found], ascii(x)


def test_words_are_encoded_as_one_text():
    t = tokens.tokenizer(WORD)
    words = sorted({w for x in texts() if x for found in bpe.words_of(x, WORD) for w in found})
    _, special = tokens.special_tokens(WORD)
    ids, lengths = bpe.encode_words(words, WORD)
    want = [[special[w[1:]]] if w[1:] in special else t.encode(w, add_special_tokens=False).ids for w in words]
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert any(w[1:] in special for w in words) and not len(bpe.encode_words([], WORD)[0])


def test_words_of_a_block_go_together():
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    batches = [pa.RecordBatch.from_pydict({"block": [k % 3 for k in range(50)] * 2, "number": [k // 3 for k in range(50)] * 2, "word": part}) for part in (words[:100], words[99:199])]
    rows = [r for b in bpe._encode(WORD)(batches) for r in b.to_pylist()]
    assert [(r["block"], r["number"]) for r in rows] == [(0, 68), (1, 68), (2, 64)]  # a row for each word before
    for r in rows:
        numbers, lengths, ids = bpe.unpack_words(r["ids"], r["number"])
        assert numbers.tolist() == sorted(numbers.tolist()) and len(ids) == lengths.sum()
    again = sum((len(tokens.tokenizer(WORD).encode(w, add_special_tokens=False).ids) for b in batches for w in b.column("word").to_pylist()))
    assert sum(int(bpe.unpack_words(r["ids"], r["number"])[1].sum()) for r in rows) == again


def test_gathered_in_sections(monkeypatch):
    values, starts, lengths = np.arange(100), np.array([0, 10, 50, 60]), np.array([10, 40, 0, 3])
    rows = np.array([3, 1, 2, 0, 0, 2, 3])
    want = [v for r in rows for v in range(starts[r], starts[r] + lengths[r])]
    for section in (1, 5, 20, 1000):
        monkeypatch.setattr(bpe, "SECTION", section)
        assert bpe.gather(values, starts, lengths, rows).tolist() == want


def test_counts(table):
    want = {k: len(v) for k, v in encoded(BYTE).items()}
    got = count_tokens(table, BYTE).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    size = {None if k == 9 else k: len((x or "").encode()) for k, x in enumerate(texts())}
    assert {r.doc_id: r.n_bytes for r in got} == size


def test_packing(table):
    rows = pack(table, BYTE, with_ids=True).collect()
    want = {k: [*v, 0] for k, v in encoded(BYTE).items()}
    got, places = {}, {}
    for r in sorted(rows, key=lambda r: r.start):
        assert len(r.ids) == r.length and got.setdefault(r.doc_id, []).extend(r.ids) is None
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(places) == list(range(len(places)))


def test_plan_packs_tightly():
    rng = np.random.default_rng(3)
    h = np.bincount(rng.integers(1, 1025, 300_000), minlength=1025)
    patterns = packing.plan(h, 1024)
    used = np.zeros(1025, np.int64)
    for lengths, times in patterns:
        assert times > 0 and sum(lengths) <= 1024
        for n in lengths:
            used[n] += times
    assert (used == h).all()
    filled = (h * np.arange(1025)).sum()
    assert filled / (1024 * sum(t for _, t in patterns)) > 0.99
    assert packing.plan(np.zeros(1025, int), 1024) == []


def test_round_trip(table):
    t = tokens.tokenizer(WORD)
    rows = encode_decode(table, WORD, with_text=True).collect()
    want = encoded(WORD)
    assert {r.doc_id: r.ids for r in rows} == want
    for r in rows:
        decoded = t.decode(r.ids, skip_special_tokens=False)
        assert r.decoded == decoded and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_word_numbers_beyond_three_bytes():
    for words in (1, 1 << 24, (1 << 24) + 1, 1 << 32):
        numbers = np.array([k for k in (0, 255, 65_536, (1 << 24) - 1, 1 << 24, (1 << 24) + 7, (1 << 32) - 1) if k < words], np.uint32)
        assert (bpe.unpack_numbers(bpe.pack_numbers(numbers, words), words) == numbers).all()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(empty, BYTE).count() == pack(empty, BYTE).count() == encode_decode(empty, WORD).count() == 0
