"""BPE encoding and decoding through a table of distinct words.

Words are split in Spark, block by block of the scan; a document becomes the numbers of its words
in its block's list. Each distinct word of the corpus is encoded once, its ids go back to the blocks, are
joined there with the table of pieces, and documents are put together by position.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, save
from .tokens import byte_chars, slices, special_tokens, tokenizer

# Letters and digits of U+0000 to U+017F as in tokens.py, without the one whose
# lower case is longer than one character (U+0130). Other texts are split by the library.
_PLAIN = re.compile("[\\x00-įı-ſ]*")
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼½¾]|[^\\x09-\\x0d\\x20\\x85\\xa0A-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼½¾]+")
_WORD_OR_END = re.compile("\n|" + _WORD.pattern)
_SPACE = re.compile("[\\x09-\\x0d\\x20\\x85\\xa0]+")
#: A block of documents that share a list of words ends after this much text.
BLOCK_CHARS = 24 << 20
#: So much plain text is split at a time, and the ids of about so many words and tokens go to their blocks together.
SPLIT_CHARS, PACK_ROWS = 8 << 20, 1 << 20
SECTION = 1 << 20


def words_of(text: str, path: str):
    """The words of a text after the tokenizer's normalization; special strings stand as ``\\0`` and the string."""
    split, _ = special_tokens(path)
    parts = split.split(text) if split and split.search(text) else [text]
    for k, part in enumerate(parts):
        if k % 2:
            yield ["\0" + part]
            continue
        if _PLAIN.fullmatch(part):
            for piece in slices(part):
                yield _WORD.findall(_SPACE.sub(" ", piece).lower())
        else:
            t = tokenizer(path)
            chars = byte_chars()
            found = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(part))
            yield [bytes(map(chars.__getitem__, w)).decode("utf-8") for w, _ in found]


def pack_numbers(numbers: np.ndarray, words: int) -> bytes:
    """Numbers below ``words``, compressed by byte planes: three of them, or four in a block of over 2^24 words."""
    planes = 3 if words <= 1 << 24 else 4
    return zlib.compress(np.stack([numbers >> 8 * k & 0xFF for k in range(planes)]).astype(np.uint8).tobytes(), 1)


def unpack_numbers(data: bytes, words: int) -> np.ndarray:
    """The numbers of ``pack_numbers``."""
    planes = 3 if words <= 1 << 24 else 4
    found = np.frombuffer(zlib.decompress(data), np.uint8).reshape(planes, -1).astype(np.uint32)
    out = found[0]
    for k in range(1, planes):
        out = out | found[k] << 8 * k
    return out


class _Numbers(dict):
    """Words and their numbers, in the order of first use; a line feed, which no word holds, ends a run and has -1."""

    def __init__(self):
        super().__init__({"\n": -1})

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self) - 1
        return found


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The stretches ``rows`` of ``values``, one after another."""
    n, first = lengths[rows], starts[rows]
    ends = np.cumsum(n)
    out = np.empty(ends[-1] if len(ends) else 0, values.dtype)
    at = done = 0
    while at < len(n):  # in sections, so that the places take little memory
        to = max(at + 1, int(np.searchsorted(ends, done + SECTION, "right")))
        m, end = n[at:to], int(ends[to - 1])
        if to == at + 1:
            out[done:end] = values[first[at] : first[at] + n[at]]
        else:
            out[done:end] = values[np.repeat(first[at:to] - ends[at:to] + m + done, m) + np.arange(end - done)]
        at, done = to, end
    return out


def plain_numbers(texts: list[str], words: _Numbers) -> list[np.ndarray]:
    """The numbers of the words of plain texts; each distinct run between ASCII white space is split once."""
    runs = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    coded = runs.flatten().dictionary_encode()
    lowered = "\n".join(map(str.lower, coded.dictionary.to_pylist()))
    found = np.fromiter(map(words.__getitem__, _WORD_OR_END.findall(lowered)), np.int64)
    ends = np.append(np.flatnonzero(found < 0), len(found))
    starts = np.append(0, ends[:-1] + 1)
    run = coded.indices.to_numpy(zero_copy_only=False)
    numbers = gather(found.astype(np.uint32), starts, ends - starts, run)
    bounds = np.append(0, np.cumsum((ends - starts)[run]))[runs.offsets.to_numpy()]
    return [numbers[s:e] for s, e in pairwise(bounds.tolist())]


class _Block:
    """Documents that share a list of words, as the numbers of their words."""

    def __init__(self, path: str):
        self.path, self.words, self.size = path, _Numbers(), 0
        self.keys: list[pa.Array] = []
        self.codes: list[list] = []
        self.waiting: list[tuple[list, int, str]] = []
        self.chars = 0

    def add(self, text: str) -> None:
        code: list = []
        self.codes.append(code)
        self.size += len(text)
        split, _ = special_tokens(self.path)
        for k, part in enumerate(split.split(text) if split and split.search(text) else [text]):
            if k % 2 or not _PLAIN.fullmatch(part):
                code += [np.array([self.words[w] for w in found], np.uint32) for found in words_of(part, self.path)]
                continue
            for piece in slices(part):
                self.waiting.append((code, len(code), piece))
                code.append(None)
                self.chars += len(piece)
                if self.chars >= SPLIT_CHARS:
                    self.settle()

    def settle(self) -> None:
        if self.waiting:
            for (code, k, _), numbers in zip(self.waiting, plain_numbers([w[2] for w in self.waiting], self.words), strict=True):
                code[k] = numbers
        self.waiting, self.chars = [], 0

    def batches(self, schema: pa.Schema, listed_words: bool, documents: bool):
        self.settle()
        listed = list(self.words)[1:]
        codes = [c[0] if len(c) == 1 else np.concatenate([np.zeros(0, np.uint32), *c]) for c in self.codes]
        name = xxhash.xxh64()
        for i in range(0, len(listed), 4096):
            name.update("\n".join(listed[i : i + 4096]))
        count = np.zeros(len(listed), np.int64)
        for c in codes:
            name.update((4 * len(c)).to_bytes(8, "little") + c.tobytes())
            np.add.at(count, c, 1)
        block = name.intdigest() - (1 << 63)
        order = np.argsort(-count, kind="stable")
        if listed_words:
            for i in range(0, len(listed), 20000):
                part = [listed[k] for k in order[i : i + 20000].tolist()]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.nulls(n, schema.field(1).type), pa.array(np.arange(i, i + n, dtype=np.int32)), pa.array(part, pa.string()).cast(pa.binary())], schema=schema)
        if not documents:
            return
        number = np.empty(len(listed), np.uint32)  # frequent words get small numbers
        number[order] = np.arange(len(listed), dtype=np.uint32)
        packed = [pack_numbers(number[c], len(listed)) for c in codes]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(packed), pa.int64()), pa.concat_arrays(self.keys), pa.nulls(len(packed), pa.int32()), pa.array(packed, pa.binary())], schema=schema)


def _split(path: str, schema: pa.Schema, listed_words: bool, documents: bool):
    """Blocks of documents as the numbers of their words (``block, id, data``), and the blocks' words (``block, number, data``).

    The two may be made by two runs over the same scan. A block's name is a hash of its content, so
    if a run should ever see other rows, assembly stops instead of mixing lists.
    """

    def run(batches):
        block = _Block(path)
        for batch in batches:
            texts = binary(batch.column(1))
            at = 0
            for k, raw in enumerate(texts.to_pylist()):
                block.add(raw.decode("utf-8", "replace"))
                if block.size >= BLOCK_CHARS:
                    block.keys.append(batch.column(0).slice(at, k + 1 - at))
                    yield from block.batches(schema, listed_words, documents)
                    block, at = _Block(path), k + 1
            if at < batch.num_rows:
                block.keys.append(batch.column(0).slice(at))
        if block.codes:
            yield from block.batches(schema, listed_words, documents)

    return run


@lru_cache(2)
def _last_ids(path: str) -> np.ndarray | None:
    """Which ids end a word, for files that mark the end; None for others."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    mark = model.get("end_of_word_suffix")
    if not mark:
        return None
    last = np.zeros(max(model["vocab"].values()) + 1, bool)
    last[[i for w, i in model["vocab"].items() if w.endswith(mark)]] = True
    return last


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words, one after another, and how many each has.

    Where the last id of a word tells that it is the last, many words are encoded as one text; should
    the ends not be as many as the words, they are encoded one by one.
    """
    special, last = special_tokens(path)[1], _last_ids(path)
    named = [w[0] == "\0" and w[1:] in special for w in words]
    todo = [w for w, s in zip(words, named, strict=True) if not s] if any(named) else words
    ids, lengths = [], []
    for i in range(0, len(todo), 1024):
        part = todo[i : i + 1024]
        if last is not None:
            found = np.array(tokenizer(path).encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(last[np.minimum(found, len(last) - 1)])
            if len(ends) == len(part) and ends[-1] == len(found) - 1:
                ids.append(found)
                lengths.append(np.diff(ends, prepend=-1))
                continue
        each = [e.ids for e in tokenizer(path).encode_batch_fast(part, add_special_tokens=False)]
        ids.append(np.array([x for e in each for x in e], np.uint32))
        lengths.append(np.array(list(map(len, each)), np.int64))
    flat, n = np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *lengths])
    if todo is words:
        return flat, n
    at = np.zeros(len(words), np.int64)  # special strings among the others
    at[~np.array(named)] = np.arange(len(todo))
    at[named] = len(todo) + np.arange(sum(named))
    flat = np.append(flat, np.array([special[w[1:]] for w, s in zip(words, named, strict=True) if s], np.uint32))
    n = np.append(n, np.ones(sum(named), np.int64))
    return gather(flat, np.cumsum(n) - n, n, at), n[at]


def pack_words(numbers: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Some words of a block: their numbers in rising order, how many ids each has, and the ids; by byte planes."""
    rising = np.diff(numbers, prepend=0)
    return b"".join(np.ascontiguousarray(v, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for v in (rising, lengths, ids))


def unpack_words(data: bytes, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, lengths and ids of ``pack_words`` of so many words."""

    def planes(raw: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()

    raw = np.frombuffer(data, np.uint8)
    return np.cumsum(planes(raw[: 4 * words]), dtype=np.int64), planes(raw[4 * words : 8 * words]).astype(np.int64), planes(raw[8 * words :])


def _encode(path: str):
    """Ids of sorted words, each distinct word being encoded once; those of a block go together, a row for each ``PACK_ROWS`` words read."""

    def packed(waiting):
        block, number, ids, lengths = (np.concatenate(c) for c in zip(*waiting, strict=True))
        starts = np.cumsum(lengths) - lengths
        order = np.lexsort((number, block))
        cuts = np.flatnonzero(np.diff(block[order], prepend=block[order[0]] - 1))
        rows = [order[s:e] for s, e in pairwise([*cuts.tolist(), len(order)])]
        codes = [pack_words(number[r], lengths[r], gather(ids, starts, lengths, r)) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(block[order[cuts]]), pa.array([len(r) for r in rows], pa.int32()), pa.array(codes, pa.binary())], names=["block", "number", "ids"])

    def run(batches):
        last, last_ids = None, np.zeros(0, np.uint32)
        waiting, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            again = words[0] == last
            ids, lengths = encode_words(words[again:], path)
            if again:
                ids, lengths = np.append(last_ids, ids), np.append(len(last_ids), lengths)
            last, last_ids = words[-1], ids[len(ids) - lengths[-1] :]
            which = coded.indices.to_numpy(zero_copy_only=False)
            block, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "number"))
            waiting.append((block, number, gather(ids, np.cumsum(lengths) - lengths, lengths, which), lengths[which]))
            size += batch.num_rows + len(waiting[-1][2])
            if size >= PACK_ROWS:
                yield packed(waiting)
                waiting, size = [], 0
        if waiting:
            yield packed(waiting)

    return run


def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of all ids, each after a space: bytes, where each starts, and how many it has."""
    known = {i: b" " + w.encode("utf-8") for w, i in tokenizer(path).get_vocab(with_added_tokens=True).items()}
    pieces = [known.get(i, b"") for i in range(max(known) + 1)]
    lengths = np.array(list(map(len, pieces)))
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths, lengths


def _list_of(block: int, packed: list[tuple[bytes, int]], table) -> tuple:
    """A block's words by number: ids with starts and lengths, and pieces with starts and lengths."""
    numbers, lengths, ids = (np.concatenate(c) for c in zip(*(unpack_words(*p) for p in packed), strict=True)) if packed else (np.zeros(0, np.int64),) * 3
    found, first = np.unique(numbers, return_index=True)  # another block of the same content has the same words
    if not np.array_equal(found, np.arange(len(found))):
        raise RuntimeError(f"word {np.flatnonzero(found != np.arange(len(found)))[0]} of block {block} is missing")
    ids = gather(ids, np.cumsum(lengths) - lengths, lengths, first)
    lengths = lengths[first]
    starts = np.cumsum(lengths) - lengths
    bytes_of = np.append(0, np.cumsum(table[2][ids]))
    piece_starts, piece_ends = bytes_of[starts], bytes_of[starts + lengths]
    return (ids, starts, lengths), (gather(*table, ids), piece_starts, piece_ends - piece_starts)


def _assemble(schema: pa.Schema, table, with_text: bool):
    """Put documents together; ``table``: the broadcast ``vocabulary``, joined to each word's ids."""

    def run(batches):
        block, packed, lists = None, [], None
        for batch in batches:
            blocks, number, given = (batch.column(c).to_pylist() for c in ("block", "number", "codes"))
            out: list[list] = [[] for _ in range(3 + 2 * with_text)]
            rows = []
            for k, b in enumerate(blocks):
                if b != block:
                    block, packed, lists = b, [], None
                if number[k] is not None:
                    packed.append((given[k], number[k]))
                    continue
                if lists is None:
                    lists, packed = _list_of(b, packed, table.value), []
                n = unpack_numbers(given[k], len(lists[0][1]))
                tokens, hashes, texts = 0, (sha256(), sha256()), ([], [])
                for i in range(0, len(n), 1 << 18):
                    found, decoded = (gather(*x, n[i : i + (1 << 18)]) for x in lists)
                    if not tokens:
                        decoded = decoded[1:]  # no space before the first piece
                    tokens += len(found)
                    for value, digest, text in zip((found.astype("<u4", copy=False), decoded), hashes, texts, strict=True):
                        digest.update(value)
                        if with_text:
                            text.append(value.tobytes())
                rows.append(k)
                values = [tokens, *(h.hexdigest() for h in hashes)]
                if with_text:
                    values += [np.frombuffer(b"".join(texts[0]), "<u4").astype(np.int32), b"".join(texts[1]).decode("utf-8", "replace")]
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            if rows:
                keys = batch.column(1).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(v, schema.field(i + 1).type) for i, v in enumerate(out))], schema=schema)

    return run


def encode_decode(docs: DataFrame, path: str, with_text: bool = False, stable_scan: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text with the tokenizers file at ``path`` and decode the ids again.

    Returns ``id_col, n_tokens, ids_sha256`` (of the ids as little-endian unsigned 32-bit numbers)
    and ``decoded_sha256``; with ``with_text`` also ``ids`` and ``decoded``. Ids are those of the
    library without added special tokens; special strings inside a text become their ids. Decoding
    joins the pieces of the ids with spaces, as the library does for a file without decoder.

    Blocks of rows (bounded by ``BLOCK_CHARS`` or one document) move as compressed word numbers and
    word lists; texts are not shuffled. The lists are sorted by word over the cluster, each distinct
    word is encoded once, and ids return to the blocks, many words a row. A word that occurs
    everywhere is one row a block. Only the vocabulary (id to piece) is broadcast. Blocks are written once to the shared
    folder; with ``stable_scan`` (for tables read straight from files, whose tasks see the same rows
    each time) they are made twice instead, which costs CPU and saves disk.

    A null or empty text has no tokens. Null ids and repeated rows are returned as they come; other
    columns are not read. Empty in, empty out.
    """
    spark = docs.sparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    arrow, ddl = to_arrow_type(kind), kind.simpleString()
    schema = pa.schema([("block", pa.int64()), (id_col, arrow), ("number", pa.int32()), ("data", pa.binary())])
    source, fields = docs.select(id_col, text_col), f"block long, `{id_col}` {ddl}, number int, data binary"
    if stable_scan:
        words = source.mapInArrow(_split(path, schema, True, False), fields)
        coded = source.mapInArrow(_split(path, schema, False, True), fields)
    else:
        split = save(source.mapInArrow(_split(path, schema, True, True), fields), "blocks")
        words, coded = split.where("number is not null"), split.where("number is null")
    words = words.select("block", "number", F.col("data").cast("string").alias("word"))
    table = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encode(path), "block long, number int, ids binary")
    both = table.select("block", F.lit(None).cast(ddl).alias(id_col), "number", F.col("ids").alias("codes")).unionByName(
        coded.select("block", id_col, "number", F.col("data").alias("codes"))
    )
    pieces = spark.sparkContext.broadcast(vocabulary(path))
    ordered = both.repartition("block").sortWithinPartitions("block", F.col("number").asc_nulls_last())
    out = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_text
    types = f"`{id_col}` {ddl}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_text
    return ordered.mapInArrow(_assemble(pa.schema([(id_col, arrow), *out]), pieces, with_text), types)
