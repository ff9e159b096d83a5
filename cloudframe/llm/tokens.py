"""Token counts with a whole-token shortcut, for byte-level BPE files of the tokenizers library.

Most pre-tokens of ordinary text are vocabulary strings that encode, alone, as one token. Which
those are is proved once, before the job, by encoding every vocabulary string; the job looks
pre-tokens up in that table and merges only the rest.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary

# Letters, digits and white space among U+0000 to U+024F, as the tokenizers
# library's byte-level split sees them. Texts with other characters are split by the library.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGITS = "0-9²³¹¼½¾"
BLANKS = "\\x09-\\x0d\\x20\\x85\\xa0"

_PLAIN = re.compile("[\\x00-ɏ]*")
_SPLIT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{BLANKS}{LETTERS}{DIGITS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)
#: Between two words of plain letters a pre-token always ends, so a long text may be cut there.
_CUT = re.compile("[A-Za-z](?= [A-Za-z])")
CUT_CHARS, CACHE_WORDS = 1 << 20, 400_000


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(2)
def special_tokens(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """A pattern of the strings that the library takes out of a text first, and their ids."""
    found = {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}
    pattern = "|".join(map(re.escape, sorted(found, key=len, reverse=True)))
    return (re.compile(f"({pattern})") if found else None), found


@lru_cache(2)
def merger(path: str):
    """A faster merger of the same vocabulary, or None if its merges are not in the order of their ids.

    Where merge k makes the token with the k-th id, byte-pair merging by the rank of the merged
    bytes, as tiktoken does it, gives the ids that the library gives.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, splitter = spec["model"], spec["pre_tokenizer"] or {}
    made = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    bytewise = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
    plain = not any(model.get(k) for k in ("end_of_word_suffix", "continuing_subword_prefix", "dropout", "unk_token", "ignore_merges"))
    if not (bytewise and plain and spec["normalizer"] is None and None not in made and made == sorted(set(made))):
        return None
    chars = byte_chars()
    ranks = {bytes(map(chars.__getitem__, w)): i for w, i in model["vocab"].items() if i not in special_ids(path)}
    return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def special_ids(path: str) -> set[int]:
    return set(special_tokens(path)[1].values())


@lru_cache(1)
def byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def encode_ids(text: str, path: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit numbers, as the library gives them."""
    split, special = special_tokens(path)
    fast = merger(path)
    parts = split.split(text) if split and split.search(text) else [text]
    out = []
    for k, part in enumerate(parts):
        if k % 2:
            out.append([special[part]])
        elif fast and _PLAIN.fullmatch(part):
            out += map(fast.encode_ordinary, slices(part))
        else:
            out.append(tokenizer(path).encode(part, add_special_tokens=False).ids)
    return b"".join(np.array(ids, "<u4").tobytes() for ids in out)


def slices(text: str):
    """Cut a very long text where pre-tokens end, so that memory stays bounded."""
    at = 0
    while len(text) - at > CUT_CHARS and (m := _CUT.search(text, at + CUT_CHARS)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def pretokens(text: str, path: str) -> list[str]:
    """The pre-tokens of a text without special strings, as the library's byte-level rule splits it."""
    if _PLAIN.fullmatch(text):
        return _SPLIT.findall(text)
    return [text[s:e] for _, (s, e) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]


def whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings proved to encode alone as one token, with their ids: a table as large as the vocabulary."""
    t = tokenizer(path)
    ids = sorted(t.get_vocab(with_added_tokens=False).values())
    texts = t.decode_batch([[i] for i in ids], skip_special_tokens=False)
    encoded = t.encode_batch(texts, add_special_tokens=False)
    return {s: i for s, i, e in zip(texts, ids, encoded, strict=True) if e.ids == [i]}


class Encoder:
    """Looks pre-tokens up in the whole-token table; the rest is merged, once while cached."""

    def __init__(self, path: str, whole: dict[str, int], value):
        """``value(ids)``: what to keep of a pre-token's ids; values are added up in a document's order."""
        self.path, self.value = path, value
        self.whole = {w: value([i]) for w, i in whole.items()}
        self.known = dict(self.whole)
        self.split, ids = special_tokens(path)
        self.special = {s: value([i]) for s, i in ids.items()}

    def _learn(self, words: list[str]) -> dict:
        known = self.known
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > len(self.whole) + CACHE_WORDS:
            known = self.known = dict(self.whole)
            new = [w for w in set(words) if w not in known]
        if fast := merger(self.path):
            merge, value = fast._core_bpe.encode_single_piece, self.value
            known.update((w, value(merge(w.encode("utf-8")))) for w in new)
            return known
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            encoded = tokenizer(self.path).encode_batch_fast(part, add_special_tokens=False)
            known.update(zip(part, (self.value(e.ids) for e in encoded), strict=True))
        return known

    def values(self, text: str):
        """The values of the pre-tokens of a text, slice by slice."""
        parts = self.split.split(text) if self.split and self.split.search(text) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield [self.special[part]]
                continue
            for piece in slices(part):
                words = pretokens(piece, self.path)
                yield map(self._learn(words).__getitem__, words)


def _count(path: str, table, keep: int):
    def run(batches):
        encoder = Encoder(path, table.value, len)
        for batch in batches:
            texts = binary(batch.column(keep))
            counts = [sum(map(sum, encoder.values(t.decode("utf-8", "replace")))) for t in texts.to_pylist()]
            columns = [*(batch.column(i) for i in range(keep)), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:keep], "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: ``id_col, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    ``path`` names a byte-level BPE file of the tokenizers library, which has to lie at that place
    on every node; counts are those of the library without added begin or end tokens, truncation
    or padding. Special strings inside a text count as the one token that the library makes them.
    One scan, no shuffle; the whole-token table is broadcast and as large as the vocabulary.

    A null text counts as empty: no bytes, no tokens. Null ids and repeated rows are returned as
    they come; very long texts are encoded in slices; other columns are not read. Empty in, empty
    out.
    """
    table = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    source = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("__text"))
    kind = source.schema[0].dataType.simpleString()
    counted = source.mapInArrow(_count(path, table, 2), f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
