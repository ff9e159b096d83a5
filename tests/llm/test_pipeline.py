"""All stages of the corpus pipeline, chained, each against brute force on its own input."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from cloudframe.llm import cnn, tokens

from . import test_models
from .test_dedup import windows
from .test_jaccard import changed, components_of

P = pytest.importorskip("public_tokenizers")


def documents():
    """Texts and quality labels: clean and junk, exact copies, near copies, a shared passage, a text that is only the passage."""
    rng = random.Random(6)
    texts, junk, _ = test_models.corpus(140, 5)
    clean = [t for t, y in zip(texts, junk, strict=True) if y]
    long = sorted(clean, key=len)[-12:]
    passage = " ".join(long[0].split()[:60])
    added = [*clean[:6], clean[0]]
    added += [changed(t.split(), [len(t.split()) // 3]) for t in long[:4]]
    added += [changed(t.split(), [n * len(t.split()) // 7 for n in range(7)]) for t in long[4:8]]
    added += [f"{clean[k]} {passage} {clean[k + 1]}" for k in range(10, 16)] + [passage, "", None]
    rows = [(k, t) for k, t in enumerate([*texts, *added])]
    order = rng.sample(range(1000), len(rows))
    return [(order[k], t, "en", f"s{k}", None if t is None else len(t)) for k, t in rows], [(order[k], int(junk[k]), 0) for k in range(110)]


def quality(rows, labels):
    text = {r.doc_id: (r.text or "").encode() for r in rows}
    known = sorted((k, y) for k, y, _ in labels if zlib.crc32(str(k).encode()) % 3 != 1)
    model = cnn.train([text[k] for k, _ in known], np.array([y for _, y in known], np.int64))
    return {r for r in rows if cnn.predict([text[r.doc_id]], model)[0] >= 0.5}


def exact(rows, labels):
    same = defaultdict(list)
    for r in rows:
        same[r.text or ""].append(r)
    return {max(found, key=lambda r: r.doc_id) for found in same.values()}


def near(rows, labels):
    component = components_of({r.doc_id: r.text for r in rows})
    return {r for r in rows if component[r.doc_id] == r.doc_id}


def passages(rows, labels):
    words = {r.doc_id: (r.text or "").split() for r in rows}
    count = windows(words.values())
    out = set()
    for r in rows:
        w = words[r.doc_id]
        gone = {i + j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(35)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r.text or ""
        out.add((r.doc_id, text, r.lang, r.source, len(text)))
    return out


def test_stages(spark, tmp_path, monkeypatch):
    rows, labels = documents()
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}

    def watched(name, stage):
        def call(spark, docs, sf_dir):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen[name] = docs.collect()
            return stage(spark, docs, sf_dir)

        return call

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "passages", "packing"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(n, s)) for n, s in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()

    assert sorted(map(str, seen["quality"])) == sorted(str(r) for r in spark.createDataFrame(rows, kind).collect())
    names = list(seen)
    for brute, before, after in zip((quality, exact, near, passages), names, names[1:], strict=False):
        got = list(map(tuple, seen[after]))
        assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in brute(seen[before], labels)}, before
        if brute is not passages:
            assert len(seen[after]) < len(seen[before]), before  # the decision took effect
    assert {r.text for r in seen["passages"]} != {r.text for r in seen["packing"]}
    assert any(r.text == "" and any(b.doc_id == r.doc_id and b.text for b in seen["passages"]) for r in seen["packing"])

    t = tokens.tokenizer(P.path("byte_bpe_50k.json"))
    want = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in seen["packing"]}
    got, places = defaultdict(list), defaultdict(list)
    for r in sorted(packed, key=lambda r: r.start):
        assert r.start == len(got[r.doc_id]) and r.length == len(r.ids)
        got[r.doc_id] += r.ids
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for found in places.values():
        ends = [0, *(o + n for o, n in sorted(found))]
        assert [o for o, _ in sorted(found)] == ends[:-1] and ends[-1] <= 1024


EXTRA = "fp long, fingerprint string, component_id string, kept string, keep_id int, group_size string, score string, n_words string, n_removed boolean, key string, bands string, h string, n int, `a b` string"


def clashing(rows):
    """Rows ``doc_id, text`` with columns that are named like those of the operators."""
    return [(k, t, "en", f"s{i}", None if t is None else len(t), i, f"f{i}", "c", "k", i, "g", "s", "w", True, "key", None, "h", 5, "x") for i, (k, t) in enumerate(rows)]


@pytest.mark.parametrize("name", ["quality", "exact", "near", "passages", "packing"])
def test_clashing_columns_nulls_and_repeats(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    kind = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    words = [f"t{k}" for k in range(120)]
    a, b = " ".join(words), changed(words, [60])
    long = " ".join(f"u{k % 5000}x{k}" for k in range(60_000))
    rows = clashing([(1, a), (2, a), (2, a), (3, b), (None, "null id"), (None, "null id"), (5, None), (6, ""), (7, long), (8, "tie"), (9, "tie"), (None, "tie")])
    spark.createDataFrame([(k, k % 2, 0) for k in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, kind).repartition(3)
    found = stage(spark, docs, str(tmp_path))
    got = found.collect()
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0
    if name == "packing":
        assert sorted((r.doc_id or 0) for r in got if r.start == 0) == sorted((r[0] or 0) for r in rows)
        return
    assert found.columns == docs.columns == empty.columns
    by_row = {r[5]: r for r in rows}  # fp numbers the rows
    for r in got:
        want = by_row[r.fp]
        assert tuple(r)[5:] == want[5:] and (r.doc_id, r.lang, r.source) == (want[0], *want[2:4])
        assert name == "passages" or (r.text, r.n_chars) == (want[1], want[4])
    left = sorted((r.doc_id or 0, r.text or "") for r in got)
    if name == "exact":
        assert left == sorted([(2, a), (3, b), (0, "null id"), (6, ""), (7, long), (9, "tie")])
    if name == "near":
        assert left == sorted([(1, a), (0, "null id"), (0, "null id"), (5, ""), (7, long), (8, "tie")])
    if name == "passages":
        assert left == sorted([(1, ""), (2, ""), (2, ""), (3, "changed0"), (0, "null id"), (0, "null id"), (5, ""), (6, ""), (7, long), (8, "tie"), (9, "tie"), (0, "tie")])
        assert all(r.n_chars == len(r.text) for r in got)


def test_no_stage_needs_more_than_id_and_text(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "some words"), (2, "some words"), (3, "others")], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, str(tmp_path)).columns == ["doc_id", "text"], name
