"""Near-duplicates by Jaccard similarity against brute force."""

import random

import numpy as np

import corpus_pipeline
from cloudframe.llm import common
from cloudframe.llm import jaccard as jaccard_module
from cloudframe.llm.jaccard import band_keys, jaccard_dedup
from cloudframe.llm.simhash import shingle_hashes

from .test_dedup import groups, saved_plans, unnamed_joins


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def components_of(texts):
    """Smallest id reachable over pairs alike to 0.8 or more, by comparing all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    return groups(sets, [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8])


def changed(words, places):
    out = list(words)
    for n, i in enumerate(places):
        out[i] = f"changed{n}"
    return " ".join(out)


def corpus():
    """Copies with spread changes above and below the threshold, a chain, a template, edge cases."""
    rng = random.Random(7)
    text = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    out = [None, "", " \n", "a", "A", "a b", "one two three four five", "One  two three\nfour five"]
    for size, changes in [(100, 1), (100, 2), (100, 3), (300, 3), (300, 6), (300, 9), (1000, 10), (1000, 20), (1000, 40)]:
        for _ in range(4):
            base = text(size)
            places = [size * (2 * k + 1) // (2 * changes) for k in range(changes)]
            out += [" ".join(base), changed(base, places)]
    words = text(200)
    for step in range(6):  # neighbours are alike, the ends are not
        words = changed(words, [20 * step + 10, 20 * step + 110 if step < 4 else 5]).replace("changed", f"s{step}x").split()
        out.append(" ".join(words))
    body = text(60)
    out += [" ".join(body + text(30)) for _ in range(12)]
    return dict(enumerate(out))


def test_no_join_is_left_to_guessed_sizes(spark, monkeypatch):
    """Exploded fingerprints, texts and saved tables are larger than Spark takes them for: only marks and hot keys are sent."""
    monkeypatch.setattr(jaccard_module, "BLOCK_TEXTS", 4)
    plans = saved_plans(monkeypatch, common, jaccard_module)
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    plans.append(out := jaccard_dedup(docs))
    assert {r.doc_id: r.component_id for r in out.collect()} == components_of(texts)
    assert len(plans) > 20 and not [j for p in plans for j in unnamed_joins(p)]


def test_components(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in jaccard_dedup(docs).collect()} == components_of(texts)


def test_pipeline_stage_links_copies_at_08(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "en") for k, t in texts.items()], "doc_id long, text string, lang string").repartition(3)
    want = {k for k, c in components_of(texts).items() if k == c}
    got = corpus_pipeline.near(spark, docs, "")
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text, r.lang) for r in got.collect()} == {(k, texts[k], "en") for k in want}


def test_rows_without_id_and_repeated_rows(spark):
    base = [f"t{k}" for k in range(100)]
    a, b = " ".join(base), changed(base, [50])
    rows = [(None, a), (None, "other"), (5, b), (5, b), (4, a), (9, "x"), (8, None)]
    got = jaccard_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got)) == [(-1, -1), (-1, 4), (4, 4), (5, 4), (5, 4), (8, 8), (9, 9)]
    assert jaccard_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_of_the_buckets():
    rng = random.Random(3)
    found = total = 0
    for size, changes in [(100, 2), (300, 6), (1000, 20)]:
        for _ in range(200):
            base = [f"v{rng.randrange(100_000)}" for _ in range(size)]
            other = changed(base, [size * (2 * k + 1) // (2 * changes) for k in range(changes)])
            assert jaccard(shingles(" ".join(base)), shingles(other)) >= 0.8
            x, y = (band_keys(shingle_hashes(t.encode(), 5)) for t in (" ".join(base), other))
            found, total = found + bool((x == y).any()), total + 1
    print(f"pairs at 0.81 to 0.83 that share a bucket: {found} of {total}")
    assert found >= 0.995 * total


def test_shared_counts(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(jaccard_module, "COLUMNS", 7)
    left, right = ([np.unique(rng.integers(0, 90, rng.integers(0, 60)).astype(np.uint64)) for _ in range(n)] for n in (9, 6))
    left.append(np.zeros(0, np.uint64))
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in right] for x in left]
    assert jaccard_module.shared_counts(left, right).tolist() == want
    assert jaccard_module.shared_counts(left[-1:], right[:1]).tolist() == [[0]]


def test_a_template_in_blocks(spark, monkeypatch):
    """Texts of one template, alike to less and more than 0.8, in buckets that are cut into blocks."""
    monkeypatch.setattr(jaccard_module, "BLOCK_TEXTS", 5)
    rng = random.Random(11)
    base = [f"v{k}" for k in range(150)]
    texts = {}
    for k in range(90):
        words = list(base)
        for place in rng.sample(range(150), rng.choice([2, 3, 4, 5, 6])):
            words[place] = f"w{k}x{place}"
        texts[k] = " ".join(words)
    want = components_of(texts)
    assert 3 < len(set(want.values())) < 90  # several components, buckets in common
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in jaccard_dedup(docs).collect()} == want
