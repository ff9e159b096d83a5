"""The classifiers: held-out accuracy, edge cases, and a numerical check of the gradients."""

import random
import zlib

import numpy as np
import pytest

from cloudframe.llm import cnn, queries, toxicity


def gradient_error(name):
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 110, n, dtype=np.uint8)) for n in (3, 300, 70, 900, 0, 257)]
    label, weight = np.array([0, 1, 1, 0, 1, 0], np.float32), np.full(6, 1 / 6, np.float32)
    model = {k: v.astype(np.float64) for k, v in cnn.initial(3).items()}
    grad = cnn._gradients(texts, label, weight, model)

    def loss():
        p = cnn.predict(texts, model)
        return -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum()

    worst = 0.0
    flat, g = model[name].reshape(-1), grad[name].reshape(-1)
    for k in np.argsort(-np.abs(g))[:8]:
        keep, step = flat[k], 1e-6
        flat[k] = keep + step
        up = loss()
        flat[k] = keep - step
        down = loss()
        flat[k] = keep
        worst = max(worst, abs((up - down) / (2 * step) - g[k]) / (abs(g[k]) + 1e-4))
    return worst


@pytest.mark.parametrize("name", ["embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias"])
def test_gradients(name):
    assert gradient_error(name) < 0.02


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = "an be ti or en la mo ri su ka".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    texts, junk, toxic = [], [], []
    for _ in range(n):
        words = [word() for _ in range(rng.randrange(3, 400))]
        bad, foul = rng.random() < 0.3, rng.random() < 0.2
        if bad:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        if foul:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["zorg", "zorg" + word(), "Idiot"]))
        texts.append(" ".join(words))
        junk.append(int(not bad))
        toxic.append(int(foul))
    return texts, np.array(junk), np.array(toxic)


def test_quality_accuracy_and_whole_texts():
    texts, junk, _ = corpus(500, 1)
    raw = [t.encode() for t in texts]
    model = cnn.train(raw[:350], junk[:350], epochs=6)
    p = cnn.predict(raw[350:], model)
    assert ((p >= 0.5) == junk[350:]).mean() > 0.95
    clean = next(t for t, y in zip(raw, junk, strict=True) if y)
    late = (clean + b" ") * (2_000_000 // (len(clean) + 1)) + b"be### ti### or### en### " * 40
    assert cnn.predict([late], model)[0] < cnn.predict([clean], model)[0]  # junk at the very end counts
    one_by_one = np.concatenate([cnn.predict([t], model) for t in raw[:40]])
    assert np.allclose(one_by_one, cnn.predict(raw[:40], model), atol=1e-5)


def test_toxicity_accuracy_and_whole_texts():
    texts, _, toxic = corpus(1500, 3)
    raw = [t.encode() for t in texts]
    model = toxicity.train(raw[:1000], toxic[:1000])
    classifier = toxicity.Classifier(model)
    p = classifier.scores(raw[1000:])
    assert ((p >= 0.5) == toxic[1000:]).mean() > 0.97
    clean = next(t for t, y in zip(raw, toxic, strict=True) if not y)
    long = (clean + b" ") * (3_000_000 // (len(clean) + 1))
    assert classifier.scores([long])[0] < 0.5 <= classifier.scores([b"x", long + b"zorgan. zorg", b""])[1]
    assert np.allclose(np.concatenate([classifier.scores([t]) for t in raw[:60]]), classifier.scores(raw[:60]))


def test_label_model_recovers_planted_voters_without_labels():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.3
    hit, false = np.array([0.7, 0.6, 0.5, 0.8]), np.array([0.1, 0.05, 0.02, 0.15])
    vote = [np.where(y, rng.random(6000) < h, rng.random(6000) < f) for h, f in zip(hit, false, strict=True)]
    noise = rng.random(6000) < 0.25
    model = toxicity.LabelModel(np.stack([vote[0], vote[0], vote[0], *vote[1:], noise], axis=1), 0.3)
    assert np.allclose(model.fires[1][[0, 3, 4, 5]], hit, atol=0.08) and np.allclose(model.fires[0][[0, 3, 4, 5]], false, atol=0.05)
    accuracy = 0.3 * hit / (0.3 * hit + 0.7 * false)
    assert np.allclose(model.accuracy[[0, 3, 4, 5]], accuracy, atol=0.08) and abs(model.accuracy[6] - 0.3) < 0.08
    assert model.weight[:3].max() < 0.4 and model.weight[3:].min() > 0.7  # copies share a weight
    assert model.correlation[0, 1] > 0.9 and model.correlation[0, 3] < 0.2
    votes = np.stack([vote[0], vote[0], vote[0], *vote[1:], noise], axis=1)
    assert ((model.posterior(votes) >= 0.5) == y).mean() > 0.88


def test_label_model_keeps_families_apart():
    rng = np.random.default_rng(4)
    kind = rng.choice(3, 6000, p=[0.88, 0.08, 0.04])  # clean, and two kinds that different voters know
    votes = np.stack([np.where(kind == 1 + k // 4, rng.random(6000) < 0.5, rng.random(6000) < 0.0003) for k in range(8)], axis=1)
    found = toxicity.LabelModel(votes, 0.12).posterior(votes) >= 0.5
    seen = votes.any(axis=1)
    assert len(toxicity.LabelModel(votes, 0.12).mix) == 2
    assert found[(kind > 0) & seen].mean() > 0.9 and found[kind == 0].mean() < 0.02


def test_toxicity_reaches_every_family_when_many_words_vote():
    """Words beyond the first ``VOTERS`` vote together for all families, which must not make one family of them."""
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    names = ["".join(x) for x in sorted({tuple(rng.choice(letters, 3)) for _ in range(800)})]
    rng.shuffle(names)
    words = [names[400:], names[:100], names[100:300]]  # plain, and of two kinds
    kind = rng.choice(3, 3000, p=[0.91, 0.06, 0.03])
    raw = [" ".join([*rng.choice(words[0], 40), *(rng.choice(words[k], 6 * k - 2) if k else ())]).encode() for k in kind]
    found = toxicity.Classifier(toxicity.train(raw[:2000], kind[:2000] > 0)).scores(raw[2000:]) >= 0.5
    assert all(found[kind[2000:] == k].mean() > 0.9 for k in (1, 2)) and found[kind[2000:] == 0].mean() < 0.02


def naive_quality(text, m):
    """One window, filter and chunk at a time."""
    blocks = max(-(-(len(text) + cnn.STRIDE) // cnn.BLOCK), 1)
    data = (bytes(cnn.STRIDE) + text).ljust(blocks * cnn.BLOCK + cnn.STRIDE, b"\0")
    top = []
    for b in range(blocks):
        values = []
        for w in range(b * cnn.BLOCK, (b + 1) * cnn.BLOCK, cnn.STRIDE):
            window = [float(v) for x in data[w : w + cnn.WINDOW] for v in m["embed"][x]]
            values.append([sum(v * float(c) for v, c in zip(window, m["filters"][:, f], strict=True)) for f in range(cnn.FILTERS)])
        top.append([max(v) for v in zip(*values, strict=True)])
    starts = [0]
    while starts[-1] + cnn.CHUNK < blocks:
        starts.append(min(starts[-1] + cnn.HOP, blocks - cnn.CHUNK))
    best = [0.0] * cnn.HIDDEN
    for s in starts:
        pooled = [max(v) for v in zip(*top[s : s + cnn.CHUNK], strict=True)]
        share = min(1.0, (len(text) + cnn.STRIDE - s * cnn.BLOCK) / (cnn.CHUNK * cnn.BLOCK))
        features = [max(0.0, v + float(m["bias"][f])) for f, v in enumerate(pooled)] + [share]
        for h in range(cnn.HIDDEN):
            best[h] = max(best[h], sum(v * float(m["hidden"][k, h]) for k, v in enumerate(features)) + float(m["hidden_bias"][h]))
    z = sum(v * float(m["out"][h]) for h, v in enumerate(best)) + float(m["out_bias"][0])
    return 1 / (1 + np.exp(-z))


def naive_toxicity(text, m):
    """One word at a time, each word and beginning counted once."""
    words, word = [], b""
    low = "".join(c.lower() if c.isascii() or c in "ÄÖÜÉÀÇÑÊÈ" else c for c in text.decode()).encode()
    for x in [*low, 32]:
        if chr(x).isalpha() and x < 128 or x >= 128:
            word += bytes([x])
        elif word:
            words.append(word)
            word = b""
    weight = dict(zip(m["feature"].tolist(), m["weight"].tolist(), strict=True))
    names = set()
    for w in words:
        names.add(int(toxicity.word_features(np.frombuffer(w, np.uint8))[1][-1]))
        for k in toxicity.PREFIXES:
            if len(w) > k:  # the beginning of a word: the same feature as of any word that begins so
                at, found = toxicity.word_features(np.frombuffer(w[:k] + b"q", np.uint8))
                names.add(int(found[[j for j in toxicity.PREFIXES if j < k + 1].index(k)]))
    return 1 / (1 + np.exp(-(sum(weight.get(n, 0.0) for n in names) + m["bias"][0])))


def test_scores_against_naive_loops(spark):
    texts, junk, toxic = corpus(260, 9)
    raw = [t.encode() for t in texts]
    net, linear = cnn.train(raw[:200], junk[:200], epochs=3), toxicity.train(raw[:200], toxic[:200])
    some = [b"", b"a", b"x" * 59, b"x" * 60, b"ab " * 100, "IDIOT! Zürich ÄÖÜ zorg's zorgan".encode(), *(t[:700] for t in raw[200:212])]
    rows = [(k, t.decode()) for k, t in enumerate(some)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in cnn.score_quality(docs, net).collect()}
    assert all(abs(got[k] - naive_quality(t, net)) < 1e-4 for k, t in enumerate(some))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, linear).collect()}
    assert all(abs(got[k] - naive_toxicity(t, linear)) < 1e-9 for k, t in enumerate(some))
    assert len(linear["feature"]) > 3


@pytest.mark.parametrize("name,label,modulus,rest", [("op2_quality", "quality", 3, 1), ("op9_toxicity", "toxic", 5, 0)])
def test_queries_hold_out_and_predict(spark, tmp_path, monkeypatch, name, label, modulus, rest):
    texts, junk, toxic = corpus(150, 8)
    rows = [(None if k == 4 else k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (901, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    marked = [(k, int(q), int(x)) for k, (q, x) in enumerate(zip(junk, toxic, strict=True))]
    spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, real = [], cnn.labelled_sample

    def watched(docs, labels, *rest):
        seen.extend(r.doc_id for r in labels.collect())
        return real(docs, labels, *rest)

    monkeypatch.setattr(cnn, "labelled_sample", watched)
    monkeypatch.setattr(toxicity, "labelled_sample", watched)
    got = queries.queries()[name](spark, str(tmp_path)).collect()
    out = lambda k: k is not None and zlib.crc32(str(k).encode()) % modulus == rest
    assert sorted(seen) == [k for k in range(150) if not out(k)]
    assert len(got) == len(rows)
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * (9000 if k % 7 == 0 else 100)) for k in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, label int")
    texts, _ = cnn.labelled_sample(docs, labels, "label", 60, 30_000)
    assert sum(map(len, texts)) <= 30_000 and max(map(len, texts)) == 9000 and len(texts) > 25


def test_sample_takes_one_row_for_each_label(spark):
    rows = [(1, f"text {k % 50:02}") for k in range(500)] + [(2, None), (2, "b"), (3, None), (4, "unlabelled")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (5, 1)], "doc_id long, label int")
    texts, found = cnn.labelled_sample(docs, labels, "label", 100, 1000)
    assert list(zip(texts, found.tolist(), strict=True)) == [(b"text 00", 1), (b"b", 0), (b"b", 1), (b"", 0)]
    assert len(cnn.labelled_sample(docs, labels.where("doc_id = 1"), "label", 2, 1000)[0]) == 1


@pytest.mark.parametrize("module", [cnn, toxicity])
def test_tables(spark, module):
    texts, junk, toxic = corpus(120, 5)
    rows = [(None if k == 3 else k, t, 0.5, f"s{k}") for k, t in enumerate([*texts, None, "", texts[0], "x" * 300_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, source string").repartition(4)
    labels = spark.createDataFrame([(k, int(y)) for k, y in enumerate(junk)] + [(None, 1), (5, None)], "doc_id long, label int")
    score = cnn.score_quality if module is cnn else toxicity.score_toxicity
    got = score(docs, module.fit(docs, labels, "label")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.source for r in got} == {r[3] for r in rows}
    empty = spark.createDataFrame([], docs.schema)
    assert score(empty, module.fit(empty, labels, "label")).count() == 0
    one = labels.where("label = 1")
    assert all(r.score > 0.5 for r in score(docs, module.fit(docs, one, "label")).collect())


def test_scores_beside_columns_of_any_name(spark):
    model = {"feature": np.zeros(0, np.uint64), "weight": np.zeros(0), "bias": np.array([-6.0])}
    frame = spark.createDataFrame([(1, "some words", 2, 3)], "doc_id long, text string, `a.b` int, Score int")
    out = toxicity.score_toxicity(frame, model)
    assert out.columns == ["doc_id", "text", "a.b", "score"] and out.first()[:3] == (1, "some words", 2)
    fitted = cnn.train([b"good text " * 20, b"#### ####"] * 8, np.array([1, 0] * 8))
    out = cnn.score_quality(frame, fitted)
    assert out.columns == ["doc_id", "text", "a.b", "score"] and 0 <= out.first().score <= 1
