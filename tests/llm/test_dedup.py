"""Deduplication operators against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import xxhash

from cloudframe.llm import common, fmindex, simhash
from cloudframe.llm.common import components
from cloudframe.llm.exact import exact_dedup
from cloudframe.llm.fmindex import substring_dedup
from cloudframe.llm.simhash import simhash_dedup


def groups(nodes, links):
    """Smallest node reachable from each."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ünï", "THE", "the"]
    text = lambda n: rng.choice([" ", "\n", "\t "]).join(rng.choice(vocabulary) for _ in range(n))
    passage, line = text(80), text(36)
    out = [None, "", " \n", "a", "a b", "A  B", passage, passage, line * 1, "loop " * 300, "loop " * 300]
    for _ in range(40):
        out.append(text(rng.randrange(1, 120)))
    for _ in range(30):
        out.append(f"{text(rng.randrange(50))} {passage} {text(rng.randrange(50))}")
    for _ in range(30):
        words = out[-1].split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return out + [text(3000) + " " + line, line.replace(" ", "\x0b"), *rng.sample(out, 10)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "src0", f"x{k}", k) for k, t in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, component_id long").repartition(5)


def windows(texts, size=35):
    count = Counter()
    for words in texts:
        count.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return count


@pytest.mark.parametrize("hot", [10_000, 3])
def test_substrings(docs, hot):
    words = {k: (t or "").encode().split() for k, t in enumerate(corpus())}
    count = windows(words.values())
    got = {r.doc_id: r for r in substring_dedup(docs, hot_segments=hot).collect()}
    assert len(got) == len(words)
    for k, w in words.items():
        gone = {i + j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(35)}
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[k].n_words, got[k].n_removed, got[k].kept) == (len(w), len(gone), hashlib.sha256(left).hexdigest()), k


def test_substrings_null_and_repeated_rows(spark):
    body = " ".join(f"t{k}" for k in range(50))
    rows = [(None, body), (7, "x " + body), (7, "x " + body), (8, None), (9, "short")]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in got) == [(0, 50, 50, ""), (7, 51, 51, ""), (7, 51, 51, ""), (8, 0, 0, ""), (9, 1, 0, "short")]


def test_repeated_rows_share_units_and_hits(spark, monkeypatch):
    rng = random.Random(12)
    body = " ".join(f"t{rng.randrange(10_000)}" for _ in range(400))
    rows = [(None, body)] * 60 + [(7, body)] * 60 + [(8, "x " + body)]
    kept, real = {}, fmindex.save

    def recorded(df, label):
        kept[label] = real(df.coalesce(1) if label == "units" else df, label)
        return kept[label]

    def count_hits(window, keep, with_text, schema):
        def run(batches):
            for batch in batches:
                n = [len(x or []) for x in batch.column(keep + 1).to_pylist()]
                columns = [*(batch.column(i) for i in range(keep)), pa.array(n, pa.int64()), pa.array(n, pa.int64()), pa.array([""] * len(n))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:keep], "n_words", "n_removed", "kept"])

        return run

    monkeypatch.setattr(fmindex, "save", recorded)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup(docs, with_text=True).collect()
    assert len(got) == 121 and all(r.n_removed == 400 and r.kept == ("x" if r.doc_id == 8 else "") for r in got)
    assert kept["units"].count() == kept["units"].dropDuplicates(["m", "sh", "off"]).count()
    monkeypatch.setattr(fmindex, "_remove", count_hits)
    segments = kept["segments"].dropDuplicates(["k1", "k2", "start"]).groupBy("k1", "k2").count()
    assert max(r.n_words for r in substring_dedup(docs).collect()) <= segments.agg({"count": "max"}).first()[0]


def test_exact(docs):
    texts = {k: t or "" for k, t in enumerate(corpus())}
    same = defaultdict(list)
    for k, t in texts.items():
        same[t].append(k)
    for r in exact_dedup(docs).collect():
        group = same[texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), r.doc_id == max(group))
        assert r.source == "src0"


def test_exact_null_ids(spark):
    rows = [(None, "a"), (None, "a"), (1, "b"), (None, "b"), (3, None), (4, "")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got))
    assert found == [(0, 0, 2, True), (0, 0, 2, True), (0, 1, 2, False), (1, 1, 2, True), (3, 4, 2, False), (4, 4, 2, True)]


def brute_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs):
    fps = {k: brute_fingerprint(t or "") for k, t in enumerate(corpus())}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = groups(fps, links)
    got = simhash_dedup(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{f:016x}" for k, f in fps.items()}


def test_every_pair_within_two_bits_shares_an_anchor():
    rng = random.Random(2)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(3)):
            y ^= 1 << b
        home, _ = simhash.anchors(x, 2)
        _, guests = simhash.anchors(y, 2)
        assert home in set(guests.tolist())


def test_fingerprint_chain_forms_one_component(spark):
    fps = [0, 3, 15, 63, 1 << 63, (1 << 63) | 1 << 40, 0xF0F0F0F0F0]
    rng = random.Random(9)
    fps += [rng.getrandbits(64) for _ in range(50)]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {(min(r), max(r)) for r in simhash.near_links(spark.createDataFrame(signed, "fp long"), 2).collect()}
    s = [f[0] for f in signed]
    assert got == {(min(a, b), max(a, b)) for i, a in enumerate(s) for b in s[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def unnamed_joins(df):
    """The joins of a plan whose strategy is left to Spark's guess of sizes."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"\bJoin [A-Z]", line) and "strategy=" not in line]


def saved_plans(monkeypatch, *modules):
    """What ``save`` of the modules is given from now on."""
    plans = []
    for module in modules:
        monkeypatch.setattr(module, "save", lambda df, *label, put=module.save: put((plans.append(df), df)[1], *label))
    return plans


def test_replicas_are_never_broadcast(spark, monkeypatch):
    """Spark takes the 61-fold replicas of fingerprints for as few as these, and saved tables for as small as their files."""
    fps = spark.createDataFrame([(k * 0x9E3779B97F4A7C15 % (1 << 62),) for k in range(50)], "fp long")
    plan = simhash.near_links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    plans = saved_plans(monkeypatch, common, simhash)
    docs = spark.createDataFrame([(k, f"some words of text {k // 2}") for k in range(40)], "doc_id long, text string")
    plans.append(simhash_dedup(docs))
    assert len(plans) > 4 and not [j for p in plans for j in unnamed_joins(p)]


def test_components_of_more_links_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_LINKS", 0)
    plans = saved_plans(monkeypatch, common)
    edges = [(k, k + 1) for k in range(30)] + [(k, 100) for k in range(101, 140)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {k: 0 if k <= 30 else 100 for k in [*range(31), *range(100, 140)]}
    assert not any("strategy=broadcast" in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(600), rng.randrange(600)) for _ in range(350)] + [(k, k + 1) for k in range(1000, 1300)] + [(5, None), (2000, 2000)]
    want = groups(range(1301), [e for e in edges if e[1] is not None and e[0] < 1301])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    linked = {n for a, b in edges if b is not None and a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(empty).count() == exact_dedup(empty).count() == simhash_dedup(empty).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("share", [1, 5, 1000])
def test_spread_join_is_a_join(spark, monkeypatch, how, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rng = random.Random(share)
    keys = [rng.choice([1, 1, 1, 2, 3, *range(10, 40), None]) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key long")
    groups = spark.createDataFrame([(k, keys.count(k), f"v{k}") for k in {*keys, 77} - {None} if k % 2], "key long, n long, value string")
    got = sorted(map(tuple, common.spread_join(rows, groups, ["key"], ["id"], how=how).collect()))
    want = [(i, k, f"v{k}" if k is not None and k % 2 else None) for i, k in enumerate(keys)]
    assert got == [r for r in want if how == "left" or r[2]]


def test_inner_spread_join_filters_hot_keys(spark, monkeypatch):
    """Rows of other keys pass a filter, not an anti join; without a hot key one join is left; number types may differ."""
    rows = spark.createDataFrame([(k, k % 40) for k in range(200)] + [(k, 7) for k in range(200, 230)] + [(999, 1 << 40)], "id long, key long")
    groups = spark.createDataFrame([(7, 35, "hot"), (8, 5, "cold"), (9, 5, "cold"), (77, 1, "none")], "key int, n long, value string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for share, joins in ((4, 2), (1, 1)):  # 46 rows in all: keys of 11 or more are hot, then those of 46 or more
        monkeypatch.setattr(common, "HOT_SHARE", share)
        found = common.spread_join(rows, groups, ["key"], [], how="inner")
        assert "LeftAnti" not in plan(found) and plan(found).count("Join Inner") == joins
        assert sorted(map(tuple, found.collect())) == sorted((r.id, r.key, "hot" if r.key == 7 else "cold") for r in rows.collect() if r.key in (7, 8, 9))


def test_columns_of_any_name(spark):
    """Names of results, of helpers, with dots and in other cases pass or are replaced as documented."""
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(1, passage, 1, 2, 3, 4, 5, 6), (2, passage, 7, 8, 9, 10, 11, 12), (3, None, 0, 0, 0, 0, 0, 0)]
    names = "doc_id long, text string, kept int, kept_in int, `a.b` int, k1 int, hits int, `__cf_c1` int"
    frame = spark.createDataFrame(rows, names)
    out = exact_dedup(frame)
    assert out.columns == ["doc_id", "text", "kept_in_in", "kept_in", "a.b", "k1", "hits", "__cf_c1", "keep_id", "group_size", "kept"]
    assert sorted(tuple(r)[2:] for r in out.collect()) == [(0,) * 6 + (3, 1, True), (1, 2, 3, 4, 5, 6, 2, 2, False), (7, 8, 9, 10, 11, 12, 2, 2, True)]
    out = substring_dedup(frame)
    assert out.columns == ["doc_id", "kept_in", "a.b", "k1", "hits", "__cf_c1", "n_words", "n_removed", "kept"]
    assert sorted(tuple(r)[:8] for r in out.collect()) == [(1, 2, 3, 4, 5, 6, 50, 50), (2, 8, 9, 10, 11, 12, 50, 50), (3, 0, 0, 0, 0, 0, 0, 0)]
    cased = exact_dedup(frame.toDF("Doc", "Text", "Kept", "KEEP_ID", "x", "y", "z", "w"), "Doc", "Text")
    assert cased.columns[2:4] == ["Kept_in", "KEEP_ID_in"] and cased.count() == 3
