"""Filter audits, conversation repair and sharding against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cloudframe.llm import audit, queries
from cloudframe.llm.audit import audit_filters
from cloudframe.llm.repair import damage, repair_plan, repaired_turns
from cloudframe.llm.shards import assign_shards, jump_hash, shard_documents, write_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Filter audit


def fails(text):
    words, out = WORD.findall(text), set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    return out


def audited(docs, labels):
    docs = [(i, t or "", p or "") for i, t, p in docs]
    failed = [fails(t) | ({"E"} if any(o is not None and i is not None and o < i and u == t for o, u, _ in docs) else set()) for i, t, _ in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {p for _, _, p in docs}:
        mine = [(i, f) for (i, _, p), f in zip(docs, failed, strict=True) if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                out[part, order, step] = [len(left), len(gone), sum(name in f for _, f in mine) - len(gone), sum(f == {name} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {k: (*row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def texts(seed=5):
    rng = random.Random(seed)
    out = [None, "", " \n", "a", "Ünï code", "A&B"]
    for _ in range(60):
        words = [rng.choice(["the", "The", "x", "LOUD", "ü", f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(1, 130))]
        out.append(rng.choice([" ", "\n", "\x0b\t"]).join(words) + rng.choice(["", "", " 5%", " a|b"]))
    return out + rng.choices(out, k=40) + [out[20]] * 60


def test_audit(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(rng.choice([None, 7, *[1000 - k, k]]), t, rng.choice(["hot", "hot", "b", "", None])) for k, t in enumerate(texts())]
    docs += docs[10:14]  # repeated rows
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in [None, 7, 7, *range(0, 170, 3)]]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = audited(docs, labels)
    for size in (audit.CHAIN_BYTES, 2000):
        monkeypatch.setattr(audit, "CHAIN_BYTES", size)
        assert {tuple(r)[:3]: tuple(r)[3:] for r in audit_filters(frame, marks).collect()} == want


def test_chain_of_one_fingerprint_keeps_texts_apart():
    rows = [((9, (True, i)), (t, (("p", 1),), 0)) for i, t in [(1, b"x"), (2, b"y"), (3, b"x"), (4, b"y"), (5, b"z")]]
    assert [(i, bool(m)) for i, _, m, _ in audit._settle(rows)] == [(1, False), (2, False), (3, True), (4, True), (5, False)]


def test_audit_odd_tables(spark):
    marks = spark.createDataFrame([], "`my.id` string, doc_id string, quality int, toxic int")
    empty = spark.createDataFrame([], "doc_id string, text string, source string")
    assert audit_filters(empty, marks).count() == 0
    odd = spark.createDataFrame([("b", "t", "s", 1, 2), ("a", "t", "s", 1, 2), (None, "t" * 300_000, None, 1, 2)], "`my.id` string, text string, source string, part int, `a.b` int")
    rows = audit_filters(odd, marks, id_col="my.id").where("filter_order = 'EABCD' and step = 1").collect()
    assert {(r.part, r.removed, r.kept) for r in rows} == {("s", 1, 1), ("", 0, 1)}


# Conversations


def fits(roles):
    return re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r in roles)) is not None and all(roles)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        s = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not s else "d" if (role, text) in seen else "t" if s[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edits of a few rows and up to three inserted ones: least (cost, audit) with its lines."""
    best = None
    told = faults(rows)
    choices = [[("D", 2, None)] if f in ("b", "d") and f else [("D", 2, None), ("K", 5 * (f == "t"), (r, t)), ("R", 1 + 5 * (f == "t"), ("user", t)), ("R", 1 + 5 * (f == "t"), ("assistant", t))] for (r, t), f in zip(rows, told, strict=True)]
    slots = len(rows) + 1
    inserts = [c for n in range(4) for places in itertools.combinations_with_replacement(range(slots), n) for c in itertools.product(*[[(p, r) for r in ("user", "assistant")] for p in places])]
    for picked in itertools.product(*choices):
        for extra in inserts:
            cost = sum(c for _, c, _ in picked) + 5 * len(extra)
            if best and cost > best[0]:
                continue
            letters, lines = "", []
            for k in range(slots):
                for p, r in extra:
                    if p == k:
                        letters += "I"
                        lines.append((r, ""))
                if k < len(rows):
                    letters += picked[k][0]
                    if picked[k][2]:
                        lines.append(picked[k][2])
            if fits([r for r, _ in lines]) and (best is None or (cost, letters) < best[:2]):
                best = cost, letters, lines
    return best


def planned(rows):
    """A conversation's row, from (turn, role, text) in order."""
    turns = [t for t, _, _ in rows if t is not None]
    lines = [(r, x) for _, r, x in rows]
    told = Counter(faults(lines))
    cost, letters, fixed = cheapest(lines)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(lines))
    return (gaps, told["b"], told["d"], told["t"], illegal, cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())


def conversations(seed, n):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for k in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            out.append((c if c else None, rng.choice([None, k, k, 2 * k, -k]), role, rng.choice(["Hi.", "Ho?", "so!", "cut", " ", "", None, "é. ", f"w{k}. \n"])))
    return out


def in_order(rows):
    key = lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())
    return sorted(rows, key=key)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair(spark, seed):
    rows = conversations(seed, 60)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    plan = repair_plan(frame)
    got = {r[0]: tuple(r)[1:] for r in plan.collect()}
    by = defaultdict(list)
    for c, *rest in rows:
        by[c].append(tuple(" " if v is None and k else v for k, v in enumerate(rest)))
    assert got == {c: planned(in_order(x)) for c, x in by.items()}
    lines = defaultdict(dict)
    for r in repaired_turns(frame, plan).collect():
        lines[r.conv_id][r.line] = f"{r.role}:{r.text}"
    for c, row in got.items():
        assert hashlib.sha256("\n".join(lines[c][k] for k in range(len(lines[c]))).encode()).hexdigest() == row[-1], c


def test_damaged_query(spark, tmp_path):
    rows = conversations(9, 70)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    by = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        by[c] += [] if code == 0 else [(turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)] * (2 if code == 3 else 1)
    got = {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: planned(in_order(x)) for c, x in by.items()}
    assert damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() >= len(rows)


def test_long_conversation_and_odd_tables(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(30_000)]
    turns[777] = (1, 777, "tool", "x" * 200_000 + ".")
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    row = repair_plan(frame).first()
    assert (row.cost, row.audit) == (1, "K" * 777 + "R" + "K" * 29_222)
    text = "\n".join(f"{'assistant' if k == 777 else r}:{t}" for _, k, r, t in turns)
    assert row.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert repair_plan(frame.limit(0)).count() == 0
    odd = spark.createDataFrame([("c", 1, "user", "a.", 1, 2)], "`c.id` string, turn int, role string, text string, cost int, `again` int")
    assert repair_plan(odd, conv_col="c.id").first()[:8] == ("c", 0, 0, 0, 0, 0, 2, "D")


# Shards


def jump(key, n):
    at, following = -1, 0
    while following < n:
        at = following
        key = (key * 2862933555777941757 + 1) % 2**64
        following = int((at + 1) * (2**31 / ((key >> 33) + 1)))
    return at


def test_jump_hash():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63, 3000)
    for n in (1, 2, 16, 17, 1000):
        assert jump_hash(keys, n).tolist() == [jump(int(k) % 2**64, n) for k in keys]
    assert jump_hash(keys[:0], 4).tolist() == []
    counts = np.bincount(jump_hash(rng.integers(-(2**63), 2**63, 160_000), 16), minlength=16)
    assert counts.min() > 9_500 and counts.max() < 10_500


def test_shards(spark, tmp_path):
    rng = random.Random(2)
    docs = [(k, t) for k, t in enumerate(texts(8))] + [(None, "x")] * 5 + [(3, "y")] * 3 + [(9, "ü" * 100_000)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = shard_documents(frame, 16).collect()
    told = lambda i, t: (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(told(*d) for d in docs)
    assert {r.law for r in rows} == {"key"}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(16))
    shard = {}
    for r in rows:
        assert shard.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
    some = {r.doc_id: (r.shard, r.grown_shard) for r in shard_documents(frame.where("doc_id > 50"), 16).collect()}
    assert some and all(shard[i] == s for i, s in some.items())
    grown = {r.doc_id: r.shard for r in shard_documents(frame, 17).collect()}
    assert grown == {i: g for i, (_, g) in shard.items()}
    assert shard_documents(frame.limit(0), 16).count() == 0
    write_shards(frame, f"{tmp_path}/out", 4, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {(r.doc_id, r.shard) for r in back.select("doc_id", "shard").distinct().collect()} == {(r.doc_id, r.shard) for r in assign_shards(frame, 4).collect()}
    assert back.count() == len(docs)


def test_shards_keep_other_columns_and_groups(spark):
    frame = spark.createDataFrame([(1, "t", 5, "a", 1.0, 2), (2, "t", 6, "b", 2.0, 3)], "doc_id int, text string, shard int, Size string, size_in double, `a.b` int")
    out = assign_shards(frame, 1000, ("text",))
    assert out.columns == ["doc_id", "text", "shard_in", "Size_in_in", "size_in", "a.b", "size", "text_crc32", "law", "shard", "grown_shard"]
    assert len({r.shard for r in out.collect()}) == 1
    assert {r.shard_in for r in out.collect()} == {5, 6}
