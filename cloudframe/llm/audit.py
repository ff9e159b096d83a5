"""How document filters interact: what each removes, alone and behind others, in every order of applying them."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, marked

FILTERS = "ABCDE"
UPPER, MARKS = bytes(range(65, 91)), b"#$%&*|"
#: Bytes of text whose copies a task looks for before rows move.
CHAIN_BYTES = 32 << 20
REPEATED = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
OUT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def failures(text: str, raw: bytes) -> int:
    """The filters A to D that a text fails, as bits.

    A: under 50 words. B: under 65 different words in 100. C: over 5 capitals A-Z in 100 code
    points. D: holds one of ``#$%&*|``.
    """
    words = raw.split()
    mask = int(len(words) < 50)
    mask |= (100 * len(set(words)) < 65 * len(words)) << 1
    mask |= (100 * (len(raw) - len(raw.translate(None, UPPER))) > 5 * len(text)) << 2
    return mask | (len(raw.translate(None, MARKS)) < len(raw)) << 3


def _route(rows):
    """Rows ``(id, text, part, fingerprint, marked)`` of a task as ``((fingerprint, (has an id, id)), (text, ((part, rows), ...), failures))``.

    Only marked texts may be repeated. Of rows with equal text the smallest id alone goes on by its
    text's fingerprint; the others are known to be repeated. Rows that are settled carry no text and
    are dealt in turn, so that no common text gathers.
    """
    chains: dict[bytes, list] = {}
    size = 0

    def told(at, i, parts, mask):
        return (xxhash.xxh64_intdigest(at.to_bytes(8, "little")), (i is not None, i)), (None, tuple(parts.items()), mask)

    for at, (i, text, part, fingerprint, marked) in enumerate(rows):
        text, part = text or "", part or ""
        raw = text.encode("utf-8", "surrogatepass")
        found = chains.get(raw) if marked else None
        mask = found[2] if found else failures(text, raw)
        if i is None or not marked:
            yield told(at, i, {part: 1}, mask)
        elif found is None:
            chains[raw] = [i, {part: 1}, mask, fingerprint]
            size += len(raw) + 200
        elif i == found[0]:
            found[1][part] = found[1].get(part, 0) + 1
        elif i > found[0]:
            yield told(at, i, {part: 1}, mask | REPEATED)
        else:
            yield told(at, found[0], found[1], mask | REPEATED)
            found[:2] = i, {part: 1}
        if size > CHAIN_BYTES:
            yield from _sent(chains)
            chains, size = {}, 0
    yield from _sent(chains)


def _sent(chains: dict):
    for raw, (i, parts, mask, fingerprint) in chains.items():
        yield (fingerprint, (True, i)), (raw, tuple(parts.items()), mask)


def _settle(rows):
    """Routed rows in the order of fingerprint and id as ``(id, part, failures, rows)``.

    The texts of one fingerprint form a chain of full texts with their smallest ids: the first row
    of a text has it, every row with a larger id is repeated.
    """
    fingerprint, chain = None, {}
    for (at, (_, i)), (raw, parts, mask) in rows:
        if raw is not None:
            if at != fingerprint:
                fingerprint, chain = at, {}
            mask |= REPEATED * (chain.setdefault(raw, i) != i)
        for part, n in parts:
            yield i, part, mask, n


def _first(row):
    return _more(np.zeros((1 << len(FILTERS), 3), np.int64), row)


def _more(counts, row):
    mask, n, good, toxic = row
    counts[mask] += (n, n * good, n * toxic)
    return counts


def _steps() -> tuple[np.ndarray, ...]:
    """For each order and step the failure masks that stay, go and are redundant; and the step's filter."""
    masks = np.arange(1 << len(FILTERS))
    before, own = (np.array(x)[:, None] for x in zip(*[(sum(1 << FILTERS.index(f) for f in order[:k]), 1 << FILTERS.index(order[k])) for order in ORDERS for k in range(len(FILTERS))], strict=True))
    fails, earlier = (masks & own) > 0, (masks & before) > 0
    return ~fails & ~earlier, fails & ~earlier, fails & earlier, masks == own, own[:, 0]


def _report(part: str, counts: np.ndarray):
    """The 600 rows of one part."""
    stay, go, redundant, alone, own = _steps()
    removed = go @ counts
    shapley = {f: int(removed[own == f, 0].sum()) for f in set(own.tolist())}
    columns = (stay @ counts[:, 0], removed[:, 0], redundant @ counts[:, 0], alone @ counts[:, 0], removed[:, 1], removed[:, 2], np.array([shapley[f] for f in own.tolist()]))
    for at, figures in enumerate(zip(*(c.tolist() for c in columns), strict=True)):
        yield part, ORDERS[at // len(FILTERS)], at % len(FILTERS) + 1, *figures


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Counts for each part of the documents, each order of the filters A to E and each step of it.

    Filters A to D look at one text (see ``failures``); E fails a text that a smaller id has, too.
    ``kept``: documents left after the step, ``removed``: by its filter, here; ``redundant``: that
    it would remove, had they not gone before; ``unique_fails``: that fail no other filter;
    ``good_lost, toxic_lost``: removed with label ``quality`` or ``toxic`` 1; ``shapley``:
    removed by the filter in all 120 orders.

    A first scan counts fingerprints (xxhash); those that several rows have are marked in buckets
    that every task knows. An RDD routes each text of a marked bucket once, to the partition of its
    fingerprint, sorted by fingerprint and id, so a task holds the chain of one fingerprint at a
    time; other texts do not move. Copies meet within tasks first (in blocks of
    ``CHAIN_BYTES``), so a text that a third of all rows have moves once a block. Labels join
    by id without texts. ``combineByKey`` adds vectors of 32 masks within tasks and then by
    part; the orders are made from them, 600 rows a part.

    A null text is empty, and equal to empty ones; a null part is the empty string. A null id is
    neither smaller nor larger than any: such a row never fails E and has no labels. Rows of
    the same id and text are not smaller than each other; each counts. Of several labels of an id,
    one 1 is enough. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    fingerprint = F.xxhash64(F.coalesce(column(text_col), F.lit(""))).alias("__at")
    keyed = docs.select(column(id_col).alias("__id"), column(text_col).alias("__text"), column(part_col).cast("string").alias("__part"), fingerprint)
    repeated = keyed.groupBy("__at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows: RDD = marked(keyed, repeated, ["__at"]).select("__id", "__text", "__part", "__at", "__marked").rdd
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.getNumPartitions())
    routed = rows.mapPartitions(_route).repartitionAndSortWithinPartitions(n, lambda key: key[0])
    kind = docs.schema[id_col].dataType.simpleString()
    failed = spark.createDataFrame(routed.mapPartitions(_settle), f"id {kind}, part string, mask int, n long", verifySchema=False)
    one = lambda c: F.max((column(c) == 1).cast("int"))
    known = labels.groupBy(column(id_col).alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    labelled = failed.join(known, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    counted = labelled.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_first, _more, lambda a, b: a + b, n)
    return spark.createDataFrame(counted.flatMap(lambda x: _report(*x)), OUT, verifySchema=False)
