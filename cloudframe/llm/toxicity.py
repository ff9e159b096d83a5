"""Toxicity by weak supervision.

Voters look at a document: lexicon voters fire on a word (insults in four languages) or on words
that begin alike, pattern voters on what the whole text looks like. A generative label model sees
votes only: from how voters agree it estimates how often each fires in either class and how far
voters repeat each other, and gives every document of the training sample a posterior label. A
linear classifier over words and word beginnings is trained on the posteriors; it alone scores
documents. Labels name the word beginnings that vote, since no lexicon of all languages exists, and
the share of toxic documents; they enter neither the label model nor the classifier's targets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .cnn import labelled_sample
from .common import binary, numbered
from .fmindex import mix

# General lexica of insults in English, German, French and Spanish, matched as whole words.
INSULTS = {
    "en": "coward disgusting dumb filth filthy fool garbage hate horrible idiot idiots imbecile jerk kill loathsome loser losers moron morons pathetic pig rubbish scum shut stupid trash ugly vermin vile worthless",
    "de": "abschaum blöd dreck dumm dummkopf ekelhaft feigling hass hasse idioten müll schwachkopf trottel verlierer versager wertlos widerlich",
    "fr": "abruti bouffon connard crétin débile dégoûtant haine idiote imbécile lâche minable nul ordure pathétique pourriture raclure stupide",
    "es": "asco asqueroso basura cobarde cretino escoria estúpido idiota imbécil inútil miserable odio patético perdedor repugnante tonto",
}
# Words that speak to somebody, by language.
SECOND_PERSON = (b" you ", b" your ", b" du ", b" dich ", b" tu ", b" toi ", b" vous ", b" eres ", b" usted ")

#: The driver fits on at most so many labelled documents, whose texts have at most so many bytes in all.
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 1 << 24
PREFIXES = (3, 4, 5, 6, 7, 8)
VOTERS, FEATURES = 200, 2000
#: A word or beginning becomes a voter if its documents are toxic so much oftener than others
#: (standard deviations: some 100,000 are tried) and with at least this precision.
LEAST_Z, LEAST_PRECISION = 5.0, 0.8
#: For the classifier's targets a silent voter counts less than one that fires: short documents give few voters a chance.
SILENCE = 0.25

_RNG = np.random.default_rng(31)
_FACTOR = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FILTER_BITS = 22


def word_features(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each feature of a buffer: words (runs of letters, lower-cased) and their first 3 to 8 bytes."""
    low = _LOWER[text]
    accent = np.flatnonzero((text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[1:] != 0x97) & (text[:-1] == 0xC3)) + 1
    low[accent] += 32  # capital letters with accents in UTF-8
    inside = np.concatenate([[False], _LETTER[low], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, size = edges[::2], edges[1::2] - edges[::2]
    padded = np.concatenate([low, np.zeros(40, np.uint8)])
    longest = min(int(size.max(initial=0)), 40)
    sums = np.zeros(len(starts), np.uint64)
    at, found = [], []
    for j in range(longest):
        more = size > j
        sums = sums + np.where(more, padded[starts + j], 0).astype(np.uint64) * _FACTOR[j]
        if j + 1 in PREFIXES:
            k = np.flatnonzero(size > j + 1)  # a word of just this length is the word itself
            at.append(starts[k])
            found.append(mix(sums[k] + _FACTOR[50 + j + 1]))
    at.append(starts)
    found.append(mix(sums + size.astype(np.uint64) * _FACTOR[49]))
    return np.concatenate(at), np.concatenate(found)


def _word_hash(word: str) -> int:
    return int(word_features(np.frombuffer(word.encode(), np.uint8))[1][-1])


def _texts(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of texts with a blank between them, and where each begins."""
    size = np.fromiter(map(len, group), np.int64, len(group)) + 1
    return np.frombuffer(b" ".join(group), np.uint8), np.cumsum(size) - size


def document_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature hash) pairs."""
    docs, features = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k, t in enumerate(texts):
        found = np.unique(word_features(np.frombuffer(t, np.uint8))[1]) if t else np.zeros(0, np.uint64)
        docs.append(np.full(len(found), k))
        features.append(found)
    return np.concatenate(docs), np.concatenate(features)


def patterns(texts: list[bytes]) -> np.ndarray:
    """Pattern voters, a column each: shouting, exclamation marks, runs of them, no letters, and somebody spoken to twice or more."""
    out = np.zeros((len(texts), 5), bool)
    for k, t in enumerate(texts):
        capitals = sum(map(t.count, (b"A", b"E", b"I", b"O", b"N", b"T")))
        small = sum(map(t.count, (b"a", b"e", b"i", b"o", b"n", b"t")))
        low = t.lower()
        out[k] = (capitals > small, t.count(b"!") * 40 > len(t) + 40, b"!!" in t or b"?!" in t, capitals + small == 0, sum(map(low.count, SECOND_PERSON)) >= 2)
    return out


class LabelModel:
    """A generative model of votes: firing rates of every voter in each class, with voters that repeat each other sharing one weight.

    Fitted to votes alone by expectation and maximization. Voters that fire together form families
    (such as the insults of one language), and class 1 is a mixture of a part for each family, so
    that one family's silence does not speak against another's vote. The start is that documents
    belong to the part whose family agrees on them. ``prior`` is the share of class 1. The last
    ``common`` voters are of no family: they speak for several, and would chain these into one.
    """

    def __init__(self, votes: np.ndarray, prior: float, rounds: int = 40, common: int = 0):
        votes = votes.astype(float)
        n = len(votes)
        self.prior = float(np.clip(prior, 1 / (n + 2), 1 - 1 / (n + 2)))
        rest = votes - votes.mean(axis=0)
        single = 1 / self._alike(rest, 0.9).sum(axis=1)  # voters that copy each other count once
        own = votes.shape[1] - common
        family = np.append(self._families(self._alike(rest[:, :own], 0.15)), np.full(common, -1))
        large = [f for f in np.unique(family[:own]) if single[family == f].sum() >= 1.5] or np.unique(family[:own]).tolist()
        agreed = np.stack([votes[:, family == f] @ single[family == f] for f in large])
        agreed = agreed[np.unique(agreed.argmax(axis=0))]  # families that lead somewhere
        # shares[0] is class 0; a part of class 1 begins with the documents that its family votes for
        shares = np.zeros((len(agreed) + 1, n))
        shares[1 + agreed.argmax(axis=0), np.arange(n)] = np.where(agreed.max(axis=0) >= 0.5, 0.9, 0.02)
        shares[0] = 1 - shares.sum(axis=0)
        for _ in range(rounds):
            size = shares.sum(axis=1)
            self.rates = (shares @ votes + 0.05) / (size + 1)[:, None]
            self.rates[1:] = np.maximum(self.rates[1:], self.rates[0])  # voters vote for class 1 or not at all
            self.mix = size[1:] / size[1:].sum()
            alike = self._alike(votes - shares.T @ self.rates, 0.2)
            self.correlation, self.weight = alike, 1 / alike.sum(axis=1)
            before, shares = shares, self._shares(votes)
            if np.abs(shares - before).max(initial=0) < 1e-4:
                break
        self.fires = np.stack([self.rates[0], self.mix @ self.rates[1:]])
        self.accuracy = self.prior * self.fires[1] / (self.prior * self.fires[1] + (1 - self.prior) * self.fires[0])

    @staticmethod
    def _alike(rest: np.ndarray, least: float) -> np.ndarray:
        """Correlations of residuals, those below ``least`` as none."""
        scale = np.sqrt((rest * rest).sum(axis=0)) + 1e-9
        c = np.abs(rest.T @ rest / np.outer(scale, scale))
        c = np.where(c > least, c, 0)
        np.fill_diagonal(c, 1)
        return c

    @staticmethod
    def _families(alike: np.ndarray) -> np.ndarray:
        """Voters joined by chains of correlations, named by their first voter."""
        name = np.arange(len(alike))
        while True:
            new = np.where(alike > 0, name[None, :], len(alike)).min(axis=1)
            if np.array_equal(new, name):
                return name
            name = new

    def _shares(self, votes: np.ndarray, silence: float = 1.0) -> np.ndarray:
        fired, silent = np.log(self.rates) * self.weight, silence * np.log(1 - self.rates) * self.weight
        logs = fired @ votes.T + silent @ (1 - votes).T
        logs += np.log(np.concatenate([[1 - self.prior], self.prior * self.mix]) + 1e-12)[:, None]
        odds = np.exp(logs - logs.max(axis=0))
        return odds / odds.sum(axis=0)

    def posterior(self, votes: np.ndarray, silence: float = 1.0) -> np.ndarray:
        """Probability of class 1 for each row of votes; ``silence`` is what a silent voter counts."""
        return 1 - self._shares(votes.astype(float), silence)[0]


def nominate(doc: np.ndarray, index: np.ndarray, count: np.ndarray, names: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Features that vote, surest first: those of the lexica that occur, and words and beginnings that labels name."""
    share = labels.mean()
    hits = np.bincount(index, labels[doc], len(names))
    z = (hits - count * share) / np.sqrt(count * share * (1 - share))
    fixed = np.isin(names, np.array([_word_hash(w) for words in INSULTS.values() for w in words.split()], np.uint64)) & (z > 0)
    good = np.flatnonzero(fixed | ((z >= LEAST_Z) & (hits >= LEAST_PRECISION * count)))
    return good[np.argsort(-z[good], kind="stable")][:FEATURES]


def train(texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Voters and label model on the sample, then the linear classifier on the posteriors."""
    labels = np.asarray(labels)
    ones, n = int(labels.sum()), len(texts)
    empty = {"feature": np.zeros(0, np.uint64), "weight": np.zeros(0), "bias": np.array([0.0 if not n else 6.0 if ones == n else -6.0])}
    if ones in (0, n):
        return empty
    doc, feature = document_features(texts)
    names, index, count = np.unique(feature, return_inverse=True, return_counts=True)
    good = nominate(doc, index, count, names, labels)
    if not len(good):
        return empty | {"bias": np.array([np.log(ones / (n - ones))])}
    place = np.full(len(names), -1)
    place[good] = np.arange(len(good))
    used = place[index] >= 0
    rows, columns = doc[used], place[index[used]]

    voters = min(VOTERS, len(good))
    fire = np.zeros((n, voters + 1), bool)
    few = columns < voters
    fire[rows[few], columns[few]] = True
    fire[np.bincount(rows[~few], minlength=n) > 0, voters] = True  # the rest of the lexicon is one voter
    votes = np.concatenate([fire, patterns(texts)], axis=1)
    target = LabelModel(votes, ones / n, common=votes.shape[1] - voters).posterior(votes, SILENCE)

    weight, bias = np.zeros(len(good)), np.log(target.mean() / (1 - target.mean()))
    m1, m2 = np.zeros(len(good) + 1), np.zeros(len(good) + 1)
    for step in range(1, 401):
        p = 1 / (1 + np.exp(-(bias + np.bincount(rows, weight[columns], n))))
        d = (p - target) / n
        g = np.append(np.bincount(columns, d[rows], len(good)) + 2e-5 * weight, d.sum())
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        move = 0.1 * m1 / (1 - 0.9**step) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        weight, bias = weight - move[:-1], bias - move[-1]
    order = np.argsort(names[good])
    return {"feature": names[good][order], "weight": weight[order], "bias": np.array([bias])}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, np.ndarray]:
    """Train on a bounded sample of ``labels(doc_id, label_col)``, see ``labelled_sample``."""
    return train(*labelled_sample(docs, labels, label_col, sample_docs, sample_bytes))


class Classifier:
    def __init__(self, model: dict[str, np.ndarray]):
        self.model = model
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[model["feature"] >> np.uint64(64 - _FILTER_BITS)] = True

    def _hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, found = word_features(data)
        may = np.flatnonzero(self.filter[found >> np.uint64(64 - _FILTER_BITS)])
        place = np.searchsorted(self.model["feature"], found[may])
        place = np.minimum(place, max(len(self.model["feature"]) - 1, 0))
        sure = self.model["feature"][place] == found[may] if len(may) else np.zeros(0, bool)
        return at[may[sure]], place[sure]

    def scores(self, texts: list[bytes], part: int = 1 << 20) -> np.ndarray:
        """Probability of label 1 for every whole text, a megabyte at a time; long texts are cut between words."""
        n, many = len(texts), max(len(self.model["feature"]), 1)
        pairs = [np.zeros(0, np.int64)]
        group, size, first = [], 0, 0

        def flush(last):
            data, begin = _texts(group)
            at, place = self._hits(data)
            pairs.append((np.searchsorted(begin, at, "right") - 1 + first) * many + place)

        for k, t in enumerate(texts):
            while len(t) > part:
                cut = part
                while cut < len(t) and _LETTER[t[cut]]:
                    cut += 1
                at, place = self._hits(np.frombuffer(t[:cut], np.uint8))
                pairs.append(k * many + place)
                t = t[cut:]
            group.append(t)
            size += len(t)
            if size >= part:
                flush(k)
                group, size, first = [], 0, k + 1
        if group:
            flush(n - 1)
        distinct = np.unique(np.concatenate(pairs))
        logit = np.bincount(distinct // many, self.model["weight"][distinct % many] if len(distinct) else None, n)[:n] + self.model["bias"][0]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _score(model, keep: int):
    def run(batches):
        classifier = Classifier(model.value)
        for batch in batches:
            found = classifier.scores(binary(batch.column(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(keep)), pa.array(found, pa.float64())], names=[*batch.schema.names[:keep], "score"])

    return run


def score_toxicity(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """Score every whole text: the columns of ``docs`` and ``score``, the probability of label 1.

    The classifier (at most ``FEATURES`` weights) is broadcast. One scan, no shuffle. Null and empty
    texts score by the bias alone; null ids, repeated rows and other columns pass unchanged (a column
    named ``score``, in any case, is replaced). Empty in, empty out.
    """
    docs, inner = numbered(docs)
    rest = {n: c for c, n in inner.items() if c.lower() != "score"}
    source = docs.select(*rest, F.col(inner[text_col]).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = source.mapInArrow(_score(shared, len(rest)), StructType([*source.schema.fields[:-1], StructField("score", DoubleType())]))
    return scored.toDF(*rest.values(), "score")
