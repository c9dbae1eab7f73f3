"""Toxicity by a gapped-subsequence string kernel, Nystroem landmarks and a linear SVM.

Kernel. Two words are compared by the letter triples that occur in them in order, not necessarily
side by side: a triple that spans ``s`` letters weighs ``DECAY ** (s - 3)``, spans above ``SPAN`` letters weigh
nothing, and the kernel is the normalised inner product. An insult with letters inserted, dropped or
given an ending keeps most of its triples. Letters are folded to 32 classes (digits and signs that
stand for letters included); marks inside a word are skipped, and single letters in a row, as in a
spaced-out word, are read as one word.

Landmarks. Words that set toxic training texts apart, frequent words of the others, and those of them that
the model so far takes most easily for an insult. The Nystroem map
sends a word to its kernel values with the landmarks, whitened by the landmarks' own kernel matrix. As
the map and the SVM on it are linear in the triples, they fold into one weight per triple class, so
scoring a word costs one look-up per triple, whatever the number of landmarks.

Training. A sentence is a bag of words, toxic if some word is; labels belong to texts. Positive are the
words that are significantly more frequent in toxic texts, and in each round, of every toxic text, the
best word of the sentence that scores highest (at first by log-odds); both also with letters inserted or
doubled. Negative are words of the other texts, from the second round on those that score highest.
The SVM has squared hinge loss and is fitted by Newton steps. A logistic curve, fitted on whole training
texts, turns a text's highest word into a score.

The model is fitted on the driver from at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of the
key; every document is scored, on all of its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, read_table, worker_cache

TRAIN_ROWS = 4_000
LANDMARKS, HARD = 224, 48
DECAY, SPAN = 0.7, 6
THRESHOLD = 0.7
#: Standard deviations by which a word must be more frequent in toxic texts to count as positive by itself.
SIGNIFICANT = 3.5
#: Words that one Python worker remembers, twice (see ``_scorer``); results do not depend on it.
REMEMBERED = 240_000
#: Longest word that is scored in one piece; longer ones are scored in pieces that overlap by half.
LONGEST = 40

# Signs that are read as a letter.
LOOKALIKE = str.maketrans("0134578@$!|áàâäãåéèêëíìîïóòôöõúùûüçñ", "oieastbasiiaaaaaaeeeeiiiiooooouuuucn")
SINGLE = re.compile(r"(?:(?<=\s)|^)\w(?:[\s.\-_*]{1,2}\w){2,}(?=\s|$|[.,;:!?])")
BREAK = re.compile(r"(?<=[^\W\d_]{2})[.,;:!?/]+(?=[^\W\d_]{2})")
MARKS = ".,;:!?\"'()[]{}*#$%&-_"
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


_ASCII_LETTER = np.array([chr(i).isalnum() for i in range(128)])


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(classes 0..31 of the letters, a padded row per word; number of letters); marks are skipped."""
    codes = np.frombuffer("\n".join(words).translate(LOOKALIKE).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    row = np.cumsum(codes == 10)
    keep = (codes >= 128) | _ASCII_LETTER[np.minimum(codes, 127)]
    codes, row = codes[keep], row[keep]
    length = np.bincount(row, minlength=len(words))
    at = np.arange(len(row)) - (np.cumsum(length) - length)[row]
    table = np.zeros((len(words), max(3, int(length.max(initial=0)))), dtype=np.int64)
    table[row, at] = np.where((codes >= 97) & (codes < 123), codes - 97, 26 + codes % 6)
    return table[:, : max(3, LONGEST)], np.minimum(length, LONGEST)


@lru_cache(maxsize=64)
def _spans(longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    i, j, k = np.meshgrid(*[np.arange(longest)] * 3, indexing="ij")
    good = (i < j) & (j < k) & (k - i < SPAN)
    i, j, k = i[good], j[good], k[good]
    order = np.argsort(k, kind="stable")
    i, j, k = i[order], j[order], k[order]
    return i, j, k, DECAY ** (k - i - 2.0)


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(classes, weights) of the letter triples, a row per word; unit length, padded with weight 0.

    Equal triples of a word are added up before the length is taken.
    """
    table, length = _letters(words)
    size = table.shape[1]
    i, j, k, w = _spans(size)
    cls = (table[:, i] * 32 + table[:, j]) * 32 + table[:, k]
    weight = np.where(k[None, :] < length[:, None], w[None, :], 0.0)
    order = np.argsort(cls, axis=1)
    cls, weight = np.take_along_axis(cls, order, 1), np.take_along_axis(weight, order, 1)
    new = np.ones(cls.shape, bool)
    new[:, 1:] = cls[:, 1:] != cls[:, :-1]
    sums = np.add.reduceat(weight.ravel(), np.flatnonzero(new.ravel()))
    norm = np.sqrt(np.bincount(np.flatnonzero(new.ravel()) // cls.shape[1], sums**2, len(words)))
    return cls, weight / np.maximum(norm, 1e-9)[:, None]


def tokens(text: str | None) -> list[str]:
    """Words in lower case; spaced-out letters joined; marks at a joint of two words split them."""
    low = (text or "").lower()
    out = BREAK.sub(" ", low).split()
    return out + [re.sub(r"[\W_]", "", m) for m in SINGLE.findall(low)]


def by_length(words: list[str], most: int) -> Iterator[np.ndarray]:
    """Positions of at most ``most`` words of about one length, so that little is padded."""
    order = np.argsort([len(w) for w in words], kind="stable")
    for at in range(0, len(order), most):
        yield order[at : at + most]


@dataclass
class Model:
    """One weight per triple class, and the curve from a text's highest word to its score."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    floor: float

    def words(self, words: list[str]) -> np.ndarray:
        """The SVM's value of each word; one without a triple says nothing and has the floor."""
        if not words:
            return np.zeros(0)
        out = np.empty(len(words))
        for rows in by_length(words, 2000):
            cls, weight = triples([words[i] for i in rows])
            out[rows] = np.where(weight.any(1), np.einsum("ut,ut->u", self.weights[cls], weight) + self.bias, self.floor)
        return out

    def score(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -30, 30)))


def pieces(words: list[str]) -> list[list[str]]:
    """Overlapping pieces of over-long words, so that whole texts are read."""
    step = LONGEST // 2
    return [[w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - step, step)] for w in words]


def _svm(features: np.ndarray, label: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps over the rows inside the margin; negatives weigh three times the positives."""
    x = np.hstack([features, np.ones((len(features), 1))])
    sign = np.where(label > 0, 1.0, -1.0)
    share = weight * np.where(label > 0, 0.25 / weight[label > 0].sum(), 0.75 / weight[label <= 0].sum())
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        inside = sign * (x @ w) < 1
        xi, si = x[inside], share[inside]
        new = np.linalg.solve(ridge + (xi * si[:, None]).T @ xi, xi.T @ (si * sign[inside]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _distinct(texts: list[str], k: int = 5) -> list[str]:
    """Texts of which at least half of the word k-grams are new, so that a family of near copies counts once."""
    seen: set[int] = set()
    out = []
    for text in texts:
        words = text.split()
        own = {hash(tuple(words[i : i + k])) for i in range(max(1, len(words) - k + 1))}
        if 2 * len(own - seen) >= len(own):
            out.append(text)
        seen |= own
    return out


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Fit on whole texts and their labels; equal texts count once."""
    rows = list({t or "": int(y) for t, y in zip(texts, labels, strict=True)}.items())
    bad, good = [t for t, y in rows if y], [t for t, y in rows if not y]
    if not bad or not good:
        return Model(np.zeros(32**3), 0.0, 0.0, -30.0 if not bad else 30.0, 0.0)
    rng = np.random.default_rng(seed)
    bad, good = _distinct(bad), _distinct(good)
    df_bad, df_good = (Counter(w for t in side for w in {w.strip(MARKS) for w in tokens(t)} if len(w) >= 3) for side in (bad, good))
    odds = {w: np.log((n + 0.1) / len(bad)) - np.log((df_good.get(w, 0) + 0.1) / len(good)) for w, n in df_bad.items() if n >= 2}
    even = len(good) / len(bad)
    surer = sorted(w for w, n in df_bad.items() if n * even >= 8 * df_good.get(w, 0) and (n * even - df_good.get(w, 0)) / np.sqrt(even * (n * even + df_good.get(w, 0))) >= SIGNIFICANT)
    # triples that set toxic texts apart, so that roots with many endings are found though no one form is frequent
    telling = sorted(odds, key=lambda w: (-odds[w] * min(df_bad[w], 20) ** 0.5, w))
    common = [w for w, _ in sorted(df_good.items(), key=lambda x: (-x[1], x[0]))]
    tail = common[LANDMARKS // 4 :]
    spread = [tail[i] for i in sorted(rng.choice(len(tail), min(len(tail), LANDMARKS // 4), replace=False))] if tail else []
    marks = list(dict.fromkeys(telling[: LANDMARKS // 2] + common[: LANDMARKS // 4] + spread))

    def dense(words: list[str]) -> np.ndarray:
        cls, weight = triples(words)
        out = np.zeros((len(words), 32**3), dtype=np.float32)
        np.add.at(out, (np.arange(len(words))[:, None], cls), weight)
        return out

    def nystroem() -> np.ndarray:
        """Triple class -> feature, for the landmarks as they are now."""
        basis = dense(marks)
        values, vectors = np.linalg.eigh(basis @ basis.T)
        return (basis.T @ (vectors * (1 / np.sqrt(np.maximum(values, 1e-3))))).astype(np.float32)

    project = nystroem()

    def mapped(words: list[str]) -> np.ndarray:
        out = np.empty((len(words), project.shape[1]))
        for rows in by_length(words, 200):
            cls, weight = triples([words[i] for i in rows])
            out[rows] = np.matmul(weight[:, None, :].astype(np.float32), project[cls])[:, 0, :]
        return out

    sentences = [[s for s in ([w.strip(MARKS) or w for w in tokens(x)] for x in SENTENCE.split(t)) if s] or [[""]] for t in bad]
    worth = {w: v for w, v in odds.items()}
    others = sorted(df_good, key=lambda w: (-df_good[w], w))
    picked = others[:4000] + [others[i] for i in sorted(rng.choice(len(others), min(len(others), 8000), replace=False))]
    model = Model(np.zeros(32**3), 0.0, 1.0, 0.0, -2.0)
    for turn in range(4):
        known = worth if turn == 0 else None
        if known is None:
            vocabulary = sorted({w for t in sentences for s in t for w in s})
            known = dict(zip(vocabulary, model.words(vocabulary), strict=True))
        # the witness of each toxic text: the best word of its best sentence
        witness = [max((max(s, key=lambda w: (known.get(w, -9.0), w)) for s in t), key=lambda w: (known.get(w, -9.0), w)) for t in sentences]
        base = sorted(set(witness) | set(surer))
        spoilt = []
        for w in base:
            for i in rng.integers(1, max(2, len(w)), 5):
                spoilt.append(w[:i] + "abcdefghijklmnopqrstuvwxyz"[rng.integers(26)] + w[i:])
            i = int(rng.integers(0, len(w))) if w else 0
            spoilt.append(w[:i] + w[i : i + 1] + w[i:])
        positive = witness + surer * 3 + [w for w in spoilt if len(w) > 4]
        if turn:
            hard = sorted(df_good)
            scored = model.words(hard)
            top = [hard[i] for i in np.argsort(-scored)[:4000]]
            picked = list(dict.fromkeys(top + picked))[:12000]
            # the words that are most easily taken for an insult become landmarks as well
            marks = list(dict.fromkeys(marks + top[:HARD]))
            project = nystroem()
        x = np.vstack([mapped(positive), mapped(picked)])
        y = np.concatenate([np.ones(len(positive)), np.zeros(len(picked))])
        w, b = _svm(x, y, np.concatenate([np.ones(len(positive)), [1 + np.log(df_good[v]) for v in picked]]))
        model = Model(project.astype(float) @ w, b, 1.0, 0.0, -2.0)
    # the curve, by Newton steps on the highest word of whole texts
    cache: dict[str, float] = {}
    best = np.array([_best(model, t, cache) for t, _ in rows])
    y = np.array([v for _, v in rows], float)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    slope, offset = 1.0, -float(np.median(best))
    scale = max(1e-6, float(best.std()))
    z = np.stack([best / scale, np.ones_like(best)], 1)
    theta = np.array([1.0, offset / scale])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        grad = z.T @ (share * (p - y)) + 0.01 * theta
        hess = (z * (share * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        theta -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    slope, offset = theta[0] / scale, theta[1]
    return Model(model.weights, model.bias, float(slope), float(offset), model.floor)


def _best(model: Model, text: str | None, cache: dict[str, float]) -> float:
    """The highest word of a text; a text without words has the model's floor."""
    words = set(tokens(text))
    new = [w for w in words if w not in cache]
    if new:
        parts = pieces(new)
        flat = model.words([p for x in parts for p in x])
        at = 0
        for w, x in zip(new, parts, strict=True):
            cache[w] = float(flat[at : at + len(x)].max())
            at += len(x)
    return max(map(cache.__getitem__, words), default=model.floor)


def _scorer(docs: DataFrame, model: Model, remembered: int):
    """A function of the texts of a batch to their scores, for use in tasks.

    Words once scored are kept; when ``remembered`` are, they become the older ones, which are still looked
    up, so frequent words are not scored again.
    """
    spread = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope, model.offset, model.floor))

    def score(texts: pa.Array) -> np.ndarray:
        own = Model(*spread.value)
        ident = own.weights.tobytes()[:4096] + repr((own.bias, own.slope, own.offset, float(own.weights.sum()))).encode()
        kept = worker_cache("toxicity", ident, lambda: {"now": {}, "older": {}})
        out = []
        for at in range(0, len(texts), 256):
            if len(kept["now"]) > remembered:
                kept["older"], kept["now"] = kept["now"], {}
            cache, older = kept["now"], kept["older"]
            bags = [set(tokens(v.as_py())) for v in texts.slice(at, 256)]
            unseen = set().union(*bags) - cache.keys()
            again = unseen & older.keys()
            cache.update((w, older[w]) for w in again)
            new = list(unseen - again)
            parts = pieces(new)
            flat = own.words([p for x in parts for p in x])
            i = 0
            for w, x in zip(new, parts, strict=True):
                cache[w] = float(flat[i]) if len(x) == 1 else float(flat[i : i + len(x)].max())
                i += len(x)
            get = cache.__getitem__
            out.append(own.score(np.array([max(map(get, bag), default=own.floor) for bag in bags])))
        return np.concatenate(out) if out else np.zeros(0)

    return score


def score_documents(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", remembered: int = REMEMBERED) -> DataFrame:
    """(key, score) of every row; null and empty texts get the score of a text without telling words.

    Repeated rows get equal scores; other columns are ignored; texts are read whole.
    """
    score = _scorer(docs, model, remembered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def reject_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, remembered: int = REMEMBERED // 3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``; null and empty texts stay, repeated rows too."""
    score, at = _scorer(docs, model, remembered), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAIN_ROWS, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Fit on at most ``rows`` labelled rows for which ``usable`` (of the key) holds, half of either label
    where there are enough; rows are chosen by a hash of the key, so the sample does not depend on layout.

    A key with both labels counts as toxic, one that is labelled twice counts once. Null keys and labels are left
    out, labels without a row and rows without a label too; rows that repeat a labelled key all take part. A null text
    has no words. An empty table on either side gives a model that takes every text for clean.
    """
    named = labels.where(usable & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = rows // 2
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, 0.95 * half / n))).otherwise(share)
    hashed = F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    few = named.where(hashed < share).limit(2 * rows)
    got = docs.select(key, text).join(F.broadcast(few), key).orderBy(key, text).limit(2 * rows).collect()
    model = fit([r[text] for r in got], [r["y"] for r in got])
    del got
    give_back()
    return model


def held_out(key: str = "doc_id", parts: int = 3, which: int = 1) -> Column:
    """Rows never learned from: crc32 of the key as text leaves ``which``; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == which, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model learned from the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"), ~held_out())
    out = score_documents(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
