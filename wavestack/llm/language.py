"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a label. Its emission score is a sum of learned weights: of its prefixes and
suffixes of one to three bytes, of all its byte n-grams of one to three, and of the word itself if it
is in the lexicon of frequent training words. A learned matrix scores label transitions, so that
in code-switched text a doubtful word follows its neighbours while a clear run of words switches the
label. Forward-backward gives each word's posterior; a text's label is the one with the highest mean
posterior over all its words, and that mean is the score.

Training maximises the conditional likelihood (gradients by forward-backward, Adam steps) on sequences spliced from
stretches of texts of different languages, which is where the transitions are learned from. The
model is fitted on the driver from at most ``TRAIN_ROWS`` rows, chosen by a hash of the key per
language, on their whole texts; prediction reads whole texts too.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, worker_cache

TRAIN_ROWS = 2_400
LEXICON = 3_000
BUCKETS = 1 << 16
#: Words that one Python worker remembers; results do not depend on it.
REMEMBERED = 400_000


def _letters() -> str:
    """A pattern of runs of letters: what Python counts as part of a word, less ``_`` and all numbers (categories N*)."""
    codes = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "N"]
    ranges = [[codes[0], codes[0]]]
    for c in codes[1:]:
        if c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return r"[^\W_" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]+"


WORD = re.compile(_letters())
UND = "und"


def words(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L), lower case; null has none."""
    return WORD.findall((text or "").lower())


def features(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature bucket, word) pairs of affixes and byte n-grams of the words."""
    data = [w.encode() for w in vocabulary]
    size = np.array([len(b) for b in data], dtype=np.int64)
    raw = np.frombuffer(b"\0".join(data) + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    word = np.repeat(np.arange(len(data)), size)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    left = np.repeat(start + size, size) - at  # bytes from here to the word's end
    code, buckets, owners = np.zeros(len(at), np.int64), [], []
    for n in (1, 2, 3):
        code = code * 257 + raw[at + n - 1] + 1
        inside = left >= n
        first, last = inside & (at == np.repeat(start, size)), left == n
        for kind, rows in ((0, inside), (1, first), (2, last)):
            buckets.append((code[rows] * 2654435761 + (3 * n + kind) * 40503) % 2147483647 % BUCKETS)
            owners.append(word[rows])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Crf:
    """Labels, hashed feature weights, lexicon weights, transitions and initial scores."""

    labels: list[str]
    weights: np.ndarray  # (BUCKETS, L)
    lexicon: dict[str, int]
    lexical: np.ndarray  # (words in the lexicon + 1, L); the last row is of all others
    transition: np.ndarray  # (L, L)
    initial: np.ndarray  # (L,)

    def emissions(self, vocabulary: list[str]) -> np.ndarray:
        """Scores (words, L), bounded so that their exponentials are."""
        if not vocabulary:
            return np.zeros((0, len(self.labels)))
        bucket, owner = features(vocabulary)
        out = np.stack([np.bincount(owner, self.weights[bucket, k], len(vocabulary)) for k in range(len(self.labels))], 1)
        count = np.maximum(1, np.bincount(owner, minlength=len(vocabulary)))
        out = out / np.sqrt(count)[:, None] + self.lexical[[self.lexicon.get(w, len(self.lexicon)) for w in vocabulary]]
        return np.clip(out - out.max(1, keepdims=True), -30, 0)


def forward_backward(score: np.ndarray, lengths: np.ndarray, transition: np.ndarray, initial: np.ndarray, want_pairs: bool = False):
    """Posteriors of many sequences at once.

    ``score`` holds the emission scores of the sequences one after another, longest sequence first. Each
    step handles the words at one place of all sequences that reach it. Returns posteriors in the same
    order, expected transition counts (if wanted) and the log of the normalisers.
    """
    start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    emit, move, n_labels = np.exp(score), np.exp(transition), len(initial)
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    alpha, scale = np.empty_like(emit), np.empty(len(emit))
    prev = np.exp(initial)[None, :].repeat(len(lengths), 0)
    for t in range(steps):
        n = active[t]
        rows = start[:n] + t
        a = (prev[:n] @ move if t else prev[:n]) * emit[rows]
        z = a.sum(1)
        prev = a / z[:, None]
        alpha[rows], scale[rows] = prev, z
    post, pairs = alpha, np.zeros((n_labels, n_labels))
    beta, post = np.ones((len(lengths), n_labels)), np.empty_like(emit)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        rows = start[:n] + t
        if t + 1 < steps:
            m = active[t + 1]
            nxt = start[:m] + t + 1
            carried = beta[:m] * emit[nxt] / scale[nxt][:, None]
            if want_pairs:
                pairs += move * (alpha[rows[:m]].T @ carried)
            beta[:m] = carried @ move.T
        post[rows] = alpha[rows] * beta[:n]
    post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
    return post, pairs, np.log(np.maximum(scale, 1e-300))


def fit(texts: list[str | None], langs: list[str], seed: int = 5, rounds: int = 6) -> Crf:
    """Fit on texts and their languages; spliced sequences teach the transitions."""
    labels = sorted(set(langs))
    n_labels = len(labels)
    pools: dict[str, list[list[str]]] = {x: [] for x in labels}
    for text, lang in zip(texts, langs, strict=True):
        if own := words(text):
            pools[lang].append(own)
    seen = Counter(w for pool in pools.values() for ws in pool for w in set(ws))
    lexicon = {w: i for i, (w, n) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) if n >= 3}
    model = Crf(labels, np.zeros((BUCKETS, n_labels)), lexicon, np.zeros((len(lexicon) + 1, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    rng = np.random.default_rng(seed)
    stretches: list[tuple[int, list[str]]] = []
    for k, lang in enumerate(labels):
        for ws in pools[lang]:
            at = 0
            while at < len(ws):
                n = int(rng.integers(3, 40))
                stretches.append((k, ws[at : at + n]))
                at += n
    if not stretches:
        return model
    by_label = [[s for s in stretches if s[0] == k] for k in range(n_labels)]
    # languages weigh about the same
    most = max(map(len, by_label))
    stretches = [own[i % len(own)] for own in by_label if own for i in range(min(most, 4 * len(own)))]
    vocabulary = sorted({w for _, ws in stretches for w in ws})
    index = {w: i for i, w in enumerate(vocabulary)}
    bucket, owner = features(vocabulary)
    norm = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(vocabulary))))
    lex = np.array([lexicon.get(w, len(lexicon)) for w in vocabulary])
    order = np.argsort(owner, kind="stable")
    bucket, owner = bucket[order], owner[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(vocabulary)))])
    params = [model.weights, model.lexical, model.transition, model.initial]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(rounds):
        rng.shuffle(stretches)
        # one to four stretches a sequence
        sequences, at = [], 0
        while at < len(stretches):
            n = int(rng.integers(1, 5))
            sequences.append(stretches[at : at + n])
            at += n
        for b in range(0, len(sequences), 256):
            batch = sorted(sequences[b : b + 256], key=lambda s: -sum(len(ws) for _, ws in s))
            lengths = np.array([sum(len(ws) for _, ws in s) for s in batch])
            ids = np.array([index[w] for s in batch for _, ws in s for w in ws])
            gold = np.array([k for s in batch for k, ws in s for _ in ws])
            used, local = np.unique(ids, return_inverse=True)
            take = np.concatenate([np.arange(first[u], first[u + 1]) for u in used])
            feat, own = bucket[take], np.searchsorted(used, owner[take])
            score = np.stack([np.bincount(own, model.weights[feat, k], len(used)) for k in range(n_labels)], 1) * norm[used][:, None] + model.lexical[lex[used]]
            score = np.clip(score - score.max(1, keepdims=True), -30, 0)
            post, pairs, _ = forward_backward(score[local], lengths, model.transition, model.initial, True)
            start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            diff = -post
            diff[np.arange(len(gold)), gold] += 1
            total = len(gold)
            per_word = np.stack([np.bincount(local, diff[:, k], len(used)) for k in range(n_labels)], 1) / total
            scaled = (per_word * norm[used][:, None])[own]
            grad_w = np.stack([np.bincount(feat, scaled[:, k], BUCKETS) for k in range(n_labels)], 1)
            grad_l = np.zeros_like(model.lexical)
            np.add.at(grad_l, lex[used], per_word)
            observed = np.zeros_like(pairs)
            inside = np.ones(total, bool)
            inside[start] = False
            np.add.at(observed, (gold[np.flatnonzero(inside) - 1], gold[inside]), 1)
            grad_t = (observed - pairs) / total
            grad_i = (np.bincount(gold[start], minlength=n_labels) - post[start].sum(0)) / total
            step += 1
            for p, g, (m, v) in zip(params, (grad_w, grad_l, grad_t, grad_i), moments, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def predict_documents(docs: DataFrame, model: Crf, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row, from its whole text.

    A null text, or one without a letter, is ``und`` with score 0; a model without labels says ``und`` for
    all. Repeated rows get equal rows; other columns are ignored.
    """
    if not model.labels:
        return docs.select(F.col(key).cast("long").alias("doc_id"), F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Crf = spread.value
        n_labels = len(own.labels)
        ident = hash((own.weights.tobytes()[:65536], float(own.weights.sum()), float(own.transition.sum())))
        cache = worker_cache("language", ident, lambda: {"known": {}, "table": np.zeros((0, n_labels))})
        known, table = cache["known"], cache["table"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                if len(known) > REMEMBERED:
                    known.clear()
                    table = table[:0]
                texts = [words(v.as_py()) for v in part.column(1)]
                new = [w for w in set().union(*texts) if w not in known]
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                table = np.concatenate([table, own.emissions(new)])
                cache["table"] = table
                lengths = np.array([len(ws) for ws in texts])
                order = np.argsort(-lengths, kind="stable")
                order = order[lengths[order] > 0]
                get = known.__getitem__
                ids = np.array([i for d in order for i in map(get, texts[d])], dtype=np.int64)
                names, scores = [UND] * len(texts), [0.0] * len(texts)
                if len(order):
                    size = lengths[order]
                    post, _, _ = forward_backward(table[ids], size, own.transition, own.initial)
                    mean = np.add.reduceat(post, np.cumsum(size) - size, axis=0) / size[:, None]
                    best = mean.argmax(1)
                    for d, k, m in zip(order, best, mean.max(1), strict=True):
                        names[d], scores[d] = own.labels[k], min(1.0, float(m))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def label_words(text: str, model: Crf) -> list[tuple[str, str, float]]:
    """(word, label, posterior) of each word of one text, for code-switched text."""
    own = words(text)
    if not own or not model.labels:
        return []
    post, _, _ = forward_backward(model.emissions(own), np.array([len(own)]), model.transition, model.initial)
    return [(w, model.labels[k], float(p[k])) for w, p, k in zip(own, post, post.argmax(1), strict=True)]


def train(docs: DataFrame, usable: Column, rows: int = TRAIN_ROWS, text: str = "text", key: str = "doc_id", lang: str = "lang") -> Crf:
    """Fit on about ``rows`` rows with a language for which ``usable`` holds, as many of each language as
    there are up to an equal share, chosen by a hash of the key.

    Rows with a null text or language are left out, and those without a letter teach nothing; rows with a null
    key take part. Repeated rows count as often as they come. An empty table gives a model without labels.
    """
    named = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[lang]: r["n"] for r in named.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([], [])
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(lang) == value, F.lit(min(1.0, rows / len(counts) / n))).otherwise(share)
    hashed = F.pmod(F.xxhash64(F.lit(13), F.col(key)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    got = named.where(hashed < share).select(key, F.col(text).alias("text"), lang).limit(2 * rows).collect()
    got.sort(key=lambda r: (r[key] is None, r[key], r["text"]))
    return fit([r["text"] for r in got], [r[lang] for r in got])


def held_out(key: str = "doc_id", parts: int = 4, which: int = 2) -> Column:
    """Rows never learned from: crc32 of the key as text leaves ``which``; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == which, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model learned from the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    return predict_documents(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
