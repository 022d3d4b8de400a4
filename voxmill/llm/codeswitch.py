"""Language of texts, word by word, by a linear-chain conditional random field.

Words are labelled with languages.  A word's score for a label is the sum of
hashed weights of its affixes, its character n-grams and the lexicons it stands
in; neighbouring labels are tied by learned transition weights.  Forward-
backward gives each word's label probabilities; a text's language is the one
with most expected words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import only
from voxmill.session import ship_with_tasks

ship_with_tasks(__name__)

# Bounds of the training sample; prediction has none.
SAMPLE_TEXTS = 250  # of a language
SAMPLE_CHARS = 20_000  # longer texts are not sampled
SAMPLE_WORDS = 200  # used of a sampled text
LANGUAGES = 64  # the most frequent values of the language column
LEXICON = 100  # words of a language

BUCKETS = 1 << 16
CHAIN = 64  # words that are labelled together
EPOCHS = 8
BATCH = 128
MEMO_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")

Model = dict  # labels, lexicons, weights, transitions: plain values and arrays of fixed size


def held_out(doc_id: str = "id"):
    """True for the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(word: str, lexicons: dict[str, list[int]]) -> list[int]:
    """Buckets of a lower-case word: affixes, n-grams, the word, and the lexicons it is in.

    The word is encoded once, four bytes a character; its slices are hashed
    with a seed for each kind of feature.
    """
    marked = f"<{word}>".encode("utf-32-le")
    inner, end = marked[4:-4], len(marked)
    found = {zlib.crc32(marked, 1)}
    for size in (1, 2, 3):
        found.add(zlib.crc32(inner[: 4 * size], 10 + size))
        found.add(zlib.crc32(inner[-4 * size :], 20 + size))
        wide = 4 * (size + 1)
        found.update([zlib.crc32(marked[k : k + wide], 30) for k in range(0, end - wide + 1, 4)])
    found.update(zlib.crc32(b"lexicon", 100 + label) for label in lexicons.get(word, ()))
    return sorted({value % BUCKETS for value in found})


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def forward_backward(scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray):
    """Label and label-pair probabilities of chains ``scores[chain, place, label]``.

    Chains shorter than the array end at ``lengths``.  All chains advance
    together; each step is normalised, so nothing under- or overflows.
    """
    chains, places, labels = scores.shape
    potential = np.exp(scores - scores.max(axis=2, keepdims=True))
    moves = np.exp(transitions)
    ahead = np.empty_like(potential)
    ahead[:, 0] = potential[:, 0]
    ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, places):
        ahead[:, t] = (ahead[:, t - 1] @ moves) * potential[:, t]
        ahead[:, t] /= ahead[:, t].sum(axis=1, keepdims=True)
    behind = np.ones_like(potential)
    for t in range(places - 2, -1, -1):
        step = (potential[:, t + 1] * behind[:, t + 1]) @ moves.T
        step /= step.sum(axis=1, keepdims=True)
        inside = (t + 1 < lengths)[:, None]
        behind[:, t] = np.where(inside, step, 1.0)
    single = ahead * behind
    single /= single.sum(axis=2, keepdims=True)
    return single, ahead, behind, potential, moves


def _pair_totals(ahead, behind, potential, moves, valid) -> np.ndarray:
    """Expected number of each label pair over all chains."""
    left, right = ahead[:, :-1], (potential * behind)[:, 1:]
    scale = np.einsum("ctj,ctj->ct", left @ moves, right)
    weight = np.where(valid[:, 1:], 1.0 / np.maximum(scale, 1e-300), 0.0)
    return np.einsum("cti,ctj->ij", left * weight[..., None], right) * moves


def train(texts: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit the field to ``(text, language)`` rows, by maximum likelihood with small weight decay.

    The chains switch language as mixed text does: they are put together from
    runs of 4 to 24 words of texts in random order.
    """
    labels = sorted({lang for _, lang in texts})
    code = {lang: k for k, lang in enumerate(labels)}
    drawn = np.random.default_rng(seed)
    listed = [(words_of(text)[:SAMPLE_WORDS], code[lang]) for text, lang in texts]
    counts = [Counter() for _ in labels]
    for words, label in listed:
        counts[label].update(set(words))
    lexicons: dict[str, list[int]] = {}
    for label, found in enumerate(counts):
        for word, _ in sorted(found.items(), key=lambda item: (-item[1], item[0]))[:LEXICON]:
            lexicons.setdefault(word, []).append(label)
    model = {"labels": labels, "lexicons": lexicons}
    runs = []
    for words, label in listed:
        at = 0
        while at < len(words):
            size = int(drawn.integers(4, 25))
            runs.append((words[at : at + size], label))
            at += size
    order = drawn.permutation(len(runs))
    stream = [(word, runs[k][1]) for k in order for word in runs[k][0]]
    memo = {word: features(word, lexicons) for word in {word for word, _ in stream}}
    weights = np.zeros((BUCKETS, len(labels)))
    transitions = np.zeros((len(labels), len(labels)))
    squares, moved = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    chains = [stream[k : k + CHAIN] for k in range(0, len(stream), CHAIN)]
    for _ in range(EPOCHS):
        shuffled = drawn.permutation(len(chains))
        for at in range(0, len(chains), BATCH):
            part = [chains[k] for k in shuffled[at : at + BATCH]]
            lengths = np.array([len(chain) for chain in part])
            places = np.arange(CHAIN) < lengths[:, None]
            gold = np.zeros(places.shape, int)
            gold[places] = [label for chain in part for _, label in chain]
            lists = [memo[word] for chain in part for word, _ in chain]
            flat = np.concatenate(lists)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])[:-1]])
            scores = np.zeros((*places.shape, len(labels)))
            scores[places] = np.add.reduceat(weights[flat], starts)
            single, ahead, behind, potential, moves = forward_backward(scores, transitions, lengths)
            error = -single[places]
            error[np.arange(len(error)), gold[places]] += 1
            slope = np.repeat(error, [len(x) for x in lists], axis=0)
            gradient = np.stack([np.bincount(flat, slope[:, k], BUCKETS) for k in range(len(labels))], axis=1)
            gradient -= 1e-3 * weights
            squares += gradient**2
            weights += 0.3 * gradient / np.sqrt(squares)
            pairs = -_pair_totals(ahead, behind, potential, moves, places)
            both = places[:, 1:]
            np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            moved += pairs**2
            transitions += 0.3 * pairs / np.sqrt(moved)
    model["weights"] = weights.astype(np.float32)
    model["transitions"] = transitions
    return model


class Labeller:
    """Label probabilities of the words of many texts, with a memo of word scores."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.rows: dict[str, int] = {}
        self.scores = np.empty((1024, len(model["labels"])), np.float32)

    def _learn(self, words: list[str]) -> None:
        lists = [features(word, self.model["lexicons"]) for word in words]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])[:-1]])
        first = len(self.rows)
        while first + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
        self.scores[first : first + len(words)] = np.add.reduceat(self.model["weights"][np.concatenate(lists)], starts)
        self.rows.update(zip(words, range(first, first + len(words)), strict=True))

    def _word_scores(self, words: list[str]) -> np.ndarray:
        missing = list(dict.fromkeys(word for word in words if word not in self.rows))
        if len(self.rows) + len(missing) > MEMO_WORDS:
            self.rows.clear()
            missing = list(dict.fromkeys(words))
        for at in range(0, len(missing), 20_000):
            self._learn(missing[at : at + 20_000])
        return self.scores[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]

    def probabilities(self, words: list[str]) -> np.ndarray:
        """``[word, label]``: of one text, in chains of CHAIN words."""
        count, labels = len(words), len(self.model["labels"])
        chains = -(-count // CHAIN)
        scores = np.zeros((chains * CHAIN, labels))
        scores[:count] = self._word_scores(words)
        lengths = np.full(chains, CHAIN)
        lengths[-1] = count - CHAIN * (chains - 1)
        single = forward_backward(scores.reshape(chains, CHAIN, labels), self.model["transitions"], lengths)[0]
        return single.reshape(-1, labels)[:count]

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and its share of expected words; chains of all texts advance together."""
        labels = self.model["labels"]
        lists = [words_of(text) if text else [] for text in texts]
        lists = [x if any(c.isalpha() for word in x for c in word) else [] for x in lists]
        padded: list[str] = []
        lengths: list[int] = []
        owners: list[int] = []
        for k, words in enumerate(lists):
            for at in range(0, len(words), CHAIN):
                part = words[at : at + CHAIN]
                lengths.append(len(part))
                owners.append(k)
                padded += part
        found = [("und", 0.0)] * len(texts)
        if not padded or not labels:
            return found
        size = np.array(lengths)
        places = np.arange(CHAIN) < size[:, None]
        scores = np.zeros((*places.shape, len(labels)))
        scores[places] = self._word_scores(padded)
        single = forward_backward(scores, self.model["transitions"], size)[0]
        expected = np.zeros((len(texts), len(labels)))
        np.add.at(expected, owners, (single * places[..., None]).sum(axis=1))
        for k in sorted(set(owners)):
            best = int(expected[k].argmax())
            found[k] = (labels[best], float(min(1.0, expected[k][best] / expected[k].sum())))
        return found


def fit(documents: DataFrame) -> Model:
    """Train on a bounded sample of the documents with a language that are not held out.

    At most SAMPLE_TEXTS texts of each of the LANGUAGES most frequent values,
    chosen by a hash of the id.
    """
    rows = only(documents, id="doc_id", text="text", lang="lang")
    rows = rows.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(F.length("text") <= SAMPLE_CHARS)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return {"labels": [], "lexicons": {}, "weights": np.zeros((1, 0), np.float32), "transitions": np.zeros((0, 0))}
    million = 1_000_000
    share = F.create_map(
        *(F.lit(v) for row in sizes for v in (row["lang"], min(million, 2 * million * SAMPLE_TEXTS // row["n"] + 1)))
    )
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(million))
    sample = rows.where(F.col("lang").isin([row["lang"] for row in sizes])).where(draw < share[F.col("lang")])
    taken: dict[str, list] = {}
    for row in sample.select("lang", "text", draw.alias("draw")).toLocalIterator():
        taken.setdefault(row["lang"], []).append((row["draw"], row["text"]))
    return train([(text, lang) for lang in sorted(taken) for _, text in sorted(taken[lang])[:SAMPLE_TEXTS]])


def _predictor(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            found = labeller.texts(batch.column(2).to_pylist())
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([lang for lang, _ in found], pa.string()),
                pa.array([score for _, score in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, repeated ids included.

    ``und`` and 0 stand for a null text, one without a letter, and for all
    texts if there was nothing to learn from.  A null id is never held out.
    """
    model = fit(documents) if model is None else model
    rows = only(documents, id="doc_id", text="text").select(
        F.col("id").cast("long"), held_out(), F.col("text").cast("string")
    )
    return rows.mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")
