"""Toxicity by a subsequence string kernel and a support vector machine.

The kernel compares two words by the subsequences of three and of five letters
that they share (a mark stands before the first letter), each weighted by
decay ** span, so inserted letters and gaps weaken a match instead of breaking
it. Words are first folded to letters: look-alike digits and signs become
letters, other signs inside a word go, and letters spelled out one by one are
joined. A letter outside ASCII, also one with an accent, is its own letter by its
lower-case code point; an accent that is a character by itself goes. Text without spaces is cut into overlapping pieces like a
long word. Landmark words span a Nyström approximation of the kernel space, in
which a squared-hinge SVM is trained on the words of labelled sentences: a word
weighs as often as it stands in toxic and in clean sentences. The landmark
expansion of the SVM is one weight per subsequence, which makes scoring linear
in the text. A document's score is a logistic function of its two highest word
scores, the number of words above the margin and the number of all words.

Defined cases: null, empty and letterless texts have the score of a text without
any toxic word; without labelled rows of both classes every score is 0; a
document with several labels counts as toxic if one says so; repeated rows stay
repeated; a null doc_id is not held out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import Powers, binary_texts, prefix_hash, range_hash, ship, slices, unpack, word_bounds
from mapweave.llm.features import labelled_sample
from mapweave.sources.tables import stage

DECAY = 0.6
#: Lengths of subsequences with the letters from first to last, at most.
LENGTHS = ((3, 5), (5, 6))
#: Subsequences are hashed to so many features.
FEATURES = 1 << 15
THRESHOLD = 0.3
#: Labelled documents for training, words for the SVM and landmarks, at most (arguments of `train`).
SAMPLE_ROWS, TRAINING_WORDS, LANDMARKS = 20_000, 8_000, 256
#: Letters of one word that are kept as they are; longer ones are cut into overlapping pieces.
PIECE, OVERLAP = 32, 16

# Signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_CODE = np.zeros(256, np.int64)
for _c in range(26):
    _CODE[65 + _c] = _CODE[97 + _c] = _c + 1
for _sign in "2689":
    _CODE[ord(_sign)] = 27
for _sign, _letter in LOOKALIKES.items():
    _CODE[ord(_sign)] = ord(_letter) - 96
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_START = 28
#: Places of the letters of each kind of subsequence, counted from its first.
_SHAPES = [(0, *inner, span - 1) for n, longest in LENGTHS for span in range(n, longest + 1)
           for inner in combinations(range(1, span - 1), n - 2)]
_HASH = Powers(0x9E3779B97F4A7C15)


@cache
def letter_code(point: int) -> int:
    """Code of a letter outside ASCII: one of its own, or that of the ASCII letter it is a form of; 0 for no letter."""
    char = chr(point)
    plain = unicodedata.normalize("NFKC", char)
    if len(plain) == 1 and plain.isascii():
        return int(_CODE[ord(plain)])
    if not char.isalpha():
        return 0
    lower = char.lower()
    point = ord(lower) if len(lower) == 1 else point
    # Codes have 16 bits; code points beyond them share the private area.
    return point if point < 1 << 16 else 0xE000 + point % 0x1900


def wide_codes(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Codes of the UTF-8 characters whose first bytes stand at ``lead``."""
    first = data[lead].astype(np.int64)
    more = 1 + (first >= 0xE0) + (first >= 0xF0)
    point = first & (0x3F >> more)
    for k in range(1, 4):
        inside = np.flatnonzero(more >= k)
        point[inside] = point[inside] << 6 | data[np.minimum(lead[inside] + k, len(data) - 1)] & 0x3F
    values, inverse = np.unique(np.minimum(point, 0x10FFFF), return_inverse=True)
    return np.fromiter(map(letter_code, values.tolist()), np.int64, len(values))[inverse]


@dataclass
class Units:
    """Folded words: letter codes in a row, bounds, the text and sentence of each."""

    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    sentence: np.ndarray


def units_of(texts: list[bytes]) -> Units:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    start, end = word_bounds(data)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    # A sign counts as a letter only with a letter or digit right after it.
    follows = np.append(_ALNUM[data[1:]], False)
    codes = np.where(_ALNUM[data] | follows, _CODE[data], 0)
    codes[(data == 64) & ~follows] = 0
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        codes[lead] = wide_codes(data, lead)
    letters = np.concatenate(([0], np.cumsum(codes > 0)))
    stops = np.concatenate(([0], np.cumsum(np.isin(data, (10, 33, 46, 63)))))
    size = letters[end] - letters[start]
    filled = size > 0
    start, end, size = start[filled], end[filled], size[filled]
    text = np.searchsorted(offsets, start, side="right") - 1
    # Three or more single letters in a row are one spelled-out word.
    single = size == 1
    follow = np.zeros(len(single), bool)
    follow[1:] = (single[1:] & single[:-1]) & (text[1:] == text[:-1])
    run = np.cumsum(~follow) - 1
    joined = np.bincount(run, minlength=1)[run] >= 3 if len(run) else np.zeros(0, bool)
    head = ~(follow & joined)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    u_start, u_end = letters[start[first]], letters[end[last]]
    codes = codes[codes > 0]
    text, sentence = text[first], stops[start[first]]
    long = u_end - u_start > PIECE
    if long.any():
        extra = [(s, min(s + PIECE, e), t, n) for b, e, t, n in zip(
            u_start[long], u_end[long], text[long], sentence[long]) for s in range(b, max(e - OVERLAP, b + 1), OVERLAP)]
        extra = np.array(extra, np.int64).reshape(-1, 4)
        u_start, u_end, text, sentence = (np.concatenate((x[~long], extra[:, i])) for i, x in enumerate(
            (u_start, u_end, text, sentence)))
    return Units(codes, u_start, u_end, text, sentence)


def distinct(units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Index of one unit per different word, and for each unit its place among them."""
    prefix = prefix_hash(units.codes.astype(np.uint64), _HASH)
    hashes = range_hash(prefix, units.start, units.end, _HASH)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return first, inverse


def subsequences(codes: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(unit, feature, weight) of the subsequences of the units, one shape at a time."""
    size = end - start + 1
    first = np.cumsum(size) - size
    unit = np.repeat(np.arange(len(start)), size)
    inner = np.arange(len(unit)) - first[unit]
    marked = np.where(inner == 0, _START, codes[np.maximum(start[unit] + inner - 1, 0)]).astype(np.uint32)
    # The few codes of ASCII letters are digits of a number; others are spread, not to meet these.
    marked = np.where(marked > _START, marked * np.uint32(2246822519), marked)
    left = size[unit] - inner
    for shape in _SHAPES:
        p = np.flatnonzero(left > shape[-1])
        feature = np.zeros(len(p), np.uint32)
        for place in shape:
            feature = feature * np.uint32(29) + marked[p + place]
        feature = (feature + np.uint32(len(shape))) * np.uint32(2654435761) >> np.uint32(17)
        yield unit[p], feature, DECAY ** shape[-1]


def _norms(letters: np.ndarray) -> np.ndarray:
    """Root of the summed squared weights of a word with so many letters."""
    total = np.zeros(len(letters))
    for shape in _SHAPES:
        total += np.maximum(letters + 1 - shape[-1], 0) * DECAY ** (2 * shape[-1])
    return np.sqrt(np.maximum(total, 1e-12))


def kernel_rows(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Explicit normalised kernel features, one dense row per unit."""
    out = np.zeros((len(start), FEATURES), np.float32)
    for unit, feature, weight in subsequences(codes, start, end):
        np.add.at(out, (unit, feature), np.float32(weight))
    return out / _norms(end - start)[:, None].astype(np.float32)


def kernel(codes: np.ndarray, start: np.ndarray, end: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of units (rows) and of landmarks given as transposed `kernel_rows`."""
    out = np.zeros((len(start), landmarks.shape[1]), np.float32)
    for unit, feature, weight in subsequences(codes, start, end):
        if len(unit):
            head = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            out[unit[head]] += np.add.reduceat(landmarks[feature], head) * np.float32(weight)
    return out / _norms(end - start)[:, None].astype(np.float32)


@dataclass
class ToxicModel:
    subsequence: np.ndarray
    bias: float
    document: np.ndarray

    def words(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.zeros(len(start))
        for unit, feature, weight in subsequences(codes, start, end):
            total += np.bincount(unit, self.subsequence[feature] * weight, minlength=len(start))
        return total / _norms(end - start) + self.bias

    def signs(self, texts: list[bytes]) -> np.ndarray:
        """Per text: highest and second word score, logs of words above the margin and of all."""
        out = np.zeros((len(texts), 4))
        out[:, :2] = self.bias
        for a, b in slices(texts, 4 << 20):
            units = units_of(texts[a:b])
            if not len(units.start):
                continue
            first, inverse = distinct(units)
            value = self.words(units.codes, units.start[first], units.end[first])[inverse]
            order = np.lexsort((value, units.text))
            text, value = units.text[order], value[order]
            end = np.flatnonzero(np.append(text[1:] != text[:-1], True))
            rows = a + text[end]
            out[rows, 0] = np.maximum(value[end], self.bias)
            more = (end > 0) & (text[end - 1] == text[end])
            out[rows[more], 1] = np.maximum(value[end[more] - 1], self.bias)
            out[a:b, 2] = np.log1p(np.bincount(text, value > 0, minlength=b - a))
            out[a:b, 3] = np.log1p(np.bincount(text, minlength=b - a))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _logistic(self.signs(texts) @ self.document[:-1] + self.document[-1])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _word_counts(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): labelled sentences that hold each folded word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, label = binary_texts(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in slices(texts):
                units = units_of(texts[a:b])
                if not len(units.start):
                    continue
                first, inverse = distinct(units)
                once = np.unique(np.stack((inverse, units.sentence, units.text)), axis=1)
                toxic = label[a + once[2]] > 0
                n_toxic = np.bincount(once[0], toxic, minlength=len(first)).astype(np.int64)
                n_clean = np.bincount(once[0], ~toxic, minlength=len(first)).astype(np.int64)
                words = [units.codes[s:e].astype(np.uint16).tobytes() for s, e in zip(units.start[first], units.end[first])]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n_toxic), pa.array(n_clean)],
                                                 names=["word", "toxic", "clean"])

    return sample.mapInArrow(run, "word binary, toxic long, clean long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_words(words: list[bytes], toxic: np.ndarray, clean: np.ndarray, landmarks: int = LANDMARKS,
              ridge: float = 1e-4, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights of the subsequences and the bias of the word SVM; words are 16-bit letter codes."""
    size = np.fromiter(map(len, words), np.int64, len(words)) // 2
    end = np.cumsum(size)
    codes = np.frombuffer(b"".join(words), np.uint16).astype(np.int64)
    start = end - size
    # Half of the landmarks are the words most bound to toxic sentences, half the most frequent.
    bound = np.argsort(-toxic / (toxic + clean + 3.0), kind="stable")
    frequent = np.argsort(-(toxic + clean), kind="stable")
    chosen = np.unique(np.concatenate((bound[:landmarks // 2], frequent[:landmarks // 2])))
    base = kernel_rows(codes, start[chosen], end[chosen])
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    good = values > 1e-4
    project = vectors[:, good] / np.sqrt(values[good])
    across = np.ascontiguousarray(base.T)
    z = np.vstack([kernel(codes, start[s:s + 500], end[s:s + 500], across) for s in range(0, len(words), 500)])
    z = np.hstack([z @ project, np.ones((len(words), 1))])
    # Both signs of a word, weighted by its sentences; a squared hinge by Newton steps.
    weight = np.concatenate((toxic, clean)) / (toxic + clean).sum()
    sign = np.concatenate((np.ones(len(words)), -np.ones(len(words))))
    both = np.vstack((z, z))
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-8
    for _ in range(rounds):
        slack = 1 - sign * (both @ w)
        active = (slack > 0) & (weight > 0)
        x, c = both[active], weight[active]
        gradient = penalty * w - x.T @ (c * sign[active] * slack[active])
        step = np.linalg.solve((x * c[:, None]).T @ x + np.diag(penalty), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return across @ (project @ w[:-1]), float(w[-1])


def fit_documents(signs: np.ndarray, label: np.ndarray, ridge: float = 1e-4, rounds: int = 50) -> np.ndarray:
    x = np.hstack([signs, np.ones((len(signs), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _logistic(x @ w)
        curve = (x * (p * (1 - p) / len(x))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(curve, x.T @ (p - label) / len(x) + ridge * w)
    return w


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, words: int = TRAINING_WORDS,
          landmarks: int = LANDMARKS) -> ToxicModel | None:
    """Fit on at most ``rows`` labelled documents outside the held-out quarter.

    The SVM takes at most ``words`` of their words and ``landmarks`` landmarks.
    """
    sample = labelled_sample(docs, labels.filter(~held_out()), F.col("toxic").cast("int"), rows)
    counts = stage(_word_counts(sample), "toxicity-words")
    both = F.col("toxic") + F.col("clean")
    half = words // 2
    # The most frequent words, and those that stand in toxic sentences more than others do.
    table = counts.orderBy(F.desc(both), "word").limit(half).union(
        counts.orderBy(F.desc(F.col("toxic") - 0.3 * both), "word").limit(half)).distinct().toArrow().sort_by("word")
    toxic, clean = (table[n].to_numpy().astype(float) for n in ("toxic", "clean"))
    if not toxic.sum() or not clean.sum():
        return None
    model = ToxicModel(*fit_words(table["word"].to_pylist(), toxic, clean, landmarks), np.zeros(5))
    shipped = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = unpack(shipped)
        for batch in batches:
            x = fitted.signs(binary_texts(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column(1)], names=[*"abcd", "label"])

    signs = sample.mapInArrow(run, "a double, b double, c double, d double, label int").limit(rows).toArrow()
    x = np.stack([signs[n].to_numpy() for n in "abcd"], axis=1)
    model.document = fit_documents(x, (signs["label"].to_numpy() > 0).astype(float))
    return model


def score_documents(docs: DataFrame, model: ToxicModel | None) -> DataFrame:
    """(doc_id, score) of every document row."""
    shipped = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = unpack(shipped)
        for batch in batches:
            score = fitted.scores(binary_texts(batch.column(1))) if fitted else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document row."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
