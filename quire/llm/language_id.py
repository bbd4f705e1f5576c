"""Language identification by interpolated Kneser-Ney character models.

One model for each language of the training rows, over letters: words are lower-cased runs of
letters between boundary marks, and an n-gram never crosses a boundary, so a word's
probability depends on the word alone and every distinct word of a block is scored once. Each
n-gram keeps its interpolated log probability for each language, each context its back-off weight, in
arrays sorted by hash. The language with the lowest cross-entropy per letter wins; the score is a
calibrated probability and texts far above the calibration's cross-entropy are rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import _text
from quire.llm._common import documents, with_package

ORDER, DISCOUNT = 5, 0.75
#: Bounds of the training sample: documents of one language, documents in all, code points of a document that may be used.
PER_LANGUAGE, IN_ALL, LONGEST = 300, 4000, 20_000
#: Texts that a language needs to take part in calibration; the bound of rejection is MARGIN times the QUANTILE of the calibration's cross-entropies.
ENOUGH, QUANTILE, MARGIN = 8, 0.99, 1.25
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)]))
    return _letters[0]


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends, first word of each text): runs of letters of the lower-cased texts."""
    lowered = [t.lower() for t in texts]
    joined = "\n".join(lowered)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = letter_table()[points] if len(points) else np.zeros(0, bool)
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    return points, starts, ends, np.searchsorted(starts, offsets)


def word_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_text.mix64(points.astype(np.uint64) + np.uint64(1)) * _text.powers(_text._BASE, len(points)), out=total[1:])
    return _text.mix64((total[ends] - total[starts]) * _text.powers(_text._INVERSE, len(points) + 1)[starts] + (ends - starts).astype(np.uint64))


def marked(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, place in word, word): each word with a mark (1) before and after it."""
    size = ends - starts + 2
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    symbols = np.ones(len(word), np.uint64)
    inner = (place > 0) & (place < size[word] - 1)
    symbols[inner] = points[starts[word[inner]] + place[inner] - 1].astype(np.uint64) + np.uint64(2)
    return symbols, place, word


def grams(symbols: np.ndarray, order: int) -> np.ndarray:
    """Hash of the order symbols that end at each place (meaningful where place >= order - 1)."""
    out = np.zeros(len(symbols), np.uint64)
    for back in range(order - 1, -1, -1):
        shifted = symbols if not back else np.concatenate([np.zeros(back, np.uint64), symbols[:-back]])
        out = out * np.uint64(0x9E3779B97F4A7C15) + shifted
    return _text.mix64(out + np.uint64(order))


@dataclass
class Model:
    languages: list[str]
    #: For each order from 1: sorted hashes, log probability and log back-off by language.
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]
    floor: np.ndarray
    temperature: float = 1.0
    limit: float = float("inf")

    def word_scores(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probability of each word (its end mark included) by language."""
        symbols, place, word = marked(points, starts, ends)
        score = np.broadcast_to(self.floor, (len(symbols), len(self.languages))).copy()
        context = None
        for order in range(1, len(self.keys) + 1):
            h = grams(symbols, order)
            at = np.searchsorted(self.keys[order - 1], h)
            at[at == len(self.keys[order - 1])] = 0
            hit = (self.keys[order - 1][at] == h) & (place >= order - 1) if len(self.keys[order - 1]) else np.zeros(len(h), bool)
            if order > 1:  # the context is the (order-1)-gram that ends one place earlier
                at_before, hit_before = context
                shifted_at, shifted = np.concatenate([[0], at_before[:-1]]), np.concatenate([[False], hit_before[:-1]])
                use = shifted & (place >= order - 1)
                score[use] += self.back[order - 2][shifted_at[use]]
            seen = self.logp[order - 1][at[hit]]
            score[hit] = np.where(np.isnan(seen), score[hit], seen)
            context = at, hit
        score[place == 0] = 0.0
        first = np.flatnonzero(place == 0)
        return np.add.reduceat(score, first, axis=0) if len(first) else np.zeros((0, len(self.languages)))

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per symbol by language, letters) of each text; a text without letters has 0 letters."""
        out, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        for a, b in _text.slices(sizes, _text.CHUNK_BYTES):
            points, starts, ends, index = letter_words(texts[a:b])
            if not len(starts):
                continue
            _, first, inverse = np.unique(word_keys(points, starts, ends), return_index=True, return_inverse=True)
            scores = self.word_scores(points, starts[first], ends[first])[inverse]
            running = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0)])
            size = np.concatenate([[0], np.cumsum(ends - starts)])
            n, words_in = size[index[1:]] - size[index[:-1]], np.diff(index)
            letters[a:b] = n
            out[a:b] = -(running[index[1:]] - running[index[:-1]]) / np.maximum(n + words_in, 1)[:, None]
        return out, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or und, score, rejected) of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropy, letters = self.cross_entropies(texts)
        best = entropy.argmin(axis=1)
        p = _posterior(entropy, letters, self.temperature)[np.arange(len(texts)), best]
        none = letters == 0
        rejected = none | (entropy[np.arange(len(texts)), best] > self.limit)
        return [UNKNOWN if x else self.languages[i] for x, i in zip(none, best, strict=True)], np.where(none, 0.0, p), rejected


def _posterior(entropy: np.ndarray, letters: np.ndarray, temperature: float) -> np.ndarray:
    x = -(entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(letters, 1))[:, None] * temperature
    x = np.exp(np.maximum(x, -700))
    return x / x.sum(axis=1, keepdims=True)


def _counts(texts: list[str], order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: (hash, context hash, hash without its first symbol, count) of the distinct n-grams."""
    symbols, place, _ = marked(*letter_words(texts)[:3])
    out = []
    for n in range(1, order + 1):
        valid = np.flatnonzero(place >= max(n - 1, 1))  # the mark at a word's start is given, not predicted
        h = grams(symbols, n)
        lower = grams(symbols, n - 1) if n > 1 else np.zeros(len(symbols), np.uint64)
        keys, first, count = np.unique(h[valid], return_index=True, return_counts=True)
        at = valid[first]
        out.append((keys, lower[at - 1] if n > 1 else np.zeros(len(at), np.uint64), lower[at], count))
    return out


def _one_model(texts: list[str], order: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]], float]:
    """[(hash, log probability)], [(context hash, log back-off)] by order, log probability of an unseen symbol."""
    counts = _counts(texts, order)
    probabilities, backs, lower_p = [], [], None
    for n in range(1, order + 1):
        keys, context, suffix, count = counts[n - 1]
        value = count.astype(float)
        if n < order:  # continuation counts: in how many left contexts it stands (word starts have but one and keep their count)
            up_suffix = counts[n][2]
            u, c = np.unique(up_suffix, return_counts=True)
            at = np.searchsorted(u, keys)
            at[at == len(u)] = 0
            known = (u[at] == keys) if len(u) else np.zeros(len(keys), bool)
            value = np.where(known, c[at] if len(u) else 0, value)
        ctx, inverse = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(inverse, value), np.bincount(inverse)
        gamma = DISCOUNT * kinds / np.maximum(total, 1e-9)
        base = 1.0 / (len(counts[0][0]) + 1000)
        if n == 1:
            below = np.full(len(keys), base)
            unseen = float(gamma[0] * base) if len(gamma) else base
        else:
            at = np.searchsorted(lower_p[0], suffix)
            at[at == len(lower_p[0])] = 0
            below = np.where(lower_p[0][at] == suffix, lower_p[1][at], base)
        p = np.maximum(value - DISCOUNT, 0) / total[inverse] + gamma[inverse] * below
        lower_p = keys, p
        probabilities.append((keys, np.log(p)))
        if n > 1:
            backs.append((ctx, np.log(np.minimum(gamma, 1.0))))
    return probabilities, backs, float(np.log(unseen)) if len(counts[0][0]) else -10.0


def fit(samples: dict[str, list[str]], order: int = ORDER) -> Model:
    """Models of all languages; every fourth text of the languages with enough texts calibrates the score and the rejection, then all texts are learned."""
    languages = sorted(k for k, v in samples.items() if any(any(c.isalpha() for c in t) for t in v))
    if not languages:
        return Model([], [], [], [], np.zeros(0))
    # Rare languages are left out of calibration; only where all are rare, two texts are enough.
    tested = [k for k in languages if len(samples[k]) >= ENOUGH] or [k for k in languages if len(samples[k]) > 1]
    parts = {k: ([t for i, t in enumerate(samples[k]) if i % 4], samples[k][::4]) for k in tested}
    temperature, limit = 1.0, float("inf")
    if tested:
        trial = _combine({k: learn for k, (learn, _) in parts.items()}, order)
        held = [(k, t) for k in tested for t in parts[k][1]]
        entropy, letters = trial.cross_entropies([t for _, t in held])
        truth = np.array([trial.languages.index(k) for k, _ in held])
        use = letters > 0
        if use.any():
            loss = {t: -np.log(np.maximum(_posterior(entropy[use], letters[use], t)[np.arange(use.sum()), truth[use]], 1e-9)).mean() for t in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)}
            temperature = min(loss, key=loss.get)
            limit = MARGIN * float(np.quantile(entropy[use].min(axis=1), QUANTILE, method="lower"))
    model = _combine({k: samples[k] for k in languages}, order)
    model.temperature, model.limit = temperature, limit
    return model


def _combine(samples: dict[str, list[str]], order: int) -> Model:
    languages = sorted(samples)
    single = [_one_model(samples[k], order) for k in languages]
    keys, logp, back = [], [], []
    for n in range(order):
        every = np.unique(np.concatenate([m[0][n][0] for m in single] + ([m[1][n][0] for m in single] if n < order - 1 else [])))
        p, b = np.full((len(every), len(languages)), np.nan, np.float32), np.zeros((len(every), len(languages)), np.float32)
        for i, m in enumerate(single):
            p[np.searchsorted(every, m[0][n][0]), i] = m[0][n][1]
            if n < order - 1:
                b[np.searchsorted(every, m[1][n][0]), i] = m[1][n][1]
        keys.append(every), logp.append(p), back.append(b)
    return Model(languages, keys, logp, back, np.array([m[2] for m in single]))


def held_out() -> Column:
    return (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 == 0)


def training_sample(docs: DataFrame) -> dict[str, list[str]]:
    """Texts by language from rows that are not held out: about PER_LANGUAGE, chosen by a hash of the id.

    They are whole, up to LONGEST code points; only a language whose rows are all longer gives their beginnings.

    The bound is in rows and in code points of a row, so what reaches the driver does not grow with the corpus.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    short = F.length("text") <= LONGEST
    found = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(short).alias("short")).collect()
    # Shares are of the rows that may be used; a language without short rows learns from the beginnings of its long ones.
    counts = {r["lang"]: r["short"] or r["n"] for r in found}
    if not counts:
        return {}
    each = max(1, min(PER_LANGUAGE, IN_ALL // len(counts)))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(each / n))])
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language")), 11) / F.lit(float(1 << 53))
    usable = short | F.col("lang").isin([r["lang"] for r in found if not r["short"]])
    chosen = labelled.where((unit < F.element_at(share, F.col("lang"))) & usable).select("lang", F.substring("text", 1, LONGEST).alias("text"), unit.alias("u")).limit(2 * IN_ALL).collect()
    out: dict[str, list[str]] = {k: [] for k in counts}
    for row in sorted(chosen, key=lambda r: (r["lang"], r["u"], r["text"])):
        out[row["lang"]].append(row["text"])
    return out


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row.

    A null text or one without letters is `und` with score 0 and rejected. Where no row can be learned from, all are
    `und`. Ties go to the first language by name. Repeated rows give repeated results. Columns besides doc_id, text and
    lang are not read, and lang only for training.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), *(["lang"] if model is None else []))
    if model is None:
        model = fit(training_sample(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                lang, p, rejected = shared.value.predict([t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(p, pa.float64()), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return with_package(rows).mapInArrow(_text.lean(score), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def recognised(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs without the rows whose text is rejected; all columns stay and no row moves."""
    if model is None:
        model = fit(training_sample(docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                rejected = shared.value.predict([t or "" for t in part.column(at).to_pylist()])[2]
                yield part.filter(pa.array(~rejected))

    return with_package(docs).mapInArrow(_text.lean(keep), docs.schema)


def op3(spark, sf_dir):
    return identify(documents(spark, sf_dir))
