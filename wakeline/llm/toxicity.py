"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic texts and one on windows of ordinary texts. A window is
compressed once behind the ordinary dictionary and once behind both, the toxic one in front: what the second saves, only
the toxic dictionary can have saved. The savings of a text's windows are summed up in a few features, and a logistic
calibration fitted on documents that neither dictionary has seen turns them into a score.

Most of a toxic text is ordinary, so the toxic dictionary is trained on the windows that matter, which compression itself
picks: each half of the toxic texts trains a dictionary, the other half is compressed behind it, and the windows that
save more than ordinary windows do (the cut with the widest gap between the two shares) are what the next round trains
on. Copies of a text would make ordinary windows look telling, so a text whose word 4-grams were mostly seen before
teaches nothing.

Edge cases: a null or empty text (or one without words) has no windows and gets the calibrated score of a text without
evidence; repeated rows are scored alike; other columns pass through `score_toxicity` (its own two, `score` and
`predicted`, replace columns of these names); an empty label table, or one with a single class, gives a constant score
of 0; of rows that repeat a doc_id the least text is learned from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW_BYTES = 24
#: Bytes of each dictionary, and the segment and pattern sizes that the trainer takes them from.
ORDINARY_BYTES, ORDINARY_TRAIN = 64 * 1024, {"k": 24, "d": 6}
TOXIC_BYTES, TOXIC_TRAIN = 4 * 1024, {"k": 16, "d": 6}
LEVEL = 3  # of the dictionary trainer
#: Rounds of picking windows, and the share of ordinary windows that must save less than a picked one.
ROUNDS, USUAL = 3, 0.99
#: Bounds of the sample of labelled rows that a model is fitted on: documents of each class drawn, and the characters
#: beyond which a drawn document is passed over.
MAX_TOXIC, MAX_ORDINARY, MAX_FIT_CHARS = 2000, 3000, 20_000
#: A window counts as suspicious when the toxic dictionary saves this many bytes.
STEPS = (2, 3, 4, 5, 6)
FOLDS = 2
#: Every window begins with the end of the dictionaries and ends in its first half: a block that gains less than two
#: bytes would be stored as it is, and the search does not look for matches in the last bytes of its input.
ANCHOR = b"\x01\x02\x03\x04\x05\x06\x07\x0b\x0c\x0e\x0f\x10\x11\x12\x13\x14" * 2
#: zstandard's search for matches: short ones count, as single words decide.
SEARCH = {"strategy": zstd.STRATEGY_BTLAZY2, "min_match": 4, "search_log": 7, "hash_log": 17, "chain_log": 18, "window_log": 17, "target_length": 64}


def windows(text: str | None, width: int = WINDOW_BYTES) -> list[bytes]:
    """The whole text, lower-cased, cut at white space into pieces of about `width` bytes."""
    out, piece, size = [], [], 0
    for w in (text or "").lower().encode("utf-8", "replace").split():
        if len(w) > 4 * width:
            if piece:
                out.append(b" " + b" ".join(piece))
                piece, size = [], 0
            out += [w[i : i + width] for i in range(0, len(w), width)]
            continue
        piece.append(w)
        size += len(w) + 1
        if size >= width:
            out.append(b" " + b" ".join(piece))
            piece, size = [], 0
    if piece:
        out.append(b" " + b" ".join(piece))
    return out


@dataclass
class ToxicityModel:
    toxic_dict: bytes
    ordinary_dict: bytes
    weights: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    constant: float | None = None


class _Lengths:
    """Compressed lengths of windows behind the ordinary dictionary of a model, and behind both."""

    def __init__(self, model: ToxicityModel):
        self.pair = []
        for raw in (model.ordinary_dict, model.toxic_dict + model.ordinary_dict):
            d = zstd.ZstdCompressionDict(raw + ANCHOR, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=zstd.ZstdCompressionParameters(**SEARCH))
            self.pair.append(zstd.ZstdCompressor(dict_data=d, compression_params=zstd.ZstdCompressionParameters(**SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)).compress)

    def differences(self, pieces: list[bytes]) -> np.ndarray:
        o, t = self.pair
        tail = ANCHOR[: len(ANCHOR) // 2]
        return np.fromiter((len(o(w)) - len(t(w)) for w in (ANCHOR + p + tail for p in pieces)), np.float64, len(pieces))


def features(diff: np.ndarray) -> list[float]:
    n = len(diff)
    if not n:
        return [0.0] * (5 + 2 * len(STEPS))
    top = np.sort(diff)[::-1][:4]
    over = [float((diff >= s).sum()) for s in STEPS]
    return [float(top[0]), float(top.sum() / 4), float(diff.mean()), math.log1p(n), float(np.maximum(diff - 1, 0).mean()), *map(math.log1p, over), *(math.sqrt(x / n) for x in over)]


def trained(pieces: list[bytes], size: int, parameters: dict) -> bytes:
    """A dictionary trained on windows; the windows themselves where there are too few to train on."""
    try:
        return zstd.train_dictionary(size, pieces, level=LEVEL, **parameters).as_bytes()
    except zstd.ZstdError:
        return b"".join(dict.fromkeys(pieces))[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Newton steps for a ridge logistic regression; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge * len(y) / 100)
    pen[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-9), x.T @ (p - y) + pen * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fresh(texts: list[str]) -> list[str]:
    """The texts without those of which most word 4-grams stand in an earlier one."""
    seen, out = set(), []
    for text in texts:
        w = (text or "").lower().split()
        grams = {hash(" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3))}
        if 2 * len(grams & seen) <= len(grams):
            out.append(text)
        seen |= grams
    return out


def telling(savings: np.ndarray, usual: np.ndarray) -> float:
    """The least saving at which windows of toxic texts stand out most from ordinary windows."""
    least = max(2.0, float(np.quantile(usual, USUAL)) if len(usual) else 2.0)

    def gap(cut: float) -> float:
        bad, good = (savings >= cut).mean(), (usual >= cut).mean() if len(usual) else 0.0
        return (bad - good) ** 2 / (bad + good + 1e-9)

    return max((least + i for i in range(10)), key=lambda c: (gap(c), -c))


def dictionaries(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """The two dictionaries, the toxic one trained on the windows that the halves of the toxic texts pick for each other."""
    plain, bad = ([[windows(t) for t in part[h::2]] for h in (0, 1)] for part in (fresh(ordinary), fresh(toxic)))
    plain, bad = ([[p for text in half for p in text] for half in part] for part in (plain, bad))
    base = [trained(plain[1 - h], ORDINARY_BYTES, ORDINARY_TRAIN) for h in (0, 1)]  # for the half that it has not seen
    picked = bad
    for _ in range(ROUNDS):
        new = []
        for h in (0, 1):
            lengths = _Lengths(ToxicityModel(trained(picked[1 - h], TOXIC_BYTES, TOXIC_TRAIN), base[h]))
            saved = lengths.differences(bad[h])
            cut = telling(saved, lengths.differences(plain[h])) if len(saved) else 0.0
            new.append([p for p, x in zip(bad[h], saved) if x >= cut])
        picked = new
    return ToxicityModel(trained(picked[0] + picked[1], TOXIC_BYTES, TOXIC_TRAIN), trained(plain[0] + plain[1], ORDINARY_BYTES, ORDINARY_TRAIN))


def fit(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """Dictionaries from all labelled texts; the calibration from texts left out in turn (`FOLDS` parts)."""
    if len(toxic) < 2 * FOLDS or len(ordinary) < 2 * FOLDS:
        return ToxicityModel(b"", b"", constant=0.0)
    x, y = [], []
    for k in range(FOLDS):
        rest = [[t for i, t in enumerate(part) if i % FOLDS != k] for part in (toxic, ordinary)]
        lengths = _Lengths(dictionaries(*rest))
        for label, part in ((1.0, toxic), (0.0, ordinary)):
            x += [features(lengths.differences(windows(t))) for t in part[k::FOLDS]]
            y += [label] * len(part[k::FOLDS])
    x, y = np.array(x), np.array(y)
    model = dictionaries(toxic, ordinary)
    model.mean, model.scale = x.mean(0).tolist(), (x.std(0) + 1e-9).tolist()
    z = np.column_stack([(x - model.mean) / model.scale, np.ones(len(x))])
    model.weights = _logistic(z, y).tolist()
    return model


def score_texts(model: ToxicityModel, texts: list[str | None]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    lengths = _Lengths(model)
    x = np.array([features(lengths.differences(windows(t))) for t in texts]).reshape(len(texts), -1)
    z = (x - model.mean) / model.scale @ np.array(model.weights[:-1]) + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, where: Column | None = None, most_toxic: int = MAX_TOXIC, most_ordinary: int = MAX_ORDINARY, longest: int = MAX_FIT_CHARS) -> tuple[list[str], list[str]]:
    """The texts of at most so many toxic and ordinary documents, drawn by a hash of doc_id; drawn ones of more than
    `longest` characters are passed over. `where` is a condition on `_id`.

    The labels are sampled first; the sample, bounded by its limits, is then broadcast against the documents. One text
    of each doc_id is collected.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1))
    if where is not None:
        known = known.where(where)
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    pick = lambda k, n: known.where(F.col("_toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = pick(1, most_toxic).unionAll(pick(0, most_ordinary))
    texts = docs.select(F.col("doc_id").alias("_id"), "text").where(F.length("text").between(1, longest))
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["_id"])
    return [r["text"] for r in rows if r["_toxic"] == 1], [r["text"] for r in rows if r["_toxic"] == 0]


def fit_toxicity(docs: DataFrame, labels: DataFrame, where: Column | None = None, **bounds) -> ToxicityModel:
    return fit(*labelled_sample(docs, labels, where, **bounds))


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """A column with the score of each whole text."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(model, [t if isinstance(t, str) else None for t in texts]))

    return score(text)


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """True for the documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """All rows and other columns of `docs` with `score` (0 to 1) and `predicted` (1 where score >= threshold)."""
    return docs.drop("score", "predicted").withColumn("score", toxicity_score(model, F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` that are not predicted toxic; columns as they were."""
    return docs.where(toxicity_score(model, F.col("text")) < threshold)
