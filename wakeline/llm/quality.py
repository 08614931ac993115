"""Quality rules: a linear-chain conditional random field labels lines, Viterbi decoding and the content share decide.

Each line with a word gets binary features of its look (symbols, capitals, repetition, length, ending, and so on). A
chain of two labels, content and boilerplate, with weights for features, label changes and the first label is fitted by
maximum likelihood (forward-backward, Adam) on a bounded sample of labelled documents: the lines of a document of
quality 1 count as content, those of a document of quality 0 as boilerplate. As the lines of a document all bear its
label, sequences in which the label changes are put together: a run of lines of a document of one quality is set into
one of the other. The best label sequence of a text gives the share of its words in content lines; a text is kept if it
passes the base rules and the share is high enough.

Words are runs of characters other than space and \\t \\n \\v \\f \\r. Edge cases: a null text counts as empty; texts of fewer
than 20 words, so empty and blank ones, fail the base rules; without labels of both kinds every text has content share
1; repeated rows are judged alike (the least text of a repeated doc_id is learned from); null doc_ids are kept; extra
columns pass through `judge` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.llm.common import WordHash, shingle_hashes

SPACES = " \t\n\v\f\r"
#: The characters of `[#*$%&|<>]`.
CLASS = "#*$%&|<>"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Bounds of the sample that the field is fitted on: documents of each quality, lines and characters of one.
MAX_DOCS, MAX_LINES, MAX_CHARS = 400, 48, 20_000
GLUED_LINES = 16  # of each of the two documents of a sequence put together
CONTENT_SHARE, STEPS, RATE, RIDGE = 0.35, 120, 0.1, 1e-3

FEATURES = ("bias", "repeated", "symbols>2%", "symbols>8%", "capitals>20%", "capitals>60%", "digits>20%", "bars", "bangs", "words<4", "words>=12", "few different words", "long words", "ends a sentence", "first", "mean word < 3")


def line_features(line: str, repeated: bool, first: bool) -> list[float]:
    b = line.encode("utf-8", "replace")
    w = b.split()
    n, size = len(w), max(1, len(b))
    symbols = size - len(b.translate(None, b"#*$%&|<>"))
    capitals = size - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = size - len(b.translate(None, b"0123456789"))
    mean = size / max(1, n)
    return [
        1.0, repeated, symbols > 0.02 * size, symbols > 0.08 * size, capitals > 0.2 * size, capitals > 0.6 * size, digits > 0.2 * size,
        b.count(b"|") * 4 > n, b.count(b"!") * 4 > n, n < 4, n >= 12, len(set(w)) * 2 < n, mean > 11, b.rstrip()[-1:] in (b".", b"?", b":", b'"'), first, mean < 4,
    ]


def content_lines(text: str) -> list[tuple[str, bool]]:
    """The lines with a word, and whether each is equal to an earlier one."""
    out, seen = [], set()
    for line in text.split("\n"):
        if line.strip(SPACES):
            out.append((line, line in seen))
            seen.add(line)
    return out


def featured(lines: list[tuple[str, bool]]) -> np.ndarray:
    return np.array([line_features(x, r, i == 0) for i, (x, r) in enumerate(lines)], np.float64).reshape(len(lines), len(FEATURES))


@dataclass
class LineField:
    """Weights for label 1 (boilerplate) against label 0 (content), of label changes [from, to] and of the first label."""

    weights: np.ndarray
    change: np.ndarray
    start: np.ndarray


def viterbi(field: LineField, x: np.ndarray) -> np.ndarray:
    """The best label sequence; content on ties."""
    one = (x @ field.weights).tolist()
    (c00, c01), (c10, c11) = field.change.tolist()
    a, b = field.start.tolist()
    a, b, back = a, b + (one[0] if one else 0.0), []
    for s in one[1:]:
        fa, fb = b + c10 > a + c00, b + c11 > a + c01
        a, b = (b + c10 if fa else a + c00), (b + c11 if fb else a + c01) + s
        back.append((fa, fb))
    out = [b > a] if one else []
    for fa, fb in reversed(back):
        out.append(fb if out[-1] else fa)
    return np.array(out[::-1], bool)


def fit_field(docs: list[list[tuple[np.ndarray, int]]] | list[tuple[np.ndarray, np.ndarray]]) -> LineField:
    """Maximum likelihood for (features, labels) of whole line sequences, all at once."""
    docs = [(x, y) for x, y in docs if len(y)]
    n, most, k = len(docs), max(len(y) for _, y in docs), len(FEATURES)
    x, y, live = np.zeros((n, most, k)), np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, (a, b) in enumerate(docs):
        x[i, : len(b)], y[i, : len(b)], live[i, : len(b)] = a, b, True
    theta = np.zeros(k + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    both = live[:, 1:]
    gold = np.zeros_like(theta)
    gold[:k] = (x * (y * live)[..., None]).sum((0, 1))
    for p in (0, 1):
        for q in (0, 1):
            gold[k + 2 * p + q] = ((y[:, :-1] == p) & (y[:, 1:] == q) & both).sum()
        gold[k + 4 + p] = (y[:, 0] == p).sum()
    for step in range(1, STEPS + 1):
        w, c, s = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :]
        e = np.zeros((n, most, 2))
        e[..., 1] = x @ w
        alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        alpha[:, 0] = s + e[:, 0]
        for t in range(1, most):
            alpha[:, t] = np.where(live[:, t, None], np.logaddexp(alpha[:, t - 1, 0, None] + c[0], alpha[:, t - 1, 1, None] + c[1]) + e[:, t], alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            go = beta[:, t + 1] + e[:, t + 1]
            beta[:, t] = np.where(live[:, t + 1, None], np.logaddexp(go[:, :1] + c[:, 0], go[:, 1:] + c[:, 1]), 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        mass = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
        expected = np.zeros_like(theta)
        expected[:k] = (x * mass[..., 1:]).sum((0, 1))
        for p in (0, 1):
            for q in (0, 1):
                expected[k + 2 * p + q] = (np.exp(alpha[:, :-1, p] + c[p, q] + e[:, 1:, q] + beta[:, 1:, q] - z[:, None]) * both).sum()
            expected[k + 4 + p] = mass[:, 0, p].sum()
        g = (gold - expected) / n - RIDGE * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LineField(theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :])


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MAX_DOCS) -> LineField | None:
    """Fit on at most `most` drawn documents of each quality (those of more than MAX_CHARS characters are passed over),
    MAX_LINES lines of each, and on as many sequences put together."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality")).where(F.col("_id").isNotNull() & F.col("_quality").isin(0, 1))
    known = known.groupBy("_id").agg(F.max("_quality").alias("_quality"))
    pick = lambda q: known.where(F.col("_quality") == q).orderBy(F.xxhash64("_id"), "_id").limit(most)
    texts = docs.select(F.col("doc_id").alias("_id"), "text").where(F.length("text").between(1, MAX_CHARS))
    rows = texts.join(F.broadcast(pick(0).unionAll(pick(1))), "_id").groupBy("_id", "_quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["_id"])
    good, bad = ([[x for x, _ in content_lines(r["text"])] for r in rows if r["_quality"] == q] for q in (1, 0))
    if not good or not bad:
        return None
    data = [sequence([(lines[:MAX_LINES], y)]) for y, part in enumerate((good, bad)) for lines in part]
    for i in range(max(len(good), len(bad))):
        pair = (good[i % len(good)][:GLUED_LINES], 0), (bad[i % len(bad)][:GLUED_LINES], 1)
        (outer, y), (inner, z) = pair if i % 2 else pair[::-1]
        cut = (i // 2) % (len(outer) + 1)
        data.append(sequence([(outer[:cut], y), (inner, z), (outer[cut:], y)]))
    return fit_field(data)


def sequence(parts: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of runs of lines, one after the other, each with its label."""
    lines = content_lines("\n".join(x for run, _ in parts for x in run))
    return featured(lines), np.repeat([y for _, y in parts], [len(run) for run, _ in parts])


def repeated_words(words: list[bytes], ids: np.ndarray) -> int:
    """Words that lie in a window of eight words found twice or more; hashes propose, the words themselves confirm."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = shingle_hashes(ids, WINDOW)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    found: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(twice):
        found.setdefault(tuple(words[i : i + WINDOW]), []).append(int(i))
    edge = np.zeros(len(words) + 1, np.int64)
    for at in found.values():
        if len(at) > 1:
            np.add.at(edge, at, 1)
            np.add.at(edge, np.array(at) + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None, hashes: WordHash, field: LineField | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    lines = content_lines(text)
    share = 1.0 if lines else 0.0
    if lines and field is not None:
        size = np.array([len(x.encode("utf-8", "replace").split()) for x, _ in lines])
        share = float(size[~viterbi(field, featured(lines))].sum() / size.sum())
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, CLASS)), sum(r for _, r in lines), repeated_words(words, hashes.array(words)), share


MEASURES = (("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("content_share", T.DoubleType()))


def _measured(field: LineField | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            rows = [measure(t.as_py(), hashes, field) for t in batch.column("text")]
            new = [pa.array([r[i] for r in rows], pa.float64() if i == 5 else pa.int64()) for i in range(len(MEASURES))]
            keep = [c for c in batch.schema.names if c not in dict(MEASURES)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], [*keep, *dict(MEASURES)])

    return run


def judge(docs: DataFrame, field: LineField | None, share: float = CONTENT_SHARE) -> DataFrame:
    """All columns of `docs` (those named like new ones are replaced) with the measures, base_failed and kept."""
    docs = docs.drop("base_failed", "kept")
    schema = T.StructType([f for f in docs.schema if f.name not in dict(MEASURES)] + [T.StructField(k, t) for k, t in MEASURES])
    out = docs.mapInArrow(_measured(field), schema)
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= share))
