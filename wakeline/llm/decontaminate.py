"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH, exact verification.

A document leaks an item if some run of its words is within `floor((1 - similarity) * words of the item)` word edits of
it. Words are runs of letters, digits and non-ASCII characters, lower-cased.

* Every start in a document opens one window per item length. A count filter drops windows that share too few word pairs
  with the items of their length to lie within the bound: d edits destroy at most 2d pairs, so nothing that could match
  is lost.
* The words of a window drive random walks (the embedding of Chakraborty, Goldenberg and Koucky): step j writes the
  current word and moves on by a random bit of (j, word), so that a small edit distance becomes a small Hamming distance.
* `repetitions` samples of a few steps of a walk form keys; items with a key in common are candidates. Walks over
  documents end with the item-sized window, as those over items do. The number of repetitions is the least whose
  simulated miss rate is within the target for each edit type and length class of copies edited at the bound.
* Candidates are verified by the exact semi-global edit distance around the window. An item too short for an edit is
  found by the hash of its words.

Items are taken in blocks of at most `ITEM_BLOCK`, each one pass over the documents, so the index that travels to the
executors is bounded. Edge cases: null or empty texts and documents without doc_id leak nothing (the latter cannot be
named); items with a null id, without words or with fewer than `min_words` words are not searched for; repeated rows give
one pair; other columns are ignored; an empty table gives no rows. A target recall that `MOST_REPETITIONS` samples cannot
reach is an error.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import WordHash, checked_join, materialise, mix, shingle_hashes

SIMILARITY, TARGET_RECALL, MIN_WORDS, ITEM_BLOCK = 0.8, 0.99, 1, 4000
WALKS, SAMPLED, MOST_REPETITIONS, REACH = 16, 3, 4096, 1.6
PAD, CLASSES, SIMULATED, TRIED, EDIT_TYPES = np.uint64(1), 4, 64, 64, ((0, 1, 2), (0,), (1,), (2,))  # 0 replaces, 1 inserts, 2 deletes
BATCH_WORDS, BATCH_STARTS, BITMAP, UNKNOWN = 500_000, 4096, 1 << 22, 2
_SPACES = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACES).split()


def bound(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


def walk(flat: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first steps of the walk from each start, and how far from the start each was; a pad word follows the end."""
    pos, out, far = start.astype(np.int64), np.empty((len(start), steps), np.uint64), np.empty((len(start), steps), np.int32)
    multiplier = mix(np.arange(seed * 100_003 + 1, seed * 100_003 + 1 + steps, dtype=np.uint64)) | np.uint64(1)
    for j in range(steps):
        inside = pos < end
        out[:, j] = np.where(inside, flat[np.minimum(pos, len(flat) - 1)], PAD)
        far[:, j] = pos - start
        pos += (out[:, j] * multiplier[j] >> np.uint64(63)).astype(np.int64) & inside
    return out, far


def steps_of(length: int) -> int:
    return max(SAMPLED, int(REACH * length))


@lru_cache(65_536)
def sampled_steps(length: int, repetition: int) -> np.ndarray:
    return np.sort(np.random.default_rng([length, repetition, 7]).choice(steps_of(length), SAMPLED, replace=False))


def key_of(symbols: np.ndarray, length: int, repetition: int) -> np.ndarray:
    h = np.full(len(symbols), (length << 20) + repetition, np.uint64)
    for c in range(symbols.shape[1]):
        h = mix(h ^ symbols[:, c]) + np.uint64(c)
    return h


def pair_hash(flat: np.ndarray) -> np.ndarray:
    return (flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)


@dataclass
class Index:
    ids: np.ndarray  # item ids
    words: list[np.ndarray]  # word hashes of each item
    pairs: np.ndarray  # bitmap of the word pairs
    keys: np.ndarray  # sorted keys, and the item of each
    owner: np.ndarray
    repetitions: dict[int, int]  # by item length
    similarity: float
    vocabulary: dict[bytes, int]  # hashes of the words of all items
    seen: np.ndarray  # bitmap of the keys
    pair_keys: np.ndarray  # sorted word pairs, and the lengths of the items that have each, a bit for each of `bit`
    pair_lengths: np.ndarray
    bit: dict[int, int]
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: sorted hashes of items without room for an edit, and their items

    def array(self, words: list[bytes]) -> np.ndarray:
        """Hashes of words; those in no item are all alike, as they match nothing."""
        return np.fromiter(map(self.vocabulary.get, words, repeat(UNKNOWN)), np.uint64, len(words))


def found_by_walk(items: list[np.ndarray], similarity: float, what: tuple[int, ...], rng: random.Random) -> np.ndarray:
    """The chance (copy, walk) that one key of the walk finds an item in a copy edited at the bound.

    Copies stand between unknown words, as in a document; every start that passes the count filter of `find` is tried.
    """
    unknown = lambda k: [np.uint64(rng.getrandbits(63) | 2) for _ in range(k)]
    draw, own = np.random.default_rng(rng.getrandbits(32)), [items[c * len(items) // SIMULATED] for c in range(SIMULATED)]
    texts, starts, at = [], [], 0
    for w in own:
        m, k = len(w), bound(len(w), similarity)
        edited = list(w)
        for _ in range(k):
            where, op = rng.randrange(len(edited)), rng.choice(what)
            edited[where : where + (op != 1)] = unknown(op != 2)
            edited = edited or unknown(1)
        text = np.array(unknown(2 * k) + edited + unknown(2 * m + 3 * k), np.uint64)
        hit = np.concatenate([[0], np.cumsum(np.isin(pair_hash(text), pair_hash(w)))])
        start = np.arange(4 * k + 1)
        starts.append(at + start[hit[start + m + k - 1] - hit[start] >= m - 1 - 2 * k])
        texts.append(text)
        at += len(text)
    size, tries = np.array([len(w) for w in own]), np.array([len(x) for x in starts])
    first, split = np.concatenate([[0], np.cumsum(size)[:-1]]), np.concatenate([[0], np.cumsum(tries)])
    triples = [np.array([draw.choice(steps_of(m), SAMPLED, replace=False) for _ in range(TRIED)]) for m in size]
    clean, flat, start, steps, out = np.concatenate(own), np.concatenate(texts), np.concatenate(starts), steps_of(size.max()), np.zeros((SIMULATED, WALKS))
    for s in range(WALKS):
        ours, theirs = walk(clean, first, first + size, steps, s)[0], walk(flat, start, start + np.repeat(size, tries), steps, s)[0]
        for c in range(SIMULATED):
            out[c, s] = (theirs[split[c] : split[c + 1]] == ours[c])[:, triples[c]].all(2).any(0).mean()
    return out


def repetitions_for(items: list[np.ndarray], similarity: float, target: float) -> dict[int, int]:
    """For each item length, the least number of samples whose miss rate is at most 1 - target for every edit type.

    The chance differs between copies, so the rate is the mean of the misses, not the miss at the mean chance; repetitions
    share the walks evenly.
    """
    rng, ordered, out = random.Random(5), sorted(items, key=len), {}
    for rows in np.array_split(np.arange(len(ordered)), CLASSES):
        if not len(rows):
            continue
        group = [ordered[i] for i in rows]
        missed = [np.log1p(-np.minimum(found_by_walk(group, similarity, what, rng), 1 - 1e-9)).sum(1) for what in EDIT_TYPES]
        enough = lambda each: all(np.exp(each * x).mean() <= 1 - target for x in missed)
        low, high = 0, MOST_REPETITIONS // WALKS
        if not enough(high):
            raise ValueError(f"recall {target} needs more than {MOST_REPETITIONS} samples for items of {len(group[0])} to {len(group[-1])} words")
        while low + 1 < high:
            each = (low + high) // 2
            low, high = (low, each) if enough(each) else (each, high)
        for w in group:
            out[len(w)] = max(high * WALKS, out.get(len(w), 0))
    return out


def build_index(items: list[tuple[int, str]], similarity: float = SIMILARITY, target: float = TARGET_RECALL, min_words: int = MIN_WORDS) -> Index | None:
    h = WordHash()
    kept = [(i, w) for i, t in items if i is not None and len(w := h.array(words_of(t))) >= max(1, min_words)]
    if not kept:
        return None
    words = [w for _, w in kept]
    long = [k for k, w in enumerate(words) if bound(len(w), similarity)]
    bit = {m: i % 64 for i, m in enumerate(sorted({len(words[k]) for k in long}))}
    none = np.zeros(0, np.uint64)
    pair, has = (np.concatenate([none, *x]) for x in ([pair_hash(words[k]) for k in long], [np.full(len(words[k]) - 1, 1 << bit[len(words[k])], np.uint64) for k in long]))
    pair_keys, at = np.unique(pair, return_inverse=True)
    pair_lengths = np.zeros(len(pair_keys), np.uint64)
    np.bitwise_or.at(pair_lengths, at, has)
    pairs = np.zeros(BITMAP, np.bool_)
    pairs[(pair_keys & np.uint64(BITMAP - 1)).astype(np.int64)] = True
    r, keys, owner = repetitions_for([words[k] for k in long], similarity, target), [none], []
    for k in long:
        w = words[k]
        one = [walk(w, np.zeros(1, np.int64), np.array([len(w)]), steps_of(len(w)), s)[0] for s in range(WALKS)]
        keys += [key_of(one[rep % WALKS][:, sampled_steps(len(w), rep)], len(w), rep) for rep in range(r[len(w)])]
        owner += [k] * r[len(w)]
    keys, owner = np.concatenate(keys), np.array(owner, np.int64)
    order = np.argsort(keys, kind="stable")
    seen = np.zeros(BITMAP, np.bool_)
    seen[(keys & np.uint64(BITMAP - 1)).astype(np.int64)] = True
    short = {}
    for m in {len(w) for w in words} - set(bit):
        own = np.array([k for k, w in enumerate(words) if len(w) == m])
        h_m = np.array([shingle_hashes(words[k], m)[0] for k in own])
        by = np.argsort(h_m, kind="stable")
        short[m] = (h_m[by], own[by])
    return Index(np.array([i for i, _ in kept], np.int64), words, pairs, keys[order], owner[order], r, similarity, dict(h), seen, pair_keys, pair_lengths, bit, short)


def edits(items: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Least edit distance between each item and a run of its region; 0 pads a region and matches nothing."""
    d = np.zeros((len(items), regions.shape[1] + 1), np.int32)
    step = np.arange(d.shape[1], dtype=np.int32)
    for i in range(items.shape[1]):
        t = d + 1
        t[:, 1:] = np.minimum(t[:, 1:], d[:, :-1] + (regions != items[:, i : i + 1]))
        d = np.minimum.accumulate(t - step, axis=1) + step
    return d.min(1)


def matches(keys: np.ndarray, owner: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in `wanted`, owner) of every equal key of a sorted list."""
    lo, hi = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
    count = hi - lo
    return np.repeat(np.arange(len(wanted)), count), owner[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]


def _exact(index: Index, flat: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """(start, item) of the items without room for an edit."""
    out = []
    for m, (keys, owner) in index.short.items():
        if len(end) >= m:
            start = np.flatnonzero(np.arange(len(end)) + m <= end)
            at, item = matches(keys, owner, shingle_hashes(flat[: len(end)], m)[start])
            out.append(np.column_stack([start[at], item]))
    return out


def _by_walk(index: Index, flat: np.ndarray, first: np.ndarray, n: np.ndarray, doc: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """(start, item) of the windows that pass the count filter and share a key with an item."""
    lengths = sorted(index.bit)
    if not lengths:
        return []
    pair = pair_hash(flat)
    hit = np.zeros(len(flat), np.int32)
    hit[1:] = index.pairs[(pair & np.uint64(BITMAP - 1)).astype(np.int64)]
    hit[first[1:][n > 0]] = 0  # a pair does not reach over the end of a document
    hit = np.cumsum(hit, dtype=np.int32)
    need = {m: m - 1 - 2 * bound(m, index.similarity) for m in lengths}
    least, used = max(0, min(need.values())), n > 0
    used[used] = (hit[np.maximum(first[1:] - 1, 0)] - hit[first[:-1]])[used] >= least
    alive = np.flatnonzero(np.repeat(used, n)).astype(np.int32)
    open_ = {}
    for group in (lengths[i : i + 8] for i in range(0, len(lengths), 8)):
        # What all of these lengths need, within the window of the longest; then each length by itself.
        widest = max(m + bound(m, index.similarity) for m in group)
        some = alive[hit[np.minimum(alive + (widest - 1), end[alive] - 1)] - hit[alive] >= min(need[m] for m in group)]
        for m in group:
            k = bound(m, index.similarity)
            upto = np.minimum(some + (m + k), end[some])
            ok = (hit[upto - 1] - hit[some] >= need[m]) & (upto - some >= m - k)
            if ok.any():
                open_[m] = some[ok], upto[ok]
    if not open_:
        return []
    # The same count once more with the pairs of the items of just that length, over the words of open windows.
    cover = np.zeros(len(flat) + 1, np.int32)
    for s, upto in open_.values():
        cover += np.bincount(s, minlength=len(cover)).astype(np.int32) - np.bincount(upto, minlength=len(cover)).astype(np.int32)
    inside = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
    rank = np.zeros(len(flat), np.int32)
    rank[inside] = np.arange(len(inside), dtype=np.int32)
    own = pair[np.maximum(inside, 1) - 1]
    place = np.minimum(np.searchsorted(index.pair_keys, own), len(index.pair_keys) - 1)
    has = np.where((index.pair_keys[place] == own) & (inside > first[doc[inside]]), index.pair_lengths[place], np.uint64(0))
    windows = {}
    for m, (s, upto) in open_.items():
        count = np.cumsum(has >> np.uint64(index.bit[m]) & np.uint64(1), dtype=np.int32)
        s = s[count[rank[upto - 1]] - count[rank[s]] >= need[m]]
        if len(s):
            windows[m] = s
    if not windows:
        return []
    chosen, starts = [], np.unique(np.concatenate(list(windows.values())))
    for at in range(0, len(starts), BATCH_STARTS):  # bounded memory
        part = starts[at : at + BATCH_STARTS]
        here = {m: np.searchsorted(part, s[(s >= part[0]) & (s <= part[-1])]) for m, s in windows.items()}
        longest = max((m for m in here if len(here[m])), default=0)
        for seed in range(WALKS):  # one at a time
            word, far = walk(flat, part, end[part], steps_of(longest), seed)
            for m, rows in here.items():
                if not len(rows):
                    continue
                steps = steps_of(m)
                own = np.where(far[rows, :steps] < m, word[rows, :steps], PAD).T.copy()
                for rep in range(seed, index.repetitions[m], WALKS):
                    key = key_of(own[sampled_steps(m, rep)].T, m, rep)
                    maybe = np.flatnonzero(index.seen[(key & np.uint64(BITMAP - 1)).astype(np.int64)])
                    if len(maybe):
                        row, item = matches(index.keys, index.owner, key[maybe])
                        chosen.append(np.column_stack([part[rows[maybe[row]]], item]))
    return chosen


def find(index: Index, docs: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(document, item, edits) of every leak found; documents and items by position."""
    n = np.array([len(d) for d in docs])
    if not n.sum():
        return []
    flat = np.concatenate([*docs, np.zeros(1, np.uint64)])
    first = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), n)
    end = first[doc + 1]
    chosen = _exact(index, flat, end) + _by_walk(index, flat, first, n, doc, end)
    if not chosen:
        return []
    cand = np.unique(np.concatenate(chosen), axis=0)
    size = np.array([len(w) for w in index.words])
    slack = np.array([bound(m, index.similarity) for m in size])
    _, one = np.unique(np.column_stack([doc[cand[:, 0]], cand[:, 1], cand[:, 0] // np.maximum(1, slack[cand[:, 1]])]), axis=0, return_index=True)
    cand, best = cand[one], {}
    for m in np.unique(size[cand[:, 1]]):
        rows, k = cand[size[cand[:, 1]] == m], bound(int(m), index.similarity)
        for at in range(0, len(rows), BATCH_STARTS // 4):
            s, item = rows[at : at + BATCH_STARTS // 4].T
            where = s[:, None] + np.arange(-2 * k - 1, m + 2 * k + 1)
            inside = (where >= first[doc[s]][:, None]) & (where < end[s][:, None])
            region = np.where(inside, flat[np.clip(where, 0, len(flat) - 1)], np.uint64(0))
            d = edits(np.array([index.words[i] for i in item]), region)
            for x, i, e in zip(doc[s[d <= k]], item[d <= k], d[d <= k]):
                best[x, i] = min(int(e), best.get((x, i), 1 << 30))
    return [(int(x), int(i), e) for (x, i), e in best.items()]


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, ids, n, out = [], [], 0, []
            texts, names = batch.column("text"), batch.column("doc_id").to_pylist()
            for at, name in enumerate(names):
                held.append(index.array(words_of(texts[at].as_py())))
                ids.append(name)
                n += len(held[-1])
                if n >= BATCH_WORDS or at == len(names) - 1:
                    out += [(ids[d], int(index.ids[i]), e, len(index.words[i])) for d, i, e in find(index, held)]
                    held, ids, n = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["doc_id", "item_id", "edits", "item_words"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, target: float = TARGET_RECALL, min_words: int = MIN_WORDS, block: int = ITEM_BLOCK) -> DataFrame:
    """doc_id, item_id, edits (least word edits), item_words: one row per document and leaked item."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and length(text) > 0")
    schema = "doc_id long, item_id long, edits long, item_words long"
    out, held = docs.sparkSession.createDataFrame([], schema), []

    def search() -> DataFrame:
        index = build_index(held, similarity, target, min_words)
        return out.unionAll(docs.mapInArrow(_search(index), schema)) if index else out

    for row in benchmark.select("item_id", "text").where("item_id is not null").orderBy("item_id").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        if len(held) == block:
            out, held = search(), []
    if held:
        out = search()
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.min("item_words").alias("item_words"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of `docs` that leak no item; rows without doc_id stay."""
    gone = materialise(leaks(docs, benchmark, **parameters).select("doc_id").distinct())
    return checked_join(docs, gone, "doc_id", "left_anti")
