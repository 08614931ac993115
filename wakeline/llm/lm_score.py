"""Language-model scores by deleted interpolation of word trigrams.

The probability of a word after two others is a mixture of the trigram, bigram and unigram maximum-likelihood estimates
and a uniform share. The mixture weights depend on how often the context was seen: a bucket for each power of two of the
count of the two words before, or, where these were never seen together, of the count of the word before. They are
learned by expectation-maximisation on held-out counts: a part of the learning documents is left out of the counts for
that step. Scores then use the counts of all learning documents.

Everything is counted over all documents, without a vocabulary limit. Documents are dealt to chunks by a hash and packed,
compressed, one row a chunk. A chunk sends each of its different keys (hashes of words, pairs and triples) once, with its
counts, as packed arrays to the bucket of the key. A bucket adds the counts up and answers each chunk with the totals of
the keys it asked for, so that no table of n-grams is collected or broadcast, and a frequent word is a single entry of
each chunk. Chunks and buckets grow in number with the corpus, not in size, and each is a partition of its own. A worker
takes words, pairs and triples one after the other, sorts in place, and does its arithmetic in slices of a chunk. A key has
as many bits as let two n-grams of the corpus share one with a chance of at most 2**-MARGIN (64 at most). The held-out
statistics that reach the driver are a histogram over levels of counts, whose size does not depend on the corpus.

Tokens are the words (runs of characters other than space and \t \n \v \f \r, A-Z in lower case) and an end token.
Edge cases: a null or empty text has the end token alone; a null doc_id is learned from and scored; repeated rows count
each and are scored alike; other columns are ignored; an empty table gives no rows; where nothing is learned, every token
gets the uniform share.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import WordHash, materialise, mix

PARTS, LEFT_OUT, HELD = 7, 2, 3  # of crc32(doc_id) modulo PARTS: never learned from; used for the weights first
CHUNK_CHARS, BUCKET_CHARS, LEVELS, ROUNDS, MARGIN = 12_000_000, 24_000_000, 40, 60, 20
SLICE = 1 << 18  # tokens of a chunk whose floating-point values are held at once
_END, _START = (xxhash.xxh3_64_intdigest(x) for x in (b"\n", b"\n\n"))  # no word contains white space
_PAIR = np.uint64(0x9E3779B97F4A7C15)
ORDERS = 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % PARTS == LEFT_OUT, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def key_bits(chars: int) -> int:
    return min(64, max(40, math.ceil(math.log2(chars + 1)) + MARGIN))


def flat_tokens(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts one after the other, first token of each text)."""
    hashes = WordHash()
    parts = [np.append(hashes.array(t.lower().split()), np.uint64(_END)) for t in texts]
    flat = np.concatenate([np.zeros(0, np.uint64), *parts])
    return flat, np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)


def shifted(a: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """What stands before each token of a text; `start` stands before the first."""
    out = np.empty_like(a)
    out[1:], out[first] = a[:-1], start
    return out


def joined(context: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Hashes of contexts and the tokens behind them, in the place of the contexts."""
    for a in range(0, len(own), SLICE):
        context[a : a + SLICE] = mix(context[a : a + SLICE] * _PAIR + own[a : a + SLICE])
    return context


def keyed(flat: np.ndarray, first: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """For words, pairs and triples, one after the other: the key of each token. Behind those of words and of pairs stands
    that of the context at the beginning of a text."""
    start, away = np.array([_START], np.uint64), np.uint64(64 - bits)
    own = np.append(flat, start)
    own >>= away
    yield own
    pair, start = joined(shifted(flat, first, start[0]), flat), joined(start.copy(), start)
    own = np.append(pair, start)
    own >>= away
    yield own
    own = joined(shifted(pair, first, start[0]), flat)
    del flat, pair
    own >>= away
    yield own


def fresh(keys: np.ndarray) -> np.ndarray:
    """Which of sorted keys differ from the one before."""
    out = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=out[1:])
    return out


def different(keys: np.ndarray) -> np.ndarray:
    """The sorted different keys; sorts what it is given."""
    keys.sort()
    return keys[fresh(keys)]


def occurring(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different keys and how often each occurs; sorts what it is given."""
    keys.sort()
    at = np.flatnonzero(fresh(keys))
    return keys[at], np.diff(at, append=len(keys)).astype(np.uint32)


def spread(keys: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The total of each key, from those of the sorted different keys."""
    order = np.argsort(keys)
    at = np.cumsum(fresh(keys[order]), dtype=np.int32)
    at -= 1
    out = np.empty(len(keys), total.dtype)
    out[order] = total[at]
    return out


def pack(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return zstd.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes(), 1) if len(a) else b""


def unpack(b: bytes, dtype) -> np.ndarray:
    if not b:
        return np.zeros(0, dtype)
    raw = np.frombuffer(zstd.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def cuts(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where the buckets of sorted keys begin: equal ranges of the keys."""
    edges = np.array([(i << bits) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


PACKED = "chunk long, ids binary, named binary, roles binary, sizes binary, texts binary"


def _pack(table: pa.Table) -> pa.Table:
    texts = [(t or "").encode("utf-8", "replace") for t in table.column("text").to_pylist()]
    ids = table.column("doc_id")
    row = (table.column("chunk")[0].as_py(), pack(ids.fill_null(0).to_numpy()), pack(ids.is_valid().to_numpy().astype(np.uint8)), pack(table.column("role").to_numpy().astype(np.uint8)), pack(np.array([len(t) for t in texts], np.int64)), zstd.compress(b"".join(texts), 3))
    return pa.Table.from_arrays([pa.array([v], pa.binary() if i else pa.int64()) for i, v in enumerate(row)], names=["chunk", "ids", "named", "roles", "sizes", "texts"])


def packed_row(table: pa.Table | pa.RecordBatch, i: int) -> dict:
    """A row of packed documents, without copies of its contents."""
    return {c: table.column(c)[i].as_py() if c == "chunk" else table.column(c)[i].as_buffer() for c in table.schema.names}


def texts_of(row: dict) -> Iterator[bytes]:
    whole, start = zstd.decompress(row["texts"], max_output_size=1 << 40) if row["texts"] else b"", 0
    for size in unpack(row["sizes"], np.int64).tolist():
        yield whole[start : start + size]
        start += size


def _ask(buckets: int, bits: int):
    def asked(row: dict) -> pa.RecordBatch:
        flat, first = flat_tokens(texts_of(row))
        role, out = unpack(row["roles"], np.uint8), []
        of = np.repeat(role, np.diff(np.append(first, len(flat))))
        for kind, own in enumerate(keyed(flat, first, bits)):
            counts = []
            for r in (0, 1):
                mine = own[: len(flat)][of == r]
                if kind < ORDERS - 1:  # the context at the beginning counts once a text
                    mine = np.append(mine, np.repeat(own[-1], (role == r).sum()))
                counts.append(occurring(mine))
                del mine
            keys = different(own)
            for k, (some, times) in enumerate(counts):
                counts[k] = np.zeros(len(keys), np.uint32)
                counts[k][np.searchsorted(keys, some)] = times
            edge = cuts(keys, buckets, bits)
            for b, (lo, hi) in enumerate(zip(edge, edge[1:])):
                if hi > lo:
                    out.append((b * ORDERS + kind, row["chunk"], pack(np.diff(keys[lo:hi], prepend=np.uint64(0))), pack(counts[0][lo:hi]), pack(counts[1][lo:hi])))
            del own, keys, counts, some, times
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "keys", "some", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield asked(packed_row(batch, i))

    return run


ANSWER = ["bucket", "chunk", "some", "every", "n_some", "v_some", "n_every", "v_every"]
ANSWER_SCHEMA = "bucket long, chunk long, some binary, every binary, n_some long, v_some long, n_every long, v_every long"


def _answer(held_from: int, bits: int):
    """Totals for the chunks that asked: of all counts, and of those without the held part for the chunks of that part."""
    start = np.uint64(_START >> (64 - bits))

    def run(table: pa.Table) -> pa.Table:
        bucket, chunks = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
        asked = lambda i: np.cumsum(unpack(table.column("keys")[i].as_py(), np.uint64), dtype=np.uint64)
        all_keys = different(np.concatenate([asked(i) for i in range(len(chunks))]))
        some, every, at = np.zeros(len(all_keys), np.int64), np.zeros(len(all_keys), np.int64), []
        for i in range(len(chunks)):
            at.append(np.searchsorted(all_keys, asked(i)).astype(np.uint32))
            for total, c in ((some, "some"), (every, "some"), (every, "held")):
                total[at[i]] += unpack(table.column(c)[i].as_py(), np.uint32)  # the keys of a chunk differ
        out = [(bucket, c, pack(some[a].astype(np.uint32)) if c >= held_from else b"", pack(every[a].astype(np.uint32)), 0, 0, 0, 0) for c, a in zip(chunks, at)]
        if bucket % ORDERS == 0:
            word = all_keys != start
            out.append((bucket, -1, b"", b"", *(int(f(x[word])) for x in (some, every) for f in (np.sum, np.count_nonzero))))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4))], names=ANSWER)

    return run


def counted(row: dict, answers: pa.Table, which: str, bits: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """For each token of a chunk the counts of the word, of the word before, of the pair, of the two before and of the triple;
    and the first token of each text."""
    flat, first = flat_tokens(texts_of(row))
    place = sorted((b, i) for i, b in enumerate(answers.column("bucket").to_pylist()))
    c = {}
    for kind, (own, name, before) in enumerate(zip(keyed(flat, first, bits), ("word", "pair", "triple"), ("before", "two", None))):
        total = np.concatenate([np.zeros(0, np.uint32), *(unpack(answers.column(which)[i].as_py(), np.uint32) for b, i in place if b % ORDERS == kind)])
        n = spread(own, total)
        c[name] = n[: len(flat)]
        if before:
            c[before] = shifted(c[name], first, n[-1])
        del own
    return c, first


def sliced(c: dict[str, np.ndarray]) -> Iterator[tuple[slice, dict[str, np.ndarray]]]:
    """The counts of some tokens after the other, for arithmetic."""
    for a in range(0, len(c["word"]), SLICE):
        s = slice(a, a + SLICE)
        yield s, {k: x[s].astype(np.float64) for k, x in c.items()}


def level(n: np.ndarray) -> np.ndarray:
    """The bucket of a count: 0 for none, then one for each power of two."""
    return np.minimum(np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))) + 1, 0), LEVELS - 1).astype(np.int64)


def bucket_of(c: dict[str, np.ndarray]) -> np.ndarray:
    """The weight bucket of a token: by the two words before if they were seen, else by the word before."""
    return np.where(c["two"] > 0, LEVELS + level(c["two"]), level(c["before"]))


def estimates(c: dict[str, np.ndarray], n: int, v: int) -> np.ndarray:
    """Trigram, bigram and unigram maximum-likelihood estimates and the uniform share of each token."""
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    return np.column_stack([ratio(c["triple"], c["two"]), ratio(c["pair"], c["before"]), c["word"] / max(1, n), np.full(len(c["word"]), 1 / (v + 1))])


CELL = ["bucket", "l3", "l2", "l1", "tokens", "log3", "log2", "log1"]
SHAPE = (2 * LEVELS, LEVELS, LEVELS, LEVELS)


def _histogram(n: int, v: int, bits: int):
    """Held-out tokens by weight bucket and levels of their counts, with the sums of the logarithms of their estimates."""

    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        cells, sums = [np.zeros(0, np.int64)], [np.zeros((4, 0))]

        def add(cell: np.ndarray, values: list) -> tuple[np.ndarray, np.ndarray]:
            cell, at = np.unique(cell, return_inverse=True)
            return cell, np.array([np.bincount(at, x, len(cell)) for x in values])

        for i in range(packed.num_rows):
            c, _ = counted(packed_row(packed, i), answers, "some", bits)
            for _, part in sliced(c):
                logs = np.log(np.maximum(estimates(part, n, v)[:, :3], 1e-300))
                cell, own = add(np.ravel_multi_index((bucket_of(part), *(level(part[k]) for k in ("triple", "pair", "word"))), SHAPE), [None, *logs.T])
                cells.append(cell)
                sums.append(own)
        cell, own = add(np.concatenate(cells), np.concatenate(sums, axis=1))
        cols = [*np.unravel_index(cell, SHAPE), *own]
        return pa.Table.from_arrays([pa.array(c.astype(np.int64 if i < 5 else np.float64)) for i, c in enumerate(cols)], names=CELL)

    return run


def learn_weights(hist: list[tuple], v: int) -> np.ndarray:
    """Weights of the trigram, bigram, unigram and uniform estimates for each bucket, by EM from equal shares."""
    lam = np.tile([0.3, 0.3, 0.3, 0.1], (2 * LEVELS, 1))
    lam[:LEVELS, 0] = 0  # the two words before were not seen together
    lam[0, 1] = 0  # nor was the word before
    lam /= lam.sum(1, keepdims=True)
    seen = np.zeros(2 * LEVELS, bool)
    if hist:
        h = np.array(hist, np.float64)
        bucket, tokens_ = h[:, 0].astype(int), h[:, 4]
        p = np.column_stack([*(np.where(h[:, i] > 0, np.exp(h[:, 4 + i] / tokens_), 0.0) for i in (1, 2, 3)), np.full(len(h), 1 / (v + 1))])
        seen = np.bincount(bucket, tokens_, 2 * LEVELS) > 0
        for _ in range(ROUNDS):
            post = lam[bucket] * p
            post *= (tokens_ / np.maximum(post.sum(1), 1e-300))[:, None]
            mass = np.column_stack([np.bincount(bucket, post[:, i], 2 * LEVELS) for i in range(4)]) + 1e-3 * (lam > 0)
            lam[seen] = mass[seen] / mass[seen].sum(1, keepdims=True)
    for b in (*range(2, LEVELS), *range(LEVELS + 2, 2 * LEVELS)):  # a bucket without held-out tokens behaves like the one below
        if not seen[b]:
            lam[b] = lam[b - 1]
    return lam


def _score(lam: np.ndarray, n: int, v: int, bits: int):
    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        for i in range(packed.num_rows):
            row = packed_row(packed, i)
            c, first = counted(row, answers, "every", bits)
            base, own = np.empty(len(c["word"])), np.empty(len(c["word"]))
            for s, part in sliced(c):
                base[s] = np.log10((part["word"] + 1) / (n + v + 1))
                own[s] = np.log10((lam[bucket_of(part)] * estimates(part, n, v)).sum(1))
            add = lambda x: np.add.reduceat(x, first)  # noqa: B023, E731
            cols = [add((c["word"] > 0).astype(np.int64)), np.full(len(first), n, np.int64), add(base), add(own)]
            ids = pa.array(unpack(row["ids"], np.int64), mask=unpack(row["named"], np.uint8) == 0)
            parts.append(pa.Table.from_arrays([ids, pa.array(unpack(row["roles"], np.uint8) == 2), pa.array(np.diff(np.append(first, len(c["word"])))), *map(pa.array, cols)], names=SCORED))
        return pa.concat_tables(parts) if parts else pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64())], names=SCORED)

    return run


SCORED = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
SCORED_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now rather than at its next collection.

    The scheduler holds on to the last job, so a job of nothing comes first.
    """
    gc.collect()
    spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram, add-one), score (the mixture)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % PARTS == HELD, F.lit(False))
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits, most, buckets = key_bits(chars), max(4, math.ceil(chars / CHUNK_CHARS)), max(4, math.ceil(chars / BUCKET_CHARS))
    few = max(2, math.ceil(most / PARTS))
    docs = docs.withColumn("role", F.when(held_out(F.col("doc_id")), 2).when(part, 1).otherwise(0))  # 0: counted at once, 1: held for the weights, 2: never learned from
    spread = F.xxhash64("doc_id", F.monotonically_increasing_id())  # rows of one doc_id go to many chunks
    docs = docs.withColumn("chunk", F.when(part, F.lit(most) + F.pmod(spread, F.lit(few))).otherwise(F.pmod(spread, F.lit(most))).cast("long"))
    packed = materialise(docs.repartition(most + few, "chunk").groupBy("chunk").applyInArrow(_pack, PACKED))
    _release(spark)

    asked = packed.mapInArrow(_ask(buckets, bits), "bucket long, chunk long, keys binary, some binary, held binary")
    answers = materialise(asked.repartition(ORDERS * buckets, "bucket").groupBy("bucket").applyInArrow(_answer(most, bits), ANSWER_SCHEMA))
    n_some, v_some, n, v = (x or 0 for x in answers.where("chunk < 0").agg(*(F.sum(c) for c in ANSWER[4:])).first())
    del asked
    _release(spark)

    def together(condition: str, count: str, parts: int):
        ours = packed.where(condition).repartition(parts, "chunk").groupBy("chunk")
        return ours.cogroup(answers.where(condition).select("chunk", "bucket", count).repartition(parts, "chunk").groupBy("chunk"))

    cells = together(f"chunk >= {most}", "some", few).applyInArrow(_histogram(n_some, v_some, bits), "bucket long, l3 long, l2 long, l1 long, tokens long, log3 double, log2 double, log1 double")
    cells = cells.groupBy(*CELL[:4]).agg(*(F.sum(c).alias(c) for c in CELL[4:])).orderBy(*CELL[:4]).collect()
    lam = learn_weights([tuple(r) for r in cells], v_some)
    _release(spark)
    return together("chunk >= 0", "every", most + few).applyInArrow(_score(lam, n, v, bits), SCORED_SCHEMA)
