"""Similarity self-join on word n-grams: MinHash bands propose pairs, a Bayesian test drops them, the rest is verified.

1. Every text gets a fingerprint of its set of word n-grams and a MinHash signature. Texts with equal sets form one
   class and go on as one representative with a weight.
2. Representatives that agree on a whole band of the signature share a bucket. Within a bucket the signatures are
   compared a chunk at a time; a pair is dropped as soon as the posterior probability (uniform prior) that its
   similarity reaches the threshold falls below the tolerance. What survives ties representatives into candidate groups.
3. Within a candidate group all pairs are verified by exact Jaccard similarity of their n-gram sets.

Large buckets and groups are cut into blocks of bounded size, and a task compares two blocks. Pairs never leave a
task: it returns the links counted by document and a spanning forest.

Edge cases: words are runs of non-white-space, lower-cased; a text of fewer than n words has itself as its only n-gram;
a null, empty or blank text has none and is linked to nothing; rows without doc_id are left out; rows that repeat a
doc_id count once, with their least text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import WordHash, checked_join, drop_materialised, materialise, mix, shingle_hashes
from wakeline.llm.graph import components

N, THRESHOLD, TOLERANCE = 5, 0.8, 1e-4
#: 128 MinHash values of 16 bits; 25 bands of 5 find a pair at similarity 0.8 with probability 0.99995.
HASHES, BANDS, BAND_ROWS, CHUNK = 128, 25, 5, 32
BUCKET_BLOCK, GROUP_BLOCK, COLUMNS = 512, 256, 8192
_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_A, _B = _SEEDS[:HASHES] | np.uint64(1), _SEEDS[HASHES:]


def ngrams(text: str | None, words: WordHash, n: int = N) -> np.ndarray:
    """The set of hashed n-grams of a text, sorted."""
    return np.unique(shingle_hashes(words.array((text or "").lower().encode("utf-8", "replace").split()), n))


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values; each is 16 well-mixed bits of the least hash."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 512):
        part = grams[at : at + 512, None] * _A
        part += _B
        np.minimum(least, part.min(0), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches needed): with fewer, P(similarity >= threshold | matches) < tolerance.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), whose mass above t is
    P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(CHUNK, HASHES + 1, CHUNK):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs (a[i], b[j]) of signatures pass every chunk."""
    alive, hits, at = np.arange(len(i)), np.zeros(len(i), np.int32), 0
    for upto, least in needed:
        hits += (a[i[alive], at:upto] == b[j[alive], at:upto]).sum(1, dtype=np.int32)
        keep = hits >= least
        alive, hits, at = alive[keep], hits[keep], upto
    return alive


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index in the component of each of n nodes."""
    lab = np.arange(n)
    while len(i):
        low = np.minimum(lab[i], lab[j])
        np.minimum.at(lab, lab[i], low)
        np.minimum.at(lab, lab[j], low)
        while (up := lab[lab]).tolist() != lab.tolist():
            lab = up
        open_ = lab[i] != lab[j]
        i, j = i[open_], j[open_]
    return lab


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a stream sorted by `key`, with the offsets of the groups."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        k = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        if held and k[0] == last and k[-1] == last:
            held.append(batch)
            continue
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if cut or held:
            yield _grouped([*held, batch.slice(0, cut)], key)
        held, last = [batch.slice(cut)], k[-1]
    if held:
        yield _grouped(held, key)


def _grouped(parts: list[pa.RecordBatch], key: str) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches([p for p in parts if p.num_rows] or parts[:1]).combine_chunks()
    k = t.column(key).to_numpy()
    return t, np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.array([], int), len(k))


def _matrix(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                g = ngrams(text.as_py(), words, n)
                out.append((int(g.sum(dtype=np.uint64)) - 2**63, int(np.bitwise_xor.reduce(mix(g + np.uint64(1)), initial=np.uint64(0))) - 2**63, len(g), signature(g).tobytes()))
            k1, k2, size, sig = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "k1", "k2", "n", "sig"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sig = _matrix(batch.column("sig"), np.uint16, HASHES)[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
            h = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), sig.shape[:2])
            for r in range(BAND_ROWS):
                h = mix(h ^ sig[:, :, r]) + np.uint64(r)
            ids = np.repeat(batch.column("doc_id").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64).ravel()), pa.array(ids)], ["bucket", "doc_id"])


def _prune(threshold: float, tolerance: float):
    needed = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, "part"):
            ids, sig = t.column("doc_id").to_numpy(), _matrix(t.column("sig"), np.uint16, HASHES)
            size = np.diff(at)
            end = np.repeat(at[1:], size)
            i, j = [], []
            pos = np.flatnonzero(np.repeat(size, size) <= 16)
            for d in range(1, 16):  # all small groups at once
                pos = pos[pos + d < end[pos]]
                if not len(pos):
                    break
                ok = survivors(sig, sig, pos, pos + d, needed)
                i.append(pos[ok])
                j.append(pos[ok] + d)
            for g in np.flatnonzero(size > 16):
                rows = np.arange(at[g], at[g + 1])
                for lo in range(0, len(rows), 256):  # a stripe of pairs at a time
                    x, y = np.meshgrid(rows[lo : lo + 256], rows, indexing="ij")
                    x, y = x[x < y], y[x < y]
                    ok = survivors(sig, sig, x, y, needed)
                    i.append(x[ok])
                    j.append(y[ok])
            if i:
                i, j = np.concatenate(i), np.concatenate(j)
                lab = forest(len(ids), i, j)
                own = np.flatnonzero(lab != np.arange(len(ids)))
                e = np.unique(np.column_stack([ids[own], ids[lab[own]]]), axis=0) if len(own) else np.empty((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0], pa.int64()), pa.array(e[:, 1], pa.int64())], ["a", "b"])

    return run


def _payload(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            sets = pa.array([ngrams(t.as_py(), words, n).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([sets if c == "text" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections, by products of 0/1 matrices of at most `COLUMNS` columns."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    flat = np.concatenate(sets)
    if not len(flat):
        return out
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    rows, col = rows[shared[col]], (np.cumsum(shared) - 1)[col[shared[col]]]
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(col, [lo, lo + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - lo)), np.float32)
        m[rows[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, "part"):
            ids, weight, block = (t.column(c).to_numpy() for c in ("doc_id", "weight", "block"))
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("text")]
            links, root = np.zeros(len(ids), np.int64), ids.copy()
            for lo, hi in zip(at, at[1:]):
                part = sets[lo:hi]
                n = np.array([len(s) for s in part], np.float64)
                both = intersections(part).astype(np.float64)
                union = n[:, None] + n - both
                like = (both >= threshold * union - 1e-9) & (both > 0)
                np.fill_diagonal(like, False)
                if t.column("cross")[int(lo)].as_py():
                    like &= block[lo:hi, None] != block[None, lo:hi]
                links[lo:hi] = like @ weight[lo:hi]
                i, j = np.nonzero(np.triu(like))
                root[lo:hi] = ids[lo:hi][forest(hi - lo, i, j)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(root), t.column("blocks").combine_chunks()], ["doc_id", "links", "root", "blocks"])

    return run


def _in_blocks(df: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Rows of `key` dealt to pairs of blocks: `part` names the pair, `cross` if the blocks differ."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int")
    df = df.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    df = df.withColumn("cross", F.col("block") != F.col("other"))
    return df.withColumn("part", F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))).drop("other")


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id (least doc_id of the texts that links tie together), n_links (other documents at or above
    the threshold, copies included)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    signed = materialise(docs.mapInArrow(_sign(n), "doc_id long, k1 long, k2 long, n long, sig binary"))
    copies = materialise(signed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight")).where("weight > 1"))
    member = checked_join(signed, copies, ["k1", "k2", "n"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("weight", F.lit(1).cast("long")).alias("weight"), "n", "sig")
    reps = member.where("n > 0 and rep = doc_id")

    bands = reps.select("doc_id", "sig").mapInArrow(_bands, "bucket long, doc_id long")
    full = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = bands.join(full, "bucket").join(reps.select("doc_id", "sig"), "doc_id")
    shared = _in_blocks(shared, "bucket", "size", BUCKET_BLOCK).select("part", "doc_id", "sig")
    edges = shared.repartition("part").sortWithinPartitions("part").mapInArrow(_prune(threshold, tolerance), "a long, b long")
    group = materialise(components(edges))

    sizes = group.groupBy("component").agg(F.count("*").alias("size"))
    placed = materialise(group.join(sizes, "component").withColumnRenamed("node", "doc_id"))
    weighted = checked_join(placed, copies.select(F.col("rep").alias("doc_id"), "weight"), "doc_id", "left").select("doc_id", "component", "size", F.coalesce("weight", F.lit(1).cast("long")).alias("weight"))
    payload = docs.join(weighted, "doc_id").mapInArrow(_payload(n), "doc_id long, text binary, component long, size long, weight long")
    payload = _in_blocks(payload, "component", "size", GROUP_BLOCK).select("part", "doc_id", "text", "weight", "blocks", "block", "cross")
    checked = materialise(payload.repartition("part").sortWithinPartitions("part", "doc_id").mapInArrow(_verify(threshold), "doc_id long, links long, root long, blocks int"))
    links = checked.groupBy("doc_id").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if checked.where("blocks > 1").limit(1).count():
        far = components(checked.where("blocks > 1 and root != doc_id").select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
        links = links.join(far, links.doc_id == far.node, "left").select("doc_id", "links", F.coalesce("component", "root").alias("root"))
    links = materialise(links.where("links > 0 or root != doc_id").select(F.col("doc_id").alias("rep"), "links", "root"))
    drop_materialised(checked)
    found = checked_join(member.select("doc_id", "rep", "weight"), links, "rep", "left")
    return found.select("doc_id", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))


def keep_one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of `docs` without those of a class whose least doc_id is another's; rows without doc_id stay."""
    joined = ngram_jaccard_join(docs, **parameters)
    gone = materialise(joined.where("class_id != doc_id").select("doc_id"))
    return checked_join(docs, gone, "doc_id", "left_anti")


#: All pairs that share an n-gram, for small tables.
ORACLE_SQL = f"""
with recursive t as (select doc_id, min(text) as text from documents where doc_id is not null group by doc_id),
w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') w from t where text is not null),
g as (select distinct doc_id, array_to_string(w[i : i + least({N}, len(w)) - 1], ' ') s from (select doc_id, w, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from g group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) c from g a join g b using (s) where a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where c >= {THRESHOLD} * (nx.n + ny.n - c) - 1e-9),
e as (select x, y from l union all select y, x from l),
r(a, b) as (select x, y from e union select r.a, e.y from r join e on r.b = e.x)
select t.doc_id, least(t.doc_id, coalesce(c.m, t.doc_id)) class_id, coalesce(k.k, 0) n_links from t left join (select a, min(b) m from r group by a) c on c.a = t.doc_id left join (select x, count(*) k from e group by x) k on k.x = t.doc_id
"""
