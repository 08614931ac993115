"""Mixing sources to target weights by Poisson replication.

A source of `size` characters that is to make up the share `w` of the mixture is repeated at the mean rate
w * budget * total / size. Each document draws a uniform number from a hash of the seed and its doc_id, and the inverse
of the Poisson distribution with that mean turns it into a number of copies. Copies are exploded and dealt to partitions
and ordered within them by another hash: a global shuffle that comes out alike on every run.

Edge cases: a null source is the source ''; a null text has no characters; a source without characters has rate 0; a
null doc_id draws by its text; repeated rows draw the same number, each row by itself; an empty table gives no rows;
columns of `docs` named like the new ones (`copy`, `shuffle_key`) are replaced, all others pass through, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import checked_join, materialise, spare

SEED, TEMPERATURE = 20240501, 0.5
HEX_DRAW, HEX_KEY = 13, 15  # hex digits of a hash: 52 bits make a double in [0, 1), 60 bits a key


def _hash(seed: int, *parts: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, digits), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, budget: float = 1.0) -> DataFrame:
    """_source, rate, cdf: the mean repetition rate of each source and its cumulative Poisson probabilities.

    Without `weights`, a source weighs its size to the power `temperature`. Sources not named in `weights` get none.
    The list of probabilities goes far enough that what lies beyond is less than a double can show.
    """
    size = docs.groupBy(F.coalesce("source", F.lit("")).alias("_source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size")).where("size > 0")
    if weights is None:
        size = size.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_source string, weight double")
        size = size.join(F.broadcast(named), "_source").where("weight > 0")
    size = materialise(size)
    total, mass = size.agg(F.sum("size"), F.sum("weight")).first()
    rate = F.col("weight") / F.lit(float(mass or 1)) * F.lit(float(total or 0) * budget) / F.col("size")
    steps = F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))
    zero = F.struct(F.array().cast("array<double>").alias("cdf"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("log"))

    def add(acc: Column, k: Column) -> Column:
        log = F.when(k == 0, -F.col("rate")).otherwise(acc["log"] + F.log(F.col("rate")) - F.log(k.cast("double")))
        return F.struct(F.concat(acc["cdf"], F.array(acc["sum"] + F.exp(log))).alias("cdf"), (acc["sum"] + F.exp(log)).alias("sum"), log.alias("log"))

    return materialise(size.withColumn("rate", rate).select("_source", "rate", F.aggregate(steps, zero, add)["cdf"].alias("cdf")))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """All columns of `docs` with `copy` (from 1), one row for each copy, in no order yet."""
    kept = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    source, drawn, times, cdf = spare(docs.columns, "_source", "_drawn", "_times", "_cdf")
    named = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce("source", F.lit("")).alias(source), (_hash(seed, named, digits=HEX_DRAW) / F.lit(float(16**HEX_DRAW))).alias(drawn))
    rows = checked_join(rows, rates.select(F.col("_source").alias(source), F.col("cdf").alias(cdf)), source)
    rows = rows.withColumn(times, F.size(F.filter(cdf, lambda c: c <= F.col(drawn)))).where(F.col(times) > 0)
    return rows.select(*(F.col(f"`{c}`") for c in kept), F.explode(F.sequence(F.lit(1), F.col(times))).alias("copy"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mixture: every copy of every document, globally shuffled; `shuffle_key` gives the order."""
    copies = replicate(docs, source_rates(docs, weights, temperature, budget), seed)
    named = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    keyed = copies.withColumn("shuffle_key", _hash(seed + 1, named, F.col("copy").cast("string"), digits=HEX_KEY))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE_SQL = f"""
with s as (select coalesce(source, '') src, sum(length(text)) size from documents group by 1 having sum(length(text)) > 0),
r as (select src, sqrt(size) / (select sum(sqrt(size)) from s) * (select sum(size) from s) / size rate from s),
c as (select src, rate, list_transform(range(0, cast(ceil(rate + 12 * sqrt(rate) + 30) as bigint) + 1), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-rate + i * ln(rate) - lgamma(i + 1))))) cdf from r),
n as (select d.*, len(list_filter(cdf, lambda x: x <= cast('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), text, '')), 1, {HEX_DRAW}) as bigint) / {float(16**HEX_DRAW)})) n from documents d join c on c.src = coalesce(d.source, '')),
e as (select * exclude (n), cast(unnest(range(1, n + 1)) as integer) as copy from n where n > 0)
select *, cast('0x' || substr(md5('{SEED + 1}:' || coalesce(cast(doc_id as varchar), text, '') || ':' || copy), 1, {HEX_KEY}) as bigint) shuffle_key from e
"""
