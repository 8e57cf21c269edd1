"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the output divided by its share of the input,
times the number of epochs. A document's count is the inverse of the Poisson distribution with
that mean at a number in [0, 1) hashed from seed and doc_id, so the mix is the same on every run and on every
cluster. The document is exploded by its count and all copies are dealt and sorted by a hash of their own.

All DataFrame functions. Source sizes are partial sums before their shuffle; the distribution of each source is one
small array; copies of one document or source spread over all partitions, as the hash of each copy decides.

Defined results: null source is a source of its own; sources without any text, and sources missing in given
targets, have rate 1 and 0; null doc_id counts as one id; rows that share a doc_id share their count; an
empty table gives an empty table. Extra columns pass through; incoming ones named copy_no or mix_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 20240229
PART = 500.0  # a mean above this is drawn as a sum, as exp(-mean) would vanish


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _cdf(mean: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... as far as a double can tell it from 1."""
    first = F.exp(-mean)
    zero = F.struct(first.alias("p"), F.array(first).alias("c"))
    steps = F.sequence(F.lit(1), (mean + 12 * F.sqrt(mean) + 20).cast("int"))

    def step(a, k):
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + p)).alias("c"))

    return F.aggregate(steps, zero, step)["c"]


def rates(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """_source, mean, and the distribution of each source. Without targets a source weighs as its characters to the power `temperature`."""
    sizes = docs.groupBy(F.col("source").alias("_source")).agg(F.sum(F.length("text")).cast("double").alias("size")).na.fill(0.0, ["size"])
    if targets is None:
        sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, F.pow("size", F.lit(temperature))).otherwise(0.0))
    else:
        pairs = F.create_map(*[F.lit(x) for kv in targets.items() for x in (kv[0], float(kv[1]))]) if targets else F.create_map().cast("map<string,double>")
        sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, F.coalesce(F.element_at(pairs, F.col("_source")), F.lit(0.0))).otherwise(0.0))
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    mean = F.when(F.col("size") == 0, 1.0).when(F.col("all_weight") == 0, 0.0).otherwise(F.round(epochs * F.col("all_size") * F.col("weight") / F.col("all_weight") / F.col("size"), 9))
    full = sizes.crossJoin(total).withColumn("mean", mean).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("mean") / PART).cast("int")))
    return full.withColumn("cdf", _cdf(F.col("mean") / F.col("parts"))).select("_source", "mean", "parts", "cdf")


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = 0.7, epochs: float = 1.0, seed: int = SEED,
          partitions: int | None = None) -> DataFrame:
    """docs, each row as often as its count says, with copy_no (from 1) and mix_key, in global random order."""
    rate = rates(docs, targets, temperature, epochs)
    carried = [c for c in docs.columns if c not in ("copy_no", "mix_key")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.col("source").alias("_from"))
    joined = rows.join(rate, F.col("_from").eqNullSafe(F.col("_source")))
    salt = F.lit(str(seed))
    one = F.size(F.filter("cdf", lambda c: c <= F.col("_u")))
    several = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda n, i: n + F.size(F.filter(F.col("cdf"), lambda c: c <= _unit(salt, F.col("_id"), i.cast("string")))))
    counted = joined.withColumn("_u", _unit(salt, F.col("_id"), F.lit("0"))).withColumn("_count", F.when(F.col("parts") == 1, one).otherwise(several))
    copies = counted.where("_count > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws("|", salt, F.lit("order"), "_id", F.col("copy_no").cast("string"))))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.select("_row", "copy_no", "mix_key").repartition(n, "mix_key").sortWithinPartitions("mix_key").select("_row.*", "copy_no", "mix_key")
