"""A mixture of sources with target shares of its tokens, by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions.ranks import global_rank
from karst.llm.tokens import count_tokens
from karst.runtime import written


def rates(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, goal_share, max_repeats, available, copies): expected copies of each document of a source.

    The goal share is the target share among the sources that have tokens. Without ``total`` the mixture is as large as it
    can be with every goal share met. A ``total`` beyond that leaves the scarce sources at ``max_repeats`` copies of all they have, and
    the report shows the share they really get. Targets of one source are added up, with the smallest max_repeats
    (null: 1); a null source or share, or a share of 0 or less, is no target.
    """
    t = targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min(F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0))).alias("max_repeats"))
    have = sizes.filter("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("available"))
    d = t.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"))
    usable = (F.col("available") > 0) & (F.col("max_repeats") > 0)
    one = d.agg(F.sum(F.when(usable, F.col("target_share"))).alias("shares"), F.min(F.when(usable, F.col("max_repeats") * F.col("available") / F.col("target_share"))).alias("scale"))
    shares, scale = one.first()  # one row
    if not shares:
        shares, scale = 1.0, 0.0
    size = float(total) if total is not None else scale * shares
    goal = F.when(usable, F.col("target_share") / F.lit(shares)).otherwise(0.0)
    copies = F.when(usable, F.least(F.col("max_repeats").cast("double"), F.lit(size) * goal / F.col("available"))).otherwise(0.0)
    return d.select("source", "target_share", goal.alias("goal_share"), "max_repeats", "available", copies.alias("copies"))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, path: str | None = None) -> DataFrame:
    """(doc_id, source, copy_no, n_tokens, actual_share): one row for each copy of a document in the mixture.

    Expected copies are summed up along the documents of a source, ordered by size, and shifted by one random offset;
    a document is drawn once for each integer that its stretch of the sum crosses, so at most max_repeats times, and on average as
    often as expected. Order by size makes the sample's tokens follow the expected ones closely. Documents without tokens or without a target are not drawn.
    The prefix sum is taken by blocks of size and hash, so a source with a third of all documents is spread over tasks.
    """
    sizes = written(count_tokens(documents, ["doc_id", "source"], path=path), "tokens")
    return _drawn(sizes, targets, total, seed)


def _drawn(sizes: DataFrame, targets: DataFrame, total: int | None, seed: int) -> DataFrame:
    rate = rates(sizes, targets, total).filter("copies > 0").select("source", "copies")
    rate = written(rate.coalesce(1), "rates")  # one row per target
    d = sizes.filter("n_tokens > 0").join(rate, "source")
    block = F.floor(F.log2(F.col("n_tokens") + 1) * 16) * 64 + F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(64))
    d = global_rank(d, ["source"], block, ["n_tokens", "doc_id"])
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    end = F.col("copies") * F.col("rank") + offset
    d = d.withColumn("n", (F.floor(end) - F.floor(end - F.col("copies"))).cast("int"))
    d = written(d.filter("n > 0").select("doc_id", "source", "n_tokens", "n"), "drawn")
    share = d.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t"))
    all_ = share.agg(F.sum("t")).first()[0] or 1
    share = share.select("source", (F.col("t") / F.lit(all_)).alias("actual_share"))
    return d.join(share, "source").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"), "n_tokens", "actual_share")


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, path: str | None = None) -> DataFrame:
    """(source, target_share, goal_share, max_repeats, available_tokens, documents, copies, tokens, actual_share) of each target."""
    sizes = written(count_tokens(documents, ["doc_id", "source"], path=path), "tokens")
    drawn = _drawn(sizes, targets, total, seed)
    got = drawn.groupBy("source").agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("copies"), F.sum("n_tokens").alias("tokens"), F.first("actual_share").alias("actual_share"))
    d = rates(sizes, targets, total).drop("copies").withColumnRenamed("available", "available_tokens").join(got, "source", "left")
    return d.fillna(0, ["documents", "copies", "tokens"]).fillna(0.0, ["actual_share"])
