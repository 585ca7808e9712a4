"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer over whole texts. Each mix's sources get their target
share of the total by capped water-filling: a source that would have to be repeated more often
than allowed is clamped at its cap, and what is left is shared among the others in proportion
to their weights, until nothing more is over its cap. A source's amount is taken as whole
repetitions of all its documents and a seeded part of them.

The part is cut at an exact point of a hashed order: tokens are summed per hash bucket, which
finds the bucket of the cut, and only that bucket's documents are put in order.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernbrand.session import cut
from fernbrand.sizing import broadcast_if_small

#: Leading bits of the hash that make the buckets that find the cut.
BUCKET_BITS = 16
#: Rows of the target table that the driver may hold.
MOST_TARGETS = 100_000
#: A source that would hold a mix below this part of the size that half its weight reaches doesn't set the size; it is clamped.
TINY = 0.05
# Fixed value: how the byte-level vocabulary splits text into pieces, as its publishers give it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    """Path of the public byte-level vocabulary: ``FERNBRAND_TOKENIZER``, else the installed one."""
    if named := os.environ.get("FERNBRAND_TOKENIZER"):
        return named
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counted(batches, path: str):
    encode = _encoding(path).encode_ordinary
    for batch in batches:
        sizes = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "n_tokens"])


def sizes_given(documents: DataFrame, size_col: str) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens`` from a column of sizes; null and negative ones are 0."""
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("n_tokens"))


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens`` of each row; null and empty texts have 0."""
    path = tokenizer or default_tokenizer()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return rows.mapInArrow(lambda batches: _counted(batches, path), "doc_id bigint, source string, n_tokens bigint")


def water_fill(weights: np.ndarray, caps: np.ndarray, total: float) -> np.ndarray:
    """Amounts of each source: ``total`` in proportion to ``weights``, none over its cap.

    If all weighted sources are at their caps, the amounts add up to less than ``total``.
    """
    amount, open_ = np.zeros(len(weights)), weights > 0
    left = float(total)
    while open_.any() and left > 0:
        share = np.where(open_, weights, 0) / weights[open_].sum() * left
        over = open_ & (share > caps * (1 + 1e-12))
        if not over.any():
            amount[open_] = np.where(share > caps * (1 - 1e-12), caps, share)[open_]
            break
        amount[over] = caps[over]
        left -= caps[over].sum()
        open_ &= ~over
    return amount


def largest_exact_total(weights: np.ndarray, caps: np.ndarray) -> float:
    """The greatest total at which every source with a cap can have exactly its share of what these get."""
    wanted = (weights > 0) & (caps > 0)
    return float((caps[wanted] / weights[wanted]).min() * weights[wanted].sum()) if wanted.any() else 0.0


def default_total(weights: np.ndarray, caps: np.ndarray) -> float:
    """The greatest exact total, where sources that have next to nothing (``TINY``) don't count.

    ``water_fill`` clamps those at their caps and gives what they lack to the others; the total
    is such that none of the others is over its cap then.
    """
    wanted = (weights > 0) & (caps > 0)
    if not wanted.any():
        return 0.0
    weight, cap = weights[wanted], caps[wanted]
    reach = cap / weight
    order = np.argsort(reach)
    half = reach[order][np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2 * (1 + 1e-12), "right").clip(max=len(order) - 1)]
    tiny = reach < TINY * half
    return largest_exact_total(weight[~tiny], cap[~tiny]) + float(cap[tiny].sum())


def plan_mixes(counts: DataFrame, targets: DataFrame, total_tokens: float | str | None = None) -> list[dict]:
    """A row a mix and source: what it has, its target, and how much is taken.

    ``total_tokens``: size of every mix; by default each mix is as large as its targets can be
    met exactly by the sources that aren't empty or tiny (``default_total``). Only totals a source named in ``targets`` reach the driver.
    """
    rows = [r.asDict() for r in targets.select("mix_name", "source", "target_share", "max_repeats").distinct().limit(MOST_TARGETS + 1).collect()]
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    rows = [r for r in rows if r["mix_name"] is not None and r["source"] is not None]
    names = sorted({r["source"] for r in rows})
    held = counts.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("n_tokens").alias("n")) if names else None
    have = {r["source"]: r["n"] for r in held.collect()} if names else {}
    out = []
    for mix in sorted({r["mix_name"] for r in rows}):
        part = sorted((r for r in rows if r["mix_name"] == mix), key=lambda r: r["source"])
        weights = np.array([max(r["target_share"] or 0.0, 0.0) for r in part])
        caps = np.array([float(have.get(r["source"], 0)) * max(r["max_repeats"] or 0, 0) for r in part])
        if total_tokens == ALL:
            total = float(sum(have.get(r["source"], 0) for r in part if (r["target_share"] or 0.0) > 0))
        else:
            total = default_total(weights, caps) if total_tokens is None else total_tokens
        amounts = water_fill(weights, caps, total)
        for r, amount in zip(part, amounts):
            n = have.get(r["source"], 0)
            whole = min(int(amount // n), r["max_repeats"] or 0) if n else 0
            out.append(r | {"available_tokens": n, "planned_tokens": float(amount), "whole": whole, "rest": float(amount - whole * n) if whole < (r["max_repeats"] or 0) else 0.0})
    return out


PLAN = "mix_name string, source string, target_share double, max_repeats int, available_tokens bigint, planned_tokens double, whole int, rest double"


def order_key(seed: int, doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of ``seed:doc_id``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), doc_id.cast("string"))), 1, 15), 16, 10).cast("long")


def sample_mix(counts: DataFrame, plan: list[dict], seed: int = 0) -> DataFrame:
    """``mix_name``, ``doc_id``, ``source``, ``n_tokens``, ``copies`` (over 0) of every document in a mix.

    The part beyond whole repetitions takes documents in the order of a seeded hash as long as
    they fit; the one that reaches over the end is taken if that comes nearer to it, so the part
    is off by at most half a document. The hash is a public one (``order_key``), so that any
    engine can take the same sample.
    """
    spark = counts.sparkSession
    order = [f.split()[0] for f in PLAN.split(", ")]
    plans = F.broadcast(spark.createDataFrame([tuple(r[k] for k in order) for r in plan], PLAN).select("mix_name", "source", "whole", "rest"))
    keyed = counts.withColumn("_hash", order_key(seed, F.col("doc_id"))).withColumn("_bucket", F.shiftright("_hash", 60 - BUCKET_BITS).cast("int"))
    sums = keyed.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_n"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    cuts = sums.join(plans, "source").where((F.col("_before") <= F.col("rest")) & (F.col("_before") + F.col("_n") > F.col("rest")))
    cuts = broadcast_if_small(cut(cuts.select("mix_name", "source", F.col("_bucket").alias("_cut"), "_before")))
    rows = keyed.join(plans, "source").join(cuts, ["mix_name", "source"], "left")
    within = rows.where(F.col("_bucket") == F.col("_cut"))
    upto = Window.partitionBy("mix_name", "source").orderBy("_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    after = F.col("_before") + F.sum("n_tokens").over(upto)
    fits = (after <= F.col("rest")) | ((after - F.col("n_tokens") <= F.col("rest")) & (after - F.col("rest") < F.col("rest") - after + F.col("n_tokens")))
    columns = ["mix_name", "doc_id", "source", "n_tokens"]
    edge = within.select(*columns, (F.col("whole") + F.when(fits, 1).otherwise(0)).alias("copies"))
    # Without a cut the whole source fits into the rest, or nothing is wanted of it.
    below = F.when(F.col("_cut").isNull(), F.when(F.col("rest") > 0, 1).otherwise(0)).otherwise(F.when(F.col("_bucket") < F.col("_cut"), 1).otherwise(0))
    other = rows.where(F.col("_cut").isNull() | (F.col("_bucket") != F.col("_cut"))).select(*columns, (F.col("whole") + below).alias("copies"))
    return other.unionByName(edge).where("copies > 0")


#: As ``total_tokens``: as many tokens as the sources of a mix hold, so that small ones are clamped.
ALL = "all"


def make_mixes(
    documents: DataFrame, targets: DataFrame, total_tokens: float | str | None = None, seed: int = 0, tokenizer: str | None = None, size_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The mixes, as ``sample_mix`` gives them, and the report of ``report_shares``.

    ``total_tokens``: the size of each mix; by default the greatest at which the targets are met
    exactly; with ``ALL`` that of the targeted sources. ``size_col``: a column that holds the sizes
    already; otherwise texts are tokenized.

    ``documents``: ``doc_id`` (unique), ``source``, ``text``; ``targets``: ``mix_name``,
    ``source``, ``target_share``, ``max_repeats``. Targets with a null mix or source count as not
    given, null shares and repeats as 0. A targeted source without tokens or repeats has the
    actual share 0, and its weight goes to the others of its mix; so does what a tiny one lacks.
    Sources without a target are in no mix, documents with a null source neither. Empty tables give no rows. Each text is tokenized
    once; only ids, sources and sizes are kept.
    """
    counts = cut(sizes_given(documents, size_col) if size_col else token_counts(documents, tokenizer))
    plan = plan_mixes(counts, targets, total_tokens)
    mix = sample_mix(counts, plan, seed)
    return mix, report_shares(mix, plan)


def report_shares(mix: DataFrame, plan: list[dict]) -> DataFrame:
    """Per mix and source: target and actual share, tokens taken and available, documents, greatest repeats."""
    spark = mix.sparkSession
    order = [f.split()[0] for f in PLAN.split(", ")]
    plans = F.broadcast(spark.createDataFrame([tuple(r[k] for k in order) for r in plan], PLAN))
    taken = mix.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies")
    )
    joined = plans.join(taken, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return joined.select(
        "mix_name", "source", "target_share", F.when(total > 0, F.col("tokens") / total).alias("actual_share"), "tokens", "available_tokens", "documents",
        "most_copies", "max_repeats",
    )
