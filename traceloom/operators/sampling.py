"""Deterministic samples and splits. Order of a draw is md5(seed|key), so a run can be repeated anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.bins import bucket_labels
from traceloom.operators.ranks import draw_bounds, drawn_first, row_ranks, seeded_hash, top_per


def sample_n(df: DataFrame, n: int, seed: int, key: str, strict: bool = True) -> DataFrame:
    """``n`` rows without replacement; with ``strict`` a sample larger than the data is an error."""
    if strict and df.limit(n).count() < n:
        raise ValueError(f"cannot draw {n} rows: the input has fewer")
    return drawn_first(df, [], seeded_hash(seed, key), n)


def sample_where(df: DataFrame, condition: Column, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows among those that satisfy ``condition``, or all of them when there are fewer."""
    return sample_n(df.where(condition), n, seed, key, strict=False)


def sample_per(df: DataFrame, by: str, n: int, seed: int, key: str, total: int | None = None) -> DataFrame:
    """Up to ``n`` rows of every group; ``total`` then draws that many from what is left."""
    drawn = drawn_first(df, [by], seeded_hash(seed, key), n)
    return drawn if total is None else sample_n(drawn, total, seed, key, strict=False)


def sample_stratified(
    df: DataFrame, bucket: str, seed: int, key: str, n: int | None = None, per_bucket: int | None = None, step: int = 10
) -> DataFrame:
    """A fixed number per bucket, or ``n`` rows dealt out to the buckets in turn, in bucket order."""
    if (n is None) == (per_bucket is None):
        raise ValueError("give either n or per_bucket")
    draw = seeded_hash(seed, key)
    limit = per_bucket if per_bucket is not None else n
    if per_bucket is not None:
        return drawn_first(df, [bucket], draw, limit)
    ranked = top_per(drawn_first(df, [bucket], draw, limit).withColumn("_draw", draw), [bucket], [F.col("_draw")], limit, "_rank")
    if per_bucket is None:
        labels = F.array(*[F.lit(label) for label in bucket_labels(step)])
        place = F.array_position(labels, F.col(bucket))
        turn = [F.col("_rank"), F.when(place > 0, place).otherwise(len(bucket_labels(step)) + 1), F.col(bucket)]
        ranked = ranked.orderBy(*turn).limit(n)
    return ranked.select(*df.columns)


def pick_one(df: DataFrame, by: str, seeds: list[int], key: str) -> DataFrame:
    """One row of every group for each seed; partial minima, so a large group costs no more than a small one."""
    seeded = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    draw = F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col(key).cast("string")))
    rest = [c for c in df.columns if c != by]
    chosen = seeded.groupBy("seed", by).agg(F.min_by(F.struct(*rest), draw).alias("_row"))
    return chosen.select("seed", by, "_row.*")


def batch_no(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Number of the fixed-size batch each row falls in."""
    ranked = row_ranks(df, [], order, "_rank")
    return ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / size)).drop("_rank")


def split_sizes(total: int, train: float, val: float) -> tuple[int, int, int]:
    """Rows of the three parts; from three rows on each of train and val gets at least one."""
    n_train, n_val = int(total * train), int(total * val)
    if total >= 3:
        n_val = max(1, n_val)
        n_train = max(1, min(n_train, total - 1 - n_val))
    return n_train, n_val, max(0, total - n_train - n_val)


def split_by_ratio(df: DataFrame, key: str, train: float = 0.98, val: float = 0.01, seed: int = 42) -> DataFrame:
    """Add ``split``: a seeded shuffle cut at the two ratios. An empty part is an error."""
    n_train, n_val, n_test = split_sizes(df.count(), train, val)
    if min(n_train, n_val, n_test) <= 0:
        raise ValueError(f"empty split: train={n_train}, val={n_val}, test={n_test}")
    draw = seeded_hash(seed, key)
    first, second = (draw_bounds(df, [], draw, n).select("_bound").scalar() for n in (n_train, n_train + n_val))
    part = F.when(draw <= first, F.lit("train")).when(draw <= second, F.lit("val")).otherwise(F.lit("test"))
    return df.withColumn("split", part)


def split_by_range(df: DataFrame, order: list[Column], train_count: int = 10_000, val_count: int = 1_000) -> DataFrame:
    """Add ``split`` to the first rows in ``order``: train, then val. Too few rows is an error."""
    if df.limit(train_count + val_count).count() < train_count + val_count:
        raise ValueError(f"need {train_count + val_count} rows")
    ranked = top_per(df, [], order, train_count + val_count, "_rank")
    return ranked.withColumn("split", F.when(F.col("_rank") <= train_count, F.lit("train")).otherwise(F.lit("val"))).drop("_rank")
