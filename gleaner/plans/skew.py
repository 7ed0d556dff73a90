"""Equi joins. Adaptive execution splits skewed keys of a plain join by itself; salting is for where it cannot.

It cannot where the rows go on by the same key without another shuffle, or where both sides of a key are so hot that
one task cannot hold their product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows of one key and side that a task takes
PIECE_ROWS = 2_000_000
#: hot keys per side; where more keys than that pass ``PIECE_ROWS``, a piece is 1 / MOST_HOT of the rows
MOST_HOT = 10_000


def hot_keys(df: DataFrame, keys: list[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(keys, pieces) of the keys with more rows than a task should take.

    A piece has ``piece_rows`` rows, or ``1 / MOST_HOT`` of all rows where that is more. So there are at most
    ``MOST_HOT`` such keys, whatever the data size, and the result may be broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    piece = F.greatest(F.lit(float(piece_rows)), F.coalesce(total, F.lit(0)) / F.lit(MOST_HOT))
    return counts.filter(F.col("_n") > piece).select(*keys, F.ceil(F.col("_n") / piece).cast("int").alias("pieces"))


def row_salt(df: DataFrame, pieces: Column) -> Column:
    """A number below ``pieces`` from the row and the input partition it comes from.

    Equal rows of different partitions differ in it, and a partition that runs again gives its rows the same
    numbers, in whatever order they come. Equal rows of one partition get one number, so a piece may
    exceed its share by what one input partition holds.
    """
    return F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in df.columns]), pieces).cast("int")


def _match(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], null_safe: bool) -> Column:
    tests = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in pairs]
    return reduce(lambda x, y: x & y, tests)


def _with_pieces(df: DataFrame, keys: list[str], hot: DataFrame, hot_keys_: list[str], out: str) -> DataFrame:
    """``df`` with the number of pieces of its key; 1 for a key that is not hot."""
    marks = [f"{out}{i}" for i in range(len(keys))]
    small = hot.select(*[F.col(k).alias(m) for k, m in zip(hot_keys_, marks)], F.col("pieces").alias(f"{out}_n"))
    joined = df.join(F.broadcast(small), _match(df, small, list(zip(keys, marks)), True), "left")
    return joined.withColumn(out, F.coalesce(f"{out}_n", F.lit(1))).drop(*marks, f"{out}_n")


def equi_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str] | list[tuple[str, str]],
    how: str = "inner",
    null_safe: bool = False,
    piece_rows: int | None = None,
) -> DataFrame:
    """A plain equi join, or with ``piece_rows`` a salted one; the columns are the same.

    ``on`` names shared columns, or (left, right) pairs; shared names come out once, pairs keep both columns. Semi and
    anti joins need each right key once, so their right side is made distinct ahead of its shuffle.
    """
    if piece_rows is not None:
        return salted_join(left, right, on, how, null_safe, piece_rows)
    pairs = [(n, n) if isinstance(n, str) else tuple(n) for n in ([on] if isinstance(on, str) else on)]
    if how in ("left_semi", "left_anti"):
        right = right.select(*[b for _, b in pairs]).distinct()
    renamed = {b: f"_r{i}" for i, (_, b) in enumerate(pairs)}
    right = right.withColumnsRenamed(renamed)
    out = left.join(right, _match(left, right, [(a, renamed[b]) for a, b in pairs], null_safe), how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.drop(*[renamed[b] for a, b in pairs if a == b]).withColumnsRenamed({renamed[b]: b for a, b in pairs if a != b})


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str] | list[tuple[str, str]],
    how: str = "inner",
    null_safe: bool = False,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Equi join whose hot keys are spread over as many tasks as their rows need, on both sides.

    A left row of a hot key gets one of the key's left pieces and meets a copy of every right row there; likewise
    for the right. With both hot, the pieces make a grid, in which each pair of rows meets once. Semi and
    anti joins need each right key once, so their right side is made distinct and never hot. In a left join
    a left row of a hot right key has copies that meet no right row: as such a key always has matches, these
    copies go. Other keys shuffle as in a plain join. ``on`` names shared columns, or (left, right) pairs; shared
    names come out once, pairs keep both columns. Inner, left, left_semi and left_anti joins only.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no salted form of a {how} join")
    names = [on] if isinstance(on, str) else list(on)
    pairs = [(n, n) if isinstance(n, str) else tuple(n) for n in names]
    lkeys, rkeys = [a for a, _ in pairs], [b for _, b in pairs]
    only_keys = how in ("left_semi", "left_anti")
    if only_keys:
        right = right.select(*rkeys).distinct()

    lhot = hot_keys(left.select(*lkeys), lkeys, piece_rows)
    big = _with_pieces(left, lkeys, lhot, lkeys, "_lpieces").withColumn("_lsalt", row_salt(left, F.col("_lpieces")))
    rmap = {k: f"_r{i}" for i, k in enumerate(rkeys)}
    small = _with_pieces(right, rkeys, lhot, lkeys, "_copies").withColumnsRenamed(rmap)
    small = small.withColumn("_rlsalt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    test = _match(big, small, [(a, rmap[b]) for a, b in pairs], null_safe) & (big["_lsalt"] == small["_rlsalt"])
    extra = ["_lpieces", "_lsalt", "_copies", "_rlsalt"]
    if not only_keys:
        known = right if null_safe else right.na.drop(how="any", subset=rkeys)  # a null key has no match to split
        rhot = hot_keys(known.select(*rkeys), rkeys, piece_rows)
        right_keys = [rmap[k] for k in rkeys]
        small = _with_pieces(small, right_keys, rhot, rkeys, "_rpieces")
        small = small.withColumn("_rsalt", row_salt(small.drop("_copies", "_rpieces"), F.col("_rpieces")))
        big = _with_pieces(big, lkeys, rhot, rkeys, "_lcopies")
        big = big.withColumn("_lrsalt", F.explode(F.sequence(F.lit(0), F.col("_lcopies") - 1)))
        test = _match(big, small, [(a, rmap[b]) for a, b in pairs], null_safe)
        test = test & (big["_lsalt"] == small["_rlsalt"]) & (big["_lrsalt"] == small["_rsalt"])
        extra += ["_rpieces", "_rsalt", "_lcopies", "_lrsalt"]
    out = big.join(small, test, how)
    if how == "left":
        out = out.filter((F.col("_lcopies") == 1) | F.col("_rsalt").isNotNull())
    shared = [rmap[b] for a, b in pairs if a == b]
    return out.drop(*extra, *shared).withColumnsRenamed({rmap[b]: b for a, b in pairs if a != b})
