"""Order statistics that never pull a group into one task.

A plain ``Window.partitionBy(group)`` sorts each group inside one task. A class label, a
score column or a whole table can be one group, so the helpers here cut groups into
pieces, work inside the pieces, and add the small table of piece totals:

* :func:`digest_positions` cuts by the leading digits of a digest (even by construction,
  fully lazy);
* :func:`running_before` cuts by value with Spark's range partitioner and pins the cut
  with a checkpoint, so that a lost executor cannot move rows between pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabgauge.session import ensure_checkpoint_dir

DIGEST_BUCKET_DIGITS = 3  # 16**3 = 4096 pieces per group

_UNBOUNDED = W.unboundedPreceding


def _group_window(group: Sequence[str]):
    return W.partitionBy(*group) if group else W.partitionBy(F.lit(0))


def _group_key(group: Sequence[str]) -> Column:
    """The group as one join key: a struct is never null itself, so a null group keeps its rows."""
    return F.struct(*[F.col(g) for g in group]) if group else F.lit(0)


def digest_positions(
    df: DataFrame,
    group: Sequence[str],
    digest: str,
    position: str = "position",
    digits: int = DIGEST_BUCKET_DIGITS,
) -> DataFrame:
    """Add the 1-based place of each row within its group, in digest order.

    Equal to ``row_number() over (partition by group order by digest)`` for distinct
    digests. The rows cross the network once, spread over
    ``16**digits`` pieces per group; only the piece sizes are summed per group.
    """
    keys = ["_group", "_piece"]
    pieces = df.withColumn("_piece", F.substring(digest, 1, digits)).withColumn("_group", _group_key(list(group)))
    starts = (
        pieces.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn(
            "_start",
            F.coalesce(
                F.sum("_size").over(W.partitionBy("_group").orderBy("_piece").rowsBetween(_UNBOUNDED, -1)), F.lit(0)
            ),
        )
        .drop("_size")
    )
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(digest))
    return (
        pieces.withColumn("_inside", inside)
        .join(starts, keys)
        .withColumn(position, F.col("_start") + F.col("_inside"))
        .select(*df.columns, position)
    )


def first_by_digest(df: DataFrame, n: int, digest: str, heap_limit: int = 100_000) -> DataFrame:
    """Exactly ``min(n, rows)`` rows with the smallest digests, keeping the digest column.

    Up to ``heap_limit`` rows a bounded top-k heap per task is enough. Beyond it every
    piece that lies wholly below the cut passes unsorted and only the piece that holds
    the cut is ranked.
    """
    if n <= heap_limit:
        return df.orderBy(digest).limit(n)
    piece = F.substring(digest, 1, DIGEST_BUCKET_DIGITS)
    pieces = df.withColumn("_piece", piece)
    starts = (
        pieces.groupBy("_piece")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_end", F.sum("_size").over(_group_window([]).orderBy("_piece").rowsBetween(_UNBOUNDED, 0)))
        .withColumn("_start", F.col("_end") - F.col("_size"))
        .drop("_size")
        .filter(F.col("_start") < n)
    )
    joined = pieces.join(starts, "_piece")
    whole = joined.filter(F.col("_end") <= n).select(*df.columns)
    cut = (
        joined.filter(F.col("_end") > n)
        .withColumn("_inside", F.row_number().over(W.partitionBy("_piece").orderBy(digest)))
        .filter(F.col("_start") + F.col("_inside") <= n)
        .select(*df.columns)
    )
    return whole.unionByName(cut)


def _plain(order: Sequence) -> list[Column]:
    return [o if isinstance(o, Column) else F.col(o) for o in order]


def running_before(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence,
    sums: dict[str, str],
    bounded: bool = False,
) -> DataFrame:
    """Add, for each ``out: column`` of ``sums``, the sum over the earlier rows of the group.

    Rows must be distinct on (group, order): count ties together first, which also makes
    the shuffled table smaller. ``bounded=True`` is for groups whose size is bounded by
    what they are (methods, classes, steps); it uses one plain window.
    """
    group, order = list(group), _plain(order)

    def before(window, column):
        return F.coalesce(F.sum(column).over(window.rowsBetween(_UNBOUNDED, -1)), F.lit(0))

    if bounded:
        window = _group_window(group).orderBy(*order)
        return df.select("*", *[before(window, column).alias(out) for out, column in sums.items()])

    ensure_checkpoint_dir(df.sparkSession)
    sliced = (
        df.repartitionByRange(*[F.col(g) for g in group], *order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_group", _group_key(group))
        .checkpoint()
    )
    keys = ["_slice", "_group"]
    totals = sliced.groupBy(*keys).agg(*[F.sum(column).alias(f"_total_{out}") for out, column in sums.items()])
    across = W.partitionBy("_group").orderBy("_slice")
    offsets = totals.select(*keys, *[before(across, f"_total_{out}").alias(f"_offset_{out}") for out in sums])
    within = W.partitionBy(*keys).orderBy(*order)
    placed = sliced.select("*", *[before(within, column).alias(f"_in_{out}") for out, column in sums.items()])
    joined = placed.join(offsets, keys)
    return joined.select(
        *df.columns, *[(F.col(f"_in_{out}") + F.col(f"_offset_{out}")).alias(out) for out in sums]
    )


def tie_ranks(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    rank: str = "rank",
    descending: bool = True,
    bounded: bool = False,
) -> DataFrame:
    """Add average-tie ranks of ``value`` within each group; null values get no rank.

    ``bounded`` as in :func:`running_before`. The unbounded form counts equal values
    together, so one very common value is one row, and joins the ranks back.
    """
    group = list(group)
    direction = F.col(value).desc() if descending else F.col(value).asc()
    if bounded:
        nulls_last = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
        first = F.rank().over(_group_window(group).orderBy(nulls_last))
        ties = F.count(F.lit(1)).over(W.partitionBy(*group, value))
        return df.withColumn(rank, F.when(F.col(value).isNotNull(), first + (ties - 1) / F.lit(2.0)))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_ties"))
    placed = running_before(counts, group, [direction], {"_before": "_ties"}).select(
        _group_key(group).alias("_group"), value, (F.col("_before") + (F.col("_ties") + 1) / F.lit(2.0)).alias(rank)
    )
    return df.withColumn("_group", _group_key(group)).join(placed, ["_group", value], "left").select(*df.columns, rank)


def sorted_codes(
    values: DataFrame, group: Sequence[str], value: str, code: str = "code", bounded: bool = False
) -> DataFrame:
    """Distinct ``(group, value)`` pairs with 0-based codes in sorted order (nulls left out)."""
    distinct = values.filter(F.col(value).isNotNull()).select(*group, value).distinct().withColumn("_one", F.lit(1))
    return running_before(distinct, group, [value], {code: "_one"}, bounded).drop("_one").withColumn(code, F.col(code).cast("int"))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    accuracy: int = 10_000,
    buffer_rows: int = 1_000_000,
) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles of many numeric columns in two scans.

    Spark's exact ``percentile`` keeps every distinct value of a column in one buffer, so it
    serves up to ``buffer_rows`` values. Beyond that the first scan's sketch brackets each
    wanted rank, and a second scan counts what lies below each bracket and ships only the
    bracket's values (about ``4 / accuracy`` of the rows).
    Returns ``{column: [quantile per probability]}``, all None for an all-null column.
    """
    columns, probabilities = list(columns), list(probabilities)
    if not columns:
        return {}
    margin = 2.0 / accuracy
    asked = [p for q in probabilities for p in (max(q - margin, 0.0), min(q + margin, 1.0))]
    sketch = df.agg(
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(F.col(c).cast("double"), asked, accuracy).alias(f"q_{i}") for i, c in enumerate(columns)],
        *[F.min(F.col(c).cast("double")).alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{i}") for i, c in enumerate(columns)],
    ).first()
    if max(sketch[f"n_{i}"] for i in range(len(columns))) <= buffer_rows:
        row = df.agg(*[F.percentile(F.col(c).cast("double"), probabilities).alias(f"q_{i}") for i, c in enumerate(columns)]).first()
        return {c: list(row[f"q_{i}"]) if row[f"q_{i}"] else [None] * len(probabilities) for i, c in enumerate(columns)}
    brackets = []  # (column index, probability index, lowest, highest, first rank, second rank, weight)
    for i, _ in enumerate(columns):
        n = sketch[f"n_{i}"]
        if not n:
            continue
        for j, q in enumerate(probabilities):
            place = (n - 1) * q
            first = int(place)
            low, high = sketch[f"q_{i}"][2 * j], sketch[f"q_{i}"][2 * j + 1]
            # a rank margin under one row can fall between two rows; widen to the column's ends
            if n <= 2 * accuracy or q - margin <= 0:
                low = sketch[f"lo_{i}"]
            if n <= 2 * accuracy or q + margin >= 1:
                high = sketch[f"hi_{i}"]
            brackets.append((i, j, low, high, first, min(first + 1, n - 1), place - first))
    if not brackets:
        return {c: [None] * len(probabilities) for c in columns}
    below = df.agg(
        *[
            F.count(F.when(F.col(columns[i]).cast("double") < low, 1)).alias(f"b_{i}_{j}")
            for i, j, low, _, _, _, _ in brackets
        ]
    ).first()
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("bracket"),
                F.when(F.col(columns[i]).cast("double").between(low, high), F.col(columns[i]).cast("double")).alias("value"),
            )
            for k, (i, j, low, high, _, _, _) in enumerate(brackets)
        ]
    )
    inside = (
        df.select(F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("cell"))
        .groupBy("cell.bracket", "cell.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = running_before(inside, ["bracket"], ["value"], {"before": "n"})
    ranks = df.sparkSession.createDataFrame(
        [
            (k, which, rank - below[f"b_{i}_{j}"])
            for k, (i, j, _, _, first, second, _) in enumerate(brackets)
            for which, rank in ((0, first), (1, second))
        ],
        "bracket int, which int, rank long",
    )
    found = (
        placed.join(F.broadcast(ranks), "bracket")
        .filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        .select("bracket", "which", "value")
        .collect()  # two rows per wanted quantile
    )
    picked = {(r["bracket"], r["which"]): r["value"] for r in found}
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    for k, (i, j, _, _, _, _, weight) in enumerate(brackets):
        low, high = picked[(k, 0)], picked[(k, 1)]
        result[columns[i]][j] = low + (high - low) * weight
    return result


def grouped_quantiles(
    df: DataFrame,
    group: Sequence[str],
    columns: Sequence[str],
    probabilities: Sequence[float] | None = None,
    grid: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per group: rows ``(group..., column, p, value)``.

    Give a short list of ``probabilities``, or ``grid=n`` for the n evenly spaced ones.
    Values are counted before they are ordered, and the order is cut into slices, so a
    group with a third of all rows is neither buffered nor sorted in one task. Each value
    row emits only the quantiles that fall on it.
    """
    group = list(group)
    keys = [*group, "column"]
    long = df.unpivot(group, [F.col(c).cast("double").alias(c) for c in columns], "column", "v").filter("v is not null")
    counts = long.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_before(counts, keys, ["v"], {"_before": "_n"}).withColumn("_group", _group_key(keys))
    sizes = placed.groupBy("_group").agg(F.sum("_n").alias("_size"))
    rows = placed.join(sizes, "_group")
    last = F.col("_size") - 1
    begin, end = F.col("_before"), F.col("_before") + F.col("_n")

    def covers(rank):
        return (begin <= rank) & (rank < end)

    if grid is None:
        asked = F.array(*[F.lit(float(p)) for p in probabilities])
        hits = F.filter(
            asked, lambda p: covers(F.floor(last * p)) | covers(F.least(F.floor(last * p) + 1, last))
        )
        rows = rows.withColumn("p", F.explode(hits)).withColumn("_place", last * F.col("p"))
        rows = rows.withColumn("_rank", F.floor("_place")).withColumn("_weight", F.col("_place") - F.col("_rank"))
    else:
        steps = grid - 1
        from_step = F.greatest(F.ceil((begin - 1) * steps / F.greatest(last, F.lit(1))), F.lit(0))
        to_step = F.least(F.floor((end * steps - 1) / F.greatest(last, F.lit(1))), F.lit(steps))
        every = F.sequence(F.lit(0).cast("bigint"), F.lit(steps).cast("bigint"))
        some = F.when(from_step <= to_step, F.sequence(from_step.cast("bigint"), to_step.cast("bigint")))
        rows = rows.withColumn("_step", F.explode(F.when(last == 0, every).otherwise(some)))
        scaled = F.col("_step") * last
        rows = rows.withColumn("_rank", F.floor(scaled / steps)).withColumn("_weight", (scaled % steps) / F.lit(float(steps)))
        rows = rows.withColumn("p", F.col("_step") / F.lit(float(steps)))
    low = F.max(F.when(covers(F.col("_rank")), F.col("v")))
    high = F.max(F.when(covers(F.least(F.col("_rank") + 1, last)), F.col("v")))
    return (
        rows.groupBy(*keys, "p")
        .agg(low.alias("_low"), high.alias("_high"), F.max("_weight").alias("_weight"))
        .filter("_low is not null")
        .select(*keys, "p", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_weight")).alias("value"))
    )
