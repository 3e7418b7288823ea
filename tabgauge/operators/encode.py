"""Encoders: fit on training rows, apply anywhere.

``fit`` runs one or two aggregates and keeps either a few numbers per column (literals
in the later plan) or a dictionary table. A dictionary goes into the plan as a literal map
while it is short, and as a join beyond that, so nothing of unknown size is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.ml.feature import Bucketizer, OneHotEncoder as VectorIndicator, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabgauge.functions.digest import order_key, uniform
from tabgauge.functions.ordered import exact_quantiles, grouped_quantiles, running_before, sorted_codes
from tabgauge.functions.scalars import normal_quantile
from tabgauge.operators.profile import distinct_counts
from tabgauge.session import ensure_checkpoint_dir

#: longest dictionary that is written into the plan as a literal
LITERAL_DICTIONARY = 1_000
#: rows up to which Spark's exact percentile, which buffers a column's distinct values, is used
BUFFER_ROWS = 1_000_000


# ---- target -------------------------------------------------------------------------------


def short_levels(df: DataFrame, columns: Sequence[str], limit: int = LITERAL_DICTIONARY) -> dict[str, list]:
    """Sorted distinct values of the columns that have at most ``limit`` of them."""
    counts = distinct_counts(df, columns)
    few = [c for c in columns if counts[c] <= limit]
    if not few:
        return {}
    row = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in few]).first()
    return {c: list(row[c]) for c in few}


def literal_code(values: Sequence, column: Column) -> Column:
    """Place of a value in a short sorted list, null if absent."""
    entries = [F.lit(x) for pair in ((v, i) for i, v in enumerate(values)) for x in pair]
    return F.create_map(*entries)[column] if entries else F.lit(None).cast("int")


def encode_target(df: DataFrame, target: str, code: str = "y") -> DataFrame:
    """Sorted classes to 0..k-1: a literal lookup for a short class list, a join for a long one."""
    short = short_levels(df, [target])
    if target in short:
        return df.withColumn(code, literal_code(short[target], F.col(target)))
    return df.join(sorted_codes(df, [], target, code), target, "left")


# ---- ordinal and one-hot ---------------------------------------------------------------------


@dataclass(frozen=True)
class OrdinalEncoder:
    """Sorted categories to 0..n-1; unknown and missing values as set, ``shift`` added at the end.

    ``unknown=-1, missing=-2``: plain; ``missing=None``: missing stays missing;
    ``unknown=missing=-1, shift=1``: 0 means unknown.
    """

    columns: tuple[str, ...]
    unknown: int = -1
    missing: int | None = -2
    shift: int = 0
    dictionary: DataFrame | None = field(default=None, compare=False)
    short: Mapping[str, list] = field(default_factory=dict, compare=False)

    def fit(self, train: DataFrame) -> OrdinalEncoder:
        texts = train.select(*[F.col(c).cast("string").alias(c) for c in self.columns])
        short = short_levels(texts, self.columns)
        rows = [(c, v, i) for c, values in short.items() for i, v in enumerate(values)]
        dictionary = train.sparkSession.createDataFrame(rows, "column string, value string, code int")
        long = [c for c in self.columns if c not in short]
        if long:
            cells = texts.unpivot([], long, "column", "value")
            dictionary = dictionary.unionByName(sorted_codes(cells, ["column"], "value"))
        return OrdinalEncoder(self.columns, self.unknown, self.missing, self.shift, dictionary, short)

    def _finish(self, value: Column, code: Column) -> Column:
        missing = F.lit(self.missing).cast("int")
        return (F.when(value.isNull(), missing).otherwise(F.coalesce(code, F.lit(self.unknown))) + self.shift).cast("int")

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            if c not in self.short:  # long dictionary: an ordinary join
                codes = self.dictionary.filter(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias(f"_code_{c}"))
                df = df.join(codes, F.col(c).cast("string") == F.col("_value"), "left").drop("_value")
        encoded = {}
        for c in self.columns:
            if c in self.short:
                code = literal_code(self.short[c], F.col(c).cast("string"))
            else:
                code = F.col(f"_code_{c}")
            encoded[c] = self._finish(F.col(c), code)
        drop = [f"_code_{c}" for c in self.columns if c not in self.short]
        return df.withColumns(encoded).drop(*drop)

    def decode(self, df: DataFrame) -> DataFrame:
        """Codes back to categories; unknown and missing codes become null."""
        for c in self.columns:
            values = self.dictionary.filter(F.col("column") == c).select(F.col("value").alias("_value"), (F.col("code") + self.shift).alias(c))
            df = df.join(values, c, "left").drop(c).withColumnRenamed("_value", c)
        return df


@dataclass(frozen=True)
class OneHotEncoder:
    """One 0/1 column per category named ``column_category``; unknown or missing is all zeros."""

    columns: tuple[str, ...]
    max_categories: int = LITERAL_DICTIONARY
    categories: Mapping[str, list[str]] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> OneHotEncoder:
        counts = distinct_counts(train, self.columns)
        wide = [c for c, n in counts.items() if n > self.max_categories]
        if wide:
            raise ValueError(f"one-hot would make more than {self.max_categories} columns for {wide}; encode them ordinally")
        rows = train.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in self.columns]).first()
        return OneHotEncoder(self.columns, self.max_categories, {c: list(rows[c]) for c in self.columns})

    def transform(self, df: DataFrame) -> DataFrame:
        added = {
            f"{c}_{v}": F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0))
            for c in self.columns
            for v in self.categories[c]
        }
        return df.withColumns(added).drop(*self.columns) if added else df.drop(*self.columns)


@dataclass(frozen=True)
class SparseOneHotEncoder:
    """One sparse 0/1 vector for all columns, of any width; unknown or missing sets no entry.

    Categories are numbered by column, in sorted order within it: the entry of a category is its column's offset plus
    its code. Codes come from a dictionary that is joined where it is long, so no category becomes a column or a
    literal of its own, and the driver sees one number for each column. The vectors are built in the JVM.
    """

    columns: tuple[str, ...]
    output: str = "one_hot"
    codes: OrdinalEncoder | None = None
    widths: Mapping[str, int] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> SparseOneHotEncoder:
        codes = OrdinalEncoder(self.columns, unknown=-1, missing=-1).fit(train)
        found = {r["column"]: r["n"] for r in codes.dictionary.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        return SparseOneHotEncoder(self.columns, self.output, codes, {c: found.get(c, 0) for c in self.columns})

    @property
    def width(self) -> int:
        return sum(self.widths.values())

    def offsets(self) -> dict[str, int]:
        ends = accumulate(self.widths[c] for c in self.columns)
        return {c: end - self.widths[c] for c, end in zip(self.columns, ends)}

    def dictionary(self) -> DataFrame:
        """(column, category, index) of every entry."""
        offset = F.create_map(*[F.lit(x) for pair in self.offsets().items() for x in pair])
        return self.codes.dictionary.select("column", F.col("value").alias("category"), (F.col("code") + offset[F.col("column")]).alias("index"))

    def cells(self, df: DataFrame, key: str) -> DataFrame:
        """(key, index, value): the non-zero entries as rows."""
        coded = self.codes.transform(df.select(key, *self.columns))
        entries = [F.when(F.col(c) >= 0, F.col(c) + offset) for c, offset in self.offsets().items()]
        return coded.select(key, F.explode(F.array_compact(F.array(*entries))).alias("index"), F.lit(1.0).alias("value"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the columns by the vector column ``output``."""
        kept = [c for c in df.columns if c not in self.columns]
        wide = [c for c in self.columns if self.widths[c]]
        if not wide:
            return df.select(*kept, array_to_vector(F.array().cast("array<double>")).alias(self.output))
        coded = self.codes.transform(df)
        # a code beyond the last category is the invalid one, which sets no entry
        coded = coded.withColumns({c: F.when(F.col(c) < 0, self.widths[c]).otherwise(F.col(c)).cast("double") for c in wide})
        places = [f"_hot_{i}" for i in range(len(wide))]
        largest = df.sparkSession.createDataFrame([tuple(float(self.widths[c] - 1) for c in wide)], wide)
        vectors = VectorIndicator(inputCols=wide, outputCols=places, dropLast=True, handleInvalid="keep").fit(largest).transform(coded)
        return VectorAssembler(inputCols=places, outputCol=self.output).transform(vectors).select(*kept, self.output)


@dataclass(frozen=True)
class CardinalitySplitEncoder:
    """One-hot up to ``limit`` categories, ordinal (missing stays missing) above."""

    columns: tuple[str, ...]
    limit: int = 5
    one_hot: OneHotEncoder | None = None
    ordinal: OrdinalEncoder | None = None

    def fit(self, train: DataFrame) -> CardinalitySplitEncoder:
        counts = distinct_counts(train, self.columns)
        low = tuple(c for c in self.columns if counts[c] <= self.limit)
        high = tuple(c for c in self.columns if counts[c] > self.limit)
        return CardinalitySplitEncoder(
            self.columns,
            self.limit,
            OneHotEncoder(low).fit(train) if low else None,
            OrdinalEncoder(high, missing=None).fit(train) if high else None,
        )

    def transform(self, df: DataFrame) -> DataFrame:
        for step in (self.one_hot, self.ordinal):
            df = step.transform(df) if step else df
        return df


# ---- numeric steps ---------------------------------------------------------------------------


@dataclass(frozen=True)
class MedianImputer:
    """Missing numbers become the exact training median; columns without any value are dropped."""

    columns: tuple[str, ...]
    medians: Mapping[str, float | None] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> MedianImputer:
        return MedianImputer(self.columns, {c: q[0] for c, q in exact_quantiles(train, self.columns, [0.5]).items()})

    def transform(self, df: DataFrame) -> DataFrame:
        gone = [c for c, m in self.medians.items() if m is None]
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in self.medians.items() if m is not None}).drop(*gone)


@dataclass(frozen=True)
class ConstantImputer:
    columns: tuple[str, ...]
    value: object = "missing_value"

    def fit(self, train: DataFrame) -> ConstantImputer:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(self.value)) for c in self.columns})


@dataclass(frozen=True)
class DropConstantColumns:
    """Drop numeric columns whose training values are all equal."""

    columns: tuple[str, ...]
    constant: tuple[str, ...] = ()

    def fit(self, train: DataFrame) -> DropConstantColumns:
        present = [c for c in self.columns if c in train.columns]
        row = train.agg(
            *[F.min(c).alias(f"lo_{c}") for c in present], *[F.max(c).alias(f"hi_{c}") for c in present]
        ).first()
        return DropConstantColumns(self.columns, tuple(c for c in present if row[f"lo_{c}"] == row[f"hi_{c}"]))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.constant)


@dataclass(frozen=True)
class StandardScaler:
    """``(x - mean) / population std``; a zero std counts as 1."""

    columns: tuple[str, ...]
    moments: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> StandardScaler:
        row = train.agg(
            *[F.avg(c).alias(f"m_{c}") for c in self.columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in self.columns]
        ).first()
        return StandardScaler(self.columns, {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in self.columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.moments.items()})


@dataclass(frozen=True)
class QuantileTransformer:
    """Map a number to its place among the training quantiles, then to a normal score.

    Fit keeps ``n_quantiles`` exact quantiles per column. A value between two of them is
    interpolated; runs of equal quantiles take the middle of the run. ``output="uniform"``
    stops before the normal scores, which are clipped at 1e-7.
    """

    columns: tuple[str, ...]
    n_quantiles: int = 1000
    output: str = "normal"
    quantiles: Mapping[str, list[float]] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> QuantileTransformer:
        n_rows = train.count()
        n = max(2, min(self.n_quantiles, n_rows))
        if n_rows <= BUFFER_ROWS:
            places = [i / (n - 1) for i in range(n)]
            row = train.agg(*[F.percentile(F.col(c).cast("double"), places).alias(c) for c in self.columns]).first()
            return QuantileTransformer(self.columns, n, self.output, {c: list(row[c] or []) for c in self.columns})
        rows = grouped_quantiles(train, [], self.columns, grid=n).orderBy("column", "p").collect()  # n per column
        found: dict[str, list[float]] = {c: [] for c in self.columns}
        for r in rows:
            found[r["column"]].append(r["value"])
        return QuantileTransformer(self.columns, n, self.output, found)

    def _marks(self, df: DataFrame, c: str) -> DataFrame:
        """Per search bucket: its mark, the next mark, and where the run of the mark lies (at most n rows)."""
        grid, n = self.quantiles[c], len(self.quantiles[c])
        marks = sorted(set(grid))
        rows = []
        for k, mark in enumerate(marks):
            first, last = grid.index(mark), n - 1 - grid[::-1].index(mark)
            rows.append((float(k + 1), mark, marks[min(k + 1, len(marks) - 1)], float(last), (first + last) / 2))
        return df.sparkSession.createDataFrame(
            rows, f"_at_{c} double, _mark_{c} double, _next_{c} double, _end_{c} double, _middle_{c} double"
        )

    def transform(self, df: DataFrame) -> DataFrame:
        known = [c for c in self.columns if self.quantiles.get(c)]
        # binary search among the marks inside the JVM
        search = Bucketizer(
            splitsArray=[[float("-inf"), *sorted(set(self.quantiles[c])), float("inf")] for c in known],
            inputCols=[f"_x_{c}" for c in known],
            outputCols=[f"_at_{c}" for c in known],
            handleInvalid="keep",
        )
        found = search.transform(df.withColumns({f"_x_{c}": F.col(c).cast("double") for c in known}))
        for c in known:
            found = found.join(F.broadcast(self._marks(df, c)), f"_at_{c}", "left")  # n_quantiles rows at most

        def score(c: str) -> Column:
            grid, n = self.quantiles[c], len(self.quantiles[c])
            x, mark = F.col(f"_x_{c}"), F.col(f"_mark_{c}")
            place = (
                F.when(x <= grid[0], F.lit(0.0))
                .when(x >= grid[-1], F.lit(1.0))
                .when(x == mark, F.col(f"_middle_{c}") / (n - 1))
                .otherwise((F.col(f"_end_{c}") + (x - mark) / (F.col(f"_next_{c}") - mark)) / (n - 1))
            )
            return F.when(x.isNotNull(), place)

        placed = found.select(*[score(c).alias(c) if c in known else F.col(c) for c in df.columns])
        if self.output == "uniform":
            return placed
        # the place is a column of its own before the long normal formula uses it several times
        clipped = placed.withColumns({c: F.greatest(F.least(F.col(c), F.lit(1 - 1e-7)), F.lit(1e-7)) for c in known})
        return clipped.withColumns({c: F.when(F.col(c).isNotNull(), normal_quantile(c)) for c in known})


# ---- category folding -------------------------------------------------------------------------


@dataclass(frozen=True)
class InfrequentFolder:
    """For columns with more than ``max_bins`` categories keep the top ``max_bins - 1`` of training, fold its rest.

    ``widths`` has the number of categories of each column by the dataset's profile; columns it does not name are
    measured in training. Equal counts are ordered by value, as text. A category that training did not hold stays as it
    is, so that later encoders know it for unseen. All columns are counted in one pass. The kept lists are bounded by
    ``max_bins`` and are literals in the plan; the rest is joined, broadcast up to ``LITERAL_DICTIONARY`` categories.
    """

    columns: tuple[str, ...]
    max_bins: int = 255
    label: str = "infrequent"
    widths: Mapping[str, int] = field(default_factory=dict)
    kept: Mapping[str, list] = field(default_factory=dict)
    rest: DataFrame | None = field(default=None, compare=False)
    small: Mapping[str, bool] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> InfrequentFolder:
        cells = train.select(*[F.col(c).cast("string").alias(c) for c in self.columns]).unpivot([], list(self.columns), "column", "value")
        counted = cells.filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        ensure_checkpoint_dir(train.sparkSession)
        counted = counted.checkpoint()  # the dictionary of all columns, read again for each of them
        found = {r["column"]: r["n"] for r in counted.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        wide = [c for c in self.columns if {**found, **self.widths}.get(c, 0) > self.max_bins]
        place = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
        top = counted.filter(F.col("column").isin(wide)).withColumn("place", place).filter(F.col("place") < self.max_bins)
        kept: dict[str, list] = {c: [] for c in wide}
        for r in top.orderBy("column", "place").collect():  # max_bins - 1 rows for each column
            kept[r["column"]].append(r["value"])
        small = {c: found.get(c, 0) <= LITERAL_DICTIONARY for c in wide}
        return InfrequentFolder(self.columns, self.max_bins, self.label, self.widths, kept, counted, small)

    def transform(self, df: DataFrame) -> DataFrame:
        """One join for each wide column on the whole rows; kept and missing values spread over all partitions."""
        order = df.columns
        for c, top in self.kept.items():
            text = F.col(c).cast("string")
            others = text.isNotNull() & ~text.isin(top)
            # rows that cannot match get keys of their own, so that a frequent kept value is no hot key
            key = F.when(others, text).otherwise(F.concat(F.lit("\0"), F.xxhash64(*order).cast("string")))
            rest = self.rest.filter((F.col("column") == c) & ~F.col("value").isin(top)).select(F.col("value").alias("_rest"))
            joined = df.withColumn("_fold", key).join(F.broadcast(rest) if self.small[c] else rest, F.col("_fold") == F.col("_rest"), "left")
            df = joined.select(*[F.when(others & F.col("_rest").isNotNull(), self.label).otherwise(F.col(c)).alias(c) if x == c else F.col(x) for x in order])
        return df


# ---- whole rows -----------------------------------------------------------------------------


def feature_array(df: DataFrame, key: str, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Features in the given order as one array of doubles."""
    return df.select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias(output))


def categories_as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def equal_count_bins(df: DataFrame, column: str, n_bins: int, key: str, output: str = "bin") -> DataFrame:
    """Bins 1..n of equal size by rank (equal to ``ntile``), larger bins first; ties by key."""
    placed = running_before(
        df.select(key, column).withColumn("_one", F.lit(1)), [], [F.col(column), F.col(key)], {"_place": "_one"}
    )
    n = df.agg(F.count(F.lit(1))).scalar()
    sized = placed.withColumn("_n", n)
    small = F.floor(F.col("_n") / n_bins)
    large_bins = F.col("_n") % n_bins
    large_rows = large_bins * (small + 1)
    bin_no = F.when(F.col("_place") < large_rows, F.floor(F.col("_place") / (small + 1))).otherwise(
        large_bins + F.floor((F.col("_place") - large_rows) / F.greatest(small, F.lit(1)))
    )
    return sized.select(key, column, (bin_no + 1).cast("int").alias(output))


def _partners(df: DataFrame, key: str, columns: Sequence[str], seed: int, digits: int) -> DataFrame:
    """Give each row the next row in digest order within its digest piece (the first after the last)."""
    ordered = df.withColumn("_digest", order_key(seed, key)).withColumn("_piece", F.substring("_digest", 1, digits))
    window = W.partitionBy("_piece").orderBy("_digest")
    whole = window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    row = F.struct(*[F.col(c) for c in columns])
    paired = ordered.withColumn("_partner", F.coalesce(F.lead(row).over(window), F.first(row).over(whole)))
    return paired.select(*df.columns, *[F.col("_partner")[c].alias(f"_partner_{c}") for c in columns])


def mix_rows(df: DataFrame, key: str, columns: Sequence[str], target: str, lam: float, seed: int = 0, digits: int = 3) -> DataFrame:
    """``lam * row + (1 - lam) * partner`` for numeric columns; both labels are kept."""
    paired = _partners(df, key, [*columns, target], seed, digits)
    return paired.select(
        key,
        *[(lam * F.col(c) + (1 - lam) * F.col(f"_partner_{c}")).alias(c) for c in columns],
        F.col(target).alias(f"{target}_a"),
        F.col(f"_partner_{target}").alias(f"{target}_b"),
    )


def noise_cells(
    df: DataFrame, key: str, columns: Sequence[str], lam: float, mode: str = "cutmix", seed: int = 0, digits: int = 3
) -> DataFrame:
    """With probability ``lam`` replace a cell by the partner's (``cutmix``) or by 0 (``missing``)."""
    source = _partners(df, key, columns, seed, digits) if mode == "cutmix" else df
    hit = lambda c: uniform(seed, F.lit(c), F.col(key)) < lam
    other = lambda c: F.col(f"_partner_{c}") if mode == "cutmix" else F.lit(0.0)
    return source.select(key, *[F.when(hit(c), other(c)).otherwise(F.col(c)).alias(c) for c in columns])


# ---- chaining ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Steps:
    """Encoders applied one after the other, each fitted on the training rows as left by the ones before."""

    steps: tuple

    def fit(self, train: DataFrame) -> Steps:
        fitted = []
        for step in self.steps:
            step = step.fit(train)
            train = step.transform(train)
            fitted.append(step)
        return Steps(tuple(fitted))

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df
