"""Scalar column functions: text clean-up, probabilities, value maps, step tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def nan_to_null(value) -> Column:
    """Missing values are null everywhere inside the engine."""
    return F.when(~F.isnan(_c(value)), _c(value))


# ---- text -----------------------------------------------------------------------------


def camel_case(text) -> Column:
    """``some_long-name`` to ``SomeLongName``; a digit or sign also ends a word."""
    words = F.regexp_replace(F.regexp_replace(_c(text), "[_-]+", " "), r"([^\p{L} ])(?=\p{L})", "$1 ")
    return F.replace(F.initcap(words), F.lit(" "), F.lit(""))


def citation_style(key) -> Column:
    """``name-venue22a`` to ``Name et al. 22``: first part, then two digits before the last letter."""
    parts = F.split(_c(key), "-")
    last = F.element_at(parts, -1)
    # characters from place -3 up to, not including, the last one; short texts give what is there
    stop = F.greatest(F.length(last) - 1, F.lit(0))
    start = F.greatest(F.length(last) - 3, F.lit(0))
    year = F.substring(last, start + 1, stop - start)
    return F.concat(camel_case(F.element_at(parts, 1)), F.lit(" et al. "), year)


def lookup_name(name, catalogue_name) -> Column:
    return F.lower(F.coalesce(_c(name), _c(catalogue_name)))


def link_text(identifier, url_prefix: str) -> Column:
    """LaTeX link with the id as text."""
    return F.concat(
        F.lit("\\href{" + url_prefix), _c(identifier).cast("string"), F.lit("}{"), _c(identifier).cast("string"), F.lit("}")
    )


def escape_underscores(text) -> Column:
    return F.replace(_c(text), F.lit("_"), F.lit("\\_"))


def model_display_name(name, suffix: str = "_early_stop_valid") -> Column:
    """Strip the suffix, turn underscores into blanks, capitalise the first letter of each word."""
    return F.initcap(F.replace(F.replace(_c(name), F.lit(suffix), F.lit("")), F.lit("_"), F.lit(" ")))


def quality_column_name(prefix: str, quality: str) -> str:
    return prefix + "_" + quality.replace("NumberOf", "n_")


def year_of(text) -> Column:
    """Year of a text of four digits; anything else is null."""
    return F.when(_c(text).rlike("^[0-9]{4}$"), F.year(F.try_to_timestamp(_c(text), F.lit("yyyy"))))


def keyword_value(text) -> Column:
    """``None`` becomes null, ``True``/``False`` become lower-case JSON words, others stay."""
    return F.when(_c(text) == "None", F.lit(None)).when(_c(text).isin("True", "False"), F.lower(_c(text))).otherwise(_c(text))


def keyword_map(mapping) -> Column:
    return F.transform_values(_c(mapping), lambda _, v: keyword_value(v))


def metric_part_name(part, metric) -> Column:
    return F.concat_ws("_", _c(part), _c(metric))


def model_alias(name) -> Column:
    """Configuration folder of a model: variants of one library share its folder."""
    name = _c(name)
    return (
        F.when(name.startswith("xgb"), F.lit("xgb"))
        .when(name.startswith("lgbm"), F.lit("lgbm"))
        .otherwise(F.regexp_replace(name, "_early_stop_valid", ""))
    )


# ---- probabilities ----------------------------------------------------------------------


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def softmax(logits) -> Column:
    """Softmax of an array, shifted by its maximum against overflow."""
    top = F.array_max(_c(logits))
    powers = F.transform(_c(logits), lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)
    return F.transform(powers, lambda v: v / total)


def argmax_label(probs) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(_c(probs), F.array_max(_c(probs))) - 1).cast("int")


def rounded_label(p) -> Column:
    """Label of a single probability: half rounds to even, so 0.5 is class 0."""
    return F.bround(_c(p), 0).cast("int")


def threshold_label(p, threshold: float = 0.5) -> Column:
    return F.when(_c(p) >= threshold, 1).otherwise(0)


def two_column_probs(probs) -> Column:
    """A one-entry binary probability becomes ``[1 - p, p]``."""
    p = _c(probs)
    return F.when(F.size(p) == 1, F.array(1 - p[0], p[0])).otherwise(p)


def align_probs(probs, classes) -> Column:
    """Keep the columns of ``classes`` (0-based array) and rescale, or pad with zeros if too few."""
    p, classes = _c(probs), _c(classes)
    picked = F.transform(classes, lambda k: F.element_at(p, (k + 1).cast("int")))
    total = F.aggregate(picked, F.lit(0.0), lambda a, v: a + v)
    padded = F.concat(p, F.array_repeat(F.lit(0.0), (F.size(classes) - F.size(p)).cast("int")))
    return F.when(F.size(p) > F.size(classes), F.transform(picked, lambda v: v / total)).otherwise(padded)


def normal_quantile(p) -> Column:
    """Inverse of the standard normal distribution function (Acklam's published rational form)."""
    # fixed values of the approximation, relative error below 1.2e-9
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
    low = 0.02425
    p = _c(p)

    def poly(coefficients, x):
        value = F.lit(coefficients[0])
        for k in coefficients[1:]:
            value = value * x + F.lit(k)
        return value

    q = p - 0.5
    tail_low = F.sqrt(-2 * F.ln(p))
    tail_high = F.sqrt(-2 * F.ln(1 - p))
    return (
        F.when(p < low, poly(c, tail_low) / poly(d, tail_low))
        .when(p > 1 - low, -poly(c, tail_high) / poly(d, tail_high))
        .otherwise(q * poly(a, q * q) / poly(b, q * q))
    )


# ---- value maps and step tables ------------------------------------------------------------


def graded_value(x) -> Column:
    """Above 2 is 1, above 1 is 0, all else is 2."""
    return F.when(_c(x) > 2, 1).when(_c(x) > 1, 0).otherwise(2)


def fill_missing(value, filler) -> Column:
    return F.coalesce(_c(value), F.lit(filler))


def shift_codes(code, by: int = 1) -> Column:
    return _c(code) + by


# fixed values: (training rows below, batch size), last entry without a limit
BATCH_SIZE_STEPS = {
    "v1": [(1000, 16), (10000, 32), (50000, 64), (100000, 128), (200000, 256), (500000, 512), (None, 1024)],
    "v2": [(100000, 512), (500000, 1024), (None, 2048)],
    "v3": [(50000, 256), (100000, 512), (None, 1024)],
}


def batch_size(train_rows, version: str) -> Column:
    steps = BATCH_SIZE_STEPS[version]
    expression = F.lit(steps[-1][1])
    for limit, size in reversed(steps[:-1]):
        expression = F.when(_c(train_rows) < limit, size).otherwise(expression)
    return expression


def epoch_size(train_rows, size) -> Column:
    return F.ceil(_c(train_rows) / _c(size)).cast("bigint")


def array_chunks(values, n: int) -> Column:
    """Cut an array into pieces of ``n``; an empty array gives no piece."""
    values = _c(values)
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(values, s, F.lit(n)))


def report_summary(values: dict[str, Column], first: str = "score") -> Column:
    """``score = 0.900 | acc = 0.9 | ...`` from named numbers, three places."""
    parts = [F.format_string(f"{first} = %.3f", values[first])]
    parts += [F.concat(F.lit(f"{k} = "), F.round(v, 3).cast("string")) for k, v in values.items() if k != first]
    return F.concat_ws(" | ", *parts)
