"""Quality rules, line first: judge every line, drop the ones that fail, then judge what is left.

Row by row and without a shuffle, all in built-in expressions. A line with at least one word fails when it

* does not end in closing punctuation (headings, menus, cut-off text),
* looks like navigation (two or more separators such as ``|`` or ``>`` between labels),
* holds a boilerplate phrase,
* is mostly symbols (too many words with one of ``#*$%&|<>``), or
* shouts (three or more words, letters without a single lower-case one).

A document is rejected by the base rules (too short, or too repetitive), and by the method when its failing
lines hold more than ``max_loss`` of its characters.

Cases: null text counts as empty; an empty or blank document has no words and is rejected as too short; blank lines
are neither judged nor removed; repeated rows are judged each on its own; an empty table gives an empty result; other
columns pass through, and a result column replaces an input column of the same name.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from tabgauge.llm.common import settled, words

# The symbols, separators, closing characters and phrases that the rules look for.
SYMBOLS = list("#*$%&|<>")
SEPARATORS = list("|»›>•·")
CLOSING = list(".!?…:;\"')]»”’。！？")
BOILERPLATE = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies",
    "enable javascript", "javascript is disabled", "lorem ipsum", "click here", "sign in to", "log in to",
    "subscribe to our", "skip to content", "skip to main content", "powered by",
]


def _any_of(text: Column, needles: list[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, [text.contains(x) for x in needles])


def line_passes(line: Column, symbols: Column, separators: Column, phrases: Column, symbol_share: float) -> Column:
    """Whether one line with a word keeps its place.

    ``symbols``, ``separators`` and ``phrases`` say whether the document holds any at all; most hold none, and their
    lines skip the counts.
    """
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    with_symbol = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D#*$%&|<>]*[#*$%&|<>][^\x20\x09-\x0D]*"))
    end = F.rtrim(F.replace(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" ")))
    return (
        F.substring(end, -1, 1).isin(CLOSING)
        & (~symbols | (with_symbol <= F.lit(symbol_share) * n))
        & (~separators | (F.regexp_count(line, F.lit(r" [|»›>•·] ")) < 2))
        & ~(~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & (n >= 3))
        & (~phrases | ~_any_of(F.lower(line), BOILERPLATE))
    )


def _window_hashes(w: Column) -> Column:
    """A hash for each 3-word window."""
    return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )
    )


def _repeat_words(hashes: Column, in_order: Column) -> Column:
    """Words inside a 3-word window that the text holds at least twice.

    Sorted hashes put equal windows side by side. Only texts with a repeat are sorted again, with their places.
    """
    n = F.size(in_order)
    none = F.lit(0).cast("bigint")
    repeats = F.exists(F.sequence(F.lit(1), n - 1), lambda k: F.get(in_order, k) == F.get(in_order, k - 1))
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    again = F.filter(
        F.transform(
            F.arrays_zip(
                placed.alias("a"),
                F.concat(nothing, placed).alias("b"),
                F.concat(F.slice(placed, 2, n), nothing).alias("c"),
            ),
            lambda x: F.when((x["a"]["h"] == x["b"]["h"]) | (x["a"]["h"] == x["c"]["h"]), x["a"]["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))
    return F.when(n < 2, none).when(~repeats, none).otherwise(covered.cast("bigint"))


def clean_lines(
    df: DataFrame,
    text: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_loss: float = 0.3,
    symbol_share: float = 0.3,
) -> DataFrame:
    """Add the counts, both verdicts and ``clean_text`` (the text without its failing lines) to every row.

    Added columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), lost_chars and line_chars
    (characters in failing lines and in all lines with a word), base_failed, kept, clean_text. Text without a failing
    line comes back unchanged.
    """
    added = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "line_chars",
        "base_failed", "kept", "clean_text",
    ]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in added]).alias("row")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    n_symbols = functools.reduce(
        lambda a, b: a + b, [F.octet_length("t") - F.octet_length(F.replace("t", F.lit(c), F.lit(""))) for c in SYMBOLS]
    )
    base = df.select(row, t.alias("t"), words(t).alias("w"), F.split(t, "\n").alias("lines"))
    base = base.select(
        *["row", "t", "w", "lines"],
        n_symbols.cast("bigint").alias("n_symbols"),
        _any_of(F.col("t"), SEPARATORS).alias("separators"),
        _any_of(F.lower("t"), BOILERPLATE).alias("phrases"),
        F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("full"),
        _window_hashes(F.col("w")).alias("h"),
    )
    passes = lambda x: line_passes(x, F.col("n_symbols") > 0, F.col("separators"), F.col("phrases"), symbol_share)
    base = base.select(
        *["row", "t", "w", "lines", "full", "n_symbols", "h"],
        F.filter("full", lambda x: ~passes(x)).alias("bad"),
        F.sort_array("h").alias("s"),
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(x))
    out = base.select(
        *["row", "t", "lines", "bad"],
        F.size("w").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        (F.size("full") - F.size(F.array_distinct("full"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("h"), F.col("s")).alias("n_repeat_words"),
        total("bad").alias("lost_chars"),
        total("full").alias("line_chars"),
    )
    base_failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    kept = ~base_failed & (F.col("lost_chars") <= F.lit(max_loss) * F.col("line_chars"))
    bad = F.array_distinct("bad")
    clean = F.when(F.size("bad") == 0, F.col("t")).otherwise(
        F.array_join(F.filter("lines", lambda x: ~F.array_contains(bad, x)), "\n")
    )
    judged = out.select(
        "row.*",
        *added[:7],
        base_failed.alias("base_failed"),
        kept.alias("kept"),
        clean.alias("clean_text"),
    )
    return settled(judged)


def documents_quality(docs: DataFrame) -> DataFrame:
    """Counts and verdict per document, as the registered query returns them."""
    return clean_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lost_chars", "line_chars",
    )


SQL = r"""
with t as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents
), w as (
  select rid, doc_id, t,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as f
  from t
), windows as (
  select rid, i, list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2) as g
  from (select rid, w, unnest(range(1, len(w) - 1)) as i from w)
), again as (
  select rid, i from windows qualify count(*) over (partition by rid, g) > 1
), repeats as (
  select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from again) group by rid
), lines as (
  select rid, f, list_filter(f, lambda x: not (
      right(rtrim(replace(replace(x, chr(9), ' '), chr(13), ' ')), 1) in
          ('.', '!', '?', '…', ':', ';', '"', '''', ')', ']', '»', '”', '’', '。', '！', '？')
      and len(regexp_extract_all(x, '[^\x20\x09-\x0D#*$%&|<>]*[#*$%&|<>][^\x20\x09-\x0D]*'))
          <= 0.3::double * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
      and len(regexp_extract_all(x, ' [|»›>•·] ')) < 2
      and not (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 3
          and not regexp_matches(x, '\p{Ll}') and regexp_matches(x, '\p{Lu}'))
      and not regexp_matches(lower(x), '""" + "|".join(BOILERPLATE) + r"""')
  )) as bad
  from w
), counts as (
  select w.doc_id,
    len(w)::bigint as n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    (len(lines.f) - len(list_distinct(lines.f)))::bigint as n_dup_lines,
    coalesce(repeats.n, 0)::bigint as n_repeat_words,
    coalesce(list_sum(list_transform(bad, lambda x: length(x))), 0)::bigint as lost_chars,
    coalesce(list_sum(list_transform(lines.f, lambda x: length(x))), 0)::bigint as line_chars
  from w join lines using (rid) left join repeats using (rid)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost_chars <= 0.3::double * line_chars as kept,
  lost_chars, line_chars
from counts
"""
