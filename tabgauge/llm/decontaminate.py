"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams against all document windows.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and all characters beyond ASCII. Every run of
``n`` words of a benchmark item is a window; an item of fewer words is one window as it is. Windows of the documents
are hashed where they stand, looked up in the set, and every hit is verified word by word before it counts.

How it scales: documents are read twice and never exploded beyond (place, hash) pairs that meet the broadcast set in the
same stage; only hits are shuffled. The set is broadcast while it has at most ``max_broadcast`` n-grams, which bounds
its size; beyond that the same join goes through a shuffle. Verified hits come back to their text by document.

Cases: null text has no words; an item without words matches nothing; items with the same id are one item; an item with
a null id marks words but is not listed; repeated rows get the same answer; a null document id is an id like others;
an empty benchmark hits nothing; other columns pass through, and a result column replaces an input column of the same
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabgauge.llm.common import ascii_lower, free_name, settled, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _windows(w: Column, n: int) -> Column:
    """(place, length, hash) of every run of ``n`` words; places start at 1."""
    found = F.transform(
        F.sequence(F.lit(1), F.size(w) - (n - 1)),
        lambda i: F.struct(i.alias("place"), F.lit(n).alias("length"), F.xxhash64(F.slice(w, i, n)).alias("h")),
    )
    return F.when(F.size(w) >= n, found).otherwise(F.array().cast("array<struct<place:int,length:int,h:bigint>>"))


def benchmark_ngrams(benchmark: DataFrame, n: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of the items: (length, h, gram, items)."""
    w = benchmark.select(F.col(f"`{item}`").alias("item"), normal_words(F.col(f"`{text}`")).alias("w")).filter(
        F.size("w") > 0
    )
    length = F.least(F.size("w"), F.lit(n))
    grams = w.select("item", length.alias("length"), F.explode(
        F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))
    ).alias("gram"))
    return (
        grams.groupBy("length", "gram")
        .agg(F.collect_set("item").alias("items"))
        .select("length", F.xxhash64("gram").alias("h"), "gram", "items")
    )


def mark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    max_broadcast: int = 2_000_000,
) -> DataFrame:
    """Add n_words, n_hit (long), items (sorted texts), contaminated and clean_text to every row.

    ``clean_text`` is the text without the words that are hit and what stands between them and the next word.
    """
    grams = benchmark_ngrams(benchmark, n, item, item_text)
    facts = grams.groupBy("length").count().collect()  # at most n rows
    small = sum(r["count"] for r in facts) <= max_broadcast
    lengths = sorted({r["length"] for r in facts}) or [n]
    row = free_name(docs, "row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    packed = packed.select(row, F.col(row)[key].alias("id"), F.xxhash64(F.col(row)[text]).alias("text_hash"))
    windows = (
        packed.select("id", "text_hash", normal_words(F.col(row)[text]).alias("w"))
        .select("id", "text_hash", F.explode(F.concat(*[_windows(F.col("w"), k) for k in lengths])).alias("window"))
        .select("id", "text_hash", "window.*")
    )
    hits = (
        windows.join(F.broadcast(grams) if small else grams, ["length", "h"])
        .groupBy("id", "text_hash")
        .agg(F.collect_set(F.struct("place", "length", "gram", "items")).alias("hits"))
        .select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "hits")
    )
    joined = packed.join(
        hits, packed["id"].eqNullSafe(hits["hit_id"]) & (packed["text_hash"] == hits["hit_hash"]), "left"
    ).select(row, "hits", normal_words(F.col(row)[text]).alias("w"))
    verified = joined.select(
        *[row, "w"],
        F.filter("hits", lambda x: F.slice(F.col("w"), x["place"], x["length"]) == x["gram"]).alias("hits"),
    )
    placed = verified.select(
        row,
        F.size("w").cast("bigint").alias("n_words"),
        F.array_distinct(
            F.flatten(F.transform("hits", lambda x: F.sequence(x["place"], x["place"] + x["length"] - 1)))
        ).alias("places"),
        F.array_sort(
            F.array_distinct(F.transform(F.flatten(F.transform("hits", lambda x: x["items"])), lambda i: i.cast("string")))
        ).alias("items"),
    )
    nothing = F.array().cast("array<string>")
    n_hit = F.coalesce(F.size("places"), F.lit(0)).cast("bigint")
    body = F.col(row)[text]
    pieces = F.regexp_extract_all(
        body, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[^0-9A-Za-z\x{80}-\x{10FFFF}]*"), F.lit(0)
    )
    head = F.regexp_extract(body, r"^[^0-9A-Za-z\x{80}-\x{10FFFF}]+", 0)
    left = F.concat(head, F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains("places", i + 1)), ""))
    added = ["n_words", "n_hit", "items", "contaminated", "clean_text"]
    marked = placed.select(
        *[F.col(row)[c].alias(c) for c in docs.columns if c.lower() not in added],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", nothing).alias("items"),
        (n_hit > 0).alias("contaminated"),
        F.when(n_hit > 0, left).otherwise(body).alias("clean_text"),
    )
    return settled(marked)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_hits(docs, table(spark, sf_dir, "benchmark")).select(
        *["doc_id", "n_words", "n_hit"],
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents
), b as (
  select item_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark
), g as (
  select distinct item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as gram
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i
        from b where len(w) > 0)
), hits as (
  select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as gram
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from g) where len(w) >= n)
), found as (select doc_id, i, hits.n, item_id from hits join g on hits.n = g.n and hits.gram = g.gram
), places as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
  from (select distinct doc_id, item_id::varchar as item_id from found) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join items using (doc_id)
"""
