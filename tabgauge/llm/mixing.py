"""Mixing sources to target weights by hierarchical budgeting.

The token budget flows down a tree of levels (here domain, language, source). At each node the children share its
budget by weight; a child that holds less than its share (its tokens times ``max_epochs``) gives up the difference,
which goes to its siblings by weight first, and to the node's own siblings only when all its children are full. Each
leaf then serves its budget as whole epochs plus a prefix, in tokens, of one more epoch in a seeded order. The document
on the cut is the last one in, so a leaf serves its budget and less than one document more.

How it scales: the documents are reduced to (leaf, id, tokens) once, into a table in the checkpoint folder. Budgets are
windows over the leaf table, whose size is the number of sources. The prefix of a leaf is found without sorting the
leaf: 65,536 pieces by leading digest digits are summed, the piece that holds the cut is the only one that is sorted,
and its outcome is one digest for each leaf. Documents then meet the leaf table, broadcast while it is small.

Cases: null text has no tokens; a null level is a child of its own, named by the empty text; rows that share an id go
together; a null id sorts as the empty text; a leaf without tokens gets nothing; shares are rounded down, which leaves
less than one token for each node; a child of weight 0 gets nothing, and what it holds counts nowhere above it; a
negative weight is an error; an empty table gives an empty result; other columns pass through, and a result column
replaces an input column of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabgauge.functions.digest import order_key
from tabgauge.llm.common import free_name, table, words, written

PIECE_DIGITS = 4
BROADCAST_LEAVES = 100_000


def weight_of(level: Column, weights: dict[str, int] | None) -> Column:
    """The weight of a child by its name; 1 where none is given."""
    found = F.lit(1)
    for name, weight in sorted((weights or {}).items()):
        if weight < 0:
            raise ValueError(f"the weight of {name} is negative")
        found = F.when(level == name, F.lit(int(weight))).otherwise(found)
    return found.cast("decimal(9,0)")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: dict, total: int, max_epochs: int) -> DataFrame:
    """(levels..., tokens, budget): what every leaf may serve. ``leaves`` has the levels and their tokens."""
    shut = F.lit(False)
    for level in levels:
        shut |= weight_of(F.col(level), weights.get(level)) == 0
    nodes = leaves.withColumn("cap", F.when(shut, 0).otherwise(F.col("tokens") * max_epochs).cast("decimal(20,0)"))
    given = nodes.agg(F.least(F.coalesce(F.sum("cap"), F.lit(0)), F.lit(int(total))).cast("decimal(20,0)").alias("given"))
    given = given.withColumn("_all", F.lit(1))
    above: list[str] = []
    for level in levels:
        here = [*above, level]
        children = nodes.groupBy(*here).agg(F.sum("cap").cast("decimal(20,0)").alias("cap"))
        children = children.withColumn("w", weight_of(F.col(level), weights.get(level)))
        keys = above or ["_all"]
        children = (children if above else children.withColumn("_all", F.lit(1))).join(given, keys)
        share = F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double")).otherwise(0.0)
        order = W.partitionBy(*keys).orderBy(share, level)
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("decimal(20,0)")
        rest = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)).cast("decimal(12,0)")
        full = children.withColumn("before", before).withColumn("rest", rest).withColumn(
            "full", F.expr("cap * rest <= (given - before) * w")
        )
        group = W.partitionBy(*keys)
        shared = full.withColumn(
            "left", (F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0))).cast("decimal(20,0)")
        ).withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(group).cast("decimal(12,0)"))
        given = shared.select(
            *here,
            F.when(F.col("full"), F.col("cap")).otherwise(F.expr("left * w div open")).cast("decimal(20,0)").alias("given"),
        )
        above = here
    return leaves.join(given, list(levels)).select(*levels, "tokens", F.col("given").cast("bigint").alias("budget"))


def _epoch_digest(seed: int) -> Column:
    return order_key(seed, F.col("epochs"), F.coalesce(F.col("id").cast("string"), F.lit("")))


def leaf_plan(slim: DataFrame, levels: Sequence[str], weights: dict, share: float, max_epochs: int, seed: int):
    """(levels..., tokens, budget, epochs, cut): whole epochs of every leaf, and the last digest of the next one."""
    leaves = written(slim.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), "mixing-leaves")
    corpus = leaves.agg(F.sum("tokens")).first()[0] or 0
    planned = written(
        budgets(leaves, levels, weights, int(corpus * share), max_epochs).select(
            "*",
            F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("epochs"),
            F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("rest"),
        ),
        "mixing-plan",
    )
    few = leaves.count() <= BROADCAST_LEAVES
    open_leaves = planned.filter("rest > 0").select(*levels, "epochs", "rest")
    placed = slim.join(F.broadcast(open_leaves) if few else open_leaves, list(levels)).select(
        *levels, "rest", "tokens", _epoch_digest(seed).alias("digest")
    )
    placed = placed.withColumn("piece", F.substring("digest", 1, PIECE_DIGITS))
    pieces = placed.groupBy(*levels, "rest", "piece").agg(F.sum("tokens").alias("size"))
    running = W.partitionBy(*levels).orderBy("piece")  # at most 16 ** PIECE_DIGITS rows a leaf
    cuts = (
        pieces.withColumn("end", F.sum("size").over(running.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("start", F.col("end") - F.col("size"))
        .filter((F.col("end") >= F.col("rest")) & (F.col("start") < F.col("rest")))
        .select(*levels, "piece", "start")
    )
    cut_rows = placed.join(cuts, [*levels, "piece"]).groupBy(*levels, "piece", "rest", "start", "digest").agg(
        F.sum("tokens").alias("size")
    )
    inside = W.partitionBy(*levels, "piece").orderBy("digest").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = (
        cut_rows.withColumn("spent", F.col("start") + F.sum("size").over(inside) >= F.col("rest"))
        .groupBy(*levels)
        .agg(F.min(F.when(F.col("spent"), F.col("digest"))).alias("cut"))  # the last document in
    )
    return planned.join(last, list(levels), "left").select(
        *levels, F.col("tokens").alias("leaf_tokens"), "budget", "epochs", F.coalesce("cut", F.lit("")).alias("cut")
    ), few


def mix(
    df: DataFrame,
    levels: dict[str, Column],
    tokens: Column,
    key: str = "doc_id",
    weights: dict[str, dict[str, int]] | None = None,
    share: float = 0.5,
    max_epochs: int = 2,
    seed: int = 42,
) -> DataFrame:
    """Rows that are served at least once, with the levels, n_tokens, leaf_budget and copies (how often) added.

    ``levels`` maps level names, top first, to columns of ``df``; ``tokens`` counts a row's tokens; ``share`` is the
    budget as a share of the corpus; ``weights`` has weights of children by level and name, else 1.
    """
    names = [f"_level{i}" for i in range(len(levels))]
    as_text = [F.coalesce(c.cast("string"), F.lit("")) for c in levels.values()]
    slim = written(
        df.select(
            *[c.alias(n) for n, c in zip(names, as_text)],
            F.col(f"`{key}`").alias("id"),
            F.coalesce(tokens, F.lit(0)).cast("bigint").alias("tokens"),
        ),
        "mixing-tokens",
    )
    by_name = {n: (weights or {}).get(level) for n, level in zip(names, levels)}
    plan, few = leaf_plan(slim, names, by_name, share, max_epochs, seed)
    added = [*levels, "n_tokens", "leaf_budget", "copies"]
    row = free_name(df, "row")
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row),
        *[c.alias(n) for n, c in zip(names, as_text)],
        F.coalesce(tokens, F.lit(0)).cast("bigint").alias("n_tokens"),
    ).join(F.broadcast(plan) if few else plan, names)
    served = packed.withColumn("id", F.col(row)[key]).withColumn(
        "copies", F.col("epochs") + F.when(_epoch_digest(seed) <= F.col("cut"), 1).otherwise(0)
    )
    lower = {c.lower() for c in added}
    return served.filter("copies > 0").select(
        *[F.col(row)[c].alias(c) for c in df.columns if c.lower() not in lower],
        *[F.col(n).alias(level) for n, level in zip(names, levels)],
        "n_tokens",
        F.col("budget").alias("leaf_budget"),
        F.col("copies").cast("bigint").alias("copies"),
    )


#: The table has no domain: sources are dealt to four by their number. Weights are the mix's targets.
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}


def document_levels() -> dict[str, Column]:
    number = F.coalesce(F.regexp_extract("source", "[0-9]+", 0).try_cast("int"), F.lit(0))
    return {"domain": F.concat(F.lit("d"), F.pmod(number, F.lit(4)).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def mix_documents(docs: DataFrame) -> DataFrame:
    return mix(docs, document_levels(), F.size(words(F.col("text"))), weights={"lang": LANG_WEIGHTS})


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix_documents(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "leaf_budget", "copies")


def _level_sql(name: str, above: list[str], level: str, parent: str, weight: str) -> str:
    here = ", ".join([*above, level])
    keys = ", ".join(above) if above else "1"
    join = f"join {parent} using ({', '.join(above)})" if above else f"cross join {parent}"
    return f"""
{name}_c as (
  select {here}, cap, {weight}::hugeint as w, given
  from (select {here}, sum(cap)::hugeint as cap from caps group by {here}) {join}
), {name}_f as (
  select *, cap * sum(w) over (partition by {keys} order by cap::double / w::double, {level}
      rows between current row and unbounded following)
    <= (given - coalesce(sum(cap) over (partition by {keys} order by cap::double / w::double, {level}
      rows between unbounded preceding and 1 preceding), 0)) * w as filled
  from {name}_c
), {name} as (
  select {here}, case when filled then cap else
      (given - coalesce(sum(cap) filter (where filled) over (partition by {keys}), 0)) * w
      // sum(w) filter (where not filled) over (partition by {keys}) end::hugeint as given
  from {name}_f
)"""


SQL = f"""
with docs as (
  select doc_id, 'd' || (coalesce(try_cast(regexp_extract(source, '[0-9]+') as int), 0) % 4)::varchar as domain,
    coalesce(lang, '') as lang, coalesce(source, '') as source,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::bigint as tokens
  from documents
), leaves as (select domain, lang, source, sum(tokens)::hugeint as tokens from docs group by all
), caps as (select *, tokens * 2 as cap from leaves
), root as (select least(sum(cap), floor(sum(tokens)::double * 0.5)::hugeint) as given from caps
),{_level_sql("l1", [], "domain", "root", "1")
},{_level_sql("l2", ["domain"], "lang", "l1", "(case lang when 'en' then 4 when 'de' then 2 when 'es' then 2 when 'fr' then 2 else 1 end)")
},{_level_sql("l3", ["domain", "lang"], "source", "l2", "1")
}, plan as (
  select domain, lang, source, given as budget, case when tokens > 0 then given // tokens else 0 end as epochs,
    case when tokens > 0 then given % tokens else 0 end as rest
  from l3 join leaves using (domain, lang, source)
), ordered as (
  select docs.*, budget, epochs, rest,
    sum(tokens) over (partition by domain, lang, source order by md5('42:' || epochs::varchar || ':' || coalesce(doc_id::varchar, ''))) as upto
  from docs join plan using (domain, lang, source)
)
select doc_id, domain, lang, source, tokens as n_tokens, budget::bigint as leaf_budget,
  (epochs + case when upto - tokens < rest then 1 else 0 end)::bigint as copies
from ordered where epochs + case when upto - tokens < rest then 1 else 0 end > 0
"""
