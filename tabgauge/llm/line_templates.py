"""Line deduplication by a log-template tree.

Tokens with a digit are variable fields and become ``<*>``; what is left is the template of a line. A line of such tokens
alone, as in a table of numbers, has nothing constant that could make it boilerplate: it stays unmasked. A template
hangs in a tree of fixed depth: below its number of tokens, below its first ``depth`` tokens. Two things recur:

* a template that ``min_documents`` documents hold;
* the common form of a leaf, which finds fields without a digit. A token without a digit is constant at its place if more
  than half of the leaf's lines (each template counted once for each row that holds it) have it there. A template belongs
  to the form if it has constant tokens at ``min_constant`` percent of its places and at more than ``depth`` of them; the
  other places are fields. The form recurs if ``field_documents`` documents hold one of its templates. So
  ``Posted by Anna in News`` and ``Posted by Ben in Sport`` become ``Posted by <*> in <*>``. All of this is counted, so
  no order of the lines changes it.

What recurs is dropped from every document but the one with the smallest id, of the documents that hold the template or
a template of its form.

How it scales: a document writes each of its templates once, as three numbers and the text. Counts are combined before
the shuffle. Only leaves with ``field_documents`` lines and two templates are looked at place by place; their sums are
grouped by leaf, place and token, so that a leaf with a third of all lines is spread over its places. The joins that
bring verdicts back have one row per template or leaf on one side, so what a third of all documents hold is only a large
partition of the other side, which adaptive execution splits.

Cases: null text counts as empty and stays null; blank lines and lines under ``min_tokens`` tokens are never dropped;
a null id counts as larger than every other; rows that share an id are judged alike, and a template counts once for each
of those rows towards ``min_documents`` and the half; a line that occurs several times in one document counts once; an
empty table gives an empty result; other columns pass through, and a result column replaces an input column of the same
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabgauge.llm.common import free_name, settled, table, written

FIELD = "<*>"
#: a line whose tokens all have a digit, tokens being parted by blanks
FIELDS_ALONE = r"^ *+(?:[^ \n0-9]*+[0-9][^ \n]*+ *+)++$"


def line_array(text: Column) -> Column:
    """The text's lines."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def templates(text: Column) -> Column:
    """The templates of the text's lines: tokens joined by single blanks, variable fields masked; a line of fields alone
    is its own template.

    All is done on the whole text, once, before it is cut into lines.
    """
    flat = F.coalesce(text, F.lit(""))
    for c in "\t\x0b\f\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    # a lookbehind keeps the pattern to starts of tokens; it only runs on texts with a digit
    masked = F.regexp_replace(flat, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*", FIELD)
    lines = F.split(F.when(flat.rlike("[0-9]"), masked).otherwise(flat), "\n")
    # only texts with a line of fields alone look at each line
    unlike = F.zip_with(
        F.split(flat, "\n"), F.split(masked, "\n"), lambda line, m: F.when(line.rlike(FIELDS_ALONE), line).otherwise(m)
    )
    return F.transform(F.when(flat.rlike(f"(?m){FIELDS_ALONE}"), unlike).otherwise(lines), single_blanks)


def single_blanks(line: Column) -> Column:
    return F.trim(F.when(line.contains("  "), F.regexp_replace(line, " +", " ")).otherwise(line))


def node(template: Column, depth: int) -> Column:
    """Place of a template in the tree: token count, leading tokens, and the template itself."""
    tokens = F.octet_length(template) - F.octet_length(F.replace(template, F.lit(" "), F.lit(""))) + 1
    return F.struct(
        F.when(template == "", 0).otherwise(tokens).alias("tokens"),
        F.xxhash64(F.substring_index(template, " ", depth)).alias("lead"),
        F.xxhash64(template).alias("rest"),
    )


def held_templates(df: DataFrame, key: str, text: str, depth: int, min_tokens: int) -> DataFrame:
    """(id, template, tokens, lead, rest): every template of every row once, written: no later step parses the texts."""
    held = (
        df.select(F.col(f"`{key}`").alias("id"), templates(F.col(f"`{text}`")).alias("templates"))
        .select("id", F.explode(F.array_distinct("templates")).alias("template"))
        .select("id", "template", node(F.col("template"), depth).alias("node"))
        .select("id", "template", "node.*")
        .filter(F.col("tokens") >= min_tokens)
    )
    return written(held, "templates")


def recurring_templates(held: DataFrame, min_documents: int) -> DataFrame:
    """(tokens, lead, rest, first): templates that recur, with the smallest id that holds them."""
    return (
        held.groupBy("tokens", "lead", "rest")
        .agg(F.count(F.lit(1)).alias("documents"), F.min("id").alias("first"))
        .filter(F.col("documents") >= min_documents)
        .drop("documents")
    )


def leaf_lines(held: DataFrame, field_documents: int) -> DataFrame:
    """Held templates of leaves that may have a common form, with the number of lines of the leaf.

    Written twice on the way: the leaves, so that the join knows their size before it moves any text, and the lines, so
    that no later step meets the texts of other leaves.
    """
    leaves = (
        held.groupBy("tokens", "lead")
        .agg(F.count(F.lit(1)).alias("lines"), F.min("rest").alias("least"), F.max("rest").alias("most"))
        .filter((F.col("lines") >= field_documents) & (F.col("least") < F.col("most")))
        .select("tokens", "lead", "lines")
    )
    return written(held.join(written(leaves, "template-leaves"), ["tokens", "lead"]), "template-lines")


def common_forms(lines: DataFrame, depth: int, min_constant: int) -> DataFrame:
    """(tokens, lead, places): leaves with enough constant tokens; ``places`` has their place and token."""
    return (
        lines.select("tokens", "lead", "lines", F.posexplode(F.split("template", " ")).alias("place", "token"))
        .filter(~F.col("token").rlike("[0-9]") & (F.col("token") != FIELD))
        .groupBy("tokens", "lead", "lines", "place", "token")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(2 * F.col("n") > F.col("lines"))
        .groupBy("tokens", "lead")
        .agg(F.collect_list(F.struct("place", "token")).alias("places"))  # at most one for each token of a line
        .filter((100 * F.size("places") >= min_constant * F.col("tokens")) & (F.size("places") > depth))
    )


def fielded_templates(held: DataFrame, depth: int, min_constant: int, field_documents: int) -> DataFrame:
    """(id, tokens, lead, rest, first): held templates of forms that recur, with the smallest id of the form."""
    leaf = ["tokens", "lead"]
    lines = leaf_lines(held, field_documents)
    split = lines.join(common_forms(lines, depth, min_constant), leaf).withColumn("own", F.split("template", " "))
    same = F.size(F.filter("places", lambda p: F.get("own", p["place"]) == p["token"]))
    members = written(
        split.filter((100 * same >= min_constant * F.col("tokens")) & (same > depth)).select("id", *leaf, "rest"),
        "template-members",
    )
    found = members.groupBy(*leaf).agg(F.countDistinct("id").alias("documents"), F.min("id").alias("first"))
    return members.join(found.filter(F.col("documents") >= field_documents).drop("documents"), leaf)


def drop_templates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    depth: int = 2,
    min_tokens: int = 3,
    min_documents: int = 2,
    min_constant: int = 60,
    field_documents: int = 10,
) -> DataFrame:
    """Add n_lines, n_dropped (long) and clean_text (the text without its dropped lines) to every row."""
    path = ["tokens", "lead", "rest"]
    held = held_templates(df, key, text, depth, min_tokens)
    alike = held.select("id", *path).join(recurring_templates(held, min_documents), path)
    fielded = fielded_templates(held, depth, min_constant, field_documents)
    dropped = (
        alike.unionByName(fielded)
        .filter(F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first"))))
        .groupBy("id")
        .agg(F.collect_set(F.xxhash64(*path)).alias("dropped"))
    )
    added = ["n_lines", "n_dropped", "clean_text"]
    row = free_name(df, "row")
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row))
    joined = packed.join(dropped, packed[row][key].eqNullSafe(dropped["id"]), "left")
    joined = joined.select(
        row, "dropped", F.when(F.col("dropped").isNotNull(), templates(F.col(row)[text])).alias("templates")
    )
    nodes = F.transform("templates", lambda x: node(x, depth))
    judged = joined.select(row, "dropped", line_array(F.col(row)[text]).alias("lines"), nodes.alias("nodes")).select(
        *[row, "lines"],
        F.transform(
            "nodes",
            lambda x: (x["tokens"] < min_tokens)
            | ~F.array_contains("dropped", F.xxhash64(x["tokens"], x["lead"], x["rest"])),
        ).alias("keep"),
    )
    left = F.filter("lines", lambda x, i: F.get("keep", i))
    cleaned = judged.select(
        *[F.col(row)[c].alias(c) for c in df.columns if c.lower() not in added],
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size(F.filter("keep", lambda k: ~k)), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col(row)[text]).otherwise(F.array_join(left, "\n")).alias("clean_text"),
    )
    return settled(cleaned)


def op4_line_templates(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_templates(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256")
    )


SQL = r"""
with l as (
  select doc_id, i, list_extract(ls, i) as line
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))
), t as (
  select doc_id, i, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from l
), m as (
  select doc_id, i, line,
    case when len(list_filter(w, lambda x: not regexp_matches(x, '[0-9]'))) = 0 then w
      else list_transform(w, lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) end as w
  from t
), n as (
  select doc_id, i, line, len(w) as n, array_to_string(w[1:2], ' ') as lead, array_to_string(w, ' ') as template from m
), h as (select distinct doc_id, n, lead, template from n where n >= 3
), r as (
  select template, min(doc_id) as first from h group by template having count(distinct doc_id) >= 2
), leaves as (select n, lead, count(*) as lines from h group by n, lead having count(*) >= 10
), tokens as (
  select doc_id, n, lead, template, lines, unnest(range(1, n + 1)) as place, unnest(string_split(template, ' ')) as token
  from h join leaves using (n, lead)
), constants as (
  select n, lead, place, token from tokens where not regexp_matches(token, '[0-9]') and token <> '<*>'
  group by n, lead, place, token, lines having 2 * count(*) > lines
), members as (
  select doc_id, n, lead, template from tokens join constants using (n, lead, place, token)
  group by doc_id, n, lead, template having 100 * count(*) >= 60 * n and count(*) > 2
), forms as (select n, lead, min(doc_id) as first from members group by n, lead having count(distinct doc_id) >= 10
), f as (select distinct template, first from members join forms using (n, lead)
)
select doc_id, count(*)::bigint as n_lines,
  (count(*) filter (where least(r.first, f.first) < doc_id))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where coalesce(least(r.first, f.first) >= doc_id, true)), '')) as clean_sha256
from n left join r on n.template = r.template and n.n >= 3 left join f on n.template = f.template and n.n >= 3
group by doc_id
"""
