"""Chat formatting by quotation linking.

Messages quote others by ``>`` marks, nested ones by several. Every line's quote level is parsed; quoted lines are
normalised (white space, case), hashed and joined to the unquoted lines of the same conversation. A line's original is
the earliest message that says it unquoted. A message answers the earlier message that most of its least nested linked
lines come from; ties go to the later one. Following those links up gives every message its thread (``root_turn``) and
``depth``; by (conversation, root_turn, depth, turn) replies follow what they answer. Quotes leave the text.

How it scales: a line leaves its message as one number beside its place, and originals are counted to one row for each
line before the join, so a line that very many messages hold, or a conversation of very many messages, is a large
partition on one side of the join only, which adaptive execution splits. Links are followed by doubling, each round
written to the checkpoint folder. No conversation is gathered into one task: order is given by columns.

Cases: null text has no lines and stays null; a message of quotes alone becomes empty; quotes that match nothing, or only
the same or a later message, are removed as well and counted in n_unlinked; lines without a letter or digit link
nothing; repeated rows of one turn count as one message and get the same answer each; a null conversation or turn is
equal to another null, and a null turn is neither before nor after any; an empty table gives an empty result; other
columns pass through, and a result column replaces an input column of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabgauge.llm.common import free_name, table, written

#: up to three blanks before each mark, one after the last
MARKS = r"^(?: {0,3}>)+ ?"


def quote_level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.char_length(marks) - F.char_length(F.replace(marks, F.lit(">"), F.lit("")))


def normal_line(line: Column) -> Column:
    """What a line says: without marks, in lower case, with single blanks."""
    bare = F.when(line.contains(">"), F.regexp_replace(line, MARKS, "")).otherwise(line)
    return F.lower(F.btrim(F.regexp_replace(bare, r"[\x20\x09-\x0D]+", " ")))


def _lines(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, h): the hashed lines of every message that say something."""
    lines = F.transform(
        F.split("text", "\n"), lambda x: F.struct(quote_level(x).alias("level"), normal_line(x).alias("says"))
    )
    return (
        messages.filter(F.col("text").isNotNull())
        .select("conv", "turn", F.explode(lines).alias("line"))
        .filter(F.col("line.says").rlike(r"[\p{L}\p{N}]"))
        .select("conv", "turn", "line.level", F.xxhash64("line.says").alias("h"))
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[f"{k}_"])
    return condition


def parents(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent, n_linked, n_quoted): one row for each message with quoted lines."""
    lines = _lines(messages)
    originals = lines.filter("level = 0").groupBy("conv", "h").agg(F.min("turn").alias("said"))
    originals = originals.select(F.col("conv").alias("conv_"), F.col("h").alias("h_"), "said")
    quoted = lines.filter("level > 0")
    linked = quoted.join(originals, _null_safe(quoted, originals, ["conv", "h"]), "left").select(
        "conv", "turn", "level", F.when(F.col("said") < F.col("turn"), F.col("said")).alias("said")
    )
    votes = linked.groupBy("conv", "turn", "level", "said").agg(F.count(F.lit(1)).alias("n"))
    found = F.col("said").isNotNull()
    # least nested level first, then most lines, then the later message
    best = F.max_by(F.col("said"), F.when(found, F.struct(-F.col("level"), F.col("n"), F.col("said"))))
    return votes.groupBy("conv", "turn").agg(
        best.alias("parent"),
        F.coalesce(F.sum(F.when(found, F.col("n"))), F.lit(0)).alias("n_linked"),
        F.sum("n").alias("n_quoted"),
    )


def threads(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(conv, turn, root, depth) for every row of ``links`` (conv, turn, parent)."""
    reach = written(links.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "quotes-reach")
    for _ in range(max_rounds):
        further = reach.select(
            F.col("conv").alias("conv_"), F.col("turn").alias("root_"), F.col("root").alias("then"), F.col("depth").alias("more")
        )
        if reach.join(further, _null_safe(reach, further, ["conv", "root"]), "left_semi").isEmpty():
            return reach
        reach = written(
            reach.join(further, _null_safe(reach, further, ["conv", "root"]), "left").select(
                "conv",
                "turn",
                F.coalesce("then", "root").alias("root"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            ),
            "quotes-reach",
        )
    raise RuntimeError(f"a thread is deeper than 2 ** {max_rounds}")


def link_quotes(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Add parent_turn, root_turn, depth, n_quoted, n_linked, n_unlinked, clean_text and chat_text to every row."""
    messages = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{text}`").alias("text"))
    found = written(parents(messages), "quotes-parents")
    reach = threads(found.filter(F.col("parent").isNotNull()).select("conv", "turn", "parent"))
    reach = reach.select(F.col("conv").alias("conv_"), F.col("turn").alias("turn_"), "root", "depth")
    facts = found.join(reach, _null_safe(found, reach, ["conv", "turn"]), "left").select(
        F.col("conv").alias("conv_"), F.col("turn").alias("turn_"), "parent", "root", "depth", "n_quoted", "n_linked"
    )
    row = free_name(df, "row")
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row))
    joined = packed.join(
        facts,
        packed[row][conv].eqNullSafe(facts["conv_"]) & packed[row][turn].eqNullSafe(facts["turn_"]),
        "left",
    )
    own = F.filter(F.split(F.col(row)[text], "\n"), lambda x: ~x.rlike(MARKS))
    clean = F.when(F.col("n_quoted").isNull() & ~F.col(row)[text].contains(">"), F.col(row)[text]).otherwise(
        F.btrim(F.array_join(own, "\n"), F.lit("\n"))
    )
    zero = F.lit(0).cast("bigint")
    added = ["parent_turn", "root_turn", "depth", "n_quoted", "n_linked", "n_unlinked", "clean_text", "chat_text"]
    return joined.select(
        *[F.col(row)[c].alias(c) for c in df.columns if c.lower() not in added],
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", F.col(row)[turn]).alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
        F.coalesce("n_quoted", zero).alias("n_quoted"),
        F.coalesce("n_linked", zero).alias("n_linked"),
        F.coalesce(F.col("n_quoted") - F.col("n_linked"), zero).alias("n_unlinked"),
        clean.alias("clean_text"),
        F.concat(F.lit("<|"), F.coalesce(F.col(row)[role], F.lit("")), F.lit("|>\n"), F.coalesce(clean, F.lit(""))).alias(
            "chat_text"
        ),
    )


def op5_quotes(spark, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "role", "parent_turn", "root_turn", "depth", "n_quoted", "n_linked", "n_unlinked", "chat_text"
    )


SQL = r"""
with recursive lines as (
  select distinct conv_id, turn, i, regexp_extract(line, '^(?: {0,3}>)+ ?', 0) as marks,
    lower(trim(regexp_replace(regexp_replace(line, '^(?: {0,3}>)+ ?', ''), '[\x20\x09-\x0D]+', ' ', 'g'))) as says
  from (select conv_id, turn, text, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line
        from (select conv_id, turn, text, string_split(text, chr(10)) as ls from conversations where text is not null))
), said as (
  select conv_id, turn, length(marks) - length(replace(marks, '>', '')) as level, says
  from lines where regexp_matches(says, '[\p{L}\p{N}]')
), originals as (select conv_id, says, min(turn) as source from said where level = 0 group by all
), linked as (
  select q.conv_id, q.turn, q.level, case when source < q.turn then source end as source
  from said q left join originals o using (conv_id, says) where q.level > 0
), votes as (select conv_id, turn, level, source, count(*) as n from linked group by all
), best as (
  select conv_id, turn, source as parent from votes where source is not null
  qualify row_number() over (partition by conv_id, turn order by level, n desc, source desc) = 1
), facts as (
  select conv_id, turn, sum(n)::bigint as n_quoted, coalesce(sum(n) filter (where source is not null), 0)::bigint as n_linked
  from votes group by all
), up as (
  select conv_id, turn, parent as root, 1 as depth from best
  union all
  select up.conv_id, up.turn, best.parent, depth + 1 from up join best on up.conv_id = best.conv_id and up.root = best.turn
), top as (select conv_id, turn, arg_max(root, depth) as root, max(depth) as depth from up group by all
)
select c.conv_id, c.turn, role, parent as parent_turn, coalesce(root, c.turn) as root_turn,
  coalesce(depth, 0)::bigint as depth, coalesce(n_quoted, 0) as n_quoted, coalesce(n_linked, 0) as n_linked,
  coalesce(n_quoted - n_linked, 0) as n_unlinked,
  '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(case when contains(text, '>') then
    trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '^(?: {0,3}>)+ ?')), chr(10)), chr(10))
    else text end, '') as chat_text
from conversations c left join best using (conv_id, turn) left join facts using (conv_id, turn) left join top using (conv_id, turn)
"""
