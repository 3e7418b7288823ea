"""Secret scans: patterns of known shapes, and sliding windows of high Shannon entropy per character class.

The base finds three kinds by pattern: a value given to a secret's name (``assign``), cloud access ids (``access``) and
long runs of hexadecimal digits (``hex``). The method adds what has no such shape. Candidate strings are runs of
``WINDOW`` or more characters that keys are written in. Inside a candidate, each character class slides a window over
its own runs; counts of the characters, and with them the entropy, are kept up from one window to the next: a step adds
one character and takes one away. Windows at or above the class's entropy that mix digits and letters as keys do are
merged into spans. Sums of ``c * log2(c)`` are rounded to whole numbers beforehand, so that no two machines, nor SQL,
can disagree at the threshold.

The allow-list suppresses added spans, never base ones: UUIDs, paths and slugs of short parts, rows of the alphabet or
the keyboard, words of examples, the digests of empty input, and the caller's own ``allowed`` strings. An added span
inside a base span is not said twice.

How it scales: one pass over the texts, no shuffle; other columns stay in the JVM. The work is linear in the text: what
a window costs does not depend on its width. The ``allowed`` strings go to the executors with the function, so they
are limited to ``MAX_ALLOWED``.

Cases: null and empty texts have no spans; repeated rows get equal answers; very long texts and runs are scanned whole;
an empty table gives an empty result; other columns pass through, and a result column replaces an input column of the
same name. Places count code points; letters in the ``assign`` pattern are in either case, but only A-Z have one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabgauge.llm.common import free_name, settled, table

# The base patterns.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX = r"[0-9a-f]+"
HEX_LEAST = 24

WINDOW = 24
CANDIDATE = "A-Za-z0-9+/_=-"
MAX_ALLOWED = 100_000
#: entropies are compared as whole numbers of this part of a bit
PARTS = 1 << 20


class CharacterClass(NamedTuple):
    """A kind of key: its characters, the entropy a window needs, and the least of each sort of character in it."""

    kind: str
    characters: str
    bits: float
    digits: int
    upper: int
    lower: int

    @property
    def most(self) -> int:
        """The largest sum of ``weight(count)`` over a window's characters that still has the entropy."""
        return math.floor(WINDOW * (math.log2(WINDOW) - self.bits) * PARTS)


#: random windows of 24 have about 3.6, 4.0 and 4.2 bits; words and names stay below or mix too few sorts
CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", 3.0, 4, 0, 0),
    CharacterClass("entropy_upper", "0-9A-Z", 3.5, 4, 4, 0),
    CharacterClass("entropy_lower", "0-9a-z", 3.5, 4, 0, 4),
    CharacterClass("entropy_mixed", CANDIDATE, 3.8, 2, 2, 2),
)
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))

# The allow-list, as patterns on a whole candidate.
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
SLUG = r"^[A-Za-z0-9]{0,11}([+/_=-]+[A-Za-z0-9]{0,11})+$"
WORDS = r"(?i)example|sample|dummy|placeholder|changeme|abcdefghij|0123456789|1234567890|qwertyuiop"
EMPTY = r"(?i)^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$"
ALLOWED = (UUID, SLUG, WORDS, EMPTY)


def weight(count: int) -> int:
    """``count * log2(count)`` in whole parts; an entropy is log2(width) less the sum of these over width."""
    return math.floor(count * math.log2(count) * PARTS + 0.5) if count else 0


def dense_windows(run: str, cls: CharacterClass) -> Iterator[tuple[int, int]]:
    """Merged (start, end) of the windows of ``run`` with the class's entropy, by counts kept up step by step."""
    step = [weight(c + 1) - weight(c) for c in range(WINDOW)]
    counts: dict[str, int] = {}
    total = digits = upper = lower = 0
    begin = end = -1
    for i, new in enumerate(run):
        c = counts.get(new, 0)
        if i >= WINDOW:
            old = run[i - WINDOW]
            digits -= old.isdigit()
            upper -= old.isupper()
            lower -= old.islower()
            if old != new:  # else one goes, the same comes
                counts[old] -= 1
                total += step[c] - step[counts[old]]
                counts[new] = c + 1
        else:
            total += step[c]
            counts[new] = c + 1
        digits += new.isdigit()
        upper += new.isupper()
        lower += new.islower()
        if i < WINDOW - 1 or total > cls.most or digits < cls.digits or upper < cls.upper or lower < cls.lower:
            continue
        if upper + lower < cls.digits:  # numbers alone are no key
            continue
        if begin >= 0 and i - WINDOW + 1 > end:
            yield begin, end
            begin = -1
        if begin < 0:
            begin = i - WINDOW + 1
        end = i + 1
    if begin >= 0:
        yield begin, end


class Cover:
    """Tells whether a span lies inside one of some spans."""

    def __init__(self, spans: Iterable[tuple[int, int]]) -> None:
        ordered = sorted(spans)
        self.starts = [a for a, _ in ordered]
        self.furthest = list(accumulate((b for _, b in ordered), max))

    def holds(self, start: int, end: int) -> bool:
        before = bisect_right(self.starts, start)
        return before > 0 and self.furthest[before - 1] >= end


class Scanner:
    """Finds the spans of one text at a time."""

    def __init__(self, allowed: Iterable[str] = ()) -> None:
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access = re.compile(ACCESS)
        self.hex = re.compile(f"{HEX[:-1]}{{{HEX_LEAST},}}")  # the runs that are long enough, and no others
        self.candidates = re.compile(f"[{CANDIDATE}]{{{WINDOW},}}")
        self.runs = [(cls, re.compile(f"[{cls.characters}]{{{WINDOW},}}")) for cls in CLASSES]
        self.patterns = [re.compile(p) for p in ALLOWED]
        self.allowed = frozenset(allowed)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the base patterns."""
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        return found + [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]

    def added(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, kind, end) of what the windows find; a class says nothing inside a span of an earlier one."""
        for m in self.candidates.finditer(text):
            whole = m.group()
            if whole in self.allowed or any(p.search(whole) for p in self.patterns):
                continue
            found: list[tuple[int, int, int]] = []
            for k, (cls, runs) in enumerate(self.runs, 3):
                earlier = Cover((a, b) for a, _, b in found)
                for run in runs.finditer(whole):
                    at = m.start() + run.start()
                    spans = ((at + a, k, at + b) for a, b in dense_windows(run.group(), cls))
                    found += [x for x in spans if not earlier.holds(x[0], x[2])]
            yield from found

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of all spans, by start, then kind."""
        kept = self.base(text)
        said = Cover((a, b) for a, _, b in kept)
        kept += [x for x in self.added(text) if not said.holds(x[0], x[2])]
        return sorted(kept)


def cleaned(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


FOUND = pa.struct(
    [
        ("secrets", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
        ("clean_text", pa.string()),
    ]
)


def scan(text: Column, allowed: Iterable[str] = ()) -> Column:
    """A struct for each text: ``secrets`` (kind, start, end), and ``clean_text``, null where there are none."""
    listed = frozenset(allowed)
    if len(listed) > MAX_ALLOWED:
        raise ValueError(f"at most {MAX_ALLOWED} allowed strings go with the function")

    @F.arrow_udf("secrets array<struct<kind:string,start:int,end:int>>, clean_text string")
    def found(texts: pa.Array) -> pa.Array:
        scanner, rows = Scanner(listed), []
        for t in texts.to_pylist():
            spans = scanner.spans(t) if t else []
            said = [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
            rows.append({"secrets": said, "clean_text": cleaned(t, spans) if spans else None})
        return pa.array(rows, FOUND)

    return found(text)


def find_secrets(df: DataFrame, text: str = "text", allowed: Iterable[str] = ()) -> DataFrame:
    """Add ``secrets`` (array of kind, start, end) and ``clean_text``, in which every span reads ``[kind]``.

    Where spans overlap, the text between the first start and the last end is replaced once, by the first kind.
    """
    found = free_name(df, "found")
    scanned = df.withColumn(found, scan(F.col(f"`{text}`"), allowed))
    return settled(
        scanned.select(
            *[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("secrets", "clean_text")],
            F.col(found)["secrets"].alias("secrets"),
            F.coalesce(F.col(found)["clean_text"], F.col(f"`{text}`")).alias("clean_text"),
        )
    )


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op13_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", scan(F.col("text"))["secrets"].alias("secrets"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )


#: two characters of the private area mark where a match begins and ends; where a text has them, a third stands in
_OPEN, _SHUT, _OTHER = "chr(57344)", "chr(57345)", "chr(57346)"


def _either_case(pattern: str) -> str:
    return re.sub(r"[a-z]+(?=[|)_?])", lambda m: "".join(f"[{c.upper()}{c}]" for c in m.group()), pattern)


def _marked(pattern: str, source: str, keys: str, body: str) -> str:
    """SQL for (keys, start, m) of all matches of a pattern in ``body``; ``keys`` name a row of ``source``."""
    quoted = pattern.replace("'", "''")
    return f"""
  select {keys}, s as start, split_part(piece, {_SHUT}, 1) as m from (
    select {keys}, k, piece,
      coalesce(sum(length(replace(piece, {_SHUT}, ''))) over (partition by {keys} order by k
        rows between unbounded preceding and 1 preceding), 0)::bigint as s
    from (select {keys}, unnest(pieces) as piece, generate_subscripts(pieces, 1) as k
          from (select {keys}, string_split(regexp_replace({body}, '{quoted}', {_OPEN} || '\\0' || {_SHUT}, 'g'), {_OPEN})
                as pieces from {source})))
  where k > 1"""


def _allowed_sql(column: str) -> str:
    return " or ".join(f"regexp_matches({column}, '{p}')" for p in ALLOWED)


def _sql() -> str:
    assign = _either_case(ASSIGN)
    quoted = assign.replace("'", "''")
    classes = ", ".join(
        f"({k}, '{c.kind}', {c.most}, {c.digits}, {c.upper}, {c.lower})" for k, c in enumerate(CLASSES, 3)
    )
    runs = " union all ".join(
        f"select doc_id, spot, {k} as k, start, m from ({_marked(f'[{c.characters}]{{{WINDOW},}}', 'candidates', 'doc_id, spot', 'whole')})"
        for k, c in enumerate(CLASSES, 3)
    )
    return f"""
with d as (
  select doc_id, translate(coalesce(text, ''), {_OPEN} || {_SHUT}, {_OTHER} || {_OTHER}) as t from documents
), base as (
  select doc_id, 0 as k, start, start + length(m) as stop from ({_marked(assign, 'd', 'doc_id', 't')})
  where length(regexp_extract(m, '{quoted}', 2)) >= {ASSIGN_LEAST}
  union all
  select doc_id, 1, start, start + length(m) from ({_marked(ACCESS, 'd', 'doc_id', 't')}) where length(m) >= {ACCESS_LEAST}
  union all
  select doc_id, 2, start, start + length(m) from ({_marked(HEX, 'd', 'doc_id', 't')}) where length(m) >= {HEX_LEAST}
), candidates as (
  select doc_id, start as spot, m as whole from ({_marked(f'[{CANDIDATE}]{{{WINDOW},}}', 'd', 'doc_id', 't')})
  where not ({_allowed_sql('m')})
), classes(k, kind, most, digits, upper, lower) as (values {classes}
), runs as ({runs}
), windows as (
  select doc_id, spot, k, start, o, substr(m, o + 1, {WINDOW}) as x
  from (select doc_id, spot, k, start, m, unnest(range(length(m) - {WINDOW - 1})) as o from runs)
), dense as (
  select doc_id, spot, k, start, o
  from (select *, length(regexp_replace(x, '[^0-9]', '', 'g')) as n0, length(regexp_replace(x, '[^A-Z]', '', 'g')) as n1,
          length(regexp_replace(x, '[^a-z]', '', 'g')) as n2,
          list_sum(list_transform(list_distinct(string_split(x, '')), lambda c:
            floor((length(x) - length(replace(x, c, ''))) * log2(length(x) - length(replace(x, c, ''))) * {PARTS} + 0.5))) as total
        from windows) join classes using (k)
  where total <= most and n0 >= digits and n1 >= upper and n2 >= lower and n1 + n2 >= digits
), islands as (
  select *, sum(fresh) over (partition by doc_id, spot, k, start order by o) as island
  from (select *, case when o <= lag(o) over (partition by doc_id, spot, k, start order by o) + {WINDOW} then 0 else 1 end as fresh
        from dense)
), added as (
  select doc_id, spot, k, spot + start + min(o) as start, spot + start + max(o) + {WINDOW} as stop
  from islands group by doc_id, spot, k, start, island
), spans as (
  select doc_id, k, start, stop from base
  union all
  select doc_id, k, start, stop from added a
  where not exists (from base b where b.doc_id = a.doc_id and b.start <= a.start and b.stop >= a.stop)
    and not exists (from added b where b.doc_id = a.doc_id and b.spot = a.spot and b.k < a.k and b.start <= a.start and b.stop >= a.stop)
), kinds(k, kind) as (values (0, 'assign'), (1, 'access'), (2, 'hex') union all select k, kind from classes
), said as (
  select doc_id, count(*) filter (k = 0) as n0, count(*) filter (k = 1) as n1, count(*) filter (k = 2) as n2,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, k, stop) as spans,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, k, stop) filter (k < 3) as base
  from spans join kinds using (k) group by doc_id
)
select doc_id, coalesce(n0, 0)::bigint as n_assign, coalesce(n1, 0)::bigint as n_access, coalesce(n2, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join said using (doc_id)
"""


SQL = _sql()
