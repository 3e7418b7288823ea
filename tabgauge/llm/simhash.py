"""SimHash near-duplicates over BK-trees.

A document's fingerprint takes each bit by majority over the XXH64 hashes of its word shingles. Fingerprints that
differ in at most ``radius`` bits are linked, and linked ones form components.

The search for links runs over BK-trees: every node files its children by their Hamming distance to it, and a search
follows only the edges whose distance lies within the radius of the query's distance. A single tree, or a broadcast of
all trees, would grow with the corpus. So trees are sharded by content: of ``radius + 1`` bit blocks, two fingerprints
within the radius share at least one whole block, and each (block, value) is one shard tree, built and searched where
Spark has put its members. A shard of more than ``max_shard`` fingerprints is cut again by the same rule over its
remaining bits.

How it scales: equal fingerprints become one row before anything is compared (counts combine before the shuffle), a
shard returns a spanning forest (at most one link for each member) and never all its pairs, and components are found by
contracting links, with each round written to the checkpoint folder.

Cases: null or blank text has the zero fingerprint, linked like any other; text of fewer words than a shingle is one
shingle; repeated rows and equal ids share a component; a null id takes part but names a component only where no other
id is there (the component is then null); an empty table gives an empty result; other columns do
not take part, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tabgauge.llm.common import table, written

BITS = 64
#: shingle hashes whose bits are counted at once
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """Majority bits over the hashes of the text's word shingles."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, CHUNK):
        end = min(n, start + CHUNK)
        h = np.array([digest(join(words[i : i + shingle]), seed) for i in range(start, end)], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # signed, as Spark has no unsigned long
            prints = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), signed], names=["id", "print"])

    return run


class BKTree:
    """Values under their integer Hamming distance to a parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        place = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while place:
            distance = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = place
                return
            at = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Places of the values at most ``radius`` away."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            children = self.children[at]
            if children:
                for edge in range(distance - radius, distance + radius + 1):
                    if edge in children:
                        stack.append(children[edge])


def forest(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that join all of ``values`` that are linked directly or through each other, one for each at most."""
    tree, parent = BKTree(), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        parent.append(i)
        for j in tree.within(value, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                yield value, values[j]
        tree.add(value)


def _shard_links(radius: int):
    """Links of several shards: a row is (group, shard, print)."""

    def run(members: pa.Table) -> pa.Table:
        shard, prints = members.column("shard").to_numpy(), members.column("print").to_numpy()
        order = np.lexsort((prints, shard))
        shard, prints = shard[order], prints[order].view(np.uint64)
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        found: list[tuple[int, int]] = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)]):
            if end - start > 1:
                found.extend(forest(prints[start:end].tolist(), radius))
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of ``parts`` near-equal blocks of ``width`` bits."""
    edges = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


def links(prints: DataFrame, radius: int, max_shard: int, group_rows: int = 200_000) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within the radius that together connect all linked ones.

    ``prints`` has one row for each fingerprint, in column ``print``.
    """
    parts = radius + 1
    value = F.col("print")

    def field(start: int, length: int):
        return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << length) - 1))

    blocks = _blocks(BITS, parts)
    level1 = prints.select(
        "print",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("block"), field(*b).alias("v")) for i, b in enumerate(blocks)])
        ).alias("s"),
    ).select("print", "s.*")
    large = level1.groupBy("block", "v").count().filter(F.col("count") > max_shard).select(
        "block", "v", F.lit(True).alias("large")
    )
    placed = level1.join(large, ["block", "v"], "left")
    # a large shard: its members agree in one block, so among the bits beside it some part must agree again
    deeper = None
    for i in range(parts):
        fields = [
            (start + sub, length)
            for j, (start, size) in enumerate(blocks)
            if j != i
            for sub, length in _blocks(size, parts)
        ]
        # radius + 1 disjoint groups of bits, so at least one of them is free of differences
        groups = [fields[g::parts] for g in range(parts)]
        here = F.array(
            *[
                F.struct(
                    F.lit(g + 1).alias("part"),
                    F.concat_ws(":", *[field(*f).cast("string") for f in group]).alias("w"),
                )
                for g, group in enumerate(groups)
            ]
        )
        deeper = F.when(F.col("block") == i, here) if deeper is None else deeper.when(F.col("block") == i, here)
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit("").alias("w")))
    shards = placed.select(
        "print", "block", "v", F.explode(F.when(F.col("large"), deeper).otherwise(whole)).alias("s")
    ).select("print", F.xxhash64("block", "v", "s.part", "s.w").alias("shard"))
    groups = 1 + prints.count() * parts // group_rows
    return (
        shards.withColumn("group", F.pmod("shard", F.lit(groups)))
        .groupBy("group")
        .applyInArrow(_shard_links(radius), "a long, b long")
        .distinct()
    )


def components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): the connected component of every node of ``nodes`` (column ``node``), named by one of its nodes.

    Each round every node that still has links goes to the smallest of itself and its neighbours, links between what
    has become one node fall away, and links are renamed; a chain at least halves.
    """
    mapping = None  # node -> where it is now, for nodes that have links
    for round_number in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        # follow two more steps, to shorten chains
        for _ in range(2):
            step = (
                step.alias("x")
                .join(step.select(F.col("a").alias("to"), F.col("to").alias("then")), "to", "left")
                .select("a", F.coalesce("then", "to").alias("to"))
            )
        step = written(step, "simhash-step")
        if mapping is None:
            mapping = step.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            mapping = (
                mapping.join(step.select(F.col("a").alias("root"), F.col("to").alias("then")), "root", "left")
                .select("node", F.coalesce("then", "root").alias("root"))
            )
        mapping = written(mapping, "simhash-mapping")
        to_a, to_b = step.select("a", F.col("to").alias("ta")), step.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        edges = written(
            edges.join(to_a, "a").join(to_b, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
            .filter("a <> b").distinct(),
            "simhash-links",
        )
        if edges.isEmpty():
            break
    else:
        raise RuntimeError(f"links are left after {max_rounds} rounds")
    return nodes.join(mapping, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    radius: int = 3,
    seed: int = 42,
    max_shard: int = 20_000,
) -> DataFrame:
    """For every row its ``key``, fingerprint (16 hex digits) and component_id (smallest linked id)."""
    schema = f"id {df.schema[key].dataType.simpleString()}, print long"
    plain = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    prints = written(plain.mapInArrow(_fingerprints(shingle, seed), schema), "simhash-prints")
    distinct = prints.groupBy("print").agg(F.min("id").alias("first"))
    edges = written(links(distinct, radius, max_shard), "simhash-links")
    nodes = distinct.select(F.col("print").alias("node"), "first")
    if edges.isEmpty():
        named = nodes.select(F.col("node").alias("print"), F.col("first").alias("component_id"))
    else:
        roots = components(edges, nodes.select("node")).join(nodes, "node")
        smallest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
        named = roots.join(smallest, "root").select(F.col("node").alias("print"), "component_id")
    return prints.join(named, "print").select(
        F.col("id").alias(key),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``df`` that name their component: one for each id. Rows with a null id all stay."""
    named = near_duplicates(df, key, text, **settings).select(F.col("component_id").alias(key)).distinct()
    with_id = df.filter(F.col(f"`{key}`").isNotNull())
    return with_id.join(named, key, "left_semi").dropDuplicates([key]).unionByName(
        df.filter(F.col(f"`{key}`").isNull())
    )


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
