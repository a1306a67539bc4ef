"""Merkle manifest of a dataset: a hash tree for each language, a tree over their roots, and a proof for each row.

Levels are stored as node rows that name their parent, 2**HEIGHT nodes to a parent row: a row holds the HEIGHT binary levels to
its parent as steps, 'L' or 'R' and the sibling's digest, or 'O' where the run is its node alone. One group of at
most 2**HEIGHT nodes hashes those levels, so a tree of n leaves takes log(n) / HEIGHT rounds. Then a recursive query of
Spark climbs from every leaf: each turn joins the parent's row, appends the siblings on the way and folds the leaf's digest
(that of the tampered row where there is one) up to the root. Parents that a whole language shares are dealt out SALTS times.

Places of leaves in a language come from a range-partitioned sort and the counts of its partitions, never from one task.

Every field of a row may be null (``-``); a null doc_id comes first and is never tampered with; rows with the same doc_id follow each
other by digest, equal rows get a leaf each; a null lang is a language of its own; texts of any length are hashed whole
inside Spark; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import table, written

#: Binary levels between a node row and its parent's; a group has 2**HEIGHT nodes at most.
HEIGHT = 12
SALTS = 256
#: Number of rounds above the leaves that stands for a language's root in the node table, and the tree of these roots.
SUBROOT, UPPER = -1, "r"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_BY = 7
#: Spark's limit on rows of a recursive query, which would cut large tables.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields: ``-`` for null, else the length in bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in fields]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, hash, and tampered: the digest with one more n_chars, null where the row is left alone."""
    own = [F.col(c) for c in FIELDS]
    other = [F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_BY == 0
    tree = F.coalesce(F.concat(F.lit("s"), "lang"), F.lit("n")).alias("tree")  # sorts as the languages do, null first
    return docs.select(tree, "doc_id", leaf_digest(*own).alias("hash"), F.when(hit & F.col("n_chars").isNotNull(), leaf_digest(*other)).alias("tampered"))


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with their place in the tree in the given order, and ``n``, the tree's number of nodes."""
    dealt = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    counts = dealt.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))  # partitions plus trees
    before = "coalesce(sum(_n) over (partition by tree order by _part rows between unbounded preceding and 1 preceding), 0)"
    counts = counts.select("tree", "_part", F.expr(f"_first - {before}").alias("_shift"), F.expr("sum(_n) over (partition by tree)").alias("n"))
    return dealt.join(counts, ["tree", "_part"]).withColumn("place", F.col("_row") - F.col("_shift")).drop("_part", "_row", "_shift")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def stride(hashes: list[str], whole: bool, height: int) -> tuple[list[list[str]], str]:
    """Steps of each of up to 2**height neighbours to the node over them all; whole: they are the tree's only nodes."""
    steps: list[list[str]] = [[] for _ in hashes]
    level = hashes
    for k in range(height):
        if whole and len(level) == 1:
            break
        for i, own in enumerate(steps):
            other = i >> k ^ 1
            own.append("O" if other >= len(level) else f"{'LR'[other > i >> k]}{level[other]}")
        level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return steps, level[0]


def strides(nodes: DataFrame, carry: str, height: int) -> DataFrame:
    """Node rows with steps, the parent's place and, in the first row of each group, the parent's hash.

    carry: further columns (with types) to hand through.
    """
    names, width = [c.split()[0] for c in carry.split(", ")] if carry else [], 1 << height

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        n, place = group.column("n")[0].as_py(), group.column("place")[0].as_py()
        steps, top = stride(group.column("hash").to_pylist(), n <= width, height)
        tops = [top] + [None] * (len(steps) - 1)
        more = {"steps": pa.array(steps, pa.list_(pa.string())), "parent": pa.array([place // width] * len(steps), pa.int64()), "top": pa.array(tops, pa.string())}
        return pa.table({c: group.column(c) for c in ("tree", "place", "n", "hash", *names)} | more)

    schema = "tree string, place bigint, n bigint, hash string, " + (f"{carry}, " if carry else "") + "steps array<string>, parent bigint, top string"
    picked = nodes.select("tree", "place", "n", "hash", *names).withColumn("_group", F.expr(f"place div {width}"))
    return picked.groupBy("tree", "_group").applyInArrow(lambda _, g: run(g), schema)


def _linked(rows: DataFrame, above: int, last: tuple[Column, int | None], height: int) -> DataFrame:
    """The parent's id: number ``above`` of the same tree, or ``last`` over the tree's only group."""
    over = F.col("n") <= 1 << height
    tree, up = last
    return rows.withColumn("parent_tree", F.when(over, tree).otherwise(F.col("tree"))).withColumn("parent_height", F.when(over, F.lit(up)).otherwise(F.lit(above))).withColumn("parent", F.when(over, 0).otherwise(F.col("parent")).cast("bigint"))


def _rounds(rows: DataFrame, last: tuple[Column, int | None], height: int) -> tuple[list[DataFrame], DataFrame]:
    """Node rows above ``rows`` up to the trees' roots, and these roots (tree, hash)."""
    out, roots, number, width = [], None, 0, 1 << height
    while True:
        tops = rows.filter("top is not null").select("tree", F.col("parent").alias("place"), F.expr(f"(n + {width - 1}) div {width}").alias("n"), F.col("top").alias("hash"))
        done = tops.filter("n = 1").select("tree", "hash")
        roots = done if roots is None else roots.unionByName(done)
        upper = tops.filter("n > 1")
        if upper.isEmpty():
            return out, roots
        number += 1
        rows = written(strides(upper, "", height))
        out.append(_linked(rows, number + 1, last, height).withColumn("height", F.lit(number)))


NODE = ("tree", "height", "place", "hash", "steps", "parent_tree", "parent_height", "parent")


def build(docs: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaf rows (doc_id, hash, tampered, steps and the parent's id), the rows of all nodes above, and the root (one row, none for an empty table)."""
    low = written(strides(placed(leaves(docs), "doc_id", "hash"), "doc_id bigint, tampered string", height))
    to_subroot = (F.col("tree"), SUBROOT)
    nodes, subroots = _rounds(low, to_subroot, height)
    ranked = placed(subroots.select(F.lit(UPPER).alias("tree"), F.col("tree").alias("lang_tree"), "hash"), "lang_tree")
    top = written(strides(ranked, "lang_tree string", height))
    end = (F.lit(None).cast("string"), None)
    named = _linked(top, 1, end, height).withColumn("tree", F.col("lang_tree")).withColumn("height", F.lit(SUBROOT)).withColumn("place", F.lit(0).cast("bigint"))
    above, root = _rounds(top, end, height)
    rows = named.select(*NODE)
    for part in nodes + above:
        rows = rows.unionByName(part.select(*NODE))
    return _linked(low, 1, to_subroot, height), written(rows), root.select("hash")


FOLD = (
    "aggregate({steps}, {start}, (x, s) -> sha2(case left(s, 1) when 'L' then concat(substr(s, 2), x)"
    " when 'R' then concat(x, substr(s, 2)) else x end, 256))"
)
SIBLINGS = "array_join(transform({steps}, s -> substr(s, 2)), '')"


def climb(low: DataFrame, nodes: DataFrame, root: str | None) -> DataFrame:
    """What each leaf finds on its way: subroot, siblings' digest, the folded root and whether it is ``root``."""
    spark, name = low.sparkSession, uuid.uuid4().hex
    # the first parent in a language has at most 2**height leaves below, the others may have a whole language
    few = f"c.height = 1 and c.tree <> '{UPPER}'"
    salts = F.when((F.col("height") == 1) & (F.col("tree") != UPPER), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    low.createOrReplaceTempView(f"leaves_{name}")
    nodes.withColumn("salt", F.explode(salts)).createOrReplaceTempView(f"nodes_{name}")
    query = f"""
        with recursive climb(doc_id, leaf, tree, height, place, subroot, proof, folded) as (
            select doc_id, hash, parent_tree, parent_height, parent, cast(null as string), {SIBLINGS.format(steps="steps")},
                {FOLD.format(steps="steps", start="coalesce(tampered, hash)")} from leaves_{name}
            union all
            select c.doc_id, c.leaf, n.parent_tree, n.parent_height, n.parent, coalesce(c.subroot, case when n.height = {SUBROOT} then n.hash end),
                concat(c.proof, {SIBLINGS.format(steps="n.steps")}), {FOLD.format(steps="n.steps", start="c.folded")}
            from climb c join nodes_{name} n on n.tree = c.tree and n.height = c.height and n.place = c.place
                and n.salt = case when {few} then 0 else pmod(crc32(c.leaf), {SALTS}) end)
        select doc_id, leaf, subroot, sha2(proof, 256) as proof_sha256, folded as folded_root from climb where tree is null"""
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        found = written(spark.sql(query))  # while the limit is off
    finally:
        spark.conf.set(ROW_LIMIT, limit)
        for view in ("leaves", "nodes"):
            spark.catalog.dropTempView(f"{view}_{name}")
    whole = F.lit(root).cast("string")
    return found.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row for each document: its leaf, its roots, the digest of its proof, and whether the (tampered) row still folds to the root."""
    low, nodes, root = build(docs, height)
    found = root.first()
    return climb(low, nodes, found["hash"] if found else None)


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
