"""Merkle manifest of a dataset: a tree per group (source) over its rows' hashes, and a tree over the groups' roots.

Levels are built by grouping: every ``ARITY`` consecutive nodes become their parent, so the tables shrink by that
factor. Inner nodes are stored as rows that name their own parent and hold their children's hashes. A recursive query
climbs from every leaf to the root. The leaves of a run have all above it in common, so they climb in one row: each
step appends the siblings once, and folds the hash of each leaf by itself.

Rows are put in order by a range sort and numbered by counts of its partitions, so a large group is the work of many
tasks. The upper nodes, which many rows meet, are few and broadcast; the lower ones have few runs below them and are
joined by a shuffle. All hashes are SHA-256 over hex digits and held as 32 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, column, cut_lineage, shuffle_partitions

#: Fixed value: nodes of a run.
ARITY = 16
#: The number of the tree over the groups' roots; groups are numbered from 0.
TOP = -1
#: Nodes that are broadcast at most: about 25 MB.
UPPER_NODES = 40_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sized_value(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hex_digits(value: Column) -> Column:
    return F.lower(F.hex(value))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``pos``, their place from 0 in their group (no group is null), and ``n``, the group's rows."""
    laid = cut_lineage(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order))
    laid = laid.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    counts = laid.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    every, upto = Window.partitionBy(group), Window.partitionBy(group).orderBy("__part")
    counts = counts.select(group, "__part", (F.sum("__n").over(upto) - F.col("__n") - F.col("__first")).alias("__shift"), F.sum("__n").over(every).alias("n"))
    return laid.join(bounded_broadcast(counts), [group, "__part"]).withColumn("pos", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def parents(nodes: DataFrame) -> DataFrame:
    """(tree, level, pos, n, children, hash) over nodes of trees that have more than one at their level; n: parents of the tree."""
    children = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda c: hex_digits(c["hash"])), "")
    grouped = nodes.where("n > 1").groupBy("tree", F.expr(f"pos div {ARITY}").alias("pos"), "level", F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n")).agg(children.alias("digits"))
    return grouped.select("tree", (F.col("level") + 1).alias("level"), "pos", "n", F.unhex("digits").alias("children"), digest(F.col("digits")).alias("hash"))


def levels(nodes: DataFrame, height: int) -> list[DataFrame]:
    """``height`` levels of parents, one above the other, each kept."""
    made = []
    for _ in range(height):
        nodes = cut_lineage(parents(nodes))
        made.append(nodes)
    return made


def height_over(n: int) -> int:
    """Levels above n nodes until one is left."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def linked(nodes: DataFrame, groups: int) -> DataFrame:
    """Nodes with their parent (up_tree, up_level, up_pos; null at the root) and their place (from 0) among its children."""
    inside, top = F.col("n") > 1, (F.col("tree") != TOP) & F.lit(groups > 1)
    pick = lambda own, above: F.when(inside, own).when(top, above).cast("long")
    return nodes.withColumns({
        "up_tree": pick(F.col("tree"), F.lit(TOP)), "up_level": pick(F.col("level") + 1, F.lit(1)), "up_pos": pick(F.expr(f"pos div {ARITY}"), F.expr(f"tree div {ARITY}")),
        "place": pick(F.col("pos") % ARITY, F.col("tree") % ARITY),
    })


def climb(spark: SparkSession, rows: DataFrame, nodes: DataFrame, ended: str) -> DataFrame:
    """Rows (tree, pos, up_tree, up_level, up_pos, place, siblings, folded) lifted through the nodes, where ``ended``."""
    query = f"""
    with recursive climb as (
      select tree, pos, up_tree, up_level, up_pos, place, siblings, folded from {{rows}}
      union all
      select c.tree, c.pos, n.up_tree, n.up_level, n.up_pos, n.place,
             concat(c.siblings, substring(n.children, 1, int(32 * c.place)), substring(n.children, int(32 * c.place + 33))),
             transform(c.folded, f -> unhex(sha2(lower(hex(concat(substring(n.children, 1, int(32 * c.place)), f, substring(n.children, int(32 * c.place + 33))))), 256)))
      from climb c join {{nodes}} n on c.up_tree = n.tree and c.up_level = n.level and c.up_pos = n.pos)
    select * from climb where {ended}"""
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # every leaf is climbed from
    try:
        return cut_lineage(spark.sql(query, rows=rows, nodes=nodes))
    finally:
        spark.conf.set(limit, before)


def prove(docs: DataFrame, tampered: Column, changes: dict[str, Column], *, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", upper_nodes: int = UPPER_NODES) -> DataFrame:
    """Per row: its key, leaf, subroot, root, proof_sha256, folded_root and verified, as hex digits.

    A leaf is the hash of the row's fields. Per group, nulls first, leaves ascend by key (nulls first); rows of one key
    by leaf, so equal rows are leaves side by side. proof_sha256 is the hash of the siblings from the leaf to the root.
    folded_root is recomputed from the siblings and the leaf, with ``changes`` in place of the fields where ``tampered``
    (null: not); verified tells whether it is the root. A single row is its own root, and its proof is empty. An empty
    table gives an empty result. Other columns are not read; group and key may be null, texts of any length.
    """
    spark = docs.sparkSession
    leaf_of = lambda now: digest(F.concat(*(sized_value(now.get(f, column(f))) for f in fields)))
    leaves = docs.select(column(group).alias("of"), column(key).alias("key"), leaf_of({}).alias("leaf"), F.when(tampered, leaf_of(changes)).alias("changed"))
    leaves = cut_lineage(leaves)

    names = numbered(leaves.groupBy("of").agg(F.count(F.lit(1)).alias("size")).withColumn("all", F.lit(0)), "all", ["of"]).select("of", "size", F.col("pos").alias("tree"))
    names = cut_lineage(names)
    groups, largest = names.agg(F.count(F.lit(1)), F.max("size")).first()
    own = bounded_broadcast(names.select(F.col("of").alias("name"), "tree"))
    placed = numbered(leaves.join(own, F.col("of").eqNullSafe(F.col("name"))).select("tree", "key", "leaf", "changed"), "tree", ["key", "leaf"])

    # runs of leaves: what climbs
    member = F.struct("pos", "key", "leaf", F.coalesce("changed", "leaf").alias("now"))
    runs = placed.groupBy("tree", F.expr(f"pos div {ARITY}").alias("run"), "n").agg(F.sort_array(F.collect_list(member)).alias("members"))
    runs = runs.withColumn("leaves", F.unhex(F.array_join(F.transform("members", lambda m: F.hex(m["leaf"])), "")))
    over = F.when(F.col("n") == 1, F.col("leaves")).otherwise(digest(hex_digits(F.col("leaves"))))  # a lone leaf is its own root
    runs = cut_lineage(runs.select("tree", F.lit(1).cast("long").alias("level"), F.col("run").alias("pos"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), "members", "leaves", (F.col("n") == 1).alias("lone"), over.alias("hash")))

    first = runs.select("tree", "level", "pos", "n", "hash")
    inner = levels(first, height_over(-(-(largest or 0) // ARITY)))
    subroots = cut_lineage(_union([first, *(x.select(first.columns) for x in inner)]).where("n = 1").select("tree", "hash"))
    base = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).cast("long").alias("level"), F.col("tree").alias("pos"), F.lit(groups).cast("long").alias("n"), "hash")
    top = levels(base, height_over(groups))
    root = (top[-1] if top else subroots).select("hash").first()

    # the lowest level from which all nodes above are few enough
    counts = [x.count() for x in inner]
    cut = next(k for k in range(len(counts) + 1) if sum(counts[k:]) <= upper_nodes)
    sides = lambda blob, k: (F.substring(blob, F.lit(1), F.lit(32) * k), F.substring(blob, F.lit(32) * k + 33, F.octet_length(blob)))
    folded = F.transform("members", lambda m, k: F.when(F.col("lone"), m["now"]).otherwise(digest(hex_digits(F.concat(sides(F.col("leaves"), k)[0], m["now"], sides(F.col("leaves"), k)[1])))))
    rows = linked(runs, groups).select("tree", "pos", "up_tree", "up_level", "up_pos", "place", F.lit(b"").alias("siblings"), folded.alias("folded"))
    if cut:
        rows = climb(spark, cut_lineage(rows), linked(_union(inner[:cut]), groups), f"up_level is null or up_tree = {TOP} or up_level > {cut + 1}")
    if above := inner[cut:] + top:
        rows = climb(spark, rows if cut else cut_lineage(rows), bounded_broadcast(linked(_union(above), groups)), "up_level is null")

    each = runs.select("tree", "pos", "members", "leaves").join(rows.select("tree", "pos", "siblings", "folded"), ["tree", "pos"]).select("tree", "leaves", "siblings", "folded", F.posexplode("members").alias("k", "m"))
    each = each.join(bounded_broadcast(subroots.withColumnRenamed("hash", "subroot")), "tree")
    text = lambda c: hex_digits(F.col(c))
    made = F.get("folded", F.col("k"))
    whole = F.lit(bytes(root["hash"]) if root else None).cast("binary")
    return each.select(
        F.col("m.key").alias(key), text("m.leaf").alias("leaf"), text("subroot").alias("subroot"), hex_digits(whole).alias("root"), F.sha2(hex_digits(F.concat(*sides(F.col("leaves"), F.col("k")), F.col("siblings"))), 256).alias("proof_sha256"),
        hex_digits(made).alias("folded_root"), (made == whole).alias("verified"),
    )


def _union(tables: list[DataFrame]) -> DataFrame:
    made = tables[0]
    for t in tables[1:]:
        made = made.unionByName(t)
    return made
