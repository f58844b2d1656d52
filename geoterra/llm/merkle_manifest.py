"""A Merkle manifest of a table: leaves, a tree for each group of rows, a tree over the groups, and a proof for every row.

Leaves have places in their group's order. Levels are windows: partitioned by group and parent's place, an ordered
collect_list over the full frame holds the parent's preimage and each child's siblings; every leaf keeps a row of its own, which
takes up its path. Ten levels or so share one shuffle and one sort, since a block of leaves that meet there is dealt as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import placed
from .sqlparts import CRC_TABLE, crc32
from .store import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(values: Sequence[Column]) -> Column:
    """Hex sha256 of the values, each ``-`` if null, else its bytes in UTF-8 counted, a colon and the value."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]), 256)


def _climb(leaves: DataFrame, fan: int, levels: int) -> DataFrame:
    """(grp, block, n, node, item, path, first) from leaves (grp, idx, n, node, item): one row for each leaf, with its path inside its block of ``fan`` ** ``levels`` leaves and the block's digest.

    A level's window holds the rows under one parent; its ordered collect_list has the digests of the parent's children, each from the first leaf
    under it. All windows follow one sort, from the narrowest to the widest, and no row is longer than one path.
    """
    above = [f"p{k}" for k in range(levels, 0, -1)]
    place = lambda k: F.floor(F.col("idx") / fan**k)
    empty = F.array().cast("array<struct<left:string,right:string>>")
    rows = leaves.select("grp", "idx", "n", "node", "item", empty.alias("path"), *[place(int(c[1:])).alias(c) for c in above]).repartition("grp", above[0])
    for k in range(levels):
        frame = Window.partitionBy("grp", *above[: levels - k]).orderBy(*above[levels - k :], "idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("kids", F.collect_list("node").over(frame))
        own, many = (place(k) % fan).cast("int"), F.ceil(F.col("n") / fan**k) > 1
        step = F.struct(F.array_join(F.slice("kids", F.lit(1), own), "").alias("left"), F.array_join(F.slice("kids", own + 2, F.lit(fan)), "").alias("right"))
        up = F.when(F.col("idx") % fan ** (k + 1) == 0, F.when(many, F.sha2(F.array_join("kids", ""), 256)).otherwise(F.col("node")))
        rows = rows.withColumn("path", F.when(many, F.concat("path", F.array(step))).otherwise(F.col("path"))).withColumn("node", up).drop("kids")
    whole = Window.partitionBy("grp", above[0])
    return rows.select("grp", F.col(above[0]).alias("block"), F.ceil(F.col("n") / fan**levels).alias("n"), F.max("node").over(whole).alias("node"), "item", "path", F.col("node").isNotNull().alias("first"))


def trees(leaves: DataFrame, fan: int, block: int, name: str) -> DataFrame:
    """(grp, top, item, path) from leaves (grp, idx, n, node, item): each item with its path to its group's top.

    ``idx`` counts from 0 in each group and ``n`` is the group's size. Levels are taken ``block`` leaves together; the blocks' nodes
    are the leaves of the next stage, so stages are as many as the logarithm of the largest group to the base ``block``, and
    paths are put together on the way down, a join on the block's place each.
    """
    levels = 1
    while fan ** (levels + 1) <= block:
        levels += 1
    stages, nodes = [], leaves
    while True:
        table = written(_climb(nodes, fan, levels), name)
        stages.append(table)
        if table.filter("n > 1").isEmpty():
            break
        nodes = table.filter("first").select("grp", F.col("block").alias("idx"), "n", "node", F.col("block").alias("item"))
    done = stages.pop().select("grp", F.col("node").alias("top"), "item", "path")
    while stages:
        upper = done.select(F.col("grp").alias("__grp"), "top", F.col("item").alias("__item"), F.col("path").alias("rest"))
        lower = stages.pop()
        both = lower.join(upper, lower["grp"].eqNullSafe(F.col("__grp")) & (lower["block"] == F.col("__item")))
        done = both.select("grp", "top", "item", F.concat("path", "rest").alias("path"))
    return done


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to; a level without siblings hashes the node alone."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, fan: int = 2, block: int = 1024) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, path, folded_root, verified.

    A language's leaves ascend by doc_id (nulls first, equal doc_ids by leaf); ``fan`` consecutive nodes become their parent until
    one is left, the subroot; subroots, ordered by language (null first), likewise lead to the root. ``path`` has the siblings left
    and right of every node from leaf to root, ``proof_sha256`` their digest. Where ``tampered`` holds (null: it does not), the
    row as it is checked has one more n_chars than the row as it was written; a null n_chars stays. ``verified`` tells whether
    it still folds to the root. Repeated rows are leaves of their own; null and empty texts differ; other columns are ignored; an
    empty table gives an empty one.
    """
    one_more = F.col("n_chars").cast("decimal(38,0)") + 1
    was = [F.col(c) for c in FIELDS]
    now = [F.when(tampered, one_more).otherwise(F.col("n_chars").cast("decimal(38,0)")) if c == "n_chars" and tampered is not None else F.col(c) for c in FIELDS]
    leaves = docs.select("doc_id", F.col("lang").cast("string").alias("grp"), digest(was).alias("node"), digest(now).alias("now"))
    order = placed(leaves, ["grp"], ["doc_id", "node"], "merkle-leaves")
    sizes = order.groupBy("grp").agg((F.max("idx") + 1).alias("n")).select(F.col("grp").alias("__grp"), "n")
    rows = order.join(sizes, F.col("grp").eqNullSafe(F.col("__grp"))).select("grp", "idx", "n", "node", F.struct("doc_id", F.col("node").alias("leaf"), "now").alias("item"))
    within = written(trees(rows, fan, block, "merkle-levels"), "merkle-groups")
    tops = placed(within.groupBy("grp").agg(F.first("top").alias("node")).withColumn("every", F.lit(0)), ["every"], ["grp"], "merkle-tops")
    count = tops.groupBy("every").agg((F.max("idx") + 1).alias("n"))
    over = trees(tops.join(count, "every").select(F.lit("").alias("grp"), "idx", "n", "node", F.struct(F.col("grp").alias("of")).alias("item")), fan, block, "merkle-levels")
    over = over.select(F.col("top").alias("root"), F.col("item.of").alias("of"), F.col("path").alias("rest"))
    out = within.join(over, F.col("grp").eqNullSafe(F.col("of")))
    out = out.select(F.col("item.*"), F.col("top").alias("subroot"), "root", F.concat("path", "rest").alias("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "path", folded(F.col("now"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0).drop("path")


def _value(column: str) -> str:
    return f"coalesce(octet_length(encode(cast({column} as varchar))) || ':' || cast({column} as varchar), '-')"


def _oracle() -> str:
    before, after = (" || ".join(_value(n if c == "n_chars" else c) for c in FIELDS) for n in ("n_chars", "n_chars + 1"))
    tree = """
up{k}(grp, lvl, idx, n, node) as (select grp, 0, idx, n, node from leaf{k}
  union all select grp, lvl + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(node, '' order by idx)) from up{k} where n > 1 group by grp, lvl, idx // 2),
sib{k} as (select a.grp, a.idx, u.lvl, coalesce(s.node, '') as sib, (a.idx >> u.lvl) % 2 = 1 as is_left
  from leaf{k} a join (select distinct grp, lvl from up{k} where n > 1) u on a.grp is not distinct from u.grp
  left join up{k} s on s.grp is not distinct from a.grp and s.lvl = u.lvl and s.idx = xor(a.idx >> u.lvl, 1)),
path{k} as (select grp, idx, list({{'sib': sib, 'is_left': is_left}} order by lvl) as path from sib{k} group by grp, idx),
top{k} as (select grp, node as top from up{k} where n = 1)"""
    fold = "list_reduce(list_prepend({'sib': %s, 'is_left': false}, steps), lambda a, s: {'sib': sha256(case when s.is_left then s.sib || a.sib else a.sib || s.sib end), 'is_left': false}).sib"
    return f"""
with recursive {CRC_TABLE},
d as (select doc_id, lang as grp, sha256({before}) as node, sha256(case when doc_id is not null and {crc32("cast(doc_id as varchar)")} % 7 = 0 then {after} else {before} end) as now
  from documents, tab),
leaf1 as (select *, row_number() over (partition by grp order by doc_id nulls first, node) - 1 as idx, count(*) over (partition by grp) as n from d),
{tree.format(k=1)},
leaf2 as (select '' as grp, grp as of, top as node, row_number() over (order by encode(grp) nulls first) - 1 as idx, count(*) over () as n from top1),
{tree.format(k=2)},
j as (select l.doc_id, l.node as leaf, l.now, t.top as subroot, r.top as root, list_concat(coalesce(p.path, []), coalesce(q.path, [])) as steps
  from leaf1 l join top1 t on t.grp is not distinct from l.grp join leaf2 s on s.of is not distinct from l.grp cross join top2 r
  left join path1 p on p.grp is not distinct from l.grp and p.idx = l.idx left join path2 q on q.idx = s.idx),
f as (select *, {fold % "now"} as folded_root from j)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.sib), '')) as proof_sha256, folded_root, folded_root = root as verified from f"""


ORACLES = {"op13_merkle_manifest": _oracle()}
QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
