"""Merkle manifest of a dataset, with proofs found by pointer jumping.

Every row is a leaf; the leaves of one group (here: one source) make a tree, and the groups' roots make
the tree above. A level's nodes see their run's siblings in a window over small blocks, and the first of
a run makes the parent. Then every node holds a pointer to its parent and the segment of siblings on the
way there; each round joins the nodes with themselves, which doubles every pointer's distance and puts
the ancestor's segment behind the node's own, until every leaf's pointer has passed the root.

No key gets hot: positions come from a range partition with counts per partition, so a group that holds
a third of all rows is spread over many tasks; in a round of distance d an ancestor has at most fan ** d
rows below it, and where d is 8 or more, so that this may be many, the ancestors themselves are few:
they are counted, and broadcast where there are at most BROADCAST of them (each holds at most one
segment a level). Beyond that number the join stays a shuffled one, which Spark splits where it is skewed.

Defined results: nulls are written `-`, so they differ from empty texts; a null key comes first in its
group and is never tampered with; rows that share a key are ordered by their digests, equal rows get
neighbouring places and like proofs; rows with a null group are a group of their own, the first one;
a single row is its own root, with an empty proof; an empty table gives no rows; columns that aren't
named are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stash, table, unstash

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
#: Ancestors that a round may broadcast; each is under 200 bytes a level of the tree.
BROADCAST = 4096
#: Nodes of one window: blocks of whole runs.
BLOCK_RUNS = 27
#: The tree above the groups' trees.
TOP = -1

_PATH = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """A value as it is hashed: `-`, or its UTF-8 length, a colon and the text itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(parts: Sequence[Column]) -> Column:
    """The 32 bytes of the SHA-256 of the parts, concatenated."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def fold(start: Column, path: Column) -> Column:
    """The digest at the end of a path that begins at `start`."""
    return F.aggregate(path, start, lambda d, s: digest([_hex(s["left"]), _hex(d), _hex(s["right"])]))


def numbered(df: DataFrame, group: str | None, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """df, written in order with `part` and `id`, and for each (group, part) its `first` id, `before` (rows of the group in earlier parts) and `size` of the group.

    A row's place within its group is id - first + before. Windows hold a row for each part at most.
    """
    keys = [*([group] if group else []), *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id())
    placed = stash(placed.withColumn("part", F.shiftright("id", 33)), name)
    group = group or "__all"
    parts = placed.withColumn("__all", F.lit(0)).groupBy(group, "part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    earlier = F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return placed, parts.select(group, "part", "first", F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("n").over(w).alias("size"))


def _height(size: Column, fan: int) -> Column:
    """Levels above the leaves of a tree of so many leaves: the least k with fan ** k >= size."""
    powers = [p for k in range(64) if (p := fan**k) < 1 << 62]
    return F.size(F.filter(F.array(*[F.lit(p) for p in powers]), lambda p: p < size)).cast("long")


def _with_siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """nodes (tree, at, digest, high, size) with left and right: the siblings of their run, concatenated; and top: the parent's height."""
    w = Window.partitionBy("tree", F.floor(F.col("at") / (fan * BLOCK_RUNS))).orderBy("at")
    place = F.col("at") % fan
    none = F.lit(b"")
    left = F.concat(*[F.coalesce(F.when(place >= k, F.lag("digest", k).over(w)), none) for k in range(fan - 1, 0, -1)])
    after = [place + k < fan for k in range(1, fan)]
    right = F.concat(*[F.coalesce(F.when(a, F.lead("digest", k).over(w)), none) for k, a in enumerate(after, 1)])
    top = F.greatest("high", *[F.when(a, F.lead("high", k).over(w)) for k, a in enumerate(after, 1)]) + 1
    return nodes.withColumns({"left": left, "right": right, "top": top})


def _levels(nodes: DataFrame, fan: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Every level of the trees whose leaves are `nodes`, with siblings, and the trees' roots (tree, digest, high)."""
    levels, roots = [], []
    level = nodes
    while True:
        roots.append(level.filter("size = 1").select("tree", "digest", "high"))
        level = level.filter("size > 1")
        if level.isEmpty():
            break
        level = stash(_with_siblings(level, fan), name)
        levels.append(level)
        parent = digest([_hex(F.col("digest")), _hex(F.col("right"))])
        level = level.filter(F.col("at") % fan == 0).select(
            "tree", F.floor(F.col("at") / fan).alias("at"), parent.alias("digest"), F.col("top").alias("high"), F.ceil(F.col("size") / fan).alias("size")
        )
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, out


def _pointers(level: DataFrame, depth: int, fan: int, n_groups: int, keep: list) -> DataFrame:
    """A level's nodes with a pointer to the parent (a tree's root is a leaf of the tree above) and the path there."""
    parent_is_root, above = F.col("size") <= fan, F.col("tree") == TOP
    to_top = parent_is_root & ~above
    return level.select(
        *keep,
        F.when(to_top, F.lit(TOP).cast("long")).otherwise(F.col("tree")).alias("to_tree"),
        F.when(to_top, F.lit(0)).otherwise(F.lit(depth + 1)).alias("to_depth"),
        F.when(to_top, F.col("tree")).otherwise(F.floor(F.col("at") / fan)).alias("to_at"),
        (parent_is_root & (above | F.lit(n_groups == 1))).alias("done"),
        F.array(F.struct("left", "right")).cast(_PATH).alias("path"),
    )


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "source", key: str = "doc_id", tampered: dict[str, Column] | None = None, when: Column | None = None, fan: int = FAN) -> DataFrame:
    """A row for each of docs: the key, leaf, tampered (the leaf where `when` holds and the columns are replaced by `tampered`, else null), height (steps to the group's root), path and root.

    Digests are 32 bytes; the path's steps hold the siblings to the left and to the right, from the leaf up.
    """
    leaf = digest([field(F.col(c)) for c in columns])
    changed = digest([field((tampered or {}).get(c, F.col(c))) for c in columns])
    wrong = F.when(when, changed) if when is not None else F.lit(None).cast("binary")
    rows = docs.select(F.col(key).alias("key"), F.col(group).alias("in"), leaf.alias("digest"), wrong.alias("tampered"), F.monotonically_increasing_id().alias("row"))
    rows = stash(rows, "merkle-leaves")
    placed, parts = numbered(rows, "in", ["key", "digest", "row"], "merkle-placed")
    groups, group_parts = numbered(parts.select("in").distinct(), None, ["in"], "merkle-groups")
    first = group_parts.drop("__all", "size").withColumnRenamed("before", "earlier").withColumnRenamed("first", "start")
    trees = groups.join(first, "part").select("in", (F.col("id") - F.col("start") + F.col("earlier")).alias("tree"))
    n_groups = groups.count()
    spread = parts.join(trees, parts["in"].eqNullSafe(trees["in"])).select(parts["in"].alias("of"), F.col("part").alias("p"), "first", "before", "size", "tree")
    at = F.col("id") - F.col("first") + F.col("before")
    leaves = placed.join(spread, F.col("in").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p"))).select("tree", at.alias("at"), "size", "key", "digest", "tampered")

    levels, subroots = _levels(leaves.withColumn("high", F.lit(0).cast("long")), fan, "merkle-level")
    one = F.greatest(F.col("high"), F.lit(1)).alias("high")  # a lone leaf points to itself as a leaf of the tree above
    subroots = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), "digest", one, F.lit(n_groups).cast("long").alias("size"))
    above, top = _levels(subroots, fan, "merkle-top")
    root = top.first()
    inner = [_pointers(x, k, fan, n_groups, ["tree", F.lit(k).alias("depth"), "at", "high"]) for part in (levels[1:], above) for k, x in enumerate(part, part is not above)]
    own = ["key", F.col("digest").alias("leaf"), "tampered", _height(F.col("size"), fan).alias("height")]
    lone = [F.lit(TOP).cast("long").alias("to_tree"), F.lit(0).alias("to_depth"), F.col("tree").alias("to_at"), F.lit(n_groups == 1).alias("done"), F.array().cast(_PATH).alias("path")]
    nodes = leaves.filter("size = 1").select(*own, *lone)
    if levels:
        nodes = nodes.unionByName(_pointers(levels[0], 0, fan, n_groups, own))
    nodes = stash(nodes, "merkle-nodes")
    finished = [nodes.filter("done")]
    steps, scratch = root["high"] if root else 0, [rows, placed, groups, *levels, *above]
    if inner:
        ancestors = inner[0]
        for x in inner[1:]:
            ancestors = ancestors.unionByName(x)
        ancestors = stash(ancestors, "merkle-inner")
        distance = 1
        while distance < steps:
            right = ancestors.filter(F.col("high") >= distance)
            if distance >= 8 and right.count() <= BROADCAST:
                right = F.broadcast(right)
            scratch += [nodes, ancestors]
            nodes = stash(_jump(nodes, right, ["key", "leaf", "tampered", "height"]), "merkle-nodes")
            finished.append(nodes.filter("done"))
            ancestors = stash(ancestors.filter("done").unionByName(_jump(ancestors, right, ["tree", "depth", "at", "high"])), "merkle-inner")
            distance *= 2
        scratch.append(ancestors)
    out = finished[0]
    for x in finished[1:]:
        out = out.unionByName(x)
    out = stash(out.select("key", "leaf", "tampered", "height", "path"), "merkle-proofs")
    for x in [*scratch, nodes]:
        unstash(x)
    return out.withColumn("root", F.lit(bytes(root["digest"]) if root else None).cast("binary"))


def _jump(nodes: DataFrame, ancestors: DataFrame, keep: list[str]) -> DataFrame:
    """The open nodes, pointing where their pointers' nodes point, with those nodes' paths behind their own."""
    a = ancestors.select(*[F.col(c).alias(f"a_{c}") for c in ("tree", "depth", "at", "to_tree", "to_depth", "to_at", "done", "path")])
    met = (F.col("to_tree") == F.col("a_tree")) & (F.col("to_depth") == F.col("a_depth")) & (F.col("to_at") == F.col("a_at"))
    return nodes.filter("not done").join(a, met).select(
        *keep, F.col("a_to_tree").alias("to_tree"), F.col("a_to_depth").alias("to_depth"), F.col("a_to_at").alias("to_at"), F.col("a_done").alias("done"), F.concat("path", "a_path").alias("path")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every document's proof, and whether it holds; half the documents have lost their line ends since."""
    key = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    found = manifest(docs, tampered={"text": F.translate("text", "\n", "")}, when=F.crc32(key) % 2 == 0)
    steps = F.size("path")
    subroot = fold(F.col("leaf"), F.slice("path", 1, F.col("height").cast("int")))
    siblings = F.array_join(F.transform("path", lambda s: _hex(F.concat(s["left"], s["right"]))), "")
    found = found.withColumn("subroot", subroot)
    rest = F.slice("path", F.col("height").cast("int") + 1, steps)
    folded = F.when(F.col("tampered").isNotNull(), fold(F.col("tampered"), F.col("path"))).otherwise(fold(F.col("subroot"), rest))
    found = found.withColumn("folded", folded)
    return found.select(
        F.col("key").alias("doc_id"), _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), _hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


#: DuckDB has no crc32: `crc` holds the table of its steps, and crc_sql() is the check sum of a list of bytes.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) r(i))"


def crc_sql(data: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, crc.steps[(xor(c, b) & 255) + 1])), 4294967295)"


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL: levels and proofs by recursion."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*[value(c) for c in COLUMNS[:-1]], text]) + ")"
    bytes_of = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)"
    levels = "(SELECT tree, 0 AS lvl, at_, h, size FROM {src} UNION ALL SELECT tree, lvl + 1, at_ // 3, sha256(string_agg(h, '' ORDER BY at_)), (size + 2) // 3 FROM {me} WHERE size > 1 GROUP BY tree, lvl, at_ // 3, size)"
    steps = """SELECT a.tree, a.at_, a.lvl, coalesce(string_agg(b.h, '' ORDER BY b.at_) FILTER (b.at_ < a.here), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.at_) FILTER (b.at_ > a.here), '') AS r
FROM (SELECT t.tree, t.at_, s.lvl, t.at_ // power(3, s.lvl)::BIGINT AS here FROM {src} t JOIN (SELECT DISTINCT tree, lvl FROM {nodes} WHERE size > 1) s USING (tree)) a
JOIN {nodes} b ON b.tree = a.tree AND b.lvl = a.lvl AND b.at_ // 3 = a.here // 3 GROUP BY a.tree, a.at_, a.lvl"""
    return f"""
WITH RECURSIVE {CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, {leaf(value('text'))} AS h, CASE WHEN doc_id IS NOT NULL AND {crc_sql(bytes_of)} % 2 = 0 THEN {leaf(value("replace(text, chr(10), '')"))} END AS wrong, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT {', '.join(COLUMNS)} FROM documents), crc),
leaves AS MATERIALIZED (SELECT doc_id, h, wrong, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS at_, count(*) OVER (PARTITION BY tree) AS size FROM d),
nodes AS {levels.format(src='leaves', me='nodes')},
subroots AS MATERIALIZED (SELECT 0::BIGINT AS tree, tree AS at_, h, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops AS {levels.format(src='subroots', me='tops')},
s1 AS MATERIALIZED ({steps.format(src='leaves', nodes='nodes')}), s2 AS MATERIALIZED ({steps.format(src='subroots', nodes='tops')}),
low AS (SELECT tree, at_, list(l || '|' || r ORDER BY lvl) AS steps, string_agg(l || r, '' ORDER BY lvl) AS sib FROM s1 GROUP BY tree, at_),
up AS (SELECT at_ AS tree, list(l || '|' || r ORDER BY lvl) AS steps, string_agg(l || r, '' ORDER BY lvl) AS sib FROM s2 GROUP BY at_),
own AS (SELECT leaves.doc_id, leaves.tree, h, wrong, list_concat(coalesce(low.steps, []), coalesce(up.steps, [])) AS steps, coalesce(low.sib, '') || coalesce(up.sib, '') AS sib
FROM leaves LEFT JOIN low ON low.tree = leaves.tree AND low.at_ = leaves.at_ LEFT JOIN up ON up.tree = leaves.tree),
folded AS (SELECT *, list_reduce(list_prepend(coalesce(wrong, h), steps), lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) AS folded_root FROM own)
SELECT doc_id, folded.h AS leaf, subroots.h AS subroot, t.h AS root, sha256(sib) AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM folded JOIN subroots ON subroots.at_ = folded.tree, (SELECT h FROM tops WHERE size = 1) t"""
