"""Merkle manifest of a dataset: one tree per group, one over the groups.

Every row is a leaf, the hash of its typed, length-prefixed columns. Within a
group the leaves are numbered by ``row_number`` and, level by level, each run
of ``fanout`` neighbours is gathered into a sorted array and hashed into its
parent, until one node, the subroot, is left. The subroots, in order of their
groups, are folded by the same levels into the root. Going down again, a join
per level appends the siblings of each node to what its parent has, so a proof
is never longer than the tree is high.

All of it is DataFrame operations. Numbers come from range partitions, counted
and offset, so that a group that holds most rows is not numbered in one task;
every later group is a run of at most ``fanout`` rows. Each level is written
to the scratch folder, an eighth of the one below, and read from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import BROADCAST_BYTES, fold, numbered, table, write_table

FANOUT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A step of a proof: the hashes left and right of the node in its run, as one text each.
STEPS = "array<struct<l string, r string>>"


def encoded(value: Column) -> Column:
    """A value as unambiguous text: ``-`` for null, else its number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """The group as text that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("v"), group.cast("string")), F.lit(""))


def runs_of(nodes: DataFrame, fanout: int, *more: str) -> DataFrame:
    """The runs of a level: g, p (number of the parent), n, kids in order, hash of the parent. Groups of one node are done and have none."""
    kids = F.sort_array(F.collect_list(F.struct("idx", "hash", *more)))
    grouped = nodes.where("n > 1").groupBy("g", F.expr(f"idx div {fanout}").alias("p"))
    hashed = grouped.agg(F.first("n").alias("n"), kids.alias("kids"))
    return hashed.withColumn("hash", digest(F.array_join("kids.hash", "")))


class Tree:
    """The levels over numbered ``nodes`` (g, idx, n, hash, more columns): ``runs`` from the bottom, ``tops`` (level, g, hash) of the groups."""

    def __init__(self, nodes: DataFrame, fanout: int, tag: str, *more: str):
        self.runs, self.sizes = [], []
        tops = nodes.where("n = 1").select(F.lit(0).alias("level"), "g", "hash")
        most = nodes.agg(F.max("n")).first()[0] or 0
        while most > 1:
            run = write_table(runs_of(nodes, fanout, *(more if not self.runs else ())), f"{tag}-{len(self.runs)}")
            self.runs.append(run)
            self.sizes.append(run.count())
            nodes = run.select("g", F.col("p").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), "hash")
            tops = tops.unionByName(nodes.where("n = 1").select(F.lit(len(self.runs)).alias("level"), "g", "hash"))
            most = -(-most // fanout)
        self.tops = write_table(tops, f"{tag}-tops")

    def down(self, paths: DataFrame, fanout: int, high: int, level: int = 0) -> DataFrame:
        """Nodes of ``level`` in runs, as (g, kid, steps, carried columns); ``paths`` has level, g, steps and carried columns of each top.

        ``high`` is the most steps that a path can have, for the size of what is broadcast.
        """
        carried = [c for c in paths.columns if c not in ("level", "g", "steps")]
        at = None
        for k in range(len(self.runs) - 1, level - 1, -1):
            here = paths.where(F.col("level") == k + 1).select("g", F.lit(0).cast("long").alias("p"), "steps", *carried)
            if at is not None:
                here = here.unionByName(at.select("g", F.col("kid.idx").alias("p"), "steps", *carried))
            if self.sizes[k] * (256 + 80 * fanout * high) <= BROADCAST_BYTES:
                here = F.broadcast(here)  # as many rows as there are runs, counted
            run = self.runs[k].drop("hash", "n").join(here, ["g", "p"])
            run = run.select("g", "steps", *carried, F.col("kids.hash").alias("hashes"), F.posexplode("kids").alias("pos", "kid"))
            step = F.struct(
                F.array_join(F.slice("hashes", F.lit(1), F.col("pos")), "").alias("l"),
                F.array_join(F.slice("hashes", F.col("pos") + 2, F.lit(fanout)), "").alias("r"),
            )
            at = run.select("g", "kid", F.concat(F.array(step), "steps").alias("steps"), *carried)
        return at


def manifest(leaves: DataFrame, order: list[str], fanout: int = FANOUT) -> DataFrame:
    """The proof of every leaf: all columns of ``leaves``, subroot, root, and ``steps`` (see STEPS) from the leaf to the root.

    ``leaves`` has ``g`` (see :func:`group_key`), ``hash`` and any other
    columns that do not clash with idx, n, kids, p, steps, subroot, root.
    Leaves ascend by ``order`` within their group, nulls first, then by hash.
    No leaves, no rows.
    """
    more = [c for c in leaves.columns if c not in ("g", "hash")]
    nodes = write_table(numbered(leaves, [*order, *(["hash"] if "hash" not in order else [])], "leaves"), "nodes")
    groups = Tree(nodes, fanout, "level", *more)
    over = groups.tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "hash", "level")
    over = write_table(numbered(over, ["name"], "subroots"), "groups")
    top = Tree(over, fanout, "top", "name", "level")
    found = top.tops.first()
    root = F.lit(found["hash"] if found else None).cast("string").alias("root")
    high = len(top.runs) + len(groups.runs)
    if top.runs:
        start = top.tops.select("level", "g", F.lit(None).cast(STEPS).alias("steps")).withColumn("steps", F.array().cast(STEPS))
        kid = top.down(start, fanout, high)
        paths = kid.select(F.col("kid.level").alias("level"), F.col("kid.name").alias("g"), "steps", F.col("kid.hash").alias("subroot"))
    else:
        paths = over.select("level", F.col("name").alias("g"), F.array().cast(STEPS).alias("steps"), F.col("hash").alias("subroot"))
    paths = write_table(paths, "group-paths")
    alone = nodes.where("n = 1").select("g", "hash", *more)
    proofs = alone.join(paths.where("level = 0").select("g", "steps", "subroot"), "g").select("g", "hash", *more, "subroot", root, "steps")
    if groups.runs:
        low = groups.down(paths, fanout, high)
        proofs = proofs.unionByName(low.select("g", "kid.hash", *[F.col(f"kid.{c}").alias(c) for c in more], "subroot", root, "steps"))
    return proofs


def siblings(steps: str = "steps") -> Column:
    """All sibling hashes of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), "")


def folded(leaf: Column, steps: str = "steps") -> Column:
    """The root that a leaf gives with the siblings of a proof."""
    return F.aggregate(steps, leaf, lambda node, s: digest(s["l"], node, s["r"]))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame) -> DataFrame:
    """g, doc_id, hash, and ``changed``: the hash after A-Z of the text became a-z, for rows whose id's crc32 divides by 3 (else null).

    A null id is never tampered with; other columns are ignored.
    """
    whole = [encoded(F.col(c)) for c in COLUMNS]
    changed = [*whole[:-1], encoded(F.translate("text", UPPER, LOWER))]
    tampered = F.when(fold(F.col("doc_id"), 3) == 0, digest(*changed))
    return docs.select(group_key(F.col("lang")).alias("g"), "doc_id", digest(*whole).alias("hash"), tampered.alias("changed"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof digest and verification of every document, a third of them tampered with.

    Nulls in any column hash as ``-``; repeated rows are leaves of their own
    beside each other; a group of one row is its own subroot and a table of
    one group has that subroot as its root.
    """
    proofs = manifest(document_leaves(table(spark, sf_dir, "documents")), ["doc_id"])
    start = F.coalesce("changed", "hash")
    out = proofs.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings().cast("binary"), 256).alias("proof_sha256"), folded(start).alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL spells out: groups of up to 8^9 rows, up to 8^3 groups.
SQL_LEVELS, SQL_TOP_LEVELS = 9, 3


def _sql_level(name: str, below: str, fanout: int) -> tuple[str, str]:
    """The SQL of a level's siblings and of its parents."""
    run = f"partition by g, idx // {fanout} order by idx"
    sides = (
        f"{below}s as materialized (select g, idx, n > 1 as live,"
        f" coalesce(string_agg(h, '') over ({run} rows between unbounded preceding and 1 preceding), '') as l,"
        f" coalesce(string_agg(h, '') over ({run} rows between 1 following and unbounded following), '') as r from {below})"
    )
    up = (
        f"{name} as materialized (select g, idx // {fanout} as idx, (max(n) + {fanout - 1}) // {fanout} as n,"
        f" case when max(n) > 1 then sha256(string_agg(h, '' order by idx)) else max(h) end as h from {below} group by g, idx // {fanout})"
    )
    return sides, up


def _oracle(fanout: int = FANOUT) -> str:
    value = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
    head = " || ".join(value.format(c) for c in COLUMNS[:-1])
    crc = (
        "xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint),"
        " lambda c, b: list_reduce(range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(c, b)), 4294967295), 4294967295)"
    )
    ctes = [
        f"raw as materialized (select doc_id, coalesce('v' || lang, '') as g, sha256({head} || {value.format('text')}) as h,"
        f" case when {crc} % 3 = 0 then sha256({head} || {value.format(f'translate(text, {UPPER!r}, {LOWER!r})')}) end as t from documents)",
        "leaf as materialized (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as idx, count(*) over (partition by g) as n from raw)",
        "a0 as materialized (select g, idx, n, h from leaf)",
    ]
    for k in range(SQL_LEVELS):
        ctes += _sql_level(f"a{k + 1}", f"a{k}", fanout)
    ctes.append(f"b0 as materialized (select '' as g, row_number() over (order by g) - 1 as idx, count(*) over () as n, h, g as name from a{SQL_LEVELS})")
    for k in range(SQL_TOP_LEVELS):
        ctes += _sql_level(f"b{k + 1}", f"b{k}", fanout)
    steps = [(f"a{k}s", f"p.g = x.g and p.idx // {fanout**k} = x.idx") for k in range(SQL_LEVELS)]
    steps += [(f"b{k}s", f"p.pos // {fanout**k} = x.idx") for k in range(SQL_TOP_LEVELS)]
    ctes.append("p0 as materialized (select f.*, b.idx as pos, b.h as subroot, '' as sibs, coalesce(t, f.h) as node from leaf f join b0 b on b.name = f.g)")
    for k, (side, on) in enumerate(steps):
        ctes.append(
            f"p{k + 1} as materialized (select p.* replace (case when x.live then p.sibs || x.l || x.r else p.sibs end as sibs,"
            f" case when x.live then sha256(x.l || p.node || x.r) else p.node end as node) from p{k} p join {side} x on {on})"
        )
    return (
        f"with {', '.join(ctes)} select p.doc_id, p.h as leaf, p.subroot, r.h as root, sha256(p.sibs) as proof_sha256, p.node as folded_root, p.node = r.h as verified"
        f" from p{len(steps)} p cross join b{SQL_TOP_LEVELS} r"
    )


ORACLE = _oracle()
