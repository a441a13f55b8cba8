"""Problem 1: splits that keep related records together.

Records that share an entity (a chunk or a document), directly or through others, form a group. Every record is stood
for by its document (else its chunk, else itself), and those that another entity puts together are linked to the least
of them, so a document with a third of all rows is one node, and one that shares nothing has no link.
Connected components run by alternating large-star and small-star (Kiveris et al., SoCC 2014) on that graph:
each step is an aggregation (minimum of the neighbours) and one join, written to the shared folder. Hub nodes are
salted in the join. Whole groups then go to splits by the hash of the group, into ranges proportional to the targets; only
groups with more than a hundredth of all ids are placed one by one before.

Results by case: null and blank ids link nothing; a record without any entity is its own group; a repeated record id
links its rows; rows without an id link their entities but come out nowhere; ids compare without case and surrounding white space; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.words import clean_id
from loomline.operators.skew import hub_join
from loomline.session import Stage

#: A group with more than 1/LARGE of the ids is placed by itself; hash cells whose ids are counted.
LARGE, CELLS = 100, 4096


def _star(both: DataFrame, keep: Column, links: int) -> DataFrame:
    """Links (v, m(u)) for every neighbour v of u that ``keep`` admits, m(u) the least of u and its neighbours.

    ``both``: (u, v). The aggregate combines before it shuffles; hubs are salted in the join.
    """
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        hub_join(both, least, "u", rows=links)
        .where(keep)
        .select(F.col("v").alias("a"), F.col("m").alias("b"))
        .where("a <> b")
    )


def _count(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, a: str, b: str, most: int = 100) -> DataFrame:
    """(node, root) of every node of the links ``a`` - ``b``; the root is the least node of the component.

    Rows with a null end are ignored, self links give single nodes.
    """
    clean = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = clean.select("a").union(clean.select("b")).distinct().withColumnRenamed("a", "node")
    stage = Stage(clean.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _count(stage.df)
    for _ in range(most):
        if not mark[0]:
            break
        e = stage.df
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = Stage(_star(both, F.col("v") > F.col("u"), mark[0]).distinct(), "large")
        down = large.df.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _star(down, F.lit(True), mark[0]).union(down.groupBy("u").agg(F.min("v").alias("b")).withColumnRenamed("u", "a"))
        new = Stage(small.distinct(), "links")
        now = _count(new.df)
        stage.drop()
        large.drop()
        stage = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return nodes.join(stage.df.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("root"))


def record_groups(records: DataFrame, id_col: str = "qa_id", entities: tuple[str, ...] = ("chunk_id", "doc_id")) -> DataFrame:
    """(record, group, one column for each entity) of the distinct rows; ``group`` is the least key of the group.

    Every row has a key: its last entity that is not null (prefixed by its place in ``entities``), else the record. Keys of
    rows that share another entity, or the record id, are linked; most entities stand beside one key only and link
    nothing, which their least and greatest key tell, so components run over the few keys that are linked at all.
    """
    keys = [F.concat(F.lit(f"{i}:"), clean_id(F.col(c))) for i, c in enumerate(entities)]
    rows = records.select(F.col(id_col).alias("record"), *[k.alias(f"e{i}") for i, k in enumerate(keys)]).distinct()
    key = F.coalesce(*[F.col(f"e{i}") for i in reversed(range(len(keys)))], F.concat(F.lit("r:"), F.col("record")))
    rows = Stage(rows.withColumn("key", key), "records").df
    links = None
    for shared in [*[f"e{i}" for i in range(len(keys) - 1)], "record"]:
        own = rows.where(F.col(shared).isNotNull() & F.col("key").isNotNull()).select(shared, "key")
        apart = own.groupBy(shared).agg(F.min("key").alias("b"), F.max("key").alias("_to")).where("b <> _to").drop("_to")
        apart = Stage(apart, "linked").df
        if apart.limit(1).count():
            one = hub_join(own, apart, shared).select(F.col("key").alias("a"), "b").where("a <> b").distinct()
            links = one if links is None else links.unionByName(one)
    rows = rows.where("key is not null")
    if links is None:
        return rows.withColumnRenamed("key", "group")
    roots = Stage(connected_components(links, "a", "b"), "roots").df.withColumnsRenamed({"node": "key", "root": "_root"})
    return Stage(hub_join(rows, roots, "key", "left").withColumn("group", F.coalesce("_root", "key")).drop("key", "_root"), "groups").df


def found_groups(records: DataFrame) -> DataFrame:
    """p1_found: (qa_id, group_doc_id) of groups with at least two different ids."""
    rows = record_groups(records).where("record is not null")
    sizes = rows.groupBy("group").agg(
        F.min("e1").alias("doc"), F.min("record").alias("lo"), F.max("record").alias("hi")
    )
    big = sizes.where("lo <> hi").select("group", F.substring("doc", 3, 1 << 30).alias("group_doc_id"))
    return hub_join(rows.select("record", "group"), big, "group").select(F.col("record").alias("qa_id"), "group_doc_id").distinct()


def assign_splits(records: DataFrame, targets: DataFrame, large: int = LARGE, cells: int = CELLS) -> DataFrame:
    """(qa_id, group_id, split_name): every distinct id in one split, groups whole, sizes near the targets.

    A group's hash gives its cell, cells in their order are cut into one range for each split, in proportion to the
    targets by the ids that the cells hold. So the sizes miss the targets by a cell at most, and new data moves only
    groups next to a cut. Groups holding more than 1/``large`` of the ids, which no hash can place well, go to the split
    that lacks most, largest first. The driver sees the targets, ``cells`` counts and fewer than ``large`` groups.
    """
    rows = record_groups(records).where("record is not null").select("record", "group").distinct()
    sizes = Stage(rows.groupBy("group").agg(F.count("*").alias("n")), "sizes").df
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shares = {r["split_name"]: float(r["share"]) for r in targets.select("split_name", "share").distinct().collect()}
    scale = sum(shares.values()) or 1.0
    lack = {k: v / scale * total for k, v in sorted(shares.items())}
    placed = []
    for r in sizes.where(F.col("n") * large > total).orderBy(F.desc("n"), "group").collect():
        to = max(lack, key=lambda k: (lack[k], k))
        lack[to] -= r["n"]
        placed.append((r["group"], to))
    cell = F.pmod(F.xxhash64("group"), F.lit(cells))
    masses = sizes.where(F.col("n") * large <= total).groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")).orderBy("cell").collect()
    hashed = _ranges(cell, [(r["cell"], r["n"]) for r in masses], {k: max(v, 0.0) for k, v in lack.items()})
    if not placed:
        out = rows.withColumn("split_name", hashed)
    else:
        fixed = F.broadcast(records.sparkSession.createDataFrame(placed, "group string, placed string"))
        out = rows.join(fixed, "group", "left").withColumn("split_name", F.coalesce("placed", hashed))
    return out.select(F.col("record").alias("qa_id"), F.col("group").alias("group_id"), "split_name")


def _ranges(cell: Column, masses: list[tuple[int, int]], lack: dict[str, float]) -> Column:
    """The split of a cell: ranges of cells, as long as the splits' lacks; a cell belongs where its middle falls."""
    whole, rest, names = sum(n for _, n in masses), sum(lack.values()), list(lack)
    if not names:
        return F.lit(None).cast("string")
    done, at, upper, bound = 0, 0, lack[names[0]] * (whole / rest if rest else 0), {}
    for where, n in masses:
        while at < len(names) - 1 and done + n / 2 > upper:
            at += 1
            upper += lack[names[at]] * (whole / rest if rest else 0)
        bound[names[at]] = where
        done += n
    out = F.lit(names[-1])
    for name in reversed(names):
        if name in bound:
            out = F.when(cell <= bound[name], F.lit(name)).otherwise(out)
    return out
