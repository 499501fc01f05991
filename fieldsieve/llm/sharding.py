"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents of equal text are linked. Rows are dealt to shards in the order of a hash. In each round the
members of a group that a shard holds look at the shards that hold their neighbours and ask to
move to the one that holds most (every other round: most among those with room). Between two
shards as many move as want to come back, and besides as many as the target's quota leaves room
for, by gain. Every move cuts fewer edges than before, so rounds end; they do when one of either
kind moves nothing. Linked documents of one group in one shard are alike, so a round works on
their counts (group, shard, members), one row for each. Documents without links fill the shards up
to their quotas in the end, so the numbers of rows differ by one at most (law `rows`). A group
larger than a shard is spread over several.

Defined results
- null text: linked with other null texts only; its size is 1. Empty text: likewise, size 1.
- null doc_id and repeated rows: rows count, not ids; each gets a place of its own.
- ties between shards are decided by a hash of the group and the shard, so that groups spread.
- very long texts: compared by their MD5. Further columns don't matter here, whatever their names.
- an empty table: no rows. Fewer rows than shards: some shards are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, discard

SHARDS = 8
#: Parts in which a shard's rows are numbered apart.
PARTS = 1024


def _numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds a number from 0 within each group, in the order of parts (by hash) and then `order`; no group is in one task."""
    df = df.withColumn("__part", F.pmod(F.xxhash64("row"), F.lit(PARTS)))
    sizes = df.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, "__part").orderBy(*order)
    out = df.withColumn("__r", F.row_number().over(inside) - 1).join(starts, [*group, "__part"])
    return out.withColumn(name, (F.col("__r") + F.col("__start")).cast("long")).drop("__part", "__r", "__start")


def _quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _lookup(values: list[int], index: Column) -> Column:
    """values[index], as an expression over a handful of values."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index + 1)


def _counts(cells: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("m").alias("n")).collect()}  # one row a shard
    return [found.get(s, 0) for s in range(shards)]


def cut_edges(cells: DataFrame) -> int:
    """Linked pairs in different shards, every two members of a group being linked."""
    square = lambda c: F.pow(F.col(c).cast("double"), 2)
    sums = cells.groupBy("group").agg(F.sum("m").alias("n"), F.sum(square("m")).alias("inside"))
    return int((sums.agg(F.sum(square("n") - F.col("inside"))).first()[0] or 0) / 2)


def _allowed(asked: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many may go from shard a to shard b: as many as want to come back, and what room b has besides."""
    n = len(room)
    allow = [[min(asked[a][b], asked[b][a]) for b in range(n)] for a in range(n)]
    for b in range(n):
        left = max(0, room[b])
        for a in sorted(range(n), key=lambda a: allow[a][b] - asked[a][b]):
            more = min(left, asked[a][b] - allow[a][b])
            allow[a][b] += more
            left -= more
    return allow


def _requests(cells: DataFrame, room: list[int] | None) -> DataFrame:
    """(group, shard, to, m, gain): the m members of a group in a shard that ask to move; room: only to shards that have some."""
    targets = cells if room is None else cells.where(_lookup(room, F.col("shard")) > 0)
    # the most members, and among equals a hash's choice; the shard is told apart in the hash's last bits
    best = targets.groupBy("group").agg(F.max(F.struct(F.col("m").alias("most"), F.xxhash64("group", "shard").alias("h"), "shard")).alias("b"))
    wish = cells.join(best, "group").select("group", "shard", F.col("b.shard").alias("to"), "m", (F.col("b.most") - F.col("m")).alias("gain"))
    return wish.where((F.col("to") != F.col("shard")) & (F.col("gain") >= 0))


def _granted(wish: DataFrame, allow: list[list[int]]) -> DataFrame:
    """wish with grant, how many of m may move: in the order of gain (by powers of two), then by a hash of the group."""
    keys, n = ["shard", "to"], len(allow)
    level = F.floor(F.log2(F.col("gain") + 2)).cast("int")
    wish = wish.withColumn("level", level).withColumn("h", F.xxhash64("group")).withColumn("part", F.pmod("h", F.lit(PARTS)))
    sums = wish.groupBy(*keys, "level", "part").agg(F.sum("m").alias("m"))  # at most shards^2 * 64 * PARTS rows
    upto = Window.partitionBy(*keys).orderBy(F.col("level").desc(), "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "level", "part", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("part_at"))
    upto = Window.partitionBy(*keys, "level", "part").orderBy("h", "group").rowsBetween(Window.unboundedPreceding, -1)
    placed = wish.withColumn("own_at", F.coalesce(F.sum("m").over(upto), F.lit(0))).join(sums, [*keys, "level", "part"])
    limit = _lookup([x for row in allow for x in row], F.col("shard") * n + F.col("to"))
    grant = F.least(F.col("m"), limit - F.col("part_at") - F.col("own_at"))
    return placed.withColumn("grant", grant).where("grant > 0").select("group", "shard", "to", "m", "grant")


def propagated(cells: DataFrame, quota: list[int], trace: list[int] | None = None) -> DataFrame:
    """cells (group, shard, m) after rounds under quotas until nothing moves; trace: gets the cut edges before each round and after the last."""
    shards, turn, idle = len(quota), 0, 0
    while idle < 2:
        if trace is not None:
            trace.append(cut_edges(cells))
        room = [q - n for q, n in zip(quota, _counts(cells, shards), strict=True)]
        wish = cut(_requests(cells, None if turn % 2 == 0 else room), "wish")
        asked = [[0] * shards for _ in range(shards)]
        for r in wish.groupBy("shard", "to").agg(F.sum("m").alias("m")).collect():  # one row for two shards
            asked[r["shard"]][r["to"]] = r["m"]
        allow = _allowed(asked, room)
        turn += 1
        if not any(map(sum, allow)):
            idle += 1
            discard(wish)
            continue
        idle = 0
        grants = _granted(wish, allow)
        moves = grants.select("group", F.explode(F.array(F.struct("shard", (-F.col("grant")).alias("m")), F.struct(F.col("to").alias("shard"), F.col("grant").alias("m")))).alias("x")).select("group", "x.*")
        before, cells = cells, cut(cells.union(moves).groupBy("group", "shard").agg(F.sum("m").alias("m")).where("m > 0"), "cells")
        discard(before), discard(wish)
    return cells


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row for each of docs."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    group = F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.md5(text))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), group.alias("group"))
    # a number for each row, kept in a written table
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    quota = _quotas(rows.count(), shards)
    groups = cut(rows.groupBy("group").agg(F.count("*").alias("members")).where("members > 1").select("group"), "groups")
    dealt = _numbered(rows.select("row", "group").withColumn("one", F.lit(0)), ["one"], [F.xxhash64("row")], "k")
    dealt = dealt.join(groups, "group").withColumn("shard", (F.col("k") % shards).cast("int"))
    linked = rows.select("row", "group").join(groups, "group")
    cells = propagated(cut(dealt.groupBy("group", "shard").agg(F.count("*").alias("m")), "cells"), quota)
    free = [q - n for q, n in zip(quota, _counts(cells, shards), strict=True)]
    ends = [sum(free[: s + 1]) for s in range(shards)]
    # members of a group are alike: its k-th row goes to the shard whose stretch of the group's count holds k
    upto = F.sum("m").over(Window.partitionBy("group").orderBy("shard"))
    stretches = cells.select("group", "shard", upto.alias("upto")).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("s"))  # at most one a shard
    placed = _numbered(linked, ["group"], [F.col("row")], "k").join(stretches, "group")
    placed = placed.select("row", F.get(F.filter("s", lambda x: x["upto"] > F.col("k")), F.lit(0))["shard"].alias("shard"))
    single = rows.join(groups, "group", "left_anti").select("row").withColumn("one", F.lit(0))
    shard = reduce(lambda out, s: F.when(F.col("k") < ends[s], s).otherwise(out), reversed(range(shards - 1)), F.lit(shards - 1))
    single = _numbered(single, ["one"], [F.col("row")], "k").select("row", shard.cast("int").alias("shard"))
    labels = placed.union(single)
    return _numbered(rows.join(labels, "row"), ["shard"], [F.col("row")], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    out = assigned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
