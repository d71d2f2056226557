"""Sharding by balanced label propagation, in DataFrame operations only.

Law `rows`: shard sizes in rows differ by one at most. Linked rows (those of a group) start in a
packing of whole groups: those of over a PART-th of a shard, which are few, largest first, each in
the fullest shard that can hold it or else in as few shards as it needs; the small ones end to end
in what is left, where at most one for each border between shards does not fit. Then labels are
propagated until no row moves: each round, a group names the shard that holds most of it among
those with room, its members elsewhere want to move there, and as many may as the shard has room
for (those of the largest groups first). With one group a row, the packing leaves little to move.
Rows without links then fill the shards up to their exact sizes. `cuts` tells how many shards
each group is in, and how many it needs at least.

Ranks are never taken in one task: rows are counted by (shard, bucket), offsets summed over the
counts, and rows numbered within their bucket. Buckets are drawn from hashes of the rows, and
their number follows the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, load

SHARDS = 24
#: Groups of over a PART-th of a shard are packed one by one on the driver: at most SHARDS * PART.
PART = 64
#: Rounds beyond the number of shards after which propagation ends even if rows still move.
EXTRA_ROUNDS = 8
#: Rows per bucket of a distributed numbering.
BUCKET_ROWS = 2_000


def numbered(df: DataFrame, part: str, name: str, order: list[Column], buckets: int) -> DataFrame:
    """Numbers rows 0, 1, ... within each value of `part`, by bucket and then by `order`; `part` values should be few and df written or deterministic."""
    # Each numbering has hashes of its own: rows that one numbering put side by side, as those that fill a shard, would else share a bucket in the next.
    b = F.pmod(F.xxhash64(F.lit(f"{part}/{name}"), *order), F.lit(buckets))
    df = df.withColumn("_b", b)
    sums = Window.partitionBy(part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(part, "_b").agg(F.count("*").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(sums), F.lit(0))).select(part, "_b", "_off")
    inner = Window.partitionBy(part, "_b").orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(inner))
    return ranked.join(offsets, [part, "_b"]).withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("long")).drop("_b", "_off", "_rn")


def fitted(size: int, room: list[int]) -> list[tuple[int, int]]:
    """(shard, rows) for a group of `size` rows, in as few shards as `room` allows; takes the room."""
    out = []
    while size:
        whole = [k for k, r in enumerate(room) if r >= size]
        k = min(whole, key=lambda x: (room[x], x)) if whole else max(range(len(room)), key=lambda x: (room[x], -x))
        taken = min(size, room[k])
        if not taken:
            break
        room[k] -= taken
        size -= taken
        out.append((k, taken))
    return out


def valued(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of numbers, as SQL values."""
    fields = [f.split() for f in schema.split(", ")]
    made = ", ".join("struct(" + ", ".join(f"CAST({x} AS {t}) AS `{n}`" for x, (n, t) in zip(r, fields)) + ")" for r in rows)
    empty = "array<struct<" + ", ".join(f"`{n}`: {t}" for n, t in fields) + ">>"
    return spark.sql(f"SELECT inline(CAST(array({made}) AS {empty}))")


def packed(members: DataFrame, sizes: list[int], buckets: int, scratch: Scratch) -> DataFrame:
    """rid, shard of every member by its first group; groups whole where they fit."""
    spark, room = members.sparkSession, list(sizes)
    first = scratch.save("first", members.groupBy("rid").agg(F.min("grp").alias("grp")))
    groups = scratch.save("groups", first.groupBy("grp").agg(F.count("*").alias("size")))
    least = max(sizes) // PART
    pieces: list[tuple[int, int, int, int]] = []

    def place(grp: int, size: int) -> None:
        at = 0
        for shard, taken in fitted(size, room):
            pieces.append((grp, shard, at, at + taken))
            at += taken

    for r in groups.where(F.col("size") > least).orderBy(F.desc("size"), "grp").collect():
        place(r["grp"], r["size"])
    # Small groups lie end to end over the room that is left: sums by bucket, then within the bucket.
    small = groups.where(F.col("size") <= least).withColumn("_b", F.pmod(F.xxhash64(F.lit("line"), "grp"), F.lit(buckets)))
    sums = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = small.groupBy("_b").agg(F.sum("size").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(sums), F.lit(0))).select("_b", "_off")
    inner = Window.partitionBy("_b").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    line = small.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(offsets, "_b").select("grp", "size", (F.col("_off") + F.col("_in")).alias("from"))
    ends = [sum(room[: k + 1]) for k in range(len(room))]

    def shard_at(x: Column) -> Column:
        return F.aggregate(F.array(*[F.lit(e).cast("long") for e in ends]), F.lit(0), lambda n, e: n + (e <= x).cast("int"))

    line = scratch.save("line", line.select("grp", "size", shard_at(F.col("from")).alias("shard"), shard_at(F.col("from") + F.col("size") - 1).alias("last")))
    for r in line.where("shard = last").groupBy("shard").agg(F.sum("size").alias("n")).collect():
        room[r["shard"]] -= r["n"]
    for r in line.where("shard < last").orderBy(F.desc("size"), "grp").collect():  # one per border at most
        place(r["grp"], r["size"])
    split = {p[0] for p in pieces if p[2]}
    known = F.broadcast(valued(spark, pieces, "grp bigint, to_shard int, from bigint, to bigint"))
    whole = F.broadcast(valued(spark, [p[:2] for p in pieces if p[0] not in split], "grp bigint, shard int"))
    parts = F.broadcast(valued(spark, [(g,) for g in split], "grp bigint"))
    # Rows of the groups placed on the driver meet them by broadcast: a large group is dealt to no single task.
    numbers = numbered(first.join(parts, "grp"), "grp", "at", [F.col("rid")], buckets)
    of_parts = numbers.join(known, "grp").where((F.col("at") >= F.col("from")) & (F.col("at") < F.col("to"))).select("rid", F.col("to_shard").alias("shard"))
    of_whole = first.join(whole, "grp").select("rid", "shard")
    rest = first.join(F.broadcast(known.select("grp").distinct()), "grp", "left_anti")
    of_small = rest.join(line.where("shard = last").select("grp", "shard"), "grp").select("rid", "shard")
    return of_parts.unionByName(of_whole).unionByName(of_small)


def met(rows: DataFrame, table: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """rows joined to a table of groups: those of hot groups (at most SHARDS * PART) by broadcast, so that no task gets a whole hot group; the others by shuffle."""
    few = F.broadcast(hot)
    by_broadcast = rows.join(few, "grp", "left_semi").join(F.broadcast(table.join(few, "grp", "left_semi")), on)
    return by_broadcast.unionByName(rows.join(few, "grp", "left_anti").join(table.join(few, "grp", "left_anti"), on))


def propagated(members: DataFrame, sizes: list[int], buckets: int, scratch: Scratch) -> DataFrame:
    """members: rid, grp (a row may be in several groups). Returns rid, shard; no shard gets much more than its size (rest: see `balanced`)."""
    shards, capacity = len(sizes), max(1, min(sizes))
    state = scratch.save("state-0", packed(members, sizes, buckets, scratch))
    spark = members.sparkSession
    hot = scratch.save("hot", members.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > capacity // PART).select("grp"))
    for k in range(shards + EXTRA_ROUNDS):
        held = members.join(state, "rid").groupBy("grp", "shard").agg(F.count("*").alias("c"))
        held = scratch.save(f"held-{k}", held)
        # One row per shard: sizes are bounded by the number of shards.
        room = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(state.groupBy("shard").agg(F.count("*").alias("n")), "shard", "left").select("shard", F.greatest(F.lit(capacity) - F.coalesce("n", F.lit(0)), F.lit(0)).alias("room"))
        pick = F.struct("c", F.xxhash64("grp", "shard"))
        best = held.join(F.broadcast(room), "shard").where("room > 0").groupBy("grp").agg(F.max_by("shard", pick).alias("goal"), F.max("c").alias("goal_c"))
        best = scratch.save(f"best-{k}", best)
        here = met(members.join(state, "rid"), best, ["grp"], hot)
        votes = here.groupBy("rid", "shard", "goal").agg(F.sum("goal_c").alias("gain"))
        want = votes.groupBy("rid", "shard").agg(F.max_by("goal", F.struct("gain", F.xxhash64("rid", "goal"))).alias("goal"), F.max("gain").alias("gain"))
        # A row leaves only for a shard that holds more of its groups than its own does (ties: from a full shard always, else by hash, the same for a whole group).
        own = met(members.join(state, "rid"), held, ["grp", "shard"], hot).groupBy("rid").agg(F.sum("c").alias("own"), F.min("grp").alias("grp"))
        worth = (F.col("gain") > F.col("own")) | ((F.col("gain") == F.col("own")) & ((F.col("room") == 0) | (F.xxhash64("grp", F.col("goal")) > F.xxhash64("grp", F.col("shard")))))
        moves = want.join(own, "rid").join(F.broadcast(room), "shard").where((F.col("goal") != F.col("shard")) & worth).select("rid", "goal", F.floor(F.log2(F.col("gain") + 1) * 4).cast("int").alias("level"))
        moves = scratch.save(f"moves-{k}", moves)
        if moves.isEmpty():
            break
        # Levels are few (of logarithms): all of those above the quota, and a hashed share of the one that crosses it.
        before = Window.partitionBy("goal").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
        levels = moves.groupBy("goal", "level").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        share = levels.join(room.withColumnRenamed("shard", "goal"), "goal").select("goal", "level", ((F.col("room") - F.col("before")) / F.col("n")).alias("share"))
        taken = moves.join(F.broadcast(share), ["goal", "level"]).where(F.pmod(F.xxhash64("rid", F.lit(k)), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("rid", "goal")
        state = scratch.save(f"state-{k + 1}", state.join(taken, "rid", "left").select("rid", F.coalesce("goal", "shard").alias("shard")))
        scratch.drop(f"state-{k}")
        scratch.drop(f"held-{k}")
        scratch.drop(f"best-{k}")
        scratch.drop(f"moves-{k}")
    return state


def balanced(nodes: DataFrame, members: DataFrame, shards: int = SHARDS, scratch: Scratch | None = None) -> DataFrame:
    """rid, shard for every row of `nodes` (rid: numbers from 0 without gaps); exact row counts, few cut links."""
    scratch = scratch or Scratch(nodes.sparkSession, "shards")
    spark = nodes.sparkSession
    n = nodes.count()
    if not n:
        return nodes.select("rid", F.lit(0).alias("shard"))
    buckets = n // BUCKET_ROWS + 1
    state = propagated(members, [n // shards + (k < n % shards) for k in range(shards)], buckets, scratch)
    # Rows beyond a shard's size, and rows without links, fill the places that are left.
    size = F.lit(n // shards) + F.when(F.col("shard") < n % shards, 1).otherwise(0)
    placed = numbered(state, "shard", "at", [F.col("rid")], buckets).withColumn("keep", F.col("at") < size)
    placed = scratch.save("placed", placed.select("rid", "shard", "keep"))
    fixed = placed.where("keep").select("rid", "shard")
    free = nodes.select("rid").join(fixed.select("rid"), "rid", "left_anti").withColumn("one", F.lit(0))
    free = numbered(free, "one", "at", [F.col("rid")], buckets)
    gaps = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(fixed.groupBy("shard").agg(F.count("*").alias("n")), "shard", "left").select("shard", (size - F.coalesce("n", F.lit(0))).alias("gap"))
    upto = Window.partitionBy(F.lit(0)).orderBy("shard")
    gaps = gaps.withColumn("to", F.sum("gap").over(upto)).withColumn("from", F.col("to") - F.col("gap"))  # one row per shard
    filled = free.join(F.broadcast(gaps), (F.col("at") >= F.col("from")) & (F.col("at") < F.col("to"))).select("rid", "shard")
    return fixed.unionByName(filled)


def cuts(members: DataFrame, placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """grp, size, shards, least of every group: the shards it is in, and those that its size needs if the largest shards are its own."""
    n = placed.count()
    q, more = n // shards, n % shards
    wide = F.ceil(F.col("size") / F.lit(q + 1))
    least = F.when(F.col("size") <= more * (q + 1), wide).otherwise(F.lit(more) + F.ceil((F.col("size") - more * (q + 1)) / F.lit(max(q, 1))))
    held = members.join(placed, "rid").groupBy("grp", "shard").agg(F.count("*").alias("c"))
    return held.groupBy("grp").agg(F.sum("c").alias("size"), F.count("*").alias("shards")).withColumn("least", least.cast("long"))


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; rows with equal texts are linked.

    Null and empty texts are equal texts like others (null counts as empty in size and crc, but
    is no group). Rows with null or repeated ids are rows of their own. An empty table gives
    none. Only a digest of each text is shuffled.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("doc_id"), (F.length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.when(F.col(text).isNotNull(), F.sha2(body, 256)).alias("digest"))
    rows = scratch.save("rows", rows)
    n = rows.count()
    buckets = n // BUCKET_ROWS + 1
    order = [F.col(c) for c in ("doc_id", "text_crc32", "size", "digest")]
    rows = scratch.save("numbered", numbered(rows.withColumn("_one", F.lit(0)), "_one", "rid", order, buckets).drop("_one"))
    scratch.drop("rows")
    twice = rows.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest", F.xxhash64("digest").alias("grp"))
    # Written, so that the join below has a shuffle of its own on both sides: Spark splits a hot digest's rows only then.
    twice = scratch.save("twice", twice)
    members = scratch.save("members", rows.select("rid", "digest").join(twice, "digest").select("rid", "grp"))
    placed = balanced(rows.select("rid"), members, shards, scratch)
    out = scratch.save("out", rows.select("rid", "doc_id", "size", "text_crc32").join(placed, "rid"))
    out = numbered(out, "shard", "slot", [F.col("rid")], buckets)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(load(spark, sf_dir, "documents").select("doc_id", "text"))
