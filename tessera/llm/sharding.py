"""Sharding by balanced label propagation.

Documents start in shards dealt evenly by hash.  Each round, a group of linked
documents names the shards that hold most of it as its homes, as many as its
size needs at one shard's capacity; members elsewhere ask to move to a home.
A shard accepts movers up to its quota; then the least attached documents of
over-full shards fill the others, so sizes are even again.  Rounds go on until
nobody asks to move, or PATIENCE of them in a row kept no more pairs of linked
documents together; the best placement stands.  Shards end with counts at most
one apart.

Links are given as groups, a document may be in several: two linked documents
are a group of two, equal texts one group, whatever its size, and no pair
inside a group is ever listed.

Defined results.  A null text has no bytes and forms a group with other null
texts, as empty texts do.  Repeated rows are documents of their own; rows
without doc_id too.  Other columns are ignored, and an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable, gapless_rank

SHARDS = 24
PATIENCE = 2             # rounds without a better placement that end the search
SLACK = 0.5              # share of its capacity by which a shard may overfill within a round
OVERHEAD = 8             # bytes a document takes beside its text


def _sizes(placed: DataFrame, shards: int) -> dict[int, int]:
    found = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return {s: found.get(s, 0) for s in range(shards)}


def _targets(n: int, shards: int) -> dict[int, int]:
    return {s: n // shards + (s < n % shards) for s in range(shards)}


def _number(table: dict[int, int], key) -> F.Column:
    """A column that maps a shard to its number (one entry a shard)."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _asks(placed: DataFrame, links: DataFrame, capacity: int) -> DataFrame:
    """(node, to, own, most): for each linked node the home it asks for, or
    its own shard, with the neighbours it has in its own shard."""
    at = links.join(placed, "node").select("group", "node", "shard")
    at = durable(at, "linked")
    per = durable(at.groupBy("group", "shard").agg(F.count("*").alias("c")), "group-shards")
    homes = (per.groupBy("group")
             .agg(F.sum("c").alias("size"),
                  F.sort_array(F.collect_list(F.struct(F.col("c").alias("c"),
                                                       F.xxhash64("group", "shard").alias("tie"),
                                                       F.col("shard").alias("s"))), asc=False).alias("by"))
             .where("size > 1")
             .select(F.col("group").alias("_g"),
                     F.slice("by", 1, F.ceil(F.col("size") / capacity).cast("int")).alias("homes"), "by"))
    homes = durable(homes, "homes")          # one row a group, at most one entry a shard
    m = at.join(homes, F.col("group") == F.col("_g"))
    here = F.coalesce(F.element_at(F.map_from_entries(F.transform("by", lambda x: F.struct(x["s"], x["c"]))), F.col("shard")),
                      F.lit(0))
    home = F.element_at("homes", (F.pmod(F.xxhash64("node"), F.size("homes")) + 1).cast("int"))
    at_home = F.exists("homes", lambda x: x["s"] == F.col("shard"))
    m = m.select("node", "shard", F.when(at_home, F.col("shard")).otherwise(home["s"]).alias("to"),
                 F.when(at_home, here).otherwise(home["c"]).alias("pull"), (here - 1).alias("own"))
    m = m.groupBy("node", "shard", "to").agg(F.sum("pull").alias("pull"), F.sum("own").alias("own"))
    return (m.groupBy("node").agg(F.max_by("to", F.struct("pull", "to")).alias("to"), F.sum("own").alias("own"))
            .select(F.col("node").alias("_n"), "to", "own"))


def _level(own: F.Column) -> F.Column:
    """Attachment in steps: exact up to 1,000, of about one percent beyond,
    without an upper end, so few numbers stand for any."""
    return F.when(own <= 1000, own).otherwise(1001 + F.floor(64 * F.log2(own / 1000))).cast("long")


def _kept(placed: DataFrame, links: DataFrame) -> int:
    """Ordered pairs of linked documents that share a shard."""
    per = links.join(placed, "node").groupBy("group", "shard").agg(F.count("*").alias("c"))
    return per.agg(F.sum((F.col("c") * (F.col("c") - 1)).cast("decimal(38,0)"))).first()[0] or 0


def _evened(placed: DataFrame, own: DataFrame | None, n: int, shards: int, targets: dict[int, int]) -> DataFrame:
    """Moves the least attached documents of over-full shards into the others,
    until each shard has its target."""
    sizes = _sizes(placed, shards)
    over = {s: max(0, sizes[s] - targets[s]) for s in sizes}
    if not any(over.values()):
        return placed
    room = [(s, targets[s] - sizes[s]) for s in sizes if sizes[s] < targets[s]]
    p = placed if own is None else placed.join(own, F.col("node") == F.col("_n"), "left").drop("_n")
    p = p.select("node", "shard", (_level(F.coalesce("own", F.lit(0))) if own is not None else F.lit(0)).alias("own"))
    p = durable(p, "attached")
    # How many of each attachment leave: all below a cut, some at the cut.
    counts = {}
    for r in p.where(_number(over, F.col("shard")) > 0).groupBy("shard", "own").agg(F.count("*").alias("c")).collect():
        counts.setdefault(r.shard, {})[r.own] = r.c
    cut, some = {s: -1 for s in sizes}, {s: 0 for s in sizes}
    for s, by in counts.items():
        left = over[s]
        for a in sorted(by):
            cut[s], some[s] = a, min(left, by[a])
            left -= some[s]
            if not left:
                break
    c = _number(cut, F.col("shard"))
    below = p.where(F.col("own") < c).select("node", "shard")
    at = gapless_rank(p.where(F.col("own") == c).select("node", "shard"), ["shard"],
                      [F.xxhash64("node"), F.col("node")], "r")
    leave = below.unionByName(at.where(F.col("r") < _number(some, F.col("shard"))).drop("r"))
    leave = durable(leave, "leaving")
    seats = gapless_rank(leave.select("node"), [], [F.xxhash64("node"), F.col("node")], "r")
    to, upto = None, 0
    for s, free in room:
        upto += free
        to = F.when(F.col("r") < upto, s) if to is None else to.when(F.col("r") < upto, s)
    seats = durable(seats.select(F.col("node").alias("_n"), to.cast("int").alias("to")), "seats")
    return (placed.join(seats, F.col("node") == F.col("_n"), "left")
            .select("node", F.coalesce("to", "shard").alias("shard")))


def place(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int | None = None,
          slack: float = SLACK) -> DataFrame:
    """(node, shard) of every node of ``nodes`` (node), links being (node,
    group).  ``node`` must be unique.  ``rounds`` bounds the search, None does not."""
    n = nodes.count()
    targets = _targets(n, shards)
    capacity = max(1, n // shards)
    dealt = gapless_rank(nodes.select("node"), [], [F.xxhash64("node", F.lit(0)), F.col("node")], "r", rows=n)
    placed = durable(dealt.select("node", F.pmod("r", F.lit(shards)).cast("int").alias("shard")), "placed")
    sizes = links.groupBy("group").agg(F.count("*").alias("size")).where("size > 1")
    sizes = durable(sizes.select(F.col("group").alias("_g")), "groups")
    linked = durable(links.join(sizes, F.col("group") == F.col("_g"), "left_semi"), "links")
    best, kept, idle, turn = placed, _kept(placed, linked), 0, 0
    while idle < PATIENCE and (rounds is None or turn < rounds):
        turn += 1
        asks = durable(_asks(placed, linked, capacity), "asks")
        moves = (asks.join(placed, F.col("_n") == F.col("node")).where("to <> shard")
                 .select("node", "to"))
        moves = durable(moves, "moves")
        wanted = moves.count()
        if not wanted:
            break
        now = _sizes(placed, shards)
        quota = {s: max(1, int(targets[s] * (1 + slack)) + 1 - now[s]) for s in now}
        granted = gapless_rank(moves, ["to"], [F.xxhash64("node"), F.col("node")], "r", rows=wanted)
        granted = granted.where(F.col("r") < _number(quota, F.col("to"))).select(F.col("node").alias("_m"), "to")
        moved = (placed.join(granted, F.col("node") == F.col("_m"), "left")
                 .select("node", F.coalesce("to", "shard").alias("shard")))
        moved = durable(moved, "moved")
        own = _attached(moved, linked)
        placed = durable(_evened(moved, own, n, shards, targets), "placed")
        now_kept = _kept(placed, linked)
        if now_kept > kept:
            best, kept, idle = placed, now_kept, 0
        else:
            idle += 1
    return best


def _attached(placed: DataFrame, links: DataFrame) -> DataFrame:
    """(_n, own): the neighbours each linked node has in its shard."""
    at = durable(links.join(placed, "node").select("group", "node", "shard"), "linked")
    per = durable(at.groupBy("group", "shard").agg(F.count("*").alias("c")).where("c > 1")
                  .select(F.col("group").alias("_g"), F.col("shard").alias("_s"), "c"), "group-shards")
    return durable(at.join(per, (F.col("group") == F.col("_g")) & (F.col("shard") == F.col("_s")))
                   .groupBy("node").agg(F.sum(F.col("c") - 1).alias("own"))
                   .select(F.col("node").alias("_n"), "own"), "attached")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row
    of ``docs`` (doc_id, text); equal texts are linked."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = durable(docs.select(
        F.monotonically_increasing_id().alias("node"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("group")), "documents")
    placed = place(rows.select("node"), rows.select("node", "group"), shards, rounds)
    named = rows.join(placed.withColumnRenamed("node", "_p"), F.col("node") == F.col("_p"))
    slotted = gapless_rank(named.select("node", "doc_id", "size", "text_crc32", "shard"), ["shard"],
                           [F.col("doc_id"), F.col("node")], "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))
