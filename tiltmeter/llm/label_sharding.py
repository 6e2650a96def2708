"""Sharding by balanced label propagation.

Documents start in a shard drawn from a hash of their id. In each round, every linked document looks
at the shards of its neighbours and, if most of them are elsewhere, asks to move there. Requests from
shard i to shard j are granted as far as they are matched by requests from j to i, plus what fits into
the free room of j; the capacity of a shard is its share of all rows, and only linked rows count, since
the others can still make way. Requests are taken in the order of a hash, by counts over
buckets of it, so a round is a few joins and sums. Hubs take part in even rounds only, so that a
document and its hub don't swap places.

After the rounds, rows are moved from shards over their share to shards below it, unlinked rows
first, until the law ``rows`` holds exactly: row counts of any two shards differ by at most one.
Slots number the rows of a shard without gaps; ranks come from counts over buckets, so no shard is
ever sorted in one task.

Defined results: null texts and null ids are in no group; equal texts (empty ones too) are; a group
larger than a shard is split; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.llm.shared import stored

ROUNDS, STEPS, BUCKET_ROWS = 8, 64, 1000


def draw(seed: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40))


def equal_text_links(rows: DataFrame) -> DataFrame:
    """Links ``(a, b)`` from the least id of each set of equal texts to its other ids; ``rows(id, text_key)``."""
    known = rows.where("id is not null and text_key is not null").select("id", "text_key").distinct()
    hubs = known.groupBy("text_key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    return known.join(hubs.select("text_key", "a"), "text_key").where("id <> a").select("a", F.col("id").alias("b"))


def propagate(nodes: DataFrame, links: DataFrame, shards: int, room: int, seed: int) -> DataFrame:
    """Shards of the linked ``nodes(id, rows)`` after the rounds, as ``(id, shard)``; none gets more than ``room`` of their rows."""
    ways = stored(
        links.select(F.col("a").alias("id"), F.col("b").alias("other"), F.lit(True).alias("hub")).unionByName(
            links.select(F.col("b").alias("id"), F.col("a").alias("other"), F.lit(False).alias("hub"))
        ),
        "shard-ways",
    )
    spark = nodes.sparkSession
    state = stored(nodes.withColumn("shard", (draw(seed, F.col("id").cast("long")) % shards).cast("int")), "shard-state")
    sizes = dict.fromkeys(range(shards), 0) | {r[0]: r[1] for r in state.groupBy("shard").agg(F.sum("rows")).collect()}
    quiet = 0  # rounds in a row without requests: one of hubs says nothing about their documents
    for turn in range(ROUNDS):
        around = (
            ways.where("hub" if turn % 2 == 0 else "not hub")
            .join(state.select(F.col("id").alias("other"), F.col("shard").alias("there")), "other")
            .groupBy("id", "there")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        best = around.groupBy("id").agg(
            F.max(F.struct("n", draw(seed + 1, F.col("there")).alias("tie"), "there")).alias("top")
        )
        asked = (
            state.join(best.select("id", F.col("top.there").alias("to"), F.col("top.n").alias("n")), "id")
            .join(around.select("id", F.col("there").alias("shard"), F.col("n").alias("here")), ["id", "shard"], "left")
            .where((F.col("to") != F.col("shard")) & (F.col("n") > F.coalesce("here", F.lit(0))))
            .withColumn("step", (draw(seed + 2 + turn, F.col("id")) % STEPS).cast("int"))
        )
        asked = stored(asked.select("id", "rows", "shard", "to", "step"), "shard-asked")
        counts = asked.groupBy("shard", "to", "step").agg(F.sum("rows").alias("rows")).collect()  # a fixed bound of cells
        quiet = 0 if counts else quiet + 1
        if quiet == 2:
            break
        if not counts:
            continue
        limits, sizes = granted([tuple(r) for r in counts], sizes, room)
        grants = spark.createDataFrame([(i, j, k) for (i, j), k in sorted(limits.items())], "shard int, to int, upto int")
        moves = asked.join(F.broadcast(grants), ["shard", "to"]).where("step <= upto").select("id", "to")
        state = stored(
            state.join(moves, "id", "left").select("id", "rows", F.coalesce("to", "shard").alias("shard")), "shard-state"
        )
    return state


def granted(
    counts: list[tuple[int, int, int, int]], sizes: dict[int, int], room: int
) -> tuple[dict[tuple[int, int], int], dict[int, int]]:
    """Up to which hash step each (from, to) may move, and the sizes afterwards, for (from, to, step, rows)."""
    wish: dict[tuple[int, int], int] = {}
    for i, j, _, n in counts:
        wish[i, j] = wish.get((i, j), 0) + n
    quota = {(i, j): min(n, wish.get((j, i), 0)) for (i, j), n in wish.items()}
    after = dict(sizes)
    for (i, j), n in sorted(wish.items()):  # what no request matches goes where there is room
        more = max(0, min(n - quota[i, j], room - after[j]))
        quota[i, j] += more
        after[j] += more
        after[i] -= more
    limits, spent, closed = {pair: -1 for pair in wish}, dict.fromkeys(wish, 0), set()
    for i, j, step, n in sorted(counts, key=lambda c: c[2]):
        if (i, j) not in closed and spent[i, j] + n <= quota[i, j]:
            spent[i, j] += n
            limits[i, j] = step
        else:
            closed.add((i, j))
    after = dict(sizes)
    for (i, j), n in spent.items():
        after[i] -= n
        after[j] += n
    return limits, after


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, links: DataFrame | None = None,
    seed: int = 5,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``shard``, ``slot`` under the law ``rows``.

    ``links(a, b)`` are pairs of ids that should lie together; without them, equal texts are linked.
    """
    text = F.col(text_col)
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
            F.sha2(text, 256).alias("text_key"),
        ),
        "shard-rows",
    )
    start = (draw(seed, F.coalesce(F.col("id").cast("long"), F.col("crc"))) % shards).cast("int")
    total = rows.count()
    links = stored((equal_text_links(rows) if links is None else links).select("a", "b"), "shard-links")
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    nodes = rows.join(ends, "id").groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    state = propagate(nodes, links, shards, total // shards, seed)

    buckets = max(1, -(-total // (BUCKET_ROWS * shards)))
    placed = stored(
        rows.join(state.select("id", F.col("shard").alias("moved")), "id", "left").select(
            "id", "size", "crc",
            F.coalesce("moved", start).alias("home"),
            F.col("moved").isNotNull().cast("int").alias("linked"),
            (draw(seed + 1, F.col("id"), F.col("crc")) % buckets).cast("int").alias("bucket"),
        ),
        "shard-placed",
    )
    cells = placed.groupBy("home", "linked", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("home").orderBy("linked", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("home", "linked", "bucket").orderBy("id", "crc", "size")
    ranked = placed.withColumn("i", F.row_number().over(inside)).join(cells, ["home", "linked", "bucket"]).withColumn(
        "rank", F.col("offset") + F.col("i") - 1
    )

    have = dict.fromkeys(range(shards), 0) | {r[0]: r[1] for r in placed.groupBy("home").count().collect()}
    due = {s: total // shards + (s < total % shards) for s in range(shards)}
    out = {s: max(0, have[s] - due[s]) for s in range(shards)}
    shard, slot = F.col("home"), F.col("rank") - _of(F.col("home"), out)
    moving = F.col("rank") < _of(F.col("home"), out)
    at = F.col("rank") + _of(F.col("home"), _starts(out))
    new_shard, new_slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in range(shards):
        given = sum(max(0, due[t] - have[t]) for t in range(s))
        if have[s] < due[s]:
            here = (at >= given) & (at < given + due[s] - have[s])
            new_slot = F.when(here, at - given + have[s]).otherwise(new_slot)
            new_shard = F.when(here, F.lit(s)).otherwise(new_shard)
    return ranked.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"),
        F.when(moving, new_shard).otherwise(shard).cast("int").alias("shard"),
        F.when(moving, new_slot).otherwise(slot).cast("long").alias("slot"),
    )


def _of(key: Column, values: dict[int, int]) -> Column:
    """A fixed small table as a column."""
    out = F.lit(0).cast("long")
    for k, v in values.items():
        out = F.when(key == k, F.lit(v).cast("long")).otherwise(out)
    return out


def _starts(sizes: dict[int, int]) -> dict[int, int]:
    """Running sums before each key."""
    starts, at = {}, 0
    for k in sorted(sizes):
        starts[k] = at
        at += sizes[k]
    return starts
