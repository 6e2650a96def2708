"""A Merkle manifest of a dataset: a root over all rows, and a proof for each of them.

Every row is a leaf. The leaves of a source, in the order of their ids, form a tree in which each run of ``arity``
consecutive nodes becomes their hash; the roots of the sources, in the order of the sources, form a tree of the same kind.

The trees are built as a sparse forest. A fragment holds nodes keyed by (tree, level, index) that wait for siblings; to merge
fragments is to put their nodes together and to replace each run that is complete (its length follows from the tree's size)
by its parent. This is associative, and what a contiguous stretch of leaves leaves over are a few nodes for each level at its
two ends. So: leaves are dealt to contiguous parts; each part reduces its own; fragments are reduced ``FAN`` neighbours at a time
until one is left, which holds the root alone. Then the way back: what stands above a waiting node is handed down the same
groups, and each part completes the proofs of its leaves. No task sees more than a part of leaves or ``FAN`` fragments, and
the driver sees counts only.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.llm.shared import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Fragments that one task merges.
FAN = 32
#: Leaves that a part holds at most, about: a part is one pandas frame.
PART_LEAVES = 20_000
#: The tree over the sources' roots.
TOP = -1

Key = tuple[int, int, int]


def leaf_hash(*values: Column) -> Column:
    """Hash of values, each with its length in bytes before it, a null as a dash: no two rows run into each other."""
    shown = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*[shown(v.cast("string")) for v in values]), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def proof_text(steps: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def verified(leaf: Column, steps: Column, root: Column) -> Column:
    return fold(leaf, steps) == root


def height(size: int, arity: int) -> int:
    levels = 0
    while size > 1:
        size, levels = -(-size // arity), levels + 1
    return levels


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Fragment:
    """Nodes that wait for siblings, and how those that have found theirs are tied to their parents."""

    def __init__(self, sizes: dict[int, int], arity: int):
        self.sizes, self.arity = sizes, arity
        self.waiting: dict[Key, str] = {}
        self.above: dict[Key, tuple[Key, str, str]] = {}

    def add(self, nodes: dict[Key, str]) -> None:
        """Put ``nodes`` in and merge every run that is complete, level by level; a tree's root becomes a leaf of the top tree."""
        lower: dict[int, dict[Key, str]] = defaultdict(dict)
        upper: dict[int, dict[Key, str]] = defaultdict(dict)
        for key, digest in nodes.items():
            (upper if key[0] == TOP else lower)[key[1]][key] = digest
        self._rise(lower, upper)
        self._rise(upper, upper)

    def _rise(self, levels: dict[int, dict[Key, str]], upper: dict[int, dict[Key, str]]) -> None:
        level = min(levels, default=0)
        while level <= max(levels, default=-1):
            runs: dict[tuple[int, int], list[Key]] = defaultdict(list)
            for key in levels.get(level, ()):
                runs[key[0], key[2] // self.arity].append(key)
            for (tree, run), keys in runs.items():
                width = -(-self.sizes[tree] // self.arity**level)
                if width == 1:
                    digest = levels[level][keys[0]]
                    if tree == TOP:
                        self.waiting[keys[0]] = digest
                    else:
                        upper[0][TOP, 0, tree] = digest
                        self.above[keys[0]] = ((TOP, 0, tree), "", "")
                elif len(keys) == min(self.arity, width - run * self.arity):
                    keys.sort()
                    own = [levels[level][k] for k in keys]
                    parent = (tree, level + 1, run)
                    levels.setdefault(level + 1, {})[parent] = _hash("".join(own))
                    for i, k in enumerate(keys):
                        self.above[k] = (parent, "".join(own[:i]), "".join(own[i + 1 :]))
                else:
                    self.waiting.update((k, levels[level][k]) for k in keys)
            level += 1

    def steps(self, key: Key, handed: dict[Key, str], known: dict[Key, str]) -> str:
        """The way from a node to the root as ``left|right`` of each level; ``handed`` has it for nodes that wait here."""
        path = []
        while key not in known and key in self.above:
            path.append(key)
            key = self.above[key][0]
        found = known[key] if key in known else handed[key]
        for k in reversed(path):
            parent, left, right = self.above[k]
            # A source's root is itself the leaf of the top tree: no step lies between them.
            own = [] if parent[0] == TOP and k[0] != TOP else [f"{left}|{right}"]
            found = known[k] = ",".join([*own, *([found] if found else [])])
        return found


def _nodes(frame: pd.DataFrame) -> dict[Key, str]:
    return dict(zip(zip(frame["tree"].tolist(), frame["level"].tolist(), frame["at"].tolist(), strict=True), frame["digest"], strict=True))


def _sizes(frame: pd.DataFrame) -> dict[int, int]:
    return {TOP: int(frame["trees"].iloc[0])} | dict(zip(frame["tree"].tolist(), frame["size"].tolist(), strict=True))


_NODE = "part long, tree long, level int, at long, digest string, size long, trees long"
_WAY = "part long, tree long, level int, at long, digest string, size long, trees long, steps string"


def _rows(part: int, nodes: dict[Key, str], sizes: dict[int, int], **more) -> pd.DataFrame:
    keys = list(nodes)
    return pd.DataFrame(
        {
            "part": part, "tree": [k[0] for k in keys], "level": [k[1] for k in keys], "at": [k[2] for k in keys],
            "digest": [nodes[k] for k in keys], "size": [sizes[k[0]] for k in keys], "trees": sizes[TOP],
        }
        | {name: list(values) for name, values in more.items()}
    ).astype({"tree": "int64", "level": "int32", "at": "int64", "size": "int64"})


def _leaves(docs: DataFrame, carry: str | None) -> DataFrame:
    """Leaves in contiguous parts of the order (source, id), stored; ``line`` is the place in a part."""
    carried = F.col(carry).cast("string") if carry else F.lit(None).cast("string")
    made = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), leaf_hash(*[F.col(c) for c in FIELDS]).alias("leaf"), carried.alias("carried")
    )
    # Equal rows are leaves too, and may be very many: the last key deals them apart.
    order = ["source", "doc_id", "leaf", "tie"]
    count = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = made.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(int(count), *order).sortWithinPartitions(*order)
    # Ids go as text: a pandas column of integers with nulls would round them.
    named = dealt.select(F.col("doc_id").cast("string").alias("id"), "source", "leaf", "carried", F.monotonically_increasing_id().alias("place"))
    line = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    kept = stored(named, "merkle-leaves").withColumn("line", line)
    return kept.select("id", "source", "leaf", "carried", F.shiftright("place", 33).alias("file"), F.floor(line / PART_LEAVES).alias("piece"), "line")


def _placed(leaves: DataFrame) -> DataFrame:
    """Each stretch of one source in one part, with the place of its first leaf and the sizes of the trees.

    Sources and parts have the same order, so the number of a source is found from counts by part and never by sorting all
    sources in one task; only one line for each part is.
    """
    runs = stored(
        leaves.groupBy("file", "piece", "source").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first")), "merkle-runs"
    )
    parts = runs.groupBy("file", "piece").agg(F.lit(1).alias("one"))
    parts = stored(parts.withColumn("part", F.row_number().over(Window.orderBy("file", "piece")).cast("long") - 1).drop("one"), "merkle-parts")
    numbered = runs.join(parts, ["file", "piece"])
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    by_source = Window.partitionBy("name").orderBy("part")
    numbered = numbered.withColumn("name", name).withColumn("ahead", F.sum("n").over(by_source) - F.col("n"))
    numbered = numbered.withColumn("begins", F.row_number().over(by_source) == 1).withColumn("size", F.sum("n").over(Window.partitionBy("name")))
    numbered = stored(numbered, "merkle-stretches")
    begun = numbered.where("begins").groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    before = parts.select("part").join(begun, "part", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    before = before.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
    tree = numbered.where("begins").withColumn("within", within).join(before, "part")
    tree = tree.select("name", (F.col("before") + F.col("within")).alias("tree"))
    rows = numbered.join(tree, "name").withColumn("trees", F.lit(numbered.where("begins").count()).cast("long"))
    return stored(rows.select("file", "piece", "part", "source", "ahead", "first", "tree", "size", "trees"), "merkle-placed")


def _part_nodes(leaves: pd.DataFrame, runs: pd.DataFrame) -> tuple[dict[Key, str], dict[int, int], list[Key]]:
    """Leaves as nodes, in the order of lines."""
    sizes = {TOP: int(runs["trees"].iloc[0])} | dict(zip(runs["tree"].tolist(), runs["size"].tolist(), strict=True))
    starts = runs.sort_values("first")
    own = leaves.sort_values("line")
    lines = own["line"].to_numpy()
    at = starts["first"].to_numpy().searchsorted(lines, side="right") - 1
    tree, ahead, first = (starts[c].to_numpy().astype("int64")[at] for c in ("tree", "ahead", "first"))
    index = ahead + lines - first
    keys = list(zip(tree.tolist(), [0] * len(lines), index.tolist(), strict=True))
    return dict(zip(keys, own["leaf"], strict=True)), sizes, keys


def manifest(docs: DataFrame, arity: int = ARITY, carry: str | None = None) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, steps`` of every row, and ``carried``, the text of the column ``carry``.

    ``steps`` is the proof, from the leaf over its source's root to the root: in each step ``left`` and ``right`` are the
    siblings' digests on either side, joined. Null ids come first in their source and a null source is the first source;
    rows with the same id are ordered by their leaves, and equal rows are leaves each. A node without siblings is hashed
    alone. An empty table has no rows; other columns are not read.
    """
    leaves = _leaves(docs, carry)
    runs = _placed(leaves)
    keyed = leaves.groupBy("file", "piece")

    def up(key: tuple, own: pd.DataFrame, stretches: pd.DataFrame) -> pd.DataFrame:
        nodes, sizes, _ = _part_nodes(own, stretches)
        made = Fragment(sizes, arity)
        made.add(nodes)
        return _rows(int(stretches["part"].iloc[0]), made.waiting, sizes)

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        sizes = _sizes(frame)
        made = Fragment(sizes, arity)
        made.add(_nodes(frame))
        return _rows(int(key[0]), made.waiting, sizes)

    def spread(key: tuple, frame: pd.DataFrame, handed: pd.DataFrame) -> pd.DataFrame:
        """The ways of the nodes that went into a merge, from those of the nodes that came out of it."""
        sizes = _sizes(frame)
        made = Fragment(sizes, arity)
        made.add(_nodes(frame))
        above, known = dict(zip(_nodes(handed), handed["steps"], strict=True)), {}
        out = []
        for part, rows in frame.groupby("part"):
            own = _nodes(rows)
            out.append(_rows(int(part), own, sizes, steps=[made.steps(k, above, known) for k in own]))
        return pd.concat(out)

    fragments = [stored(keyed.cogroup(runs.groupBy("file", "piece")).applyInPandas(up, _NODE), "merkle-nodes")]
    group = F.floor(F.col("part") / FAN)
    while fragments[-1].where("part > 0").limit(1).count():
        fragments.append(stored(fragments[-1].groupBy(group.alias("group")).applyInPandas(merge, _NODE), "merkle-nodes"))
    # One fragment is left: the root waits for nothing, and nothing stands above it.
    ways = fragments[-1].withColumn("steps", F.lit(""))
    for below in reversed(fragments[:-1]):
        ways = stored(below.groupBy(group.alias("group")).cogroup(ways.groupBy(F.col("part").alias("group"))).applyInPandas(spread, _WAY), "merkle-ways")

    def down(key: tuple, own: pd.DataFrame, context: pd.DataFrame) -> pd.DataFrame:
        handed = context[context["digest"].notna()]
        nodes, sizes, keys = _part_nodes(own, context[context["digest"].isna()])
        made = Fragment(sizes, arity)
        made.add(nodes)
        above, known = dict(zip(_nodes(handed), handed["steps"], strict=True)), {}
        own = own.sort_values("line")
        way = [made.steps(k, above, known) for k in keys]
        ends: dict[int, tuple[str, str]] = {}
        for k, w, leaf in zip(keys, way, own["leaf"], strict=True):
            if k[0] not in ends:  # the leaves of a source share its root
                at, roots, rise = leaf, [leaf], w.split(",") if w else []
                for step in rise:
                    left, right = step.split("|")
                    at = _hash(left + at + right)
                    roots.append(at)
                ends[k[0]] = roots[height(sizes[k[0]], arity)], at
        return pd.DataFrame(
            {
                "id": own["id"].to_numpy(), "source": own["source"].to_numpy(), "leaf": own["leaf"].to_numpy(),
                "carried": own["carried"].to_numpy(), "subroot": [ends[k[0]][0] for k in keys], "root": [ends[k[0]][1] for k in keys], "way": way,
            }
        )

    ways = ways.join(runs.select("part", "file", "piece").distinct(), "part").select(
        "file", "piece", "part", "tree", "level", "at", "digest", "size", "trees", "steps", *[F.lit(None).cast("long").alias(c) for c in ("ahead", "first")],
    )
    context = ways.unionByName(
        runs.select(
            "file", "piece", "part", "tree", "size", "trees", "ahead", "first", F.lit(0).alias("level"), F.lit(None).cast("long").alias("at"),
            F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("steps"),
        )
    )
    shape = "id string, source string, leaf string, carried string, subroot string, root string, way string"
    found = keyed.cogroup(context.groupBy("file", "piece")).applyInPandas(down, shape)
    pair = lambda s: F.struct(F.split_part(s, F.lit("|"), F.lit(1)).alias("left"), F.split_part(s, F.lit("|"), F.lit(2)).alias("right"))
    steps = F.when(F.col("way") == "", F.array().cast("array<struct<left:string,right:string>>")).otherwise(F.transform(F.split("way", ","), pair))
    doc_id = F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return found.select(doc_id, "source", "leaf", "carried", "subroot", "root", steps.alias("steps"))
