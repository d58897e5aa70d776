"""Near-duplicate documents: bottom-k sketches from one hash function.

A document's set is its distinct five-word shingles (fewer words: the whole sequence). Documents with
100 * intersection >= 75 * union are linked; components of links are the groups.

1. Equal sets are one class, so copies never meet as pairs. A class is known by the number of one of its rows, never by
   a doc_id, so rows that share an id and not a text are different nodes.
2. Each class keeps the k smallest hashes of its set. Classes that share at most one of their 16 smallest with any other
   class leave here. (A linked pair shares 12 of 16 on average; it shares two or more but for one case in 10**8.)
3. Inverted lists of retained values: a class is listed under its rarest values only, so many that two classes which
   share at least ``needed(k)`` values meet in a list (prefix filtering; linked pairs share fewer in under one case in
   10**6). Values common to many documents (shared passages, lines) come last in that order and so list only classes
   made of little else.
4. Each list names one of its classes as hub, by one order for all lists; members in other components are compared with
   the hub. Rounds with new orders go on while that joins groups and many pairs across components are left.
   Then all pairs across components that still share a list are compared: those of short lists one by one, those of long
   lists in blocks of classes of like size, by exact intersections as matrix products. Only blocks that share a list, and
   whose sizes allow a link, meet; a block's sets travel once for each block that it meets. No list or group is capped.
5. Comparing: the estimate from the union's sketch rejects at 5.5 standard deviations; exact sets of 64-bit hashes decide.
   Sets are made again from the text, for listed classes only.

Null and empty texts have empty sets and are linked with nothing. Rows with a null id take no part (component null).
Rows that repeat an id are each placed by their own text; ``component_id`` is the smallest id of the group, and ``kept``
tells whether a row has it, so rows that repeat both id and text are all kept (one_of_each() keeps one row a group).
Extra columns stay out. Texts of any length: hashing sees 512 KB at a time; a set takes 8 bytes a distinct shingle.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, utf8
from .textops import shingle_sets

WORDS, K, PROBE, PERCENT = 5, 64, 16, 75
ROUNDS = 8
#: Members of a list whose pairs are made one by one; members of a block, and shingles that its sets hold together;
#: columns of a block's matrix.
SHORT, BLOCK, CELLS, COLUMNS = 32, 512, 1 << 22, 4096


def needed(k: int) -> int:
    """Values that the sketches of linked documents share, 5.2 standard deviations below the mean."""
    t = PERCENT / 100
    return max(1, math.floor(k * t - 5.2 * math.sqrt(k * t * (1 - t))))


def floor_estimate(k: int) -> float:
    t = PERCENT / 100
    return t - 5.5 * math.sqrt(t * (1 - t) / k)


ROW = "_row"


def numbered(df: DataFrame) -> DataFrame:
    """The rows with a number of their own, as a written table: numbers hold whoever reads it."""
    return materialize(df.withColumn(ROW, F.monotonically_increasing_id()))


def sketch(rows: DataFrame, k: int = K, words: int = WORDS, text: str = "text", id_col: str = "doc_id", sets: bool = False) -> DataFrame:
    """_row, doc_id, n_shingles, set_id, sketch (k smallest hashes, rising) and, with ``sets``, shingles (the whole set)."""

    def make():
        def f(batch):
            out = []
            for values in shingle_sets(utf8(batch.column(2)), words):
                digest = hashlib.blake2b(values, digest_size=16).digest() if len(values) else None
                out.append((len(values), digest, (values[:k] >> np.uint64(1)).astype(np.int64), *([values.tobytes()] if sets else [])))
            types = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], [ROW, "doc_id", "n_shingles", "set_id", "sketch", "shingles"][: 2 + len(made)])

        return f

    schema = f"{ROW} long, doc_id long, n_shingles long, set_id binary, sketch array<long>" + ", shingles binary" * sets
    return map_batches(rows.select(ROW, F.col(id_col).cast("long"), text), make, schema)


def listed(classes: DataFrame, k: int) -> DataFrame:
    """value, node, n: the inverted lists (a written table)."""
    # Classes that share two of their smallest values with others.
    probe = classes.select("node", F.explode(F.slice("sketch", 1, PROBE)).alias("value"), F.least(F.size("sketch"), F.lit(2)).alias("least"))
    shared = probe.groupBy("value").agg(F.count("*").alias("m")).where("m > 1").select("value")
    met = probe.join(shared, "value").groupBy("node").agg(F.count("*").alias("met"), F.first("least").alias("least")).where("met >= least").select("node")
    entries = materialize(classes.join(met, "node", "left_semi").select("node", "n", "sketch"))
    values = entries.select("node", "n", F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("m")).where("m > 1")
    own = F.when(100 * F.col("n") < PERCENT * (k + 1), F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).otherwise(F.least("n", F.lit(k)) - needed(k) + 1)
    # Values of one class only stand first in the order and list nothing.
    lists = (
        values.join(counts, "value").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("m", "value"))).alias("found"))
        .withColumn("lone", F.least("n", F.lit(k)) - F.size("found")).withColumn("take", F.greatest(own - F.col("lone"), F.lit(0)).cast("int"))
        .where("take > 0").select("node", "n", F.explode(F.slice("found", F.lit(1), F.col("take"))).alias("e"))
    )
    return materialize(lists.select(F.col("e.value").alias("value"), "node", "n"))


def near_sizes(a: str, b: str):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def verified(pairs: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) that are linked, as a written table. sets: node, n, sketch, shingles."""
    side = {x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"), F.col("shingles").alias(f"w_{x}")) for x in "ab"}
    both = F.array_intersect("s_a", "s_b")
    union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, k)
    likely = materialize(
        pairs.join(side["a"].drop("w_a"), "a").join(side["b"].drop("w_b"), "b")
        .where(F.size(F.array_intersect(both, union)) >= floor_estimate(k) * F.size(union)).select("a", "b")
    )

    def make():
        def f(batch):
            c = {x: batch.column(x).to_pylist() for x in batch.schema.names}
            keep = []
            for na, nb, wa, wb in zip(c["n_a"], c["n_b"], c["w_a"], c["w_b"], strict=True):
                common = len(np.intersect1d(np.frombuffer(wa, np.uint64), np.frombuffer(wb, np.uint64), assume_unique=True))
                keep.append(100 * common >= PERCENT * (na + nb - common))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return f

    full = likely.join(side["a"].drop("s_a"), "a").join(side["b"].drop("s_b"), "b")
    return materialize(map_batches(full, make, "a long, b long").select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable, for every node of an edge (a, b). Edges contract until none is left.
    The edges are read several times, so they come as written tables.

    A hash orders the nodes; every round each takes the first of its neighbours and itself as parent, twice over, and what
    has a common parent becomes one. Stars are done in two rounds, and of a chain, in whatever order its ids come, at most the
    nodes that come before both neighbours are left.
    """
    labels = None
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        either = edges.union(edges.select("b", "a")).toDF("node", "other")

        def ranked(name: str):
            return F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("up"))

        parent = materialize(either.groupBy("node").agg(F.min(ranked("other")).alias("x")).select("node", F.least("x", ranked("node"))["up"].alias("up")))
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = materialize(parent.join(above, "up").select("node", F.col("top").alias("comp")))
        if labels is None:
            labels = parent
        else:
            onward = parent.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            labels = materialize(labels.join(onward, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")))
        at = {x: parent.select(F.col("node").alias(x), F.col("comp").alias(f"c_{x}")) for x in "ab"}
        left = edges.join(at["a"], "a").join(at["b"], "b").where("c_a <> c_b")
        edges = materialize(left.select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    # Written, so that a large component's rows stand right behind a shuffle and the join may split them.
    least = materialize(labels.groupBy("comp").agg(F.min("node").alias("least")))
    return materialize(labels.join(least, "comp").select("node", F.col("least").alias("comp")))


def link_rounds(lists: DataFrame, sets: DataFrame, k: int, rounds: int) -> DataFrame | None:
    """node, comp for every class that is linked with another; None if none is."""
    size, before = lists.count(), math.inf
    edges, labels = None, None
    for turn in range(rounds + 1):
        placed = lists.withColumn("comp", F.col("node"))
        if labels is not None:
            placed = materialize(lists.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        # Per list: members, and pairs of members in different components.
        across = placed.groupBy("value", "comp").agg(F.count("*").alias("m")).groupBy("value").agg(F.sum("m").alias("members"), ((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("pairs")).where("pairs > 0")
        left = across.agg(F.sum("pairs")).first()[0] or 0
        if not left:
            break
        last = turn == rounds or (turn > 0 and (left <= 2 * size or left > 0.8 * before))
        before = left
        other = placed.select("value", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"))
        if last:
            found = rest(placed, materialize(across), other, sets, k)
        else:
            hubs = other.groupBy("value").agg(F.min(F.struct(F.xxhash64("hub", F.lit(turn)).alias("h"), "hub", "hub_n", "hub_comp")).alias("x")).select("value", "x.*")
            met = placed.join(hubs, "value").where((F.col("comp") != F.col("hub_comp")) & near_sizes("n", "hub_n"))
            found = verified(distinct_pairs(met), sets, k)
        if not found.isEmpty():
            edges = found if edges is None else edges.union(found)
            labels = components(edges)
        if last:
            break
    return labels


def distinct_pairs(met: DataFrame) -> DataFrame:
    return materialize(met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())


def rest(placed: DataFrame, across: DataFrame, other: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """Links (a, b) among the pairs in different components that still share a list, of which none is left out.

    Short lists give their pairs. Members of long lists would meet in list after list, so there blocks of classes meet,
    each two blocks once. A class is in a block of the longest list that it is under, with classes of like size: members of
    one large component, or whole small components by a hash.
    """
    short = placed.join(across.where(F.col("members") <= SHORT).select("value"), "value")
    met = short.join(other, "value").where((F.col("node") < F.col("hub")) & (F.col("comp") != F.col("hub_comp")) & near_sizes("n", "hub_n"))
    found = verified(distinct_pairs(met), sets, k)
    long = materialize(placed.join(across.where(F.col("members") > SHORT).select("value", "members"), "value"))
    if long.isEmpty():
        return found
    # Sizes in steps of 4/3: a link's classes are in one step or in neighbouring ones.
    step = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / PERCENT))).cast("int")
    members = long.groupBy("node", "comp", "n").agg(F.max(F.struct("members", "value")).alias("x")).select("node", "comp", step.alias("step"), F.col("x.value").alias("home"))
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(CELLS) / F.pow(F.lit(100 / PERCENT), F.col("step") + 1))))
    sizes = members.groupBy("step", "home", "comp").agg(F.count("*").alias("m"))
    large = sizes.where(F.col("m") >= most).withColumn("part", F.col("comp"))
    small = sizes.where(F.col("m") < most).groupBy("step", "home").agg(F.sum("m").alias("small"))
    blocked = materialize(
        members.join(large, ["step", "home", "comp"], "left").join(small, ["step", "home"], "left").select(
            "node", "comp", "step", "home", F.coalesce("part", F.lit(-1)).alias("part"),
            F.when(F.col("part").isNotNull(), F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / most)))
            .otherwise(F.pmod(F.xxhash64("comp"), F.ceil(F.col("small") / most))).alias("block"),
        ).select("node", "comp", F.struct("step", "home", "part", "block").alias("seat"))
    )
    # Two blocks meet if a list has both: once a list and block, then once a pair of blocks.
    seated = materialize(long.select("value", "node").join(blocked.select("node", "seat"), "node").select("value", "seat").distinct())
    mine, theirs = seated.withColumnRenamed("seat", "mine"), seated.withColumnRenamed("seat", "theirs")
    near = "mine <= theirs AND theirs.step - mine.step <= 1 AND (mine.part <> theirs.part OR mine.part = -1)"
    meeting = materialize(mine.join(theirs, "value").where(near).select("mine", "theirs").distinct())
    sides = meeting.select("mine", "theirs", F.lit(0).alias("side"), F.col("mine").alias("seat")).unionAll(meeting.where("mine <> theirs").select("mine", "theirs", F.lit(1), "theirs"))
    contents = blocked.join(sets.select("node", "n", "shingles"), "node")
    more = contents.join(sides, "seat").select("mine", "theirs", "side", "node", "comp", "n", "shingles").groupBy("mine", "theirs").applyInArrow(meet, "a long, b long")
    return materialize(found.union(more))


def meet(table: pa.Table) -> pa.Table:
    """Links between two blocks (or within one), by exact sizes of intersections; only those that join something new."""
    side = table.column("side").to_numpy()
    sides = []
    for s in (0, 1) if side.any() else (0,):
        t = table.filter(pa.array(side == s))
        parts = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        sides.append((t.column("node").to_numpy(), t.column("comp").to_numpy(), t.column("n").to_numpy(), row, np.concatenate(parts)))
    one, two = sides[0], sides[-1]
    common = np.intersect1d(one[4], two[4])
    total = np.zeros((len(one[0]), len(two[0])), np.float32)
    for at in range(0, len(common), COLUMNS):
        part = common[at : at + COLUMNS]
        cells = []
        for x in (one, two) if len(sides) > 1 else (one,):
            place = np.minimum(np.searchsorted(part, x[4]), len(part) - 1)
            has = part[place] == x[4]
            m = np.zeros((len(x[0]), len(part)), np.float32)
            m[x[3][has], place[has]] = 1
            cells.append(m)
        total += cells[0] @ cells[-1].T
    ok = (100 * total >= PERCENT * (one[2][:, None] + two[2][None, :] - total)) & (one[1][:, None] != two[1][None, :])
    group: dict[int, int] = {}

    def root(x: int) -> int:
        while group.setdefault(x, x) != x:
            group[x] = x = group[group[x]]
        return x

    links = []
    for i, j in np.argwhere(ok).tolist():
        a, b = root(int(one[1][i])), root(int(two[1][j]))
        if a != b:
            group[a] = b
            links.append(sorted((int(one[0][i]), int(two[0][j]))))
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def placed_rows(rows: DataFrame, k: int = K, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """_row, doc_id, n_shingles, comp (a number of the group, null for rows that take no part) for numbered() rows."""
    told = materialize(sketch(rows, k, WORDS, text, id_col))
    whole = told.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # One row a class; a class's members have the same sketch.
    classes = materialize(whole.groupBy("set_id").agg(F.min(ROW).alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    lists = listed(classes, k)
    # Whole sets of the classes in lists only, from the text of one row each.
    wanted = rows.join(lists.select(F.col("node").alias(ROW)).distinct(), ROW, "left_semi")
    sets = materialize(sketch(wanted, k, WORDS, text, id_col, True).select(F.col(ROW).alias("node"), F.col("n_shingles").alias("n"), "sketch", "shingles"))
    labels = link_rounds(lists, sets, k, ROUNDS)
    discard(sets)
    named = classes.select("set_id", F.col("node").alias("comp")) if labels is None else classes.select("set_id", "node").join(labels, "node", "left").select("set_id", F.coalesce("comp", "node").alias("comp"))
    out = told.select(ROW, "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    return out.join(named, "set_id", "left").select(ROW, "doc_id", "n_shingles", "comp")


def near_duplicates(df: DataFrame, k: int = K, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    placed = materialize(placed_rows(numbered(df.select(id_col, text)), k, text, id_col))
    least = materialize(placed.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least")))
    component = F.coalesce("least", "doc_id")
    return placed.join(least, "comp", "left").select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def one_of_each(df: DataFrame, k: int = K, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Of each group one row: that with the smallest id, of several such rows one. Rows outside groups stay, all columns too."""
    rows = numbered(df)
    placed = materialize(placed_rows(rows, k, text, id_col).where("comp IS NOT NULL"))
    first = materialize(placed.groupBy("comp").agg(F.min(F.struct("doc_id", ROW)).alias("first")))
    dropped = placed.join(first, "comp").where(F.col(ROW) != F.col("first")[ROW]).select(ROW)
    return rows.join(dropped, ROW, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
