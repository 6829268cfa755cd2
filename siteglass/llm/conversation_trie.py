"""Prefix trie of conversations in balanced parentheses.

Conversations that begin with the same turns share the nodes of these turns. The trie is
never built in one place:

* A prefix is named by its depth and the exclusive or of hashes of its turns with their
  places, so that all prefixes come from one scan of the turns and texts are not moved.
* Grouping prefixes gives the nodes. A chain of nodes with one child each, where no
  conversation ends, hangs below the *stop* that ends it: only stops (the root, branches and
  ends) enter the tree, and chains take their figures from the stop below.
* Conversations are range-sorted by their choices at branches, so those through a node are
  neighbours. Each partition is a shard, and writes its part of the trie as balanced
  parentheses. Range min-max blocks over the excess find the closing parenthesis that delimits
  a subtree, a rank over leaf pairs counts its leaves, cumulative sums give its savings.
* A node on the spine between shards occurs in each of them. Its leaf or saving is entered
  only in the first, and its figures from all shards are added up.

No group is held as a whole: long conversations are numbered and summed in stretches, ids of
equal conversations are first joined by ranges of ids and hashed as they stream by. (The
digest itself is sequential by definition.)

Odd rows: turns are ordered by turn (null first), then role, then the text's sha256; null role
or text is empty, a null conv_id takes no part, repeated turns are turns. An empty table gives
no rows, else there is at least the root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .merkle import numbered
from .storage import discard, stored

FAMILY = 5
HEAD = 9
#: Turns of a conversation summed up in one go, ids joined in one go: 2 to the power of this.
STRETCH_BITS = 12
#: Conversations in a shard of the trie, at most about.
SHARD = 100_000
#: Parentheses in a block of the range min-max tree.
BLOCK = 64

KEY = ["depth", "ka", "kb"]


def _turn_hashes(turns: DataFrame) -> DataFrame:
    """conv, pos (from 1), ta, tb (hashes of role and text), bytes, n_own of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        F.sha2(text, 256).alias("sha"),
        F.xxhash64(F.lit(1), role, text).alias("ta"),
        F.xxhash64(F.lit(2), text, role).alias("tb"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    places = numbered(slim, F.col("conv").cast("string"), ["turn", "role", "sha"])
    return places.select(
        "conv", (F.col("pos") + 1).alias("pos"), "ta", "tb", "bytes", F.col("n").alias("n_own")
    )


def rebuilt(turns: DataFrame, family: int = FAMILY, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt upon others of their family, and their turns.

    Conversation ``c`` begins with the first ``crc32(c) % head`` turns of ``c - c % family``
    and goes on with its own turns after as many. Returns (conv, length) and
    (conv, pos, ta, tb, bytes).
    """
    own = stored(_turn_hashes(turns), "turns")
    base = F.col("conv") - F.col("conv") % family
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % head
    convs = own.where("pos = 1").select("conv", "n_own", base.alias("base"), h.alias("h"))
    # The first turns of a base: at most ``head`` rows each.
    heads = own.where((F.col("pos") < head) & (F.col("conv") == base))
    heads = heads.select(F.col("conv").alias("base"), "pos", "ta", "tb", "bytes")
    first = convs.join(heads, "base").where("pos <= h").select("conv", "pos", "ta", "tb", "bytes")
    lengths = convs.join(
        convs.select(F.col("conv").alias("base"), F.col("n_own").alias("n_base")), "base", "left"
    ).select(
        "conv", "h",
        F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"),
        F.greatest(F.col("n_own") - F.col("h"), F.lit(0)).alias("rest"),
    )
    rest = own.join(lengths, "conv").where("pos > h")
    rest = rest.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "ta", "tb", "bytes")
    conversations = lengths.select("conv", (F.col("taken") + F.col("rest")).alias("length"))
    return conversations, first.unionByName(rest)


def _prefixes(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """conv, length, depth, ka, kb, ha, hb, bytes: each prefix and its last turn.

    Exclusive ors run along stretches of a conversation and over the stretches before.
    """
    hashed = turns.join(conversations, "conv").select(
        "conv", "length", F.col("pos").alias("depth"), "bytes",
        F.xxhash64("pos", "ta").alias("ha"), F.xxhash64("pos", "tb").alias("hb"),
        F.shiftright("pos", STRETCH_BITS).alias("stretch"),
    )
    along = Window.partitionBy("conv", "stretch").orderBy("depth")
    inside = hashed.withColumns({"ka": F.bit_xor("ha").over(along), "kb": F.bit_xor("hb").over(along)})
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    # Shorter conversations have one stretch and need no sum.
    totals = (
        hashed.where(F.col("length") >= 1 << STRETCH_BITS)
        .groupBy("conv", "stretch")
        .agg(F.bit_xor("ha").alias("a"), F.bit_xor("hb").alias("b"))
        .select("conv", "stretch", F.bit_xor("a").over(before).alias("a"), F.bit_xor("b").over(before).alias("b"))
    )
    joined = inside.join(totals, ["conv", "stretch"], "left")
    return joined.select(
        "conv", "length", "depth", "bytes", "ha", "hb",
        F.col("ka").bitwiseXOR(F.coalesce("a", F.lit(0))).alias("ka"),
        F.col("kb").bitwiseXOR(F.coalesce("b", F.lit(0))).alias("kb"),
    )


def _root(conversations: DataFrame) -> DataFrame:
    """Every conversation as member of the root."""
    zero = F.lit(0).cast("long")
    return conversations.select(
        "conv", "length", *[zero.alias(c) for c in ("depth", "bytes", "ha", "hb", "ka", "kb")]
    )


def _nodes(members: DataFrame) -> DataFrame:
    """One row per node: conv (smallest member), n_convs, n_ends, n_children, parent_conv, ..."""
    ends = F.count_if(F.col("length") == F.col("depth"))
    found = members.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), ends.alias("n_ends"),
        F.first("bytes").alias("bytes"), F.first("ha").alias("ha"), F.first("hb").alias("hb"),
    )
    found = stored(found, "nodes")
    parent = [
        (F.col("depth") - 1).alias("depth"),
        F.col("ka").bitwiseXOR(F.col("ha")).alias("ka"),
        F.col("kb").bitwiseXOR(F.col("hb")).alias("kb"),
    ]
    children = found.where("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    counted = found.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = stored(counted, "nodes")
    above = counted.where("n_children > 0").select(
        *[F.col(k).alias(f"p_{k}") for k in KEY],
        F.col("conv").alias("parent_conv"), (F.col("n_children") > 1).alias("chosen"),
    )
    up = counted.withColumns({f"p_{k}": c for k, c in zip(KEY, parent)})
    joined = up.join(above, [f"p_{k}" for k in KEY], "left").drop(*[f"p_{k}" for k in KEY])
    stop = (F.col("depth") == 0) | (F.col("n_children") != 1) | (F.col("n_ends") > 0)
    weight = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(F.lit(0))
    chosen = F.coalesce("chosen", F.lit(False)) | (F.col("depth") == 1)
    done = stored(
        joined.withColumns({"stop": stop, "weight": weight.cast("long"), "chosen": chosen}), "nodes"
    )
    discard(found, counted)
    return done


def _chains(nodes: DataFrame) -> DataFrame:
    """Adds stop_depth, the next stop below on the path of the smallest member, and ``sum``.

    Nodes with the same smallest member form one path down to that member's end. ``sum`` adds
    the weights from the node down to the end of the path; in stretches, as paths may be long.
    """
    cut = nodes.withColumn("stretch", F.shiftright("depth", STRETCH_BITS))
    stop_depth = F.when(F.col("stop"), F.col("depth"))
    inside = Window.partitionBy("conv", "stretch").orderBy(F.col("depth").desc())
    cut = cut.withColumns(
        {"_sum": F.sum("weight").over(inside), "_stop": F.min(stop_depth).over(inside.rowsBetween(0, 0))}
    )
    cut = cut.withColumn("_stop", F.last("_stop", ignorenulls=True).over(inside))
    later = Window.partitionBy("conv").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("conv", "stretch").agg(F.sum("weight").alias("w"), F.min(stop_depth).alias("s"))
    totals = totals.select(
        "conv", "stretch", F.coalesce(F.sum("w").over(later), F.lit(0)).alias("w"), F.min("s").over(later).alias("s")
    )
    joined = cut.join(totals, ["conv", "stretch"])
    return joined.withColumns(
        {"sum": F.col("_sum") + F.col("w"), "stop_depth": F.coalesce("_stop", "s")}
    ).drop("stretch", "_sum", "_stop", "w", "s")


class Parentheses:
    """Balanced parentheses with range min-max blocks over the excess.

    ``excess[i]`` counts open less closed parentheses up to and including ``i``. ``floors``
    holds the least excess of each block, then of each pair of blocks, and so on.
    """

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        n = len(opens)
        self.excess = np.cumsum(np.where(opens, 1, -1))
        blocks = max(1, -(-n // BLOCK))
        padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        padded[:n] = self.excess
        self.floors = [padded.reshape(blocks, BLOCK).min(axis=1)]
        while len(self.floors[-1]) > 1:
            low = self.floors[-1]
            if len(low) % 2:
                low = np.append(low, np.iinfo(np.int64).max)
            self.floors.append(low.reshape(-1, 2).min(axis=1))
        self.padded = padded
        # Leaf pairs "()" that begin before a place.
        pairs = np.zeros(n, dtype=np.int64)
        pairs[:-1] = opens[:-1] & ~opens[1:]
        self.leaf_pair = pairs.astype(bool)

    def _scan(self, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """First place from ``at`` to its block's end whose excess is below, or -1."""
        found = np.full(len(at), -1, dtype=np.int64)
        live = np.arange(len(at))
        place = at.copy()
        end = (at // BLOCK + 1) * BLOCK
        while len(live):
            inside = place[live] < end[live]
            live = live[inside]
            hit = self.padded[place[live]] < wanted[live]
            found[live[hit]] = place[live[hit]]
            live = live[~hit]
            place[live] += 1
        return found

    def find_close(self, places: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the first with a lower excess."""
        wanted = self.excess[places]
        found = self._scan(places + 1, wanted) if len(places) else places
        # A place at a block's start belongs to the next block: look there by the tree.
        open_ = np.flatnonzero(found < 0)
        block = (places[open_] + 1) // BLOCK
        level = np.zeros(len(open_), dtype=np.int64)
        # Up: the next block to the right whose floor is low enough, at rising levels.
        rising = np.ones(len(open_), dtype=bool)
        while rising.any():
            for k in np.unique(level[rising]):
                now = np.flatnonzero(rising & (level == k))
                floors, right = self.floors[k], block[now] + 1
                ok = (block[now] % 2 == 0) & (right < len(floors))
                low = np.zeros(len(now), dtype=bool)
                low[ok] = floors[right[ok]] < wanted[open_[now[ok]]]
                block[now] = np.where(low, right, block[now] // 2)
                level[now[~low]] += 1
                rising[now[low]] = False
        # Down: to the first low child, at falling levels.
        while (level > 0).any():
            now = np.flatnonzero(level > 0)
            for k in np.unique(level[now]):
                own = now[level[now] == k]
                left = block[own] * 2
                low = self.floors[k - 1][left] < wanted[open_[own]]
                block[own] = np.where(low, left, left + 1)
                level[own] -= 1
        found[open_] = self._scan(block * BLOCK, wanted[open_])
        return found


def shard_figures(first, last, depth, leaf, weight) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and savings below each node of a shard, the node included.

    ``first`` and ``last`` are the ranks of a node's outer members, ``leaf`` says whether the
    node is entered as a leaf here, ``weight`` is what it saves.
    """
    n = len(first)
    # Nodes open at their first member, outer ones earlier; close at their last, inner ones earlier.
    rank = np.concatenate([first, last])
    closing = np.repeat([0, 1], n)
    order = np.lexsort((np.concatenate([depth, -depth]), closing, rank))
    opens = order < n
    tree = Parentheses(opens)
    place = np.empty(n, dtype=np.int64)
    place[order[opens]] = np.flatnonzero(opens)
    end = tree.find_close(place)
    entered, saved = np.zeros(2 * n + 1, dtype=np.int64), np.zeros(2 * n + 1, dtype=np.int64)
    entered[place + 1] = leaf & tree.leaf_pair[place]
    saved[place + 1] = weight
    leaves_to, saved_to = np.cumsum(entered), np.cumsum(saved)
    return leaves_to[end + 1] - leaves_to[place], saved_to[end + 1] - saved_to[place]


def _shard_tries(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of the nodes of whole shards, streamed in order of shard."""

    def figures(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        value = {c: table[c].to_numpy() for c in ("first", "last", "depth", "leaf", "weight")}
        leaves, saved = shard_figures(*value.values())
        columns = [table["conv"].combine_chunks(), table["depth"].combine_chunks(), pa.array(leaves), pa.array(saved)]
        return pa.RecordBatch.from_arrays(columns, ["conv", "depth", "leaves", "saved"])

    held, now = [], None
    for table in tables:
        shards = table["shard"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if shards[a] != now and held:
                yield figures(held)
                held = []
            now = shards[a]
            held.append(table.slice(a, b - a))
    if held:
        yield figures(held)


def _ranked(conversations: DataFrame, passed: DataFrame, shard: int) -> DataFrame:
    """conv, rank, shard: neighbours in rank share the longest prefixes.

    The key is what a conversation chooses at each branch, then its length: conversations
    with the same choices lie on one path, the shorter first.
    """
    choices = passed.where("chosen").groupBy("conv").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("depth", "ha", "hb"))), lambda x: x["ha"]).alias("way")
    )
    keyed = stored(conversations.join(choices, "conv", "left"), "ways")
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(tasks, -(-keyed.count() // shard))
    by = [F.coalesce("way", F.array().cast("array<long>")), F.col("length"), F.col("conv")]
    dealt = keyed.repartitionByRange(shards, *by).sortWithinPartitions(*by)
    placed = dealt.select("conv", F.monotonically_increasing_id().alias("rank"), F.spark_partition_id().alias("shard"))
    ranks = stored(placed, "ranks")
    discard(keyed)
    return ranks


def _ends_digests(members: DataFrame) -> DataFrame:
    """depth, ka, kb, ends_sha256 of nodes where conversations end."""
    ends = members.where("depth = length").select(*KEY, "conv", F.shiftright("conv", STRETCH_BITS).alias("stretch"))
    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))
    joined = ends.groupBy(*KEY, "stretch").agg(F.array_join(ids, ",").alias("ids"))

    def digest(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], [*KEY, "ends_sha256"]
            )

        for table in tables:
            for *key, ids in zip(*[table[c].to_pylist() for c in (*KEY, "ids")]):
                if key != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield batch(done)
                done = []
        if now:
            yield batch([(*now, state.hexdigest())])

    dealt = joined.repartition(*KEY).sortWithinPartitions(*KEY, "stretch")
    return dealt.mapInArrow(digest, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(rebuilt_conversations: tuple[DataFrame, DataFrame], shard: int = SHARD) -> DataFrame:
    """One row per node of the trie of (conv, length) and their turns (conv, pos, ta, tb, bytes).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.
    """
    conversations, turns = rebuilt_conversations
    conversations = stored(conversations, "conversations")
    members = stored(_prefixes(conversations, turns).unionByName(_root(conversations)), "prefixes")
    nodes = _nodes(members)
    chains = stored(_chains(nodes), "chains")

    # Prefixes of conversations at stops and after branches.
    marked = nodes.where("stop or chosen").select(*KEY, "stop", "chosen", F.col("conv").alias("node"))
    passed = stored(members.select("conv", *KEY, "ha", "hb").join(marked, KEY), "passed")
    ranks = _ranked(conversations, passed, shard)

    stops = chains.where("stop")
    # A stop stands for the chain above it: all nodes with the same path and next stop.
    weights = chains.groupBy("conv", F.col("stop_depth").alias("depth")).agg(F.sum("weight").alias("weight"))
    parts = (
        passed.where("stop")
        .join(ranks, "conv")
        .groupBy("shard", F.col("node").alias("conv"), "depth")
        .agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    )
    home = parts.groupBy("conv", "depth").agg(F.min("shard").alias("home"))
    entered = home.join(weights, ["conv", "depth"]).join(
        stops.select("conv", "depth", (F.col("n_children") == 0).alias("leaf")), ["conv", "depth"]
    )
    here = F.col("shard") == F.col("home")
    parts = parts.join(entered, ["conv", "depth"]).select(
        "shard", "conv", "depth", "first", "last", (F.col("leaf") & here).alias("leaf"),
        F.when(here, F.col("weight")).otherwise(0).alias("weight"),
    )
    dealt = parts.repartition("shard").sortWithinPartitions("shard")
    tries = dealt.mapInArrow(_shard_tries, "conv long, depth long, leaves long, saved long")
    figures = tries.groupBy("conv", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    # A stop's figures hold the weights of its chain; a node of the chain leaves out those above.
    below = (
        stops.select("conv", "depth", F.col("sum").alias("stop_sum"), F.col("weight").alias("stop_weight"))
        .join(figures, ["conv", "depth"])
        .join(weights.withColumnRenamed("weight", "chain"), ["conv", "depth"])
        .select(
            "conv", F.col("depth").alias("stop_depth"), "leaves",
            (F.col("saved") - F.col("chain") + F.col("stop_weight") - F.col("stop_sum")).alias("rest"),
        )
    )
    done = chains.join(below, ["conv", "stop_depth"])
    # ``sum`` of the node less that of the stop are the weights between them.
    saved = (F.col("rest") + F.col("sum")).alias("saved_tokens")
    digests = _ends_digests(members)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return done.join(digests, KEY, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"),
        "n_convs", "n_children", F.col("leaves").alias("n_leaves"), saved,
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
