"""Conversation prefix trie (13): subtree sums by the Euler-tour technique.

The first ``d`` turns of a conversation are a node of depth ``d``; equal
prefixes of different conversations are one node, the textless root is all
conversations' prefix of depth 0.  Serving the turns of a node once instead
of once per member saves (members - 1) times its last turn's tokens; the
report gives this per subtree.

- **Names.** A prefix is named by its depth and the exclusive or of two
  64-bit hashes of (place, role, text) over its turns, a running total over
  ordered rows.  The parent's name is the node's without the last turn's
  hashes.  Nodes then get ids in order of (smallest member, depth), which
  keeps most steps of the tour within neighbouring ids.
- **Tour.** Every node has an enter and an exit arc.  Enter goes on to the
  first child's enter or the node's own exit, exit to the next sibling's
  enter or the parent's exit.
- **List ranking.** Arcs are cut into ranges of ids of bounded size; each
  task ranks the pieces of the list inside its range, a piece becomes one
  weighted element of a shorter list, and so on until ``bound`` elements are
  left, which one task ranks.  A round that shortens the list too little is
  followed by one that splices out every element whose random mark is one
  and whose predecessor's is zero (a quarter, whatever the order).  Going
  back, an arc's place is its piece's place plus its place in the piece.
- **Sums.** Running totals over the places; a subtree's sum is the total at
  the exit arc minus the total before the enter arc.

No step holds a node's children, a node's members or a conversation in one
group: order comes from range partitions, counts from partial aggregates.
The one sequential thing is the digest of the ids that end at a node, which
streams through one task per node in pieces of up to 64 kB of text.

Cases: null role or text is empty; a null turn comes first, equal turns are
ordered by role, then by a hash of the text; rows without ``conv_id`` belong
to no conversation; repeated rows are repeated turns; equal prefixes are one
node however long; very long texts are hashed, never moved; an empty table
gives no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .running import running
from .tables import written

BOUND = 1 << 19
WORD = r"[^\x20\x09-\x0D]+"


def ordered_turns(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv_id, place, a, b, words): the turns of each conversation, numbered from 1.

    ``a`` and ``b`` are two hashes of (role, text), ``words`` the turn's words.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    rows = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), by.alias("role"),
                       F.xxhash64(F.lit(1), by, said).alias("a"), F.xxhash64(F.lit(2), by, said).alias("b"),
                       F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("one"))
    placed = running(rows.filter("conv_id is not null"), ["conv_id"], [F.asc_nulls_first("turn"), F.col("role"), F.col("a")],
                     "turns", add=["one"])
    return placed.select("conv_id", F.col("one_run").alias("place"), "a", "b", "words")


def with_shared_start(turns: DataFrame, every: int = 20, modulus: int = 4) -> DataFrame:
    """The turns of every conversation c after its first h are its own, the first h those of c - c % every.

    h is crc32 of the decimal id modulo ``modulus``; places stay gapless.  A
    conversation that is the start of others passes on at most
    ``modulus - 1`` turns to fewer than ``2 * every`` ids.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus
    counted = turns.filter(F.col("place") < modulus)
    firsts = counted.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), "place", "a", "b", "words")
    have = firsts.groupBy("base").agg(F.max("place").alias("have"))
    ids = (turns.filter("place = 1").select("conv_id", base.alias("base"), h.alias("h"))
           .join(have, "base", "left").withColumn("got", F.least("h", F.coalesce("have", F.lit(0)))))
    taken = (ids.filter("got > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("long"), "got")).alias("place"))
             .join(firsts, ["base", "place"]).select("conv_id", "place", "a", "b", "words"))
    # an own turn's place needs only its id and how many turns its base has given
    short = ids.filter("got < h").select("conv_id", (F.col("h") - F.col("got")).alias("less"))
    own = turns.withColumn("h", h).filter("place > h").drop("h").join(short, "conv_id", "left").select(
        "conv_id", (F.col("place") - F.coalesce("less", F.lit(0))).alias("place"), "a", "b", "words")
    return taken.unionByName(own)


def _digests(ends: DataFrame, keys: list[str], piece: int = 1 << 16) -> DataFrame:
    """(keys, ends_sha256): hex digest of the comma-joined ids of each key, ids ascending."""
    width = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches):
        seq = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(i).to_numpy() for i in range(len(keys))]
            new = np.zeros(n, dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            new[::max(1, piece // 20)] = True
            starts = np.flatnonzero(new)
            ids = batch.column(len(keys)).to_pylist()
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, [*starts[1:], n])]
            part = batch.column(len(keys) + 1).take(pa.array(starts))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c[starts]) for c in cols], part, pa.array(np.arange(seq, seq + len(starts))), pa.array(texts)],
                [*keys, "part", "seq", "text"])
            seq += len(starts)

    def digest(batches):
        last, state = None, None
        for batch in batches:
            done, found = [], []
            for *key, text in zip(*[batch.column(i).to_pylist() for i in range(len(keys))],
                                  batch.column(len(keys) + 2).to_pylist()):
                if key == last:
                    state.update(b"," + text.encode())
                else:
                    if last is not None:
                        done.append(last)
                        found.append(state.hexdigest())
                    last, state = key, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in done], pa.int64()) for i in range(len(keys))],
                                              pa.array(found, pa.string())], [*keys, "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in last], pa.array([state.hexdigest()])],
                                             [*keys, "ends_sha256"])

    by = [*keys, "conv_id"]
    named = ", ".join(f"{k} long" for k in keys)
    pieces = (ends.select(*by).repartitionByRange(width, *by).sortWithinPartitions(*by)
              .withColumn("part", F.spark_partition_id()).mapInArrow(cut, f"{named}, part int, seq long, text string"))
    return (pieces.repartition(width, *keys).sortWithinPartitions(*keys, "part", "seq")
            .mapInArrow(digest, f"{named}, ends_sha256 string"))


def trie_nodes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the prefixes of ``turns`` (conv_id, place, a, b, words), written.

    ``ids`` has every conversation once, those without turns too.  Columns:
    id, conv_id, depth, parent (id), parent_conv_id, nth (among its
    siblings, from 1), n_convs, words, ends_sha256.
    """
    mixed = turns.select("conv_id", "place", "words", F.xxhash64("place", "a").alias("x"), F.xxhash64("place", "b").alias("y"))
    named = running(mixed, ["conv_id"], [F.col("place")], "prefixes", xor=["x", "y"])
    named = named.select("conv_id", F.col("place").alias("d"), F.col("x_run").alias("p"), F.col("y_run").alias("q"),
                         F.col("x_run").bitwiseXOR(F.col("x")).alias("up_p"), F.col("y_run").bitwiseXOR(F.col("y")).alias("up_q"),
                         "words")
    zero = F.lit(0).cast("long")
    root = ids.select("conv_id", *[zero.alias(c) for c in ("d", "p", "q", "up_p", "up_q", "words")])
    every = named.unionByName(root)
    key = ["d", "p", "q"]
    last = (every.groupBy("conv_id").agg(F.max(F.struct("d", "p", "q")).alias("at")).select("at.*", "conv_id"))
    nodes = (every.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
                                     F.max("words").alias("words"), F.max("up_p").alias("up_p"), F.max("up_q").alias("up_q"))
             .join(_digests(last, key), key, "left"))
    width = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = written(nodes.repartitionByRange(width, "conv_id", "d").sortWithinPartitions("conv_id", "d")
                    .withColumn("id", F.monotonically_increasing_id()), "nodes")

    # a parent's row comes before its children's; its id and member run on over them
    one = F.lit(1).cast("long")
    above = nodes.select("d", "p", "q", zero.alias("child"), "id", F.col("id").alias("parent"),
                         F.col("conv_id").alias("parent_conv_id"), zero.alias("nth"))
    below = nodes.filter("d > 0").select((F.col("d") - 1).alias("d"), F.col("up_p").alias("p"), F.col("up_q").alias("q"),
                                         one.alias("child"), "id", zero.alias("parent"), zero.alias("parent_conv_id"),
                                         one.alias("nth"))
    linked = running(above.unionByName(below), key, [F.col("child"), F.col("id")], "children",
                     add=["parent", "parent_conv_id", "nth"])
    linked = linked.filter("child = 1").select("id", F.col("parent_run").alias("parent"),
                                               F.col("parent_conv_id_run").alias("parent_conv_id"), F.col("nth_run").alias("nth"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return written(nodes.join(linked, "id", "left").select(
        "id", "conv_id", F.col("d").alias("depth"), "parent", "parent_conv_id", "nth", "n_convs", "words",
        F.coalesce("ends_sha256", none).alias("ends_sha256")), "trie")


def euler_tour(nodes: DataFrame) -> DataFrame:
    """(arc, next): arc 2 id enters a node, 2 id + 1 leaves it; next is null at the tour's end."""
    first = nodes.filter("nth = 1").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    enter = nodes.select("id").join(first, "id", "left").select(
        (F.col("id") * 2).alias("arc"), F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1).alias("next"))
    after = nodes.filter("nth > 1").select("parent", (F.col("nth") - 1).alias("nth"), F.col("id").alias("sibling"))
    leave = nodes.select("id", "parent", "nth").join(after, ["parent", "nth"], "left").select(
        (F.col("id") * 2 + 1).alias("arc"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"))
    return enter.unionByName(leave)


def _shorten(batches):
    """Pieces of the list within a partition: (arc, head, off), and next and weight of each head."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    arc, nxt, w = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
    order = np.argsort(arc)
    arc, nxt, w = arc[order], nxt[order], w[order]
    at = np.minimum(np.searchsorted(arc, nxt), len(arc) - 1)
    inside = arc[at] == nxt
    head, off = np.arange(len(arc)), np.zeros(len(arc), dtype=np.int64)
    head[at[inside]] = np.flatnonzero(inside)            # the predecessor, then ever earlier ones
    off[at[inside]] = w[inside]
    while True:
        further = head[head]
        if (further == head).all():
            break
        off = off + off[head]
        head = further
    tail = ~inside
    end, weight = np.zeros(len(arc), dtype=np.int64), np.zeros(len(arc), dtype=np.int64)
    end[head[tail]] = nxt[tail]
    weight[head[tail]] = off[tail] + w[tail]
    yield pa.RecordBatch.from_arrays([pa.array(arc), pa.array(arc[head]), pa.array(off), pa.array(end), pa.array(weight)],
                                     ["arc", "head", "off", "next", "w"])


def _splice(lst: DataFrame, salt: int) -> DataFrame:
    """The list without the elements of mark one behind a mark of zero; same columns as a shortening."""
    def mark(c: str):
        return F.pmod(F.xxhash64(F.lit(salt), F.col(c)), F.lit(2))
    before = lst.select(F.col("next").alias("arc"), F.col("arc").alias("pred"), F.col("w").alias("pred_w"))
    behind = lst.select(F.col("arc").alias("next"), F.col("next").alias("next2"), F.col("w").alias("w2"))
    all_ = lst.join(before, "arc", "left").join(behind, "next", "left")
    goes = (mark("arc") == 1) & F.col("pred").isNotNull() & (mark("pred") == 0)
    takes = (mark("arc") == 0) & F.col("next2").isNotNull() & (mark("next") == 1)
    return all_.select("arc", F.when(goes, F.col("pred")).otherwise(F.col("arc")).alias("head"),
                       F.when(goes, F.col("pred_w")).otherwise(0).alias("off"),
                       F.when(takes, F.col("next2")).otherwise(F.col("next")).alias("next"),
                       F.when(takes, F.col("w") + F.col("w2")).otherwise(F.col("w")).alias("w"))


def list_ranks(links: DataFrame, bound: int = BOUND) -> DataFrame:
    """(arc, rank): the place of every element of one list (arc, next), from 0; next is null at the end."""
    schema = "arc long, head long, off long, next long, w long"
    lst = written(links.select("arc", F.coalesce("next", F.lit(-1).cast("long")).alias("next"), F.lit(1).cast("long").alias("w")), "list")
    n, levels = lst.count(), []
    while n > 1:
        if n <= bound:
            dealt = lst.coalesce(1)
        else:
            dealt = lst.repartitionByRange(-(-2 * n // bound), "arc")
        levels.append(written(dealt.mapInArrow(_shorten, schema), "level"))
        lst, before = levels[-1].filter("arc = head").select("arc", "next", "w"), n
        n = lst.count()
        if n > bound and 2 * n > before:
            levels.append(written(_splice(lst, len(levels)), "level"))
            lst = levels[-1].filter("arc = head").select("arc", "next", "w")
            n = lst.count()
    ranks = lst.select("arc", F.lit(0).cast("long").alias("rank"))
    for level in reversed(levels):
        place = ranks.select(F.col("arc").alias("head"), F.col("rank").alias("base"))
        ranks = level.select("arc", "head", "off").join(place, "head").select("arc", (F.col("base") + F.col("off")).alias("rank"))
    return ranks


def prefix_trie(turns: DataFrame, ids: DataFrame, bound: int = BOUND) -> DataFrame:
    """One row per node of the trie of ``turns`` with members, children, leaves and saved words; see the module text."""
    nodes = trie_nodes(turns, ids)
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
                    .withColumn("leaf", (F.col("n_children") == 0).cast("long"))
                    .withColumn("saves", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    ranked = list_ranks(euler_tour(nodes), bound)
    weights = nodes.select((F.col("id") * 2).alias("arc"), "leaf", "saves")
    zero = F.lit(0).cast("long")
    at = ranked.join(weights, "arc", "left").select("rank", "arc", F.coalesce("leaf", zero).alias("leaf"),
                                                    F.coalesce("saves", zero).alias("saves"))
    summed = running(at, [], [F.col("rank")], "tour", add=["leaf", "saves"])
    # the exit's total less the total before the enter arc
    enters = F.col("arc") % 2 == 0
    sign = F.when(enters, -1).otherwise(1)
    sub = summed.groupBy(F.shiftright("arc", 1).alias("id")).agg(
        F.sum(sign * F.col("leaf_run") + F.col("leaf")).alias("n_leaves"),
        F.sum(sign * F.col("saves_run") + F.col("saves")).alias("saved_tokens"))
    return nodes.join(sub, "id").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                        "saved_tokens", "ends_sha256")
