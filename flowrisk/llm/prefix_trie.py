"""Operator 13: the trie of conversation prefixes, built as burst tries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.llm.common import SPACE
from flowrisk.session import materialize

WIDTH = 32                  # characters of a turn's id
LAYER_TURNS = 1 << 16       # turns of a conversation in one row; the trie is built layer by layer
CONTAINER_TURNS = 1024      # containers with more turns in several suffixes burst
ENDS_PER_PART = 10          # bits of the ids that are joined in one string
NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, e1 long, e2 long"
FIELDS = [f.split()[0] for f in NODE.split(", ")]


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, pos, id, words): the turns of every conversation in order, numbered from 0.

    Order is turn (null first), then id: a hash of 128 bits of role and text, of which null is empty. Rows without a conversation id are
    left out. Rows are sorted over the cluster, so a conversation may be spread over any number of tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    words = F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        words.alias("words"), F.monotonically_increasing_id().alias("salt"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, k = TaskContext.get().partitionId(), None, 0
        for batch in (b for b in batches if b.num_rows):
            c = batch.column(0).to_numpy()
            start = np.flatnonzero(np.concatenate([[c[0] != last], c[1:] != c[:-1]]))
            first = np.zeros(len(c), "int64")
            first[start] = start
            pos = np.arange(len(c)) - np.maximum.accumulate(first)
            ahead = start[0] if len(start) else len(c)
            pos[:ahead] += k
            last, k = c[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pos), batch.column(1), batch.column(2), pa.array(np.full(len(c), part))], ["c", "k", "id", "words", "part"])

    order = ["c", "turn", "id", "salt"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "id", "words").mapInArrow(number, "c long, k long, id string, words long, part long")
    placed = materialize(placed, "turns")
    # Conversations of several tasks: at most one begins in each of them and goes on.
    parts = placed.groupBy("c").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("c")
    sizes = placed.join(parts, "c", "left_semi").groupBy("c", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("c", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return placed.join(ahead, ["c", "part"], "left").select("c", (F.col("k") + F.coalesce("ahead", F.lit(0))).alias("pos"), "id", "words")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """All conversations (c), and their turns after the rebuild: the first h turns of conversation c - c % family, then the own ones after h.

    h is crc32 of the decimal c, modulo ``most``.
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    convs = turns.groupBy("c").agg(F.count("*").alias("n")).withColumns({"h": h, "base": F.col("c") - F.col("c") % family})
    convs = materialize(convs, "conversations")
    bases = convs.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").select("c", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("b"))
    first = turns.where(F.col("pos") < most - 1).withColumnRenamed("c", "base")
    shared = convs.where("b > 0").select("c", "base", "b").join(first, "base").where("pos < b").select("c", "pos", "id", "words")
    own = turns.where(F.col("pos") >= h).join(convs.select("c", "h", "b"), "c").select("c", (F.col("pos") - F.col("h") + F.col("b")).alias("pos"), "id", "words")
    return convs.select("c"), shared.unionByName(own)


def common_turns(a: str, b: str) -> int:
    """Turns that two sequences of ids begin with together."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * WIDTH:mid * WIDTH] == b[lo * WIDTH:mid * WIDTH]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def swept(items: list[dict], base: int) -> tuple[list[list], list]:
    """Nodes of a container, whose suffixes are in sorted order, and its (tops, leaves, saved tokens).

    A node is closed when the next suffix leaves it, and adds its numbers to its parent.
    """
    j = items[0]["j"]
    low, nodes, before = max(j, 1) - 1, [], ""
    # depth, members, smallest member, children, leaves, saved tokens, words, end, rows of its children
    stack = [[low, 0, None, 0, 0, 0, 0, (None, None), []]]

    def close() -> None:
        depth, n, least, children, leaves, saved, words, end, own = stack.pop()
        leaves, saved = leaves or 1, saved + (n - 1) * words
        for k in own:
            nodes[k][2] = least
        up = stack[-1]
        up[1] += n
        up[2] = least if up[2] is None else min(up[2], least)
        up[3] += 1
        up[4] += leaves
        up[5] += saved
        up[8].append(len(nodes))
        nodes.append([base + depth, least, None, n, children, leaves, saved, *end])

    for item in items:
        seq = item["seq"]
        same = max(common_turns(before, seq), low)
        while stack[-1][0] > same:
            close()
        for d in range(same, len(seq) // WIDTH):
            stack.append([d + 1, 0, None, 0, 0, 0, item["words"][d], (None, None), []])
        top, before = stack[-1], seq
        top[1] += item["n"]
        top[2] = item["least"] if top[2] is None else min(top[2], item["least"])
        for k, name in ((3, "below_tops"), (4, "below_leaves"), (5, "below_saved")):
            top[k] += item[name]
        if item["ended"]:
            top[7] = item["e1"], item["e2"]
    while len(stack) > 1:
        close()
    for k in stack[0][8]:
        nodes[k][2] = items[0]["parent"]
    return nodes, stack[0][3:6]


def burst(items: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Containers, and the heads above them.

    A container holds the suffixes below a head; one with more than CONTAINER_TURNS turns bursts by the next turn id after
    the turns that all its suffixes share. A suffix that ends there stays at the head. ``path`` names the heads above a container.
    """
    rows = items.withColumns({"head": F.concat_ws(" ", "p1", "p2"), "j": F.lit(0), "path": F.array().cast("array<string>")})
    done, heads = [], []
    turns = F.char_length("seq") / WIDTH
    while True:
        rows = materialize(rows, "trie-containers")
        large = rows.groupBy("head").agg(F.count("*").alias("items"), F.sum(turns - F.col("j")).alias("turns"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.sum("n").alias("all"),
                                         F.min("least").alias("conv"), F.first("parent").alias("above"), F.first("path").alias("up"), F.min("j").alias("from"), F.first("p1").alias("q1"),
                                         F.first("p2").alias("q2")).where((F.col("items") > 1) & (F.col("turns") > CONTAINER_TURNS))
        size = F.least(F.char_length("lo"), F.char_length("hi")) / WIDTH
        equal = F.transform(F.sequence(F.lit(0), size.cast("int")), lambda i: (i < size) & (F.substring("lo", i * WIDTH + 1, F.lit(WIDTH)) == F.substring("hi", i * WIDTH + 1, F.lit(WIDTH))))
        large = materialize(large.withColumn("m", (F.array_position(equal, F.lit(False)) - 1).cast("int")).drop("lo", "hi", "items", "turns"), "trie-heads")
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, "head", "left_anti"))
        within = rows.join(large.select("head", "m", "conv"), "head")
        stay = within.where(turns == F.col("m")).select("head", *(F.col(c).alias(f"stay_{c}") for c in ("e1", "e2")), (F.col("ended") > 0).alias("stays"))
        # Any suffix tells the words of the turns that all share.
        own = within.groupBy("head").agg(F.min_by(F.slice("words", F.greatest("j", F.lit(1)), F.col("m") - F.greatest("j", F.lit(1)) + 1), "seq").alias("words"))
        heads.append(large.join(own, "head").join(stay, "head", "left"))
        rows = within.where(turns > F.col("m")).withColumns({
            "parent": F.when(F.col("m") > 0, F.col("conv")).otherwise(F.col("parent")), "path": F.concat("path", F.array("head")), "j": F.col("m") + 1,
            "head": F.concat_ws(" ", "p1", "p2", F.md5(F.expr(f"left(seq, (m + 1) * {WIDTH})")))}).drop("m", "conv")
    for part in done[:-1]:
        rows = rows.unionByName(part)
    every = heads[0] if heads else None
    for more in heads[1:]:
        every = every.unionByName(more)
    return rows, every


def layer(items: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of one layer, and per prefix (p1, p2) it begins with: tops, leaves and saved tokens below."""
    rows, heads = burst(items)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(container: list[dict]) -> pa.RecordBatch:
            nodes, (tops, leaves, saved) = swept(container, base)
            first = container[0]
            table = [x + [None] * 6 for x in nodes] + [[None] * 9 + [first["p1"], first["p2"], first["path"], tops, leaves, saved]]
            kinds = [pa.int64()] * 9 + [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*table), kinds)], [*FIELDS, "p1", "p2", "path", "tops", "leaves", "saved"])

        container: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if container and container[0]["head"] != row["head"]:
                    yield done(container)
                    container = []
                container.append(row)
        if container:
            yield done(container)

    out = rows.repartition("head").sortWithinPartitions("head", "seq").mapInArrow(sweep, NODE + ", p1 long, p2 long, path array<string>, tops long, leaves long, saved long")
    out = materialize(out, "trie-swept")
    nodes, sums = out.where("path is null").select(*FIELDS), out.where("path is not null").select("p1", "p2", "path", "tops", "leaves", "saved")
    if heads is None:
        return nodes, sums.drop("path")

    # Turns that all suffixes of a head share are a chain of nodes from depth j (1 at least) to m.
    chain = heads.withColumn("chain", F.expr(f"transform(words, (w, i) -> struct(greatest(`from`, 1) + i as d, w * (`all` - 1) as s))"))
    own = F.aggregate("chain", F.lit(0).cast("long"), lambda acc, x: acc + x["s"])
    part = sums.select("path", "leaves", "saved").unionByName(chain.select(F.col("up").alias("path"), F.lit(0).cast("long").alias("leaves"), own.alias("saved")))
    below = part.select(F.explode("path").alias("head"), "leaves", "saved").groupBy("head").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    children = sums.select("path").unionByName(heads.select(F.col("up").alias("path"))).where(F.size("path") > 0)
    children = children.groupBy(F.element_at("path", -1).alias("head")).agg(F.count("*").alias("tops"))
    known = materialize(chain.join(below, "head").join(children, "head"), "trie-known")

    each = known.select("*", F.explode("chain").alias("x"))
    deeper = Window.partitionBy("head").orderBy(F.col("x.d").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_end = F.col("x.d") == F.col("m")
    shared = each.select((F.lit(base) + F.col("x.d")).cast("long").alias("depth"), F.col("conv").alias("conv_id"),
                         F.when(F.col("x.d") == F.greatest("from", F.lit(1)), F.col("above")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("all").alias("n_convs"),
                         F.when(at_end, F.col("tops")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
                         (F.col("saved") + F.sum("x.s").over(deeper)).alias("saved_tokens"),
                         *(F.when(at_end & F.col("stays"), F.col(f"stay_{e}")).alias(e) for e in ("e1", "e2")))
    first = known.where(F.col("from") == 0).select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.when(F.col("m") > 0, F.lit(1)).otherwise(F.col("tops")).cast("long").alias("tops"),
                                                   "leaves", (F.col("saved") + own).alias("saved"))
    return nodes.unionByName(shared), sums.where(F.size("path") == 0).drop("path").unionByName(first)


def trie(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the prefix trie of all conversations ``convs`` (c) with ``turns`` (c, pos, id, words), and where they end (c, e1, e2).

    A node is a distinct sequence of first turns. Columns: depth, conv_id (smallest member), parent_conv_id (that of the parent, null at the root),
    n_convs (members), n_children, n_leaves (childless nodes in the subtree, its top included), saved_tokens (sum over the subtree of members beyond the
    first, times words of the last turn), and the key e1, e2 of the conversations that end there, or nulls. Conversations
    without turns end at the root; without conversations there is no node.

    Equal conversations are one row from the start. A row holds at most LAYER_TURNS turns of a conversation: longer ones are cut into layers, of which
    every one is a set of tries below the prefixes that reach it, built from the last layer up.
    """
    chunk = F.floor(F.col("pos") / LAYER_TURNS).cast("int").alias("layer")
    parts = turns.groupBy("c", chunk).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "words"))).alias("t"), F.bit_xor(F.xxhash64("pos", "id")).alias("x1"),
                                          F.bit_xor(F.xxhash64("id", "pos", F.lit(1))).alias("x2"))
    up_to = Window.partitionBy("c").orderBy("layer").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max("layer").over(Window.partitionBy("c")) == F.col("layer")
    parts = parts.withColumns({"e1": F.bit_xor("x1").over(up_to), "e2": F.bit_xor("x2").over(up_to), "last": last})
    parts = materialize(parts.select("c", "layer", F.array_join(F.transform("t", lambda x: x["id"]), "").alias("seq"), F.transform("t", lambda x: x["words"]).alias("words"), "e1", "e2",
                                     F.col("e1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("e2").bitwiseXOR(F.col("x2")).alias("p2"), "last"), "trie-parts")
    ends = convs.join(parts.where("last").select("c", "e1", "e2"), "c", "left").select("c", *(F.coalesce(e, F.lit(0).cast("long")).alias(e) for e in ("e1", "e2")))
    ends = materialize(ends, "trie-ends")
    items = parts.groupBy("layer", "p1", "p2", "e1", "e2").agg(F.first("seq").alias("seq"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("c").alias("least"),
                                                               F.sum(F.col("last").cast("int")).alias("ended"))
    items = materialize(items, "trie-items")
    n_convs, smallest, at_root, layers = *convs.agg(F.count("*"), F.min("c")).first(), *ends.agg(F.coalesce(F.max(((F.col("e1") == 0) & (F.col("e2") == 0)).cast("int")), F.lit(0))).first(), \
        *items.agg(F.coalesce(F.max("layer") + 1, F.lit(0))).first()
    zero = F.lit(0).cast("long")
    nodes, below = [], None
    for k in reversed(range(layers)):
        own = items.where(F.col("layer") == k).drop("layer")
        if k:
            above = items.where(F.col("layer") == k - 1).select(F.col("e1").alias("p1"), F.col("e2").alias("p2"), F.col("least").alias("parent"))
            own = own.join(above, ["p1", "p2"])
        else:
            own = own.withColumn("parent", F.lit(smallest).cast("long"))
        if below is None:
            own = own.withColumns({"below_tops": zero, "below_leaves": zero, "below_saved": zero})
        else:
            known = below.select(F.col("p1").alias("e1"), F.col("p2").alias("e2"), *(F.col(x).alias(f"below_{x}") for x in ("tops", "leaves", "saved")))
            own = own.join(known, ["e1", "e2"], "left").fillna(0, ["below_tops", "below_leaves", "below_saved"])
        found, below = layer(own, k * LAYER_TURNS)
        if layers > 1:
            found, below = materialize(found, "trie-nodes"), materialize(below, "trie-below")
        nodes.append(found)
    tops = below.agg(F.coalesce(F.sum("tops"), zero).alias("tops"), F.sum("leaves").alias("leaves"), F.coalesce(F.sum("saved"), zero).alias("saved")) if layers else \
        convs.sparkSession.range(1).select(zero.alias("tops"), zero.alias("leaves"), zero.alias("saved"))
    here = F.when(F.lit(bool(at_root)), zero)
    root = tops.where(F.lit(n_convs > 0)).select(zero.alias("depth"), F.lit(smallest).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
                                                 F.lit(n_convs).cast("long").alias("n_convs"), F.col("tops").alias("n_children"), F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"),
                                                 F.col("saved").alias("saved_tokens"), here.alias("e1"), here.alias("e2"))
    for found in nodes:
        root = root.unionByName(found)
    return root, ends


def end_hashes(ends: DataFrame) -> DataFrame:
    """(e1, e2, ends_sha256): SHA-256 of the comma-joined decimal ids that end at a node, in numerical order.

    Ids are joined in parts of 2 ** ENDS_PER_PART possible ids each; a node's parts are hashed one after the other as they come sorted.
    """
    parts = ends.groupBy("e1", "e2", F.shiftright("c", ENDS_PER_PART).alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for e1, e2, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if key == (e1, e2):
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (e1, e2), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["e1", "e2", "ends_sha256"])
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], ["e1", "e2", "ends_sha256"])

    dealt = parts.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "part").select("e1", "e2", "ids")
    return dealt.mapInArrow(run, "e1 long, e2 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations (``rebuilt``), with a hash of the ids that end at each node; see ``trie`` and ``numbered``."""
    nodes, ends = trie(*rebuilt(numbered(conversations)))
    none: Column = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(end_hashes(ends), ["e1", "e2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                                                      F.coalesce("ends_sha256", none).alias("ends_sha256"))
