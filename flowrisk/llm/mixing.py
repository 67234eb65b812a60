"""Operator 5: mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.llm.common import number_copies, uniform, words_of
from flowrisk.session import materialize

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
FAN_IN = 128


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """Add the target of each source: its weighted share of all sizes, at most ``most`` times its own.

    ``sources`` has one row per source (source, source_size). Weights repeat over the sources in order of
    code point, null last. What a source can't take is shared again by weight until none is above its
    bound: with sources sorted by bound per weight, those that reach it are a prefix, found in one pass.
    """
    ranked = sources.withColumn("__w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(
        F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * float(most)
    order = Window.orderBy(cap / F.col("__w"), F.col("source").asc_nulls_last())
    earlier, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0))
    ranked = ranked.withColumn("__level", left / F.sum("__w").over(rest))
    full = F.col("__level") * F.col("__w") > cap
    ranked = ranked.withColumn("__free_level", F.min(F.when(~full, F.struct((cap / F.col("__w")).alias("r"), F.col("__level").alias("l")))).over(Window.partitionBy())["l"])
    return ranked.select("source", "source_size", F.when(full, cap).otherwise(F.col("__free_level") * F.col("__w")).alias("target"))


def _settle(items: Column, draws: int, kind: str) -> Column:
    """Fold an array of items (size, p) into decisions: pivotal rounding that keeps the sum of size * p.

    One item is open at a time. With the next item, mass moves one way or the other, at random and so
    that the expected p of both stays the same, until one of the two is 0 or 1; the other stays open.
    Returns a struct of the settled items (id fields, up) and the one left open (null if none).
    """
    eps = 1e-9

    def step(acc: Column, nxt: Column) -> Column:
        a, b = acc["open"], nxt
        mass_up = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"])        # from b to a
        mass_down = F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))      # from a to b
        u = uniform(b["__id"], b["copy"], b["size"], a["size"], F.lit(draws))
        moved = F.when(u * (mass_up + mass_down) < mass_down, mass_up).otherwise(-mass_down)
        pa, pb = a["p"] + moved / a["size"], b["p"] - moved / b["size"]
        edge = lambda p: F.least(p, 1 - p)
        a2 = F.struct(a["__id"].alias("__id"), a["size"].alias("size"), a["copy"].alias("copy"), pa.alias("p"))
        b2 = F.struct(b["__id"].alias("__id"), b["size"].alias("size"), b["copy"].alias("copy"), pb.alias("p"))
        a_done = edge(pa) <= edge(pb)
        settled, still = F.when(a_done, a2).otherwise(b2), F.when(a_done, b2).otherwise(a2)
        both = edge(still["p"]) < eps
        return F.when(a.isNull(), F.struct(acc["done"].alias("done"), b.alias("open"))).otherwise(F.struct(
            F.when(both, F.concat(acc["done"], F.array(settled, still))).otherwise(F.concat(acc["done"], F.array(settled))).alias("done"),
            F.when(~both, still).alias("open")))

    item = f"struct<__id:{kind},size:bigint,copy:bigint,p:double>"
    start = F.struct(F.expr(f"cast(array() as array<{item}>)").alias("done"), F.expr(f"cast(null as {item})").alias("open"))
    return F.aggregate(items, start, step)


def pivotal(items: DataFrame, kind: str, fan_in: int = FAN_IN) -> DataFrame:
    """Round the fractions of all items, source by source: adds ``up`` (0 or 1).

    ``items`` has source, __id, copy, size > 0, p in (0, 1), and the rows of its source ``n``. Blocks of
    about ``fan_in`` items are settled in parallel; the one item that each leaves open goes up a
    tree of the same width. So no task sees more than a block, and after log(n) levels a source has
    one open item, which a last draw settles: its words miss the target by less than that item.
    """
    level, n_open = 0, F.col("n")
    deepest = items.agg(F.max("n")).first()[0] or 0
    now, done = items, []
    while True:
        blocks = F.ceil(n_open / fan_in)
        keyed = now.withColumn("__block", F.pmod(F.xxhash64("__id", "copy", "size", F.lit(level)), blocks))
        grouped = keyed.groupBy("source", "__block", "n").agg(
            F.array_sort(F.collect_list(F.struct("__id", "size", "copy", "p"))).alias("items"))
        folded = materialize(grouped.select("source", "n", _settle(F.col("items"), level, kind).alias("r")), f"pivotal-{level}")
        done.append(folded.select("source", F.explode("r.done").alias("i")).select("source", "i.*"))
        now = folded.where("r.open is not null").select("source", "n", "r.open.*")
        level += 1
        if deepest <= fan_in:
            break
        deepest = -(-deepest // fan_in)
        n_open = F.ceil(F.col("n") / float(fan_in ** level))
    last = now.select("source", "__id", "size", "copy", F.when(uniform(F.col("__id"), F.col("copy"), F.lit(-1)) < F.col("p"), 1.0).otherwise(0.0).alias("p"))
    out = last
    for part in done:
        out = out.unionByName(part)
    return out.select("source", "__id", "size", "copy", F.round("p").cast("long").alias("up"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words the mix takes of every document: one row per input row.

    Columns: id, size (words of the text; null text: 0), source, source_size, target (its source's), taken
    (copies times size, at most ``most`` times the size). Every document of a source is expected
    target / source_size times; the whole part is taken outright and the fraction is rounded dependently,
    so that the words of a source come within one document of its target. Draws are hashes: reruns agree.
    Texts without a word take nothing. Rows that are alike in every respect are numbered and rounded
    like different rows. No text is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"),
                         F.size(words_of(F.col(text_col))).cast("long").alias("size"))
    rows = materialize(number_copies(narrow, "copy"), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    wanted = materialize(targets(sources.drop("n"), weights, most).alias("t").join(
        sources.drop("source_size").alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", "n"), "mix-targets")
    ratio = F.least(F.lit(float(most)), F.try_divide(F.col("target"), F.col("source_size")))
    every = rows.alias("r").join(wanted.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")), "left").select(
        "r.*", "source_size", "target", "n", F.coalesce(ratio, F.lit(0.0)).alias("ratio"))
    whole = F.floor(F.col("ratio") + 1e-9)
    every = every.withColumns({"whole": whole, "p": F.greatest(F.col("ratio") - whole, F.lit(0.0))})
    open_ = (F.col("size") > 0) & (F.col("p") > 1e-9)
    rounded = pivotal(every.where(open_).select("source", "__id", "copy", "size", "p", "n"), kind)
    settled = every.where(~open_).select("__id", "source", "size", F.lit(0).cast("long").alias("up"))
    both = settled.unionByName(rounded.select("__id", "source", "size", "up"))
    final = both.alias("b").join(wanted.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")), "left")
    taken = F.col("size") * (F.coalesce(F.floor(ratio + 1e-9), F.lit(0)) + F.col("up"))
    return final.select(F.col("__id").alias(id_col), "size", F.col("b.source").alias("source"), "source_size", "target",
                        taken.cast("long").alias("taken"))
