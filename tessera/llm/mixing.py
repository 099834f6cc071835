"""Mixing sources to target weights (operator 8) by Sainte-Lague apportionment, in DataFrame operations alone.

Targets: sources share all tokens by weight; a source whose share exceeds `most` times its own size is held
there and the excess goes to the others by weight, found in closed form over the sorted ratios size / weight.
Quotas: the tokens are dealt out in equal blocks to the highest quotients target / (2 j - 1), so each source
gets a whole number of blocks; its shards of about `shard_rows` documents get theirs out of these by highest quotients too, so
shard quotas add up to the source's, but for a shard of which every block is already taken `most` times.
Selection: a shard's documents stand in an order drawn by seed, id and text and form one line of blocks; whole passes over
the line come first, then one run of blocks from a seeded start. What a document gives is arithmetic on its
place in the line, so no block is ever a row and no window spans more than a shard.

The source table (one row per source) is the only thing ordered in one place.

Defined results: a null text has size 0 and is never taken; a null source is a source, last in order; an
empty table gives an empty result; repeated rows of one id stand beside each other and are taken on their
own account. Carried columns are kept apart from the working columns, so clashing names do no harm; an
output named like a carried column replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, settle

OUTPUTS = ("size", "source_size", "target", "taken", "passes", "from1", "to1", "from2", "to2")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes (source, source_size, rows) with each source's target."""
    everything = W.partitionBy()
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    line = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = line.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(line.rowsBetween(0, W.unboundedFollowing))
    held = ranked.withColumn("level", level).withColumn("held", F.col("level") > F.col("ratio"))
    level = F.max(F.when(~F.col("held"), F.col("level"))).over(everything)
    return held.withColumn("target", F.when(F.col("held"), F.col("cap").cast("double")).otherwise(F.least(level * F.col("weight"), F.col("cap").cast("double")))).select("source", "source_size", "rows", "target")


def divide(parts: DataFrame, keys: list[str], part: str, weight: str, seats: str) -> DataFrame:
    """parts with `won`: each group's `seats` (the same in all its rows) dealt to its parts by the highest quotients weight / (2 seat - 1), ties by part.

    No part's seats are further from its exact share than by `slack`, as raising or lowering the divisor for the seats that
    rounding leaves over moves a part by no more; only the seats inside that margin are ordered. Parts without weight get none.
    """
    group = W.partitionBy(*keys)
    total, count = F.sum(weight).over(group), F.sum(F.when(F.col(weight) > 0, 1).otherwise(0)).over(group)
    share = parts.where(F.col(weight) > 0).withColumn("__share", F.col(weight) / total).withColumn("__near", F.floor(F.col(seats) * F.col("__share") + 0.5)).withColumn("__count", count)
    off = F.abs(F.col(seats) - F.sum("__near").over(group))
    share = share.withColumn("__slack", F.ceil((off + F.col("__count")) * F.col("__share")) + 1).withColumn("__sure", F.greatest(F.lit(0), F.col("__near") - F.col("__slack")))
    share = share.withColumn("__open", F.col(seats) - F.sum("__sure").over(group))
    each = share.withColumn("__seat", F.explode(F.sequence(F.col("__sure") + 1, F.col("__near") + F.col("__slack"))))
    line = W.partitionBy(*keys).orderBy((F.col(weight) / (2 * F.col("__seat") - 1)).desc(), F.col(part).asc_nulls_last(), "__seat")
    dealt = each.withColumn("__place", F.row_number().over(line)).groupBy(*keys, part).agg((F.min("__sure") + F.count(F.when(F.col("__place") <= F.col("__open"), 1))).alias("won"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, part)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return parts.alias("a").join(dealt.alias("b"), on, "left").select("a.*", F.coalesce("b.won", F.lit(0)).cast("bigint").alias("won"))


def apportion(shares: DataFrame, block: int) -> DataFrame:
    """shares (source, target, ...) with `seats`: blocks by highest quotients, in all the whole number nearest to the sum of the targets over the block."""
    whole = shares.withColumn("__one", F.lit(0)).withColumn("__all", F.floor(F.sum("target").over(W.partitionBy("__one")) / block + 0.5))
    return divide(whole, ["__one"], "source", "target", "__all").withColumnRenamed("won", "seats").drop("__one", "__all")


def mix(df: DataFrame, keep: list[str], doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 16, shard_rows: int = 256, fan: int = 1024, seed: int = 1, prefix: str = "") -> DataFrame:
    """df's columns `keep` and OUTPUTS, their names led by the prefix: taken = passes * size + (to1 - from1) + (to2 - from2), the latter being word ranges of the document."""
    draw = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text).cast("string"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in keep if c not in [prefix + n for n in OUTPUTS]), F.lit(0).alias("__none")).alias("row"), F.col(source).cast("string").alias("source"), F.col(doc_id).alias("id"), draw.alias("draw"), word_count(F.col(text)).alias("size"))
    rows = settle(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    quotas = settle(apportion(targets(sizes, weights, most), block))
    # Sources go by number from here on, as a join and a window on a column without nulls share one shuffle.
    quotas = quotas.select(F.col("source").alias("name"), F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).alias("s"), "source_size", "target", "seats", F.greatest(F.lit(1), F.ceil(F.col("rows") / shard_rows)).alias("shards"))
    placed = rows.join(F.broadcast(quotas) if quotas.count() <= 10_000 else quotas, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # A source's seats go to rows of about `fan` shards first and then to their shards, so neither step orders many rows in one place.
    shard = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), F.col("shards"))).withColumn("bunch", F.floor(F.col("shard") / fan))
    longs = settle(shard.groupBy("s", "bunch", "shard").agg(F.sum("size").alias("long"), F.first("seats").alias("seats")))
    bunches = divide(longs.groupBy("s", "bunch").agg(F.sum("long").alias("long"), F.first("seats").alias("seats")), ["s"], "bunch", "long", "seats")
    bunches = bunches.select(F.col("s").alias("s2"), F.col("bunch").alias("b2"), F.col("won").alias("seats"))
    within = longs.drop("seats").join(bunches, (F.col("s") == F.col("s2")) & (F.col("bunch") == F.col("b2"))).drop("s2", "b2")
    dealt = divide(within, ["s", "bunch"], "shard", "long", "seats").select(F.col("s").alias("s3"), F.col("shard").alias("d3"), "long", "won")
    order = W.partitionBy("s", "shard").orderBy("draw", F.col("id").asc_nulls_first(), "size")
    line = shard.join(dealt, (F.col("s") == F.col("s3")) & (F.col("shard") == F.col("d3"))).withColumn("begin", F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    line = line.withColumn("blocks", F.ceil(F.col("long") / block)).withColumn("quota", F.least(most * F.col("blocks"), F.col("won")))
    line = line.withColumn("passes", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0)).withColumn("rest", F.col("quota") - F.col("passes") * F.col("blocks"))
    line = line.withColumn("first", F.pmod(F.xxhash64(F.lit(seed + 2), "s", "shard"), F.greatest(F.col("blocks"), F.lit(1))) * block)
    end = F.col("first") + F.col("rest") * block
    wrap = F.when(F.col("rest") > 0, F.greatest(F.lit(0), end - F.col("blocks") * block)).otherwise(0)
    inside = lambda x: F.least(F.greatest(x - F.col("begin"), F.lit(0)), F.col("size")).cast("bigint")
    out = line.withColumns({"from1": inside(F.col("first")), "to1": inside(F.when(F.col("rest") > 0, end).otherwise(F.col("first"))), "from2": F.lit(0).cast("bigint"), "to2": inside(wrap)})
    taken = F.col("passes") * F.col("size") + F.col("to1") - F.col("from1") + F.col("to2")
    out = out.withColumns({"target": F.col("target").cast("double"), "taken": taken.cast("bigint"), "passes": F.col("passes").cast("bigint")})
    return out.select("row.*", *(F.col(n).alias(prefix + n) for n in OUTPUTS)).drop("__none")


def apply_mix(mixed: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """The mixed rows with their decision in effect: one row per whole pass over a document and one per part of it, the text cut to the part's words and the white space before them."""
    size, passes, from1, to1, from2, to2 = (F.col(prefix + n) for n in ("size", *OUTPUTS[4:]))
    parts = F.filter(
        F.concat(
            F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(passes, F.lit(1))), lambda _: F.struct(F.lit(0).cast("bigint").alias("a"), F.when(passes > 0, size).otherwise(0).alias("z"))),
            F.array(F.struct(from1.alias("a"), to1.alias("z")), F.struct(from2.alias("a"), to2.alias("z"))),
        ),
        lambda p: p["z"] > p["a"],
    )
    cut = mixed.withColumn("__part", F.explode(parts))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    piece = F.array_join(F.slice(words, (F.col("__part.a") + 1).cast("int"), (F.col("__part.z") - F.col("__part.a")).cast("int")), "")
    whole = (F.col("__part.a") == 0) & (F.col("__part.z") == size)
    return cut.withColumn(text, F.when(whole, F.col(text)).otherwise(piece)).drop("__part", *(prefix + n for n in OUTPUTS))
