"""Mixing of sources to target weights by pivotal dependent rounding, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import materialize, spread
from docmill.operators.clean import let

#: Documents that meet in one fold, and how many of a size class are left to the last one.
BLOCK, LEFT = 64, 32
SPACE = "\\x20\\x09-\\x0D"
ITEM = "struct<key:bigint,doc_id:bigint,text_key:bigint,size:bigint,whole:bigint,mass:double>"


def words(text: Column) -> Column:
    """How many runs of other characters than ASCII white space a text has; null has none. The memory it takes is a text's."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, f"[^{SPACE}]+", "x"), " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """sizes (source, source_size) with `target` and `rate`, its part of source_size.

    Sources are numbered by code point, null last, in ranges of them, so that no task sees all.
    A target is the smaller of `most` times the source's size and `level` times its weight;
    `level` is raised until the targets make up `share` of all sizes, as resharing the excess does.
    """
    ranged = materialize(sizes.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    number = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number % len(weights) + 1).cast("int"))
    ranked = materialize(ranged.join(F.broadcast(counts), "part").select("source", "source_size", weight.alias("weight")), "mix-weights")
    level, most_of = 0.0, F.col("source_size") * float(most)
    while True:
        capped = most_of <= F.col("weight") * level
        r = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)), F.sum(F.when(~capped, F.col("weight")))).first()
        if not r[2] or (raised := (share * r[0] - most * r[1]) / r[2]) <= level:
            break
        level = raised
    target = F.least(most_of, F.col("weight") * level)
    rate = F.when(F.col("source_size") == 0, 0.0).when(most_of <= F.col("weight") * level, float(most)).otherwise(target / F.col("source_size"))
    return ranked.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _folded(items: Column, draw: Column) -> Column:
    """(kept, decided) of an array of items: each meets the one that is still open and mass moves between them, up or down with the chances that keep both means, until one has none or is full."""

    def step(state: Column, new: Column) -> Column:
        def meet(d: Column) -> Column:
            old, up, down = state["kept"], d["up"], d["down"]
            rises = F.pmod(F.xxhash64(draw, old["key"], new["key"]), F.lit(1 << 40)) / float(1 << 40) * (up + down) < down
            moved = F.when(rises, up).otherwise(-down)
            old_ends = F.when(rises, up == old["size"] - old["mass"]).otherwise(down == old["mass"])
            ended = F.when(rises, old["size"].cast("double")).otherwise(0.0)
            met = F.struct(
                F.when(old_ends, new.withField("mass", new["mass"] - moved)).otherwise(old.withField("mass", old["mass"] + moved)).alias("kept"),
                F.when(old_ends, old.withField("mass", ended)).otherwise(new.withField("mass", F.when(rises, 0.0).otherwise(new["size"].cast("double")))).alias("done"),
            )
            return let(met, lambda m: F.struct(m["kept"].alias("kept"), F.concat(state["decided"], F.array(m["done"])).alias("decided")))

        old = state["kept"]
        room = F.struct(F.least(old["size"] - old["mass"], new["mass"]).alias("up"), F.least(old["mass"], new["size"] - new["mass"]).alias("down"))
        return F.when(old.isNull(), F.struct(new.alias("kept"), state["decided"].alias("decided"))).otherwise(let(room, meet))

    start = F.struct(F.lit(None).cast(ITEM).alias("kept"), F.array().cast(f"array<{ITEM}>").alias("decided"))
    return F.aggregate(items, start, step)


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """How often each row of docs (doc_id, text, source) goes into a mix of its sources.

    Sources, by code point and null last, have the weights in turn and share `share` times all
    words; a target stops at `most` times its source's words and the excess is shared again. A
    document's mean number of copies is its source's target over its source's words: the whole
    part is taken as it is, the fraction is rounded by pivotal dependent rounding.

    Returns doc_id long, source string, text_key long (hash of the text), size long (words),
    source_size long, target double, copies long, taken long (copies times size).

    Method: two documents with open fractions meet, and words of mean mass are moved from one
    to the other, in a random direction with chances that leave both means as they are, until
    one of them is taken or left whole; the other stays open. The sum of words over both is the
    same before and after, so a source's taken words differ from its target by what the one
    last open document is rounded by. Documents are dealt to blocks of about 64 by hash within
    their source and size class (powers of two); the open ones of 64 blocks meet in the next
    level, until each size class has 32 to 64. These meet in one last fold for each source,
    largest first, so what stays open at the end is among the smallest. Draws are hashes of
    the documents that meet, so reruns agree, whatever the partitions.

    Edge cases: a null text has no words, is taken no times more than the whole part of its
    mean and moves no mass; a null source is a source; null and repeated doc_ids are documents
    of their own; rows that are equal in doc_id, source and text get copies of their own but
    can't be told apart; an empty table gives an empty result; a text of any length is
    counted whole.

    Scale: texts are read once. Equal rows are added up before the shuffle and dealt out again
    in runs, so neither a hot source nor a hot row makes a large task; a fold sees about 64
    documents, the last one at most 64 for each size class.
    """
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), words(F.col("text").cast("string")).alias("size"))
    rows = materialize(counted.groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").alias("n")), "mix-rows")
    sources = source_targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    sources = materialize(sources, "mix-targets")
    runs = spread(rows.withColumn("run", F.explode(F.expr("sequence(0L, (n - 1) div 4096)"))))
    single = runs.withColumn("copy", F.explode(F.expr("sequence(run * 4096, least(n - 1, run * 4096 + 4095))")))
    at = single.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    mean = at.select("source", F.xxhash64(F.lit(seed), "doc_id", "source", "text_key", "copy").alias("key"), "doc_id", "text_key", "size", "rate", F.floor("rate").alias("whole"))
    item = mean.select("source", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")))).cast("int").alias("class"), F.struct("key", "doc_id", "text_key", "size", F.col("whole").cast("long").alias("whole"), ((F.col("rate") - F.col("whole")) * F.col("size")).alias("mass")).cast(ITEM).alias("item"))
    still = (F.col("item.mass") > 0) & (F.col("item.mass") < F.col("item.size"))
    item = materialize(item, "mix-items")
    done, open_, level = [item.where(~still).select("source", "item")], item.where(still), 0
    sized = open_.groupBy("source", "class").agg(F.count("*").alias("open"))
    blocks = F.greatest(F.lit(LEFT), F.ceil(F.col("open") / BLOCK)).cast("long")
    sized = materialize(sized.select(F.col("source").alias("of"), F.col("class").alias("of_class"), F.when(F.col("open") > BLOCK, blocks).alias("blocks")), "mix-blocks")
    own = F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class"))
    placed = open_.join(sized, own).select("source", "class", "item", "blocks", F.expr("pmod(xxhash64('block', item.key), blocks)").alias("block"))
    last = [placed.where(F.col("blocks").isNull()).select("source", "class", "item")]
    placed = placed.where(F.col("blocks").isNotNull())
    while True:
        meet = placed.groupBy("source", "class", "block").agg(F.first("blocks").alias("blocks"), F.sort_array(F.collect_list("item")).alias("items"))
        folded = materialize(meet.select("source", "class", "block", "blocks", _folded(F.col("items"), F.lit(f"{seed}:{level}")).alias("fold")), f"mix-level-{level}")
        done.append(folded.select("source", F.explode("fold.decided").alias("item")))
        kept = folded.select("source", "class", "block", "blocks", F.col("fold.kept").alias("item"))
        done.append(kept.where(~still).select("source", "item"))
        kept = kept.where(still)
        last.append(kept.where(F.col("blocks") <= BLOCK).select("source", "class", "item"))
        placed, level = kept.where(F.col("blocks") > BLOCK), level + 1
        if placed.isEmpty():
            break
        fewer = F.greatest(F.lit(LEFT), F.ceil(F.col("blocks") / BLOCK)).cast("long")
        placed = placed.withColumn("block", F.col("block") % fewer).withColumn("blocks", fewer)
    rest = last[0]
    for more in last[1:]:
        rest = rest.unionByName(more)
    order = F.sort_array(F.collect_list(F.struct((-F.col("item.size")).alias("by"), "item")))
    final = rest.groupBy("source").agg(F.transform(order, lambda x: x["item"]).alias("items")).select("source", _folded(F.col("items"), F.lit(f"{seed}:last")).alias("fold"))
    final = materialize(final, "mix-last")
    done.append(final.select("source", F.explode("fold.decided").alias("item")))
    full = F.pmod(F.xxhash64(F.lit(f"{seed}:end"), F.col("fold.kept.key")), F.lit(1 << 40)) / float(1 << 40) * F.col("fold.kept.size") < F.col("fold.kept.mass")
    done.append(final.where(F.col("fold.kept").isNotNull()).select("source", F.col("fold.kept").withField("mass", F.when(full, F.col("fold.kept.size").cast("double")).otherwise(0.0)).alias("item")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("item.whole") + F.when((F.col("item.mass") > 0) & (F.col("item.size") > 0), 1).otherwise(0)
    out = out.select(F.col("item.doc_id").alias("doc_id"), "source", F.col("item.text_key").alias("text_key"), F.col("item.size").alias("size"), copies.alias("copies"))
    out = out.join(sources.select(F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of")))
    return out.select("doc_id", "source", "text_key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The mixed documents: doc_id, source and text, as often as mix (of mix_sources) says; equal rows of docs are one text with all their copies."""
    copies = mix.groupBy("doc_id", "source", "text_key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    copies = copies.select(F.col("doc_id").alias("of_doc"), F.col("source").alias("of"), F.col("text_key").alias("of_text"), F.explode(F.expr("sequence(1L, copies, 4096L)")).alias("first"), "copies")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).dropDuplicates()
    same = F.xxhash64("text").eqNullSafe(F.col("of_text")) & F.col("doc_id").eqNullSafe(F.col("of_doc")) & F.col("source").eqNullSafe(F.col("of"))
    return texts.join(copies, same).select("doc_id", "source", "text", F.explode(F.expr("sequence(first, least(copies, first + 4095))")).alias("copy"))
