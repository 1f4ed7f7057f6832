"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share a multiple of all words; a
source's target stops at a multiple of its own size and the excess is shared again by weight.

Schedule: each source's documents, in a shuffled order that depends on the documents alone, form one
stream that is cut into blocks of equal numbers of words. Slot n of the schedule has the golden-ratio
point frac((n + 1/2) * phi); the interval of cumulative block quotas that holds it names the source, and
the slot's rank among the source's slots names the block (ranks run over the blocks again and again). A
source takes exactly its quota of slots: ranks beyond it are passed over, and the few that the sequence
still owes at its end are appended. Slots are part of the result: by them the mix has its order.

Scale: sums and ranks within a source run over hash buckets and slot chunks, with a running total over the
buckets only, so no task holds a source. Sources are dealt by ranges and numbered range by range, so no task
holds all of them either.

Defined results: a null text has size 0 and is never taken; a null source is a source; equal rows are
drawn one by one; an empty table, or one without words, gives targets of 0; other columns are not looked
at. Reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.support import free_name, materialize, running, word_count_expr, words_expr

PHI = 0.6180339887498949
_STEP = 1 << 20
#: frac(2**20 * phi), so that points keep their precision for any slot number
_FAR = 0.607787409740351


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = (5, 2, 1)
    #: Words of the mix for each word of the corpus.
    share: float = 1.5
    #: No source, and so no document, is taken more often.
    most: int = 2
    #: Words of a block; smaller for sources with fewer than least_blocks such blocks.
    block: int = 256
    least_blocks: int = 400
    #: Documents, or slots, that one task orders at a time (about).
    bucket: int = 50_000


def _targets(sized: DataFrame, s: Settings) -> DataFrame:
    """One row per source: sid (place by code point), its size, target, blocks, words of a block and quota of slots."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = running(per, [F.col("source").asc_nulls_last()], "sid")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in s.weights)), (F.pmod(F.col("sid"), F.lit(len(s.weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.lit(float(s.most)) * F.col("source_size"))
    sums = per.agg(F.sum("source_size").alias("n"), F.sum("w").alias("w")).first()
    per = running(per, [F.col("cap") / F.col("w"), F.col("sid")], "pos", capped="cap", spent="w")
    # level k: what a unit of weight gets if all sources with smaller cap / w are capped; the first that its own source does not reach holds
    level = (F.lit(float(sums["n"] or 0) * s.share) - F.col("capped")) / (F.lit(float(sums["w"] or 0)) - F.col("spent"))
    per = materialize(per.withColumn("level", level))
    found = per.agg(F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("pos", "level"))).alias("first")).first()["first"]
    unit = F.lit(None if found is None else found["level"]).cast("double")
    target = F.when(unit.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * unit))
    words = F.greatest(F.lit(1), F.least(F.lit(s.block), F.floor(F.col("source_size") / s.least_blocks))).cast("long")
    per = per.withColumns({"target": target, "words": words}).withColumn("blocks", F.ceil(F.col("source_size") / F.col("words")).cast("long"))
    return per.withColumn("quota", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), F.col("blocks") * s.most)).otherwise(0).cast("long")).select("source", "sid", "source_size", "target", "words", "blocks", "quota")


def schedule(targets: DataFrame, s: Settings) -> DataFrame:
    """(slot, sid, block) for every slot that is used; slots are placed by points, never listed on the driver."""
    spark = targets.sparkSession
    n, k = (int(x or 0) for x in targets.agg(F.sum("quota"), F.count("*")).first())
    cells = max(1, 4 * k)
    arcs = running(targets.filter("quota > 0"), [F.col("sid")], "place", before="quota")
    arcs = arcs.withColumn("hi", (F.col("before") + F.col("quota")) / float(max(1, n))).withColumn("lo", F.col("hi") - F.col("quota") / float(max(1, n)))
    # a source's arc is known in each grid cell that it touches, so points find their source by an equality
    in_cells = arcs.select("sid", "quota", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    slots = spark.range(n).select(F.col("id").alias("n"))
    point = F.col("n").cast("double") % _STEP * PHI + F.floor(F.col("n") / _STEP) * _FAR + 0.5 * PHI
    slots = slots.withColumn("x", point - F.floor(point)).withColumn("cell", F.least(F.floor(F.col("x") * cells), F.lit(cells - 1)))
    hit = slots.join(in_cells, "cell").filter("x >= lo AND x < hi").select("n", "sid", "quota", F.floor(F.col("n") / s.bucket).alias("chunk"))
    hit = materialize(hit)
    counts = hit.groupBy("sid", "chunk").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("sid", "chunk", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("offset"))
    ranked = hit.withColumn("r", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("n")) - 1).join(offsets, ["sid", "chunk"]).select("n", "sid", (F.col("r") + F.col("offset")).alias("rank"))
    got = hit.groupBy("sid").agg(F.count("*").alias("got"))
    owed = targets.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < quota").select("sid", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("rank"))
    owed = running(owed, [F.col("sid"), F.col("rank")], "n").select((F.col("n") + F.lit(n)).cast("long").alias("n"), "sid", "rank")
    taken = ranked.unionByName(owed).join(targets.select("sid", "quota", "blocks"), "sid").filter("rank < quota")
    return taken.select(F.col("n").alias("slot"), "sid", F.expr("rank % blocks").alias("block"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, source, text_key, size, source_size, target, taken, slots.

    slots: each slot that takes words of the document, and how many. taken is their sum, so it counts words with repeats. A document's taken words are whole copies of it and, at the one place
    where its source's last round of blocks ends, a first part of it.
    """
    s = settings
    c = lambda name: F.col(f"`{name}`")
    sized = materialize(docs.select(c(doc_id).cast("long").alias("doc_id"), c(source).cast("string").alias("source"), word_count_expr(c(text)).alias("size"), F.xxhash64(c(text)).alias("text_key")))
    targets = materialize(_targets(sized, s))
    slots = schedule(targets, s)
    rows = sized.count()
    buckets = max(1, 1 << (max(0, rows // s.bucket)).bit_length())
    order = F.xxhash64(F.lit("order"), "doc_id", "text_key")
    spread = sized.withColumns({"h": order}).withColumn("p", F.pmod(F.col("h"), F.lit(buckets)))
    by = targets.select(F.col("source").alias("of"), "sid", "source_size", "target", "words")
    spread = spread.join(by, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    sums = spread.groupBy("sid", "p").agg(F.sum("size").alias("c"))
    earlier = Window.partitionBy("sid").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "p", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "p").orderBy("h", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["sid", "p"]).withColumn("start", F.col("base") + F.col("inner"))
    placed = materialize(placed.select("doc_id", "source", "text_key", "size", "sid", "source_size", "target", "words", "start"))
    block = F.explode(F.sequence(F.expr("start div words"), F.expr("(start + size - 1) div words"))).alias("block")
    pieces = placed.filter("size > 0").select("sid", "start", "size", "words", block)
    length = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("words")) - F.greatest(F.col("start"), F.col("block") * F.col("words"))
    taken = pieces.join(slots, ["sid", "block"]).groupBy("sid", "start").agg(F.sum(length).alias("taken"), F.array_sort(F.collect_list(F.struct("slot", length.alias("words")))).alias("slots"))
    # (sid, start) is one document among those with words; those without take no part
    worded = placed.filter("size > 0").join(taken, ["sid", "start"], "left")
    out = worded.unionByName(placed.filter("size = 0").withColumns({"taken": F.lit(0).cast("long"), "slots": F.array().cast("array<struct<slot:bigint,words:bigint>>")}))
    return out.select("doc_id", "source", "text_key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.array().cast("array<struct<slot:bigint,words:bigint>>")).alias("slots"))


def first_words(text: Column, n: Column) -> Column:
    return F.array_join(F.slice(words_expr(text), 1, n.cast("int")), " ")


def apply_mix(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents as the mix takes them: each whole copy a row, and a row with its first words where a part is taken."""
    names = {n: free_name(docs, n) for n in ("mix_id_", "mix_key_", "mix_taken_", "mix_size_", "mix_copy_")}
    # equal rows are interchangeable: they share what was taken of them
    plan = mixed.groupBy("doc_id", "text_key").agg(F.expr("sum(taken) div count(*)").alias(names["mix_taken_"]), F.max("size").alias(names["mix_size_"]))
    plan = plan.filter(F.col(names["mix_taken_"]) > 0).select(F.col("doc_id").alias(names["mix_id_"]), F.col("text_key").alias(names["mix_key_"]), names["mix_taken_"], names["mix_size_"])
    taken, size, copy = (F.col(names[n]) for n in ("mix_taken_", "mix_size_", "mix_copy_"))
    key = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(names["mix_id_"])) & F.xxhash64(F.col(f"`{text}`")).eqNullSafe(F.col(names["mix_key_"]))
    joined = docs.join(plan, key).withColumn(names["mix_copy_"], F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(taken / size).cast("long"))))
    cut = F.when(copy * size <= taken, F.col(f"`{text}`")).otherwise(first_words(F.col(f"`{text}`"), taken - (copy - 1) * size))
    columns = [cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    out = joined.select(*columns)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(F.col(f"`{text}`")).cast(docs.schema[n_chars].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
