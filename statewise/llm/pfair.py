"""Mixing sources to target weights by Pfair scheduling.

Time runs in slots of one block. In a stretch of L slots a source with c blocks
has the weight c / L: its block k is released at floor(k L / c) and due at
ceil((k + 1) L / c). Serving the released block that is due first (earliest
deadline) meets all deadlines, so after any slot each source has had its share
to within less than one block.

A frame holds ``frame`` blocks, dealt to the sources by their weights. Frame
after frame looks alike until a source runs out, so one schedule is made for
each kind of frame, of which there are at most twice as many as sources, and
every block finds its slot by arithmetic. When a source is used up, the others
go on in their proportions: no row is dropped or repeated.

``mixed`` rounds the weights to whole blocks of a frame, in DataFrame operations
only, so a source keeps to its rounded share. ``exactly_mixed`` has no frames and
keeps each source within one block of its weight as given, over the whole run.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewise.llm.common import numbered, written

FRAME = 200  # blocks of a frame while all sources last
ROWS_PER_BUCKET = 20_000
BROADCAST_ROWS = 200_000  # of a schedule, about 60 bytes each
WEIGHT_BITS = 60  # of the largest weight as a whole number
SERVED = 1 << 16  # slots of a batch


def ranked(df: DataFrame, by: list[str], order: list[Column], spread: Column) -> DataFrame:
    """``df`` with ``_rank``, the place (from 0) of a row among the rows of equal ``by`` in the
    order of ``spread``, a text of hexadecimal digits, then ``order``.

    Rows are cut into buckets by the leading digits of ``spread``, as many as the
    counted rows need, so that no key of ``by`` meets in one task.
    """
    digits = 0
    n = df.count()
    while ROWS_PER_BUCKET * 16**digits < n:
        digits += 1
    cut = df.withColumn("_spread", spread).withColumn("_bucket", F.substring("_spread", 1, digits) if digits else F.lit(""))
    sizes = cut.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_spread", *order))
    return cut.withColumn("_inside", inside).join(starts, [*by, "_bucket"]).withColumn("_rank", F.col("_start") + F.col("_inside") - 1).drop("_spread", "_bucket", "_inside", "_start")


def frame_shares(sources: DataFrame, frame: int) -> DataFrame:
    """``sources`` (_source, _weight, _blocks) with ``_share``, the whole blocks of each in a
    frame: the weights' shares rounded by largest remainders, one at least."""
    one = Window.partitionBy()  # one row for each source
    exact = F.col("_weight") / F.sum("_weight").over(one) * frame
    floors = sources.withColumn("_exact", exact).withColumn("_floor", F.greatest(F.floor("_exact"), F.lit(1)).cast("long"))
    place = F.row_number().over(one.orderBy(F.desc(F.col("_exact") - F.col("_floor")), "_source"))
    spare = F.lit(frame) - F.sum("_floor").over(one)
    return floors.withColumn("_share", F.col("_floor") + F.when(place <= spare, 1).otherwise(0)).select("_source", "_blocks", "_share")


def slots(counts: Column) -> Column:
    """Earliest-deadline-first schedule of one frame: which source (place in ``counts``) each slot serves.

    ``counts``: blocks of each source in the frame; the frame has as many slots
    as blocks. Ties of deadlines go to the earlier place.
    """
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(F.transform(counts, lambda c: F.lit(0).cast("long")).alias("done"), F.array().cast("array<long>").alias("out"))

    def serve(state, slot):
        done = state["done"]
        due = F.transform(
            F.arrays_zip(done.alias("d"), counts.alias("c")),
            lambda x, i: F.when(
                (x["d"] < x["c"]) & (F.floor(x["d"] * total / F.greatest(x["c"], F.lit(1))) <= slot),
                F.struct(F.ceil((x["d"] + 1) * total / x["c"]).cast("long").alias("due"), i.cast("long").alias("at")),
            ),
        )
        chosen = F.array_min(due)["at"]
        return F.struct(F.transform(done, lambda d, i: d + F.when(i == chosen, 1).otherwise(0)).alias("done"), F.concat(state["out"], F.array(chosen)).alias("out"))

    return F.when(total > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), total - 1), start, serve)["out"])


def sized(df: DataFrame) -> DataFrame:
    """A small table, marked for broadcast if its counted rows are few; else any join will do."""
    kept = written(df, "schedule")
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def mixed(df: DataFrame, weights: DataFrame, block: int = 1, frame: int = FRAME, source_column: str = "source", id_column: str = "doc_id", weight_column: str = "weight") -> DataFrame:
    """``df`` with ``mix_frame``, ``mix_slot`` and ``mix_within``: the order of the mixture.

    Rows of a source are shuffled by a hash of their id and cut into blocks of
    ``block`` rows. ``mix_slot`` (from 0) is the slot of a row's block and belongs
    to no other block; ``mix_within`` (from 0) orders the rows of a block. ``weights``
    has a positive weight for each source; a source without one, or with a null or
    non-positive one, gets the smallest weight there is (1 if there is none).
    Rows with a null source form a source of their own. A null id counts as
    empty; repeated ids are ordered by the text of their columns, and wholly
    equal rows may change places. Columns of ``df`` named like those of the
    result are replaced. An empty table gives an empty result.
    """
    names = [c for c in df.columns if c.lower() not in ("mix_frame", "mix_slot", "mix_within")]
    own = [f"c{i}" for i in range(len(names))]  # whatever the columns are called
    named = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n")).alias("_source")
    rows = df.select(*names).toDF(*own)
    rows = rows.select(*own, named(own[names.index(source_column)]))
    id_place = own[names.index(id_column)]
    tie = F.md5(F.to_json(F.struct(*[F.col(c) for c in own])).cast("binary"))
    given = weights.select(named(source_column), F.col(weight_column).cast("double").alias("_weight"))
    given = given.where("_weight > 0 and _weight < double('infinity')").groupBy("_source").agg(F.max("_weight").alias("_weight"))
    blocks = rows.groupBy("_source").agg(F.ceil(F.count("*") / block).cast("long").alias("_blocks"))
    least = F.coalesce(F.min("_weight").over(Window.partitionBy()), F.lit(1.0))
    known = blocks.join(given, "_source", "left").withColumn("_weight", F.coalesce("_weight", least))
    shares = sized(frame_shares(known, frame))

    # kinds of frames: the blocks that a frame holds change where a source is in its last frame, or gone
    listed = shares.agg(F.array_sort(F.collect_list(F.struct("_source", "_share", "_blocks"))).alias("_all"))  # an entry for each source
    whole = lambda x: F.floor(x["_blocks"] / x["_share"]).cast("long")
    ends = F.flatten(F.transform("_all", lambda x: F.array(whole(x), F.ceil(x["_blocks"] / x["_share"]).cast("long"))))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), ends)))
    kinds = listed.withColumn("_cuts", cuts).select("_all", F.explode(F.arrays_zip(F.col("_cuts").alias("a"), F.slice("_cuts", 2, F.size("_cuts")).alias("b"))).alias("_x"))
    kinds = kinds.where("_x.b is not null").select("_all", F.col("_x.a").alias("_from"), F.col("_x.b").alias("_to")).repartition("_from")
    counts = F.transform("_all", lambda x: F.least(x["_share"], F.greatest(x["_blocks"] - F.col("_from") * x["_share"], F.lit(0).cast("long"))))
    made = written(kinds.withColumn("_slots", slots(counts)).withColumn("_length", F.size("_slots").cast("long")), "kinds")
    earlier = Window.partitionBy().orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)  # two kinds for each source at most
    based = made.withColumn("_base", F.coalesce(F.sum((F.col("_to") - F.col("_from")) * F.col("_length")).over(earlier), F.lit(0)))
    each = based.select("_from", "_to", "_length", "_base", "_all", F.posexplode("_slots").alias("_slot", "_place"))
    each = each.withColumn("_source", F.element_at("_all", (F.col("_place") + 1).cast("int"))["_source"])
    nth = F.row_number().over(Window.partitionBy("_from", "_source").orderBy("_slot")) - 1
    each = sized(each.select("_from", "_to", "_length", "_base", "_source", F.col("_slot").cast("long").alias("_slot"), nth.cast("long").alias("_nth")))

    # each block finds its frame, the kind of the frame and its slot in it
    placed = ranked(rows, ["_source"], [tie], F.md5(F.coalesce(F.col(id_place).cast("string"), F.lit("")).cast("binary")))
    placed = placed.withColumn("_block", F.floor(F.col("_rank") / block).cast("long")).join(shares.select("_source", "_share"), "_source")
    placed = placed.withColumn("mix_frame", F.floor(F.col("_block") / F.col("_share")).cast("long")).withColumn("_nth", F.col("_block") % F.col("_share"))
    found = placed.join(each, ["_source", "_nth"]).where("mix_frame >= _from and mix_frame < _to")
    slot = F.col("_base") + (F.col("mix_frame") - F.col("_from")) * F.col("_length") + F.col("_slot")
    return found.select(*own, "mix_frame", slot.alias("mix_slot"), (F.col("_rank") % block).alias("mix_within")).toDF(*names, "mix_frame", "mix_slot", "mix_within")


def served(weights: list[float], blocks: list[int]) -> Iterator[tuple[int, int]]:
    """(source, block) of each slot: earliest deadline first over the whole run, by the weights as
    they are. After t slots since a source last ran out, each source that is left has had its
    weight's part of t to within less than one block; ties go to the earlier source."""
    most = max(weights, default=1.0)
    whole = [max(int(w / most * (1 << WEIGHT_BITS)), 1) for w in weights]
    done, left = [0] * len(blocks), {i for i, n in enumerate(blocks) if n > 0}
    while left:
        total = sum(whole[i] for i in left)
        from_block = done.copy()
        waiting, ready, slot = [], [(-(-total // whole[i]), i) for i in left], 0
        heapq.heapify(ready)
        while True:
            while waiting and waiting[0][0] <= slot:
                i = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (-(-(done[i] - from_block[i] + 1) * total // whole[i]), i))
            i = heapq.heappop(ready)[1]
            yield i, done[i]
            done[i] += 1
            slot += 1
            if done[i] == blocks[i]:
                left.remove(i)
                break
            heapq.heappush(waiting, ((done[i] - from_block[i]) * total // whole[i], i))


def exactly_mixed(df: DataFrame, weights: DataFrame, block: int = 1, frame: int = FRAME, source_column: str = "source", id_column: str = "doc_id", weight_column: str = "weight") -> DataFrame:
    """As ``mixed``, by the weights as given: no source is ever a block or more from its part.

    Deadlines follow from all blocks before, so one task makes the schedule, a row
    for each block, in memory that grows with the sources only; ranks and rows are
    spread as ever. ``mix_frame`` counts stretches of ``frame`` slots.
    """
    names = [c for c in df.columns if c.lower() not in ("mix_frame", "mix_slot", "mix_within")]
    own = [f"c{i}" for i in range(len(names))]  # whatever the columns are called
    named = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n")).alias("_source")
    rows = numbered(df.select(*names).toDF(*own), *own)
    tie = F.md5(F.to_json(F.struct(*[F.col(c) for c in own])).cast("binary")).alias("_tie")
    spread = F.md5(F.coalesce(F.col(own[names.index(id_column)]).cast("string"), F.lit("")).cast("binary")).alias("_order")
    slim = written(rows.select("_row", named(own[names.index(source_column)]), spread, tie), "slim")
    given = weights.select(named(source_column), F.col(weight_column).cast("double").alias("_weight"))
    given = given.where("_weight > 0 and _weight < double('infinity')").groupBy("_source").agg(F.max("_weight").alias("_weight"))
    blocks = slim.groupBy("_source").agg(F.ceil(F.count("*") / block).cast("long").alias("_blocks"))
    least = F.coalesce(F.min("_weight").over(Window.partitionBy()), F.lit(1.0))
    known = blocks.join(given, "_source", "left").withColumn("_weight", F.coalesce("_weight", least))
    listed = known.agg(F.array_sort(F.collect_list(F.struct("_source", "_weight", "_blocks"))).alias("_all"))  # an entry for each source

    def schedule(batches):
        for batch in batches:
            for entries in batch.column(0).to_pylist():
                source, nth = [], []
                slot = 0
                for i, k in served([e["_weight"] for e in entries], [e["_blocks"] for e in entries]):
                    source.append(entries[i]["_source"]), nth.append(k)
                    if len(nth) == SERVED:
                        yield pa.RecordBatch.from_arrays([pa.array(source), pa.array(nth), pa.array(range(slot, slot + SERVED))], names=["_source", "_block", "_slot"])
                        slot += SERVED
                        source, nth = [], []
                if nth:
                    yield pa.RecordBatch.from_arrays([pa.array(source), pa.array(nth), pa.array(range(slot, slot + len(nth)))], names=["_source", "_block", "_slot"])

    slots_of = written(listed.mapInArrow(schedule, "_source string, _block long, _slot long"), "schedule")
    placed = ranked(slim, ["_source"], [F.col("_tie")], F.col("_order")).withColumn("_block", F.floor(F.col("_rank") / block).cast("long"))
    placed = placed.join(slots_of, ["_source", "_block"])
    placed = placed.select("_row", F.floor(F.col("_slot") / frame).cast("long").alias("mix_frame"), F.col("_slot").alias("mix_slot"), (F.col("_rank") % block).alias("mix_within"))
    return rows.join(placed, "_row").select(*own, "mix_frame", "mix_slot", "mix_within").toDF(*names, "mix_frame", "mix_slot", "mix_within")


def tempered(df: DataFrame, alpha: float = 0.5, source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(source, weight): target weights from the characters of each source to the power ``alpha``."""
    size = F.sum(F.coalesce(F.length(text_column), F.lit(0)))
    return df.groupBy(source_column).agg(size.alias("_size")).select(source_column, F.pow(F.greatest(F.col("_size"), F.lit(1)).cast("double"), alpha).alias("weight"))
