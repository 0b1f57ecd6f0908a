"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopflow.llm.frames import stored

# Documents of one source that go out together.
BLOCK = 32
# Slots of one period of the schedule; weights are whole multiples of 1 / FRAME.
FRAME = 4_000
# Without explicit weights a source gets its share of the documents, but no more than this.
MAX_SHARE = 0.25
# Rows that a window numbers in one task.
NUMBERED_TOGETHER = 5_000

_SIMULATE = """
if(size(shares) = 0, cast(array() as array<int>), aggregate(sequence(0, frame - 1), named_struct('a', array_repeat(0L, size(shares)), 'out', cast(array() as array<int>)),
  (st, t) -> element_at(transform(array(
      array_min(transform(filter(sequence(0, size(shares) - 1), s -> st.a[s] < get(shares, s) and (st.a[s] * frame) div get(shares, s) <= t),
                          s -> struct(((st.a[s] + 1) * frame + get(shares, s) - 1) div get(shares, s) as deadline, s as s))).s),
      p -> named_struct('a', transform(st.a, (x, i) -> if(i = p, x + 1, x)), 'out', array_append(st.out, p))), 1)).out)
"""


def schedule(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", block: int = BLOCK, frame: int = FRAME, max_share: float = MAX_SHARE) -> DataFrame:
    """One row (_source, supply, share, frame, slots, favoured, quota) per source.

    Block i of a source with weight w is released at floor((i - 1) / w) and due
    at ceil(i / w); in every slot the released block with the earliest deadline
    goes out (ties: by the order of names). The weights add up to one, so no
    deadline is missed and every source stays within one block of its weight at
    any time. Weights are rounded to shares of a frame, after which all
    releases and deadlines repeat; only that one frame is simulated, in a single
    row of at most `frame` numbers, whatever the size of the corpus. `slots`
    holds the slots of a source within the frame. Sources without a positive
    weight have a share of 0. At most `frame` sources can be mixed.

    `quota` is the number of documents of a source that the stream takes. In
    fluid time, by the weights before they are rounded, a source is used up
    after supply / weight documents of the stream; the stream ends with the last
    favoured source, and the others get their weight of that length. So neither
    blocks nor the frame change the mixture.
    """
    supply = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("supply"))
    if weights is None:
        total = supply.agg(F.sum("supply")).scalar()
        rated = supply.withColumn("w", F.least(F.col("supply") / total, F.lit(max_share)))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(w)
        rated = supply.withColumn("w", w)
    rated = stored(rated, "sources")
    whole, all_docs = rated.where("w > 0").agg(F.sum("w")).scalar(), rated.where("w > 0").agg(F.sum("supply")).scalar()
    shares = rated.withColumn("share", F.when(F.col("w") > 0, F.greatest(F.lit(1), F.round(F.col("w") / whole * frame))).otherwise(F.lit(0)).cast("long")) \
        .withColumn("favoured", F.col("w") / whole >= F.col("supply") / all_docs * (1 - 1e-9))
    length = shares.where("share > 0 AND favoured").agg(F.max(F.col("supply") / F.col("w"))).scalar()
    due = F.ceil(F.coalesce(length, F.lit(0.0)) * F.col("w") * (1 - 1e-9))
    shares = shares.withColumn("quota", F.when(F.col("favoured"), F.col("supply")).otherwise(F.least(F.col("supply"), due)).cast("long"))
    row = shares.where("share > 0").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_source", F.lit("")).alias("name"), F.col("_source").isNull().alias("nil"), F.col("share")))).alias("sources"))
    row = row.withColumn("sources", F.when(F.size("sources") <= frame, F.col("sources")).otherwise(F.raise_error(F.lit(f"more than {frame} sources: raise frame"))))
    row = row.withColumn("shares", F.expr("transform(sources, s -> s.share)")).withColumn("frame", F.expr("aggregate(shares, 0L, (a, x) -> a + x)"))
    slots = row.where("frame > 0").withColumn("picked", F.expr(_SIMULATE)).select("sources", "frame", F.posexplode("picked").alias("slot", "s"))
    slots = slots.groupBy(F.expr("if(sources[s].nil, null, sources[s].name)").alias("_source"), "frame").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    out = shares.join(slots.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left")
    return stored(out.select("_source", "supply", "share", "favoured", "quota", "frame", "slots", F.lit(block).alias("block")), "schedule")


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", doc_id: str = "doc_id", block: int = BLOCK, frame: int = FRAME, max_share: float = MAX_SHARE) -> DataFrame:
    """Adds to every document its `block_no` within the source, `slot`, `place`
    in the block, `release`, `deadline` and `scheduled`; columns of these names
    are replaced. The stream is the documents by (slot, place).

    The stream takes every source whole that the weights favour (weight not below
    its share of the documents), and of the others as many documents as their
    weights are worth beside these (`quota`); what they have beyond that, and
    sources without weight, have scheduled = false.
    Within a source documents go by a hash of the id, equal ids next to each
    other in any order. A null source is a source of its own. Empty tables give
    empty results; the text is never looked at.

    Documents are numbered per (source, part), parts holding about
    NUMBERED_TOGETHER rows each, so no source is gathered in one task. The
    table of sources has at most `frame` rows and numbers, so it is broadcast.
    """
    added = ("block_no", "slot", "place", "release", "deadline", "scheduled")
    docs = docs.drop(*added, *[c for c in docs.columns if c.startswith("_pf_")])
    plan = schedule(docs, weights, source, block, frame, max_share)
    plan = F.broadcast(plan.select(*[F.col(c).alias(f"_pf_{c.lstrip('_')}") for c in plan.columns]))
    mine = F.col(source).eqNullSafe(F.col("_pf_source"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_pf_supply") / NUMBERED_TOGETHER)).cast("long")
    rows = docs.join(plan, mine).withColumn("_pf_h", F.xxhash64(F.col(doc_id))).withColumn("_pf_part", F.pmod("_pf_h", parts))
    ahead = stored(rows.groupBy("_pf_source", "_pf_part").agg(F.count("*").alias("n")), "parts")
    before = Window.partitionBy("_pf_source").orderBy("_pf_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = ahead.select(F.col("_pf_source").alias("_pf_s"), F.col("_pf_part").alias("_pf_p"), (F.sum("n").over(before) - F.col("n")).alias("_pf_ahead"))
    within = Window.partitionBy("_pf_source", "_pf_part").orderBy("_pf_h", doc_id)
    # the table of sources is joined again behind the window, so that its arrays are not shuffled
    slim = rows.select(*docs.columns, "_pf_source", "_pf_part", "_pf_h").withColumn("_pf_row", F.row_number().over(within))
    numbered = slim.join(ahead, F.col("_pf_source").eqNullSafe(F.col("_pf_s")) & (F.col("_pf_part") == F.col("_pf_p"))).select(
        *docs.columns, (F.col("_pf_ahead") + F.col("_pf_row") - 1).alias("_pf_n"))

    def when_shared(sql: str):
        return F.expr(f"if(_pf_share > 0, {sql}, null)")

    timed = numbered.join(plan, mine).withColumn("block_no", F.expr("_pf_n div _pf_block")).withColumn("place", F.expr("cast(_pf_n % _pf_block as int)"))
    timed = timed.withColumn("slot", when_shared("block_no div _pf_share * _pf_frame + _pf_slots[cast(block_no % _pf_share as int)]"))
    timed = timed.withColumn("release", when_shared("block_no * _pf_frame div _pf_share")).withColumn("deadline", when_shared("((block_no + 1) * _pf_frame + _pf_share - 1) div _pf_share"))
    return timed.withColumn("scheduled", F.expr("_pf_share > 0 AND _pf_n < _pf_quota")).select(*docs.columns, *added)
