"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots, each for one block of equally many words. Slot i reads the i-th point of the golden-
ratio (or van der Corput) sequence and gives the slot to the source whose range of cumulative weights holds it, so that
any stretch of slots is close to the target proportions. Within a source the slots are ranked, and rank r reads block
r of the source's shuffled documents laid end to end, beginning again when all blocks are used. The last rank of a
source reads only what is left of its target; a source that the points gave too few slots for it has the missing ones at the
end. Documents meet the ranks by a join on their blocks. All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trilattice.llm.common import WORD, quoted, table
from trilattice.session import discard, stored

#: 2**32 divided by the golden ratio, odd: multiples of it modulo 2**32 are the golden-ratio points. A fixed value.
GOLDEN, MODULUS = 2654435769, 1 << 32
#: Words of a block.
BLOCK, CAP, WEIGHTS, SEED = 256, 3, (1, 2, 3), "mix"
#: Leading bits of a point by which slots meet the ranges of sources, and slots ranked by one window.
CELL_BITS, RUN = 10, 1 << 16


def n_words(text: str = "text"):
    """Words of a text, null as none."""
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, weight, target, from, to of a table (source, source_size) with a row per source.

    Sources are ordered by code point, null last, and weigh `weights` in turn. The total of all sizes is shared by
    weight; no target exceeds `cap` times its source's size, and what is above is shared among the others again.
    The end of that is one water level: in the order of size by weight, the first k sources are at their cap, for the
    least k at which the level of the rest overflows none. from and to are the source's range of 32-bit points.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(0))
    level = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum(F.col("source_size") * cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("open"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("source_size") * cap)
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("capped"), F.col("level")))).over(everything)["level"])
    )
    wanted = F.least(F.col("level") * F.col("weight"), (F.col("source_size") * cap).cast("double"))
    out = level.withColumn("target", F.coalesce(wanted, (F.col("source_size") * cap).cast("double")))
    upto = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    edge = F.when(F.col("total") > 0, F.floor(upto / F.col("total") * MODULUS)).otherwise(F.lit(0))
    out = out.withColumn("to", F.when(F.lead("weight").over(by_name).isNull(), F.lit(MODULUS)).otherwise(F.least(edge, F.lit(MODULUS))).cast("long"))
    return out.withColumn("from", F.coalesce(F.lag("to").over(by_name), F.lit(0)).cast("long")).select("source", "source_size", "weight", "target", "from", "to", "total")


def point(i, sequence: str = "golden"):
    """The i-th point of a low-discrepancy sequence as a 32-bit integer; both repeat after 2**32 points."""
    i = F.pmod(i.cast("long"), F.lit(MODULUS))
    if sequence == "golden":
        # by halves of i, as no product may pass 63 bits
        high = (F.shiftright(i, 16) * GOLDEN) % MODULUS
        return (high * (1 << 16) + i.bitwiseAND(F.lit(0xFFFF)) * GOLDEN) % MODULUS
    return F.conv(F.reverse(F.lpad(F.bin(i), 32, "0")), 2, 10).cast("long")


def place_slots(plan: DataFrame, slots: int, sequence: str = "golden") -> DataFrame:
    """(slot, source) for every slot, by an equi-join on the leading bits of its point.

    A range is repeated for each cell it touches, which makes a row per source and 1,024 more in all; Spark broadcasts
    that table only if its known size is below its own threshold.
    """
    shift = 32 - CELL_BITS
    given = plan.sparkSession.range(slots).select(F.col("id").alias("slot"), point(F.col("id"), sequence).alias("at")).withColumn("cell", F.shiftright("at", shift))
    ranges = plan.where("to > from").select("source", "from", "to", F.explode(F.sequence(F.shiftright("from", shift), F.shiftright(F.col("to") - 1, shift))).alias("cell"))
    return given.join(ranges, "cell").where("at >= from and at < to").select("slot", "source")


def ranks(plan: DataFrame, slots: int, sequence: str = "golden") -> DataFrame:
    """(slot, key, rank): the slots of each source numbered from 0.

    Slots are counted by runs of 65,536, and each run is numbered on its own, so that no task holds a source.
    """
    placed = place_slots(plan, slots, sequence).select("slot", _source_key().alias("key"), F.floor(F.col("slot") / RUN).alias("run"))
    counts = placed.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    opened = counts.select("key", "run", F.coalesce(before, F.lit(0)).alias("opens"))
    inside = F.row_number().over(Window.partitionBy("key", "run").orderBy("slot")) - 1
    return placed.withColumn("inside", inside).join(opened, ["key", "run"]).select("slot", "key", (F.col("opens") + F.col("inside")).cast("long").alias("rank"))


def allotted(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """The plan with key, blocks, whole rounds, words of the last round, ranks, and the source's number.

    A source is read for the whole words of its target: `rounds` times from end to end, then its first `rest` words.
    """
    words, size = F.floor("target").cast("long"), F.col("source_size")
    rounds = F.when(size > 0, F.floor(words / size)).otherwise(0).cast("long")
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    return (
        plan.withColumn("key", _source_key()).withColumn("blocks", F.ceil(size / block).cast("long")).withColumn("rounds", rounds)
        .withColumn("rest", F.when(size > 0, words - F.col("rounds") * size).otherwise(0).cast("long"))
        .withColumn("ranks", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
        .withColumn("number", (F.row_number().over(by_name) - 1).cast("long"))
        .withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    )


def schedule(plan: DataFrame, total: int, block: int = BLOCK, sequence: str = "golden") -> DataFrame:
    """(key, slot, rank, block, upto): the order in which the mix reads blocks of an :func:`allotted` plan.

    Rank r of a source is its block r modulo their number; of it the words before offset `upto` of the source are read.
    Slots beyond a source's ranks are empty; ranks that no point gave a slot follow all points, source by source in turn.
    """
    slots = -(-total // block)
    ranked = stored(ranks(plan, slots, sequence), "mix-ranks")
    given = ranked.join(plan, "key").where(F.col("rank") < F.col("ranks"))
    counted = plan.join(ranked.groupBy("key").agg(F.count(F.lit(1)).alias("had")), "key", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    more = counted.where("ranks > had").withColumn("rank", F.explode(F.sequence("had", F.col("ranks") - 1)))
    more = more.withColumn("slot", F.lit(slots) + (F.col("rank") - F.col("had")) * F.col("sources") + F.col("number"))
    read = [F.pmod("rank", "blocks").alias("block"), F.when(F.col("rank") < F.col("rounds") * F.col("blocks"), F.col("source_size")).otherwise(F.col("rest")).alias("upto")]
    out = stored(given.select("key", "slot", "rank", *read).unionByName(more.select("key", "slot", "rank", *read)), "mix-schedule")
    discard(ranked)
    return out


def _source_key(source: str = "source"):
    """A non-null stand-in for a source, so that equal keys mean equal sources, null included."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _shuffle_key(key: str, seed: str):
    return F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), "UTF-8"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: str = SEED, sequence: str = "golden", text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot), one row per row of docs.

    The documents of a source are shuffled by a hash of their id and laid end to end; running offsets come from sums over
    4,096 hash buckets of each source and a window inside each bucket, so that no task holds a source. Rows that repeat an
    id follow each other, the shorter first. Slots grow with the corpus, a block stays at `block` words. taken is what
    the slots read of a document, summed over its blocks, and first_slot the first of them, null if nothing is read.
    A source's taken words are the whole words of its target.

    Null texts and texts without words have size 0, and nothing is taken of them. A null source is a source, the last
    in order. A null id is shuffled like the empty text. If no text has a word, all targets are 0. Other columns play
    no part, whatever their names. An empty table gives an empty one.
    """
    given = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"), _shuffle_key(key, seed).alias("order"))
    sized = stored(given.withColumn("key", _source_key()).withColumn("bucket", F.substring("order", 1, 3)), "mix-sized")
    sums = stored(sized.groupBy("key", "source", "bucket").agg(F.sum("size").alias("n")), "mix-sums")
    plan = stored(allotted(targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, cap), block), "mix-plan")
    order = schedule(plan, plan.agg(F.max("total")).first()[0] or 0, block, sequence)
    before = F.sum("n").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    opened = sums.select("key", "bucket", F.coalesce(before, F.lit(0)).alias("opens"))
    inside = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = stored(sized.withColumn("inside", F.coalesce(inside, F.lit(0))).join(opened, ["key", "bucket"]).select("doc_id", "key", "size", (F.col("opens") + F.col("inside")).alias("offset")), "mix-placed")
    discard(sized)
    discard(sums)
    end = F.col("offset") + F.col("size")
    pieces = placed.where("size > 0").select("key", "offset", end.alias("end"), F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((end - 1) / block))).alias("block"))
    words = F.least("end", "upto", (F.col("block") + 1) * block) - F.greatest("offset", F.col("block") * block)
    read = pieces.join(order, ["key", "block"]).withColumn("words", words).where("words > 0").groupBy("key", "offset").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    # documents without words share their offset with the next one
    some = placed.where("size > 0").join(read, ["key", "offset"], "left").select("doc_id", "key", "size", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")
    none = placed.where("size = 0").select("doc_id", "key", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return some.unionByName(none).join(plan, "key").select(F.col("doc_id").alias(key), F.col("source").alias(source), "size", "source_size", "target", "taken", "first_slot")


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", **settings) -> DataFrame:
    """The rows of docs as often as the mix takes them: taken over size, rounded to whole documents, halves up.

    Rows that repeat an id within a source share what is taken of them and stay equally often. All columns stay as they
    are, whatever their names.
    """
    taken = mix(docs, key=key, source=source, **settings).groupBy(F.col(key).alias("k"), F.col(source).alias("s")).agg(F.sum("taken").alias("t"), F.sum("size").alias("n"))
    times = F.when(F.col("n") > 0, F.floor((F.col("t") * 2 + F.col("n")) / (F.col("n") * 2))).otherwise(F.lit(0)).cast("int")
    # a row of this side per document: never broadcast; it is hashed, so that no text is sorted
    kept = taken.select(F.struct("k", "s").alias("of"), times.alias("times")).where("times > 0").hint("shuffle_hash")
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.struct(F.col(key).alias("k"), F.col(source).cast("string").alias("s")).alias("mine"))
    found = rows.join(kept, (F.col("mine.k").eqNullSafe(F.col("of.k"))) & (F.col("mine.s").eqNullSafe(F.col("of.s"))))
    return found.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and the slot that reads it first."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, sum(source_size) OVER ()::BIGINT AS total FROM s),
r AS (SELECT *, coalesce(sum(source_size * 3) OVER before, 0)::BIGINT AS capped, sum(weight) OVER after::BIGINT AS open FROM w
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT *, (total - capped)::DOUBLE / open AS own FROM r),
f AS (SELECT arg_min(own, capped) AS level FROM l WHERE own * weight <= source_size * 3),
t AS (SELECT source, source_size, total, least(level * weight, (source_size * 3)::DOUBLE) AS target FROM l, f),
u AS (SELECT *, CASE WHEN total > 0 THEN least(4294967296, floor(sum(target) OVER (ORDER BY source NULLS LAST) / total * 4294967296))::BIGINT ELSE 0 END AS edge,
  lead(1) OVER (ORDER BY source NULLS LAST) IS NULL AS final FROM t),
p AS (SELECT *, CASE WHEN final THEN 4294967296 ELSE edge END AS hi FROM u),
q AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number, count(*) OVER () AS sources,
  (source_size + 255) // 256 AS blocks, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size::BIGINT ELSE 0 END AS rounds FROM p),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT - rounds * source_size::BIGINT ELSE 0 END AS rest, (total + 255) // 256 AS slots FROM q),
h AS (SELECT *, rounds * blocks + (rest + 255) // 256 AS ranks FROM g),
i AS (SELECT x AS slot, (x * 2654435769) % 4294967296 AS at FROM (SELECT unnest(range((SELECT coalesce(max(slots), 0) FROM h)::BIGINT)) AS x)),
n AS (SELECT number, slot, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS rank FROM i JOIN h ON i.at >= h.lo AND i.at < h.hi),
c AS (SELECT h.number, sources, slots, ranks, count(n.slot) AS had FROM h LEFT JOIN n ON h.number = n.number GROUP BY ALL),
e AS (SELECT number, slots + (rank - had) * sources + number AS slot, rank FROM (SELECT *, unnest(range(had::BIGINT, ranks::BIGINT)) AS rank FROM c)),
m AS (SELECT number, slot, rank FROM n UNION ALL SELECT number, slot, rank FROM e),
o AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM d),
v AS (SELECT doc_id, size, source_size, target, number, off, (rounds * size + greatest(0, least(size, rest - off)))::BIGINT AS taken FROM o JOIN h ON o.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, taken, CASE WHEN taken > 0 THEN slot::BIGINT END AS first_slot
FROM v LEFT JOIN m ON v.number = m.number AND m.rank = v.off // 256
"""
