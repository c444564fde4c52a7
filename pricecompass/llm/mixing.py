"""Mixing sources to target weights along a time-varying curriculum.

A source's share of the mix follows a piecewise linear schedule over training time 0..1. Integrated,
it gives the source's cumulative demand; inverted, it says when a word of the source is due. Each
source's documents are dealt in a fixed pseudo-random order, again and again. A copy is due when the
demand reaches its middle word, and the mix takes it if that is within training: so the copies taken
come near the target. Sorted by that position, they are the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, shuffle_parts, staged, text_key

#: Weights of the sources in order of their names (code points, NULL last), repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most this many times its source's size.
MAX_PASSES = 3
#: Relative demand at evenly spaced times, by weight: heavy sources lead early, light ones late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, turn, target).

    The sources share all words by weight; who would exceed MAX_PASSES times its size gets just
    that, and the excess goes to the others by weight. With ratio = cap / weight, the capped are
    those of the smallest ratios, so a running sum over the sources by ratio finds the level at
    which the rest stop. One row a source takes part, not its documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    cap = (MAX_PASSES * F.col("source_size")).cast("double")
    s = sources.withColumn("turn", turn.cast("int")).withColumns({"cap": cap})
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1).cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    s = s.withColumns(
        {
            "left": F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "heavy": F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    ).withColumn("level", F.col("left") / F.col("heavy"))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(all_)["level"]
    s = s.withColumn("stop", level)
    share = F.least(F.col("cap"), F.col("weight") * F.col("stop"))
    return s.select("source", "source_size", "turn", F.coalesce(share, F.col("cap")).alias("target"))


def due(u: Column, turn: Column, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> Column:
    """When a fraction u of a source's demand is reached, by its schedule: the inverse of the
    integral, a quadratic within the piece between two knots."""
    out = None
    for k, knots in enumerate(schedules):
        step = 1.0 / (len(knots) - 1)
        area = [step * (a + b) / 2 for a, b in zip(knots, knots[1:], strict=False)]
        done, time = 0.0, None
        for j, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
            part = F.greatest((u * F.lit(sum(area)) - F.lit(done)), F.lit(0.0))  # demand within the piece
            root = F.sqrt(F.greatest(F.lit(a * a) + 2 * (b - a) / step * part, F.lit(0.0)))
            inside = F.when(root + F.lit(a) > 0, 2 * part / (root + F.lit(a))).otherwise(F.lit(0.0))
            here = F.lit(j * step) + F.least(inside, F.lit(step))
            done += area[j]
            time = here if time is None else F.when(u * F.lit(sum(area)) >= F.lit(done - area[j]), here).otherwise(time)
        out = time if out is None else F.when(turn == k, time).otherwise(out)
    return out


def _range_sums(docs: DataFrame) -> DataFrame:
    """docs with before: words of the same source in earlier documents of its order; and with part and
    nth, which together with the source name a row.

    Range partitions split a hot source over many tasks; each sums its own rows, and what earlier
    partitions hold of a source comes from a table of a row per source and partition.
    """
    n = shuffle_parts(docs.sparkSession)
    order = [F.col("source").asc_nulls_last(), F.col("deal"), F.col("doc_id").asc_nulls_last(), F.col("size")]
    parts = staged(
        docs.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "mix"
    )
    of = Window.partitionBy("source", "part")
    sums = parts.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("_s"),
        F.col("part").alias("_p"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"),
    )
    in_turn = of.orderBy("deal", F.col("doc_id").asc_nulls_last(), "size", "text_key")
    own = F.sum("size").over(in_turn.rowsBetween(Window.unboundedPreceding, 0))
    return (
        parts.withColumns({"own": own, "nth": F.row_number().over(in_turn)})
        .join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
        .withColumn("before", F.col("offset") + F.col("own") - F.col("size"))
        .drop("_s", "_p", "own", "offset")
    )


def _placed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """mix() with part and nth."""
    sized = docs.select(
        "doc_id", text_key(F.col("text")).alias("text_key"), "source", n_words(F.col("text")).alias("size")
    ).withColumn("deal", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    dealt = _range_sums(staged(sized, "sizes"))  # staged: sampling the ranges doesn't read the texts again
    goal = targets(dealt.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    goal = goal.withColumnRenamed("source", "_s")
    mixed = dealt.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "deal")

    def position(k: Column) -> Column:
        middle = k * F.col("source_size") + F.col("before") + F.col("size") / 2.0
        share = middle / F.greatest(F.col("target"), F.lit(1.0))
        worded = F.when(middle <= F.col("target"), due(share, F.col("turn")))
        return F.when(F.col("source_size") > 0, worded).when(k == 0, F.lit(0.0))

    positions = F.filter(F.transform(F.array(*(F.lit(k) for k in range(MAX_PASSES))), position), lambda x: x.isNotNull())
    passes = F.size("positions")
    return mixed.withColumn("positions", positions).withColumns({"passes": passes, "taken": passes * F.col("size")})


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, turn, target, before, positions, passes, taken) of each row.

    positions are those of the copies that the mix takes, ascending: the k-th copy is taken if the
    demand of its source reaches the copy's middle word by the end of training. passes is how many
    there are. A NULL text has size 0; a source without words has each of its documents once, at the
    start; NULL is a source of its own, last in order; a NULL doc_id is dealt like another id;
    repeated rows are dealt one by one, and which of them comes first makes no difference to the
    rows returned; no rows give none; other columns are ignored. The order within a source is the
    MD5 of the id, so reruns agree.
    """
    return _placed(docs, weights).drop("part", "nth")


def copies(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, with its position 0..1 in training."""
    return mixed.withColumn("position", F.explode("positions")).drop("positions")


def in_order(copied: DataFrame, *then: str) -> DataFrame:
    """Copies range-sorted by their positions in training, equal ones by the columns `then`."""
    return copied.repartitionByRange("position", *then).sortWithinPartitions("position", *then)


def mixed_in_order(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_position, last_position) of each row, read from
    the training order: copies are range-sorted by position and written, and a row's words are counted and
    its first and last copy found there. A row that the mix leaves out takes 0 words and has NULL positions.
    """
    placed = staged(_placed(docs, weights), "mixed")
    key = ["source", "part", "nth"]
    order = staged(in_order(copies(placed).select(*key, "doc_id", "size", "position"), "doc_id"), "order")
    read = order.groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(
        F.sum("size").alias("_taken"), F.min("position").alias("first_position"), F.max("position").alias("last_position")
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")) & (F.col("nth") == F.col("_nth"))
    taken = F.coalesce("_taken", F.lit(0).cast("long")).alias("taken")
    return placed.join(read, same, "left").select(
        "doc_id", "source", "size", "source_size", "target", taken, "first_position", "last_position"
    )


def training_order(docs: DataFrame) -> DataFrame:
    """docs' columns and position (0..1): a row for each copy that the mix takes, range-sorted by it.

    Rows that agree in doc_id, text and source are one document here: dealt as often as they came. A
    column named position is replaced.
    """
    docs = docs.drop("position") if "position" in docs.columns else docs
    keyed = docs.withColumn("_key", text_key(F.col("text")))
    plan = copies(mix(docs)).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), F.col("source").alias("_source"), "position"
    )
    one = keyed.dropDuplicates(["doc_id", "_key", "source"])
    joined = one.join(
        plan,
        keyed.doc_id.eqNullSafe(plan._id) & (keyed._key == plan._text) & keyed.source.eqNullSafe(plan._source),
    )
    return in_order(joined, "doc_id").select(*docs.columns, "position")


def _due_sql(u: str, turn: str) -> str:
    """due() in SQL."""
    cases = []
    for k, knots in enumerate(SCHEDULES):
        step = 1.0 / (len(knots) - 1)
        area = [step * (a + b) / 2 for a, b in zip(knots, knots[1:], strict=False)]
        done, parts = 0.0, []
        for j, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
            part = f"greatest({u} * {sum(area)}::DOUBLE - {done}::DOUBLE, 0.0::DOUBLE)"
            root = f"sqrt(greatest({a * a}::DOUBLE + {2 * (b - a) / step}::DOUBLE * {part}, 0.0::DOUBLE))"
            parts.append((done, f"{j * step}::DOUBLE + least(CASE WHEN {root} + {a} > 0 THEN 2 * {part} / ({root} + {a}::DOUBLE) ELSE 0 END, {step}::DOUBLE)"))
            done += area[j]
        whens = " ".join(f"WHEN {u} * {sum(area)}::DOUBLE >= {at}::DOUBLE THEN {time}" for at, time in reversed(parts[1:]))
        cases.append(f"WHEN {k} THEN CASE {whens} ELSE {parts[0][1]} END")
    return f"CASE {turn} {' '.join(cases)} END"


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'),
         lambda x: x <> '')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS deal FROM documents),
b AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY deal, doc_id NULLS LAST, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (3 * sum(size))::DOUBLE AS cap,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS turn,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, cap / weight AS ratio, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER p, 0))
    / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER p, 0)) AS level
  FROM s WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, level LIMIT 1),
t AS (SELECT source, source_size, turn, coalesce(least(cap, weight * (SELECT level FROM stop)), cap) AS target FROM l),
m AS (
  SELECT r, doc_id, size, source_size, target, turn, k, k * source_size + before + size / 2.0::DOUBLE AS middle
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source, (SELECT unnest(range(3)) AS k)),
c AS (
  SELECT *, CASE WHEN source_size = 0 THEN CASE WHEN k = 0 THEN 0.0::DOUBLE END
    WHEN middle <= target THEN DUE END AS position FROM m)
SELECT doc_id, size, source_size, target, (any_value(size) * count(position))::BIGINT AS taken,
  round(min(position), 6) AS first_position, round(max(position), 6) AS last_position
FROM c GROUP BY r, doc_id, size, source_size, target
""".replace("DUE", _due_sql("(middle / greatest(target, 1.0::DOUBLE))", "turn"))
