"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Each source has a weight schedule over the training time t in [0, 1]: its share of the mix is
``target * (1 + slope * (2 t - 1))`` words per unit of time, so the schedule integrates to the
source's target whatever the slope. The cumulative demand ``target * (t + slope * (t^2 - t))`` has
a closed inverse, so the documents of a source, in a pseudo-random order fixed by
MD5(doc_id), get the training position at which the demand reaches them: the k-th word of a
source is due at the t whose cumulative demand is k. Words past the target are not due and
not taken; a source whose target exceeds its size is read a second time. Documents are range-sorted
by position.

Targets: sources in code point order (null last) weigh ``weights`` in turn and share
``total_share`` of all words; a target stops at ``max_passes`` times its source's size and
the excess is reshared by weight until none is above. That fixed point is water filling:
with the sources sorted by cap / weight, each prefix taken as capped gives a level
``(total - caps before) / (weights left)``; the largest of them is the level of the
sources that stay below their cap.

Skew: sizes are counted once per document and written without texts; sums per source aggregate
map-side; running sums inside a source go through blocks (``shared.running_sum``), so a source with a
third of all rows is many tasks. Only the list of sources meets in one task.

Defined cases: a null text has size 0; a null source is a source of its own (the last); documents
of size 0 take nothing and have no position; rows that repeat an id count each for themselves;
ties in MD5 are ordered by size; an empty table gives no rows. If no document has a word, all
targets are 0. Extra columns are passed on by :func:`mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.shared import SPACE_CLASS, materialize, running_sum, settled

WEIGHTS = (3, 1, 2)
SLOPES = (-0.5, 0.5, 0.0)
TOTAL_SHARE = 1.5
MAX_PASSES = 2


def n_words(text: Column) -> Column:
    """Number of runs of non-space characters; each run with the space before it becomes one letter."""
    word = SPACE_CLASS + "*[^" + SPACE_CLASS[1:-1] + "]+"
    return F.length(F.rtrim(F.regexp_replace(F.coalesce(text, F.lit("")), word, "x"),
                            F.lit(" \t\n\x0b\f\r"))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, total_share: float = TOTAL_SHARE,
                   max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: source, source_size, target, slope."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    sources = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
               .withColumn("_turn", turn)
               .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("_turn") + 1).cast("double"))
               .withColumn("slope", F.element_at(F.array(*[F.lit(float(s)) for s in slopes]),
                                                 F.col("_turn") % len(slopes) + 1))
               .withColumn("cap", (F.col("source_size") * max_passes).cast("double")))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, left = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = ((F.sum("source_size").over(every) * F.lit(float(total_share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(left))
    return (sources.withColumn("_level", level)
            .withColumn("target", F.least("cap", F.max("_level").over(every) * F.col("weight")))
            .select("source", "source_size", "target", "slope"))


def schedule(docs: DataFrame, **rule) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, position.

    ``position`` is where the first pass over the document begins (null if nothing is taken);
    ``second_position`` the same for the second pass.
    """
    due = _due(docs, **rule)
    second = F.col("positions")[1] if rule.get("max_passes", MAX_PASSES) > 1 else F.lit(None).cast("double")
    return due.select("doc_id", "source", "size", "source_size", "target", "taken",
                      F.col("positions")[0].alias("position"), second.alias("second_position"))


def _due(docs: DataFrame, *keys: str, **rule) -> DataFrame:
    """``schedule`` with the position of every pass as an array, and the columns ``keys`` of ``docs``."""
    max_passes = rule.get("max_passes", MAX_PASSES)
    sizes = materialize(docs.select(*keys, "doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    targets = materialize(source_targets(sizes, **rule), "targets")
    ordered = running_sum(sizes.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))),
                          ["source"], ["_h", "size"], "size", "before")
    renamed = targets.withColumnRenamed("source", "_s")
    due = (ordered.join(renamed, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
           .withColumn("words", F.floor("target")))

    def in_pass(k: int) -> Column:
        start = F.col("before") + F.col("source_size") * k
        return F.least("size", F.greatest(F.lit(0).cast("long"), F.col("words") - start))

    def position(k: int) -> Column:
        a = F.col("slope")
        u = (F.col("before") + F.col("source_size") * k) / F.col("target")
        root = F.sqrt((1 - a) * (1 - a) + 4 * a * u)
        return F.when(in_pass(k) > 0, F.when(u > 0, 2 * u / ((1 - a) + root)).otherwise(F.lit(0.0)))

    taken = in_pass(0)
    for k in range(1, max_passes):
        taken = taken + in_pass(k)
    return due.select(*keys, "doc_id", "source", "size", "source_size", "target", taken.alias("taken"),
                      F.array(*[position(k) for k in range(max_passes)]).alias("positions"))


def mixing(docs: DataFrame, **rule) -> DataFrame:
    """The schedule in training order (range-sorted by position; documents not taken last)."""
    return (schedule(docs, **rule).drop("source")
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


def mix(docs: DataFrame, **rule) -> DataFrame:
    """The mixed documents in training order, with the columns of ``docs``.

    A document is repeated as often as it is taken. Texts stay whole: the one document of
    a source that its target cuts is taken if at least half of it is due. Every row has its own schedule, also
    rows that repeat an id or have none: rows are named by their place in the stored table.
    """
    keyed, key = _with_row_key(docs)
    copies = F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")
    chosen = settled(lambda: _due(keyed, *key, **rule).where("size > 0").withColumn("n", copies).where("n > 0")
                     .select(*key, F.slice("positions", F.lit(1), F.col("n")).alias("__mix_at")), "chosen")
    taken = keyed.join(chosen, key)
    return (taken.withColumn("__mix_position", F.explode("__mix_at")).orderBy("__mix_position", "doc_id", *key)
            .drop(*key, "__mix_at", "__mix_position"))


def _with_row_key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns that name each row, the same ones whenever it is read.

    A stored table has them: the file and the row's place in it. Anything else is written once.
    """
    key = ["__mix_file", "__mix_row"]
    try:
        return docs.select("*", F.col("_metadata.file_path").alias(key[0]), F.col("_metadata.row_index").alias(key[1])), key
    except AnalysisException:
        keyed = docs.withColumn(key[0], F.lit("")).withColumn(key[1], F.monotonically_increasing_id())
        return materialize(keyed, "keyed"), key


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM d GROUP BY source),
c AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target,
             [-0.5, 0.5, 0.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS a FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.a, floor(t.target) AS words,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, CAST(least(size, greatest(0, words - before)) AS BIGINT) AS one,
         CAST(least(size, greatest(0, words - before - source_size)) AS BIGINT) AS two,
         before / target AS u, (before + source_size) / target AS v
  FROM r)
SELECT doc_id, size, source_size, target, one + two AS taken,
       CASE WHEN one > 0 THEN 2 * u / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * u)) END AS position,
       CASE WHEN two > 0 THEN 2 * v / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * v)) END AS second_position
FROM p
"""
