"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import NON_SPACE, materialise

#: Weights dealt in turn to the sources in code point order, null last.
WEIGHTS = (5, 2, 1)
#: The share of all words that the mix takes, in percent, and the most copies of any source.
TOTAL_PERCENT, MAX_COPIES = 150, 2
#: The Pareto order is cut into 2^SLICE_BITS slices, and the slice that holds the cut again, while it has more rows than one task should sort.
SLICE_BITS, LEVELS, SORT_ROWS = 10, 4, 1_000_000


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(NON_SPACE)), F.lit(0)).cast("long")


def weight(size: Column) -> Column:
    """What a document's expected copies are proportional to: the binary digits of its word count, so that longer ones are likelier."""
    return F.length(F.bin(size)).cast("long")


def uniform(seed: str, *keys: Column) -> Column:
    """A number strictly between 0 and 1 from the md5 of the keys: the same in every run and engine."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    high = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (high.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, total_percent: int = TOTAL_PERCENT, max_copies: int = MAX_COPIES
) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Water filling in closed form: sources sorted by cap/weight; those whose cap lies under the common
    level keep their cap, the rest get weight x level. All sums are of integers, so any engine gets the
    same doubles. Two windows over one row per source; documents never meet in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.withColumn("_i", (F.row_number().over(order) - 1) % n).withColumn(
        "_w", F.element_at(F.array(*(F.lit(int(w)).cast("long") for w in weights)), (F.col("_i") + 1).cast("int"))
    )
    filling = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("source").asc_nulls_last())
    upto = filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(max_copies))
    ranked = (
        ranked.withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_all_w", F.sum("_w").over(everything))
        .withColumn("_cap_upto", F.sum("_cap").over(upto))
        .withColumn("_w_upto", F.sum("_w").over(upto))
    )
    goal = F.col("_all") * F.lit(float(total_percent)) / F.lit(100.0)
    # Capped are the sources for which even the level reached without them lies at or above their cap.
    level_before = (goal - (F.col("_cap_upto") - F.col("_cap"))) / (F.col("_all_w") - (F.col("_w_upto") - F.col("_w")))
    ranked = ranked.withColumn("_capped", F.col("_cap") <= F.col("_w") * level_before)
    ranked = ranked.withColumn(
        "_cap_sum", F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(everything), F.lit(0))
    ).withColumn("_w_rest", F.coalesce(F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(everything), F.lit(0)))
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(
        F.least(F.col("_cap").cast("double"), F.col("_w") * ((goal - F.col("_cap_sum")) / F.col("_w_rest")))
    )
    return ranked.withColumn("target", target).select("source", "source_size", "target")


def expected_copies(classes: DataFrame, goals: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target, weight, whole, part, need) from (source, weight, size), the words of each weight in each source.

    A document is expected to be taken min(max_copies, c x weight) times, with c such that the source's target is met: water
    filling over its few weights, the largest first. whole copies are certain, part is the inclusion probability of
    one more, and need are the words of the target that the sample has to fill.
    """
    down = Window.partitionBy("source").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy("source").orderBy("weight").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = Window.partitionBy("source")
    c = classes.alias("c").join(goals.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")))
    c = c.select("c.source", "g.source_size", "g.target", "c.weight", "c.size").withColumns({
        "left": F.col("target") - max_copies * (F.sum("size").over(down) - F.col("size")),  # if all heavier ones are capped
        "pull": F.sum(F.col("weight") * F.col("size")).over(up),
    })
    capped = F.col("left") * F.col("weight") >= max_copies * F.col("pull")
    c = c.withColumn("capped", capped).withColumns({
        "rest": F.col("target") - max_copies * F.coalesce(F.sum(F.when(F.col("capped"), F.col("size"))).over(each), F.lit(0)),
        "free": F.sum(F.when(~F.col("capped"), F.col("weight") * F.col("size"))).over(each),
    })
    copies = F.when(F.col("capped"), F.lit(float(max_copies))).when(F.col("free") > 0, F.col("rest") * F.col("weight") / F.col("free")).otherwise(F.lit(0.0))
    c = c.withColumn("copies", copies).withColumns({"whole": F.floor("copies"), "part": F.col("copies") - F.floor("copies")})
    need = F.col("target") - F.sum(F.col("whole") * F.col("size")).over(each)
    return c.withColumn("need", need).select("source", "source_size", "target", "weight", "whole", "part", "need")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    carry: tuple[str, ...] = (),
    **targets,
) -> DataFrame:
    """One row per input row: (id, source, *carry, size, source_size, target, copies, taken).

    Expected copies of a document are proportional to its weight, up to the cap (expected_copies). It gets the whole ones for certain;
    one more goes to a sample of unequal probabilities in Pareto order, uniform odds over inclusion odds, that ends at the document
    boundary nearest to the target's words. The cut is found from word counts by slice of the order, sliced again while many rows
    are left, so only about a million rows of a source are ever sorted; a hot source needs no task of its own.

    Null text: size 0, nothing taken. Null source: a source of its own, last. Sources without words take
    nothing. The uniform comes from id and text, so rows that repeat an id with other texts are drawn apart; equal rows tie in the
    order and are interchangeable. An empty table gives no rows. Columns not named are ignored, whatever they are called.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
        uniform(seed, F.col(id_col), F.md5(text.cast("binary"))).alias("u"), *(F.col(c).alias(f"_carry_{c}") for c in carry),
    )
    sizes = materialise(sizes.withColumn("weight", weight(F.col("size"))), "mix-sizes")
    classes = sizes.groupBy("source", "weight").agg(F.sum("size").alias("size"))
    goals = source_targets(classes.select("source", "size"), **targets)
    # A row for each source and power of two of sizes.
    plan = materialise(expected_copies(classes, goals, targets.get("max_copies", MAX_COPIES)), "mix-plan")
    matched = F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.weight") == F.col("p.weight"))
    odds, least = F.col("u") / (1 - F.col("u")), F.col("part") / (1 - F.col("part"))
    ranked = (
        sizes.alias("s").join(plan.alias("p"), matched).select("s.*", "p.source_size", "p.target", "p.whole", "p.part", "p.need")
        .withColumn("q", F.when(F.col("part") > 0, odds / least)).withColumn("rank", F.col("q") / (1 + F.col("q")))
        .withColumn("at", F.floor(F.col("rank") * 2.0 ** (SLICE_BITS * LEVELS)))
    )
    cut = _cut(ranked)
    joined = (
        ranked.alias("s").join(cut.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").select("s.*", "c.cut", "c.shift", "c.base")
        .withColumn("slice", F.expr("shiftright(at, shift)"))
    )
    # A slice that ends on the target is the cut; without a cutting slice all slices lie before the target.
    plain = joined.where("rank IS NULL OR cut IS NULL OR slice <> cut").withColumn(
        "extra", F.when(F.col("rank").isNotNull() & (F.col("cut").isNull() | (F.col("slice") < F.col("cut"))), 1).otherwise(0)
    )
    running = (
        Window.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    split = (
        joined.where("rank IS NOT NULL AND slice = cut")
        .withColumn("upto", F.col("base") + F.sum("size").over(running))
        .withColumn("extra", F.when(2 * F.col("upto") - F.col("size") <= 2 * F.col("need"), 1).otherwise(0))
        .drop("upto")
    )
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return plain.unionByName(split).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        *(F.col(f"_carry_{c}").alias(c) for c in carry),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def _cut(ranked: DataFrame) -> DataFrame:
    """(source, cut, shift, base): for each source the slice of the order in which its need is met, and the words before it.

    shift tells how fine the slices are: a slice is `at` without its last bits. Each level counts only the rows of the slices found before.
    """
    rows, cut = ranked.where("rank IS NOT NULL").select("source", "size", "need", "at"), None
    for level in range(LEVELS):
        shift = SLICE_BITS * (LEVELS - 1 - level)
        left = rows if cut is None else (
            rows.alias("r").join(cut.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.shiftright("r.at", shift + SLICE_BITS) == F.col("c.cut")))
            .select("r.*", "c.base")
        )
        left = left if cut is not None else left.withColumn("base", F.lit(0).cast("long"))
        in_order = Window.partitionBy("source").orderBy("slice")
        found = (
            left.groupBy("source", F.shiftright("at", shift).alias("slice"))
            .agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("need").alias("need"), F.first("base").alias("base"))
            .withColumn("upto", F.col("base") + F.sum("words").over(in_order))
            .where((F.col("upto") - F.col("words") < F.col("need")) & (F.col("upto") >= F.col("need")))
            .select("source", F.col("slice").alias("cut"), F.lit(shift).alias("shift"), (F.col("upto") - F.col("words")).alias("base"), "rows")
        )
        cut = materialise(found, "mix-cut")
        if (cut.agg(F.max("rows")).first()[0] or 0) <= SORT_ROWS:
            break
    return cut


#: DuckDB SQL for op5's rows: one window over each source instead of slices.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, source_size * 2 AS cap,
    (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS w
  FROM s
), f AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE * 150.0::DOUBLE / 100.0::DOUBLE AS goal, sum(w) OVER ()::DOUBLE AS all_w,
    sum(cap) OVER o::DOUBLE AS cap_upto, sum(w) OVER o::DOUBLE AS w_upto
  FROM r WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)
), c AS (
  SELECT *, cap::DOUBLE <= w::DOUBLE * ((goal - (cap_upto - cap)) / (all_w - (w_upto - w))) AS capped FROM f
), e AS (
  SELECT *, coalesce(sum(cap) FILTER (capped) OVER (), 0)::DOUBLE AS cap_sum,
    coalesce(sum(w) FILTER (NOT capped) OVER (), 0)::DOUBLE AS w_rest FROM c
), g AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE
    ELSE least(cap::DOUBLE, w::DOUBLE * ((goal - cap_sum) / w_rest)) END AS target FROM e
), cl AS (
  SELECT d.source, t.source_size, t.target, length(bin(d.size))::BIGINT AS weight, sum(d.size)::BIGINT AS size
  FROM d JOIN g t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL
), cw AS (
  SELECT *, target - 2 * (sum(size) OVER (PARTITION BY source ORDER BY weight DESC) - size)::DOUBLE AS rest0,
    sum(weight * size) OVER (PARTITION BY source ORDER BY weight)::DOUBLE AS pull FROM cl
), cc AS (
  SELECT *, rest0 * weight >= 2 * pull AS capped FROM cw
), cr AS (
  SELECT *, target - 2 * coalesce(sum(size) FILTER (capped) OVER (PARTITION BY source), 0)::DOUBLE AS rest,
    (sum(weight * size) FILTER (NOT capped) OVER (PARTITION BY source))::DOUBLE AS free FROM cc
), cx AS (
  SELECT *, CASE WHEN capped THEN 2.0::DOUBLE WHEN free > 0 THEN rest * weight / free ELSE 0.0::DOUBLE END AS m FROM cr
), cn AS (
  SELECT *, target - (sum(floor(m)::BIGINT * size) OVER (PARTITION BY source))::DOUBLE AS need FROM cx
), q AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target, t.need, floor(m) AS whole, m - floor(m) AS part,
    (('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, '') || '|' || md5(d.text)), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN cn t ON d.source IS NOT DISTINCT FROM t.source AND length(bin(d.size)) = t.weight
), o AS (
  SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS odds FROM q
), p AS (
  SELECT *, odds / (1 + odds) AS pareto FROM o
), k AS (
  SELECT *, sum(size) OVER (PARTITION BY source, pareto IS NULL ORDER BY pareto, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM p
)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN pareto IS NOT NULL AND 2 * upto - size <= 2 * need THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM k
"""
