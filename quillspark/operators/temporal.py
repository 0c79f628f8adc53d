"""Narrative time: position bins, dense trajectories, and phrases of relative position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark import schema as S
from quillspark.functions import text as X


def num_bins(total: Column, least: int = S.MIN_BINS, most: int = S.MAX_BINS, facts_per_bin: int = S.FACTS_PER_BIN) -> Column:
    return F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), total / F.lit(float(facts_per_bin)))).cast("int")


def bin_of(chunk: Column, least: Column, most: Column, bins: Column) -> Column:
    """1-based bin of a chunk; the quotient is of whole numbers far below 2^53, so its floor is exact."""
    reached = F.floor(((chunk - least).cast("long") * bins) / (most - least + 1)) + 1
    return F.least(bins.cast("long"), reached).cast("int")


def temporal_index(edge_table: DataFrame, **binning) -> DataFrame:
    """(book_id, min_chunk, max_chunk, n_edges, num_bins): one row for each book with edges; binning sets num_bins's bounds."""
    return edge_table.groupBy("book_id").agg(
        F.min("chunk_id").alias("min_chunk"), F.max("chunk_id").alias("max_chunk"), F.count("*").alias("n_edges")
    ).withColumn("num_bins", num_bins(F.col("n_edges"), **binning))


def binned(edge_table: DataFrame, canonical_only: bool = True, **binning) -> DataFrame:
    """Edges with the bin of their chunk; the index counts all edges of the book."""
    kept = edge_table.where(X.is_canonical(F.col("relation"))) if canonical_only else edge_table
    return kept.join(temporal_index(edge_table, **binning), "book_id").withColumn(
        "bin", bin_of(F.col("chunk_id"), F.col("min_chunk"), F.col("max_chunk"), F.col("num_bins"))
    )


def _dense(index: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    slots = index.select(*keys, F.explode(F.sequence(F.lit(1), F.col("num_bins"))).alias("bin"))
    return slots.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def book_trajectory(edge_table: DataFrame, canonical_only: bool = True, **binning) -> DataFrame:
    """(book_id, bin, cnt) with a row for every bin, empty ones too."""
    counts = binned(edge_table, canonical_only, **binning).groupBy("book_id", "bin").agg(F.count("*").alias("cnt"))
    return _dense(temporal_index(edge_table, **binning), counts, ["book_id"])


def pair_trajectory(edge_table: DataFrame, pairs: DataFrame, canonical_only: bool = True) -> DataFrame:
    """(book_id, lo, hi, bin, cnt): as book_trajectory, for pairs (book_id, a, b); unknown names give zeros."""
    pairs = pairs.select("book_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    keyed = binned(edge_table, canonical_only).withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")})
    counts = keyed.join(pairs, ["book_id", "lo", "hi"], "left_semi").groupBy("book_id", "lo", "hi", "bin").agg(F.count("*").alias("cnt"))
    index = pairs.join(temporal_index(edge_table), "book_id")
    return _dense(index, counts, ["book_id", "lo", "hi"])


def active_pairs(edge_table: DataFrame, top: int = 10, canonical_only: bool = True) -> DataFrame:
    """(book_id, bin, lo, hi, cnt, place): the most frequent pairs of each bin; ties in order of appearance."""
    counts = binned(edge_table, canonical_only).groupBy(
        "book_id", "bin", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")
    ).agg(F.count("*").alias("cnt"), F.min("seq").alias("seen"))
    order = Window.partitionBy("book_id", "bin").orderBy(F.desc("cnt"), "seen")
    return counts.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= top).drop("seen")


def weighted_mean_bin(trajectory: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean_bin); null where nothing is counted."""
    return trajectory.groupBy(*keys).agg(F.try_divide(F.sum(F.col("bin") * F.col("cnt")), F.sum("cnt")).alias("mean_bin"))


def evenness(trajectory: DataFrame, index: DataFrame) -> DataFrame:
    """One row: spread of the books' mean positions as shares of their bins, and how many lie early, central and late."""
    at = weighted_mean_bin(trajectory, ["book_id"]).join(index, "book_id").select((F.col("mean_bin") / F.col("num_bins")).alias("at"))
    return at.agg(
        F.round(F.min("at"), 6).alias("least"), F.round(F.max("at"), 6).alias("most"), F.round(F.avg("at"), 6).alias("mean"),
        F.count_if(F.col("at") < 0.4).alias("early"), F.count_if(F.col("at").between(0.4, 0.6)).alias("central"), F.count_if(F.col("at") > 0.6).alias("late"),
    )


def _words(table: dict) -> str:
    return "|".join(sorted(table, key=lambda w: -len(w)))


def _value(table: dict, word: Column, kind: str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), word).cast(kind)


def parse_phrase(query: Column) -> Column:
    """struct(start_frac, end_frac, kind, phrase) of the first phrase of relative position, null if there is none.

    Tried in this order: a fraction of the way through, an ordinal span, early or late, an anchor with a modifier.
    """
    q = X.strip(F.regexp_replace(F.lower(query), r"(?U)\s+", " "))
    pick = lambda pattern, i: F.nullif(F.regexp_extract(q, pattern, i), F.lit(""))

    def span(start: Column, end: Column, kind, phrase: Column) -> Column:
        return F.struct(start.cast("double").alias("start_frac"), end.cast("double").alias("end_frac"), kind.alias("kind"), phrase.alias("phrase"))

    ordered = lambda table: "|".join(table)
    fraction = ordered(S.FRACTIONS)
    through = S.THROUGH_PATTERN.format(numbers=ordered(S.NUMBERS), fractions=fraction)
    point = F.least(F.lit(1.0), F.coalesce(_value(S.NUMBERS, pick(through, 1), "double"), F.lit(1.0)) / _value(S.FRACTIONS, pick(through, 2), "double"))
    near = F.lit(S.NEAR_WINDOW / 2)
    a = F.when(q.rlike(through), span(F.greatest(F.lit(0.0), point - near), F.least(F.lit(1.0), point + near), F.lit("point_window"), pick(through, 0)))

    part = S.PART_PATTERN.format(ordinals=ordered(S.ORDINALS), fractions=fraction)
    parts = _value(S.FRACTIONS, pick(part, 2), "double")
    index = _value(S.ORDINALS, pick(part, 1), "double")
    index = F.when(index == -1, parts - 1).otherwise(index)
    b = F.when(q.rlike(part) & (index < parts), span(index / parts, (index + 1) / parts, F.lit("fractional_span"), pick(part, 0)))

    edge = S.EDGE_PATTERN
    early = pick(edge, 1) == "early"
    c = F.when(
        q.rlike(edge),
        span(F.when(early, 0.0).otherwise(1.0 - S.EDGE_WINDOW), F.when(early, S.EDGE_WINDOW).otherwise(1.0), F.lit("point_window"), pick(edge, 0)),
    )

    anchor = S.ANCHOR_PATTERN.format(anchors=_words(S.ANCHORS))
    at = _value(S.ANCHORS, pick(anchor, 2), "double")
    modifier = F.regexp_extract(q, anchor, 1)
    half = F.when(modifier.isin("right at", "exactly at"), F.lit(S.EXACT_WINDOW / 2)).otherwise(near)
    by = modifier == "by"
    d = F.when(
        q.rlike(anchor),
        span(
            F.when(by, 0.0).otherwise(F.greatest(F.lit(0.0), at - half)), F.when(by, at).otherwise(F.least(F.lit(1.0), at + half)),
            F.when(by, "cumulative").otherwise("point_window"), pick(anchor, 0),
        ),
    )
    return F.coalesce(a, b, c, d)


def resolve_bins(span: Column, bins: Column) -> Column:
    """struct(start_bin, end_bin), both inclusive and within 1 and bins."""
    clamp = lambda f: F.greatest(F.lit(1), F.least(bins.cast("int"), (f * bins).cast("int") + 1))
    start = clamp(span["start_frac"])
    return F.when(span.isNotNull(), F.struct(start.alias("start_bin"), F.greatest(start, clamp(span["end_frac"])).alias("end_bin")))


def contiguity(chunks: DataFrame) -> DataFrame:
    """(book_id, n_chunks, first, last, contiguous, gaps): whether a book's chunk numbers run without holes."""
    order = Window.partitionBy("book_id").orderBy("chunk_id")
    return chunks.withColumn("next", F.lead("chunk_id").over(order)).groupBy("book_id").agg(
        F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last"),
        (F.max("chunk_id") - F.min("chunk_id") + 1 == F.count("*")).alias("contiguous"),
        F.count_if(F.col("next") - F.col("chunk_id") > 1).alias("gaps"),
    )


def position_gaps(marked: DataFrame) -> DataFrame:
    """(book_id, n, median_gap, least_gap, most_gap) of the distances between marked chunks."""
    order = Window.partitionBy("book_id").orderBy("chunk_id")
    gaps = marked.withColumn("gap", F.col("chunk_id") - F.lag("chunk_id").over(order))
    return gaps.groupBy("book_id").agg(
        F.count("*").alias("n"), F.expr("percentile(gap, 0.5)").alias("median_gap"), F.min("gap").alias("least_gap"), F.max("gap").alias("most_gap")
    )


def marker_counts(chunks: DataFrame, pattern: str) -> DataFrame:
    """(book_id, chunk_id, n_markers, kind): none, candidate with exactly one, contents with more."""
    n = F.regexp_count("chunk", F.lit(pattern))
    return chunks.select("book_id", "chunk_id", n.cast("long").alias("n_markers")).withColumn(
        "kind", F.when(F.col("n_markers") == 0, "none").when(F.col("n_markers") == 1, "candidate").otherwise("contents")
    )


def passages(chunks: DataFrame, first: int, length: int) -> DataFrame:
    """(book_id, passage): chunks from the first-th on, in numeric order, joined by spaces; length bounds what is gathered."""
    placed = chunks.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy("chunk_id")))
    window = placed.where(F.col("place").between(first, first + length - 1))
    gathered = F.array_sort(F.collect_list(F.struct("place", "chunk")))
    return window.groupBy("book_id").agg(F.array_join(F.transform(gathered, lambda x: x["chunk"]), " ").alias("passage"))
