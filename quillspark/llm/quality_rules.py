"""Quality rules whose cutoffs come from mergeable quantile sketches, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import materialise

#: Whitespace characters as a plain set, for trimming.
SPACES = " \t\n\x0b\f\r"
#: Fixed base rule: fewer words, or more than this percent of words in repeated windows, fails.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: (sketched ratio, slack above the upper fence, slack below the lower fence or None). Per mille of words
#: or lines; word length in hundredths of a character.
RATIOS = (("sym", 100, None), ("dup", 300, None), ("rep", 300, None), ("len", 200, 100))
#: Fence: the outer decile plus so many times its distance from the median.
FENCE = 3
#: Groups with fewer rows take the thresholds of their language, then those of all rows.
MIN_GROUP = 100


def text_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words, all long; null text counts as empty.

    Repeated windows are found by sorting each document's own window hashes, so no document's words leave
    its row. Columns of docs with these names or starting with "_q_" are not allowed; select what to keep first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    staged = docs.withColumn(
        "_q_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    ).withColumn("_q_l", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    staged = staged.withColumn("n_words", F.size("_q_w").cast("long")).withColumn(
        "_q_h",
        F.when(
            F.col("n_words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("_q_w") - 3),
                lambda i: F.xxhash64(F.get("_q_w", i), F.get("_q_w", i + 1), F.get("_q_w", i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    staged = staged.withColumn(
        "_q_s",
        F.when(
            F.size(F.array_distinct("_q_h")) < F.size("_q_h"),
            F.sort_array(F.transform("_q_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    repeated = F.filter(
        "_q_s",
        lambda x, j: (F.get("_q_s", j - 1)["h"].eqNullSafe(x["h"])) | (F.get("_q_s", j + 1)["h"].eqNullSafe(x["h"])),
    )
    staged = staged.withColumn("_q_p", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_q_p", lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get("_q_p", k - 1)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return (
        staged.withColumn("word_chars", (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_lines", F.size("_q_l").cast("long"))
        .withColumn("n_dup_lines", (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("_q_w", "_q_l", "_q_h", "_q_s", "_q_p")
    )


def sketch_bucket(value: str) -> str:
    """SQL for the bucket of a non-negative whole number: exact below 16, then 16 buckets for each power of two."""
    shift = f"(length(bin({value})) - 5)"
    return f"CASE WHEN {value} < 16 THEN {value} ELSE 16 * {shift} + shiftright({value}, cast({shift} AS INT)) END"


def bucket_floor(bucket: str) -> str:
    """SQL for the smallest value of a bucket."""
    shift = f"(({bucket} DIV 16) - 1)"
    return (
        f"CASE WHEN {bucket} < 16 THEN {bucket} ELSE shiftleft({bucket} - 16 * {shift}, cast({shift} AS INT)) END"
    )


def _quantiles(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket floors of the 10th, 50th and 90th percentile for each (keys, ratio) from (keys, ratio, bucket, n)."""
    by = [*keys, "ratio"]
    order = Window.partitionBy(*by).orderBy("bucket")
    ranked = (
        cells.groupBy(*by, "bucket")
        .agg(F.sum("n").alias("n"))
        .withColumn("upto", F.sum("n").over(order))
        .withColumn("rows", F.sum("n").over(Window.partitionBy(*by)))
    )
    at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("rows"), F.col("bucket")))
    found = ranked.groupBy(*by).agg(
        F.first("rows").alias("rows"), at(10).alias("b10"), at(50).alias("b50"), at(90).alias("b90")
    )
    return found.select(*by, "rows", *(F.expr(bucket_floor(b)).alias(f"q{b[1:]}") for b in ("b10", "b50", "b90")))


def adaptive_thresholds(rows: DataFrame, lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, hi_<ratio>, lo_len): fences from the sketches of (lang, source, <ratios>).

    The sketches are counts per bucket: partial aggregates of fixed resolution that merge by addition, so
    language-wide and global sketches are sums of the groups' and nothing is read twice. Null language or
    source forms groups of its own.
    """
    cells = (
        rows.select(
            F.col(lang).alias("lang"),
            F.col(source).alias("source"),
            F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), F.col(r).alias("v")) for r, _, _ in RATIOS))).alias("x"),
        )
        .select("lang", "source", "x.ratio", F.expr(sketch_bucket("x.v")).alias("bucket"))
        .groupBy("lang", "source", "ratio", "bucket")
        .agg(F.count("*").alias("n"))
    )
    cells = materialise(cells, "sketch")
    groups = cells.select("lang", "source").distinct()
    own = _quantiles(cells, ["lang", "source"])
    language = _quantiles(cells, ["lang"])
    whole = _quantiles(cells, [])
    q = lambda t: F.struct(f"{t}.rows", f"{t}.q10", f"{t}.q50", f"{t}.q90")
    names = F.array(*(F.lit(r) for r, _, _ in RATIOS))
    picked = (
        groups.withColumn("ratio", F.explode(names)).alias("k")
        .join(own.alias("o"), F.col("k.lang").eqNullSafe(F.col("o.lang")) & F.col("k.source").eqNullSafe(F.col("o.source")) & (F.col("k.ratio") == F.col("o.ratio")), "left")
        .join(language.alias("l"), F.col("k.lang").eqNullSafe(F.col("l.lang")) & (F.col("k.ratio") == F.col("l.ratio")), "left")
        .join(whole.alias("w"), F.col("k.ratio") == F.col("w.ratio"), "left")
        .select(
            "k.lang", "k.source", "k.ratio",
            F.when(F.col("o.rows") >= min_group, q("o")).when(F.col("l.rows") >= min_group, q("l")).otherwise(q("w")).alias("q"),
        )
        .select("lang", "source", "ratio", "q.q10", "q.q50", "q.q90")
    )
    limits = []
    for ratio, above, below in RATIOS:
        this = F.col("ratio") == ratio
        limits.append(F.max(F.when(this, F.col("q90") + FENCE * (F.col("q90") - F.col("q50")) + above)).alias(f"hi_{ratio}"))
        if below is not None:
            limits.append(F.max(F.when(this, F.col("q10") - FENCE * (F.col("q50") - F.col("q10")) - below)).alias(f"lo_{ratio}"))
    return picked.groupBy("lang", "source").agg(*limits)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, *keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row per input row.

    kept is false for base failures; other documents are kept while every ratio lies within the fences of
    their language and source. Null or empty text: all counts 0, base_failed. Null language or source:
    groups of their own. Equal rows get equal results. An empty table gives no rows. The measures of
    a document need its whole text once; thresholds and verdicts work on the narrow measures table. Columns that
    are not named are ignored.
    """
    own = docs.select(
        F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"),
        F.col(text_col).alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep),
    )
    ratio = lambda a, b, k: F.expr(f"coalesce({k} * {a} DIV nullif({b}, 0), 0)")
    measured = text_measures(own, "_text")
    measured = measured if "_text" in (f"_keep_{c}" for c in keep) else measured.drop("_text")
    measured = (
        measured.withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        )
        .withColumn("sym", ratio("n_symbols", "n_words", 1000))
        .withColumn("dup", ratio("n_dup_lines", "n_lines", 1000))
        .withColumn("rep", ratio("n_repeat_words", "n_words", 1000))
        .withColumn("len", ratio("word_chars", "n_words", 100))
    )
    measured = materialise(measured, "measures")
    limits = adaptive_thresholds(measured.where("NOT base_failed"), "_lang", "_source")
    within = F.lit(True)
    for name, _, below in RATIOS:
        within = within & (F.col(f"m.{name}") <= F.col(f"t.hi_{name}"))
        if below is not None:
            within = within & (F.col(f"m.{name}") >= F.col(f"t.lo_{name}"))
    joined = measured.alias("m").join(
        limits.alias("t"),
        F.col("m._lang").eqNullSafe(F.col("t.lang")) & F.col("m._source").eqNullSafe(F.col("t.source")),
        "left",
    )
    return joined.select(
        F.col("m._id").alias(id_col), *(F.col(f"m._keep_{c}").alias(c) for c in keep),
        "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "m.base_failed",
        (~F.col("m.base_failed") & F.coalesce(within, F.lit(True))).alias("kept"),
    )


#: DuckDB SQL for op9's rows.
SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT rid, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM w WHERE len(w) >= 3
), g3 AS (
  SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM g
), r AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g3
), rep AS (
  SELECT rid, sum(CASE WHEN prev IS NULL THEN 3 ELSE least(3, i - prev) END)::BIGINT AS n_repeat_words
  FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM r WHERE n > 1) GROUP BY rid
), l AS (
  SELECT rid, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM w
), m AS (
  SELECT w.rid, doc_id, lang, source, len(w)::BIGINT AS n_words,
    (length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w JOIN l USING (rid) LEFT JOIN rep USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(1000 * n_symbols // nullif(n_words, 0), 0) AS sym, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup,
    coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS rep, coalesce(100 * word_chars // nullif(n_words, 0), 0) AS len FROM m
), v AS (
  SELECT lang, source, 'sym' AS ratio, sym AS v FROM f WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'dup', dup FROM f WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'rep', rep FROM f WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'len', len FROM f WHERE NOT base_failed
), cells AS (
  SELECT lang, source, ratio, bucket, count(*) AS n FROM (
    SELECT *, CASE WHEN v < 16 THEN v ELSE 16 * (length(bin(v)) - 5) + (v >> (length(bin(v)) - 5)::BIGINT) END AS bucket FROM v)
  GROUP BY ALL
), levels AS (
  SELECT lang, source, 0 AS level, ratio, bucket, n FROM cells
  UNION ALL SELECT lang, NULL, 1, ratio, bucket, sum(n) FROM cells GROUP BY lang, ratio, bucket
  UNION ALL SELECT NULL, NULL, 2, ratio, bucket, sum(n) FROM cells GROUP BY ratio, bucket
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, ratio) AS rows FROM levels
), qb AS (
  SELECT level, lang, source, ratio, rows, min(bucket) FILTER (100 * upto >= 10 * rows) AS b10,
    min(bucket) FILTER (100 * upto >= 50 * rows) AS b50, min(bucket) FILTER (100 * upto >= 90 * rows) AS b90
  FROM ranked GROUP BY ALL
), q AS (
  SELECT level, lang, source, ratio, rows,
    CASE WHEN b10 < 16 THEN b10 ELSE (b10 - 16 * (b10 // 16 - 1)) << (b10 // 16 - 1) END AS q10,
    CASE WHEN b50 < 16 THEN b50 ELSE (b50 - 16 * (b50 // 16 - 1)) << (b50 // 16 - 1) END AS q50,
    CASE WHEN b90 < 16 THEN b90 ELSE (b90 - 16 * (b90 // 16 - 1)) << (b90 // 16 - 1) END AS q90 FROM qb
), picked AS (
  SELECT o.lang, o.source, o.ratio,
    CASE WHEN o.rows >= 100 THEN o.q10 WHEN l.rows >= 100 THEN l.q10 ELSE a.q10 END AS q10,
    CASE WHEN o.rows >= 100 THEN o.q50 WHEN l.rows >= 100 THEN l.q50 ELSE a.q50 END AS q50,
    CASE WHEN o.rows >= 100 THEN o.q90 WHEN l.rows >= 100 THEN l.q90 ELSE a.q90 END AS q90
  FROM q o JOIN q l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM o.lang AND l.ratio = o.ratio
  JOIN q a ON a.level = 2 AND a.ratio = o.ratio WHERE o.level = 0
), t AS (
  SELECT lang, source, max(q90 + 3 * (q90 - q50) + 100) FILTER (ratio = 'sym') AS hi_sym,
    max(q90 + 3 * (q90 - q50) + 300) FILTER (ratio = 'dup') AS hi_dup, max(q90 + 3 * (q90 - q50) + 300) FILTER (ratio = 'rep') AS hi_rep,
    max(q90 + 3 * (q90 - q50) + 200) FILTER (ratio = 'len') AS hi_len, max(q10 - 3 * (q50 - q10) - 100) FILTER (ratio = 'len') AS lo_len
  FROM picked GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(sym <= hi_sym AND dup <= hi_dup AND rep <= hi_rep AND len <= hi_len AND len >= lo_len, true) AS kept
FROM f LEFT JOIN t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source
"""
