"""I-Match document fingerprints over several randomised lexicon subsets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import SLICE_ROWS, give_back, map_rows, materialise, small_batches

#: Band of document frequency, as shares of all documents: terms outside it are not in the lexicon.
#: A document has T distinct terms on average, so at most T / LEAST_SHARE terms lie in the band, whatever the corpus;
#: all of them are broadcast, 8 bytes each.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.2
#: The full lexicon, then (halvings, subsets): so many random subsets after so many halvings of it. Of any text some
#: subsets hold a term or two, and these are the ones that survive an edit.
SUBSETS = ((1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 5), (8, 5), (9, 5), (10, 5))
#: Hex digits for each subset's hash; an empty subset has dashes.
DIGITS = 4
#: Most partitions of the ordered pass.
MAX_RANGES = 20_000

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class TermHashes(dict):
    limit = 200_000

    def __missing__(self, term: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[term] = xxhash.xxh3_64_intdigest(term)
        return value


def distinct_terms(text: str | None, hashes: TermHashes) -> np.ndarray:
    """Sorted hashes of the distinct terms of a whole text: runs of digits, letters and anything beyond ASCII, A-Z lower-cased."""
    terms = set(text.encode().translate(_WORD_BYTES).split()) if text else ()
    return np.sort(np.fromiter(map(hashes.__getitem__, terms), np.uint64, len(terms)))


def subset_seeds(seed: int = 5) -> list[tuple[int, int]]:
    draw = np.random.default_rng(seed)
    return [(0, 0)] + [(h, int(draw.integers(1, 2**63))) for h, n in SUBSETS for _ in range(n)]


class IMatch:
    """Fingerprints against a sorted array of lexicon hashes."""

    def __init__(self, lexicon: np.ndarray):
        self.lexicon, self.hashes, self.seeds = lexicon, TermHashes(), subset_seeds()

    def fingerprint(self, text: str | None) -> str:
        """Hashes of the sorted terms in each subset. A text without lexicon terms takes all its terms instead."""
        terms = distinct_terms(text, self.hashes)
        if len(self.lexicon) and len(terms):
            at = np.searchsorted(self.lexicon, terms)
            at[at == len(self.lexicon)] = 0
            inside = terms[self.lexicon[at] == terms]
            terms = inside if len(inside) else terms
        parts = []
        for halvings, seed in self.seeds:
            chosen = terms
            if halvings and len(terms):
                mixed = (terms ^ np.uint64(seed)) * _MULTIPLY
                chosen = terms[((mixed ^ (mixed >> np.uint64(29))) * _MULTIPLY) >> np.uint64(64 - halvings) == 0]
            parts.append(
                hashlib.blake2b(chosen.tobytes(), digest_size=DIGITS // 2).hexdigest() if len(chosen) else "-" * DIGITS
            )
        return "".join(parts)


def likeness(a: str, b: str) -> float:
    """The share of subsets with equal hashes among those that are not empty on both sides; equal fingerprints: 1."""
    if a == b:
        return 1.0
    empty = "-" * DIGITS
    pairs = [(a[i : i + DIGITS], b[i : i + DIGITS]) for i in range(0, len(a), DIGITS)]
    pairs = [(x, y) for x, y in pairs if x != empty or y != empty]
    return sum(x == y for x, y in pairs) / len(pairs)


def edited_text(text: str, following: str) -> str:
    """The text with the last quarter of its code points replaced by as many of the following text's first, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def build_lexicon(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the terms in the band, from document frequencies over all documents.

    Each task counts distinct terms of its documents and hands on sums; the sums of a term meet in one place.
    """

    def run(batches):
        hashes, held, kept = TermHashes(), [], 0

        def counted():
            term, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                    held.append(distinct_terms(text, hashes))
                    kept += len(held[-1])
                if kept > 4_000_000:
                    yield counted()
                    held, kept = [], 0
        if kept:
            yield counted()
        del hashes, held
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(text_col).count()
    counts = docs.select(text_col).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where(f"n >= {LEAST_SHARE * rows} AND n <= {max(1.0, MOST_SHARE * rows)}"), "lexicon")
    found = np.fromiter((r["term"] for r in counts.select("term").toLocalIterator()), np.int64)
    return np.sort(found.view(np.uint64))


def fingerprint_documents(
    docs: DataFrame, lexicon: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fingerprint), a row per input row, without a shuffle once the lexicon is there.

    Equal texts, and texts with the same distinct lexicon terms, have equal fingerprints. Null or empty text: dashes.
    """
    lexicon = build_lexicon(docs, text_col) if lexicon is None else lexicon
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def start():
        match = IMatch(shared.value)

        def step(rows):
            for key, text in rows:
                yield key, match.fingerprint(text)

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {kind}, fingerprint string", start)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per input row.

    One exchange brings the texts into the order of ids, cut into ranges; each range is read once as a stream that holds
    two documents. The last document of a range meets the first of the next range that has any in a join of those two documents
    of each range. Ids may repeat: rows are then ordered by a hash of the text and by place, so a range may begin amid
    the rows of one id; null ids come first. Null text counts as empty. A single row is followed by itself. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    placed = own.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    shared = spark.sparkContext.broadcast(build_lexicon(own))
    kind = docs.schema[id_col].dataType.simpleString()
    ranges = min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), own.select("id").count() // 20_000))
    columns = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = (
        f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def judged(match, own_row, next_row):
        key, text, mark = own_row
        changed = edited_text(text, next_row[1])
        other = match.fingerprint(changed)
        return (
            key, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, other, likeness(mark, other), likeness(mark, next_row[2])
        )

    def ordered(batches):
        from pyspark import TaskContext

        part, match, held, first = TaskContext.get().partitionId(), IMatch(shared.value), None, None
        blank = (None,) * 6

        def out(rows):
            return pa.RecordBatch.from_pylist([dict(zip([*columns, "text", "part", "edge"], r)) for r in rows], schema=target)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = []
                for key, text in zip(*(c.slice(at, SLICE_ROWS).to_pylist() for c in batch.columns)):
                    row = (key, text, match.fingerprint(text))
                    if held is None:
                        first = row
                    else:
                        rows.append((*judged(match, held, row), None, part, 0))
                    held = row
                if rows:
                    yield out(rows)
        if held is not None:
            edge = lambda r, k: (r[0], None, None, r[2], None, None, None, r[1], part, k)
            yield out([edge(first, 1), edge(held, 2)])
        del match
        give_back()

    def meet():
        match = IMatch(shared.value)

        def step(rows):
            for key, text, mark, next_text, next_mark in rows:
                yield judged(match, (key, text, mark), (None, next_text, next_mark))

        return step

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema + ", text string, part int, edge int"))
    lines = placed.repartitionByRange(ranges, "id", "hash", "place").sortWithinPartitions("id", "hash", "place").select("id", "text")
    done = materialise(lines.mapInArrow(ordered, schema + ", text string, part int, edge int"), "ordered")
    # Two documents for each range; the ranges that have any are numbered, at most MAX_RANGES numbers.
    ends = done.where("edge > 0").select("id", "fingerprint", "text", "part", "edge")
    numbers = ends.where("edge = 1").select("part").withColumn("n", F.row_number().over(Window.orderBy("part")))
    numbers = numbers.withColumn("next", F.col("n") % F.count("*").over(Window.partitionBy()) + 1)
    numbered = ends.join(F.broadcast(numbers), "part")
    first = numbered.where("edge = 1").select(F.col("n").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    seams = numbered.where("edge = 2").join(first, "next").select("id", "text", "fingerprint", "next_text", "next_mark")
    return done.where("edge = 0").select(*columns).unionByName(map_rows(seams, schema, meet)).withColumnRenamed("id", id_col)
