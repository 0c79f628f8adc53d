"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import crc_mod, map_rows

#: Length of the random vectors, letters in an n-gram, and labelled documents aimed at for each language.
DIMENSIONS, GRAM, SAMPLE_PER_LANGUAGE = 1024, 3, 3_000
#: n-gram vectors that a task keeps; beyond it they are made anew.
KEPT_GRAMS = 50_000
#: Tasks that the sample is bundled in, and so the partial bundles that reach the driver.
BUNDLE_TASKS = 16
UNKNOWN = "und"


class Hyperspace:
    """Random +1/-1 vectors for letters; an n-gram binds its letters' vectors, each rotated by its place."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = 11):
        self.dimensions, self.gram = dimensions, gram
        draw = np.random.default_rng(seed)
        letters = draw.integers(0, 2, (256, dimensions), dtype=np.int8) * 2 - 1
        self.rotated = [np.roll(letters, gram - 1 - i, axis=1) for i in range(gram)]
        self.codes: np.ndarray | None = None
        self.forget()

    def forget(self) -> None:
        """Keep no n-gram vectors; row_of has one place for each n-gram, most of which are never touched."""
        self.kept, self.row_of = 0, np.zeros(256**self.gram, np.int32)
        self.vectors = np.empty((1024, self.dimensions), np.float32)

    def letter_codes(self, size: int = 0x110000) -> np.ndarray:
        """Code of the code points below size at least: 0 for what is no letter, else 1 to 255; small letters of the first scripts have their own."""
        if self.codes is None or len(self.codes) < size:
            size = min(0x110000, max(2 * size, 0x4000))  # texts rarely go far, so that the whole table is seldom made
            point = np.arange(size)
            codes = (1 + (point * 2654435761 >> 7) % 255).astype(np.uint8)
            codes[:0x180] = 1 + point[:0x180] % 255
            letter = np.fromiter((chr(p).isalpha() for p in range(size)), bool, size)
            self.codes = np.where(letter, codes, 0).astype(np.uint8)
        return self.codes

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of the whole text's letters, runs of anything else as one space, and their counts."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
        codes = self.letter_codes(int(points.max(initial=0)) + 1)[points]
        if not codes.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = np.concatenate([[0], codes, [0]])
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])].astype(np.int64)
        if len(codes) < self.gram:
            codes = np.concatenate([codes, np.zeros(self.gram - len(codes), np.int64)])
        key = codes[: len(codes) - self.gram + 1].copy()
        for i in range(1, self.gram):
            key = key * 256 + codes[i : len(codes) - self.gram + 1 + i]
        return np.unique(key, return_counts=True)

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The sum of the n-gram vectors, each as often as it occurs; None without a letter."""
        keys, counts = self.grams(text)
        if not len(keys):
            return None
        if self.kept + len(keys) > KEPT_GRAMS:
            self.forget()
        rows = self.row_of[keys].astype(np.int64) - 1
        missing = keys[rows < 0]
        if len(missing):
            first, last = self.kept, self.kept + len(missing)
            if last > len(self.vectors):
                grown = np.empty((max(last, 2 * len(self.vectors)), self.dimensions), np.float32)
                grown[:first] = self.vectors[:first]
                self.vectors = grown
            bound = np.ones((len(missing), self.dimensions), np.int8)
            for i in range(self.gram):
                bound *= self.rotated[i][(missing >> (8 * (self.gram - 1 - i))) & 255]
            self.vectors[first:last] = bound
            rows[rows < 0] = np.arange(first, last)
            self.kept, self.row_of[missing] = last, np.arange(first + 1, last + 1)
        return counts.astype(np.float32) @ self.vectors[rows]


def train_languages(
    docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", folds: int = 3, held_out: int = 1, dimensions: int = DIMENSIONS,
) -> tuple[list[str], np.ndarray]:
    """Prototypes, one unit vector per language, from a hash sample with about sample_per_language distinct texts each.

    Only rows outside the held-out fold with a language and a text count. A text that repeats counts once, so a sample is bounded
    whatever repeats, ids or rows. A document adds its bundle at unit length. An empty table teaches no language.
    """
    usable = docs.where(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(id_col, folds) != held_out)
    ).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
        F.xxhash64(F.lit("languages"), F.col(text_col)).alias("hash"),
    )
    texts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    if not texts:
        return [], np.empty((0, dimensions))
    # The hash, as a number below 2^62, is compared with a limit for each language, so that rare languages are taken whole.
    limits = docs.sparkSession.createDataFrame(
        [(lang, 2**62 * sample_per_language // max(n, sample_per_language)) for lang, n in texts.items()], "lang string, share long"
    )
    # One row per language.
    sample = usable.join(F.broadcast(limits), "lang").where(F.col("hash").bitwiseAND(2**62 - 1) < F.col("share"))
    sample = sample.groupBy("lang", "hash").agg(F.first("text").alias("text"))

    def start():
        space = Hyperspace(dimensions)

        def step(batch):
            sums: dict[str, np.ndarray] = {}
            for lang, text in batch:
                bundle = space.bundle(text)
                if bundle is not None:
                    sums[lang] = sums.get(lang, 0) + bundle.astype(float) / np.linalg.norm(bundle)
            for lang, total in sums.items():
                yield lang, total.tolist()

        return step

    parts = map_rows(sample.select("lang", "text").repartition(BUNDLE_TASKS), "lang string, bundle array<double>", start).collect()
    total: dict[str, np.ndarray] = {}
    for r in sorted(parts, key=lambda r: (r["lang"], r["bundle"])):
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["bundle"])
    names = sorted(total)
    return names, np.array([total[n] / np.linalg.norm(total[n]) for n in names]).reshape(len(names), dimensions)


def identify_languages(
    docs: DataFrame, names: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
    folds: int = 3, held_out: int = 1,
) -> DataFrame:
    """(id, held_out, lang_pred, score), a row per input row, without a shuffle.

    The language with the largest cosine between document bundle and prototype, ties to the first name;
    score is that cosine, negative ones as 0. Null text or text without a letter, or no learned language: "und", score 0.
    Repeated rows and null ids are judged like others. An empty table gives no rows.
    """
    dimensions = prototypes.shape[1]
    transposed = np.ascontiguousarray(prototypes.T.astype(np.float32))
    own = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (crc_mod(id_col, folds) == held_out).alias("_held")
    )

    def start():
        space = Hyperspace(dimensions)

        def step(rows):
            for key, text, held in rows:
                bundle = space.bundle(text) if names else None
                norm = float(np.linalg.norm(bundle)) if bundle is not None else 0.0
                if not norm:
                    yield key, bool(held), UNKNOWN, 0.0
                    continue
                cosine = bundle @ transposed / norm
                best = int(np.argmax(cosine))
                yield key, bool(held), names[best], float(min(1.0, max(0.0, cosine[best])))

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(own, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double", start)
