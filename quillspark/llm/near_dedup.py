"""MinHash near-duplicate detection with tensored banding and exact verification."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import aggregated, map_rows, materialise, release
from quillspark.llm.components import connected_components

#: Similarity in percent and words in a shingle.
PERCENT, SHINGLE = 85, 3
#: Two collections of so many bands of so many minhashes: BANDS x BANDS tables from 2 x BANDS x ROWS minhashes.
#: At similarity 0.85 a pair misses all tables with probability 2 (1 - 0.85^2)^12 = 4e-7, at 0.8 with 1e-5.
BANDS, ROWS = 12, 2
#: Different leaders that the tables of one group of copies choose.
LEADERS = 3
#: Most document ids broadcast to pick the candidates' texts (8 bytes each); beyond it they are shuffled.
BROADCAST_IDS = 2_000_000
#: Members of a table's group between which pairs are made directly.
SMALL_GROUP = 32
#: In larger groups, a shingle is rare if at most so many of their members have it.
RARE = 16

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _M2
    x = (x ^ (x >> _S32)) * _M2
    return x ^ (x >> _S32)


class WordHashes(dict):
    """64-bit hashes of words, kept for the words of late."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the whole text's shingles; with fewer words the whole sequence is one."""
    words = text.encode().lower().split() if text else []  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64) * _M1
    for i in range(width):
        total = mix(total + h[i : len(h) - width + 1 + i]) * _M1
    return np.unique(total)


def band_hashes(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Hashes of the bands of both collections; multipliers has one odd number for each minhash."""
    low = np.full(len(multipliers), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[None, at : at + 4096] * multipliers[:, None]).min(1))
    low = mix(low).reshape(-1, ROWS)
    out = np.zeros(len(low), np.uint64)
    for i in range(ROWS):
        out = mix(out * _M1 + low[:, i])
    return out


def minhash_multipliers(seed: int = 7) -> np.ndarray:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 2**63, 2 * BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _digests(docs: DataFrame, kind: str, size: int) -> DataFrame:
    """(id, n, d1, d2, bands): set size, 128-bit digest of the set, and the bands' hashes."""

    def start():
        hashes, multipliers = WordHashes(), minhash_multipliers()

        def step(rows):
            for key, text in rows:
                own = shingle_set(text, hashes, size)
                if not len(own):
                    yield key, 0, 0, 0, None
                    continue
                digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                yield key, len(own), int(digest[0]), int(digest[1]), band_hashes(own, multipliers).view(np.int64).tolist()

        return step

    return map_rows(docs, f"id {kind}, n bigint, d1 bigint, d2 bigint, bands array<bigint>", start)


def _sets(docs: DataFrame, kind: str, size: int) -> DataFrame:
    def start():
        hashes = WordHashes()

        def step(rows):
            for key, text in rows:
                yield key, shingle_set(text, hashes, size).tobytes()

        return step

    return map_rows(docs, f"id {kind}, shingles binary", start)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, kind: str, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"
    )

    def start():
        def step(rows):
            for a, b, sa, sb in rows:
                if similar(np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64), percent):
                    yield a, b

        return step

    return map_rows(joined.select("a", "b", "sa", "sb"), f"src {kind}, dst {kind}", start)


def _close_in_size(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE
) -> DataFrame:
    """(id, n_shingles, component_id, kept), a row per input row; component_id is the smallest id reachable over links.

    Linked are documents whose sets of shingles of so many words are similar by so many percent or more.

    1. Digest every document: distinct shingles, 2 x BANDS band hashes. 2. Documents with equal sets are one class, known
    by its smallest id. 3. A band that no other class shares can't be part of a shared table key; the rest are
    combined, each of the first collection with each of the second, into table keys. 4. In each table every member is verified
    against one leader. 5. Members of a table that are not yet in one component are verified against each other:
    directly in small groups; in larger ones where they share a rare shingle or where their sizes and cores allow similarity
    without one. So every pair that shares a table key is verified on full sets, is connected already, or is
    proven not to be similar. 6. Components of the verified links.

    Null, empty or blank text: n_shingles 0, linked with nothing. A null id can't be linked: component_id
    null, kept. Rows that repeat an id are one node with the links of each. An empty table gives no rows. Other
    columns are ignored. Nothing of a group is collected anywhere: classes, leaders and counts are partial aggregates,
    written out before rows join back to them if there are many, so that adaptive execution can split a hot key's join.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    digests = materialise(_digests(own, kind, shingle), "digests")
    rows = digests.count()  # a key of any join below is held at most once by each
    whole = digests.where("n > 0 AND id IS NOT NULL")
    equal = whole.groupBy("n", "d1", "d2").agg(F.min("id").alias("least_id"), F.count("*").alias("times")).where("times > 1")
    equal = aggregated(equal.drop("times"), "classes", rows)
    members = whole.join(equal, ["n", "d1", "d2"], "left").withColumn("rep", F.coalesce("least_id", "id")).select(
        "id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")
    )
    members = materialise(members, "members")
    keys = _table_keys(members.where("bands IS NOT NULL"), rows)
    # Members of groups of two or more; the leader is the smallest under one of a few keyed hashes.
    groups = keys.groupBy("key", "turn").agg(F.min("draw").alias("lead_draw"), F.count("*").alias("size")).where("size > 1")
    groups = aggregated(groups, "groups", rows)
    grouped = materialise(keys.join(groups, ["key", "turn"]), "grouped")
    leaders = grouped.where("draw = lead_draw").groupBy("key").agg(
        F.min("id").alias("lead"), F.min("n").alias("lead_least"), F.max("n").alias("lead_most")
    )
    leaders = aggregated(leaders, "leaders", rows)
    wanted = materialise(grouped.select("id").distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        picked = own.join(F.broadcast(wanted), "id", "left_semi")
    else:
        picked = own.join(wanted, "id", "left_semi")
    sets = materialise(_sets(picked, kind, shingle), "sets")
    led = (
        grouped.join(leaders, "key").where("id <> lead")
        .where((100 * F.col("lead_most") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("lead_least")))
        .select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    )
    links = materialise(_verified(led, sets, kind, percent), "leader-links")
    rest = _unsettled(grouped, leaders, links, rows)
    small = _between_few(rest.where(F.col("members") <= SMALL_GROUP), sets, kind, percent)
    links = materialise(links.union(small), "more-links")
    large = rest.where(F.col("members") > SMALL_GROUP)
    if not large.isEmpty():
        bands = members.where("bands IS NOT NULL").select("id", "bands")
        links = _between_many(large, bands, links, sets, kind, percent, rows)
    same = members.where("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    components = connected_components(links.union(same).distinct())
    release(equal, members, groups, grouped, leaders, wanted, sets, rest)
    return digests.join(components, digests["id"] == components["node"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        (F.col("id").isNull() | F.col("component").isNull() | (F.col("id") == F.col("component"))).alias("kept"),
    )


def _table_keys(classes: DataFrame, rows: int) -> DataFrame:
    """(key, first_key, i, turn, id, n, draw): tensored table keys of (id, n, bands), without those no other class can share.

    first_key is that of the band of the first collection alone, and i its place. draw orders a group for the choice of its leader, differently for each turn.
    """
    bands = classes.select("id", "n", F.posexplode("bands").alias("slot", "band"))
    shared = bands.groupBy("slot", "band").agg(F.count("*").alias("holders")).where("holders > 1").drop("holders")
    left = bands.join(aggregated(shared, "shared", rows), ["slot", "band"])
    # At most 2 x BANDS rows for each class.
    held = left.groupBy("id", "n").agg(F.collect_list(F.struct("slot", "band")).alias("held"))
    pairs = held.select(
        "id", "n",
        F.explode(F.filter("held", lambda x: x["slot"] < BANDS)).alias("x"),
        F.filter("held", lambda x: x["slot"] >= BANDS).alias("ys"),
    ).select("id", "n", "x", F.explode("ys").alias("y"))
    turn = F.pmod(F.col("x.slot"), F.lit(LEADERS))
    return materialise(pairs.select(
        F.xxhash64("x.slot", "y.slot", "x.band", "y.band").alias("key"),
        F.xxhash64("x.slot", "x.band").alias("first_key"), F.col("x.slot").alias("i"), turn.cast("int").alias("turn"), "id", "n", F.xxhash64(turn, "id").alias("draw"),
    ).distinct(), "keys")


def _unsettled(grouped: DataFrame, leaders: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """(key, first_key, i, id, n, component, members) of the groups whose members, but for the leader, lie in several components."""
    found = materialise(connected_components(links), "first-components")
    placed = (
        grouped.where("size > 2").join(leaders.select("key", "lead"), "key").where("id <> lead")
        .join(found.withColumnRenamed("node", "id"), "id", "left")
        .select("key", "first_key", "i", "id", "n", F.coalesce("component", "id").alias("component"))
    )
    placed = materialise(placed, "placed")
    split = placed.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")
    ).where("lo <> hi").select("key", "members")
    split = aggregated(split, "split", rows)
    rest = materialise(placed.join(split, "key"), "unsettled")
    release(found, placed, split)
    return rest


def _between_few(small: DataFrame, sets: DataFrame, kind: str, percent: int) -> DataFrame:
    """Verified links between different components of each small group: at most SMALL_GROUP^2 / 2 pairs for each."""
    x, y = small.alias("x"), small.alias("y")
    direct = (
        x.join(y, F.col("x.key") == F.col("y.key"))
        .where("x.id < y.id AND x.component <> y.component")
        .where(_close_in_size("x.n", "y.n", percent))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        .distinct()
    )
    return _verified(direct, sets, kind, percent)


def _between_many(
    large: DataFrame, bands: DataFrame, links: DataFrame, sets: DataFrame, kind: str, percent: int, rows: int
) -> DataFrame:
    """links with those between different components of each large group, without making all pairs of a group.

    A shingle is rare if at most RARE members of large groups have it; a member's core are its other shingles.
    Two similar members either share a rare shingle, and are met in that shingle's short list (_sharing), or have all that they share in
    both cores: then 100 * least core >= percent * (sum of sizes - least core). That bound holds for hardly any
    pair but those close to what the group has in common, and most of these are linked through the member with the
    fewest rare shingles, which is verified first. What the bound still allows between components is verified; members
    that meet many times make a pair at their first common band only.

    As this holds for any two documents, members are grouped by their bands of the first collection alone: groups that contain
    those of the tables, and one row for each of a member's bands instead of one for each of its tables.
    """
    large = large.select(F.col("first_key").alias("key"), "i", "id", "n", "component").distinct()
    owners = large.select("id").distinct()
    tokens = materialise(_tokens(sets.join(owners, "id", "left_semi"), kind), "tokens")
    rare = _rare_tokens(tokens)
    # An id that repeats with several sets keeps the largest size as its core, which rules nothing out.
    counted = rare.groupBy("id").agg(F.count("*").alias("rare"))
    cores = tokens.groupBy("id").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("all")).join(counted, "id", "left")
    cores = materialise(cores.select(
        "id", "n", F.when(F.col("all") > F.col("n"), F.col("most")).otherwise(F.col("n") - F.coalesce("rare", F.lit(0))).alias("core"),
        (F.col("all") == F.col("n")).alias("single"),
    ), "cores")
    placed = materialise(large.drop("n").join(cores, "id"), "large")
    part = placed.select("id", "n", "core", "single", "component").distinct()
    sharing = _sharing(rare, part, percent)
    centres = placed.groupBy("key").agg(F.min_by("id", F.struct(F.col("n") - F.col("core"), "id")).alias("centre"))
    centres = centres.join(
        part.select(F.col("id").alias("centre"), F.col("component").alias("cc"), F.col("n").alias("cn"), F.col("core").alias("ck")), "centre"
    )
    centres = aggregated(centres, "centres", rows)
    around = placed.join(centres, "key").where("component <> cc").where(_cores_suffice("n", "core", "cn", "ck", percent)).select(
        F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")
    )
    links = materialise(links.union(_verified(sharing.union(around).distinct(), sets, kind, percent)), "centre-links")
    found = connected_components(links).withColumnRenamed("node", "id").withColumnRenamed("component", "now")
    smallest = aggregated(placed.groupBy("key").agg(F.min("n").alias("least_n")), "smallest", rows)
    close = placed.join(smallest, "key").where(_cores_suffice("n", "core", "least_n", "core", percent))
    close = close.join(found, "id", "left").withColumn("component", F.coalesce("now", "component")).drop("now", "least_n")
    close = materialise(close, "close")
    split = close.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    split = aggregated(split, "split", rows)
    open_rows = materialise(close.join(split, "key").join(bands, "id"), "open")
    x, y = open_rows.alias("x"), open_rows.alias("y")
    last = (
        x.join(y, F.col("x.key") == F.col("y.key"))
        .where("x.id < y.id AND x.component <> y.component").where(_close_in_size("x.n", "y.n", percent))
        .where(_cores_suffice("x.n", "x.core", "y.n", "y.core", percent))
        .where(_first_shared() == F.col("x.i"))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    )
    out = materialise(links.union(_verified(last, sets, kind, percent)), "all-links")
    release(tokens, rare, cores, placed, centres, smallest, close, split, open_rows)
    return out


def _rare_tokens(tokens: DataFrame) -> DataFrame:
    """(id, token, holders) of the shingles (id, n, token) that at most RARE members have.

    Most shingles have one or two holders, which a count's least and greatest id name; only the others are joined back.
    """
    held = tokens.groupBy("token").agg(F.count("*").alias("holders"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    held = materialise(held.where(F.col("holders") <= RARE), "held")
    named = held.where("holders <= 2").select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("id"), "token", "holders")
    joined = tokens.select("id", "token").join(held.where("holders > 2").select("token", "holders"), "token").select("id", "token", "holders").distinct()
    rare = materialise(named.unionByName(joined), "rare")
    release(held)
    return rare


def _sharing(rare: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of different components that share a rare shingle and may be similar.

    Each member's shingles are in one order, fewest holders first. The first shingle that two sets share leaves
    them no more in common than what follows it in each; if they are similar, that is still enough. So only a
    member's shingles with a large enough rest can be the first shared one with a similar member, and a pair is made only where
    the places of the shingle in both orders leave enough. Members with several sets under one id are left out of this reckoning.
    """
    in_order = Window.partitionBy("id").orderBy("holders", "token")
    listed = (
        rare.withColumn("place", F.row_number().over(in_order)).where("holders > 1").join(part.drop("core"), "id")
        .withColumn("left", F.when(F.col("single"), F.col("n") - F.col("place") + 1))
        .where(F.col("left").isNull() | (100 * F.col("left") >= percent * F.col("n")))
        .select("token", "id", "n", "left", "component")
    )
    x, y = listed.alias("x"), listed.alias("y")
    enough = (100 + percent) * F.least("x.left", "y.left") >= percent * (F.col("x.n") + F.col("y.n"))
    return x.join(y, F.col("x.token") == F.col("y.token")).where("x.id < y.id AND x.component <> y.component").where(
        F.col("x.left").isNull() | F.col("y.left").isNull() | enough
    ).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _first_shared():
    """Place of the first band of the first collection that the rows x and y share."""
    same = F.zip_with(F.slice("x.bands", 1, BANDS), F.slice("y.bands", 1, BANDS), lambda a, b: a == b)
    return F.array_position(same, True) - 1


def _cores_suffice(n: str, core: str, other_n: str, other_core: str, percent: int):
    """Whether two members without a common rare shingle may be similar, by sizes and cores."""
    least = F.least(core, other_core)
    return (100 + percent) * least >= percent * (F.col(n) + F.col(other_n))


def _tokens(sets: DataFrame, kind: str) -> DataFrame:
    """(id, n, token): every shingle of every set."""

    def start():
        def step(rows):
            for key, shingles in rows:
                yield key, len(shingles) // 8, np.frombuffer(shingles, np.int64).tolist()

        return step

    listed = map_rows(sets.select("id", "shingles"), f"id {kind}, n bigint, tokens array<bigint>", start)
    return listed.select("id", "n", F.explode("tokens").alias("token"))
