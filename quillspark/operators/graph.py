"""Book-scoped multigraphs as two tables, and the operators over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark import schema as S
from quillspark.functions import text as X


def edges(relations: DataFrame) -> DataFrame:
    """(book_id, seq, src, dst, relation, chunk_id): one edge for each relation; parallel edges and self-loops stay."""
    return relations.where("book_id IS NOT NULL").select(
        "book_id", "seq", X.normalize_entity(F.col("entity1")).alias("src"), X.normalize_entity(F.col("entity2")).alias("dst"),
        "relation", "chunk_id",
    )


def nodes(relations: DataFrame) -> DataFrame:
    """(book_id, node, entity_type, surface_forms, first_seen): type of the first mention, all raw names."""
    ends = relations.where("book_id IS NOT NULL").select(
        "book_id",
        F.inline(
            F.array(
                F.struct(F.col("entity1").alias("raw"), F.col("entity1Type").alias("type"), (2 * F.col("seq")).alias("place")),
                F.struct(F.col("entity2").alias("raw"), F.col("entity2Type").alias("type"), (2 * F.col("seq") + 1).alias("place")),
            )
        ),
    )
    return ends.groupBy("book_id", X.normalize_entity(F.col("raw")).alias("node")).agg(
        F.min_by("type", "place").alias("entity_type"),
        F.sort_array(F.collect_set("raw")).alias("surface_forms"),
        F.min("place").alias("first_seen"),
    )


def _both_ways(edge_table: DataFrame) -> DataFrame:
    """Each edge from both of its ends, of one pass over the edges."""
    forward = F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("forward").alias("direction"))
    backward = F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("reverse").alias("direction"))
    return edge_table.select("book_id", F.inline(F.array(forward, backward)), "relation", "seq")


def arcs(edge_table: DataFrame) -> DataFrame:
    """(book_id, node, other, relation, direction, arc_rank): what can be walked from a node, in order of discovery.

    Edges forward, then symmetric edges backward; within a direction, neighbours in order of their first edge of
    any relation, then their edges in order. Of arcs to one neighbour by one relation and direction the
    first stays. Computed once and stored, so that path searches only join.
    """
    met = Window.partitionBy("book_id", "node", "direction", "other")
    both = _both_ways(edge_table).withColumn("met", F.min("seq").over(met))
    both = both.where((F.col("direction") == "forward") | X.is_symmetric(F.col("relation")))
    order = Window.partitionBy("book_id", "node").orderBy("direction", "met", "seq", "other", "relation")
    ranked = both.withColumn("arc_rank", F.row_number().over(order).cast("long"))
    return ranked.groupBy("book_id", "node", "other", "relation", "direction").agg(F.min("arc_rank").alias("arc_rank"))


def arc_pairs(edge_table: DataFrame) -> DataFrame:
    """(book_id, node, other): the distinct ends of arcs, without their order."""
    both = _both_ways(edge_table).where((F.col("direction") == "forward") | X.is_symmetric(F.col("relation")))
    return both.where("node IS NOT NULL AND other IS NOT NULL").select("book_id", "node", "other").distinct()


def all_arcs(edge_table: DataFrame) -> DataFrame:
    """As arcs, with parallel edges as arcs of their own."""
    met = Window.partitionBy("book_id", "node", "direction", "other")
    both = _both_ways(edge_table).withColumn("met", F.min("seq").over(met))
    both = both.where((F.col("direction") == "forward") | X.is_symmetric(F.col("relation")))
    order = Window.partitionBy("book_id", "node").orderBy("direction", "met", "seq", "other", "relation")
    return both.withColumn("arc_rank", F.row_number().over(order).cast("long")).drop("met", "seq")


def mirrored(edge_table: DataFrame) -> DataFrame:
    """The edges, and the symmetric ones once more the other way round."""
    return edge_table.select("book_id", "src", "dst", "relation", "chunk_id").unionAll(
        edge_table.where(X.is_symmetric(F.col("relation"))).select(
            "book_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "chunk_id"
        )
    )


def degrees(edge_table: DataFrame) -> DataFrame:
    """(book_id, node, degree); a self-loop counts twice."""
    return (
        edge_table.select("book_id", F.explode(F.array("src", "dst")).alias("node")).groupBy("book_id", "node").agg(F.count("*").alias("degree"))
    )


def degree_summary(edge_table: DataFrame) -> DataFrame:
    return degrees(edge_table).groupBy("book_id").agg(
        F.count("*").alias("n_nodes"), F.max("degree").alias("max_degree"), F.expr("percentile(degree, 0.5)").alias("median_degree"),
        F.round(F.avg("degree"), 6).alias("mean_degree"),
    )


def hubs(edge_table: DataFrame, times: int = 3) -> DataFrame:
    """Nodes with more than so many times their book's median degree."""
    d = degrees(edge_table)
    m = d.groupBy("book_id").agg(F.expr("percentile(degree, 0.5)").alias("median_degree"))
    return d.join(m, "book_id").where(F.col("degree") > times * F.col("median_degree"))


def pair_facts(pairs: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Every stored edge between the two ends of each pair (book_id, a, b), in either direction: one equi join on the sorted pair."""
    keyed = lambda t, x, y: t.withColumns({"lo": F.least(x, y), "hi": F.greatest(x, y)})
    return keyed(pairs, "a", "b").join(keyed(edge_table, "src", "dst"), ["book_id", "lo", "hi"]).drop("lo", "hi")


def bidirectional_pairs(edge_table: DataFrame) -> DataFrame:
    """(book_id, relation, lo, hi, strict): pairs stored both ways by one relation, without a self-join."""
    between = edge_table.where("src <> dst").groupBy("book_id", "relation", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    found = between.agg(F.min("src").alias("a"), F.max("src").alias("b")).where("a <> b").drop("a", "b")
    return found.withColumn("strict", F.col("relation").isin("parent_father_of", "parent_mother_of", "child_of"))


def steps(edge_table: DataFrame, role_relations_only: bool = True) -> DataFrame:
    """(book_id, relation, role, node, next): neighbours by role, e1 sources into a node, e2 targets from it, sym both."""
    spark = edge_table.sparkSession
    roles = spark.createDataFrame([(r, w) for r, w, _ in S.ROLE_STEPS], "relation string, role string")
    usable = edge_table.where("src <> dst") if role_relations_only else edge_table
    pairs = usable.select("book_id", "relation", "src", "dst").distinct().join(F.broadcast(roles), "relation")  # a fixed list
    into = pairs.where("role IN ('e1', 'sym')").select("book_id", "relation", "role", F.col("dst").alias("node"), F.col("src").alias("next"))
    out = pairs.where("role IN ('e2', 'sym')").select("book_id", "relation", "role", F.col("src").alias("node"), F.col("dst").alias("next"))
    return into.unionByName(out).distinct()


def frontiers(edge_table: DataFrame) -> DataFrame:
    """(book_id, node, relation, role, frontier): where each step leads from each nameable node, sorted."""
    found = steps(edge_table).where(X.is_nameable(F.col("node")))
    return found.groupBy("book_id", "node", "relation", "role").agg(F.sort_array(F.collect_set("next")).alias("frontier"))


def frontier_category(frontier) -> Column:
    """pure, pronoun_generic, surface_variant or unrelated: why a frontier of one step has several members."""
    longest = F.get(F.array_sort(F.transform(frontier, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), F.lit(0))["x"]
    overlap = F.forall(frontier, lambda x: F.arrays_overlap(X.tokens(x), X.tokens(longest)))
    return (
        F.when(F.size(frontier) <= 1, "pure")
        .when(F.exists(frontier, X.is_pronoun_generic), "pronoun_generic")
        .when(overlap, "surface_variant")
        .otherwise("unrelated")
    )


def two_step_walks(edge_table: DataFrame, nameable=X.is_nameable) -> DataFrame:
    """(book_id, anchor, first, second, gold): two role steps from anchors that `nameable` admits, through a single middle node only."""
    step = steps(edge_table).withColumn("label", F.concat_ws(":", "relation", "role"))
    first = (
        step.where(nameable(F.col("node"))).where("next <> node")
        .groupBy("book_id", F.col("node").alias("anchor"), F.col("label").alias("first"))
        .agg(F.min("next").alias("middle"), F.max("next").alias("last")).where("middle = last").drop("last")
    )
    second = step.select("book_id", F.col("node").alias("middle"), F.col("label").alias("second"), "next")
    return (
        first.join(second, ["book_id", "middle"]).where("next <> anchor")
        .groupBy("book_id", "anchor", "first", "second").agg(F.sort_array(F.collect_set("next")).alias("gold"))
    )


def templated_chains(edge_table: DataFrame) -> DataFrame:
    """Distinct (book_id, a, r1, b, r2, c): two templated edges in a row that do not lead back."""
    e = edge_table.where(F.col("relation").isin(*S.PREDICATES)).select("book_id", "src", "relation", "dst").distinct()
    one = e.select("book_id", F.col("src").alias("a"), F.col("relation").alias("r1"), F.col("dst").alias("b"))
    two = e.select("book_id", F.col("src").alias("b"), F.col("relation").alias("r2"), F.col("dst").alias("c"))
    return one.join(two, ["book_id", "b"]).where("a <> c").select("book_id", "a", "r1", "b", "r2", "c")


def coordinated_possessors(edge_table: DataFrame) -> DataFrame:
    """(book_id, relation, target, first, second): the first two sources of kinship targets with two at least."""
    kin = edge_table.where(F.col("relation").isin("parent_father_of", "parent_mother_of", "child_of", "sibling_of", "spouse_of"))
    met = kin.where("src <> dst").groupBy("book_id", "relation", F.col("dst").alias("target"), "src").agg(F.min("seq").alias("seq"))
    order = Window.partitionBy("book_id", "relation", "target").orderBy("seq")
    return (
        met.withColumn("n", F.row_number().over(order)).where("n <= 2")
        .groupBy("book_id", "relation", "target")
        .agg(F.max(F.when(F.col("n") == 1, F.col("src"))).alias("first"), F.max(F.when(F.col("n") == 2, F.col("src"))).alias("second"))
        .where("second IS NOT NULL")
    )


def relation_histogram(relations: DataFrame, top: int = 48) -> DataFrame:
    """(relation, n, share, in_top, canonical): counts over all books, with the share of the most frequent types."""
    n = relations.groupBy("relation").agg(F.count("*").alias("n"))
    ranked = n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "relation")))  # one row per type
    return ranked.select(
        "relation", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"),
        (F.col("place") <= top).alias("in_top"), X.is_canonical(F.col("relation")).alias("canonical"),
    )


def entity_type_histogram(relations: DataFrame) -> DataFrame:
    return relations.select(F.explode(F.array("entity1Type", "entity2Type")).alias("entity_type")).groupBy("entity_type").agg(F.count("*").alias("n"))


def typed_ends(relations: DataFrame, entity_type: str) -> DataFrame:
    """(book_id, name, other_type, slot, n): names of a type in either slot, with the type across."""
    one = relations.where(F.col("entity1Type") == entity_type).select("book_id", F.col("entity1").alias("name"), F.col("entity2Type").alias("other_type"), F.lit(1).alias("slot"))
    two = relations.where(F.col("entity2Type") == entity_type).select("book_id", F.col("entity2").alias("name"), F.col("entity1Type").alias("other_type"), F.lit(2).alias("slot"))
    return one.unionByName(two).groupBy("book_id", "name", "other_type", "slot").agg(F.count("*").alias("n"))
