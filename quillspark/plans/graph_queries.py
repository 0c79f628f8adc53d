"""Queries on names, relations and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import schema as S
from quillspark.functions import text as X
from quillspark.operators import evaluation, graph, paths, resolution, vector
from quillspark.plans.common import (
    ARCS, CANONICAL, EVENTS, LINES, STEPS, SYMMETRIC, core, event_edges, event_nodes, flat, line_edges, listed, nameable, norm, pronoun, query,
    sentence, words, array,
)
from quillspark.sources import relations as R


@query(f"with {EVENTS} select book_id, seq, src, dst, relation, chunk_id from e")
def graph_edges(spark, sf_dir):
    return event_edges(spark, sf_dir)


@query(f"with {LINES} select book_id, seq, src, dst, relation, chunk_id from e3")
def graph_edges_lines(spark, sf_dir):
    return line_edges(spark, sf_dir)


_NODES = f"""ends as (
  select book_id, entity1 as raw, entity1Type as type, 2 * seq as place from raw
  union all select book_id, entity2, entity2Type, 2 * seq + 1 from raw
), nodes as (
  select book_id, {norm('raw')} as node, arg_min(type, place) as entity_type, list_sort(list(distinct raw)) as surface_forms, min(place) as first_seen
  from ends group by 1, 2
)"""


@query(f"with {EVENTS}, {_NODES} select book_id, node, entity_type, array_to_string(surface_forms, '|') as surface_forms, first_seen from nodes")
def graph_nodes(spark, sf_dir):
    return flat(event_nodes(spark, sf_dir))


@query(f"with {EVENTS}, {_NODES} select (select count(*) from e) as n_edges, (select count(*) from nodes) as n_nodes, (select count(distinct book_id) from e) as n_books")
def corpus_totals(spark, sf_dir):
    e = event_edges(spark, sf_dir).agg(F.count("*").alias("n_edges"), F.count_distinct("book_id").alias("n_books"))
    return e.join(F.broadcast(event_nodes(spark, sf_dir).agg(F.count("*").alias("n_nodes"))))  # single rows


@query(f"with {EVENTS} select book_id, arg_min(entity1, seq) as title from raw group by 1")
def title_per_book(spark, sf_dir):
    return R.event_relations(spark, sf_dir).groupBy("book_id").agg(F.min_by("entity1", "seq").alias("title"))


@query(f"""with {EVENTS}, names as (select entity1 as raw from raw union select entity2 from raw)
select {norm('raw')} as canonical, count(*) as n_names, array_to_string(list_sort(list(raw)), '|') as names from names group by 1 having count(*) > 1""")
def name_collisions(spark, sf_dir):
    names = R.event_relations(spark, sf_dir).select(F.explode(F.array("entity1", "entity2")).alias("raw")).distinct()
    return flat(
        names.groupBy(X.normalize_entity(F.col("raw")).alias("canonical"))
        .agg(F.count("*").alias("n_names"), F.sort_array(F.collect_list("raw")).alias("names")).where("n_names > 1")
    )


@query(f"with {EVENTS} select book_id, seq, {sentence('entity1', 'entity2', 'relation')} as sentence from raw")
def relation_sentences(spark, sf_dir):
    r = R.event_relations(spark, sf_dir)
    return r.select("book_id", "seq", X.sentence(F.col("entity1"), F.col("entity2"), F.col("relation")).alias("sentence"))


@query(f"""with {LINES}, first as (
  select *, row_number() over (partition by book_id, chunk_id, entity1, entity2, relation order by seq) as again from raw3
), based as (
  select *, concat_ws('_', book_id, chunk_id, entity1, entity2, relation) as base from first where again = 1
), numbered as (select *, row_number() over (partition by base order by book_id, seq) - 1 as nth from based)
select case when nth = 0 then base else base || '_' || nth end as id, {sentence('entity1', 'entity2', 'relation')} as text, book_id, chunk_id,
  {norm('entity1')} as entity1, {norm('entity2')} as entity2, relation from numbered""")
def embedding_records(spark, sf_dir):
    return vector.embedding_records(R.line_relations(spark, sf_dir))


@query(f"""with {EVENTS}, {_NODES} select book_id, node, {pronoun('node')} as pronoun_generic, {nameable('node')} as nameable,
  array_to_string(list_sort({core('node')}), '|') as core_words from nodes""")
def name_predicates(spark, sf_dir):
    n = F.col("node")
    return event_nodes(spark, sf_dir).select(
        "book_id", "node", X.is_pronoun_generic(n).alias("pronoun_generic"), X.is_nameable(n).alias("nameable"),
        F.array_join(F.sort_array(X.core_tokens(n)), "|").alias("core_words"),
    )


@query(f"""with {EVENTS}, names as (select entity1 as name from raw union select entity2 from raw)
select name, case when regexp_matches(name, '(?i)^(sir|king|queen|lord|lady|prince|princess|dr\\.?|mr\\.?|mrs\\.?|miss)\\s+') then 'title'
  when regexp_matches(name, '(?i)\\b(van|von|de|di|du|der|le|la)\\s+') then 'particle' when len({words('name')}) >= 3 then 'multiword' else 'plain' end as shape from names""")
def name_shapes(spark, sf_dir):
    names = R.event_relations(spark, sf_dir).select(F.explode(F.array("entity1", "entity2")).alias("name")).distinct()
    return names.select("name", X.name_shape(F.col("name")).alias("shape"))


@query(f"""with {EVENTS}, n as (select relation, count(*) as n from raw group by 1),
p as (select *, row_number() over (order by n desc, relation) as place from n)
select relation, n, round(n / (select sum(n) from n), 6) as share, place <= 48 as in_top, relation in {CANONICAL} as canonical from p""")
def relation_histogram(spark, sf_dir):
    return graph.relation_histogram(R.event_relations(spark, sf_dir))


@query(f"with {EVENTS} select entity_type, count(*) as n from (select entity1Type as entity_type from raw union all select entity2Type from raw) group by 1")
def entity_type_histogram(spark, sf_dir):
    return graph.entity_type_histogram(R.event_relations(spark, sf_dir))


@query(f"""with {EVENTS} select book_id, name, other_type, slot, count(*) as n from (
  select book_id, entity1 as name, entity2Type as other_type, 1 as slot from raw where entity1Type = 'ORG'
  union all select book_id, entity2, entity1Type, 2 from raw where entity2Type = 'ORG') group by all""")
def typed_ends(spark, sf_dir):
    return graph.typed_ends(R.event_relations(spark, sf_dir), "ORG")


@query(f"""with {EVENTS} select name, count(distinct type) as n_types from (
  select entity1 as name, entity1Type as type from raw union all select entity2, entity2Type from raw) group by 1 having count(distinct type) > 1""")
def multi_typed_names(spark, sf_dir):
    r = R.event_relations(spark, sf_dir)
    ends = r.select(F.inline(F.array(F.struct(F.col("entity1").alias("name"), F.col("entity1Type").alias("type")), F.struct(F.col("entity2").alias("name"), F.col("entity2Type").alias("type")))))
    return ends.groupBy("name").agg(F.count_distinct("type").alias("n_types")).where("n_types > 1")


@query(f"with {EVENTS} select book_id, count(distinct src) as n_sources, count(distinct relation) as n_relations from e group by 1")
def distinct_per_book(spark, sf_dir):
    return event_edges(spark, sf_dir).groupBy("book_id").agg(F.count_distinct("src").alias("n_sources"), F.count_distinct("relation").alias("n_relations"))


@query(f"with {LINES} select book_id, least(src, dst) as lo, greatest(src, dst) as hi, count(*) as n from e3 group by all having count(*) > 1")
def pair_repeats(spark, sf_dir):
    return line_edges(spark, sf_dir).groupBy("book_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"with {LINES} select n, count(*) as n_keys from (select count(*) as n from e3 group by book_id, src, relation, dst) group by 1")
def duplicate_key_histogram(spark, sf_dir):
    return line_edges(spark, sf_dir).groupBy("book_id", "src", "relation", "dst").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_keys"))


@query(f"""with {EVENTS}, pairs as (select distinct book_id, least(src, dst) as lo, greatest(src, dst) as hi from e)
select p.book_id, lo as a, hi as b, e.seq, e.src, e.relation, e.dst, e.chunk_id from pairs p join e on e.book_id = p.book_id and
  ((e.src = lo and e.dst = hi) or (e.src = hi and e.dst = lo))""")
def pair_enrichment(spark, sf_dir):
    e = event_edges(spark, sf_dir)
    return graph.pair_facts(e.select("book_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), e)


@query(f"with {LINES} select book_id, node, count(*) as degree from (select book_id, src as node from e3 union all select book_id, dst from e3) group by all")
def degrees(spark, sf_dir):
    return graph.degrees(line_edges(spark, sf_dir))


@query(f"""with {LINES}, d as (select book_id, node, count(*) as degree from (select book_id, src as node from e3 union all select book_id, dst from e3) group by all)
select book_id, count(*) as n_nodes, max(degree) as max_degree, quantile_cont(degree, 0.5)::double as median_degree, round(avg(degree), 6) as mean_degree from d group by 1""")
def degree_summary(spark, sf_dir):
    return graph.degree_summary(line_edges(spark, sf_dir))


@query(f"""with {LINES}, d as (select book_id, node, count(*) as degree from (select book_id, src as node from e3 union all select book_id, dst from e3) group by all),
m as (select book_id, quantile_cont(degree, 0.5)::double as median_degree from d group by 1)
select book_id, node, degree, median_degree from d join m using (book_id) where degree > 3 * median_degree""")
def hub_nodes(spark, sf_dir):
    return graph.hubs(line_edges(spark, sf_dir))


@query(f"""with {EVENTS} select book_id, src, dst, relation, chunk_id from e
union all select book_id, dst, src, relation, chunk_id from e where relation in {SYMMETRIC}""")
def mirrored_edges(spark, sf_dir):
    return graph.mirrored(event_edges(spark, sf_dir))


@query(f"""with {EVENTS}, f as (select distinct book_id, relation, src, dst from e where src <> dst)
select a.book_id, a.relation, a.src as lo, a.dst as hi, a.relation in ('parent_father_of', 'parent_mother_of', 'child_of') as strict
from f a join f b on a.book_id = b.book_id and a.relation = b.relation and a.src = b.dst and a.dst = b.src where a.src < a.dst""")
def bidirectional_pairs(spark, sf_dir):
    return graph.bidirectional_pairs(event_edges(spark, sf_dir))


@query(f"with {EVENTS}, {ARCS} select book_id, node, other, relation, direction, arc_rank from arcs")
def ranked_arcs(spark, sf_dir):
    return graph.arcs(event_edges(spark, sf_dir))


@query(f"""with recursive {EVENTS}, {ARCS}, hop as (select distinct book_id, node, other from arcs),
reach(book_id, start, node, depth) as (
  select distinct book_id, node, node, 0 from hop
  union select r.book_id, start, other, depth + 1 from reach r join hop on hop.book_id = r.book_id and hop.node = r.node where depth < 2
) select book_id, start, node, min(depth) as depth from reach where node <> start group by all""")
def n_hop_reach(spark, sf_dir):
    return paths.reach_in_two(graph.arc_pairs(event_edges(spark, sf_dir)))


@query(f"""with recursive {EVENTS}, {ARCS}, walk(book_id, start, cur, path, relations, directions, rank) as (
  select book_id, node, other, [node, other], [relation], [direction], [arc_rank] from arcs
  union all select w.book_id, start, a.other, list_append(path, a.other), list_append(relations, a.relation), list_append(directions, a.direction), list_append(rank, a.arc_rank)
  from walk w join arcs a on a.book_id = w.book_id and a.node = w.cur where len(relations) < 2 and not list_contains(path[:-2], a.other)
), placed as (select *, row_number() over (partition by book_id, start order by rank) as n from walk),
first as (select *, row_number() over (partition by book_id, start, path, relations order by rank) as again from placed where n <= 20)
select book_id, start, cur as "end", array_to_string(path, '|') as path, array_to_string(relations, '|') as relations,
  array_to_string(directions, '|') as directions, array_to_string(rank, '|') as rank from first where again = 1""")
def paths_up_to(spark, sf_dir):
    arcs = graph.arcs(event_edges(spark, sf_dir))
    return flat(paths.paths_up_to(arcs.select("book_id", F.col("node").alias("start")).distinct(), arcs, 2))


@query(f"""with {EVENTS}, {_NODES}, {ARCS}, walk as (
  select a.book_id, first_seen, a.node as start, b.other as cur, [a.node, a.other, b.other] as path, [a.relation, b.relation] as relations,
    [a.direction, b.direction] as directions, [a.arc_rank, b.arc_rank] as rank
  from nodes n join arcs_all a on a.book_id = n.book_id and a.node = n.node join arcs_all b on b.book_id = a.book_id and b.node = a.other
  where b.other <> a.node
), placed as (select *, row_number() over (partition by book_id order by first_seen, rank) as n from walk),
grouped as (select *, min(n) over (partition by book_id, first_seen, rank[1]) as group_first from placed)
select book_id, start, cur as "end", array_to_string(path, '|') as path, array_to_string(relations, '|') as relations,
  array_to_string(directions, '|') as directions, array_to_string(rank, '|') as rank from grouped where group_first <= 20""")
def paths_exact(spark, sf_dir):
    order = event_nodes(spark, sf_dir).select("book_id", F.col("node").alias("start"), "first_seen")
    return flat(paths.paths_exact(order, graph.all_arcs(event_edges(spark, sf_dir)), 2))


@query(f"with {EVENTS}, {STEPS} select book_id, relation, role, node, next from steps")
def role_steps(spark, sf_dir):
    return graph.steps(event_edges(spark, sf_dir))


_FRONTIERS = f"""frontiers as (
  select book_id, node, relation, role, list_sort(list(distinct next)) as frontier from steps where {nameable('node')} group by 1, 2, 3, 4
), longest as (select *, list_sort([{{'n': -length(x), 'x': x}} for x in frontier])[1].x as longest from frontiers
), classified as (select *, case when len(frontier) <= 1 then 'pure' when len([x for x in frontier if {pronoun('x')}]) > 0 then 'pronoun_generic'
  when len([x for x in frontier if not list_has_any({words('x')}, {words('longest')})]) = 0 then 'surface_variant' else 'unrelated' end as category from longest)"""


@query(f"with {EVENTS}, {STEPS}, {_FRONTIERS} select book_id, node, relation, role, array_to_string(frontier, '|') as frontier, category from classified")
def step_frontiers(spark, sf_dir):
    return flat(graph.frontiers(event_edges(spark, sf_dir)).withColumn("category", graph.frontier_category(F.col("frontier"))))


@query(f"""with {EVENTS}, {STEPS}, {_FRONTIERS}, c(category) as (values ('pure'), ('pronoun_generic'), ('surface_variant'), ('unrelated'))
select c.category, count(f.node) as n, round(count(f.node) / (select count(*) from classified), 6) as share from c left join classified f using (category) group by 1""")
def frontier_report(spark, sf_dir):
    f = graph.frontiers(event_edges(spark, sf_dir)).select(graph.frontier_category(F.col("frontier")).alias("category"))
    n = f.groupBy("category").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(c,) for c in ("pure", "pronoun_generic", "surface_variant", "unrelated")], "category string")
    joined = names.join(n, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = n.agg(F.sum("n").alias("total"))
    return joined.join(F.broadcast(total)).select("category", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # a single row


@query(f"""with {EVENTS}, {STEPS}, {_FRONTIERS}
select book_id, count(*) as n, round(avg((category <> 'pure')::int), 6) as contaminated from classified group by 1 having count(*) >= 5 order by 3 desc, 1 limit 10""")
def contamination_by_book(spark, sf_dir):
    f = graph.frontiers(event_edges(spark, sf_dir)).withColumn("category", graph.frontier_category(F.col("frontier")))
    return (
        f.groupBy("book_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("category") != "pure").cast("int")), 6).alias("contaminated"))
        .where("n >= 5").orderBy(F.desc("contaminated"), "book_id").limit(10)
    )


_WALKS = f"""first_steps as (
  select book_id, node as anchor, relation || ':' || role as first, min(next) as middle from steps where {nameable('node')} and next <> node
  group by 1, 2, 3 having count(distinct next) = 1
), walks as (
  select f.book_id, anchor, first, s.relation || ':' || s.role as second, list_sort(list(distinct next)) as gold
  from first_steps f join steps s on s.book_id = f.book_id and s.node = middle where next <> anchor group by 1, 2, 3, 4
)"""


@query(f"with {EVENTS}, {STEPS}, {_WALKS} select book_id, anchor, first, second, array_to_string(gold, '|') as gold from walks")
def two_step_walks(spark, sf_dir):
    return flat(graph.two_step_walks(event_edges(spark, sf_dir)))


@query(f"""with {EVENTS}, t as (select distinct book_id, src, relation, dst from e where relation in {listed(S.PREDICATES)})
select x.book_id, x.relation as r1, y.relation as r2, count(*) as n from t x join t y on x.book_id = y.book_id and x.dst = y.src where x.src <> y.dst group by all""")
def templated_chains(spark, sf_dir):
    return graph.templated_chains(event_edges(spark, sf_dir)).groupBy("book_id", "r1", "r2").agg(F.count("*").alias("n"))


@query(f"""with {EVENTS}, m as (
  select book_id, relation, dst as target, src, min(seq) as seq from e where src <> dst and relation in
  ('parent_father_of', 'parent_mother_of', 'child_of', 'sibling_of', 'spouse_of') group by all
), p as (select *, row_number() over (partition by book_id, relation, target order by seq) as n from m)
select book_id, relation, target, max(src) filter (n = 1) as first, max(src) filter (n = 2) as second from p group by all having count(*) >= 2""")
def coordinated_possessors(spark, sf_dir):
    return graph.coordinated_possessors(event_edges(spark, sf_dir))


@query(f"""with {EVENTS}, k as (select *, row_number() over (partition by book_id, relation order by seq) as n from e where relation in ('child_of', 'parent_father_of', 'parent_mother_of'))
select book_id, relation, src, dst, seq from k where n <= 8""")
def capped_kinship_edges(spark, sf_dir):
    from pyspark.sql.window import Window

    kin = event_edges(spark, sf_dir).where(F.col("relation").isin("child_of", "parent_father_of", "parent_mother_of"))
    order = Window.partitionBy("book_id", "relation").orderBy("seq")
    return kin.withColumn("n", F.row_number().over(order)).where("n <= 8").select("book_id", "relation", "src", "dst", "seq")


_VARIANTS = f"""names as (select book_id, node, {core('node')} as core, {words('node')} as words from nodes where not {pronoun('node')}
), pairs as (
  select a.book_id, a.node as name, b.node as longer, list_intersect(a.core, b.core) as common, a.core as ca, b.core as cb, a.words as wa, b.words as wb
  from names a join names b on a.book_id = b.book_id and length(b.node) > length(a.node)
), variants as (
  select book_id, name, longer from pairs where len(ca) > 0 and len(cb) > 0 and (len(common) = least(len(ca), len(cb)) or len(common) >= 2)
  and not (len([w for w in wa if not list_contains(wb, w)]) + len([w for w in wb if not list_contains(wa, w)]) > 0
    and len([w for w in list_concat([w for w in wa if not list_contains(wb, w)], [w for w in wb if not list_contains(wa, w)]) if not list_contains({array(S.DISTINGUISHING_SUFFIXES)}, w)]) = 0)
), resolution as (
  select book_id, node as raw_name, 'excluded_pronoun_generic' as tier, null as canonical_form from nodes where {pronoun('node')}
  union all select book_id, name, case when count(*) = 1 then 'surface_variant' else 'ambiguous_variant_candidate' end, case when count(*) = 1 then min(longer) end
  from variants group by 1, 2
)"""


@query(f"with {EVENTS}, {_NODES}, {_VARIANTS} select book_id, raw_name, tier, canonical_form from resolution")
def resolution_map(spark, sf_dir):
    return resolution.resolution_map(event_nodes(spark, sf_dir))


@query(f"""with {EVENTS}, {_NODES}, {_VARIANTS} select n.book_id, count(*) as n_names, count(*) filter (tier = 'excluded_pronoun_generic') as n_pronoun,
  count(*) filter (tier = 'surface_variant') as n_variant, count(*) filter (tier = 'ambiguous_variant_candidate') as n_ambiguous, count(*) filter (tier is null) as n_unresolved
from nodes n left join resolution r on r.book_id = n.book_id and r.raw_name = n.node group by 1""")
def resolution_summary(spark, sf_dir):
    n = event_nodes(spark, sf_dir)
    return resolution.summary(n, resolution.resolution_map(n))


@query(f"""with {EVENTS}, {_NODES}, {_VARIANTS}, r as (
  select n.book_id, node, case when tier = 'surface_variant' then canonical_form else node end as canonical from nodes n left join resolution r on r.book_id = n.book_id and r.raw_name = n.node)
select book_id, canonical, array_to_string(list_sort(list(distinct node)), '|') as members, count(*)::int as size from r group by 1, 2 having count(*) >= 2""")
def resolution_clusters(spark, sf_dir):
    n = event_nodes(spark, sf_dir)
    return flat(resolution.clusters(n, resolution.resolution_map(n)))


@query(f"""with {EVENTS}, {_NODES}, {_VARIANTS}, {STEPS}, {_FRONTIERS}, m as (select book_id, node, relation, role, unnest(frontier) as member from frontiers)
select m.book_id, node, relation, role, count(distinct member) as before,
  count(distinct case when tier is null then member when tier = 'surface_variant' then canonical_form end) as after
from m left join resolution r on r.book_id = m.book_id and r.raw_name = member group by all""")
def settled_frontiers(spark, sf_dir):
    n, e = event_nodes(spark, sf_dir), event_edges(spark, sf_dir)
    return resolution.settled_frontiers(graph.frontiers(e), resolution.resolution_map(n))


@query(f"with {EVENTS}, {_NODES} select book_id, node from nodes where not {pronoun('node')}")
def names_without_pronouns(spark, sf_dir):
    n = event_nodes(spark, sf_dir)
    flagged = resolution.resolution_map(n).where("tier = 'excluded_pronoun_generic'").select("book_id", F.col("raw_name").alias("node"))
    return n.select("book_id", "node").join(flagged, ["book_id", "node"], "left_anti")


@query(f"""with {EVENTS} select book_id, seq, src, relation, dst from e order by md5(book_id || '|' || seq || '|42'), book_id, seq limit 200""")
def sampled_edges(spark, sf_dir):
    return evaluation.hash_sample(event_edges(spark, sf_dir).select("book_id", "seq", "src", "relation", "dst"), 200, 42, "book_id", "seq")
