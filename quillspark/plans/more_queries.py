"""Further queries: exploration, serving views and evaluation on paths."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark import schema as S
from quillspark.functions import text as X
from quillspark.operators import evaluation, graph, paths, questions as Q
from quillspark.plans.common import SYMMETRIC, ARCS, EVENTS, LINES, STEPS, ask_forward, ask_reverse, event_edges, event_nodes, flat, line_edges, listed, pronoun, query, words
from quillspark.plans.graph_queries import _NODES
from quillspark.plans.other_queries import _C, _DIR_ROWS, _chunks, _direction
from quillspark.sources import relations as R


@query(f"""with {LINES}, t as (select book_id, arg_min(entity1, seq) as title from raw3 group by 1)
select book_id, title, (select count(*) from e3 where e3.book_id = t.book_id) as n_edges from t""")
def books(spark, sf_dir):
    """What the serving layer lists: books with an edge at least."""
    r = R.line_relations(spark, sf_dir)
    return r.groupBy("book_id").agg(F.min_by("entity1", "seq").alias("title"), F.count("*").alias("n_edges"))


@query(f"""with {EVENTS}, names as (select entity1 as name from raw union select entity2 from raw)
select name, coalesce(lower({words('name')}[1]) in {listed(S.PRONOUN_LIKE)} or (lower({words('name')}[1]) in {listed(S.ARTICLE_LIKE)}
  and len([w for w in {words('name')} if regexp_matches(w, '^[A-Z]')]) = 0), false) as generic from names""")
def generic_looking_names(spark, sf_dir):
    names = R.event_relations(spark, sf_dir).select(F.explode(F.array("entity1", "entity2")).alias("name")).distinct()
    first = F.lower(F.get(X.tokens(F.col("name")), F.lit(0)))
    capital = F.exists(X.tokens(F.col("name")), lambda t: t.rlike("^[A-Z]"))
    generic = first.isin(*S.PRONOUN_LIKE) | (first.isin(*S.ARTICLE_LIKE) & ~capital)
    return names.select("name", F.coalesce(generic, F.lit(False)).alias("generic"))


@query()
def fuzzy_name_pairs(spark, sf_dir):
    """Pairs of names of a book whose matching-block ratio is over 0.6; the ratio of lengths bounds it before it is computed."""
    n = event_nodes(spark, sf_dir).select("book_id", "node")
    a, b = n.withColumnRenamed("node", "a"), n.withColumnRenamed("node", "b")
    near = 2 * F.least(F.length("a"), F.length("b")) > 0.6 * (F.length("a") + F.length("b"))
    pairs = a.join(b, "book_id").where((F.col("a") < F.col("b")) & near)

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])

    return pairs.withColumn("ratio", ratio("a", "b")).where("ratio > 0.6")


@query(f"""with {_C}, p as (select *, row_number() over (partition by book_id order by chunk_id) as place, count(*) over (partition by book_id) as n from c)
select book_id, string_agg(chunk, ' ' order by place) as middle from p where place between n // 2 - 1 and n // 2 + 2 group by 1""")
def middle_windows(spark, sf_dir):
    each = Window.partitionBy("book_id")
    p = _chunks(spark, sf_dir).withColumns({"place": F.row_number().over(each.orderBy("chunk_id")), "n": F.count("*").over(each)})
    kept = p.where(F.expr("place BETWEEN n DIV 2 - 1 AND n DIV 2 + 2"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "chunk")))
    return kept.groupBy("book_id").agg(F.array_join(F.transform(ordered, lambda x: x["chunk"]), " ").alias("middle"))


_EXACT = f"""walk as (
  select a.book_id, first_seen, a.node as start, b.other as cur, [a.node, a.other, b.other] as path, [a.relation, b.relation] as relations,
    [a.direction, b.direction] as directions, [a.arc_rank, b.arc_rank] as rank
  from nodes n join arcs_all a on a.book_id = n.book_id and a.node = n.node join arcs_all b on b.book_id = a.book_id and b.node = a.other where b.other <> a.node
), numbered as (select *, row_number() over (partition by book_id order by first_seen, rank) as n from walk),
exact as (select * from (select *, min(n) over (partition by book_id, first_seen, rank[1]) as group_first from numbered) where group_first <= 20)"""


def _exact_paths(spark, sf_dir):
    order = event_nodes(spark, sf_dir).select("book_id", F.col("node").alias("start"), "first_seen")
    return paths.paths_exact(order, graph.all_arcs(event_edges(spark, sf_dir)), 2)


@query(f"""with {EVENTS}, {_NODES}, {ARCS}, {_EXACT}, h as (
  select *, case when directions[1] = 'forward' then {ask_forward('start', 'relations[1]')} else {ask_reverse('start', 'relations[1]')} end as q1,
    case when directions[2] = 'forward' then {ask_forward("'that entity'", 'relations[2]')} else {ask_reverse("'that entity'", 'relations[2]')} end as q2 from exact)
select book_id, start, cur as answer, array_to_string(rank, '|') as rank, q1 || ' Then, ' || lower(q2[1]) || q2[2:] as question from h where q1 is not null and q2 is not null""")
def two_hop_questions(spark, sf_dir):
    p = _exact_paths(spark, sf_dir).withColumn("question", evaluation.chain_question(F.col("start"), F.col("relations"), F.col("directions")))
    return flat(p.where("question IS NOT NULL").select("book_id", "start", F.col("end").alias("answer"), "rank", "question"))


@query(f"""with {EVENTS}, {_NODES}, {ARCS}, {_EXACT}, q as (select distinct book_id, start, cur as node from exact where start <> cur),
step as (select distinct book_id, node, other from arcs),
ours as (select s.book_id, s.node as start, s.other as node from step s union select a.book_id, a.node, b.other from step a join step b on a.book_id = b.book_id and a.other = b.node),
view as (select book_id, src, dst from e union select book_id, dst, src from e where relation in {SYMMETRIC}),
theirs as (select book_id, src as start, dst as node from view union select a.book_id, a.src, b.dst from view a join view b on a.book_id = b.book_id and a.dst = b.src),
f as (select q.*, o.node is not null as a, t.node is not null as b from q left join ours o on (o.book_id, o.start, o.node) = (q.book_id, q.start, q.node)
  left join theirs t on (t.book_id, t.start, t.node) = (q.book_id, q.start, q.node))
select count(*) as n_questions, avg((a = b)::int::double) as agreement_rate, avg(b::int::double) as reachable_rate from f""")
def reachability_agreement(spark, sf_dir):
    """Ends of sampled paths by the search over arcs, and by joins of the mirrored edges, which know no arcs."""
    ends = _exact_paths(spark, sf_dir).where("start <> `end`").select("book_id", "start", F.col("end").alias("node")).distinct().persist()  # few rows a book
    e, starts = event_edges(spark, sf_dir), ends.select("book_id", "start").distinct()
    reach = paths.reach(starts, graph.arcs(e), 2)
    view = graph.mirrored(e).select("book_id", F.col("src").alias("start"), F.col("dst").alias("node")).distinct()
    onward = view.select("book_id", F.col("start").alias("middle"), "node")
    first = view.join(starts, ["book_id", "start"], "left_semi")
    two = first.withColumnRenamed("node", "middle").join(onward, ["book_id", "middle"]).select("book_id", "start", "node")
    near = first.unionByName(two).distinct().withColumn("near", F.lit(True))
    joined = ends.join(reach, ["book_id", "start", "node"], "left").join(near, ["book_id", "start", "node"], "left")
    ours, theirs = F.col("depth").isNotNull(), F.col("near").isNotNull()
    return joined.agg(F.count("*").alias("n_questions"), F.avg((ours == theirs).cast("double")).alias("agreement_rate"), F.avg(theirs.cast("double")).alias("reachable_rate"))


@query(f"""with {EVENTS}, {_NODES}, {ARCS}, {_EXACT}, d as (select book_id, node, count(*) as degree from (select book_id, src as node from e union all select book_id, dst from e) group by all),
m as (select book_id, quantile_cont(degree, 0.5)::double as median_degree from d group by 1), x as (select book_id, start, rank, unnest(path) as node from exact)
select x.book_id, start, array_to_string(rank, '|') as rank, max(degree) as max_degree, max(degree) > 3 * any_value(median_degree) as through_hub
from x join d on d.book_id = x.book_id and d.node = x.node join m on m.book_id = x.book_id group by 1, 2, rank""")
def path_hub_degrees(spark, sf_dir):
    e = event_edges(spark, sf_dir)
    d = graph.degrees(e)
    m = d.groupBy("book_id").agg(F.expr("percentile(degree, 0.5)").alias("median_degree"))
    x = _exact_paths(spark, sf_dir).select("book_id", "start", "rank", F.explode("path").alias("node"))
    return flat(x.join(d, ["book_id", "node"]).join(m, "book_id").groupBy("book_id", "start", "rank").agg(
        F.max("degree").alias("max_degree"), (F.max("degree") > 3 * F.first("median_degree")).alias("through_hub")
    ))


@query(f"""with {EVENTS}, {_DIR_ROWS}, q as (select *, lower(question) as q from rows), d as (select relation, {_direction('entity1')} as d1 from q)
select relation, count(*) as n, round(avg((d1 is not null)::int::double), 6) as detected from d group by 1""")
def direction_coverage(spark, sf_dir):
    e = event_edges(spark, sf_dir).where(F.col("relation").isin(*S.PREDICATES))
    rows = e.select(X.question_forward(F.col("src"), F.col("relation")).alias("question"), F.col("src").alias("entity1"), F.col("dst").alias("entity2"), "relation").distinct()
    found = Q.with_directions(rows)
    return found.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg(F.col("d1").isNotNull().cast("double")), 6).alias("detected"))


@query(f"""with {EVENTS}, o as (select book_id, seq, row_number() over (order by md5(book_id || '|' || seq || '|7'), book_id, seq) as n from e)
select book_id, seq, case when n <= 100 then 'first' else 'second' end as sample from o where n <= 200""")
def disjoint_samples(spark, sf_dir):
    first = evaluation.hash_sample(event_edges(spark, sf_dir).select("book_id", "seq"), 200, 7, "book_id", "seq")
    n = F.row_number().over(Window.orderBy(evaluation.hash_order(7, "book_id", "seq"), "book_id", "seq"))  # two hundred rows
    return first.withColumn("n", n).select("book_id", "seq", F.when(F.col("n") <= 100, "first").otherwise("second").alias("sample"))


@query(f"""with {EVENTS}, {STEPS}, f as (select book_id, node, relation, role, list(distinct next) as members from steps where role <> 'sym' group by all having count(distinct next) > 1)
select count(*) as before, count(*) filter (len([m for m in members if not {pronoun('m')}]) > 1) as after from f""")
def functional_frontiers(spark, sf_dir):
    """Directed steps that lead to several members, before and after pronoun-like names are removed."""
    f = graph.steps(event_edges(spark, sf_dir)).where("role <> 'sym'").groupBy("book_id", "node", "relation", "role").agg(
        F.count_distinct("next").alias("n"), F.count_distinct(F.when(~X.is_pronoun_generic(F.col("next")), F.col("next"))).alias("named")
    ).where("n > 1")
    return f.agg(F.count("*").alias("before"), F.count_if(F.col("named") > 1).alias("after"))


@query(f"""with {LINES}, n as (select relation, count(*) as n from e3 group by 1)
select count(*) as n_types, count(*) filter (n <= 2) as n_rare, round((select sum(n) from (select n from n order by n desc limit 3)) / sum(n), 6) as top_share from n""")
def relation_concentration(spark, sf_dir):
    n = line_edges(spark, sf_dir).groupBy("relation").agg(F.count("*").alias("n"))
    ranked = n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"))))  # one row per type
    return ranked.agg(
        F.count("*").alias("n_types"), F.count_if(F.col("n") <= 2).alias("n_rare"),
        F.round(F.sum(F.when(F.col("place") <= 3, F.col("n"))) / F.sum("n"), 6).alias("top_share"),
    )
