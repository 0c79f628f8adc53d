"""Queries on retrieval arms: direction-aware accuracy, hop baselines, canonical outcomes, populations and their losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import schema as S
from quillspark.functions import text as X
from quillspark.operators import evaluation, graph, paths, questions as Q, resolution, retrieval, vector
from quillspark.plans.common import (
    ARCS, EVENTS, STEPS, ask_forward, ask_reverse, event_edges, event_nodes, flat, listed, norm, query, sentence, words,
)
from quillspark.plans.graph_queries import _FRONTIERS, _NODES, _VARIANTS, _WALKS
from quillspark.plans.other_queries import _DIR_ROWS, _MENTIONS, _OUT, _PLAN, _QS, _WALK_Q, _asked, _direction, _distance, _hybrid, _outcomes
from quillspark.sources import relations as R

KS = (1, 3, 5, 7, 10, 15, 20)

#: WITH parts: embedding records of the events, and the vector of a text (hashed word counts at unit length).
_RECORDS = f"""based as (select *, concat_ws('_', book_id, chunk_id, entity1, entity2, relation) as base from (
    select *, row_number() over (partition by book_id, chunk_id, entity1, entity2, relation order by seq) as again from raw) where again = 1
), rec_text as (select base || case when nth = 0 then '' else '_' || nth end as id, {sentence('entity1', 'entity2', 'relation')} as text, book_id,
    {norm('entity1')} as entity1, {norm('entity2')} as entity2, relation
  from (select *, row_number() over (partition by base order by book_id, seq) - 1 as nth from based)
), rec as (select *, {{vector}} as v from rec_text)"""


def _vector(text: str) -> str:
    slots = f"[('0x' || substr(md5(w), 1, 4))::int % {vector.DIMENSIONS} for w in string_split_regex(lower({text}), '[^a-z0-9]+') if w <> '']"
    counts = f"(select list(c order by i) from (select i, len([s for s in x.s if s = i])::double as c from range({vector.DIMENSIONS}) t(i)))"
    unit = f"(select [c / sqrt(list_sum([d * d for d in y.c])) for c in y.c] from (select {counts} as c) y)"
    return f"(select {unit} from (select {slots} as s) x)"


def _hits(asked: str, k: int) -> str:
    """Parts: asked with vectors, and the k nearest records of its book for each question (qid, book_id, question, ...)."""
    return f"""{_RECORDS.format(vector=_vector('text'))}, asked as ({asked}), av as (select *, {_vector('question')} as qv from asked),
near as (select qid, rec.*, {_distance('qv', 'v')} as distance from av join rec using (book_id)),
hits as (select * from (select *, row_number() over (partition by qid order by distance, id) as place from near) where place <= {k}),
facts as (select h.qid, place, e.src, e.relation, e.dst, e.chunk_id, e.seq from hits h join e on e.book_id = h.book_id
  and least(e.src, e.dst) = least(h.entity1, h.entity2) and greatest(e.src, e.dst) = greatest(h.entity1, h.entity2))"""


_ONE_HOP = f"select book_id || '|' || seq as qid, book_id, {ask_forward('src', 'relation')} as question, relation as asked_relation, dst as answer from e where relation in {listed(S.PREDICATES)} and seq % 50 = 0"
_NESTED = f"select qid, book_id, regexp_replace(question, '\\?$', '') || ' and who protects the friend of ' || answer || '?' as question from ({_ONE_HOP})"


@query(f"""with {EVENTS}, {_hits(_NESTED, 5)}, h as (select hits.*, question, lower(question) as q from hits join asked using (qid)),
d as (select *, {_direction('entity1')} as d1, {_direction('entity2')} as d2 from h)
select qid, place, id, coalesce(d1 = 'forward', d2 = 'reverse') as direction_match,
  case when d1 = 'forward' then entity2 when d1 = 'reverse' then entity1 when d2 = 'reverse' then entity1 when d2 = 'forward' then entity2 end as expand_from from d""")
def hybrid_hits(spark, sf_dir):
    """Vector hits of a question for every fiftieth edge, with their direction."""
    return _hybrid(spark, sf_dir)[0].select("qid", "place", "id", "direction_match", "expand_from")


@query(f"""with {EVENTS}, {_hits(_NESTED, 5)}, n as (select *, row_number() over (partition by qid, src, relation, dst, chunk_id order by place, seq) as n from facts)
select qid, place, src, relation, dst, chunk_id from n where n = 1""")
def hybrid_facts(spark, sf_dir):
    return retrieval.distinct_facts(_hybrid(spark, sf_dir)[1]).select("qid", "place", "src", "relation", "dst", "chunk_id")


def _records(relations):
    return vector.embedding_records(relations).withColumn("vector", vector.hashed_embedding(F.col("text")))


def _one_hop(edges):
    return evaluation.one_hop_questions(edges).where("seq % 50 = 0").withColumn("qid", F.concat_ws("|", "book_id", "seq"))


def _near(asked, records, k):
    q = asked.select(F.col("qid").alias("query_id"), "book_id", vector.hashed_embedding(F.col("question")).alias("vector"))
    return vector.nearest(q, records, k, "book_id").withColumnRenamed("query_id", "qid").join(records.drop("vector"), "id")


@query(f"""with {EVENTS}, {_hits(_ONE_HOP, max(KS))}, top as (select a.qid, bool_or(h.place = 1 and h.relation = asked_relation and h.entity2 = answer) as top
  from asked a left join hits h using (qid) group by 1),
best as (select a.qid, min(place) filter (f.relation = asked_relation and dst = answer) as best from asked a left join facts f using (qid) group by 1)
select k::int as k, count(*) as n_questions, round(avg(coalesce(top, false)::int::double), 6) as baseline, round(avg((coalesce(best, 2147483647) <= k)::int::double), 6) as hybrid
from top join best using (qid), (values {", ".join(f"({k})" for k in KS)}) t(k) group by 1""")
def direction_accuracy(spark, sf_dir):
    """A question for every fiftieth edge: top-1 of plain vectors against any fact of the first k hits."""
    r = R.event_relations(spark, sf_dir)
    e = graph.edges(r)
    asked = _one_hop(e)
    hits = _near(asked, _records(r), max(KS))
    facts = graph.pair_facts(hits.select("qid", "place", "book_id", F.col("entity1").alias("a"), F.col("entity2").alias("b")), e)
    return evaluation.direction_accuracy(asked, hits, facts.select("qid", "place", "relation", "dst"), KS)


def _exact(hops: int) -> str:
    """Parts: x{hops}, the first 20 simple paths of exactly so many arcs of each book, siblings whole."""
    steps = range(1, hops + 1)
    joins = " ".join(f"join arcs_all a{i} on a{i}.book_id = a{i - 1}.book_id and a{i}.node = a{i - 1}.other" for i in range(2, hops + 1))
    free = " and ".join(f"a{i}.other not in ({', '.join(['a1.node', *(f'a{j}.other' for j in range(1, i - 1))])})" for i in range(2, hops + 1)) or "true"
    questions = " || ' Then, ' || ".join(
        q if i == 1 else f"lower(({q})[1]) || ({q})[2:]"
        for i in steps
        for q in [f"(case when a{i}.direction = 'forward' then {ask_forward('a1.node' if i == 1 else chr(39) + 'that entity' + chr(39), f'a{i}.relation')} else {ask_reverse('a1.node' if i == 1 else chr(39) + 'that entity' + chr(39), f'a{i}.relation')} end)"]
    )
    ranks = ", ".join(f"a{i}.arc_rank" for i in steps)
    return f"""w{hops} as (select a1.book_id, first_seen, a1.node as start, a{hops}.other as answer, [{ranks}] as rank, {questions} as question
  from nodes n join arcs_all a1 on a1.book_id = n.book_id and a1.node = n.node {joins} where {free}),
m{hops} as (select *, row_number() over (partition by book_id order by first_seen, rank) as n from w{hops}),
x{hops} as (select * from (select *, min(n) over (partition by book_id, first_seen, rank[1:{hops - 1}]) as g from m{hops}) where g <= 20)"""


def _hops(hops) -> str:
    return " union all ".join(f"select {h}::int as hops, '{h}|' || book_id || '|' || start || '|' || array_to_string(rank, '.') as qid, book_id, start, answer, question from x{h} where question is not null" for h in hops)


def _hop_questions(spark, sf_dir, depths=(1, 2)):
    e = event_edges(spark, sf_dir)
    order = event_nodes(spark, sf_dir).select("book_id", F.col("node").alias("start"), "first_seen")
    found = None
    for hops in depths:
        p = paths.paths_exact(order, graph.all_arcs(e), hops).withColumn("question", evaluation.chain_question(F.col("start"), F.col("relations"), F.col("directions")))
        p = p.where("question IS NOT NULL").select(
            F.lit(hops).alias("hops"), F.concat_ws("|", F.lit(hops), "book_id", "start", F.array_join("rank", ".")).alias("qid"), "book_id", "start",
            F.col("end").alias("answer"), "question",
        )
        found = p if found is None else found.unionByName(p)
    return found


@query(f"with {EVENTS}, {_NODES}, {ARCS}, {', '.join(map(_exact, (1, 2)))} {_hops((1, 2))}")
def hop_questions(spark, sf_dir):
    """Questions of one and two hops from the first exact paths of each book."""
    return _hop_questions(spark, sf_dir)


@query(f"""with {EVENTS}, {_NODES}, {ARCS}, {', '.join(map(_exact, (1, 2)))}, {_hits(_hops((1, 2)), 10)},
ok as (select a.qid, hops, bool_or(entity1 = answer or entity2 = answer) as ok from asked a left join hits using (qid) group by 1, 2)
select hops, count(*) as n_questions, round(avg(coalesce(ok, false)::int::double), 6) as accuracy from ok group by 1""")
def hop_baseline(spark, sf_dir):
    """Whether the answer of a question of one or two hops is an end of any of ten vector hits."""
    asked = _hop_questions(spark, sf_dir).persist()  # few rows a book
    return evaluation.answer_among_hits(asked, _near(asked, _records(R.event_relations(spark, sf_dir)), 10))


#: SQL for three hops lists all paths of three arcs, which is too slow for a registered query; the tests run it on the smallest tables.
THREE_HOP_SQL = f"with {EVENTS}, {_NODES}, {ARCS}, {_exact(3)} {_hops((3,))}"


@query()
def three_hop_questions(spark, sf_dir):
    return _hop_questions(spark, sf_dir, (3,))


_RESOLVED = "(select o.book_id, anchor, first, second, case when tier = 'surface_variant' then canonical_form else name end as name from o left join resolution r on r.book_id = o.book_id and r.raw_name = o.name)"


@query(f"""with {_OUT}, {_NODES}, {_VARIANTS}, a as (with o as (select book_id, anchor, first, second, unnest(a_few) as name from oc) select * from {_RESOLVED}),
g as (with o as (select book_id, anchor, first, second, unnest(gold) as name from oc) select * from {_RESOLVED}),
al as (select book_id, anchor, first, second, list(name) as a from a group by all), gl as (select book_id, anchor, first, second, list(name) as g from g group by all)
select oc.book_id, oc.anchor, oc.first || ' > ' || oc.second as sequence, case when a is null then 'DECLINED' when list_has_any(a, g) then 'HIT' else 'WRONG' end as outcome
from oc left join al using (book_id, anchor, first, second) left join gl using (book_id, anchor, first, second)""")
def canonical_outcomes(spark, sf_dir):
    n = event_nodes(spark, sf_dir)
    return evaluation.canonical_outcome(_outcomes(spark, sf_dir, "few"), resolution.resolution_map(n), "anchor", "sequence")


@query(f"""with {_QS}, {_hits("select qid, book_id, question from qs", 5)}, f as (select distinct qid, place, relation as fact from facts),
x as (select qs.qid, anchor, split_part(first, ':', 1) as fr, (select list(distinct next) from steps s where s.book_id = qs.book_id and s.node = anchor and s.relation || ':' || s.role = first) as fn from qs),
near_anchor as (select x.*, place, case when entity1 = anchor then entity2 else entity1 end as other from hits join x using (qid) where entity1 = anchor or entity2 = anchor)
select x.qid, exists (select 1 from near_anchor n where n.qid = x.qid) as anchor_retrieved,
  exists (select 1 from near_anchor n join f on f.qid = n.qid and f.place = n.place where n.qid = x.qid and list_contains(fn, other) and fact = fr) as first_step_retrieved from x""")
def retrieval_flags(spark, sf_dir):
    """Of every nested question: whether its anchor and its first step are among five hits."""
    r = R.event_relations(spark, sf_dir)
    e = graph.edges(r)
    asked = _asked(spark, sf_dir)
    first = graph.steps(e).groupBy("book_id", F.col("node").alias("anchor"), F.concat_ws(":", "relation", "role").alias("step")).agg(F.collect_set("next").alias("first_nodes"))
    asked = asked.withColumn("step", F.substring_index("sequence", " > ", 1)).join(first, ["book_id", "anchor", "step"])
    hits = _near(asked, _records(r), 5)
    facts = graph.pair_facts(hits.select("qid", "place", "book_id", F.col("entity1").alias("a"), F.col("entity2").alias("b")), e)
    questions = asked.select("qid", "anchor", F.substring_index("step", ":", 1).alias("first_relation"), "first_nodes")
    return evaluation.retrieval_flags(questions, hits.select("qid", "place", "entity1", "entity2"), facts.select("qid", "place", "relation"))


def _nameable_old(x: str) -> str:
    return f"(len({words(x)}) between 1 and 4 and {words(x)}[1] not in {listed(S.OLD_FUNCTION_WORDS)} and {x} not in {listed(S.OLD_GENERIC)})"


@query(f"""with {EVENTS}, {_NODES} select book_id, node, {_nameable_old('node')} as nameable_old from nodes""")
def nameable_before(spark, sf_dir):
    return event_nodes(spark, sf_dir).select("book_id", "node", X.is_nameable_old(F.col("node")).alias("nameable_old"))


@query(f"""with {EVENTS}, {STEPS}, {_WALKS}, old_first as (
  select book_id, node as anchor, relation || ':' || role as first, min(next) as middle from steps where {_nameable_old('node')} and next <> node group by 1, 2, 3 having count(distinct next) = 1
), old_walks as (select f.book_id, anchor, first, s.relation || ':' || s.role as second from old_first f join steps s on s.book_id = f.book_id and s.node = middle where next <> anchor group by all),
p as (select book_id, o.book_id is not null as old, n.book_id is not null as new from old_walks o full join (select book_id, anchor, first, second, true as here from walks) n using (book_id, anchor, first, second))
select book_id, count(*) filter (old) as n_old, count(*) filter (new) as n_new, count(*) filter (old and not new) as only_old, count(*) filter (new and not old) as only_new from p group by 1""")
def nameable_populations(spark, sf_dir):
    """Walks of every book under the earlier and the present predicate of nameable anchors."""
    e, keys = event_edges(spark, sf_dir), ["book_id", "anchor", "first", "second"]
    old = graph.two_step_walks(e, X.is_nameable_old).select(*keys, F.lit(True).alias("old"))
    new = graph.two_step_walks(e).select(*keys, F.lit(True).alias("new"))
    o, n = F.col("old").isNotNull(), F.col("new").isNotNull()
    return old.join(new, keys, "full_outer").groupBy("book_id").agg(
        F.count_if(o).alias("n_old"), F.count_if(n).alias("n_new"), F.count_if(o & ~n).alias("only_old"), F.count_if(n & ~o).alias("only_new")
    )


def _possessive_sql() -> str:
    noun = "case relation " + " ".join(f"when '{r}' then '{n}'" for r, n in S.RELATION_NOUNS.items()) + " end"
    synonym = "case relation " + " ".join(f"when '{r}' then '{n[0]}'" for r, n in S.NOUN_SYNONYMS.items()) + " end"
    return f"""poss as (select book_id, seq, relation, 'anchor_noun' as kind, dst as subject, 'Who is ' || dst || '''s ' || {noun} || '?' as question, src as entity1, dst as entity2 from e where {noun} is not null
  union all select book_id, seq, relation, 'synonym_noun', src, 'Who is ' || src || '''s ' || {synonym} || '?', src, dst from e where {synonym} is not null)"""


@query(f"with {EVENTS}, {_possessive_sql()} select book_id, seq, relation, kind, subject, question from poss")
def possessive_questions(spark, sf_dir):
    return evaluation.possessive_questions(event_edges(spark, sf_dir))


@query(f"""with {EVENTS}, {_possessive_sql()}, q as (select *, lower(question) as q from poss), d as (select *, {_direction('subject')} as d from q)
select relation, kind, case when kind = 'synonym_noun' and relation not in {listed(S.NOUN_SYNONYMS)} then 'EXPECTED no synonym' when relation not in {listed(S.PREDICATES)} then 'EXPECTED untemplated' else 'NEW' end as bucket,
  count(*) as n, count(*) filter (d is null) as undetected from d group by all""")
def possessive_failures(spark, sf_dir):
    """Possessive questions whose direction isn't seen, by whether that was to be expected."""
    entry = F.get(F.filter(Q.vocabulary(), lambda v: v["relation"] == F.col("relation")), F.lit(0))
    asked = evaluation.possessive_questions(event_edges(spark, sf_dir)).withColumn("v", entry).withColumn("q", F.lower("question"))
    seen = asked.withColumn("d", Q.direction(F.col("q"), F.col("subject"), F.col("v")))
    return seen.groupBy("relation", "kind", evaluation.failure_bucket(F.col("relation"), F.col("kind")).alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if(F.col("d").isNull()).alias("undetected")
    )


@query(f"""with {EVENTS}, {_DIR_ROWS}, r as (select *, lower(question) as q from rows)
select relation, count(*) as n, count(*) filter (regexp_matches(q, '\\b' || regexp_escape(lower(entity1)) || '\\b')) as first_as_word, count(*) filter (contains(q, lower(entity1))) as first_as_text,
  count(*) filter (regexp_matches(q, '\\b' || regexp_escape(lower(entity2)) || '\\b')) as second_as_word from r group by 1""")
def endpoint_presence(spark, sf_dir):
    """How many one-hop questions hold the ends of their edge, as a word and as mere text."""
    e = event_edges(spark, sf_dir).where(F.col("relation").isin(*S.PREDICATES))
    rows = e.select(X.question_forward(F.col("src"), F.col("relation")).alias("question"), "src", "dst", "relation").distinct()
    return rows.groupBy("relation").agg(
        F.count("*").alias("n"), F.count_if(X.mentions_word(F.col("question"), F.col("src"))).alias("first_as_word"),
        F.count_if(F.contains(F.lower("question"), F.lower("src"))).alias("first_as_text"), F.count_if(X.mentions_word(F.col("question"), F.col("dst"))).alias("second_as_word"),
    )


@query(f"""with {EVENTS}, c(relation) as (values {", ".join(f"('{r}')" for r in S.EVENT_RELATIONS)}) select c.relation, count(raw.relation) as n,
  count(*) filter (entity1Type = 'EVENT' and entity2Type = 'EVENT') as between_events from c left join raw using (relation) group by 1""")
def event_shaped_relations(spark, sf_dir):
    """Relations that look like events: how often each occurs, and between two events."""
    kept = R.event_relations(spark, sf_dir).where(F.col("relation").isin(*S.EVENT_RELATIONS))
    names = spark.createDataFrame([(r,) for r in S.EVENT_RELATIONS], "relation string")
    between = F.count_if((F.col("entity1Type") == "EVENT") & (F.col("entity2Type") == "EVENT")).alias("b")
    found = kept.groupBy("relation").agg(F.count("*").alias("c"), between)
    return names.join(found, "relation", "left").select("relation", F.coalesce("c", F.lit(0)).alias("n"), F.coalesce("b", F.lit(0)).alias("between_events"))


@query(f"""with {EVENTS}, {_NODES}, {_VARIANTS}, {STEPS}, {_FRONTIERS}, m as (select book_id, node, relation, role, unnest(frontier) as member from frontiers),
s as (select m.book_id, node, relation, role, count(distinct member) as before, count(distinct case when tier is null then member when tier = 'surface_variant' then canonical_form end) as after
  from m left join resolution r on r.book_id = m.book_id and r.raw_name = member group by all),
o as (select case when after <= 1 then 'resolved' when after < before then 'improved' else 'unchanged' end as outcome, count(*) as n from s where before > 1 group by 1)
select outcome, n, round(n / (select sum(n) from o), 6) as share from o""")
def frontier_purity(spark, sf_dir):
    n, e = event_nodes(spark, sf_dir), event_edges(spark, sf_dir)
    return resolution.purity(resolution.settled_frontiers(graph.frontiers(e), resolution.resolution_map(n)))


@query(f"""with {EVENTS}, {STEPS}, {_FRONTIERS} select book_id, node, relation, role, category, len(frontier)::int as size from classified where category <> 'pure'
order by len(frontier) desc, book_id, node, relation, role limit 10""")
def worst_frontiers(spark, sf_dir):
    """The ten largest frontiers that are not pure."""
    f = graph.frontiers(event_edges(spark, sf_dir)).withColumn("category", graph.frontier_category(F.col("frontier"))).where("category <> 'pure'")
    return f.select("book_id", "node", "relation", "role", "category", F.size("frontier").alias("size")).orderBy(F.desc("size"), "book_id", "node", "relation", "role").limit(10)


@query(f"""with {EVENTS}, {ARCS}, n as (select distinct book_id, node, other from arcs), o as (select distinct book_id, src as node, dst as other from e),
n2 as (select book_id, node, other from n union select a.book_id, a.node, b.other from n a join n b on a.book_id = b.book_id and a.other = b.node),
o2 as (select book_id, node, other from o union select a.book_id, a.node, b.other from o a join o b on a.book_id = b.book_id and a.other = b.node),
x as (select book_id, node, other, bool_or(here) as new, bool_or(not here) as old from (select *, true as here from n2 union all select *, false from o2) where node <> other group by all)
select book_id, node as start, count(*) filter (old) as old_reachable, count(*) filter (new) as new_reachable, count(*) filter (new and not old) as recovered from x group by all""")
def recovered_nodes(spark, sf_dir):
    """Nodes within two steps of each node: by edges as stored only, by arcs, and what the arcs add."""
    e = event_edges(spark, sf_dir)
    arcs = graph.arcs(e)
    starts = arcs.select("book_id", F.col("node").alias("start")).distinct()
    forward = e.select("book_id", F.col("src").alias("node"), F.col("dst").alias("other"))
    new = paths.reach(starts, arcs, 2).select("book_id", "start", "node", F.lit(True).alias("new"))
    old = paths.reach(starts, forward, 2).select("book_id", "start", "node", F.lit(True).alias("old"))
    n, o = F.col("new").isNotNull(), F.col("old").isNotNull()
    return new.join(old, ["book_id", "start", "node"], "full_outer").groupBy("book_id", "start").agg(
        F.count_if(o).alias("old_reachable"), F.count_if(n).alias("new_reachable"), F.count_if(n & ~o).alias("recovered")
    )


_GATED = """gated as (select qs.book_id, qs.anchor, qs.first, qs.second, split_part(qs.first, ':', 1) = split_part(qs.second, ':', 1) as same_relation,
  case when hop_depth = 0 then 'G1 hop_depth 0' when target is null then 'G2 target_relation None' when target <> split_part(qs.second, ':', 1) then 'G3 target_relation wrong' else 'passed parse gates' end as gate
  from plan join qs using (qid))"""


@query(f"""with {_OUT}, {_WALK_Q}, qs as (select book_id || '|' || anchor || '|' || first || ' > ' || second as qid, lower(question) as q, wq.* from wq), {_MENTIONS}, {_PLAN}, {_GATED},
j as (select gate, same_relation, o_few as outcome, count(*) as n from gated join oc using (book_id, anchor, first, second) group by all)
select gate, same_relation, outcome, n, round(n / sum(n) over (partition by gate, same_relation), 6) as share from j""")
def gate_outcomes(spark, sf_dir):
    scored = _outcomes(spark, sf_dir, "few").withColumn("qid", F.concat_ws("|", "book_id", "anchor", "sequence"))
    first, last = (F.substring_index(F.substring_index("sequence", " > ", i), ":", 1) for i in (1, -1))
    joined = Q.question_plan(scored).join(scored.select("qid", "sequence", "outcome"), "qid")
    return evaluation.gate_outcomes(joined.select(
        evaluation.gate(F.col("hop_depth"), F.col("target"), last).alias("gate"), (first == last).alias("same_relation"), "outcome"
    ))


@query(f"""with {_OUT}, h as (select *, round_even(len(list_intersect(a_all, gold)) / nullif(len(a_all), 0), 2) as precision,
  row_number() over (partition by book_id, first, second order by anchor) <= 5 as kept from oc),
p as (select 'all' as population, * from h where o_all = 'HIT' union all select 'lost', * from h where o_all = 'HIT' and not kept)
select population, count(*) as n, count(*) filter (precision = 1) as pure, count(*) filter (len(gold) = 1) as single, median(len(gold))::double as median_gold from p group by 1""")
def lost_hits(spark, sf_dir):
    """Hits of all walks, and those that a population of five walks a sequence leaves out."""
    before = _outcomes(spark, sf_dir, "all").withColumn("precision", evaluation.precision(F.col("answers"), F.col("gold")))
    after = evaluation.walk_questions(graph.two_step_walks(event_edges(spark, sf_dir)))
    return evaluation.lost_hits(before, after, "book_id", "anchor", "sequence")


@query()
def retrieval_stability(spark, sf_dir):
    """The hits of two runs over differently partitioned records: questions, one for every templated edge, and those with equal lists."""
    r = R.event_relations(spark, sf_dir)
    # Equal questions of a book are the same search: each is asked once a run, and counts for all its edges.
    each = evaluation.one_hop_questions(graph.edges(r)).groupBy("book_id", "question").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    each = each.withColumn("qid", F.concat_ws("|", "book_id", "seq")).persist()  # of each book, a few times its nodes at most
    asked, records = each.select(F.col("qid").alias("query_id"), "book_id", vector.hashed_embedding(F.col("question")).alias("vector")), _records(r)
    listed_ = lambda t, name: t.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias(name))  # noqa: E731  five hits each
    a, b = listed_(vector.nearest(asked, records, 5, "book_id"), "a"), listed_(vector.nearest(asked, records.repartition(7, "id"), 5, "book_id"), "b")
    both = each.withColumnRenamed("qid", "query_id").join(a, "query_id", "left").join(b, "query_id", "left")
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))  # noqa: E731  of no questions none
    return both.agg(total("n").alias("n_questions"), total(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n"))).alias("n_equal"))
