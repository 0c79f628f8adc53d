"""Queries on narrative time, vectors, questions and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import schema as S
from quillspark.functions import text as X
from quillspark.operators import evaluation, graph, questions as Q, retrieval, temporal, vector
from quillspark.plans.common import (
    CANONICAL, EVENTS, LINES, STEPS, array, ask_forward, ask_reverse, event_edges, flat, line_edges, listed, query,
)
from quillspark.plans.graph_queries import _WALKS
from quillspark.sources import relations as R


def _temporal(e: str) -> str:
    return f"""idx as (select book_id, min(chunk_id) as min_chunk, max(chunk_id) as max_chunk, count(*) as n_edges,
  trunc(least(20.0, greatest(6.0, count(*) / 15.0)))::int as num_bins from {e} group by 1
), binned as (select t.*, num_bins, least(num_bins, ((chunk_id - min_chunk)::bigint * num_bins) // (max_chunk - min_chunk + 1) + 1)::int as bin
  from {e} t join idx using (book_id) where relation in {CANONICAL}
), slots as (select book_id, unnest(range(1, num_bins + 1))::int as bin from idx)"""


@query(f"with {LINES}, {_temporal('e3')} select * from idx")
def temporal_index(spark, sf_dir):
    return temporal.temporal_index(line_edges(spark, sf_dir))


@query(f"with {EVENTS}, {_temporal('e')} select s.book_id, s.bin, count(b.seq) as cnt from slots s left join binned b using (book_id, bin) group by all")
def book_trajectory(spark, sf_dir):
    return temporal.book_trajectory(event_edges(spark, sf_dir))


@query(f"with {LINES}, {_temporal('e3')} select s.book_id, s.bin, count(b.seq) as cnt from slots s left join binned b using (book_id, bin) group by all")
def book_trajectory_lines(spark, sf_dir):
    return temporal.book_trajectory(line_edges(spark, sf_dir))


@query(f"""with {EVENTS}, {_temporal('e')}, p as (select distinct book_id, least(src, dst) as lo, greatest(src, dst) as hi from e)
select p.book_id, p.lo, p.hi, s.bin, count(b.seq) as cnt from p join slots s using (book_id) left join binned b
on b.book_id = p.book_id and b.bin = s.bin and least(b.src, b.dst) = p.lo and greatest(b.src, b.dst) = p.hi group by all""")
def pair_trajectory(spark, sf_dir):
    e = event_edges(spark, sf_dir)
    return temporal.pair_trajectory(e, e.select("book_id", F.col("src").alias("a"), F.col("dst").alias("b")))


@query(f"""with {EVENTS}, {_temporal('e')}, c as (select book_id, bin, least(src, dst) as lo, greatest(src, dst) as hi, count(*) as cnt, min(seq) as seen from binned group by all),
r as (select *, row_number() over (partition by book_id, bin order by cnt desc, seen) as place from c) select book_id, bin, lo, hi, cnt, place from r where place <= 10""")
def active_pairs(spark, sf_dir):
    return temporal.active_pairs(event_edges(spark, sf_dir))


_BOOK_T = "bt as (select s.book_id, s.bin, count(b.seq) as cnt from slots s left join binned b using (book_id, bin) group by all)"


@query(f"with {LINES}, {_temporal('e3')}, {_BOOK_T} select book_id, sum(bin * cnt) / nullif(sum(cnt), 0) as mean_bin from bt group by 1")
def weighted_mean_bin(spark, sf_dir):
    return temporal.weighted_mean_bin(temporal.book_trajectory(line_edges(spark, sf_dir)), ["book_id"])


@query(f"""with {LINES}, {_temporal('e3')}, {_BOOK_T}, m as (select book_id, sum(bin * cnt) / nullif(sum(cnt), 0) as mean_bin from bt group by 1),
a as (select mean_bin / num_bins as pos from m join idx using (book_id))
select round(min(pos), 6) as least, round(max(pos), 6) as most, round(avg(pos), 6) as mean, count(*) filter (pos < 0.4) as early,
  count(*) filter (pos between 0.4 and 0.6) as central, count(*) filter (pos > 0.6) as late from a""")
def narrative_evenness(spark, sf_dir):
    e = line_edges(spark, sf_dir)
    return temporal.evenness(temporal.book_trajectory(e), temporal.temporal_index(e))


PHRASES = (
    "who does he meet near the end of the book?", "what happens in the first third", "the last quarter of the story", "by the middle of the story",
    "early in the book", "late in the narrative", "the second half", "two-thirds of the way through", "a third of the way through",
    "two thirds through the book", "right at the beginning", "exactly at the midpoint", "around the halfway point", "the fifth half", "who is he?",
    "towards the conclusion", "about three quarters through",
)


@query()
def phrase_bins(spark, sf_dir):
    """Phrases of relative position against every possible number of bins."""
    asked = spark.createDataFrame([(i, p) for i, p in enumerate(PHRASES)], "qid int, question string")
    spans = asked.withColumn("span", temporal.parse_phrase(F.col("question"))).withColumn("bins", F.explode(F.sequence(F.lit(S.MIN_BINS), F.lit(S.MAX_BINS))))
    return spans.withColumn("b", temporal.resolve_bins(F.col("span"), F.col("bins"))).select(
        "qid", "bins", F.col("span.kind").alias("kind"), F.round("span.start_frac", 6).alias("start_frac"), F.round("span.end_frac", 6).alias("end_frac"),
        F.col("b.start_bin").alias("start_bin"), F.col("b.end_bin").alias("end_bin"),
    )


def _chunks(spark, sf_dir):
    c = R.read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").cast("int").alias("chunk_id"), F.col("text").alias("chunk"))


_C = "c as (select cast(conv_id as varchar) as book_id, cast(turn as int) as chunk_id, text as chunk from conversations)"


@query(f"""with {_C}, l as (select *, lead(chunk_id) over (partition by book_id order by chunk_id) as nxt from c)
select book_id, count(*) as n_chunks, min(chunk_id) as first, max(chunk_id) as last, max(chunk_id) - min(chunk_id) + 1 = count(*) as contiguous,
  count(*) filter (nxt - chunk_id > 1) as gaps from l group by 1""")
def chunk_contiguity(spark, sf_dir):
    return temporal.contiguity(_chunks(spark, sf_dir))


@query(rf"""with {_C}, m as (select book_id, chunk_id, len(regexp_extract_all(chunk, '\b[A-Z][a-z]+\.'))::bigint as n_markers from c)
select *, case when n_markers = 0 then 'none' when n_markers = 1 then 'candidate' else 'contents' end as kind from m""")
def chapter_markers(spark, sf_dir):
    return temporal.marker_counts(_chunks(spark, sf_dir), r"\b[A-Z][a-z]+\.")


@query(rf"""with {_C}, m as (select book_id, chunk_id from c where regexp_matches(chunk, '\.')), g as (select *, chunk_id - lag(chunk_id) over (partition by book_id order by chunk_id) as gap from m)
select book_id, count(*) as n, quantile_cont(gap, 0.5)::double as median_gap, min(gap) as least_gap, max(gap) as most_gap from g group by 1""")
def marker_gaps(spark, sf_dir):
    return temporal.position_gaps(_chunks(spark, sf_dir).where(F.col("chunk").contains(".")))


@query(f"""with {_C}, p as (select *, row_number() over (partition by book_id order by chunk_id) as place from c)
select book_id, string_agg(chunk, ' ' order by place) as passage from p where place between 2 and 5 group by 1""")
def passages(spark, sf_dir):
    return temporal.passages(_chunks(spark, sf_dir), 2, 4)


_LANG = " ".join(f"len(list_intersect(w, {array(S.LANGUAGE_MARKERS[k])})) as {k[:2]}," for k in ("french", "german", "spanish"))


@query(f"""with w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) as w from documents), n as (select doc_id, {_LANG} from w)
select doc_id, case when fr >= 4 and fr >= ge and fr >= sp then 'likely_french' when ge >= 4 then 'likely_german' when sp >= 4 then 'likely_spanish' else 'likely_english' end as guess from n""")
def guessed_language(spark, sf_dir):
    return R.read(spark, sf_dir, "documents").select("doc_id", X.guess_language(F.col("text")).alias("guess"))




def _distance(a: str, b: str) -> str:
    return f"list_sum([({a}[i]::double - {b}[i]::double) * ({a}[i]::double - {b}[i]::double) for i in range(1, len({a}) + 1)])"


@query(f"""with d as (select q.vec_id as query_id, r.vec_id as id, {_distance('q.embedding', 'r.embedding')} as distance
  from embeddings q join embeddings r on q.label = r.label and q.vec_id <> r.vec_id where q.vec_id % 50 = 0),
p as (select *, row_number() over (partition by query_id order by round(distance, 6), id) as place from d) select query_id, id, round(distance, 6) as distance, place from p where place <= 5""")
def nearest_within_book(spark, sf_dir):
    v = R.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = v.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    near = vector.nearest(q, v, 6, "label").where("query_id <> id")
    from pyspark.sql.window import Window

    order = Window.partitionBy("query_id").orderBy(F.round("distance", 6), "id")
    return near.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 5").select("query_id", "id", F.round("distance", 6).alias("distance"), "place")


@query(f"""with d as (select q.vec_id as qid, q.label = r.label as correct, r.vec_id as id, {_distance('q.embedding', 'r.embedding')} as distance
  from embeddings q join embeddings r on q.vec_id <> r.vec_id where q.vec_id % 50 = 0),
p as (select *, row_number() over (partition by qid order by round(distance, 6), id) as place from d),
b as (select qid, min(place) filter (correct) as best from p where place <= 20 group by 1)
select k::int as k, round(avg((coalesce(best, 2147483647) <= k)::int::double), 6) as accuracy from b, (values (1), (3), (5), (7), (10), (15), (20)) t(k) group by 1""")
def accuracy_at_k(spark, sf_dir):
    """One ranking to the largest k; every k is read off it."""
    v = R.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = v.where("id % 50 = 0").withColumnRenamed("id", "query_id").drop("label")
    near = vector.nearest(q, v, 21).where("query_id <> id")
    from pyspark.sql.window import Window

    order = Window.partitionBy("query_id").orderBy(F.round("distance", 6), "id")
    ranked = near.withColumn("place", F.row_number().over(order)).where("place <= 20")
    labels = v.select("id", "label")
    joined = ranked.join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return evaluation.accuracy_at(joined.select(F.col("query_id").alias("qid"), "place", (F.col("label") == F.col("own")).alias("correct")), (1, 3, 5, 7, 10, 15, 20))


@query(f"with {EVENTS} select book_id, seq, {ask_forward('src', 'relation')} as forward, {ask_reverse('dst', 'relation')} as reverse from e where relation in {listed(S.PREDICATES)}")
def edge_questions(spark, sf_dir):
    e = event_edges(spark, sf_dir).where(F.col("relation").isin(*S.PREDICATES))
    return e.select("book_id", "seq", X.question_forward(F.col("src"), F.col("relation")).alias("forward"), X.question_reverse(F.col("dst"), F.col("relation")).alias("reverse"))


def _place(q: str, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"case when regexp_matches({q}, '{p}') then length(regexp_extract({q}, '^(.*?){p}', 1)) end" for p in patterns) + ")"


def _mention(q: str, relation: str) -> str:
    found = [_place(q, [rf"\b{a}\s+(?:\w+\s+){{0,2}}{n}\s+of\b"]) for n in Q.relation_nouns(relation) for a in ("a", "an", "the")]
    if relation in S.VERB_FORMS:
        found.append(f"nullif(instr({q}, '{S.VERB_FORMS[relation]}'), 0) - 1")
    return "coalesce(" + ", ".join([*found, "null"]) + ")"


def _possessive(q: str, relation: str) -> str:
    found = [_place(q, [rf"\b\w+''s\s+(?:\w+\s+){{0,2}}{n}(?:''s\b|[?,]|$)"]) for n in Q.relation_nouns(relation)]
    return "coalesce(" + ", ".join([*found, "null"]) + ")"


_NOUNS = "case {} " + " ".join(f"when '{r}:{w}' then '{n}'" for r, w, n in S.ROLE_STEPS) + " end"
_CAP = "array_to_string([upper(w[1]) || lower(w[2:]) for w in regexp_extract_all(anchor, '[^\\s]+')], ' ')"
_WALK_Q = f"""wq as (select *, row_number() over (partition by book_id, first || ' > ' || second order by anchor) as n,
  'Who is the ' || {_NOUNS.format('second')} || ' of the ' || {_NOUNS.format('first')} || ' of ' || {_CAP} || '?' as question from walks)"""
_MENTIONS = "m as (" + " union all ".join(
    f"select qid, '{r}' as relation, {_mention('q', r)} as f, {_possessive('q', r)} as s from qs" for r in S.PREDICATES if Q.relation_nouns(r) or r in S.VERB_FORMS
) + "), mm as (select * from m where f is not null or s is not null)"
_PLAN = """pl as (select qid, list_sort(list(relation)) as relations, min(f) as first_of, max(s) filter (f is null) as last_pos from mm group by 1),
tg as (select mm.qid, case when min(relation) = max(relation) then min(relation) end as target from mm join pl using (qid)
  where case when first_of is not null then f = first_of else s = last_pos end group by 1),
plan as (select qs.qid, coalesce(relations, []) as relations, greatest(0, least(coalesce(len(relations), 0) - 1, 3))::int as hop_depth, target
  from qs left join pl using (qid) left join tg using (qid))"""


@query(f"""with {EVENTS}, {STEPS}, {_WALKS}, {_WALK_Q} select book_id, anchor, first || ' > ' || second as sequence, question, array_to_string(gold, '|') as gold,
  len(gold)::int as gold_size, len(gold) = 1 as is_unique from wq where n <= 5""")
def walk_questions(spark, sf_dir):
    return flat(evaluation.walk_questions(graph.two_step_walks(event_edges(spark, sf_dir))))


def _asked(spark, sf_dir):
    q = evaluation.walk_questions(graph.two_step_walks(event_edges(spark, sf_dir)), None)
    return q.withColumn("qid", F.concat_ws("|", "book_id", "anchor", "sequence"))


_QS = f"{EVENTS}, {STEPS}, {_WALKS}, {_WALK_Q}, qs as (select book_id || '|' || anchor || '|' || first || ' > ' || second as qid, lower(question) as q, wq.* from wq)"


@query(f"with {_QS}, {_MENTIONS}, {_PLAN} select qid, array_to_string(relations, '|') as relations, hop_depth, target from plan")
def question_plans(spark, sf_dir):
    return flat(Q.question_plan(_asked(spark, sf_dir)))


@query(f"""with {_QS}, {_MENTIONS}, {_PLAN}, g as (select gate, count(*) as n from (select case when hop_depth = 0 then 'G1 hop_depth 0' when target is null then 'G2 target_relation None'
  when target <> split_part(second, ':', 1) then 'G3 target_relation wrong' else 'passed parse gates' end as gate from plan join qs using (qid)) group by 1)
select gate, n, round(n / (select sum(n) from g), 6) as share from g""")
def parse_gates(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    expected = F.substring_index(F.substring_index("sequence", " > ", -1), ":", 1)
    joined = Q.question_plan(asked).join(asked, "qid").select(evaluation.gate(F.col("hop_depth"), F.col("target"), expected).alias("gate"))
    n = joined.groupBy("gate").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select("gate", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # a single row


_DIR_ROWS = f"""rows as (select distinct {ask_forward('src', 'relation')} as question, src as entity1, dst as entity2, relation from e where relation in {listed(S.PREDICATES)})"""


def _direction(entity: str) -> str:
    quoted = f"regexp_escape({entity})"
    cases = " ".join(f"when '{r}' then {_mention('q', r)}" for r in S.PREDICATES)
    owns = " ".join(
        rf"when '{r}' then regexp_matches(q, '\b' || {quoted} || '(?:\s+\w+){{0,2}}''s\s+(?:\w+\s+){{0,2}}(?:{'|'.join(Q.relation_nouns(r))})(?:''s\b|[?,]|$)')"
        for r in S.PREDICATES if Q.relation_nouns(r)
    )
    at = rf"case when regexp_matches(q, '\b' || {quoted} || '\b') then length(regexp_extract(q, '^(.*?)\b' || {quoted} || '\b', 1)) end"
    return f"case when {at} is null then null when case relation {owns} else false end then 'reverse' when ({at}) < (case relation {cases} end) then 'forward' when (case relation {cases} end) is not null then 'reverse' end"


@query(f"""with {EVENTS}, {_DIR_ROWS}, q as (select *, lower(question) as q from rows), d as (select *, {_direction('entity1')} as d1, {_direction('entity2')} as d2 from q)
select question, entity1, entity2, relation, d1, d2, coalesce(d1 = 'forward', d2 = 'reverse') as direction_match,
  case when d1 = 'forward' then entity2 when d1 = 'reverse' then entity1 when d2 = 'reverse' then entity1 when d2 = 'forward' then entity2 end as expand_from from d""")
def question_directions(spark, sf_dir):
    e = event_edges(spark, sf_dir).where(F.col("relation").isin(*S.PREDICATES))
    rows = e.select(X.question_forward(F.col("src"), F.col("relation")).alias("question"), F.col("src").alias("entity1"), F.col("dst").alias("entity2"), "relation").distinct()
    return Q.with_directions(rows)


def _outcomes(spark, sf_dir, arm):
    """Answers of the anchor's own first step, strict or with any two steps: a small stand-in for a retrieval arm."""
    e = event_edges(spark, sf_dir)
    asked = evaluation.walk_questions(graph.two_step_walks(e), None)
    steps = graph.steps(e).groupBy("book_id", F.col("node").alias("anchor")).agg(F.sort_array(F.collect_set("next")).alias("answers"), F.count("*").alias("n_steps"))
    joined = asked.join(steps, ["book_id", "anchor"], "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<string>")))
    if arm == "few":
        joined = joined.withColumn("answers", F.when(F.col("n_steps") % 2 == 0, F.col("answers")).otherwise(F.array().cast("array<string>")))
    return joined.withColumn("outcome", evaluation.outcome(F.col("answers"), F.col("gold")))


_OUT = f"""{EVENTS}, {STEPS}, {_WALKS}, st as (select book_id, node as anchor, list_sort(list(distinct next)) as answers, count(*) as n_steps from steps group by 1, 2),
ans as (select w.*, coalesce(answers, []) as a_all, case when n_steps % 2 = 0 then answers else [] end as a_few from walks w left join st using (book_id, anchor)),
oc as (select *, case when len(a_all) = 0 then 'DECLINED' when list_has_any(a_all, gold) then 'HIT' else 'WRONG' end as o_all,
  case when len(a_few) = 0 then 'DECLINED' when list_has_any(a_few, gold) then 'HIT' else 'WRONG' end as o_few from ans)"""


@query(f"""with {_OUT} select book_id, count(*) as n, round(avg((o_few = 'HIT')::int::double), 6) as hit, round(avg((o_few = 'DECLINED')::int::double), 6) as declined,
  round(avg((o_few = 'WRONG')::int::double), 6) as wrong from oc group by rollup (book_id)""")
def outcome_shares(spark, sf_dir):
    return evaluation.outcome_shares(_outcomes(spark, sf_dir, "few"), "book_id")


@query(f"""with {_OUT}, a as (select book_id, anchor, first, second, o_few from oc), b as (select book_id, anchor, first, second, o_all from oc),
p as (select o_few, o_all from a full join b using (book_id, anchor, first, second))
select count(*) filter (o_few is not null and o_all is not null) as n_both, count(*) filter (o_all is null) as only_old, count(*) filter (o_few is null) as only_new,
  count(*) filter (o_few <> 'HIT' and o_all = 'HIT') as gained, count(*) filter (o_few = 'HIT' and o_all <> 'HIT') as lost from p""")
def paired_comparison(spark, sf_dir):
    return evaluation.paired(_outcomes(spark, sf_dir, "few"), _outcomes(spark, sf_dir, "all"), "book_id", "anchor", "sequence")


@query(f"""with {_OUT} select book_id, anchor, first || ' > ' || second as sequence, round_even(len(list_intersect(a_all, gold)) / nullif(len(a_all), 0), 2) as precision from oc""")
def answer_precision(spark, sf_dir):
    return _outcomes(spark, sf_dir, "all").select("book_id", "anchor", "sequence", evaluation.precision(F.col("answers"), F.col("gold")).alias("precision"))


@query(f"""with {LINES}, d as (select book_id, node, count(*) as degree from (select book_id, src as node from e3 union all select book_id, dst from e3) group by all),
q as (select quantile_cont(degree, 0.25) as q1, quantile_cont(degree, 0.5) as q2, quantile_cont(degree, 0.75) as q3 from d)
select book_id, node, degree, case when degree <= q1 then 1 when degree <= q2 then 2 when degree <= q3 then 3 else 4 end as quartile from d, q""")
def degree_quartiles(spark, sf_dir):
    return evaluation.quartiles(graph.degrees(line_edges(spark, sf_dir)), "degree")


@query()
def hybrid_chains(spark, sf_dir):
    return flat(_hybrid(spark, sf_dir)[2].select("hit_id", "path", "relations", "directions", "answer"))


def _hybrid(spark, sf_dir):
    relations = R.event_relations(spark, sf_dir)
    e = graph.edges(relations)
    first = evaluation.one_hop_questions(e).where("seq % 50 = 0")
    nested = first.select(
        F.concat_ws("|", "book_id", "seq").alias("qid"), "book_id",
        F.concat(F.regexp_replace("question", r"\?$", ""), F.lit(" and who protects the friend of "), F.col("answer"), F.lit("?")).alias("question"),
    )
    records = vector.embedding_records(relations).withColumn("vector", vector.hashed_embedding(F.col("text")))
    return retrieval.hybrid_search(nested, records, e, 5)
