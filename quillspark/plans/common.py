"""Registration of queries, and the parts that their SQL for the independent engine shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schema as S
from quillspark.operators import graph
from quillspark.sources import relations as R

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with SQL for the same rows if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(R.event_relations(spark, sf_dir))


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(R.line_relations(spark, sf_dir))


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(R.event_relations(spark, sf_dir))


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text, so that every engine's rows compare."""
    return df.select(*(F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))


def listed(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(trim(lower({x})), ',\s*the\s+.+$', ''))"


def _edges(name: str, raw: str) -> str:
    return (
        f"{raw} as ({{}}),\n{name} as (select book_id, seq, {norm('entity1')} as src, {norm('entity2')} as dst, relation, chunk_id from {raw})"
    )


#: WITH parts: raw relations and edges of the events (raw, e) and of the order lines (raw3, e3).
EVENTS = _edges("e", "raw").format(R.EVENT_RELATIONS.replace("{events}", "events").strip())
LINES = _edges("e3", "raw3").format(
    R.LINE_RELATIONS.replace("{day}", "cast(datediff('day', date '1992-01-01', o_orderdate) as int)")
    .replace("{lineitem}", "lineitem").replace("{orders}", "orders").replace("{customer}", "customer").replace("{supplier}", "supplier").strip()
)
CANONICAL, SYMMETRIC = listed(S.CANONICAL_RELATIONS), listed(S.SYMMETRIC_RELATIONS)

#: Words, and the predicates on names, as SQL over an expression.
def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[^\s]+')"


def pronoun(x: str) -> str:
    last = f"lower({words(x)}[-1])"
    return (
        f"coalesce({last} in {listed([*S.PRONOUN_GENERIC, *S.IRREGULAR_FORMS, *S.ARCHAIC_FORMS])} or "
        f"(ends_with({last}, 's') and left({last}, length({last}) - 1) in {listed(S.PRONOUN_GENERIC)}), false)"
    )


def nameable(x: str) -> str:
    return (
        f"(len({words(x)}) between 1 and 4 and lower({words(x)}[1]) not in {listed(S.LEADING_FUNCTION_WORDS)} "
        f"and not {pronoun(x)} and lower({x}) not in {listed(S.SOCIAL_ROLES)})"
    )


def core(x: str) -> str:
    return f"list_distinct([w for w in {words(f'lower({x})')} if not list_contains({array(S.HONORIFICS)}, w)])"


def sentence(a: str, b: str, r: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in S.PREDICATES.items())
    return f"{a} || ' ' || (case {r} {cases} else replace({r}, '_', ' ') end) || ' ' || {b}"


def ask_forward(x: str, r: str) -> str:
    cases = " ".join(f"when '{k}' then 'Who {v.split(' ', 1)[0]} ' || {x} || ' {v.split(' ', 1)[1]}?'" for k, v in S.PREDICATES.items() if k != "travel_to")
    return f"case {r} when 'travel_to' then 'Where does ' || {x} || ' travel to?' {cases} end"


def ask_reverse(x: str, r: str) -> str:
    return "case " + r + " " + " ".join(f"when '{k}' then 'Who {v} ' || {x} || '?'" for k, v in S.PREDICATES.items()) + " end"


#: Arcs of the events' edges, each direction ranked by a node's order of discovery; arcs_all keeps parallel ones.
ARCS = f"""
both_ways as (
  select book_id, src as node, dst as other, relation, 'forward' as direction, seq from e
  union all select book_id, dst, src, relation, 'reverse', seq from e
), met as (
  select *, min(seq) over (partition by book_id, node, direction, other) as met from both_ways
), arcs_all as (
  select book_id, node, other, relation, direction,
    row_number() over (partition by book_id, node order by direction, met, seq, other, relation) as arc_rank
  from met where direction = 'forward' or relation in {SYMMETRIC}
), arcs as (
  select book_id, node, other, relation, direction, min(arc_rank) as arc_rank from arcs_all group by all
)"""

#: Neighbours by role.
STEPS = f"""
roles(relation, role, noun) as (values {", ".join(f"('{r}', '{w}', '{n}')" for r, w, n in S.ROLE_STEPS)}),
role_pairs as (select distinct book_id, relation, role, src, dst from e join roles using (relation) where src <> dst),
steps as (
  select book_id, relation, role, dst as node, src as next from role_pairs where role in ('e1', 'sym')
  union select book_id, relation, role, src, dst from role_pairs where role in ('e2', 'sym')
)"""
