"""Sources of relations: chunk tables with parsed relations, projections of plain tables, and table files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark import schema as S


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parse_relations(text: Column) -> Column:
    """Relations from a literal list of dictionaries; null for what is no text or does not parse, empty lists stay."""
    fields = [f.name for f in S.RELATION]

    def one(value):
        if not isinstance(value, str):
            return None
        try:
            found = ast.literal_eval(value)
        except (ValueError, SyntaxError):
            return None
        if not isinstance(found, list):
            return None
        return [{k: d.get(k) if d.get(k) is None else str(d.get(k)) for k in fields} for d in found if isinstance(d, dict)]

    @F.pandas_udf(S.RELATIONS)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(one)

    return parse(text)


def load_chunks(raw: DataFrame) -> DataFrame:
    """Chunks whose relations parse, with numeric chunk_id and relations_parsed; malformed rows go."""
    return (
        raw.withColumn("relations_parsed", parse_relations(F.col("relations")))
        .where("relations_parsed IS NOT NULL")
        .withColumn("chunk_id", F.col("chunk_id").try_cast("int"))
    )


def explode_relations(chunks: DataFrame) -> DataFrame:
    """(book_id, chunk_id, seq, entity1, entity2, entity1Type, entity2Type, relation), seq in order of chunk and place.

    Chunks without a number come last; rows that repeat a chunk follow each other in order of their content, so that no two relations
    of different content share a seq (up to 1,000 rows a chunk and 100,000 relations a row).
    """
    again = F.row_number().over(Window.partitionBy("book_id", "chunk_id").orderBy(F.to_json("relations_parsed"))) - 1
    numbered = chunks.withColumn("_again", again).select("book_id", "chunk_id", "_again", F.posexplode("relations_parsed").alias("pos", "r"))
    chunk = F.coalesce(F.col("chunk_id").cast("long"), F.lit(2**31))
    return numbered.select("book_id", "chunk_id", ((chunk * 1_000 + F.col("_again")) * 100_000 + F.col("pos")).alias("seq"), "r.*")


#: Events as a small dense multigraph in eight books; one relation for each chunk, so that seq is chunk_id.
EVENT_RELATIONS = """
with s as (
 select event_id, user_id, user_id % 8 as book,
   row_number() over (partition by user_id % 8 order by ts, event_id) - 1 as chunk_id,
   lead(user_id) over (partition by user_id % 8 order by ts, event_id) as nxt from {events}),
r as (select *, event_id % 10 as k, event_id % 11 as v from s where nxt is not null)
select cast(book as varchar(9)) as book_id, cast(chunk_id as int) as chunk_id, cast(chunk_id as bigint) as seq,
 case when user_id % 37 = 0 then 'her son' when v = 0 then concat('Mr. U', cast(user_id as varchar(9)))
      when v = 1 then concat('U', cast(user_id as varchar(9)), ', the Elder') else concat('U', cast(user_id as varchar(9))) end as entity1,
 case when nxt % 37 = 0 then 'her son' else concat('U', cast(nxt as varchar(9))) end as entity2,
 case when v < 8 then 'PER' else 'ORG' end as entity1Type, 'PER' as entity2Type,
 case k when 0 then 'companion_of' when 1 then 'friend_of' when 2 then 'enemy_of' when 3 then 'protector_of'
        when 4 then 'leader_of' when 5 then 'child_of' when 6 then 'parent_father_of' when 7 then 'parent_mother_of'
        when 8 then 'owns' else 'screaming at' end as relation
from r
"""

#: Order lines as a large sparse bipartite graph between customers and suppliers, a book for each nation.
LINE_RELATIONS = """
select cast(c_nationkey as varchar(9)) as book_id, {day} as chunk_id,
 l_orderkey * 8 + l_linenumber as seq, c_name as entity1, s_name as entity2, 'PER' as entity1Type, 'ORG' as entity2Type,
 case l_partkey % 10 when 0 then 'companion_of' when 1 then 'friend_of' when 2 then 'enemy_of' when 3 then 'protector_of'
   when 4 then 'leader_of' when 5 then 'member_of' when 6 then 'employer_of' when 7 then 'located_in' when 8 then 'owns'
   else 'screaming at' end as relation
from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey
join {supplier} on l_suppkey = s_suppkey
"""


def event_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENT_RELATIONS, events=read(spark, sf_dir, "events"))


def line_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier")}
    day = "datediff(o_orderdate, date'1992-01-01')"
    return spark.sql(LINE_RELATIONS.replace("{day}", day), **tables)


def write_table(df: DataFrame, path: str, partition_by: str | None = "book_id") -> None:
    """Replace a table of Parquet files, one folder for each book so that queries for a book read that folder alone."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_records(records: DataFrame, path: str, batch_rows: int = 5_000) -> int:
    """Replace the table of embedding records; ids must be unique. Returns the number of rows written."""
    repeated = records.groupBy("id").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"id {repeated[0]['id']} is not unique")
    records.write.mode("overwrite").option("maxRecordsPerFile", batch_rows).parquet(path)
    return records.sparkSession.read.parquet(path).count()


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays joined by semicolons."""
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, encoding: str = "windows-1252") -> DataFrame:
    return spark.read.option("header", True).option("encoding", encoding).csv(path)


def run_folder(base: str, started) -> str:
    """The folder of one run's results, named by the moment it began."""
    return f"{base.rstrip('/')}/{started:%Y%m%d_%H%M%S}"


def read_resolutions(spark: SparkSession, path: str) -> DataFrame:
    """A stored resolution table; a ValueError names columns that are missing or of another type."""
    wanted = {"book_id": "string", "raw_name": "string", "tier": "string", "canonical_form": "string"}
    found = spark.read.parquet(path)
    kinds = dict(found.dtypes)
    wrong = [c for c, t in wanted.items() if kinds.get(c) != t and not (c == "book_id" and kinds.get(c) == "int")]
    if wrong:
        raise ValueError(f"{path} has no string column {', '.join(wrong)}")
    return found.select(*(F.col(c).cast("string").alias(c) for c in wanted))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
