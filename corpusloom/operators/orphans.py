"""References to records that do not exist: deleted, missing or arriving after the row that names them.

Parent and child keys are put in one long form, tagged with what they are, and grouped by the kind of parent and the key,
in two steps so that a key that a third of all rows name is combined before the shuffle: by month of the children first,
then over the months. A group so has the months' counts of its children, whether a parent came and when, and what the
removal log said last. Groups that lack a parent (or whose parent was deleted, or came after a child) are kept. A report
is the sum of the kept groups' counts by month; rows are listed by joining the children to the kept groups, where
adaptive execution splits a hot key on the children's side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.keys import TEXT_TABLES, key, stripped
from corpusloom.session import table, written

#: child table -> (its key, the reference, the time of arrival, the parent tables)
REFERENCES = {
    "rewritten_texts": ("id", "source_text_id", "ingested_at", ("human_texts",)),
    "humanized_texts": ("id", "source_text_id", "ingested_at", ("rewritten_texts",)),
    "detector_scores": ("score_id", "id", "scored_at", TEXT_TABLES),
}


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, row_key, ref and arrival of each referring record: the first arrival of its key, references not blank."""
    out = None
    for tbl, (k, ref, at, _) in REFERENCES.items():
        rows = table(spark, sf_dir, tbl).select(key(k).alias("k"), stripped(k).alias("row_key"), key(ref).alias("ref"), F.col(at).alias("arrival"))
        # ref stands in a struct so that min() compares a null as any other value
        first = rows.where("k is not null").groupBy("k").agg(F.min(F.struct("arrival", "row_key", "ref")).alias("f"))
        part = first.select(F.lit(tbl).alias("tbl"), "f.row_key", "f.ref", "f.arrival").where("ref is not null")
        out = part if out is None else out.unionByName(part)
    return out


def tagged(spark: SparkSession, sf_dir: str, referring: DataFrame) -> DataFrame:
    """Long form: tbl (whose references are meant), ref, tag (child, parent or log), at, month (of children), entry and gone (of the log)."""
    none = {"month": F.lit(None).cast("string"), "entry": F.lit(None).cast("bigint"), "gone": F.lit(None).cast("boolean")}

    def form(rows: DataFrame, tbl: Column, tag: str, at: str, **own: Column) -> DataFrame:
        extra = none | own
        return rows.select(tbl.alias("tbl"), "ref", F.lit(tag).alias("tag"), F.col(at).alias("at"), *[extra[c].alias(c) for c in none])

    long = form(referring, F.col("tbl"), "child", "arrival", month=F.date_format("arrival", "yyyy-MM"))
    for parent in TEXT_TABLES:
        kinds = [tbl for tbl, (_, _, _, parents) in REFERENCES.items() if parent in parents]
        rows = table(spark, sf_dir, parent).select(key("id").alias("ref"), "ingested_at")
        long = long.unionByName(form(rows, F.explode(F.array(*map(F.lit, kinds))), "parent", "ingested_at"))
    log = table(spark, sf_dir, "removal_log").select(key("id").alias("ref"), "logged_at", F.col("entry_id").alias("e"), (key("entry_type") == "delete").alias("g"))
    long = long.unionByName(form(log, F.explode(F.array(*map(F.lit, REFERENCES))), "log", "logged_at", entry=F.col("e"), gone=F.col("g")))
    return long.where("ref is not null")


def groups(long: DataFrame) -> DataFrame:
    """tbl, ref, kind (missing, deleted, late or null) and months: month, n, first and last arrival of the group's children."""
    child, parent, log = (F.col("tag") == t for t in ("child", "parent", "log"))
    by_month = long.groupBy("tbl", "ref", "month").agg(
        F.count(F.when(child, 1)).alias("n"), F.min(F.when(child, F.col("at"))).alias("first"), F.max(F.when(child, F.col("at"))).alias("last"),
        F.max(parent.cast("int")).alias("there"), F.min(F.when(parent, F.col("at"))).alias("since"), F.max(F.when(log, F.struct("at", "entry", "gone"))).alias("said"),
    )
    # a row a month: as many as the calendar has
    whole = by_month.groupBy("tbl", "ref").agg(
        F.collect_list(F.when(F.col("n") > 0, F.struct("month", "n", "first", "last"))).alias("months"), F.min("first").alias("first"),
        F.max("there").alias("there"), F.min("since").alias("since"), F.max("said")["gone"].alias("deleted"),
    )
    kind = F.when(F.col("deleted"), "deleted").when(F.col("there") == 0, "missing").when(F.col("since") > F.col("first"), "late")
    return whole.where(F.size("months") > 0).select("tbl", "ref", kind.alias("kind"), "since", "months")


def _listed(referring: DataFrame, kept: DataFrame) -> DataFrame:
    """The children of kept groups; of a group whose parent came late those that came before it."""
    rows = referring.join(kept.select("tbl", "ref", "kind", "since"), ["tbl", "ref"])
    return rows.where((F.col("kind") != "late") | (F.col("since") > F.col("arrival"))).select("tbl", "row_key", "kind", "arrival")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, row_key, kind (deleted, missing or late) and arrival of each reference without a valid target.

    Null and blank references are no cases. Nulls: a row with a null key is left out (it can't be named); a target or
    child without a time is never late; a log entry without a time counts as the earliest. Of rows with the same key
    the first arrival counts, of ties the smallest reference. Empty tables give an empty result.
    """
    referring = children(spark, sf_dir)
    return _listed(referring, groups(tagged(spark, sf_dir, referring)).where("kind is not null"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(spark, sf_dir).select("tbl", "row_key", "kind")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans and all references per table, kind and month of the referring row's first arrival: sums of the groups' counts."""
    referring = written(children(spark, sf_dir), "children")
    each = written(groups(tagged(spark, sf_dir, referring)), "groups")
    months = each.select("tbl", "ref", "kind", "since", F.explode("months").alias("m")).select("tbl", "ref", "kind", "since", "m.*")
    # of a late parent's groups a month counts whole or not at all, but for the one in which the parent came
    whole = F.when(F.col("kind") == "late", F.col("last") < F.col("since")).otherwise(F.col("kind").isNotNull())
    split = (F.col("kind") == "late") & (F.col("first") < F.col("since")) & (F.col("last") >= F.col("since"))
    found = months.groupBy("tbl", "month", "kind").agg(F.sum("n").alias("n_all"), F.sum(F.when(whole, F.col("n")).otherwise(0)).alias("n"))
    rest = months.where(split).select("tbl", "ref", "month", "since").withColumnRenamed("month", "m")
    rest = referring.join(rest, ["tbl", "ref"]).where((F.col("arrival") < F.col("since")) & (F.date_format("arrival", "yyyy-MM") == F.col("m")))
    found = found.unionByName(rest.groupBy("tbl", F.col("m").alias("month")).agg(F.lit("late").alias("kind"), F.lit(0).cast("bigint").alias("n_all"), F.count("*").alias("n")))
    # one row for each table, kind and month from here
    sums = found.groupBy("tbl", "month", "kind").agg(F.sum("n_all").alias("n_all"), F.sum("n").alias("n"))
    return sums.withColumn("n_references", F.sum("n_all").over(W.partitionBy("tbl", "month"))).where("n > 0 and kind is not null").select("tbl", "month", "kind", "n", "n_references")


_K = "nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"
_S = "nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')"


def _child_sql(tbl: str) -> str:
    k, ref, at, parents = REFERENCES[tbl]
    return f"""select '{tbl}' as tbl, row_key, ref, arrival from (
      select {_S.format(c=k)} as row_key, {_K.format(c=ref)} as ref, {at} as arrival,
             row_number() over (partition by {_K.format(c=k)} order by {at} nulls first) as rn
      from {tbl} where {_K.format(c=k)} is not null) where rn = 1 and ref is not null"""


_CHILDREN = " union all ".join(_child_sql(t) for t in REFERENCES)
_PARENTS = " union all ".join(f"select '{c}' as tbl, {_K.format(c='id')} as ref, min(ingested_at) as t0 from {t} group by 2" for c, v in REFERENCES.items() for t in v[3])
_ORPHANS_SQL = f"""with c as ({_CHILDREN}),
  p as (select tbl, ref, min(t0) as t0 from ({_PARENTS}) group by 1, 2),
  g as (select {_K.format(c="id")} as ref, arg_max(lower(trim(entry_type)) = 'delete', row(logged_at, entry_id)) as gone from removal_log group by 1),
  o as (select c.tbl, c.row_key, c.arrival,
          case when g.gone then 'deleted' when p.ref is null then 'missing' when p.t0 > c.arrival then 'late' end as kind
        from c left join p on p.tbl = c.tbl and p.ref = c.ref left join g on g.ref = c.ref)"""

SQL = {
    "p4_found": _ORPHANS_SQL + " select tbl, row_key, kind from o where kind is not null",
    "p4_report": _ORPHANS_SQL
    + """, n as (select tbl, strftime(arrival at time zone 'UTC', '%Y-%m') as month, count(*) as n_references from c group by 1, 2)
      select o.tbl, strftime(o.arrival at time zone 'UTC', '%Y-%m') as month, kind, count(*) as n, any_value(n_references) as n_references
      from o join n on n.tbl = o.tbl and n.month = strftime(o.arrival at time zone 'UTC', '%Y-%m') where kind is not null group by 1, 2, 3""",
}
QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
