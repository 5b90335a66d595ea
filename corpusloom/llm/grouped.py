"""Splits that keep related records together: components by minimum-edge contraction, dealt to splits by size.

Records are linked by author, by the record they were made from, or by a common such record. Each record hangs on its
author (or, without one, on itself), which contracts the stars of authors before any edge is built. The edges left run
between those: a Borůvka round lets every vertex pick its least edge (by a hash of the edge, so that trees stay shallow),
jumps along the picks to the root and contracts. The picked edges, with the records whose edges they are, and the stars are
the spanning forest; each round is written to the shared folder. Rounds are logarithmic in the number of vertices. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.keys import author, first_arrivals, key, split_name, text_records
from corpusloom.operators.components import contract
from corpusloom.session import written

SPLITS = ("train", "val", "test")
SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}
#: Groups of at least this share of all records are placed one by one; there are at most 1/LARGE of them.
LARGE = 0.002
#: Groups per cell of the systematic deal.
CELL = 50_000


def linked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, id, au, src, split of each record of the four text tables: a key that came more than once, as it came first."""
    rows = text_records(spark, sf_dir, ["id", "author_id", "source_text_id", "split", "ingested_at"])
    rows = rows.select(key("id").alias("k"), "id", author("author_id").alias("au"), key("source_text_id").alias("src"), split_name("split").alias("split"), F.col("ingested_at").alias("at"))
    return first_arrivals(rows.where("k is not null"), "k", "at", ["at", "id", "au", "src", "split"]).drop("at")


def hung(records: DataFrame) -> DataFrame:
    """records with `label`, the vertex on which each hangs: its author, else itself."""
    return records.withColumn("label", F.coalesce(F.concat(F.lit("a:"), "au"), F.concat(F.lit("i:"), "k")))


def label_edges(recs: DataFrame) -> DataFrame:
    """Distinct edges (u, v), u < v, between vertices: from a record's to that of the record it was made from.

    ou, ov: a record's own vertex and that of the record it names, whose edge it is; the least of those that fall together.
    """
    refs = recs.where("src is not null").groupBy("label", "src").agg(F.min("k").alias("k"))
    ends = refs.join(recs.select(F.col("k").alias("src"), F.col("label").alias("other")), "src", "left")
    own = F.concat(F.lit("i:"), "src")
    other = F.coalesce("other", own)
    ends = ends.select(F.least("label", other).alias("u"), F.greatest("label", other).alias("v"), F.struct(F.concat(F.lit("i:"), "k").alias("ou"), own.alias("ov")).alias("o")).where("u <> v")
    return ends.groupBy("u", "v").agg(F.min("o").alias("o")).select("u", "v", "o.ou", "o.ov")


def grouped(records: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """records with `root`, the name of its group; and the forest."""
    recs = written(hung(records), "records")
    comp, forest = contract(label_edges(recs))
    return recs.join(comp, "label", "left").withColumn("root", F.coalesce("root", "label")), forest


def _has(split: str) -> Column:
    return F.max(F.when(F.col("split") == split, 1).otherwise(0))


def group_sizes(recs: DataFrame) -> DataFrame:
    """root, group_id (smallest id in string order), n (records), torn (records in more than one split)."""
    return recs.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("n"), (sum(_has(s) for s in SPLITS) > 1).alias("torn"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs, _ = grouped(linked_records(spark, sf_dir))
    torn = group_sizes(recs).where("torn").select("root", "group_id")
    return recs.join(torn, "root").select("id", "group_id")


def deal(sizes: DataFrame, shares: dict[str, float] = SHARES, seed: str = "42") -> DataFrame:
    """sizes (root, n) with `new_split`: groups dealt so that records come as near the shares as the groups allow.

    The few largest groups (each at least LARGE of all records; their number is bounded by 1/LARGE) go one by one, largest
    first, to the split that lacks most. The rest is stratified into bands of doubling size. Each band is dealt
    systematically, in an order by hash: a group goes where the middle of its records lies on a line divided in the
    proportion of what the splits still lack; bands are cut into cells of bounded size, each with its own line. An
    empty table gives an empty one; equal sizes are told apart by the hash and the root.
    """
    sizes = sizes.select("root", *[c for c in ("group_id", "torn") if c in sizes.columns], "n")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    lack = {s: share * total for s, share in shares.items()}
    limit = max(2.0, LARGE * total)
    placed = []
    for r in sizes.where(F.col("n") >= limit).orderBy(F.desc("n"), "root").collect():  # at most 1/LARGE groups
        s = max(lack, key=lambda x: lack[x])
        lack[s] -= r["n"]
        placed.append((r["root"], s))
    columns = [*sizes.columns, "new_split"]
    big = sizes.join(F.broadcast(sizes.sparkSession.createDataFrame(placed, "root string, new_split string")), "root").select(columns)
    h = F.xxhash64(F.lit(seed), F.col("root"))
    rest = sizes.where(F.col("n") < limit).withColumns({"band": F.floor(F.log2("n")).cast("int"), "h": h})
    counts = {r["band"]: r["groups"] for r in rest.groupBy("band").agg(F.count("*").alias("groups")).collect()}  # at most 64 bands
    cells = F.lit(1)
    for b, groups in counts.items():
        cells = F.when(F.col("band") == b, max(1, -(-groups // CELL))).otherwise(cells)
    rest = rest.withColumn("cell", F.pmod("h", cells))
    out = written(big.unionByName(_on_a_line(rest.where("band > 0"), lack, shares).select(columns)), "dealt")
    for r in out.groupBy("new_split").agg(F.sum("n").alias("n")).collect():  # one row per split
        lack[r["new_split"]] = shares[r["new_split"]] * total - r["n"]
    for s in set(shares) - {r["new_split"] for r in out.select("new_split").distinct().collect()}:
        lack[s] = shares[s] * total
    # single records make up for what the larger groups left uneven
    return out.unionByName(_on_a_line(rest.where("band = 0"), lack, shares).select(columns))


def _on_a_line(rest: DataFrame, lack: dict[str, float], shares: dict[str, float]) -> DataFrame:
    """new_split by where the middle of a group's records lies on its cell's line, cut in the proportion of what splits lack."""
    w = W.partitionBy("band", "cell").orderBy("h", "root")
    place = (F.sum("n").over(w) - F.col("n") / 2) / F.sum("n").over(W.partitionBy("band", "cell"))
    wanted = {s: max(0.0, lack[s]) for s in shares}
    if sum(wanted.values()) <= 0:
        wanted = dict(shares)
    *names, last = shares
    new, end = None, 0.0
    for s in names:
        end += wanted[s] / sum(wanted.values())
        here = F.col("place") < end
        new = F.when(here, s) if new is None else new.when(here, s)
    return rest.withColumn("place", place).withColumn("new_split", F.lit(last) if new is None else new.otherwise(last))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, group_id and new_split of every record."""
    recs, _ = grouped(linked_records(spark, sf_dir))
    recs = written(recs.select("id", "root", "split"), "groups")
    dealt = deal(written(group_sizes(recs), "sizes"))
    return recs.join(dealt, "root").select("id", "group_id", "new_split")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: records it has now and gets, groups it gets, the share wanted and got."""
    recs, _ = grouped(linked_records(spark, sf_dir))
    recs = written(recs.select("id", "root", "split"), "groups")
    dealt = deal(written(group_sizes(recs), "sizes"))
    got = dealt.groupBy(F.col("new_split").alias("split")).agg(F.sum("n").alias("n_new"), F.count("*").alias("n_groups"))
    now = recs.where(F.col("split").isin(*SPLITS)).groupBy("split").agg(F.count("*").alias("n_now"))
    share = F.create_map(*[F.lit(x) for p in SHARES.items() for x in p])[F.col("split")]
    return got.join(now, "split", "full_outer").select("split", F.coalesce("n_now", F.lit(0)).alias("n_now"), F.coalesce("n_new", F.lit(0)).alias("n_new"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), share.alias("wanted"), (F.coalesce("n_new", F.lit(0)) / F.sum("n_new").over(W.partitionBy())).alias("share"))


def p5_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning forest over records (i:), authors (a:) and records that are named but missing (i:).

    Round -1 hangs each record on its author; the later rounds' edges, each between a record and the one it names, join
    what is still apart.
    """
    recs = written(hung(linked_records(spark, sf_dir)), "records")
    _, forest = contract(label_edges(recs))
    stars = recs.where("au is not null").select(F.concat(F.lit("i:"), "k").alias("u"), F.col("label").alias("v"), F.lit(-1).alias("round"))
    return stars if forest is None else stars.unionByName(forest)


QUERIES = {"p5_found": p5_found, "p5_splits": p5_splits, "p5_report": p5_report, "p5_forest": p5_forest}
SQL: dict[str, str] = {}
