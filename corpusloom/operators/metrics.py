"""Evaluation of detectors over their run lines: confusion counts, F1, ROC, strict thresholds, seeds, agreement, reports.

Curves are built from counts by distinct score. Running sums go over the few buckets of a score range and then within a
bucket, so that a detector with most of the lines is no single window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import NUDGE
from corpusloom.keys import first_arrivals, key
from corpusloom.operators.corpus import ranged_rank, _K, CORPUS, corpus
from corpusloom.session import table, written

CAP = 0.01
BUCKETS = 4096


def scores(spark, d) -> DataFrame:
    """sid, detector, k (the text's key), y_true, y_pred, y_score of each run line that has both labels and a score."""
    s = table(spark, d, "detector_scores").select(key("score_id").alias("sid"), F.col("scored_at").alias("at"), key("detector").alias("detector"), key("id").alias("k"), "y_true", "y_pred", "y_score")
    s = first_arrivals(s.where("sid is not null"), "sid", "at", ["at", "detector", "k", "y_true", "y_pred", "y_score"])
    return s.where("y_true is not null and y_pred is not null and y_score is not null and detector is not null").drop("at")


_SCORES = f"""s as (select sid, detector, k, y_true, y_pred, y_score from (select {_K.format(c='score_id')} as sid, {_K.format(c='detector')} as detector, {_K.format(c='id')} as k, y_true, y_pred, y_score,
   row_number() over (partition by {_K.format(c='score_id')} order by scored_at) as rn from detector_scores) where rn = 1 and sid is not null and y_true is not null and y_pred is not null and y_score is not null and detector is not null)"""


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def confusion(s: DataFrame, *by: str) -> DataFrame:
    n = lambda t, p: F.count(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), 1))
    return s.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), n(1, 0).alias("fn"))


def with_rates(c: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of both classes and macro-F1 from tp, fp, tn and fn; 0 where a division has none."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    named = {"accuracy": _ratio(tp + tn, tp + fp + tn + fn), "precision_ai": _ratio(tp, tp + fp), "recall_ai": _ratio(tp, tp + fn), "f1_ai": f1, "f1_human": f0, "macro_f1": (f1 + f0) / 2}
    return c.withColumns({k: F.round(v + NUDGE, 6) for k, v in named.items()})


def confusion_f1(spark, d):
    return with_rates(confusion(scores(spark, d), "detector"))


def per_source_accuracy(spark, d):
    c = corpus(spark, d, ["source"]).select("k", "source")
    j = scores(spark, d).join(c, "k", "left")
    return j.groupBy("detector", "source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")) + NUDGE, 6).alias("accuracy"))


def _running(df: DataFrame, part: str, score: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with running sums by the order (which is by score first, falling), in two steps: over buckets, within buckets."""
    df = df.withColumn("_b", F.floor(F.col(score) * BUCKETS))
    totals = df.groupBy(part, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    w = W.partitionBy(part).orderBy(F.desc("_b"))
    totals = totals.select(part, "_b", *[(F.sum(f"_t_{n}").over(w) - F.col(f"_t_{n}")).alias(f"_t_{n}") for n in sums])
    inner = W.partitionBy(part, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.join(totals, [part, "_b"]).withColumns({n: F.sum(c).over(inner) + F.col(f"_t_{n}") for n, c in sums.items()}).drop("_b", *[f"_t_{n}" for n in sums])


def by_score(s: DataFrame) -> DataFrame:
    """detector, y_score, p and q (AI and human lines of that score), tp and fp (of it and higher ones), n1 and n0."""
    c = s.groupBy("detector", "y_score").agg(F.sum("y_true").alias("p"), F.sum(1 - F.col("y_true")).alias("q"))
    n = s.groupBy("detector").agg(F.sum("y_true").alias("n1"), F.sum(1 - F.col("y_true")).alias("n0"))
    return _running(c, "detector", "y_score", [F.desc("y_score")], {"tp": "p", "fp": "q"}).join(n, "detector")


def roc_auc(spark, d):
    """Area under the ROC curve with ties counted half; null where a class is missing."""
    c = by_score(scores(spark, d))
    area = F.sum(F.col("p") * (F.col("n0") - F.col("fp") + F.col("q") / 2))
    return c.groupBy("detector").agg(F.max("n1").alias("n_ai"), F.max("n0").alias("n_human"), F.round(F.when(F.max(F.col("n1") * F.col("n0")) > 0, area / F.max(F.col("n1") * F.col("n0"))) + NUDGE, 6).alias("auc"))


def roc_points(spark, d):
    c = by_score(scores(spark, d))
    return c.select("detector", "y_score", F.round(_ratio(F.col("fp"), F.col("n0")) + NUDGE, 6).alias("fpr"), F.round(_ratio(F.col("tp"), F.col("n1")) + NUDGE, 6).alias("tpr"))


def strict_fpr_sweep(spark, d, cap=CAP):
    """Line by line from the highest score (ties by key): the last line before the human rate passes the cap.

    Scores count as a whole but for the one at which the cap is passed; of its lines those before the first human line
    too many are kept, found by its rank, so that a score that very many lines share is no hot group.
    """
    s = scores(spark, d)
    within = F.col("fp") <= cap * F.col("n0")
    n = lambda c: F.coalesce(c, F.lit(0))
    whole = by_score(s).groupBy("detector").agg(F.max("n1").alias("n1"), F.max("n0").alias("n0"), F.min(F.when(within, F.col("y_score"))).alias("least"), n(F.max(F.when(within, F.col("tp")))).alias("tp"), n(F.max(F.when(within, F.col("fp")))).alias("fp"), F.max(F.when(~within, F.col("y_score"))).alias("passed"))
    whole = written(whole, "scores")  # one row a detector
    tied = s.join(whole.select("detector", F.col("passed").alias("y_score"), (F.floor(cap * F.col("n0")) - F.col("fp")).alias("allowed")), ["detector", "y_score"])
    first = ranged_rank(tied.where("y_true = 0").select("detector", "sid", "allowed"), ["sid"], "r", ["detector"]).where(F.col("r") == F.col("allowed") + 1).select("detector", F.col("sid").alias("end"))
    some = tied.join(first, "detector").where(F.col("sid") < F.col("end")).groupBy("detector").agg(F.sum("y_true").alias("p"), F.sum(1 - F.col("y_true")).alias("q"), F.min("y_score").alias("at"))
    best = whole.join(some, "detector", "left").select("detector", F.coalesce("at", "least").alias("threshold"), (F.col("tp") + n("p")).alias("tp"), (F.col("fp") + n("q")).alias("fp"), "n1", "n0").where("threshold is not null")
    return best.select("detector", "threshold", F.round(_ratio(F.col("tp"), F.col("n1")) + NUDGE, 6).alias("tpr"), F.round(_ratio(F.col("fp"), F.col("n0")) + NUDGE, 6).alias("fpr"), F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp")) + NUDGE, 6).alias("precision"))


def _rates_at(c: DataFrame, thresholds: DataFrame) -> DataFrame:
    """tpr and fpr of each detector at its threshold (scores at or above it are AI)."""
    hit = c.join(thresholds, "detector").where(F.col("y_score") >= F.col("threshold"))
    got = hit.groupBy("detector").agg(F.max("tp").alias("tp"), F.max("fp").alias("fp"))
    n = c.groupBy("detector").agg(F.max("n1").alias("n1"), F.max("n0").alias("n0"))
    out = thresholds.join(n, "detector").join(got, "detector", "left")
    return out.select("detector", F.round("threshold", 9).alias("threshold"), F.round(_ratio(F.coalesce("tp", F.lit(0)), F.col("n1")) + NUDGE, 6).alias("tpr"), F.round(_ratio(F.coalesce("fp", F.lit(0)), F.col("n0")) + NUDGE, 6).alias("fpr"))


def strict_fpr_quantile(spark, d, cap=CAP):
    """Just above the human score of rank n - floor(cap n) in rising order."""
    c = by_score(scores(spark, d))
    at_most = F.col("n0") - F.col("fp") + F.col("q")  # human lines of this score and lower ones
    t = c.where((F.col("q") > 0) & (at_most >= F.col("n0") - F.floor(cap * F.col("n0")))).groupBy("detector").agg((F.min("y_score") + 1e-12).alias("threshold"))
    return _rates_at(c, t)


def strict_fpr_roc(spark, d, cap=CAP):
    """The lowest distinct score at which the human rate is within the cap."""
    c = by_score(scores(spark, d))
    t = c.where(F.col("fp") <= cap * F.col("n0")).groupBy("detector").agg(F.min("y_score").alias("threshold"))
    return _rates_at(c, t)


def _seed() -> Column:
    return F.pmod(F.conv(F.substring(F.md5("sid"), 1, 4), 16, 10).cast("int"), F.lit(5))


def mean_std_over_seeds(spark, d):
    """Mean and sample deviation of accuracy and macro-F1 over five parts of the lines."""
    c = with_rates(confusion(scores(spark, d).withColumn("seed", _seed()), "detector", "seed"))
    stat = lambda x: [F.round(F.avg(x) + NUDGE, 5).alias(f"mean_{x}"), F.round(F.stddev_samp(x) + NUDGE, 5).alias(f"std_{x}")]
    return c.groupBy("detector").agg(F.count("*").alias("seeds"), *stat("accuracy"), *stat("macro_f1"))


def _pairs(spark, d) -> DataFrame:
    """Two detectors' lines of the same text; a detector that ran twice over a text counts once (its first key)."""
    s = scores(spark, d).where("k is not null").groupBy("detector", "k").agg(F.min_by(F.struct("y_true", "y_pred"), "sid").alias("v")).select("detector", "k", "v.y_true", "v.y_pred")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.detector") < F.col("b.detector")))


def model_agreement(spark, d):
    p = _pairs(spark, d)
    return p.groupBy(F.col("a.detector").alias("one"), F.col("b.detector").alias("two")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("a.y_pred") == F.col("b.y_pred")).cast("int")) + NUDGE, 6).alias("agreement"))


def mcnemar_counts(spark, d):
    """Texts that only the one and only the other detector got right."""
    p = _pairs(spark, d)
    ok = lambda x: F.col(f"{x}.y_pred") == F.col(f"{x}.y_true")
    return p.groupBy(F.col("a.detector").alias("one"), F.col("b.detector").alias("two")).agg(F.count(F.when(ok("a") & ~ok("b"), 1)).alias("b"), F.count(F.when(~ok("a") & ok("b"), 1)).alias("c"))


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided binomial p-value of discordant counts; 1 where there are none."""
    from math import lgamma, log

    n = b + c
    if n == 0:
        return 1.0
    logs = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * log(2) for i in range(min(b, c) + 1)]
    return min(1.0, 2 * float(np.exp(logs).sum()))


def mcnemar_test(spark, d):
    rows = mcnemar_counts(spark, d).collect()  # one row for each pair of detectors
    return spark.createDataFrame([(r["one"], r["two"], r["b"], r["c"], round(mcnemar_p(r["b"], r["c"]), 9)) for r in rows], "one string, two string, b bigint, c bigint, p double")


def vote_contested(spark, d):
    """AI votes and voters of each text that more than one detector scored; contested between int(.3 n) and int(.7 n)."""
    v = scores(spark, d).where("k is not null").groupBy("k").agg(F.sum("y_pred").alias("votes"), F.count("*").alias("n")).where("n > 1")
    return v.select(F.col("k").alias("id"), "votes", "n", F.col("votes").between(F.floor(0.3 * F.col("n")), F.floor(0.7 * F.col("n"))).alias("contested"))


def score_histogram(spark, d, bins=30):
    """Counts in equal bins between each detector's least and highest score of a class."""
    s = scores(spark, d)
    r = s.groupBy("detector", "y_true").agg(F.min("y_score").alias("lo"), F.max("y_score").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("y_score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return s.join(r, ["detector", "y_true"]).groupBy("detector", "y_true", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def score_squash(spark, d):
    """The scores' z from the raw payload as probabilities: sigmoid, 1 / (1 + z), clamped; and a hard label."""
    s = table(spark, d, "detector_scores").select(key("score_id").alias("sid"), F.col("scored_at").alias("at"), F.get_json_object("raw", "$.z").cast("double").alias("z"), F.get_json_object("raw", "$.n_tokens").cast("int").alias("n_tokens"))
    s = first_arrivals(s.where("sid is not null"), "sid", "at", ["at", "z", "n_tokens"]).where("z is not null")
    z = F.col("z")
    return s.select(F.col("sid").alias("score_id"), "n_tokens", F.round(1 / (1 + F.exp(-z)) + NUDGE, 6).alias("sigmoid"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)) + NUDGE, 6).alias("clamped"), F.when(z != -1, F.round(1 / (1 + z) + NUDGE, 4)).alias("inverse"), F.when(z >= 0, "ai").otherwise("human").alias("label"))


def _by_set(spark, d) -> DataFrame:
    """Rates by detector and evaluation set: human lines are in both, AI lines are clean or humanized by their table."""
    c = corpus(spark, d, []).select("k", "tbl")
    s = scores(spark, d).join(c, "k").withColumn("sets", F.when(F.col("y_true") == 0, F.array(F.lit("clean"), F.lit("humanized"))).when(F.col("tbl") == "humanized_texts", F.array(F.lit("humanized"))).otherwise(F.array(F.lit("clean"))))
    return with_rates(confusion(s.withColumn("eval_set", F.explode("sets")), "detector", "eval_set"))


def clean_vs_humanized(spark, d):
    m = _by_set(spark, d)
    one = lambda x: m.where(F.col("eval_set") == x).select("detector", F.col("macro_f1").alias(f"f1_{x}"), F.col("recall_ai").alias(f"tpr_{x}"))
    j = one("clean").join(one("humanized"), "detector", "full_outer")
    return j.select("detector", "f1_clean", "f1_humanized", F.round(F.col("f1_humanized") - F.col("f1_clean"), 6).alias("delta_f1"), F.round(F.col("tpr_humanized") - F.col("tpr_clean"), 6).alias("delta_tpr"))


def anomaly_flags(spark, d):
    """Detectors that lose more than 0.2 of macro-F1, have an area under 0.6, or no strict threshold."""
    c = clean_vs_humanized(spark, d).join(roc_auc(spark, d), "detector", "left").join(strict_fpr_roc(spark, d).select("detector", "threshold"), "detector", "left")
    return c.select("detector", (F.coalesce("delta_f1", F.lit(0.0)) < -0.2).alias("drops"), (F.coalesce("auc", F.lit(0.0)) < 0.6).alias("weak"), F.col("threshold").isNull().alias("no_threshold"))


def leaderboard(spark, d, k=10):
    """The detectors of highest macro-F1, nulls last, ties by name: a top-k report."""
    m = confusion_f1(spark, d).join(roc_auc(spark, d).select("detector", "auc"), "detector", "left")
    top = m.orderBy(F.desc_nulls_last("macro_f1"), "detector").limit(k)
    return top.select("detector", "macro_f1", "accuracy", "auc", F.row_number().over(W.orderBy(F.desc_nulls_last("macro_f1"), "detector")).alias("place"))  # at most k rows


def score_spread(spark, d):
    """Spread of macro-F1 over detectors, how many are at the ceiling, and the best."""
    m = confusion_f1(spark, d)
    return m.agg(F.round(F.max("macro_f1") - F.min("macro_f1"), 6).alias("spread"), F.count(F.when(F.col("macro_f1") >= 0.99, 1)).alias("at_ceiling"), F.max_by("detector", F.struct("macro_f1", "detector")).alias("best"))


def best_epoch(history: list[float], patience: int = 8) -> tuple[int, int]:
    """The first epoch (from 0) of strictly highest score before training stops, and the epoch at which it stops."""
    best, at = float("-inf"), 0
    for i, score in enumerate(history):
        if score > best:
            best, at = score, i
        elif i - at >= patience:
            return at, i
    return at, max(len(history) - 1, 0)


def bootstrap_ci(spark, d, resamples=2000, seed=42):
    """Mean and 2.5 and 97.5 per cent points of macro-F1 over resamples of the lines.

    Macro-F1 hangs on the four confusion counts only, and those of a resample with replacement are multinomial: so they
    are drawn from the counts of all lines, and no line is copied. Resamples with one class are skipped.
    """
    rng, out = np.random.default_rng(seed), []
    for r in confusion(scores(spark, d), "detector").orderBy("detector").collect():  # one row for each detector
        n = np.array([r["tp"], r["fp"], r["tn"], r["fn"]], float)
        if not n.sum():
            continue
        tp, fp, tn, fn = rng.multinomial(int(n.sum()), n / n.sum(), resamples).T
        ok = (tp + fn > 0) & (tn + fp > 0)
        f = ((2 * tp / np.maximum(2 * tp + fp + fn, 1)) + (2 * tn / np.maximum(2 * tn + fp + fn, 1)))[ok] / 2
        if len(f):
            out.append((r["detector"], int(ok.sum()), float(f.mean()), float(np.percentile(f, 2.5)), float(np.percentile(f, 97.5))))
    return spark.createDataFrame(out, "detector string, resamples int, mean double, low double, high double")


_W = f"with {CORPUS}, {_SCORES}"
_CONF = lambda src, by: f"(select {by}, count(*) filter (y_true = 1 and y_pred = 1) as tp, count(*) filter (y_true = 0 and y_pred = 1) as fp, count(*) filter (y_true = 0 and y_pred = 0) as tn, count(*) filter (y_true = 1 and y_pred = 0) as fn from {src} group by {by})"
_R = lambda a, b, n=6: f"round((case when {b} <> 0 then ({a}) / ({b}) else 0.0 end) + 1e-9, {n})"
_F1 = "(case when 2 * tp + fp + fn <> 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end)"
_F0 = "(case when 2 * tn + fp + fn <> 0 then 2 * tn / (2 * tn + fp + fn) else 0.0 end)"
_RATES = f"*, {_R('tp + tn', 'tp + fp + tn + fn')} as accuracy, {_R('tp', 'tp + fp')} as precision_ai, {_R('tp', 'tp + fn')} as recall_ai, round({_F1} + 1e-9, 6) as f1_ai, round({_F0} + 1e-9, 6) as f1_human, round(({_F1} + {_F0}) / 2 + 1e-9, 6) as macro_f1"
_BY = """b as (select detector, y_score, sum(y_true) as p, sum(1 - y_true) as q from s group by 1, 2), nn as (select detector, sum(y_true) as n1, sum(1 - y_true) as n0 from s group by 1),
  c as (select b.*, n1, n0, sum(p) over w as tp, sum(q) over w as fp from b join nn using (detector) window w as (partition by detector order by y_score desc rows between unbounded preceding and current row))"""
_AUC = "auc as (select detector, max(n1) as n_ai, max(n0) as n_human, round(case when max(n1 * n0) > 0 then sum(p * (n0 - fp + q / 2)) / max(n1 * n0) end + 1e-9, 6) as auc from c group by 1)"
_AT = f"""g as (select t.detector, max(tp) as tp, max(fp) as fp from c join t using (detector) where y_score >= threshold group by 1) select t.detector, round(threshold, 9) as threshold, {_R('coalesce(g.tp, 0)', 'n1')} as tpr, {_R('coalesce(g.fp, 0)', 'n0')} as fpr from t join nn using (detector) left join g using (detector)"""
_TQ = "t as (select detector, min(y_score) + 1e-12::double as threshold from c where q > 0 and n0 - fp + q >= n0 - floor(0.01::double * n0) group by 1)"
_TR = "t as (select detector, min(y_score) as threshold from c where fp <= 0.01::double * n0 group by 1)"
_PAIRS = "u as (select detector, k, arg_min(y_true, sid) as y_true, arg_min(y_pred, sid) as y_pred from s where k is not null group by 1, 2)"
_SETS = f"e as (select s.*, unnest(case when y_true = 0 then ['clean', 'humanized'] when c.tbl = 'humanized_texts' then ['humanized'] else ['clean'] end) as eval_set from s join corpus c on c.k = s.k), m as (select {_RATES} from {_CONF('e', 'detector, eval_set')})"
_CVH = "v as (select coalesce(a.detector, b.detector) as detector, a.macro_f1 as f1_clean, b.macro_f1 as f1_humanized, round(b.macro_f1 - a.macro_f1, 6) as delta_f1, round(b.recall_ai - a.recall_ai, 6) as delta_tpr from (select * from m where eval_set = 'clean') a full outer join (select * from m where eval_set = 'humanized') b on a.detector = b.detector)"
SQL = {
    "confusion_f1": f"{_W} select {_RATES} from {_CONF('s', 'detector')}",
    "per_source_accuracy": f"{_W} select detector, c.source, count(*) as n, round(avg((y_true = y_pred)::int) + 1e-9, 6) as accuracy from s left join corpus c on c.k = s.k group by 1, 2",
    "roc_auc": f"{_W}, {_BY}, {_AUC} select * from auc",
    "roc_points": f"{_W}, {_BY} select detector, y_score, {_R('fp', 'n0')} as fpr, {_R('tp', 'n1')} as tpr from c",
    "strict_fpr_sweep": f"{_W}, nn as (select detector, sum(y_true) as n1, sum(1 - y_true) as n0 from s group by 1), r as (select detector, y_score, sum(y_true) over w as tp, sum(1 - y_true) over w as fp from s window w as (partition by detector order by y_score desc, sid rows between unbounded preceding and current row)), b as (select detector, min(y_score) as threshold, max(tp) as tp, max(fp) as fp, max(n1) as n1, max(n0) as n0 from r join nn using (detector) where fp <= 0.01::double * n0 group by 1) select detector, threshold, {_R('tp', 'n1')} as tpr, {_R('fp', 'n0')} as fpr, {_R('tp', 'tp + fp')} as precision from b",
    "strict_fpr_quantile": f"{_W}, {_BY}, {_TQ}, {_AT}",
    "strict_fpr_roc": f"{_W}, {_BY}, {_TR}, {_AT}",
    "mean_std_over_seeds": f"{_W}, x as (select *, ('0x' || substr(md5(sid), 1, 4))::int % 5 as seed from s), m as (select {_RATES} from {_CONF('x', 'detector, seed')}) select detector, count(*) as seeds, round(avg(accuracy) + 1e-9, 5) as mean_accuracy, round(stddev_samp(accuracy) + 1e-9, 5) as std_accuracy, round(avg(macro_f1) + 1e-9, 5) as mean_macro_f1, round(stddev_samp(macro_f1) + 1e-9, 5) as std_macro_f1 from m group by 1",
    "model_agreement": f"{_W}, {_PAIRS} select a.detector as one, b.detector as two, count(*) as n, round(avg((a.y_pred = b.y_pred)::int) + 1e-9, 6) as agreement from u a join u b on a.k = b.k and a.detector < b.detector group by 1, 2",
    "mcnemar_counts": f"{_W}, {_PAIRS} select a.detector as one, b.detector as two, count(*) filter (a.y_pred = a.y_true and b.y_pred <> b.y_true) as b, count(*) filter (a.y_pred <> a.y_true and b.y_pred = b.y_true) as c from u a join u b on a.k = b.k and a.detector < b.detector group by 1, 2",
    "mcnemar_test": f"""{_W}, {_PAIRS}, m as (select a.detector as one, b.detector as two, count(*) filter (a.y_pred = a.y_true and b.y_pred <> b.y_true) as b, count(*) filter (a.y_pred <> a.y_true and b.y_pred = b.y_true) as c from u a join u b on a.k = b.k and a.detector < b.detector group by 1, 2)
      select *, case when b + c = 0 then 1.0 else round(least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))), 9) end as p from m""",
    "vote_contested": f"{_W}, v as (select k, sum(y_pred) as votes, count(*) as n from s where k is not null group by 1 having count(*) > 1) select k as id, votes, n, votes between floor(0.3::double * n) and floor(0.7::double * n) as contested from v",
    "score_histogram": f"{_W}, r as (select detector, y_true, min(y_score) as lo, max(y_score) as hi from s group by 1, 2) select detector, y_true, (case when hi > lo then least(floor((y_score - lo) / (hi - lo) * 30), 29) else 0 end)::int as bin, count(*) as n from s join r using (detector, y_true) group by 1, 2, 3",
    "score_squash": f"with z as (select sid, z, n_tokens from (select {_K.format(c='score_id')} as sid, json_extract_string(raw, '$.z')::double as z, json_extract_string(raw, '$.n_tokens')::int as n_tokens, row_number() over (partition by {_K.format(c='score_id')} order by scored_at) as rn from detector_scores) where rn = 1 and sid is not null and z is not null) select sid as score_id, n_tokens, round(1 / (1 + exp(-z)) + 1e-9, 6) as sigmoid, round(greatest(0.0::double, least(1.0::double, z)) + 1e-9, 6) as clamped, case when z <> -1 then round(1 / (1 + z) + 1e-9, 4) end as inverse, case when z >= 0 then 'ai' else 'human' end as label from z",
    "clean_vs_humanized": f"{_W}, {_SETS}, {_CVH} select * from v",
    "anomaly_flags": f"{_W}, {_SETS}, {_CVH}, {_BY}, {_AUC}, {_TR} select v.detector, coalesce(delta_f1, 0.0) < -0.2 as drops, coalesce(auc, 0.0) < 0.6 as weak, threshold is null as no_threshold from v left join auc using (detector) left join t using (detector)",
    "leaderboard": f"{_W}, {_BY}, {_AUC}, m as (select {_RATES} from {_CONF('s', 'detector')}) select detector, macro_f1, accuracy, auc, row_number() over (order by macro_f1 desc nulls last, detector) as place from m left join auc using (detector) order by macro_f1 desc nulls last, detector limit 10",
    "score_spread": f"{_W}, m as (select {_RATES} from {_CONF('s', 'detector')}) select round(max(macro_f1) - min(macro_f1), 6) as spread, count(*) filter (macro_f1 >= 0.99) as at_ceiling, arg_max(detector, row(macro_f1, detector)) as best from m",
}
QUERIES = {n: globals()[n] for n in [*SQL, "bootstrap_ci"]}
