"""Classification of labelled samples by rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MiningConfig
from ..functions import kernels as K
from ..functions import mining as M


def stratified_sample(rows: DataFrame, rate_or_n: float, seed: int = 0, label: str = "label", id_col: str = "sample_id") -> DataFrame:
    """Per class: a rate in (0, 1] takes max(1, ceil(n * rate)), a larger number at most that many; by an integer hash of id and seed."""
    h = F.pmod(F.col(id_col) * F.lit(2654435761) + seed, F.lit(4294967296))
    rows = rows.withColumn("_h", h).withColumn("_cell", F.floor(F.col("_h") / 4194304))  # 1024 cells of each class
    cells = rows.groupBy(F.col(label).alias("_label"), F.col("_cell").alias("_c")).agg(F.count("*").alias("_k"))
    by = Window.partitionBy("_label").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("_k").over(Window.partitionBy("_label"))
    take = F.greatest(F.lit(1), F.ceil(n * rate_or_n)) if 0 < rate_or_n <= 1 else F.least(F.lit(int(rate_or_n)), n)
    cells = cells.select("_label", "_c", F.coalesce(F.sum("_k").over(by), F.lit(0)).alias("_before"), take.alias("_take")).where("_before < _take")
    some = rows.join(cells, rows[label].eqNullSafe(cells["_label"]) & (rows["_cell"] == cells["_c"]))
    some = some.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_cell").orderBy("_h", id_col)))
    return some.where(F.col("_before") + F.col("_r") <= F.col("_take")).drop("_h", "_cell", "_label", "_c", "_before", "_take", "_r")


def rule_series_cross(rules: DataFrame, samples: DataFrame, rule_rows: int = 100_000, rule_bytes: int = 1 << 26) -> DataFrame:
    """Every rule against every sample, as its contract is, samples staying where they are. Rules are broadcast while they are at
    most rule_rows and rule_bytes (as JSON); beyond that both sides are dealt by a bucket of the rules, so each task meets a
    bounded part of them."""
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    if n <= rule_rows and size <= rule_bytes:
        return samples.join(F.broadcast(rules), F.lit(True))
    buckets = max(-(-n // rule_rows), -(-size // rule_bytes))
    some = samples.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return some.join(rules.withColumn("_bucket", F.pmod(F.xxhash64("rule_id"), F.lit(buckets))), "_bucket").drop("_bucket")


REGIONS = "lhs_points long, irrelevant array<struct<a: long, b: long>>, violation array<struct<a: long, b: long>>, satisfaction array<struct<a: long, b: long>>, n_l long, n_r long, bad_points long"


def runs(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def regions(r, cfg: MiningConfig) -> tuple:
    """Cover of the left side and what the right side shows: single left class only, else the cover alone."""
    left, right = np.asarray(r.left_vals, float), np.asarray(r.right_vals, float)
    free, found, last = np.arange(len(left)), [], -1
    got = M.longest_matches(left, free, (r.l_breaks, r.l_slopes, r.l_intercepts), epsilon=r.l_epsilon, bound=r.l_bound, lo=r.l_lo, hi=r.l_hi, step=cfg.double_step, rate=cfg.window_rate, kind=cfg.error_kind, gamma=r.l_gamma, penalty=cfg.gamma_penalty)
    for s, d, lam, _ in sorted(got):
        if s > last:
            found.append((s, d, lam))
            last = s + int(d * cfg.minimum_interval)
    cover = np.zeros(len(left), bool)
    for s, d, _ in found:
        cover[s : s + d] = True
    seen, bad = np.zeros(len(right), bool), np.zeros(len(right), bool)
    if found and len(r.lhs) == 1:
        c = np.stack([np.asarray(x, float) for x in (r.coef_t1, r.coef_delta, r.coef_lam)])
        for f in found:
            t2, d2, lam2 = (float(x) for x in c @ np.array([1.0, *f]))
            t2, d2 = int(np.rint(t2)), int(np.rint(d2))
            if t2 < 0 or d2 < 2 or t2 + d2 > len(right):
                continue
            actual = right[t2 : t2 + d2]
            p = K.piecewise_predict(np.arange(d2) / (d2 - 1), r.breaks, r.slopes, r.intercepts) * lam2 + actual[0]
            e = K.align_error_norm(p, actual, int(d2 * cfg.window_rate))
            seen[t2 : t2 + d2] = True
            bad[t2 : t2 + d2] |= e > (0.0 if r.epsilon is None or np.isnan(r.epsilon) else r.epsilon)
    return int(cover.sum()), runs(~seen), runs(bad), runs(seen & ~bad), len(left), len(right), int(bad.sum())


def check_rule_regions(rows: DataFrame, cfg: MiningConfig, keep: list[str]) -> DataFrame:
    """rows: a rule with its left and right classes next to the two series (see with_classes); returns `keep` and the regions."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches):
        for pdf in batches:
            out = [(*(getattr(r, k) for k in keep), *regions(r, cfg)) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(out, columns=[*keep, "lhs_points", "irrelevant", "violation", "satisfaction", "n_l", "n_r", "bad_points"])

    return rows.mapInPandas(run, f"{kinds}, {REGIONS}")


def with_classes(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Single-left rules with the left class's scan parameters (l_*) and the right class's shape."""
    side = F.struct("attr_id", "class_id")
    left = classes.select("series_id", side.alias("_l"), F.col("breaks").alias("l_breaks"), F.col("slopes").alias("l_slopes"), F.col("intercepts").alias("l_intercepts"), F.col("epsilon").alias("l_epsilon"), F.col("lam_min_bound").alias("l_bound"), F.col("delta_lo").alias("l_lo"), F.col("delta_hi").alias("l_hi"), F.col("gamma").alias("l_gamma"))
    right = classes.select("series_id", side.alias("rhs"), "breaks", "slopes", "intercepts")
    one = rules.where(F.size("lhs") == 1).withColumn("_l", F.get("lhs", F.lit(0)))
    return one.join(left, ["series_id", "_l"]).join(right, ["series_id", "rhs"]).drop("_l", "lhs_combinations")


def rule_score(rows: DataFrame) -> DataFrame:
    """score = share of the left series covered - share of the right series that violates; 0 without a left match."""
    score = F.when(F.col("lhs_points") == 0, 0.0).otherwise(F.col("lhs_points") / F.col("n_l") - F.col("bad_points") / F.col("n_r"))
    return rows.withColumn("score", score)


def rule_discrimination(scores: DataFrame) -> DataFrame:
    """(rule_id, rule_label, score): sum of scores on the rule's own class / (sum on others + 1)."""
    own = F.col("label") == F.col("rule_label")
    sums = scores.groupBy("rule_id", "rule_label").agg(F.sum(F.when(own, F.col("score")).otherwise(0.0)).alias("same"), F.sum(F.when(~own, F.col("score")).otherwise(0.0)).alias("diff"))
    return sums.select("rule_id", "rule_label", F.when(F.col("diff") == -1, 0.0).otherwise(F.col("same") / (F.col("diff") + 1)).alias("score"))


def topk_rules_per_class(rules: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("rule_label").orderBy(F.desc("score"), "rule_id")
    return rules.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def class_order(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("label").union(test.select("label")).distinct().orderBy("label")


def short_list(classes: DataFrame, most: int = 100_000) -> DataFrame:
    """The labels, to be broadcast; an error where there are more than `most`."""
    own = classes.select("label")
    if own.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} classes")
    return F.broadcast(own)


def class_score_vector(scores: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(row_id, label, score): mean score of each class's rules on each row, 0 where it has none. classes is a short list."""
    per = scores.groupBy("row_id", F.col("rule_label").alias("label")).agg(F.avg("score").alias("score"))
    return rows.select("row_id").join(short_list(classes), F.lit(True)).join(per, ["row_id", "label"], "left").fillna(0.0, ["score"])


def align_scores(logits: DataFrame, classes: DataFrame) -> DataFrame:
    """(row_id, label, logit) from one logits array a row: a class's logit stands at int(label); out of range is an error."""
    rows = logits.join(short_list(classes), F.lit(True))
    at = F.col("label").cast("int")
    odd = F.raise_error(F.lit("a label is out of the logits' range")).cast("double")
    return rows.select("row_id", "label", F.when((at < 0) | (at >= F.size("logits")), odd).otherwise(F.get("logits", at)).alias("logit"))


def fuse_scores(scores: DataFrame, logits: DataFrame) -> DataFrame:
    """score + logit by row and class; a row that the other lacks is an error."""
    both = scores.join(logits, ["row_id", "label"], "full_outer")
    odd = F.raise_error(F.lit("scores and logits differ in shape")).cast("double")
    return both.select("row_id", "label", F.when(F.col("score").isNull() | F.col("logit").isNull(), odd).otherwise(F.col("score") + F.col("logit")).alias("score"))


def argmax_label(scores: DataFrame) -> DataFrame:
    """(row_id, label): the best class, the lowest on ties."""
    return scores.groupBy("row_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "label"))["label"].alias("label"))


def accuracy(pred: DataFrame, truth: DataFrame) -> DataFrame:
    both = pred.join(truth.select("row_id", F.col("label").alias("truth")), "row_id")
    return both.agg(F.avg((F.col("label") == F.col("truth")).cast("double")).alias("accuracy"))


def with_rules(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    return samples.join(pairs.select("sample_id").distinct(), "sample_id", "left_semi")


def without_rules(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    return samples.join(pairs.select("sample_id").distinct(), "sample_id", "left_anti")
