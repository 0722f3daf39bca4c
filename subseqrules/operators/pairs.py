"""Matching motif classes in pairs: candidates, sampled linear fits, their evaluation and choice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MiningConfig
from ..functions import kernels as K
from ..functions import mining as M
from ..functions import shapes as X
from ..schemas import PAIRS
from ..session import durable

SIDE_KEYS = ["series_id", "lhs", "rhs"]


def motif_pair_candidates(occ: DataFrame, supp: float, rhs_attrs: list[int] | None = None) -> DataFrame:
    """(series_id, lhs, rhs, n_lhs, n_rhs): ordered pairs of different classes with size(lhs) > 2 and size(rhs) / size(lhs) >= supp."""
    n = occ.groupBy("series_id", "attr_id", "class_id").agg(F.count("*").alias("n"))
    side = F.struct("attr_id", "class_id")
    left = n.select("series_id", side.alias("lhs"), F.col("n").alias("n_lhs")).where("n_lhs > 2")
    right = n.select("series_id", side.alias("rhs"), F.col("n").alias("n_rhs"))
    if rhs_attrs is not None:
        right = right.where(F.col("rhs.attr_id").isin(rhs_attrs))
    return left.join(right, "series_id").where((F.col("lhs") != F.col("rhs")) & (F.col("n_rhs") / F.col("n_lhs") >= supp))


def occurrence_arrays(occ: DataFrame) -> DataFrame:
    """(series_id, side, occ): the occurrences of each class in order of occ_id."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("occ_id", "t1", "delta", "lam"))), lambda x: F.array(x["t1"].cast("double"), x["delta"].cast("double"), x["lam"]))
    return occ.groupBy("series_id", "attr_id", "class_id").agg(items.alias("occ")).select("series_id", F.struct("attr_id", "class_id").alias("side"), "occ")


def reject_by_budget(pairs: DataFrame, budget: float) -> DataFrame:
    return pairs.where(F.col("min_eps_rate") <= budget)


def match_upper_bound(matches: DataFrame, keys: list[str], positions: list[str]) -> DataFrame:
    """(keys, bound): least over the positions of how many different occurrences take part."""
    counts = [F.countDistinct(p) for p in positions]
    return matches.groupBy(*keys).agg((F.least(*counts) if len(counts) > 1 else counts[0]).alias("bound"))


def support(score: Column, combos: Column) -> Column:
    return F.when(combos > 0, score / combos).otherwise(0.0)


def eps_rate_stats(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Largest error / amplitude and its quantiles."""
    rate = F.col("err") / F.col("amplitude")
    return matches.groupBy(*keys).agg(F.max(rate).alias("max_rate"), F.percentile(rate, F.array(*[F.lit(q) for q in (0.9, 0.8, 0.7, 0.6, 0.5)])).alias("rates"))


def rule_error_totals(pred: DataFrame, keys: list[str], need: Column, supp: Column, least: float) -> DataFrame:
    """epsilon and length-weighted mean error; NULL where there are too few predictions or too little support."""
    ok = (F.count("*") >= F.max(need)) & (F.max(supp) >= least)
    return pred.groupBy(*keys).agg(F.when(ok, F.max("max_err")).alias("epsilon"), F.when(ok, F.sum(F.col("mean_err") * F.col("len")) / F.sum("len")).alias("avg_err"))


def best_hypothesis(hyps: DataFrame, keys: list[str]) -> DataFrame:
    """Most chained matches; then the least rate, epsilon, mean error and the first hypothesis."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("min_eps_rate"), F.asc_nulls_last("epsilon"), F.asc_nulls_last("avg_err"), "hyp_id")
    return hyps.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ordered_chain(rows: DataFrame, keys: list[str], positions: list[str], order: str, weight: str | None = None) -> DataFrame:
    """The heaviest chain of rows strictly rising in every position, for each key; rows of a key are taken in `order`. Keys come to a task
    one after the other in batches, so that many small ones cost no call each."""

    def chains(pdf: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
        w = pdf[weight].to_numpy(float) if weight else np.ones(len(pdf))
        at = pdf[positions].to_numpy()
        return pdf.iloc[[a + i for a, b in zip(starts, [*starts[1:], len(pdf)]) for i in K.heaviest_chain(at[a:b], w[a:b])]]

    def run(batches):
        held = []  # what has come of a key that may go on
        for pdf in batches:
            if not len(pdf):
                continue
            own = pd.concat([held[-1][keys].tail(1), pdf[keys]]) if held else pdf[keys]
            last = own.shift()
            new = ~((own == last) | (own.isna() & last.isna())).all(axis=1).to_numpy()
            new = new[1:] if held else np.append(True, new[1:])
            starts = np.flatnonzero(new).tolist()
            if starts:
                if starts[0]:
                    held.append(pdf.iloc[: starts[0]])
                if held:
                    yield chains(pd.concat(held, ignore_index=True), [0])
                if len(starts) > 1:
                    yield chains(pdf.iloc[starts[0] : starts[-1]], [x - starts[0] for x in starts[:-1]])
                held = [pdf.iloc[starts[-1] :]]
            else:
                held.append(pdf)
        if held:
            yield chains(pd.concat(held, ignore_index=True), [0])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(n, *keys).sortWithinPartitions(*keys, *[F.asc_nulls_last(c) for c in (order, *positions)])
    return placed.mapInPandas(run, rows.schema)


def multi_output_lstsq(rows: DataFrame, keys: list[str], features: list[str], targets: list[str]) -> DataFrame:
    """(keys, coef): for each target its intercept and the weights of the features, of minimum norm. Means and centred products are
    added up in Spark, so no group of rows is in one task; a key's own small system is solved at the end. Rows with a null among
    the columns named are left out."""
    rows = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in [*features, *targets]]).dropna(subset=[*features, *targets])
    n, both = len(features), [*features, *targets]
    means = F.array(*[F.avg(c) for c in both]).alias("means")
    cross = F.array(*[F.covar_pop(f, c) for f in features for c in both]).alias("cross")  # merged as deviations from means
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            coef = [K.from_moments(np.array(m), np.array(c).reshape(n, -1)).T.tolist() for m, c in zip(pdf["means"], pdf["cross"])]
            yield pdf[keys].assign(coef=coef)

    return rows.groupBy(*keys).agg(means, cross).mapInPandas(run, f"{kinds}, coef array<array<double>>")


def poly_fit(rows: DataFrame, keys: list[str], degree: int = 3, y: str = "y", x: str = "x") -> DataFrame:
    """(keys, coef): least squares of y on the powers of x, lowest first."""
    powers = [F.pow(F.col(x).cast("double"), F.lit(k)).alias(f"_x{k}") for k in range(1, degree + 1)]
    own = rows.select(*keys, *powers, F.col(y).alias("_y"))
    fit = multi_output_lstsq(own, keys, [f"_x{k}" for k in range(1, degree + 1)], ["_y"])
    return fit.withColumn("coef", F.get("coef", F.lit(0)))


def start_col_fit(rows: DataFrame) -> DataFrame:
    """(pos, slope, intercept): each other side's start on the first side's."""
    return X.linear_fit(rows, ["pos"], y="start", x="first_start")


def with_sides(todo: DataFrame, occ: DataFrame, classes: DataFrame, packed: DataFrame) -> DataFrame:
    """todo (series_id, lhs array of sides, rhs) with the occurrence arrays, the right shape and the right series."""
    arrays = occurrence_arrays(occ)
    left = todo.select("series_id", "lhs", "rhs", F.posexplode("lhs").alias("pos", "side")).join(arrays, ["series_id", "side"])
    left = left.groupBy("series_id", "lhs", "rhs").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "occ"))), lambda x: x["occ"]).alias("lhs_occ"))
    right = arrays.select("series_id", F.col("side").alias("rhs"), F.col("occ").alias("rhs_occ"))
    shape = classes.select("series_id", F.struct("attr_id", "class_id").alias("rhs"), "breaks", "slopes", "intercepts")
    vals = packed.select(F.col("series_id").alias("_sid"), F.col("attr_id").alias("_attr"), "vals")
    out = todo.join(left, ["series_id", "lhs", "rhs"]).join(right, ["series_id", "rhs"]).join(shape, ["series_id", "rhs"])
    return out.join(vals, (F.col("series_id") == F.col("_sid")) & (F.col("rhs.attr_id") == F.col("_attr"))).drop("_sid", "_attr")


HYPS = PAIRS.replace("lhs struct<attr_id: int, class_id: int>", "lhs array<struct<attr_id: int, class_id: int>>") + ", score int, combos int, hyp_id long"


def evaluate_hypotheses(rows: DataFrame, cfg: MiningConfig, *, batch: int = 64, fall_back: bool = False) -> DataFrame:
    """rows of with_sides with `wave` (hypothesis batch number) and `floor` (a score found already, below which nothing counts): the best
    hypothesis of each batch. Each is drawn with a seed of its own; a batch is fitted, predicted and compared as arrays."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                data = M.PairData([np.array([list(x) for x in o]) for o in r.lhs_occ], np.array([list(x) for x in r.rhs_occ]), np.asarray(r.vals, float), (r.breaks, r.slopes, r.intercepts))
                sides = [x for s in [*r.lhs, r.rhs] for x in (s["attr_id"], s["class_id"])]
                draws = {}
                for hyp in range(int(r.wave) * batch, (int(r.wave) + 1) * batch):
                    if (got := M.draw(data, np.random.default_rng([cfg.seed, hyp, *sides]))) is None:
                        break
                    draws[hyp] = got
                best = M.best_of_draws(data, draws, epsilon_rate=cfg.epsilon_rate, rate=cfg.window_rate, kind=cfg.error_kind, floor=int(r.floor), fall_back=fall_back)
                if best is None:
                    continue
                (hyp, coef, e), null = best, lambda x: None if not np.isfinite(x) else float(x)
                out.append({
                    "series_id": r.series_id, "lhs": r.lhs, "rhs": r.rhs, "c_phi": e["score"], "supp": e["supp"] if len(data.lhs) > 1 else e["score"] / len(data.lhs[0]),
                    "coef_t1": coef[:, 0].tolist(), "coef_delta": coef[:, 1].tolist(), "coef_lam": coef[:, 2].tolist(), "avg_err": null(e["avg_err"]), "epsilon": null(e["epsilon"]),
                    "min_eps_rate": null(e["eps_rate"]), "matches": [{"lhs_occ": m[:-1].tolist(), "rhs_occ": int(m[-1])} for m in e["matches"]],
                    "score": e["score"], "combos": e["combos"], "hyp_id": hyp})
            yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in _fields(HYPS)])

    return rows.mapInPandas(run, HYPS)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a schema text."""
    out, depth, word = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return [*out, word.strip()]


def match_pairs(todo: DataFrame, occ: DataFrame, classes: DataFrame, packed: DataFrame, cfg: MiningConfig, *, batch: int = 64, fall_back: bool = False) -> DataFrame:
    """Sampled fits for each (series_id, lhs, rhs), in waves of hypothesis batches; between waves, pairs that have had the draws
    their best score asks for are done. The seeds go by pair and hypothesis, so results don't depend on partitions."""
    sides = durable(with_sides(todo, occ, classes, packed), "pair-sides")
    n = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    open_, best, done, size = sides.select("series_id", "lhs", "rhs"), None, 0, max(1, 500 // batch)
    while done * batch < cfg.max_iter:
        waves = min(size, -(-cfg.max_iter // batch) - done)
        known = open_.withColumn("floor", F.lit(0)) if best is None else open_.join(best.select("series_id", "lhs", "rhs", F.col("score").alias("floor")), ["series_id", "lhs", "rhs"], "left").fillna(0, ["floor"])
        rows = sides.join(known, ["series_id", "lhs", "rhs"]).withColumn("wave", F.explode(F.sequence(F.lit(done), F.lit(done + waves - 1))))
        got = evaluate_hypotheses(rows.repartition(n, "series_id", "lhs", "rhs", "wave"), cfg, batch=batch, fall_back=fall_back)
        best = durable(best_hypothesis(got if best is None else best.unionByName(got), ["series_id", "lhs", "rhs"]), "best-pairs")
        done += waves
        m = sides.select("series_id", "lhs", "rhs", F.size(F.get("lhs_occ", F.lit(0))).alias("m1"), F.size("rhs_occ").alias("m2"))
        need = best.join(m, ["series_id", "lhs", "rhs"]).withColumn("turns", X.max_turns(cfg.confidence, 2, F.col("score"), F.col("m1"), F.col("m2"), cfg.max_iter))
        open_ = durable(sides.select("series_id", "lhs", "rhs").join(need.where(F.col("turns") <= done * batch).select("series_id", "lhs", "rhs"), ["series_id", "lhs", "rhs"], "left_anti"), "open-pairs")
        size *= 2
        if open_.isEmpty():
            break
    return best


def match_all_pairs(occ: DataFrame, classes: DataFrame, packed: DataFrame, cfg: MiningConfig, rhs_attrs: list[int] | None = None, budget: float | None = None, **how) -> DataFrame:
    """motif_pairs of all candidates."""
    todo = motif_pair_candidates(occ, cfg.supp, rhs_attrs).select("series_id", F.array("lhs").alias("lhs"), "rhs")
    out = match_pairs(todo, occ, classes, packed, cfg, **how)
    out = out if budget is None else reject_by_budget(out, budget)
    return out.withColumn("lhs", F.get("lhs", F.lit(0))).drop("score", "combos", "hyp_id")
