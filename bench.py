"""Headline timings. Prints one JSON line; input from $BENCH_SF_DIR, cores from $BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from gramlaw.operators import select  # noqa: E402
from gramlaw.operators.algebra import split_views, whole_view  # noqa: E402
from gramlaw.operators.catalog import build_bank  # noqa: E402
from gramlaw.operators.distill import action_templates, best_regime, mine, mining_stats, with_template  # noqa: E402
from gramlaw.operators.gram import Design, gram, profile_inputs  # noqa: E402
from gramlaw.operators.medians import training_medians  # noqa: E402
from gramlaw.operators.splits import exact_folds, hashed_folds  # noqa: E402
from gramlaw.operators.telemetry import REGIMES  # noqa: E402
from gramlaw.plans.law import Law, score_array  # noqa: E402
from gramlaw.plans.options import Options  # noqa: E402
from gramlaw.plans.search import count_bags, leaf_table, round_draws, search  # noqa: E402
from gramlaw.queries.common import LINE_FEATURES, LINE_KEY, ORDER_FEATURES, labelled, line, orders  # noqa: E402
from gramlaw.session import prepare  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gramlaw-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "10g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        out = run()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    sink = lambda df: df.write.format("noop").mode("overwrite").save()

    design = Design(hashed_folds(line(spark, sf_dir), LINE_KEY, 5, 42, "fold"), LINE_FEATURES, ["y"], leaf="fold")
    rows = timed("warm_up_scan", lambda: design.df.count())
    prof = timed("stats_pass", lambda: profile_inputs(design))
    opt = Options()
    bank = build_bank(prof.corr(4), 42, 26, 24)
    for p in (100, 400, 800):
        timed(f"gram_pass_p{p}", lambda: gram(design, bank[:p], prof))
    cands = build_bank(prof.corr(4), 42)
    names = [c.name for c in cands]
    gt, sums = timed("gram_pass_folds_and_bags", lambda: leaf_table(design, cands, prof, opt, LINE_KEY, True))
    views = {(k, 0): v for k, v in split_views(gt)}
    sets = timed("greedy_selection_5_folds", lambda: {k: select.operator_set(v, names, opt) for k, v in views.items()})
    timed("forward_atoms_5_folds", lambda: [select.forward_atoms(v, opt) for v in views.values()])
    timed("bagging_5x8", lambda: count_bags(sums, views, 1, sets, opt, gt))
    og = select.operator_set(whole_view(gt), names, opt)
    law = Law(og.intercept, tuple((o.coeff, cands[o.idx]) for o in og.ops), tuple(LINE_FEATURES))
    timed("law_scoring_expression", lambda: sink(law.score(design.df).select("yhat")))
    timed("law_scoring_arrow", lambda: sink(design.df.select(score_array([law])[0].alias("yhat"))))
    draws = [q.relu for q in round_draws(42, 4, 12)]
    timed("medians_12_directions_5_folds", lambda: training_medians(design, draws, [0, 1, 2, 3, 4], False))
    timed("exact_folds", lambda: sink(exact_folds(orders(spark, sf_dir), "id", 5).select("id", "fold")))
    light = Options(n_proj=8, n_pairs=8, max_grammar=0, refine=False)
    timed("cross_validated_search_orders", lambda: search(orders(spark, sf_dir), ORDER_FEATURES, "y", "id", light, variance="variance"))
    lab = labelled(spark, sf_dir)
    timed("telemetry_labelling", lambda: sink(lab))
    hot = F.col("pred_temp") * 0.02
    scored = lab.withColumn("pred_regime", best_regime([0.9 - hot * 0.4, 0.5 - hot * 0.2, hot - 0.9, F.col("queue_ratio") * 0.25, hot * 1.25 - 1.2], REGIMES))
    timed("templates_and_mining", lambda: mining_stats(mine(with_template(scored, action_templates(scored)))).collect())

    total = round(sum(v for k, v in times.items() if k != "warm_up_scan"), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    work = {f"rows_p2_per_sec_p{p}": round(rows * p * p / times[f"gram_pass_p{p}"]) for p in (100, 400, 800)}
    work["scored_rows_per_sec"] = round(rows / times["law_scoring_expression"])
    print(json.dumps({"metric": "law_discovery_total", "value": total, "unit": "sec", "queries": times, "sf": sf, "rows": rows, "cpus": int(cpus), "throughput": work}))
    spark.stop()


if __name__ == "__main__":
    main()
