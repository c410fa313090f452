"""Evaluation and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import stats
from riskweave.operators import evaluation, joins, learning
from riskweave.plans.adapters import CHECK_ORDER, Tables
from riskweave.plans.registry import query
from riskweave.plans.snippets import SNIPPETS



def verdicts(t: Tables):
    return evaluation.case_verdicts(t.cases, t.case_findings, t.rules)


def suffixes(t: Tables):
    return t.code.select(F.col("ext").alias("suffix"))


def confusion(t: Tables):
    able = evaluation.rules_for_category(t.cases, suffixes(t))
    return evaluation.confusion_by_category(verdicts(t), able)


@query("case_verdicts", "SELECT name, category, vulnerable, reported, verdict, rules FROM v_verdicts")
def case_verdicts(t: Tables):
    return verdicts(t).select("name", "category", "vulnerable", "reported", "verdict", F.array_join("rules", " ").alias("rules"))


@query("confusion_by_category", "SELECT * FROM v_confusion")
def confusion_by_category(t: Tables):
    return confusion(t)


@query("detector_rates", """SELECT category, round(recall, 9) AS recall, round(false_positive_rate, 9) AS false_positive_rate, round(precision, 9) AS precision, round(accuracy, 9) AS accuracy, round(f1, 9) AS f1, round(score, 9) AS score FROM v_rates""")
def detector_rates(t: Tables):
    rows = evaluation.detector_rates(confusion(t))
    names = ("recall", "false_positive_rate", "precision", "accuracy", "f1", "score")
    return rows.select("category", *[F.round(n, 9).alias(n) for n in names])


def wilson_sql(k: str, n: str, part: str) -> str:
    z = stats.Z_95
    p = f"({k}::DOUBLE / {n})"
    centre = f"(({p} + {z * z} / (2 * {n}::DOUBLE)) / (1 + {z * z} / {n}::DOUBLE))"
    margin = f"({z} * sqrt({p} * (1 - {p}) / {n}::DOUBLE + {z * z} / (4 * {n}::DOUBLE * {n})) / (1 + {z * z} / {n}::DOUBLE))"
    if part == "low":
        return f"CASE WHEN {n} = 0 THEN NULL WHEN {k} = 0 THEN 0 ELSE greatest(0, {centre} - {margin}) END"
    return f"CASE WHEN {n} = 0 THEN NULL WHEN {k} = {n} THEN 1 ELSE least(1, {centre} + {margin}) END"


COUNTED = "(SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS k, count(*) AS n FROM events GROUP BY 1)"


@query("wilson_interval", f"SELECT user_id, round({wilson_sql('k', 'n', 'low')}, 9) AS low, round({wilson_sql('k', 'n', 'high')}, 9) AS high FROM {COUNTED}")
def wilson_interval(t: Tables):
    rows = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("user_id", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


NEWCOMBE = f"""SELECT category, has_rule, recall - fpr - sqrt(pow(recall - rl, 2) + pow(fh - fpr, 2)) AS low, recall - fpr + sqrt(pow(rh - recall, 2) + pow(fpr - fl, 2)) AS high
 FROM (SELECT category, has_rule, recall, false_positive_rate AS fpr, {wilson_sql('tp', '(tp + fn)', 'low')} AS rl, {wilson_sql('tp', '(tp + fn)', 'high')} AS rh, {wilson_sql('fp', '(fp + tn)', 'low')} AS fl, {wilson_sql('fp', '(fp + tn)', 'high')} AS fh FROM v_rates)"""


@query("newcombe_interval", f"SELECT category, round(low, 9) AS low, round(high, 9) AS high FROM ({NEWCOMBE})")
def newcombe_interval(t: Tables):
    rows = evaluation.intervals(confusion(t))
    return rows.select("category", F.round("score_low", 9).alias("low"), F.round("score_high", 9).alias("high"))


@query("guessing_verdict", f"""SELECT category, CASE WHEN NOT has_rule THEN 'no rule' WHEN low IS NULL THEN '–' WHEN low > 0 THEN 'better than guessing' WHEN high < 0 THEN 'worse than guessing' ELSE 'not distinguishable from guessing' END AS reading FROM ({NEWCOMBE})""")
def guessing_verdict(t: Tables):
    rows = evaluation.intervals(confusion(t))
    return rows.select(
        "category", evaluation.guessing_verdict(F.col("has_rule"), F.col("score_low"), F.col("score_high")).alias("reading")
    )


POOL = """'{0}' AS scope, count(*) AS categories, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, sum(fn)::BIGINT AS fn, round(avg(recall), 9) AS recall, round(avg(score), 9) AS score FROM v_rates"""


@query("pooled_and_macro", f"SELECT {POOL.format('all categories')} UNION ALL SELECT {POOL.format('categories with a rule')} WHERE has_rule")
def pooled_and_macro(t: Tables):
    rows = evaluation.pooled_and_macro(confusion(t))
    return rows.select("scope", "categories", *evaluation.COUNTS, F.round("recall", 9).alias("recall"), F.round("score", 9).alias("score"))


@query("rules_for_category", """SELECT category, CASE category WHEN 'cmdi' THEN 'GO001 JS002 JV001 PH001 PY002 PY003 PY016' WHEN 'hash' THEN 'JS005 JV003 PY007' WHEN 'crypto' THEN 'JV004' ELSE '' END AS rules FROM (SELECT DISTINCT category FROM v_cases)""")
def rules_for_category(t: Tables):
    return evaluation.rules_for_category(t.cases, suffixes(t)).select("category", F.array_join("rules", " ").alias("rules"))


@query("unscored_findings", """SELECT 'in cases' AS place, f.rule_id, count(*) AS findings FROM v_case_findings f JOIN rules r USING (rule_id) JOIN v_cases c ON c.name = f.name WHERE r.category IS DISTINCT FROM c.category GROUP BY 2
 UNION ALL SELECT 'outside cases', NULL, count(*) FROM v_case_findings f WHERE NOT EXISTS (SELECT 1 FROM v_cases c WHERE c.name = f.name)""")
def unscored_findings(t: Tables):
    return evaluation.unscored_findings(t.cases, t.case_findings, t.rules)


def earlier(t: Tables):
    return t.cases.select("name", F.col("reported_before").alias("reported"))


@query("compare_runs", """SELECT count(*) AS cases, count(*) FILTER (WHERE reported_before = vulnerable AND reported <> vulnerable) AS broken, count(*) FILTER (WHERE reported_before <> vulnerable AND reported = vulnerable) AS fixed,
 count(*) FILTER (WHERE reported_before <> vulnerable AND reported = vulnerable) - count(*) FILTER (WHERE reported_before = vulnerable AND reported <> vulnerable) AS net, 0 AS missing FROM v_verdicts""")
def compare_runs(t: Tables):
    return evaluation.compare_runs(earlier(t), verdicts(t)).select("cases", "broken", "fixed", "net", "missing")


@query("mcnemar_exact", """WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS a, count(*) FILTER (WHERE event_type = 'click') AS b FROM events GROUP BY 1)
 SELECT user_id, round(CASE WHEN a + b = 0 THEN NULL ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2.0::DOUBLE))) FROM (SELECT unnest(range(0, least(a, b) + 1)) AS i))) END, 7) AS p FROM c""")
def mcnemar_exact(t: Tables):
    rows = t.events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("a"), F.count_if(F.col("event_type") == "click").alias("b")
    )
    return rows.select("user_id", F.round(stats.mcnemar_exact(F.col("a"), F.col("b")), 7).alias("p"))


@query("evaluation_guards", f"""SELECT 'no source file' AS problem, 'd' || l.doc_id AS subject FROM labels l JOIN v_code f ON f.doc_id = l.doc_id WHERE ext NOT IN ('.py','.js','.mjs','.ts','.jsx','.vue','.java','.kt','.scala','.php','.go','.cs')
 UNION ALL SELECT 'case file does not parse', path FROM labels l JOIN v_code f ON f.doc_id = l.doc_id WHERE t = {len(SNIPPETS) - 1}
 UNION ALL SELECT 'scan stopped at its limit', CAST(repository_id AS VARCHAR) FROM (SELECT repository_id, count(*) AS n FROM v_findings GROUP BY 1) WHERE n >= 9""")
def evaluation_guards(t: Tables):
    from riskweave.operators.python_facts import python_call_facts

    cases = t.read("labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))
    unparsable = python_call_facts(t.code).filter("fact = 'unparsable'").select("path")
    truncated = t.findings.groupBy("repository_id").agg((F.count("*") >= 9).alias("truncated"))
    return evaluation.evaluation_guards(cases, t.code, unparsable, truncated)


# --- learning --------------------------------------------------------------------------------


@query("label_examples", """SELECT p.id AS patch_id, p.finding_id, p.check_status = 'PASSED' AS passed, f.rule_id, p.lines_added, p.last_line - p.first_line + 1 AS region_lines, length(p.diff) AS diff_characters,
 regexp_extract(f.file_path, '(\\.[a-z]+)$', 1) AS suffix FROM v_checked p JOIN v_findings f ON f.id = p.finding_id WHERE p.status = 'PROPOSED' AND p.check_status IN ('PASSED','REJECTED')""")
def label_examples(t: Tables):
    checked = joins.patch_with_latest_check(t.patches, t.validations, CHECK_ORDER)
    return learning.label_examples(checked, t.findings).select(
        "patch_id", "finding_id", "passed", "rule_id", "lines_added", "region_lines", "diff_characters", "suffix"
    )


@query("vectorise", """SELECT patch_id, round((x - avg(x) OVER ()) / coalesce(nullif(stddev_pop(x) OVER (), 0), 1), 6) AS diff_size, CASE WHEN rule_n >= 3 THEN rule_id ELSE 'other' END AS rule
 FROM (SELECT patch_id, rule_id, ln(1 + diff_characters::DOUBLE) AS x, count(*) OVER (PARTITION BY rule_id) AS rule_n FROM v_examples)""")
def vectorise(t: Tables):
    rows = learning.vectorise(t.examples).groupBy("patch_id").agg(
        F.round(F.coalesce(F.max(F.when(F.col("feature") == "size of the diff", F.col("value"))), F.lit(0.0)), 6).alias("diff_size"),
        F.max(F.when(F.col("feature").startswith("rule = "), F.expr("substring(feature, 8)"))).alias("rule"),
    )
    return rows


#: Features of an example as rows (e: repeat, fold, patch_id, passed, feature, value) over training sets ``tr``.
FEATURES = """nm AS (SELECT repeat, fold, patch_id, passed, unnest([{'f': 'lines added', 'x': ln(1 + lines_added::DOUBLE)}, {'f': 'lines removed', 'x': ln(1 + lines_removed::DOUBLE)},
 {'f': 'lines the model could change', 'x': ln(1 + region_lines::DOUBLE)}, {'f': 'size of the diff', 'x': ln(1 + diff_characters::DOUBLE)}, {'f': 'length of the rationale', 'x': ln(1 + rationale_characters::DOUBLE)},
 {'f': 'line-number gutters stripped', 'x': ln(1 + gutters_stripped::DOUBLE)}, {'f': 'generation attempts', 'x': attempts::DOUBLE}, {'f': 'knowledge passages used', 'x': passages::DOUBLE},
 {'f': 'prompt tokens', 'x': ln(1 + prompt_tokens::DOUBLE)}, {'f': 'completion tokens', 'x': ln(1 + completion_tokens::DOUBLE)}, {'f': 'generation time', 'x': ln(1 + duration_ms::DOUBLE)}, {'f': 'temperature', 'x': temperature::DOUBLE}]) AS u FROM tr),
 sc AS (SELECT repeat, fold, u.f AS f, coalesce(avg(u.x), 0) AS m, coalesce(nullif(stddev_pop(u.x), 0), 1) AS s FROM nm GROUP BY ALL),
 ct AS (SELECT repeat, fold, patch_id, passed, unnest([{'f': 'rule', 'x': rule_id}, {'f': 'severity', 'x': severity}, {'f': 'confidence', 'x': confidence}, {'f': 'file type', 'x': suffix}]) AS u FROM tr),
 cv AS (SELECT *, count(*) OVER (PARTITION BY repeat, fold, u.f, u.x) AS c FROM ct),
 fx AS (SELECT repeat, fold, passed, u.f AS feature, (u.x - m) / s AS value FROM nm JOIN sc USING (repeat, fold) WHERE sc.f = u.f AND u.x IS NOT NULL
 UNION ALL SELECT repeat, fold, passed, u.f || ': not recorded', (u.x IS NULL)::INT FROM nm
 UNION ALL SELECT repeat, fold, passed, unnest(['code fences stripped', 're-indented', 'had an explanation']), unnest([fences_stripped::INT, reindented::INT, had_explanation::INT]) FROM tr
 UNION ALL SELECT repeat, fold, passed, u.f || ' = ' || CASE WHEN c >= 3 AND u.x IS NOT NULL THEN u.x ELSE 'other' END, 1 FROM cv
 UNION ALL SELECT repeat, fold, passed, unnest(['rule = other', 'severity = other', 'confidence = other', 'file type = other']), 0 FROM tr
 UNION ALL SELECT repeat, fold, passed, 'bias', 1 FROM tr),
 mo AS (SELECT repeat, fold, feature, round(sum(CASE WHEN passed THEN value ELSE 0 END), 3) + 0.0 AS expected FROM fx GROUP BY ALL)"""
OPTIMUM = f"WITH tr AS (SELECT *, 0 AS repeat, -1 AS fold FROM v_examples), {FEATURES} SELECT feature, expected FROM mo"


@query("logistic_fit", OPTIMUM)
def logistic_fit(t: Tables):
    model = learning.train(t.examples)
    rows = learning.optimum(t.examples, model)
    return rows.select("feature", (F.round("expected", 3) + 0.0).alias("expected"))


@query("top_weights")
def top_weights(t: Tables):
    return learning.top_weights(learning.weights_table(t.spark, learning.train(t.examples)))


#: Probabilities of the rows of a saved model, summed feature by feature; equal only at the optimum.
@query("save_model_file", f"""WITH tr AS (SELECT *, 0 AS repeat, -1 AS fold FROM v_examples), {FEATURES} SELECT 'bias' AS feature, expected FROM mo WHERE feature = 'bias' UNION ALL
 SELECT 'penalised ' || feature, expected FROM mo WHERE feature <> 'bias'""")
def save_model_file(t: Tables):
    from riskweave.plans.q_sources import scratch

    model = learning.train(t.examples)
    digest = evaluation.outcomes_hash(
        t.examples.select(F.col("patch_id").cast("string").alias("name"), F.col("passed").alias("reported"))
    ).first()["outcomes_sha256"]
    path = scratch(t, "model")
    learning.save_model(t.spark, path, model, digest)
    learned, weights, bias = learning.load_model(t.spark, path)
    rows = learning.predict(t.examples, learned, weights, bias)
    # From the file alone: its own feature columns, weights and probabilities.
    sums = [
        (n, F.sum(F.col("probability") * c) + learning.L2 * w) for (n, c), w in zip(learned.features().items(), weights, strict=True)
    ]
    named = [F.struct(F.lit("bias").alias("feature"), F.sum("probability").alias("expected"))]
    named += [F.struct(F.lit(f"penalised {n}").alias("feature"), s.alias("expected")) for n, s in sums]
    out = rows.agg(F.array(*named).alias("all")).select(F.explode("all").alias("x"))
    return out.select("x.feature", (F.round("x.expected", 3) + 0.0).alias("expected"))


@query("grouped_folds", """SELECT patch_id, CAST((turn - 1) % 5 AS INTEGER) AS fold FROM v_examples JOIN (SELECT finding_id, row_number() OVER (ORDER BY mp DESC, code) AS turn FROM (SELECT finding_id, (count(*) FILTER (WHERE passed)) * 2 >= count(*) AS mp, sha256('16:' || finding_id) AS code FROM v_examples GROUP BY 1)) USING (finding_id)""")
def grouped_folds(t: Tables):
    return learning.grouped_folds(t.examples).select("patch_id", "fold")


#: Folds of ten repeats, training sets, and the two baselines.
REPEATED = """gr AS (SELECT finding_id, (count(*) FILTER (WHERE passed)) * 2 >= count(*) AS mp FROM v_examples GROUP BY 1),
 dl AS (SELECT finding_id, r AS repeat, CAST((row_number() OVER (PARTITION BY r ORDER BY mp DESC, sha256((16 + r) || ':' || finding_id)) - 1) % 5 AS INTEGER) AS fold FROM gr, (SELECT unnest(range(10))::INTEGER AS r)),
 hd AS (SELECT e.*, dl.repeat, dl.fold FROM v_examples e JOIN dl USING (finding_id)),
 tr AS (SELECT e.* EXCLUDE (fold), k.fold FROM hd e, (SELECT unnest(range(5))::INTEGER AS fold) k WHERE k.fold <> e.fold)"""


@query("cross_validate", f"""WITH {REPEATED}, {FEATURES},
 br AS (SELECT repeat, fold, (count(*) FILTER (WHERE passed))::DOUBLE / count(*) AS base FROM tr GROUP BY ALL),
 rr AS (SELECT repeat, fold, rule_id, ((count(*) FILTER (WHERE passed)) + 1)::DOUBLE / (count(*) + 2) AS rate FROM tr GROUP BY ALL)
 SELECT repeat, fold, 'optimum' AS kind, feature AS name, expected AS value FROM mo
 UNION ALL SELECT repeat, fold, 'pass rate of the rule', patch_id::VARCHAR, round(coalesce(rate, base), 9) FROM hd JOIN br USING (repeat, fold) LEFT JOIN rr USING (repeat, fold, rule_id)
 UNION ALL SELECT repeat, fold, 'commoner outcome', patch_id::VARCHAR, round(base, 9) FROM hd JOIN br USING (repeat, fold)
 UNION ALL SELECT repeat, fold, 'model', patch_id::VARCHAR, 1 FROM hd""")
def cross_validate(t: Tables):
    """All 50 models at their optimum, the baselines, and that the model says something of every held-out example."""
    rows, models = learning.fitted_folds(t.examples)
    said = learning.held_out_predictions(rows, models)
    value = F.when(F.col("predictor") == learning.MODEL, F.col("probability").between(0.0, 1.0).cast("double")).otherwise(F.round("probability", 9))
    said = said.select("repeat", "fold", F.col("predictor").alias("kind"), F.col("patch_id").cast("string").alias("name"), value.alias("value"))
    best = learning.fold_optima(rows, models).select(
        "repeat", "fold", F.lit("optimum").alias("kind"), F.col("feature").alias("name"), (F.round("expected", 3) + 0.0).alias("value")
    )
    return best.unionByName(said)


@query("cross_validate_predictions")
def cross_validate_predictions(t: Tables):
    return learning.cross_validate(t.examples)


@query("rate_by_rule_baseline", """SELECT e.patch_id, round(coalesce(r.rate, b.base), 9) AS rule_rate FROM v_examples e LEFT JOIN (SELECT rule_id, (count(*) FILTER (WHERE passed) + 1)::DOUBLE / (count(*) + 2) AS rate FROM v_examples WHERE n % 5 <> 0 GROUP BY 1) r USING (rule_id)
 CROSS JOIN (SELECT (count(*) FILTER (WHERE passed))::DOUBLE / count(*) AS base FROM v_examples WHERE n % 5 <> 0) b WHERE e.n % 5 = 0""")
def rate_by_rule_baseline(t: Tables):
    training, testing = t.examples.filter("patch_id % 5 <> 0"), t.examples.filter("patch_id % 5 = 0")
    return learning.rate_by_rule(training, testing).select("patch_id", F.round("rule_rate", 9).alias("rule_rate"))


RANKED = """SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY predictor, fold, probability) - 1) / 2.0::DOUBLE AS r FROM v_predictions WINDOW w AS (PARTITION BY predictor, fold ORDER BY probability)"""


@query("auc_ranks", f"SELECT DISTINCT predictor, fold, probability, r AS average_rank FROM ({RANKED})")
def auc_ranks(t: Tables):
    return learning.auc_ranks(t.predictions, ["predictor", "fold"]).select("predictor", "fold", "probability", "average_rank")


@query("roc_auc", f"""SELECT predictor, fold, round((sum(r) FILTER (WHERE passed) - p * (p + 1) / 2) / nullif(p * n, 0), 9) AS auc FROM (SELECT *, (count(*) FILTER (WHERE passed) OVER g)::DOUBLE AS p, (count(*) FILTER (WHERE NOT passed) OVER g)::DOUBLE AS n
 FROM ({RANKED}) WINDOW g AS (PARTITION BY predictor, fold)) GROUP BY predictor, fold, p, n""")
def roc_auc(t: Tables):
    return learning.roc_auc(t.predictions, ["predictor", "fold"]).select("predictor", "fold", F.round("auc", 9).alias("auc"))


@query("brier_and_confusion", """SELECT predictor, count(*) FILTER (WHERE probability >= 0.5 AND passed) AS tp, count(*) FILTER (WHERE probability >= 0.5 AND NOT passed) AS fp, count(*) FILTER (WHERE probability < 0.5 AND NOT passed) AS tn,
 count(*) FILTER (WHERE probability < 0.5 AND passed) AS fn, round(avg(pow(probability - passed::INT, 2)), 9) AS brier FROM v_predictions GROUP BY 1""")
def brier_and_confusion(t: Tables):
    rows = learning.brier_and_confusion(t.predictions, ["predictor"])
    return rows.select("predictor", "tp", "fp", "tn", "fn", F.round("brier", 9).alias("brier"))


@query("enough_data_guard", """SELECT examples, passed, rejected, nullif(concat_ws(', and ', CASE WHEN examples < 60 THEN (60 - examples) || ' more judged fixes' END, CASE WHEN passed < 15 THEN (15 - passed) || ' more that passed' END, CASE WHEN rejected < 15 THEN (15 - rejected) || ' more that were rejected' END), '') AS missing
 FROM (SELECT count(*) AS examples, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS rejected FROM v_examples)""")
def enough_data_guard(t: Tables):
    return learning.enough_data(t.examples)


AUCS = f"""SELECT predictor, avg(auc) AS auc FROM (SELECT predictor, fold, (sum(r) FILTER (WHERE passed) - p * (p + 1) / 2) / nullif(p * n, 0) AS auc FROM (SELECT *, (count(*) FILTER (WHERE passed) OVER g)::DOUBLE AS p, (count(*) FILTER (WHERE NOT passed) OVER g)::DOUBLE AS n
 FROM ({RANKED}) WINDOW g AS (PARTITION BY predictor, fold)) GROUP BY predictor, fold, p, n) GROUP BY 1"""


@query("model_verdict", f"""WITH x AS ({AUCS}), w AS (SELECT count(*) FILTER (WHERE m AND NOT r) AS model_only, count(*) FILTER (WHERE r AND NOT m) AS baseline_only FROM (SELECT patch_id, bool_or((probability >= 0.5) = passed) FILTER (WHERE predictor = 'model') AS m,
 bool_or((probability >= 0.5) = passed) FILTER (WHERE predictor <> 'model') AS r FROM v_predictions GROUP BY 1))
 SELECT model_only, baseline_only, round((SELECT auc FROM x WHERE predictor = 'model'), 9) AS model_mean, round((SELECT auc FROM x WHERE predictor <> 'model'), 9) AS rule_mean,
 CASE WHEN (SELECT auc FROM x WHERE predictor = 'model') <= (SELECT auc FROM x WHERE predictor <> 'model') + 0.02 THEN 'no better'
 WHEN model_only > baseline_only AND 2 * (SELECT sum(exp(lgamma(model_only + baseline_only + 1) - lgamma(i + 1) - lgamma(model_only + baseline_only - i + 1) - (model_only + baseline_only) * ln(2.0::DOUBLE))) FROM (SELECT unnest(range(0, baseline_only + 1)) AS i)) < 0.05 THEN 'better' ELSE 'unclear' END AS verdict FROM w""")
def model_verdict(t: Tables):
    rows = learning.model_comparison(t.predictions).withColumn("verdict", learning.model_verdict())
    return rows.select(
        "model_only", "baseline_only", F.round("model_mean", 9).alias("model_mean"), F.round("rule_mean", 9).alias("rule_mean"), "verdict"
    )


