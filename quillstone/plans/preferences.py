"""Preference, reward and rollout-group queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import maths
from quillstone.operators import aggregates as A
from quillstone.operators import pairs, windows
from quillstone.plans import views as V

CATALOGUE: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


_DELTA = f"WITH {V.PREFERENCES}, d AS (SELECT *, 0.1::DOUBLE * ((chosen_logp - rejected_logp) - (ref_chosen_logp - ref_rejected_logp)) AS delta FROM preferences)"


def deltas(spark, sf_dir):
    p = V.preferences(spark, sf_dir)
    return p.withColumn("delta", maths.preference_delta(0.1, *[F.col(c) for c in ("chosen_logp", "rejected_logp", "ref_chosen_logp", "ref_rejected_logp")]))


@query(_DELTA + " SELECT round(avg(CASE WHEN delta >= 0 THEN ln(1 + exp(-delta)) ELSE -delta + ln(1 + exp(delta)) END), 9) AS loss FROM d")
def dpo_loss(spark, sf_dir):
    return A.dpo_loss(deltas(spark, sf_dir), "delta").select(F.round("loss", 9).alias("loss"))


@query(f"WITH {V.PREFERENCES} SELECT count(*) AS pairs, count(*) FILTER (m > 0) AS positive, count(*) FILTER (m = 0) AS ties, round((count(*) FILTER (m > 0) + 0.5 * count(*) FILTER (m = 0))::DOUBLE / count(*), 9) AS accuracy FROM (SELECT ((pair_id * 7919) % 1000 - (pair_id * 104729) % 1000) AS m FROM preferences)")
def preference_accuracy(spark, sf_dir):
    m = V.preferences(spark, sf_dir).withColumn("m", (F.col("pair_id") * 7919) % 1000 - (F.col("pair_id") * 104729) % 1000)
    return A.preference_accuracy(m, "m").withColumn("accuracy", F.round("accuracy", 9))


@query(f"""WITH {V.PREFERENCES} SELECT b AS bucket, count(pair_id) AS pairs, round(coalesce(avg((chosen_logp > rejected_logp)::INT), 0), 9) AS raw_policy_accuracy FROM (VALUES ('shorter_rejected'), ('equal_length'), ('longer_rejected')) t(b)
  LEFT JOIN preferences ON b = CASE WHEN char_length_delta < 0 THEN 'shorter_rejected' WHEN char_length_delta = 0 THEN 'equal_length' ELSE 'longer_rejected' END GROUP BY b""")
def length_buckets(spark, sf_dir):
    return A.length_buckets(V.preferences(spark, sf_dir), spark).withColumn("raw_policy_accuracy", F.round("raw_policy_accuracy", 9))


@query(f"WITH {V.PREFERENCES} SELECT round(avg(greatest(-1, least(1, 1 - reward - 0.5 * (pair_id % 3 = 0)::INT - 0.5 * (pair_id % 5 = 0)::INT))), 9) AS reward FROM preferences")
def reward_mean(spark, sf_dir):
    r = maths.reward(F.col("reward"), F.col("pair_id") % 3 == 0, F.col("pair_id") % 5 == 0)
    return V.preferences(spark, sf_dir).agg(F.round(F.avg(r), 9).alias("reward"))


@query(f"WITH {V.PREFERENCES} SELECT pair_id, min(reward) OVER g = max(reward) OVER g AS zero_advantage, round(CASE WHEN min(reward) OVER g = max(reward) OVER g THEN 0 ELSE reward - avg(reward) OVER g END, 9) AS advantage FROM preferences WINDOW g AS (PARTITION BY group_id)")
def group_advantage(spark, sf_dir):
    out = A.group_advantages(V.preferences(spark, sf_dir), "group_id")
    return out.select("pair_id", "zero_advantage", F.round("advantage", 9).alias("advantage"))


@query(f"""WITH {V.PREFERENCES}, x AS (SELECT group_id, CASE WHEN error IS NOT NULL THEN 'error' WHEN stop_reason <> 'eos' THEN 'stop_' || stop_reason END AS why FROM preferences)
SELECT group_id, bool_and(why IS NULL) AS valid, coalesce(list_sort(list(DISTINCT why) FILTER (why IS NOT NULL)), []::VARCHAR[]) AS reasons FROM x GROUP BY group_id""")
def group_validity(spark, sf_dir):
    return A.group_validity(V.preferences(spark, sf_dir), "group_id")


_K3 = "(exp(reference_logp[{0}] - policy_logp[{0}]) - 1 - (reference_logp[{0}] - policy_logp[{0}]))"


@query(f"WITH {V.PREFERENCES} SELECT pair_id, round(({_K3.format(1)} + {_K3.format(2)}) / 2, 9) AS k3 FROM preferences")
def k3_kl(spark, sf_dir):
    return V.preferences(spark, sf_dir).select("pair_id", F.round(maths.k3(F.col("policy_logp"), F.col("reference_logp")), 9).alias("k3"))


@query(f"""WITH {V.PREFERENCES}, a AS (SELECT *, CASE WHEN min(reward) OVER g = max(reward) OVER g THEN 0 ELSE reward - avg(reward) OVER g END AS adv, ({_K3.format(1)} + {_K3.format(2)}) / 2 AS k3 FROM preferences WINDOW g AS (PARTITION BY group_id)),
l AS (SELECT group_id, bool_and(adv = 0) AS zero_advantage, avg(-adv * (policy_logp[1] + policy_logp[2]) / 2) AS p, avg(k3) AS k FROM a GROUP BY group_id)
SELECT group_id, zero_advantage, round(CASE WHEN zero_advantage THEN 0 ELSE p END, 9) AS policy_loss, round(CASE WHEN zero_advantage THEN 0 ELSE 0.04 * k END, 9) AS kl_loss, round(CASE WHEN zero_advantage THEN 0 ELSE p + 0.04 * k END, 9) AS group_loss FROM l""")
def group_loss(spark, sf_dir):
    rows = A.group_advantages(V.preferences(spark, sf_dir), "group_id")
    out = A.group_loss(rows, "group_id", 0.04)
    return out.select("group_id", "zero_advantage", *[(F.round(c, 9) + 0.0).alias(c) for c in ("policy_loss", "kl_loss", "group_loss")])


@query(f"""WITH {V.PREFERENCES}, v AS (SELECT group_id, pair_id, reward = 0 AS z FROM preferences), i AS (SELECT *, sum((NOT z)::INT) OVER (PARTITION BY group_id ORDER BY pair_id) AS island FROM v)
SELECT pair_id, (sum(z::BIGINT) OVER (PARTITION BY group_id, island ORDER BY pair_id))::BIGINT AS consecutive FROM i""")
def islands_zero_signal(spark, sf_dir):
    out = windows.zero_signal_runs(V.preferences(spark, sf_dir), "group_id", "pair_id", F.col("reward") == 0)
    return out.select("pair_id", "consecutive")


@query(f"WITH {V.PREFERENCES} SELECT group_id, round(sum(policy_logp[1] * (pair_id % 9 + 1)) / sum(pair_id % 9 + 1), 9) AS value, sum(pair_id % 9 + 1)::BIGINT AS tokens FROM preferences GROUP BY group_id")
def token_weighted_nll(spark, sf_dir):
    rows = V.preferences(spark, sf_dir).withColumn("n", F.col("pair_id") % 9 + 1).withColumn("t", F.get("policy_logp", F.lit(0)) * F.col("n"))
    return A.token_weighted(rows, "t", "n", ["group_id"]).withColumn("value", F.round("value", 9))


@query(f"""WITH {V.PREFERENCES}, e AS (SELECT pair_id, abs(chosen_logp - c) AS ae, abs(chosen_logp - c) / greatest(abs(chosen_logp), abs(c), 1e-300) AS re FROM (SELECT *, chosen_logp + (pair_id % 4) * 0.00004::DOUBLE AS c FROM preferences))
SELECT pair_id, ae <= 1e-4 AND re <= 1e-5 AS ok FROM e""")
def logprob_tolerance(spark, sf_dir):
    fresh = F.col("chosen_logp") + (F.col("pair_id") % 4) * 0.00004
    return V.preferences(spark, sf_dir).select("pair_id", maths.matches_within(F.col("chosen_logp"), fresh)["ok"].alias("ok"))


@query("SELECT o_orderkey, s AS step, round(CASE WHEN s <= 0 THEN 0 WHEN s <= 10 THEN s / 10 WHEN s >= 100 THEN 0.1 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (s - 10) / 90)) END, 9)::DOUBLE AS multiplier FROM (SELECT o_orderkey, o_orderkey % 120 AS s FROM orders)")
def warmup_cosine(spark, sf_dir):
    step = F.col("o_orderkey") % 120
    return V.table(spark, sf_dir, "orders").select("o_orderkey", step.alias("step"), F.round(maths.lr_multiplier(step, 10, 100, 0.1), 9).alias("multiplier"))


@query()
def aligned_rollout_mask(spark, sf_dir):
    p = V.preferences(spark, sf_dir)
    k = F.col("pair_id")
    c = p.select("group_id", k.alias("candidate_index"), "reward", F.array(F.lit(5).cast("long"), k % 2, k % 3, F.lit(2).cast("long")).alias("label_ids"), (k % 11 == 0).alias("punctuated"))
    return pairs.aligned_mask(c, "group_id")
