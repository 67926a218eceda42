"""Weak supervision: accuracies of voting rules by expectation-maximisation, on DataFrame functions alone.

A vote pattern is an array with one number per rule: 1 good, -1 bad, 0 abstains. EM runs on the counts of the distinct
patterns, of which there are at most 3 ** rules however many documents there are; the whole fit is one expression over
one row, so nothing but that row is ever gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 25
#: Pseudo-votes and starting chances of a good vote on good and on bad documents.
SMOOTH, GOOD, BAD, PRIOR = 2.0, 0.99, 0.6, 0.9


def vote(bad: Column, good: Column) -> Column:
    """-1 where bad, else 1 where good, else 0; null conditions count as not met."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _odds(state: Column, votes: Column, rules: int) -> Column:
    def one(j: int) -> Column:
        g, b = F.get(state.good, F.lit(j)), F.get(state.bad, F.lit(j))
        v = F.get(votes, F.lit(j))
        return F.when(v == 1, F.log(g / b)).when(v == -1, F.log((1 - g) / (1 - b))).otherwise(0.0)

    return reduce(lambda x, y: x + y, (one(j) for j in range(rules)), F.log(state.prior / (1 - state.prior)))


def fit(patterns: DataFrame, rules: int) -> DataFrame:
    """patterns: (votes, n). Returns one row: state (prior, good, bad) after STEPS steps of EM."""
    state = F.struct(
        F.lit(PRIOR).alias("prior"), F.array(*[F.lit(GOOD)] * rules).alias("good"), F.array(*[F.lit(BAD)] * rules).alias("bad"),
    )

    def total(weighed: Column, of) -> Column:
        return F.aggregate(weighed, F.lit(0.0), lambda acc, x: acc + of(x))

    def step(s: Column, seen: Column) -> Column:
        weighed = F.transform(seen, lambda p: F.struct(p.votes.alias("votes"), p.n.alias("n"), (1 / (1 + F.exp(-_odds(s, p.votes, rules)))).alias("q")))

        def update(w: Column) -> Column:
            def rate(j: int, share, start: float) -> Column:
                own = lambda x: F.get(x.votes, F.lit(j))
                up = total(w, lambda x: F.when(own(x) == 1, x.n * share(x)).otherwise(0.0))
                cast = total(w, lambda x: F.when(own(x) != 0, x.n * share(x)).otherwise(0.0))
                return F.least(F.lit(0.9999), (up + SMOOTH * start) / (cast + SMOOTH))

            return F.struct(
                ((total(w, lambda x: x.n * x.q) + SMOOTH * PRIOR) / (total(w, lambda x: x.n) + SMOOTH)).alias("prior"),
                F.array(*[rate(j, lambda x: x.q, GOOD) for j in range(rules)]).alias("good"),
                F.array(*[rate(j, lambda x: 1 - x.q, BAD) for j in range(rules)]).alias("bad"),
            )

        return F.get(F.transform(F.array(weighed), update), F.lit(0))

    gathered = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("seen"))
    return gathered.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state, lambda s, _: step(s, F.col("seen"))).alias("state"))


def posteriors(voted: DataFrame, rules: int) -> DataFrame:
    """voted has a column votes. Returns (votes, n, posterior): the chance of each pattern to be good."""
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    state = fit(patterns, rules).first()["state"]
    fixed = F.struct(
        F.lit(state.prior).alias("prior"), F.array(*map(F.lit, state.good)).alias("good"), F.array(*map(F.lit, state.bad)).alias("bad"),
    )
    return patterns.withColumn("_s", fixed).select("votes", "n", (1 / (1 + F.exp(-_odds(F.col("_s"), F.col("votes"), rules)))).alias("posterior"))
