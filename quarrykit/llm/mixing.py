"""Mixing of sources to target weights with soft membership.

A naive Bayes classifier of hashed words, trained on the table of labels by
language, predicts how likely each document belongs to each domain. Projected-gradient least squares then
fits a nonnegative rate for each document, such that the expected tokens of
each domain meet their targets. All of it is DataFrame aggregation: an
iteration sends one number per domain to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.store import bounded, computed, discard, written

#: Domains in order, as conditions over a row of labels; the last is what is left.
DOMAINS = {"clean": "quality = 1 AND toxic = 0", "toxic": "toxic = 1", "poor": "quality = 0"}
TARGETS = {"clean": 0.95, "toxic": 0.01, "poor": 0.04}
#: Places that words are hashed to; the model has a number for each and each domain, whatever the input.
SIZE = 1 << 16
#: Letters of the prefixes that stand for inflected forms, beside the words themselves.
PREFIX = 5
#: Log-likelihood ratio of a word (chi-squared of one degree; 15 is p = 0.0001) from which it tells of a domain.
TELLS = 15.0
#: Labelled documents of a language with which it has a model of its own; the others share one.
OWN = 100
#: Documents whose posteriors round to the same point of this grid are one cell, with one rate; there are (GRID + 1)(GRID + 2) / 2 cells at most.
GRID = 200
#: Pull of the rates towards 1, and the end of the iterations.
PULL = 1e-3
STEPS = 60
CLOSE = 2e-4


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{M}]+")


def _features(docs: DataFrame, own: list[str], rest: list[str]) -> DataFrame:
    """The columns ``rest`` of docs with n_tokens, __own (the place in ``own`` of its language, or -1) and __f: places of its words, their prefixes and some shares."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    listed = F.array(*map(F.lit, own)).cast("array<string>")
    counts = [F.regexp_count(text, F.lit(c)) for c in ("[#*$%&|<>]", "[A-Z]", "!")]
    tokens = F.regexp_count(F.concat(F.lit(" "), text), F.lit("[ \\t-\\r][^ \\t-\\r]")).cast("long")
    own_place = (F.array_position(listed, lang) - 1).cast("int")
    # The text is read here and goes no further, unless it is among the rest.
    read = F.struct(F.array_remove(_words(text), "").alias("w"), tokens.alias("n_tokens"), F.length(text).alias("n"), *(c.alias(f"c{i}") for i, c in enumerate(counts)))
    out = computed(docs.select("*", own_place.alias("__own")), "__r", read).select(*rest, "__own", "__r.n_tokens", "__r")
    out = computed(out, "__d", F.array_distinct("__r.w"))
    steps = [F.least(F.lit(6), F.floor(F.log2(1 + F.lit(100) * F.col(f"__r.c{i}") / F.greatest(F.col("__r.n"), F.lit(1))))) for i in range(len(counts))]
    steps.append(F.floor(F.lit(8) * F.size("__d") / F.greatest(F.size("__r.w"), F.lit(1))))
    steps.append(F.least(F.lit(12), F.floor(F.log2(1 + F.size("__r.w")))))
    names = [F.format_string(f"{kind}%d", x.cast("int")) for kind, x in zip("#A!~n", steps, strict=True)]
    place = lambda x: F.pmod(F.hash("__own", x), F.lit(SIZE))
    start = lambda w: F.when(F.length(w) > PREFIX, F.pmod(F.hash("__own", F.lit("*"), F.substring(w, 1, PREFIX)), F.lit(SIZE)))
    found = F.concat(F.transform("__d", place), F.array_compact(F.transform("__d", start)), F.transform(F.array(*names), place))
    return computed(out, "__f", F.array_distinct(found)).drop("__r", "__d")


def _languages(docs: DataFrame, marked: DataFrame) -> list[str]:
    """The languages with OWN labelled documents or more, most first; 64 at most, so that places are not shared by many."""
    if "lang" not in docs.columns:
        return []
    known = docs.where("lang IS NOT NULL").select("doc_id", "lang").join(bounded(marked), F.col("doc_id") == F.col("__id"))
    counts = known.groupBy("lang").count().where(F.col("count") >= OWN)
    return [r.lang for r in counts.orderBy(F.desc("count"), "lang").limit(64).collect()]


def _model(features: DataFrame) -> tuple[dict[int, list[float]], list[list[float]]]:
    """Of each language the score of a document without any telling word, -1 being all others; and by domain what each place adds to it.

    features are of the labelled documents, with their domain. Word presence and
    absence both count. Counts are summed by place in Spark; a place tells of a
    domain if its log-likelihood ratio is TELLS or more, and only those come
    back, SIZE at most.
    """
    k = len(DOMAINS)
    labelled = features.select("__own", "domain", "__f")
    sums = [F.sum((F.col("domain") == i).cast("long")).alias(f"c{i}") for i in range(k)]
    sizes = {r["__own"]: [r[f"c{i}"] for i in range(k)] for r in labelled.groupBy("__own").agg(*sums).collect()}
    rows = labelled.select("__own", "domain", F.explode("__f").alias("f")).groupBy("__own", "f").agg(*sums)
    base = {own: [_log((x + 1) / (sum(size) + k)) for x in size] for own, size in sizes.items()}
    adds = [[0.0] * SIZE for _ in range(k)]
    total = reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(k)])
    # One language for each place, the one that has most of it.
    best = rows.where(total >= 3).groupBy("f").agg(F.max_by(F.struct("__own", *(f"c{i}" for i in range(k))), F.struct(total, "__own")).alias("r")).select("f", "r.*")
    of_own = lambda value, empty: reduce(lambda out, own: F.when(F.col("__own") == own, F.lit(float(value(sizes[own])))).otherwise(out), sorted(sizes), F.lit(empty))
    ratios = []
    for i in range(k):
        size, rate, seen = of_own(lambda x, i=i: x[i], 0.0), total / of_own(sum, 1.0), F.col(f"c{i}").cast("double")
        rest = size - seen
        gain = seen * F.log(seen / (size * rate)) + F.when(rest > 0, rest * F.log(rest / (size * (1 - rate)))).otherwise(0.0)
        ratios.append(F.when(seen > size * rate, 2 * gain).otherwise(0.0))
    for r in sorted(best.where(F.greatest(*ratios) >= TELLS).collect()):
        size, seen = sizes[r["__own"]], [r[f"c{i}"] for i in range(k)]
        rate = sum(seen) / sum(size)
        for i, (a, n) in enumerate(zip(seen, size, strict=True)):
            p = min(1 - 1e-3, (a + rate) / (n + 1))
            base[r["__own"]][i] += _log(1 - p)
            adds[i][r.f] = round(_log(p) - _log(1 - p), 4)
    return base, adds


def _posteriors(features: DataFrame, model: tuple[dict[int, list[float]], list[list[float]]]) -> DataFrame:
    """features with p, the probabilities of all domains."""
    k = len(DOMAINS)
    base, adds = model

    def score(i: int) -> Column:
        """Beyond the first domain's, which saves a pass over the words."""
        start = reduce(lambda out, own: F.when(F.col("__own") == own, F.lit(base[own][i] - base[own][0])).otherwise(out), sorted(base), F.lit(0.0))
        table = F.split(F.lit(",".join(f"{x - y:g}" for x, y in zip(adds[i], adds[0], strict=True))), ",").cast("array<float>")  # the optimizer makes a constant of it
        return F.aggregate("__f", start, lambda acc, f: acc + F.get(table, f))

    out = computed(features, "__s", F.array(F.lit(0.0), *map(score, range(1, k))))
    top = F.array_max("__s")
    odds = [F.exp(F.get("__s", F.lit(i)) - top) for i in range(k)]
    whole = reduce(lambda a, b: a + b, odds)
    return computed(out, "p", F.array(*(x / whole for x in odds))).drop("__s", "__f", "__own")


def _log(x: float) -> float:
    from math import log

    return log(x)


def _rate(steps: list[list[float]], ahead: bool) -> Column:
    """The rate after all steps so far, or the point ahead of it where the next gradient is taken.

    Both depend on nothing but the document's posterior p. A step is a gradient
    by domain and the momentum that follows it.
    """
    k = len(DOMAINS)

    def move(at: Column, step: Column) -> Column:
        y = at["y"]
        slope = reduce(lambda a, b: a + b, [F.get("p", F.lit(i)) * F.get(step, F.lit(i)) for i in range(k)])
        rate = F.greatest(F.lit(0.0), y - (slope + F.lit(PULL) * (y - 1)) / (1 + PULL))
        return F.struct(rate.alias("r"), (rate + F.get(step, F.lit(k)) * (rate - at["r"])).alias("y"))

    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    return F.aggregate(F.array(*(F.array(*map(F.lit, x)) for x in steps)), start, move, lambda at: at["y" if ahead else "r"])


def _fitted(cells: DataFrame, targets: list[float]) -> tuple[list[list[float]], list[float]]:
    """All steps of accelerated projected gradients, from which every rate follows; and what the rates reach beyond each target.

    With tokens as shares of the corpus, and domain k holding m_k of them, half
    the sum over k of (reached_k - target_k)^2 / m_k, plus PULL times half the
    weighted sum of (rate - 1)^2, is made least. Ends when all targets are met to
    CLOSE, or when the steps no longer change what is reached, or after STEPS.
    """
    k = len(targets)

    def reached(rate: Column) -> list[float]:
        rated = cells.withColumn("rate", rate)
        row = rated.agg(*(F.sum(F.col("w") * F.col("rate") * F.get("p", F.lit(i))).alias(f"r{i}") for i in range(k))).first()
        return [x or 0.0 for x in row]

    mass = reached(F.lit(1.0))
    steps: list[list[float]] = []
    at, still = mass, 0
    for n in range(STEPS):
        pull = [(r - t) / m if m > 1e-12 else 0.0 for r, t, m in zip(at, targets, mass, strict=True)]
        if steps and (still >= 3 or max((abs(x) * m for x, m in zip(pull, mass, strict=True)), default=0.0) < CLOSE):
            steps[-1][k] = 0.0  # the rates themselves are where the targets were found to be met
            break
        steps.append([*pull, n / (n + 3)])
        then = reached(_rate(steps, True))
        still = still + 1 if max(abs(a - b) for a, b in zip(at, then, strict=True)) < CLOSE / 20 else 0
        at = then
    return steps, [r - t for r, t in zip(reached(_rate(steps, False)), targets, strict=True)]


def mix_to_targets(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, the posterior of each domain (p_...), the rate to repeat each document at, and how well the targets are met.

    The expected tokens of the result, rate * n_tokens * posterior summed, have
    the shares of ``targets`` of the corpus's tokens, as far as nonnegative rates
    can reach them; of all such rates these stay closest to 1. residual is the
    largest difference of a domain's share from its target, the same in every
    row; converged says that it is below 10 * CLOSE. Targets that nonnegative
    rates can't reach leave it false.

    ``keep`` names the columns of docs that the result has, all by default but
    those named like a result, which are replaced. Null or blank text has no
    tokens; its rate follows from its posterior, and moves no total. A null
    doc_id can't be labelled; a doc_id that is labelled twice is trained on
    twice. Words are runs of letters of any script; a language (column lang, if
    there) with OWN labelled documents has its own rates of words. Without
    labels all posteriors are equal; an empty table gives no rows. The
    posteriors are computed before this returns.
    """
    targets = targets or TARGETS
    k = len(DOMAINS)
    made = ["n_tokens", "rate", "p", "residual", "converged", *(f"p_{d}" for d in DOMAINS)]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    docs = docs.drop(*made)
    domain = F.when(F.expr("quality = 1 AND coalesce(toxic, 0) = 0"), 0).when(F.expr("toxic = 1"), 1).when(F.expr("quality = 0"), 2)
    marked = labels.select(F.col("doc_id").alias("__id"), domain.alias("domain")).where("domain IS NOT NULL AND __id IS NOT NULL")
    own = _languages(docs, marked)
    features = _features(docs.select("*", F.col("doc_id").alias("__doc")), own, [*keep, "__doc"]).select(*keep, "__doc", "n_tokens", "__own", "__f")
    features = written(features, "features")
    model = _model(features.select("__doc", "__own", "__f").join(bounded(marked), F.col("__doc") == F.col("__id")))
    names = [f"__c{i}" for i in range(k - 1)]
    small = written(_posteriors(features, model).select(*keep, "n_tokens", "p"), "posteriors")
    discard(features)
    small = small.select("*", *(F.round(F.get("p", F.lit(i)) * GRID).cast("int").alias(c) for i, c in enumerate(names)))
    # The mean posterior of a cell's tokens stands for all of them in every sum, exactly.
    weight = F.col("n_tokens") + F.lit(1e-9)
    mean = [(F.sum(weight * F.get("p", F.lit(i))) / F.sum(weight)) for i in range(k)]
    cells = written(small.groupBy(*names).agg(F.sum("n_tokens").alias("n"), F.array(*mean).alias("p")), "cells")
    cells = written(cells.coalesce(1), "cells")  # GRID bounds its rows; one file, since each step reads it
    total = cells.agg(F.sum("n")).first()[0] or 1
    steps, beyond = _fitted(cells.withColumn("w", F.col("n") / F.lit(float(total))), [targets[d] for d in DOMAINS])
    residual = max(map(abs, beyond))
    return small.join(F.broadcast(cells.select(*names, _rate(steps, False).alias("rate"))), names).select(
        *keep, "n_tokens", *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate",
        F.lit(float(residual)).alias("residual"), F.lit(residual < 10 * CLOSE).alias("converged"),
    )
