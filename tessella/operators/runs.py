"""Relational analytics of recorded search runs: funnels, generations, gates, overlaps, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CRITICAL = 1.96


def correct_sign(t: str = "fmb_tstat", sign: str = "expected_sign") -> Column:
    return F.when(F.col(sign) == "positive", F.col(t) > 0).when(F.col(sign) == "negative", F.col(t) < 0).otherwise(False)


def outcome(t: str = "fmb_tstat", error: str = "error") -> Column:
    """One bucket for each evaluated signal."""
    value = F.col(t)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(F.col(error).isNotNull(), "error").when(~finite, "invalid").when(F.abs(value) <= CRITICAL, "weak").when(correct_sign(t), "correct").otherwise("wrong_sign")


def evidence_outcome(t: str = "fmb_tstat", error: str = "error") -> Column:
    """How an evaluated signal bears on its hypothesis."""
    names = {"correct": "supporting", "weak": "opposing_weak", "wrong_sign": "opposing_wrong_sign"}
    out = outcome(t, error)
    expr = F.lit("realization_failure")
    for k, v in names.items():
        expr = F.when(out == k, v).otherwise(expr)
    return expr


def funnel(evaluated: DataFrame, key: str = "run") -> DataFrame:
    """(key, evaluated, errors, invalid, wrong_sign, weak, correct, hit_rate) for each key, and for all (key NULL)."""
    df = evaluated.withColumn("__o", outcome())
    counts = [F.count_if(F.col("__o") == o).alias(n) for o, n in (("error", "errors"), ("invalid", "invalid"), ("wrong_sign", "wrong_sign"), ("weak", "weak"), ("correct", "correct"))]
    out = df.rollup(key).agg(F.count("*").alias("evaluated"), *counts)
    return out.withColumn("hit_rate", F.col("correct") / F.col("evaluated"))


def signed_t(evaluated: DataFrame) -> DataFrame:
    """Evaluated rows with a usable t, and t_signed: positive where it supports the hypothesis."""
    flip = F.when(F.col("expected_sign") == "negative", -F.col("fmb_tstat")).otherwise(F.col("fmb_tstat"))
    return evaluated.where(~outcome().isin("error", "invalid")).withColumn("t_signed", flip)


def first_pass(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(outcome() == "correct")


def generations(evaluated: DataFrame) -> DataFrame:
    """(run, generation, n, rate, best): hit rate and best oriented t of usable rows."""
    df = signed_t(evaluated)
    return df.groupBy("run", "generation").agg(F.count("*").alias("n"), (F.count_if(F.col("t_signed") > CRITICAL) / F.count("*")).alias("rate"), F.max("t_signed").alias("best"))


def cumulative_gates(df: DataFrame, gates: dict[str, Column], key: str = "run") -> DataFrame:
    """(key, one count for each gate): rows that pass it and all before; a missing condition fails."""
    held, counts = F.lit(True), []
    for name, condition in gates.items():
        held = held & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(held).alias(name))
    return df.groupBy(key).agg(*counts)


def jaccard(items: DataFrame, group: str, item: str, within: str | None = None) -> DataFrame:
    """(a, b, overlap, jaccard) of every two groups, averaged over the values of `within`. Sets meet by item, in an equi-join."""
    sets = items.select(F.col(within).alias("__t") if within else F.lit(0).alias("__t"), F.col(group).alias("g"), F.col(item).alias("x")).distinct()
    sizes = sets.groupBy("__t", "g").agg(F.count("*").alias("n"))
    a, b = sets.select("__t", F.col("g").alias("a"), "x"), sets.select("__t", F.col("g").alias("b"), "x")
    common = a.join(b, ["__t", "x"]).where("a < b").groupBy("__t", "a", "b").agg(F.count("*").alias("c"))
    # Groups are few by nature (runs); pairs of them are what is asked for.
    pairs = sizes.select("__t", F.col("g").alias("a"), F.col("n").alias("na")).join(sizes.select("__t", F.col("g").alias("b"), F.col("n").alias("nb")), "__t").where("a < b")
    both = pairs.join(common, ["__t", "a", "b"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return both.withColumn("j", F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).groupBy("a", "b").agg(F.sum("c").alias("overlap"), F.avg("j").alias("jaccard"))


def recurrence(items: DataFrame, group: str, item: str) -> DataFrame:
    """(n_groups, n_items): how many items occur in so many groups."""
    return items.groupBy(item).agg(F.countDistinct(group).alias("n_groups")).groupBy("n_groups").agg(F.count("*").alias("n_items"))


def concentration(df: DataFrame, key: str, category: str, leave_out: tuple[str, ...] = ("other",)) -> DataFrame:
    """(key, n_categories, hhi): sum of squared shares of the categories."""
    counts = df.where(~F.col(category).isin(*leave_out)).groupBy(key, category).agg(F.count("*").alias("c"))
    return counts.groupBy(key).agg(F.count("*").alias("n_categories"), (F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("hhi"))


def task_spearman(evaluated: DataFrame, a: str, b: str, key: str = "run", task: str = "pair") -> DataFrame:
    """(n, spearman): rank correlation of two runs' hit rates over the tasks that both have."""
    rates = evaluated.where(F.col(key).isin(a, b)).groupBy(task).pivot(key, [a, b]).agg(F.avg((outcome() == "correct").cast("double")))
    both = rates.where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def rank(c: str) -> Column:
        w = Window.partitionBy(F.lit(0))
        order = w.orderBy(c)
        return (F.rank().over(order) + F.count(c).over(order.rangeBetween(Window.unboundedPreceding, 0))) / 2.0

    return both.select(rank(a).alias("ra"), rank(b).alias("rb")).agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("spearman"))


def marginals(evaluated: DataFrame, label: str = "pair", sep: str = "_") -> DataFrame:
    """(theme, evaluated, correct, rate): each part of a pair's label takes the pair's rows."""
    df = evaluated.select(F.explode(F.split(label, sep)).alias("theme"), (outcome() == "correct").alias("ok"))
    return df.groupBy("theme").agg(F.count("*").alias("evaluated"), F.count_if("ok").alias("correct")).withColumn("rate", F.col("correct") / F.col("evaluated"))


def top_per_run(df: DataFrame, by: list[Column], k: int = 3, key: str = "run") -> DataFrame:
    w = Window.partitionBy(key).orderBy(*by)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def nearest_row(rows: DataFrame, wanted: DataFrame, name: str = "name", t: str = "t_stat", target: str = "full_t") -> DataFrame:
    """wanted with the row of the same name whose t is nearest to target (the first by t, of equals)."""
    w = Window.partitionBy(*wanted.columns).orderBy(F.abs(F.col(t) - F.col(target)), t)
    return wanted.join(rows, name).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def variables_used(df: DataFrame, expression: str, catalog: list[str], out: str = "variables") -> DataFrame:
    """The catalogued items that an expression's text names, sorted."""
    tokens = F.regexp_extract_all(F.lower(F.col(expression)), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0))
    return df.withColumn(out, F.array_sort(F.array_intersect(F.array_distinct(tokens), F.array(*map(F.lit, catalog)))))


def merged(previous: DataFrame, new: DataFrame, key: str = "signal_id") -> DataFrame:
    """Rows of an earlier run that weren't computed again, and the new ones."""
    return previous.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def ordered_union(first: DataFrame, second: DataFrame, key: Column, order: str) -> DataFrame:
    """Both frames' rows, of equal keys only the first: those of `first` before those of `second`, each by `order`."""
    both = first.withColumn("__part", F.lit(0)).unionByName(second.withColumn("__part", F.lit(1))).withColumn("__key", key)
    w = Window.partitionBy("__key").orderBy("__part", order)
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__part", "__key")


def missing_and_unknown(cited: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Keys that should be cited and aren't, and cited ones that aren't known."""
    c, k = cited.select(key).distinct(), known.select(key).distinct()
    return k.join(c, key, "left_anti"), c.join(k, key, "left_anti")


def survivors(inputs: DataFrame, survivor_ids: DataFrame, archive: DataFrame, key: str = "signal_id") -> DataFrame:
    """Input rows of the survivors. ValueError if survivors repeat, aren't inputs, or aren't in the archive as they were."""
    if survivor_ids.groupBy(key).count().where("count > 1").head(1):
        raise ValueError("survivors repeat")
    lost = survivor_ids.join(inputs, key, "left_anti").head(1)
    if lost:
        raise ValueError(f"survivor {lost[0][key]} is no input")
    kept = inputs.join(survivor_ids, key, "left_semi")
    drifted = kept.join(archive.select(key, "expression"), [key, "expression"], "left_anti").head(1)
    if drifted:
        raise ValueError(f"survivor {drifted[0][key]} isn't in the archive as it was")
    return kept


def rejection_codes(diagnostics: DataFrame) -> DataFrame:
    """(code, n) of diagnostics that aren't acceptances."""
    return diagnostics.where("code <> 'accepted'").groupBy("code").agg(F.count("*").alias("n"))


def call_accounting(calls: DataFrame) -> DataFrame:
    """(role, calls, prompt_tokens, completion_tokens) by role, and in all (role NULL)."""
    return calls.rollup("role").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def selection(candidates: DataFrame, survivor_ids: DataFrame, conditional_t: DataFrame, reasons: DataFrame, key: str = "signal_id") -> DataFrame:
    """candidates with conditional_t, survives and, for the rest, why: the recorded reason, else an inestimable t, else
    a wrong sign, else a t below the threshold."""
    df = candidates.join(conditional_t, key, "left").join(reasons, key, "left").join(survivor_ids.select(key, F.lit(True).alias("__s")), key, "left")
    t = F.col("conditional_t")
    fits = F.when(F.col("expected_sign") == "negative", t < 0).otherwise(t > 0)
    why = F.coalesce(F.col("reason"), F.when(t.isNull() | F.isnan(t), "conditional_t_not_estimable"), F.when(~fits, "conditional_sign_mismatch"), F.lit("conditional_t_below_threshold"))
    survives = F.coalesce("__s", F.lit(False))
    return df.withColumns({"survives": survives, "reason": F.when(~survives, why)}).drop("__s")


def critique_taxonomy(notes: DataFrame, category: str = "category") -> DataFrame:
    """(category, n, flagged, flag_share, share): critiques by what they target."""
    counts = notes.groupBy(category).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "flag").alias("flagged"))
    # One row a category: a closed vocabulary.
    total = counts.agg(F.sum("n").alias("t"))
    return counts.withColumn("__t", total.scalar()).select(category, "n", "flagged", (F.col("flagged") / F.col("n")).alias("flag_share"), (F.col("n") / F.col("__t")).alias("share"))


def uniqueness(evaluated: DataFrame, key: str = "run", expression: str = "expression") -> DataFrame:
    """(key, n, n_unique, n_duplicate, rate): expressions that differ by more than case and blanks."""
    form = F.regexp_replace(F.lower(F.col(expression)), r"\s+", "")
    counts = evaluated.where(F.trim(F.col(expression)) != "").groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(form).alias("n_unique"))
    return counts.select(key, "n", "n_unique", (F.col("n") - F.col("n_unique")).alias("n_duplicate"), (F.col("n_unique") / F.col("n")).alias("rate"))


def across_runs(rates: DataFrame, value: str, key: str = "pair") -> DataFrame:
    """(key, median, least, greatest) of a value that each run has for each key."""
    return rates.groupBy(key).agg(F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def report(df: DataFrame, by: list[Column], most: int) -> DataFrame:
    """The first `most` rows by an order: a report of bounded length."""
    return df.orderBy(*by).limit(most)


def capped(signals: DataFrame, most: int | None, key: str = "signal_id") -> DataFrame:
    """The first `most` signals by key, or all: a cap that a caller asks for."""
    return signals if most is None else signals.orderBy(key).limit(most)


def benchmark_metrics(evaluated: DataFrame, usage: DataFrame | None = None, key: str = "run", expression: str = "expression") -> DataFrame:
    """(key, n_evaluated, n_successes, success_rate, n_unique, n_duplicate, uniqueness, ...usage): a row a run. Expressions
    count as one if they differ by case and blanks only; blank ones don't count. usage (key, ...) adds tokens and times."""
    form = F.when(F.trim(expression) != "", F.regexp_replace(F.lower(F.col(expression)), r"\s+", ""))
    rate = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    df = evaluated.groupBy(key).agg(F.count("*").alias("n_evaluated"), F.count_if(outcome() == "correct").alias("n_successes"), F.count(form).alias("__n"), F.countDistinct(form).alias("n_unique"))
    df = df.select(key, "n_evaluated", "n_successes", rate(F.col("n_successes"), F.col("n_evaluated")).alias("success_rate"), "n_unique", (F.col("__n") - F.col("n_unique")).alias("n_duplicate"), rate(F.col("n_unique"), F.col("__n")).alias("uniqueness"))
    return df if usage is None else df.join(usage, key, "left")


def converged(dynamics: DataFrame, key: str = "run") -> DataFrame:
    """(key, converged, reason) from generations' (key, generation, rate, best): what assay.converged says of each search.
    A search is a list of some tens of generations."""
    seq = dynamics.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("generation", "rate", "best"))).alias("g"))
    last, before, first = F.element_at("g", -1), F.try_element_at("g", F.lit(-2)), F.element_at("g", 1)
    why = (
        F.when(F.size("g") < 2, "too_few_generations").when(last["rate"] < 0.20, "hit_rate_collapse")
        .when((first["best"] > 0) & (last["best"] < 0.5 * first["best"]), "diminishing_returns")
        .when((last["best"] < before["best"]) & (last["rate"] < before["rate"]), "no_improvement").otherwise("productive")
    )
    return seq.select(key, why.alias("reason")).select(key, (~F.col("reason").isin("too_few_generations", "productive")).alias("converged"), "reason")
