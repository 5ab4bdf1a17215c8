"""Verdicts, gates, findings and their tallies."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.functions.scalars import rank_in
from sparkweft.operators.scan import rolling_sums
from sparkweft.sources.staging import free_names

#: Severities and priorities in order; gate words of each emitter.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
PRIORITIES = ["Must", "Should", "Could", "Won't"]
GATES = {
    "reviewer": ["PASS", "NEEDS_WORK", "FAIL"],
    "security": ["PASS", "FAIL"],
    "dba": ["SAFE", "NEEDS_REVIEW", "UNSAFE"],
    "refactorer": ["CLEAN", "HAS_FINDINGS", "NEEDS_MAJOR_WORK"],
    "deploy": ["READY", "WARNING", "BLOCKED"],
}
#: Severity, burn rate, long and short window in seconds of each alert.
BURN_POLICIES = [("Page", 14.4, 3600, 300), ("Page", 6.0, 21600, 1800), ("Ticket", 3.0, 86400, 7200), ("Ticket", 1.0, 259200, 21600)]
#: Fixed value: the words by which a verdict counts as passed.
PASS_PATTERN = r'"verdict"\s*:\s*"pass"'


def passed_text(output: Column) -> Column:
    """Whether the raw output says pass anywhere."""
    return output.rlike(PASS_PATTERN)


def passed_parsed(output: Column) -> Column:
    """Whether the output, read as JSON, has the verdict pass; false if it can't be read."""
    return F.coalesce(F.get_json_object(output, "$.verdict") == "pass", F.lit(False))


def matched_count(output: Column, key: str = "matched") -> Column:
    """Numbers in the list of that key, found by pattern."""
    return F.size(F.regexp_extract_all(F.regexp_extract(output, rf'"{key}"\s*:\s*\[([^\]]*)\]', 1), F.lit("[0-9]+"), F.lit(0)))


def select_scenarios(rows: DataFrame, agent: str = "", scenario: str = "") -> DataFrame:
    """Rows of that agent and that scenario; an empty filter passes all."""
    for col, want in (("agent", agent), ("scenario", scenario)):
        rows = rows.where(F.col(col) == want) if want else rows
    return rows


def complete(parts: DataFrame, keys: list[str], part: str, required: list[str]) -> DataFrame:
    """Keys that have every required part."""
    have = [F.bool_or(F.col(part) == r).alias(f"_h{i}") for i, r in enumerate(required)]
    return parts.groupBy(*keys).agg(*have).where(" AND ".join(f"_h{i}" for i in range(len(required)))).select(*keys)


def listed(names: DataFrame, by: str, name: str) -> DataFrame:
    """Each group's names in the order in which they are run, that of their bytes, with their places from 1."""
    return names.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(name)))


def selection(scenarios: DataFrame, agent: str = "", scenario: str = "") -> DataFrame:
    """How many scenarios a filter leaves, their cost, and whether there is anything to run; nothing is a warning, no failure."""
    count = select_scenarios(scenarios, agent, scenario).agg(F.count("*").alias("total"))
    outcome = F.when(F.col("total") > 0, "run").when(F.lit(bool(agent or scenario)), "no match for the filter").otherwise("no scenarios")
    return count.select("total", (F.col("total") * 2).alias("cost"), outcome.alias("outcome"))


def tally(results: DataFrame, by: list[str], passed: str) -> DataFrame:
    """Passed, failed, rate, cost (two runs each) and whether all passed."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    out = results.groupBy(*by).agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))
    total = F.col("passed") + F.col("failed")
    return out.select(*by, "passed", "failed", (F.col("passed") / total).alias("rate"), (total * 2).alias("cost"), (F.col("failed") == 0).alias("all_passed"))


def reduce_items(items: DataFrame, by: list[str], item: str, met: str, kind: str) -> DataFrame:
    """passed, matched, missed and forbidden of each case, by the kind of its items: required, bonus or forbidden.

    A case passes if every required item is met and no forbidden one is. The
    lists are of item numbers in order: met ones that are not forbidden,
    required ones that are not met, forbidden ones that are met. A case's
    items are those of one rubric, so the lists are short.
    """
    yes = F.coalesce(F.col(met), F.lit(False))
    forbidden, required = F.col(kind) == "forbidden", F.col(kind) == "required"
    numbers = lambda which: F.array_sort(F.collect_list(F.when(which, F.col(item))))
    out = items.groupBy(*by).agg(numbers(yes & ~forbidden).alias("matched"), numbers(required & ~yes).alias("missed"), numbers(forbidden & yes).alias("forbidden"))
    return out.select(*by, ((F.size("missed") == 0) & (F.size("forbidden") == 0)).alias("passed"), "matched", "missed", "forbidden")


def all_gates(gates: DataFrame, by: list[str], gate: str, verdict: str, required: tuple[str, ...] = ("reviewer", "security")) -> DataFrame:
    """Whether an item has every required gate, and each says what lets it pass: the first of its words in GATES.

    A gate that is missing, null or unknown stops the item, and so does one of
    several verdicts of a gate that is not the passing one.
    """
    passes = lambda g: F.when(F.col(gate) == g, F.coalesce(F.col(verdict) == GATES[g][0], F.lit(False)))
    each = [F.coalesce(F.bool_and(passes(g)), F.lit(False)) for g in required]
    return gates.groupBy(*by).agg(reduce(lambda a, b: a & b, each).alias("proceeds"))


def consensus(runs: DataFrame, by: list[str], passed: str) -> DataFrame:
    """The majority of repeated runs; a tie fails."""
    return runs.groupBy(*by).agg((F.count_if(F.col(passed)) * 2 > F.count("*")).alias("passed"))


def severity_counts(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of each severity, with its rank."""
    return findings.groupBy(F.col(severity).alias("severity")).agg(F.count("*").alias("findings")).withColumn("rank", rank_in(F.col("severity"), SEVERITIES))


def overall_risk(findings: DataFrame, severity: str) -> DataFrame:
    return findings.agg(F.min_by(severity, rank_in(F.col(severity), SEVERITIES)).alias("risk"))


def merge_reports(reports: list[DataFrame], key: list[str], severity: str) -> DataFrame:
    """Findings of several reports, each once at its worst severity, worst first; words that are no severity come last and stay as they are."""
    both = reports[0]
    for r in reports[1:]:
        both = both.unionByName(r)
    rank = rank_in(F.col(severity), SEVERITIES)
    worst = both.groupBy(*key).agg(F.min(F.struct(rank.alias("rank"), F.col(severity).alias("word"))).alias("_worst"))
    return worst.select(*key, F.col("_worst.rank").alias("rank"), F.col("_worst.word").alias(severity)).orderBy("rank", *key)


def top_findings(findings: DataFrame, impact: Column, ease: Column, effort: Column, tie: str, k: int) -> DataFrame:
    """The k best by impact times ease over effort; ties go to the smaller key."""
    return findings.withColumn("score", impact * ease / effort).orderBy(F.desc("score"), tie).limit(k)


def functional_dependency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Whether a determines b: no value of a has two of b."""
    counts = rows.groupBy(a).agg(F.min(b).alias("_lo"), F.max(b).alias("_hi"))
    return counts.agg(F.coalesce(F.bool_and(F.col("_lo") == F.col("_hi")), F.lit(True)).alias("holds"), F.count_if(F.col("_lo") != F.col("_hi")).alias("violations"))


def sigma_levels(rows: DataFrame, value: str) -> DataFrame:
    """Thresholds at the mean and at one or two deviations from it."""
    m, s = F.avg(value), F.stddev_pop(value)
    return rows.agg((m - s).alias("low"), m.alias("mean"), (m + s).alias("high"), (m + 2 * s).alias("very_high"))


def burn_rate(events: DataFrame, key: str, second: str, good: Column, span: int, slo: float) -> DataFrame:
    """Bad share of the last ``span`` seconds of each key over the share that the objective allows, for each event.

    Events count by second; sums over a span are a segmented scan, so no task
    has all of a key. Rows without a second have none.
    """
    total, bad = free_names([*events.columns, "burn"], "total", "bad")
    counts = events.where(F.col(second).isNotNull()).groupBy(key, second).agg(F.count("*").alias(total), F.count_if(~F.coalesce(good, F.lit(False))).alias(bad))
    sums = rolling_sums(counts, [key], second, [total, bad], {"span": span})
    burns = sums.select(F.col(key).alias(total), F.col(second).alias(bad), (F.col(f"{bad}_span") / F.col(f"{total}_span") / (1 - slo)).alias("burn"))
    rows = events.drop("burn")
    return rows.join(burns, rows[key].eqNullSafe(burns[total]) & (rows[second] == burns[bad]), "left").drop(total, bad)


def burn_alerts(events: DataFrame, key: str, second: str, good: Column, slo: float, policies=BURN_POLICIES, bucket: int = 60) -> DataFrame:
    """(key, bucket, severity, factor, burn_long, burn_short, fires) for each key, bucket with events and policy.

    A policy fires where the share of bad events over that the objective allows
    is above its factor both in its long and in its short window, each of which
    ends with the bucket. Events that are not known to be good are bad, those
    without a second take no part. Events are counted by bucket before anything is
    shuffled, and windows are running sums over buckets, so neither a hot key
    nor the number of its events in a window costs more.
    """
    counts = events.where(F.col(second).isNotNull()).groupBy(key, F.floor(F.col(second) / bucket).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad"))
    spans = {str(w): w // bucket - 1 for _, _, *windows in policies for w in windows}
    sums = rolling_sums(counts, [key], "bucket", ["n", "bad"], spans)
    burn = lambda w: F.col(f"bad_{w}") / F.col(f"n_{w}") / (1 - slo)
    one = [F.struct(F.lit(s).alias("severity"), F.lit(float(f)).alias("factor"), burn(long).alias("burn_long"), burn(short).alias("burn_short"), ((burn(long) > f) & (burn(short) > f)).alias("fires")) for s, f, long, short in policies]
    return sums.select(key, "bucket", F.explode(F.array(*one)).alias("p")).select(key, "bucket", "p.*")


def version_bump(commits: DataFrame, by: list[str], message: str) -> DataFrame:
    """major if a message has BREAKING, else minor for feat:, else patch for fix:, else none."""
    m = F.col(message)
    level = F.when(m.contains("BREAKING"), 3).when(m.startswith("feat:"), 2).when(m.startswith("fix:"), 1).otherwise(0)
    top = commits.groupBy(*by).agg(F.max(level).alias("_l"))
    return top.select(*by, F.element_at(F.array(*map(F.lit, ("none", "patch", "minor", "major"))), F.col("_l") + 1).alias("bump"))
