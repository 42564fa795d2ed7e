"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes for (+1) or against (-1) a document or abstains (0): rules of
merit vote for or abstain, rules of defect against or abstain. How often each
does so on good and on bad documents is not given but estimated by
expectation-maximisation over all documents: votes are first counted per
vote pattern (at most 3 to the number of rules, whatever the input), then each
round is one small aggregate over these counts. A document's posterior
probability of being good replaces an all-must-pass filter; two base rules
(too short, repetitive) still reject by themselves.

Defined results: null, empty and wordless texts have all counts 0 and fail the
base rules; documents with equal texts get equal results; an empty table gives
an empty result; other columns are untouched. A window's identity is its words'
64-bit hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldline.llm.batches import free_name
from fieldline.session import discard, materialise

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
KEEP_FROM = 0.5
PRIOR_GOOD = 0.8
BELIEF = 0.25
MAX_ROUNDS = 200
TOLERANCE = 1e-4

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_counts(docs: DataFrame, text: str = "text", into: str = "counts") -> DataFrame:
    """``docs`` with a struct of counts per document: BASE and those that only the rules use."""
    source = F.coalesce(F.col(text), F.lit(""))
    names = {}
    for step in ("words", "lines", "hashes", "windows", "ordered"):
        names[step] = free_name([*docs.columns, *names.values(), into], f"_{step}")
    words, lines, hashes, windows, ordered = (F.col(n) for n in names.values())
    split = (
        docs.withColumn(names["words"], F.filter(F.split(source, f"{SPACE}+"), lambda w: w != ""))
        .withColumn(names["lines"], F.filter(F.split(source, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn(names["hashes"], F.transform(words, lambda w: F.xxhash64(w)))
    )
    n_words = F.size(words)
    ends = F.sequence(F.lit(WINDOW), n_words)
    grams = F.transform(ends, lambda i: F.xxhash64(*[F.get(hashes, i - k) for k in range(WINDOW, 0, -1)]))
    split = split.withColumn(names["windows"], F.when(n_words >= WINDOW, grams).otherwise(F.array().cast("array<bigint>")))
    # Only texts with a repeated window need its places: those of equal windows stand side by side once sorted.
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    split = split.withColumn(names["ordered"], F.when(some, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda a, b: F.coalesce(F.get(ordered, a)["h"] == F.get(ordered, b)["h"], F.lit(False))
    repeated = F.filter(ordered, lambda x, i: same(i, i - 1) | same(i, i + 1))
    places = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["total"] + i + WINDOW - F.greatest(i, acc["end"])).alias("total"), (i + WINDOW).alias("end")),
        lambda acc: acc["total"],
    )
    counted = F.struct(
        n_words.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(source, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.regexp_count(source, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(source, F.lit(r"[!?]{2,}")).cast("long").alias("n_shouts"),
        F.regexp_count(source, F.lit(r"\p{Nd}")).cast("long").alias("n_digits"),
    )
    # Generated, so that no filter or projection above is given copies of these expressions.
    return split.withColumn(into, F.explode(F.array(counted))).drop(*names.values())


def base_failed(counts: Column) -> Column:
    """The two rules that reject by themselves."""
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def rules(counts: Column) -> dict[str, Column]:
    """The votes: 1 for, -1 against, 0 abstains."""
    words = F.greatest(counts["n_words"], F.lit(1))
    chars = F.greatest(counts["word_chars"], F.lit(1))
    lines = F.greatest(counts["n_lines"], F.lit(1))
    length = counts["word_chars"] / words

    def vote(when: Column, value: int) -> Column:
        return F.when(when, value).otherwise(0).cast("int")

    return {
        "long": vote(counts["n_words"] >= 50, 1),
        "plain": vote((counts["n_symbols"] == 0) & (counts["n_dup_lines"] == 0), 1),
        "short": vote(counts["n_words"] < MIN_WORDS, -1),
        "word_length": vote((length < 2) | (length > 20), -1),
        "symbols": vote(counts["n_symbols"] * 10 > words, -1),
        "symbol_share": vote(counts["n_symbols"] * 20 > chars, -1),
        "dup_lines": vote((counts["n_dup_lines"] > 1) & (counts["n_dup_lines"] * 10 > 3 * lines), -1),
        "repeats": vote(100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * words, -1),
        "capitals": vote(counts["n_upper"] * 2 > chars, -1),
        "shouts": vote(counts["n_shouts"] * 5 > words, -1),
        "digits": vote(counts["n_digits"] * 3 > chars, -1),
    }


MERITS = {"long", "plain"}


def believed(name: str) -> dict[int, tuple[float, float]]:
    """What is taken to be likely before the data are seen: of good and of bad documents, the share with each vote."""
    good, bad = (0.7, 0.5) if name in MERITS else (0.005, 0.3)
    return {1 if name in MERITS else -1: (good, bad), 0: (1 - good, 1 - bad)}


def log_odds(votes: dict[str, Column], model: dict) -> Column:
    """Log-odds of good, given the votes.

    The weights are one array literal, so that each round runs the code generated for the first.
    """
    weights = F.array(F.lit(float(model["prior"])), *[F.lit(float(model["rules"][name].get(v, 0.0))) for name in votes for v in (-1, 0, 1)])
    total = F.get(weights, F.lit(0))
    for k, vote in enumerate(votes.values()):
        total = total + F.get(weights, vote + F.lit(3 * k + 2))
    return total


def fit(patterns: DataFrame, names: list[str]) -> dict:
    """Expectation-maximisation over vote patterns (columns ``names`` and n).

    The model has the log-odds of the prior and, per rule and vote, the log of
    how much likelier the vote is on a good document. It starts from
    ``believed`` with PRIOR_GOOD good documents, which also settles which class
    is the good one; each round mixes the believed shares in with the weight of
    BELIEF times all documents. Ends when no number moves by TOLERANCE; raises
    if MAX_ROUNDS do not suffice.
    """
    start = {name: believed(name) for name in names}
    model = {
        "prior": math.log(PRIOR_GOOD / (1 - PRIOR_GOOD)),
        "rules": {name: {v: math.log(g / b) for v, (g, b) in start[name].items()} for name in names},
    }
    for _ in range(MAX_ROUNDS):
        good = 1 / (1 + F.exp(-log_odds({n: F.col(n) for n in names}, model)))
        sums = [F.sum(F.col("n") * F.col("_good")).alias("good"), F.sum("n").alias("all")]
        for name in names:
            cast = F.when(F.col(name) != 0, F.col("n")).otherwise(0)
            sums += [F.sum(cast * F.col("_good")).alias(f"{name}_good"), F.sum(cast).alias(f"{name}_all")]
        found = patterns.withColumn("_good", good).agg(*sums).first().asDict()
        if not found["all"]:
            return model
        belief = BELIEF * found["all"]
        n_good, n_bad = found["good"], found["all"] - found["good"]
        after = {"prior": math.log((n_good + PRIOR_GOOD * belief) / (n_bad + (1 - PRIOR_GOOD) * belief)), "rules": {}}
        for name in names:
            weights = {}
            for vote, (good_share, bad_share) in start[name].items():
                cast_good, cast_all = found[f"{name}_good"], found[f"{name}_all"]
                on_good, on_bad = (cast_good, cast_all - cast_good) if vote else (n_good - cast_good, n_bad - cast_all + cast_good)
                share_good = (on_good + good_share * belief) / (n_good + belief)
                share_bad = (on_bad + bad_share * belief) / (n_bad + belief)
                weights[vote] = math.log(share_good) - math.log(share_bad)
            after["rules"][name] = weights
        moved = max(
            abs(after["prior"] - model["prior"]),
            *(abs(w - model["rules"][n][v]) for n in names for v, w in after["rules"][n].items()),
        )
        model = after
        if moved < TOLERANCE:
            return model
    raise RuntimeError(f"no convergence in {MAX_ROUNDS} rounds")


def patterns_of(counted: DataFrame, into: str = "counts") -> DataFrame:
    votes = rules(F.col(into))
    return counted.select(*[v.alias(n) for n, v in votes.items()]).groupBy(*votes).agg(F.count("*").alias("n"))


def _fitted(counted: DataFrame, into: str) -> dict:
    patterns = materialise(patterns_of(counted, into).coalesce(1), "quality-patterns")
    model = fit(patterns, list(rules(F.col(into))))
    discard(patterns)
    return model


def verdicts(counted: DataFrame, model: dict, into: str = "counts") -> list[Column]:
    counts = F.col(into)
    posterior = 1 / (1 + F.exp(-log_odds(rules(counts), model)))
    failed = base_failed(counts)
    return [failed.alias("base_failed"), (~failed & (posterior >= KEEP_FROM)).alias("kept"), F.round(posterior, 6).alias("posterior")]


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts of BASE, base_failed, kept and posterior of every row."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = materialise(with_counts(narrow).select("doc_id", "counts"), "quality-counts")
    model = _fitted(counted, "counts")
    return counted.select("doc_id", *[F.col("counts")[c].alias(c) for c in BASE], *verdicts(counted, model))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without rejected rows; columns as they are.

    Everything is counted in one pass, whose rows are stored with their counts;
    the votes are estimated from the counts and the stored rows filtered by
    them, so that no text is shuffled or counted twice.
    """
    into = free_name(docs.columns, "counts")
    counted = materialise(with_counts(docs, text, into), "quality-counted")
    model = _fitted(counted, into)
    return counted.filter(verdicts(counted, model, into)[1]).drop(into)
