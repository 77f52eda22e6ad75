"""Quality rules as weak supervision, in DataFrame functions only.

Every rule looks at one statistic of a text and votes good (+1), bad (-1) or abstains (0). Expectation
maximisation over the counts of vote patterns estimates the share of good documents and, for each rule, how
often it gives each vote, or none, to good and to bad documents; a document's quality is then its posterior
probability given its votes, so one bad vote of a rule that errs is outvoted. A Dirichlet prior says which class
is the good one. Patterns number at most 3 ** len(RULES) whatever the input, so only they come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: What goes through unchanged is in one struct, so its names can't clash with those used here.
DOC = "_doc"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
_OWN = "_quality_"


def _c(name: str) -> Column:
    return F.col(_OWN + name)


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns _quality_<stat> of each text, and a struct DOC of the columns to keep.

    Words are runs without ASCII white space. Five-word windows are told apart by a 64-bit hash of the
    words' 64-bit hashes; two different windows of one text of n words coincide with odds of about
    n * n / 2e19. Time is n log n in a text's words, with no row per word and no shuffle.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias(DOC), F.col("text")).withColumn(_OWN + "words", F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != ""))
    df = df.withColumns({
        _OWN + "n_words": F.size(_c("words")).cast("long"),
        _OWN + "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        _OWN + "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        _OWN + "n_upper": F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")).cast("long"),
        _OWN + "n_chars": F.length(text).cast("long"),
        _OWN + "lines": lines,
        _OWN + "hashes": F.transform(_c("words"), lambda w: F.xxhash64(w)),
    })
    df = df.withColumns({
        _OWN + "n_lines": F.size(_c("lines")).cast("long"),
        _OWN + "n_dup_lines": (F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))).cast("long"),
        _OWN + "n_distinct": F.size(F.array_distinct(_c("hashes"))).cast("long"),
        _OWN + "windows": F.when(
            _c("n_words") >= WINDOW,
            F.transform(F.slice(_c("hashes"), 1, F.size(_c("hashes")) - (WINDOW - 1)), lambda _, i: F.xxhash64(*[F.get(_c("hashes"), i + k) for k in range(WINDOW)])),
        ),
    })
    # Only texts with a repeated window sort theirs, with positions; equal neighbours are repeats.
    df = df.withColumn(_OWN + "sorted", F.when(F.size(F.array_distinct(_c("windows"))) < F.size(_c("windows")), F.sort_array(F.transform(_c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda x, j, d: F.coalesce(F.get(_c("sorted"), j + d)["h"] == x["h"], F.lit(False))
    df = df.withColumn(_OWN + "starts", F.sort_array(F.transform(F.filter(_c("sorted"), lambda x, j: near(x, j, -1) | near(x, j, 1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform(_c("starts"), lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(_c("starts"), j + 1) - s, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    df = df.withColumn(_OWN + "n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    df = df.withColumn(_OWN + "base_failed", (_c("n_words") < 10) | (100 * _c("n_repeat_words") > 20 * _c("n_words")))
    found = [_OWN + x for x in (*STATS, "n_upper", "n_chars", "n_lines", "n_distinct")]
    # a generator of one row: no rule's filter is pushed below it, which would compute the statistics over and over
    return df.select(DOC, F.inline(F.array(F.struct(*found))))


def _rule(value: Column, good: Column, bad: Column, when: Column | None = None) -> Column:
    vote = F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))
    vote = F.coalesce(vote, F.lit(0))
    return (vote if when is None else F.when(when, vote).otherwise(F.lit(0))).cast("int")


def rules() -> dict[str, Column]:
    """Each rule's vote, from a statistic of its own. Between its two thresholds, or where a text is too short to tell, a rule abstains.

    Thresholds lie within what sound texts show too, so that rules err now and then and the others' votes can make up for it.
    """
    n = _c("n_words")
    mean = F.try_divide(_c("word_chars"), n)
    symbols = F.try_divide(_c("n_symbols"), n)
    dup = F.try_divide(_c("n_dup_lines"), _c("n_lines"))
    repeat = F.try_divide(_c("n_repeat_words"), n)
    upper = F.try_divide(_c("n_chars") - _c("n_upper"), _c("word_chars"))
    variety = F.try_divide(_c("n_distinct"), n)
    return {
        "length": _rule(n, n >= 150, n < 80),
        "word_length": _rule(mean, mean.between(4.5, 6), ~mean.between(4.2, 6.5), n >= 10),
        "symbols": _rule(symbols, symbols < 0.02, symbols > 0.05),
        "lines": _rule(dup, dup < 0.05, dup > 0.2, _c("n_lines") >= 4),
        "repeats": _rule(repeat, repeat < 0.05, repeat > 0.15, n >= 10),
        "upper": _rule(upper, upper < 0.03, upper > 0.05, _c("word_chars") >= 40),
        "variety": _rule(variety, variety > 0.75, variety < 0.65, n.between(20, 2000)),
    }


@dataclass
class VoteModel:
    """Share of good documents, and P(vote | class) by rule: rates[rule][class][vote + 1], class 1 good; a class's three add up to one."""

    good: float
    rates: dict[str, list[list[float]]]

    def evidence(self, name: str, vote: int) -> float:
        """The log of the ratio in which a vote moves the odds for good."""
        bad, good = self.rates[name]
        return math.log(good[vote + 1] / bad[vote + 1])

    def posterior(self, votes: dict[str, Column]) -> Column:
        z = F.lit(math.log(self.good / (1 - self.good)))
        for name, vote in votes.items():
            z = z + F.when(vote > 0, F.lit(self.evidence(name, 1))).when(vote < 0, F.lit(self.evidence(name, -1))).otherwise(F.lit(self.evidence(name, 0)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


#: The Dirichlet prior: the share of good documents, and the shares of votes (bad, none, good) in each class for any rule.
PRIOR_GOOD, PRIOR_RATES = 0.85, ((0.3, 0.2, 0.5), (0.02, 0.13, 0.85))
#: The prior counts as so many rows in all: it says which class is the good one and keeps rates from 0, and washes out as the data grow.
PRIOR_ROWS = 100.0


def estimate(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 500, pseudo: float = PRIOR_ROWS) -> VoteModel:
    """EM from (votes, count) patterns, till no posterior moves by 1e-6. An abstention is an outcome like another; with no rows the prior stands."""
    prior = (1 - PRIOR_GOOD, PRIOR_GOOD)
    model = VoteModel(PRIOR_GOOD, {n: [list(x) for x in PRIOR_RATES] for n in names})
    before: list[float] = []
    for _ in range(rounds if patterns else 0):
        z = [math.log(model.good / (1 - model.good)) + sum(model.evidence(n, v) for n, v in zip(names, votes, strict=True)) for votes, _ in patterns]
        good = [1 / (1 + math.exp(-max(-50.0, min(50.0, x)))) for x in z]
        if before and max(abs(a - b) for a, b in zip(good, before, strict=True)) < 1e-6:
            break
        before = good
        mass = [pseudo * q for q in prior]
        seen = {n: [[pseudo * q * x + 1e-9 for x in PRIOR_RATES[k]] for k, q in enumerate(prior)] for n in names}
        for (votes, count), p in zip(patterns, good, strict=True):
            for k, q in ((0, (1 - p) * count), (1, p * count)):
                mass[k] += q
                for n, v in zip(names, votes, strict=True):
                    seen[n][k][v + 1] += q
        model = VoteModel(mass[1] / sum(mass), {n: [[x / sum(row) for x in row] for row in seen[n]] for n in names})
    return model


def learn(stats: DataFrame) -> VoteModel:
    """EM over the vote patterns of all rows that with_stats() gave."""
    votes = rules()
    rows = stats.select(*[v.alias(n) for n, v in votes.items()]).groupBy(*votes).count().collect()
    return estimate(sorted((tuple(r[n] for n in votes), r["count"]) for r in rows), list(votes))


def score(stats: DataFrame, model: VoteModel) -> DataFrame:
    """`stats` with _quality_posterior and _quality_kept: the posterior is at least one half and the base rules passed."""
    out = stats.withColumn(_OWN + "posterior", model.posterior(rules()))
    return out.withColumn(_OWN + "kept", ~_c("base_failed") & (_c("posterior") >= 0.5))


def rate_quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and quality (the posterior), one row per input row.

    Null and empty texts have no words: zeros, base_failed true. A null doc_id stays null; repeated rows
    each give a row; an empty table gives none; other columns are ignored. A very long text is one row's arrays of words, in memory in proportion to
    it; a posterior of exactly one half is kept. The texts are read once: their
    statistics, a few numbers a row, go to the checkpoint folder, and both EM and scoring read those.
    """
    stats = with_stats(docs, ["doc_id"]).checkpoint()
    out = score(stats, learn(stats))
    return out.select(DOC + ".doc_id", *[_c(x).alias(x) for x in STATS], _c("kept").alias("kept"), _c("posterior").alias("quality"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with the columns of `docs`, whatever they are called.

    Null and empty texts fail the base rules, so their rows go; a null doc_id or other column stays null; repeated rows
    share a verdict; an empty table gives none; very long texts and ties as in rate_quality(). Rows and statistics go to the checkpoint folder, so each is computed once.
    """
    stats = with_stats(docs, docs.columns).checkpoint()
    return score(stats, learn(stats)).where(_c("kept")).select(DOC + ".*")
