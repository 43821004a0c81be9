"""Quality rules under weak supervision, in DataFrame functions alone.

Each rule votes a document good (1) or bad (-1), or abstains (0). Bad documents are held to be of several kinds, one for what each
rule looks for, since a fault is mostly seen by one rule while the others find nothing wrong. Expectation-maximisation
estimates, without labels, the share of good documents and of each kind, and how often each rule that votes is against each of them, from
the counts of vote patterns (at most 3 ** rules rows) of the documents that pass the base conditions. An abstention says nothing: it has
no rate and no part in the likelihood. Each document's posterior probability of being good then decides, instead of a demand
that every rule be passed: a single bad vote of a rule that is often wrong is outvoted.

Null, empty or blank texts have no words: they fail the base conditions and all rules abstain, so their posterior is the share of good
documents. An empty table gives an empty
table. Very long texts are measured whole, in memory of the order of the text. Nothing depends on other columns, whatever their
names, or on row order; repeated rows count each, and ties can't arise: equal votes have equal posteriors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

#: White space between words: space and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
ROUNDS = 30
KEEP_AT = 0.5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _less(text: Column, chars: str) -> Column:
    """Code points of text that are none of these."""
    return F.length(F.translate(text, chars, ""))


def _covered(places: Column) -> Column:
    """Words in three-word windows that start at these sorted places."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).cast("long").alias("last"))
    step = lambda a, p: F.struct((a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum"), p.alias("last"))
    return F.aggregate(places, start, step, lambda a: a["sum"])


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that the text has twice or more."""

    def of_windows(hashes: Column) -> Column:
        def of_pairs(pairs: Column) -> Column:
            # Sorted by (hash, place), so equal windows are neighbours.
            same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
            again = F.filter(pairs, lambda _, i: same(i, i + 1) | ((i > 0) & same(i, i - 1)))
            return _covered(F.sort_array(F.transform(again, lambda x: x["p"])))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("p"))))
        # Texts without a repeated window need no sort.
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(pairs, of_pairs))

    windows = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return _let(windows, of_windows)


def measures(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and, per text, MEASURES and what the rules need besides: n_lines, n_upper, n_marks, n_digits, n_stops."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    base = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAP)).alias("words"))
    chars = F.length("text")
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        _less(F.col("text"), WHITE).cast("long").alias("word_chars"),
        (chars - _less(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (chars - _less(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
        (chars - _less(F.col("text"), "!?=_~^@+")).cast("long").alias("n_marks"),
        (chars - _less(F.col("text"), "0123456789")).cast("long").alias("n_digits"),
        (chars - _less(F.col("text"), ".,;:")).cast("long").alias("n_stops"),
    )


def _rule(bad: Column, good: Column) -> Column:
    return F.when(F.col("n_words") == 0, 0).when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """Votes by name, over the columns of measures(). Between its two limits a rule abstains."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    symbols, upper, digits = (F.col(c) / chars for c in ("n_symbols", "n_upper", "n_digits"))
    marks, stops, repeats, length = (F.col(c) / words for c in ("n_marks", "n_stops", "n_repeat_words", "word_chars"))
    same = F.col("n_dup_lines") / lines
    return {
        "symbols": _rule(symbols > 0.03, symbols < 0.01),
        "capitals": _rule(upper > 0.1, upper < 0.05),
        "marks": _rule(marks > 0.05, marks < 0.02),
        "digits": _rule(digits > 0.03, digits < 0.01),
        "repeats": _rule(repeats > 0.3, repeats < 0.2),
        "lines": _rule(same > 0.3, same < 0.2),
        "word_length": _rule((length < 4) | (length > 8), (length > 4.5) & (length < 7)),
        "stops": _rule((stops < 0.08) | (stops > 0.25), (stops > 0.1) & (stops < 0.2)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Where expectation-maximisation starts: the share of good documents; how a rule that votes does so (bad, good) on good ones and on bad
#: ones of another kind, and on the kind that it looks for.
SHARE, OFF, ON = 0.8, (0.06, 0.94), (0.875, 0.125)
#: The starting values stay as a prior that weighs as much as so many documents, however many there are.
PRIOR = 20
#: Per kind its share, and per kind and rule how often its votes are bad, and good. Kind 0 is good.
Model = tuple[list[float], list[list[list[float]]]]


def start(n_rules: int) -> Model:
    kinds = range(n_rules + 1)
    shares = [SHARE if k == 0 else (1 - SHARE) / n_rules for k in kinds]
    return shares, [[list(ON if k == j + 1 else OFF) for j in range(n_rules)] for k in kinds]


def _kinds(votes: tuple[int, ...], logs: Model) -> list[float]:
    """The posterior of each kind; logs: the model's logarithms."""
    odds = [s + sum(r[v > 0] for r, v in zip(own, votes) if v) for s, own in zip(*logs)]
    most = max(odds)
    parts = [math.exp(x - most) for x in odds]
    total = sum(parts)
    return [x / total for x in parts]


def _logs(model: Model) -> Model:
    return [math.log(s) for s in model[0]], [[[math.log(x) for x in r] for r in own] for own in model[1]]


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS, prior: float = PRIOR) -> Model:
    """Shares and rates by expectation-maximisation. patterns: documents by votes."""
    n = len(next(iter(patterns), ()))
    first = start(n)
    model = first
    for _ in range(rounds):
        logs = _logs(model)
        shares = [prior * s for s in first[0]]
        rates = [[[prior * s * x for x in r] for r in own] for s, own in zip(*first)]
        for votes, count in patterns.items():
            for k, p in enumerate(_kinds(votes, logs)):
                p *= count
                shares[k] += p
                for own, v in zip(rates[k], votes):
                    if v:
                        own[v > 0] += p
        total = sum(shares)
        model = [s / total for s in shares], [[[x / sum(r) for x in r] for r in own] for own in rates]
    return model


def posterior_of(votes: tuple[int, ...], model: Model) -> float:
    return _kinds(votes, _logs(model))[0]


def _posterior(names: list[str], model: Model) -> Column:
    """The same, of columns of votes."""
    shares, rates = _logs(model)
    others = F.lit(1.0)
    for k in range(1, len(shares)):
        odds = F.lit(shares[k] - shares[0])
        for name, own, good in zip(names, rates[k], rates[0]):
            bad, well = (x - y for x, y in zip(own, good))
            odds = odds + F.when(F.col(name) < 0, bad).when(F.col(name) > 0, well).otherwise(0.0)
        others = others + F.exp(odds)
    return 1 / others


def score_quality(docs: DataFrame, id_col="doc_id", text_col="text", keep_at: float = KEEP_AT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, MEASURES, base_failed, kept, posterior, and a vote_<rule> for each rule."""
    votes = rules()
    found = stored(measures(docs, id_col, text_col).withColumns({f"vote_{k}": v for k, v in votes.items()}), "measures")
    names = [f"vote_{k}" for k in votes]
    # At most 3 ** 8 rows.
    patterns = {tuple(r[:-1]): r[-1] for r in found.where(~base_failed()).groupBy(*names).count().collect()}
    model = estimate(patterns, rounds) if patterns else start(len(names))
    found = found.withColumn("posterior", _posterior(names, model)).withColumn("base_failed", base_failed())
    found = found.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))
    return found.select("doc_id", *MEASURES, "base_failed", "kept", "posterior", *names)


def filter_quality(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The documents that are kept, with their columns."""
    key = fresh(docs, "kept_id")
    kept = score_quality(docs, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(F.col(key)), "left_semi")
