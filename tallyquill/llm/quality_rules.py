"""Quality rules: a table of thresholds compiled into one projection.

Every rule is a ratio of counts with a lower and an upper bound. The counts are built-in
column expressions, so that a scan and one projection give the verdict: no shuffle and no user
function.

Defined results. A null or empty text has no words and fails the length rule, as does a text
below ten words. A ratio whose divisor is zero is zero. Texts of any length are read whole.
Rows are judged alone: repeated rows and ties give equal verdicts, an empty table gives an
empty result. Columns besides id and text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyquill.llm.exprs import SPACE, let, split_words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

#: Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "a als an and are as at au auf aus aux avec be but by con como ce ces dans das de del dem den der des dich die "
    "du ein eine einen el elle en er es est esta et for from für ha had han has have he her his ich il ils im in is "
    "ist it je la las le les lo los man más mit ne nicht nous of on or ou par para pas plus por pour que qui sa se "
    "ses she sich sie sind so son su sur sus that the their they this to un una une und up von vous war was we were "
    "which will with wird y you zu zum zur"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= part / whole <= high`` for texts of ``words_from`` words or more."""

    name: str
    part: str
    whole: str
    low: float
    high: float
    words_from: int = LEAST_WORDS


#: The thresholds. Prose passes all of them with a wide margin; the stop-word rule waits for
#: texts long enough to have some.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.3),
    Rule("exclamations", "n_exclamations", "n_words", 0.0, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, 1.0, 60),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
)


def _kept(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, ""))


def _windows(words: Column) -> Column:
    """A 64-bit hash of each window of ``WINDOW`` words."""
    hashed = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    return F.when(
        F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), hashed)
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Number of words inside windows whose hash occurs twice or more: sort (hash, place),
    keep the places beside an equal hash, and add up the stretches they cover."""
    struct = lambda h, i: F.struct(h.alias("h"), i.alias("i"))

    def places(pairs: Column) -> Column:
        def beside(pair: Column, k: Column) -> Column:
            same = lambda at: F.coalesce(F.get(pairs, at)["h"] == pair["h"], F.lit(False))
            return F.when(same(k + 1) | same(k - 1), pair["i"])

        return F.sort_array(F.filter(F.transform(pairs, beside), lambda i: i.isNotNull()))

    def add(state: Column, place: Column) -> Column:
        fresh = F.greatest(F.least(place + WINDOW - state["until"], F.lit(WINDOW)), F.lit(0))
        return F.struct((place + WINDOW).alias("until"), (state["words"] + fresh).alias("words"))

    start = F.struct(F.lit(0).alias("until"), F.lit(0).alias("words"))
    repeated = let(F.sort_array(F.transform(windows, struct)), lambda pairs: F.aggregate(places(pairs), start, add))
    distinct = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(distinct, F.lit(0)).otherwise(repeated["words"])


def counts(text: Column) -> dict[str, Column]:
    """The counts that rules use, each a long, as expressions of one text column."""
    known = F.coalesce(text, F.lit(""))
    words = split_words(text)
    lines = F.filter(F.split(known, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    listed = let(
        words,
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).alias("n_stop_words"),
            let(_windows(w), _covered).alias("n_repeat_words"),
        ),
    )
    lined = let(
        lines,
        lambda x: F.struct(
            F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")
        ),
    )
    return {
        "listed": listed,
        "lined": lined,
        "word_chars": _kept(known, SPACE + "+"),
        "n_symbols": _kept(known, f"[^{SYMBOLS}]+"),
        "n_exclamations": _kept(known, "[^!]+"),
    }


COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_stop_words", "n_lines", "n_exclamations",
)


def measure(text: Column) -> Column:
    """All counts of a text as one struct of longs."""
    found = counts(text)
    fields = {
        "n_words": lambda s: s["listed"]["n_words"],
        "n_stop_words": lambda s: s["listed"]["n_stop_words"],
        "n_repeat_words": lambda s: s["listed"]["n_repeat_words"],
        "n_lines": lambda s: s["lined"]["n_lines"],
        "n_dup_lines": lambda s: s["lined"]["n_dup_lines"],
    }
    whole = F.struct(*[column.alias(name) for name, column in found.items()])
    return let(
        whole,
        lambda s: F.struct(*[fields.get(c, lambda s, c=c: s[c])(s).cast("long").alias(c) for c in COUNTS]),
    )


def base_failed(n: Column) -> Column:
    return (n["n_words"] < LEAST_WORDS) | (
        n["n_repeat_words"] * 100 > n["n_words"] * MOST_REPEATED_PERCENT
    )


def passes(n: Column, rule: Rule) -> Column:
    ratio = F.when(n[rule.whole] > 0, n[rule.part] / n[rule.whole]).otherwise(F.lit(0.0))
    return (n["n_words"] < rule.words_from) | ratio.between(rule.low, rule.high)


def verdict(n: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where the base tests and every rule of the table hold."""
    kept = ~base_failed(n)
    for rule in rules:
        kept = kept & passes(n, rule)
    return kept


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: its id, all counts, failed rules and the verdict."""
    n = F.col("n")
    failed = F.array_compact(F.array(*[F.when(~passes(n, rule), F.lit(rule.name)) for rule in rules]))
    return docs.select(F.col(id), measure(F.col(text)).alias("n")).select(
        F.col(id),
        "n.*",
        failed.alias("failed_rules"),
        base_failed(n).alias("base_failed"),
        verdict(n, rules).alias("kept"),
    )


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    return docs.where(let(measure(F.col(text)), lambda n: verdict(n, rules)))
