"""Quality rules combined by weak supervision.

Each rule votes that a document is good (1), bad (-1), or abstains (0). Expectation-maximisation over the
counts of vote patterns estimates, for the good and the bad class, how often each rule casts each vote; the
posterior probability of the good class replaces the demand that every rule pass. DataFrame functions only:
documents are scanned once, the table of patterns has at most 3 to the number of rules rows, and each round
is one aggregate over it whose single row of sums comes back to the driver.

Cases: a null or empty text has no words and fails the base test; rows that repeat are scored alike; an
empty table gives an empty result; other columns are kept and never read, whatever they are called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itspark.llm.common import staged, text_of


def one_of(chars: str, but: bool = False) -> str:
    """A regular expression for one of the characters, or any other one; spelled out they are looked up, not compared in turn."""
    return f"[{'^' if but else ''}{''.join(f'\\x{ord(c):02X}' for c in chars)}]"


SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Printable ASCII characters that are no letters.
NOT_LETTERS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())
SYMBOLS = "#*$%&|<>"
INSIDE = one_of(SPACE, but=True)
#: A symbol and what follows it in its word: one match in each word that has any.
SYMBOL_WORD = f"{one_of(SYMBOLS)}{INSIDE}*+"
#: A whole word of ASCII characters that are no letters.
BARE = one_of("".join(chr(c) for c in range(128) if not chr(c).isalpha() and chr(c) not in SPACE))
BARE_WORD = f"{BARE}(?<!{INSIDE}{BARE}){BARE}*+(?!{INSIDE})"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_ended_lines", "n_capitals", "n_shouts", "n_symbol_words", "n_bare_words", "n_plain", "n_digits")

#: Name, the share that the rule looks at, where it votes bad, and where good. Most rules only know bad
#: documents when they see them: a text without symbols may be anything. Several look at the same kind of junk
#: from different sides, and some are known to be often wrong; how far each is believed is estimated.
RULES = (
    ("length", "n_words", "x < 50", "x >= 80"),
    ("word_length", "word_chars / n_words", "x < 3 or x > 12", "x >= 4 and x <= 9"),
    ("symbols", "n_symbols / n_words", "x > 0.1", "false"),
    ("symbol_words", "n_symbol_words / n_words", "x > 0.1", "x < 0.01"),
    ("plain_letters", "n_plain / word_chars", "x < 0.88", "x >= 0.94"),
    ("bare_words", "n_bare_words / n_words", "x > 0.15", "x < 0.02"),
    ("digits", "n_digits / word_chars", "x > 0.02", "false"),
    ("dup_lines", "n_dup_lines / n_lines", "x > 0.3", "false"),
    ("repeats", "n_repeat_words / n_words", "x > 0.45", "x < 0.2"),
    ("capitals", "n_capitals / word_chars", "x > 0.3", "false"),
    ("shouts", "n_shouts / n_words", "x > 0.1", "false"),
    ("ended_lines", "n_ended_lines / n_lines", "x < 0.1", "x > 0.5"),
)
#: What is believed before: so much of a rule's votes is right, as if seen in so many votes, and so much of the
#: documents is good, as if seen in so many documents. The numbers do not grow with the table.
ACCURACY, SHARE, TRUST = 0.9, 0.8, 30.0
#: A document is kept if it is good with this probability.
THRESHOLD = 0.8


def how_many(text: Column, chars: str) -> Column:
    """How many of the characters, which are ASCII, are in the text; runs of them count by their length."""
    return F.octet_length(F.array_join(F.regexp_extract_all(text, F.lit(one_of(chars) + "++"), F.lit(0)), "")).cast("long")


def with_statistics(df: DataFrame, text: Column) -> DataFrame:
    """Add the counts that the rules look at, in columns named ``_<count>``.

    Each triple of words is a number whose upper 33 bits are of its hash and whose lower 31 are its place. Few
    triples share the upper bits with a neighbour among the sorted numbers, and only these are compared by their
    words. Lambdas are evaluated element by element, so there are two for each word and no more; what can be
    counted in the text is counted there. Arrays that several expressions look at are columns of their own.
    """
    df = df.withColumn("_text", text)
    df = df.withColumns(
        {
            "_words": F.array_remove(F.split("_text", one_of(SPACE) + "+"), ""),
            "_lines": F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
            # The runs of such characters, apart from each other; few where there is much text.
            "_marks": F.array_join(F.regexp_extract_all("_text", F.lit(one_of(NOT_LETTERS) + "++"), F.lit(0)), " "),
            "_n_capitals": F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long"),
            "_n_symbol_words": F.regexp_count("_text", F.lit(SYMBOL_WORD)).cast("long"),
            "_n_bare_words": F.regexp_count("_text", F.lit(BARE_WORD)).cast("long"),
        }
    ).drop("_text")
    df = df.withColumns(
        {
            "_n_words": F.size("_words").cast("long"),
            "_word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "_triples": F.expr(
                "if(size(_words) < 3, array(), sort_array(transform(sequence(0L, size(_words) - 3L), "
                "i -> (xxhash64(_words[i], _words[i + 1], _words[i + 2]) & -2147483648L) | i)))"
            ).cast("array<bigint>"),
            "_n_symbols": how_many(F.col("_marks"), SYMBOLS),
            "_n_digits": how_many(F.col("_marks"), "0123456789"),
            "_n_shouts": F.regexp_count("_marks", F.lit(r"[!?]{2,}")).cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_n_ended_lines": F.size(F.filter("_lines", lambda x: F.right(F.rtrim(x, F.lit(SPACE)), F.lit(1)).isin(*".!?\"')"))).cast("long"),
        }
    ).drop("_lines")
    # What is neither white space nor a mark: letters, and all beyond ASCII.
    df = df.withColumn("_n_plain", F.col("_word_chars") - how_many(F.col("_marks"), NOT_LETTERS)).drop("_marks")
    df = df.withColumn(
        "_same",
        F.expr(
            "if(size(_triples) < 2, array(), filter(sequence(1, size(_triples) - 1), k -> shiftrightunsigned(_triples[k - 1] ^ _triples[k], 31) = 0))"
        ).cast("array<int>"),
    )
    df = df.withColumn(
        "_places",
        F.expr("transform(array_distinct(flatten(transform(_same, k -> array(_triples[k - 1], _triples[k])))), x -> x & 2147483647L)"),
    ).drop("_triples", "_same")
    df = df.withColumn(
        "_alike", F.expr("sort_array(transform(_places, i -> struct(struct(_words[i] as a, _words[i + 1] as b, _words[i + 2] as c) as w, i as i)))")
    ).drop("_places", "_words")
    df = df.withColumn(
        "_found", F.expr("sort_array(transform(filter(_alike, (x, k) -> x.w = get(_alike, k - 1).w or x.w = get(_alike, k + 1).w), x -> x.i))")
    ).drop("_alike")
    # A repeated triple covers three words, fewer where the next one starts earlier.
    covered = "aggregate(transform(_found, (x, k) -> least(3L, coalesce(get(_found, k + 1) - x, 3L))), 0L, (a, b) -> a + b)"
    return df.withColumn("_n_repeat_words", F.expr(covered)).drop("_found")


def base_failed(prefix: str = "_") -> Column:
    """Too short, or more than half of it repeated."""
    return (F.col(f"{prefix}n_words") < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * F.col(f"{prefix}n_words"))


def votes() -> dict[str, Column]:
    """One vote per rule; a rule whose share has nothing to divide by abstains."""

    def ratio(share: str) -> str:
        top, _, under = share.partition(" / ")
        return f"(_{top} / nullif(_{under}, 0))" if under else f"_{top}"

    def vote(share: str, bad: str, good: str) -> Column:
        x = ratio(share)
        return F.expr(f"case when {bad.replace('x', x)} then -1 when {good.replace('x', x)} then 1 else 0 end").cast("tinyint")

    return {f"_vote_{name}": vote(share, bad, good) for name, share, bad, good in RULES}


@dataclass
class VoteModel:
    """Prior of the good class, and log ratios of each vote's probability in the good and the bad class."""

    prior: float
    log_ratio: dict[str, dict[int, float]]

    def posterior(self) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, of in self.log_ratio.items():
            odds = odds + F.when(F.col(rule) == 1, of[1]).when(F.col(rule) == -1, of[-1]).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame, rounds: int = 40, tolerance: float = 1e-3, accuracy: float = ACCURACY, share: float = SHARE, trust: float = TRUST) -> VoteModel:
    """Expectation-maximisation over the pattern counts of a staged table with vote columns.

    At first a document is believed bad if any rule says so. The estimate is the posterior mode under a prior
    that is worth ``trust`` votes of each rule, of which ``accuracy`` are right, and as many documents, of which
    ``share`` are good: in a table of some thousands the data decide. Abstaining says nothing.
    """
    rules = [f"_vote_{r[0]}" for r in RULES]
    patterns = staged(voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")), "patterns").coalesce(1)
    belief = F.when(F.least(*[F.col(r) for r in rules]) == -1, 0.1).otherwise(0.9)
    model = VoteModel(0.5, {r: {-1: 0.0, 1: 0.0} for r in rules})
    for _ in range(rounds):
        good, bad = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = patterns.withColumn("p", belief).agg(
            F.sum(good).alias("good"),
            F.sum(bad).alias("bad"),
            *[F.sum(F.when(F.col(r) == v, c)).alias(f"{r} {v} {k}") for r in rules for v in (-1, 1) for k, c in (("good", good), ("bad", bad))],
        ).first()
        if sums["good"] is None:
            break

        def chance(r: str, v: int, k: str) -> float:
            """Probability of the vote in the class."""
            right = accuracy if (v == 1) == (k == "good") else 1 - accuracy
            return ((sums[f"{r} {v} {k}"] or 0.0) + trust * right) / (sums[k] + trust)

        prior = (sums["good"] + trust * share) / (sums["good"] + sums["bad"] + trust)
        new = VoteModel(prior, {r: {v: math.log(chance(r, v, "good") / chance(r, v, "bad")) for v in (-1, 1)} for r in rules})
        moved = max(abs(prior - model.prior), *(abs(new.log_ratio[r][v] - model.log_ratio[r][v]) for r in rules for v in (-1, 1)))
        model = new
        belief = model.posterior()
        if moved < tolerance:
            break
    return model


def score(df: DataFrame, text_column: str = "text", threshold: float = THRESHOLD, body: bool = True) -> DataFrame:
    """Each row, whole in ``row``, with ``_<count>``, ``_base_failed``, ``_posterior`` and ``_kept``.

    Without ``body`` the row goes without its text, which then is read and not written.

    A document is kept if it passes the base test and its posterior is at least ``threshold``.
    """
    rows = df.select(F.struct("*").alias("row")).withColumn("_text", text_of(f"row.{text_column}"))
    if not body:
        rows = rows.withColumn("row", F.col("row").dropFields(text_column))
    voted = staged(with_statistics(rows, F.col("_text")).withColumns(votes()), "votes")
    posterior = fit(voted).posterior()
    return voted.withColumn("_base_failed", base_failed()).withColumn("_posterior", posterior).withColumn(
        "_kept", ~F.col("_base_failed") & (F.col("_posterior") >= threshold)
    )
