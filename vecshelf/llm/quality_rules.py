"""Quality rules whose cutoffs come with a guarantee.

Each rule rejects texts beyond a cutoff of one measure. For each stratum of
the corpus and each cutoff of a grid fixed beforehand, labelled good texts
that the rule would reject are counted, and the exact binomial test asks
whether the true share of good texts rejected may exceed the rule's part of
the allowed risk. A cutoff is certified only if that is refused at a level
divided by the number of all tests made (Bonferroni), so with probability
``1 - DELTA`` every certified cutoff in every stratum holds its limit. Of the
certified ones each rule takes the strictest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecshelf.llm.common import text_udf
from vecshelf.session import written

#: Share of a stratum's good texts that all rules together may reject, and the chance that this fails anywhere.
RISK, DELTA = 0.05, 0.05
WINDOW = 3
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)

#: measure, whether high values are bad, first cutoff, step, number of cutoffs (fixed beforehand)
RULES = (
    ("symbol_share", True, 0.0, 0.01, 32),
    ("dup_line_share", True, 0.0, 0.03, 32),
    ("repeat_share", True, 0.0, 0.03, 32),
    ("capital_share", True, 0.0, 0.03, 32),
    ("word_length", True, 4.0, 0.5, 32),
    ("word_length_low", False, 6.0, -0.15, 32),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def counts(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of a whole text; NULL as empty."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    spaces = int(seen[[9, 10, 11, 12, 13, 32]].sum())
    points = len(text) - int(seen[128:192].sum())  # bytes that go on with a code point don't start one
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        n,
        points - spaces,
        int(seen[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
        int(seen[65:91].sum()),
    )


def repeated(words: list[bytes]) -> int:
    """Words inside windows of three words that are found twice or more."""
    if len(words) <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # pairs first, numbered anew, so that no product overflows
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    window = pair[:-1] * len(number) + ids[2:]
    _, at, times = np.unique(window, return_inverse=True, return_counts=True)
    again = times[at] > 1
    hit = np.zeros(len(words), bool)
    for i in range(WINDOW):
        hit[i : i + len(again)] |= again
    return int(hit.sum())


def counts_column(text: str = "text") -> Column:
    def run(texts: list[bytes | None]) -> pa.Array:
        rows = [counts(t) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))], list(COUNTS))

    return text_udf(run, ", ".join(f"{c} long" for c in COUNTS))(F.col(text))


def _measures() -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    length = share("word_chars", "n_words")
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "capital_share": share("n_capitals", "word_chars"),
        "word_length": length,
        "word_length_low": length,
    }


def _strictness(rule: tuple) -> Column:
    """How many of the rule's cutoffs reject a text: cutoffs are counted from
    the strictest, so the text is rejected by cutoff j if j is below this."""
    name, high, first, step, n = rule
    value = _measures()[name]
    beyond = (value - first) / step  # cutoff j is first + j * step, for either direction
    # exact at the cutoffs: a text on a cutoff isn't beyond it
    return F.greatest(F.lit(0), F.least(F.lit(n), F.ceil(F.round(beyond, 9)))).cast("int")


def exact_tail(failures: int, n: int, risk: float) -> float:
    """P(X <= failures) of a binomial with ``n`` draws of probability ``risk``:
    the level at which a true share above ``risk`` is refused."""
    if n == 0 or failures >= n:
        return 1.0
    j = np.arange(1, failures + 1)
    steps = np.log((n - j + 1) / j) + np.log(risk / (1 - risk))
    terms = np.concatenate(([0.0], np.cumsum(steps))) + n * np.log1p(-risk)
    top = terms.max()
    return float(min(1.0, np.exp(top) * np.exp(terms - top).sum()))


def certified_cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, one int column for each rule): the strictest certified cutoff
    of each rule, NULL where none is.

    ``labelled``: a stratum and COUNTS of good texts. Each stratum's texts are
    reduced to a histogram over a rule's cutoffs, in Spark; the tests run on
    those, a few numbers for each stratum and rule.
    """
    sides = [F.struct(F.lit(i).alias("rule"), _strictness(r).alias("hit")) for i, r in enumerate(RULES)]
    cells = labelled.select("stratum", F.explode(F.array(*sides)).alias("x")).groupBy("stratum", "x.rule", "x.hit").agg(F.count("*").alias("n"))
    shapes = cells.groupBy("stratum", "rule").agg(F.collect_list(F.struct("hit", "n")).alias("cells"))
    shapes = written(shapes, "rule-cells")
    strata = shapes.select("stratum").distinct().count()
    tests = max(1, strata) * sum(r[-1] for r in RULES)

    @F.pandas_udf("int")
    def strictest(rules: pd.Series, shape: pd.Series) -> pd.Series:
        found = [strictest_cutoff({c["hit"]: c["n"] for c in x}, RULES[r][-1], risk / len(RULES), delta / tests) for r, x in zip(rules, shape, strict=True)]
        return pd.Series(found, dtype="Int32")

    cut = shapes.withColumn("cutoff", strictest("rule", "cells"))
    best = cut.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == i, F.col("cutoff"))).alias(f"cut_{r[0]}") for i, r in enumerate(RULES)))
    return written(best, "cutoffs")


def strictest_cutoff(shape: dict[int, int], cutoffs: int, risk: float, level: float) -> int | None:
    """The first cutoff for which a true rejected share above ``risk`` is
    refused at ``level``. ``shape``: texts by how many cutoffs reject them."""
    total = sum(shape.values())
    for cutoff in range(cutoffs):
        rejected = sum(n for hit, n in shape.items() if hit > cutoff)
        if rejected <= risk * total and exact_tail(rejected, total, risk) <= level:
            return cutoff
    return None


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    risk: float = RISK,
    delta: float = DELTA,
) -> DataFrame:
    """COUNTS, base_failed, kept and the first rule broken of each row.

    NULL and empty texts have no words and fail the base. A NULL stratum is a
    stratum. Strata without enough labelled good texts certify nothing, so
    there only the base decides. A repeated labelled id counts once and is
    good if any of its labels is; NULL labels and keys are no labels.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), counts_column(text).alias("c"))
    rows = written(rows.select("key", "stratum", "c.*"), "rule-counts")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("q")).where("q <> 0")
    held = rows.where(~failed).join(good.select(F.col("doc_id").alias("key")), "key", "left_semi")
    cutoffs = certified_cutoffs(held, risk, delta)
    judged = rows.join(cutoffs, "stratum", "left").withColumn("base_failed", failed)
    broken = F.coalesce(*(F.when(_strictness(r) > F.col(f"cut_{r[0]}"), F.lit(r[0])) for r in RULES))
    judged = judged.withColumn("rule", F.when(~F.col("base_failed"), broken))
    return judged.select(F.col("key").alias(key), *COUNTS, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
