"""Quality rules learned as an ordered list of threshold conjunctions, by built-in functions only.

Fitting is sequential covering. The labelled documents (a bounded sample) become one row of
statistics each, cut into bins. A rule starts empty and grows by the threshold that most raises
the share of bad documents among those it covers; it is then pruned from its end on documents it
was not grown on, and kept only if it stays precise there. What it covers leaves the table and
the next rule is grown. Every step is one small aggregation by (statistic, bin, label).

Thresholds lie half-way between a bin's edge and the bad documents beyond it. The result is a Spark conditional expression over the statistics; applying it is one pass over
the texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, spare_name, words_of, written

SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 5

#: Statistics a rule may test, as SQL over the counts of ``with_counts``.
FEATURES = {
    "symbol_share": "n_symbols / n_chars",
    "upper_share": "n_upper / n_chars",
    "digit_share": "n_digits / n_chars",
    "mark_share": "n_marks / n_chars",
    "word_length": "word_chars / n_words",
    "distinct_share": "n_distinct / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
}

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_chars", "n_upper", "n_digits", "n_marks", "n_distinct", "n_lines",
)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"coalesce({self.feature} {'>' if self.above else '<='} {self.threshold!r}D, false)"


@dataclass(frozen=True)
class Rule:
    """Documents for which all conditions hold are rejected."""

    conditions: tuple[Condition, ...]

    def sql(self) -> str:
        return " and ".join(c.sql() for c in self.conditions)


def with_counts(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` plus the counts of each whole text, their names after ``prefix``.

    A null text counts as empty: all counts are zero. Windows of five words are compared by
    64-bit hashes within one text.
    """
    p = prefix
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns]

    def count(pattern: str) -> Column:
        """Characters left when the pattern's runs are gone."""
        return F.length(F.regexp_replace(text, pattern, "")).cast("long")

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    first = docs.select(
        *kept,
        words_of(text).alias(f"{p}words"),
        lines.alias(f"{p}lines"),
        F.length(text).cast("long").alias(f"{p}n_chars"),
        count("[\\x20\\x09-\\x0D]+").alias(f"{p}word_chars"),
        count(SYMBOLS).alias(f"{p}n_symbols"),
        count("[^A-Z]+").alias(f"{p}n_upper"),
        count("[^0-9]+").alias(f"{p}n_digits"),
        count("[^!?]+").alias(f"{p}n_marks"),
    )
    w = F.col(f"{p}words")
    n = F.size(w)
    starts = F.sequence(F.lit(0), n - WINDOW)
    windows = F.when(
        n > WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    )
    second = first.select(
        *kept,
        *[F.col(f"{p}{c}") for c in ("n_chars", "word_chars", "n_symbols", "n_upper", "n_digits", "n_marks")],
        n.cast("long").alias(f"{p}n_words"),
        F.size(F.array_distinct(w)).cast("long").alias(f"{p}n_distinct"),
        F.size(f"{p}lines").cast("long").alias(f"{p}n_lines"),
        (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long").alias(f"{p}n_dup_lines"),
        windows.alias(f"{p}windows"),
    )
    h = F.col(f"{p}windows")
    repeated = F.size(F.array_distinct(h)) < F.size(h)
    ordered = F.when(
        repeated, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    )
    counts = [f"{p}{c}" for c in COUNTS if c != "n_repeat_words"]
    third = second.select(*kept, *counts, ordered.alias(f"{p}ordered"))
    o = F.col(f"{p}ordered")
    again = F.filter(
        o,
        lambda x, k: F.coalesce(F.get(o, k - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False)),
    )
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    fourth = third.select(*kept, *counts, places.alias(f"{p}places"))
    at = F.col(f"{p}places")
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("end")),
        lambda s, i: F.struct(
            (s["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), s["end"] - i)).cast("long").alias("n"),
            (i + WINDOW).alias("end"),
        ),
        lambda s: s["n"],
    )
    return fourth.select(*kept, *counts, F.coalesce(covered, F.lit(0).cast("long")).alias(f"{p}n_repeat_words"))


def with_features(counted: DataFrame, prefix: str = "") -> DataFrame:
    """Adds the statistics as columns of their own names; null where nothing is there to divide."""
    exprs = {}
    for name, sql in FEATURES.items():
        top, bottom = sql.split(" / ")
        exprs[f"{prefix}{name}"] = F.expr(f"{prefix}{top} / nullif({prefix}{bottom}, 0)")
    return counted.withColumns(exprs)


def _sample(labels: DataFrame, rows: int, id_col: str, label_col: str) -> DataFrame:
    """At most ``rows`` labelled ids, by hash: the same ones on every run."""
    one = labels.where(f"`{id_col}` is not null and `{label_col}` is not null").select(
        F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("good")
    )
    return one.orderBy(F.xxhash64("label_id"), "label_id", "good").limit(rows)


def learn(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 8192, bins: int = 16, max_rules: int = 8,
    max_conditions: int = 3, min_precision: float = 0.75, min_covered: int = 3,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> list[Rule]:
    """The ordered rules for bad documents (label 0).

    ``max_labelled`` bounds the labelled rows used; all else is independent of the data's size.
    Labels without a document, null labels and null ids are ignored; an id labelled twice or
    found twice counts as often as it occurs. Without bad documents there are no rules.
    """
    sample = _sample(labels, max_labelled, id_col, label_col)
    texts = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text"))
    # At most max_labelled narrow rows: a proven bound.
    chosen = texts.join(F.broadcast(sample), F.col("sample_id") == F.col("label_id")).select("label_id", "good", "text")
    stats = written(
        with_features(with_counts(chosen)).select(
            "good", (F.pmod(F.xxhash64("label_id", F.lit("prune")), F.lit(3)) == 0).alias("held"), *FEATURES
        ),
        "rule-stats",
    )
    cuts = stats.agg(
        *[
            F.percentile_approx(f, [k / bins for k in range(1, bins)], 2000).alias(f)
            for f in FEATURES
        ]
    ).first()
    thresholds = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
    binned = stats.select(
        "*",
        *[
            F.when(F.col(f).isNotNull(), sum((F.when(F.col(f) > t, 1).otherwise(0) for t in thresholds[f]), F.lit(0))).alias(f"{f}_bin")
            for f in FEATURES
        ],
    )
    rules: list[Rule] = []
    while len(rules) < max_rules:
        open_rows = binned.where(" and ".join(["true", *(f"not ({r.sql()})" for r in rules)]))
        grown = open_rows.where("not held")
        conditions = _widen(grown, _grow(grown, thresholds, max_conditions))
        rule = _prune(open_rows.where("held"), conditions, min_precision, min_covered)
        if rule is None:
            break
        rules.append(rule)
    return rules


def _grow(rows: DataFrame, thresholds: dict[str, list[float]], max_conditions: int) -> list[Condition]:
    """Conditions added one by one while the share of bad rows among the covered ones rises."""
    conditions: list[Condition] = []
    while len(conditions) < max_conditions:
        covered = rows.where(Rule(tuple(conditions)).sql()) if conditions else rows
        pairs = F.explode(
            F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"{f}_bin").alias("bin")) for f in thresholds])
        )
        # At most (statistics x bins x labels) rows come back, whatever the table's size.
        cells = covered.select("good", pairs.alias("c")).groupBy("c.f", "c.bin", "good").count().collect()
        bad_all = sum(r["count"] for r in cells if r.good == 0 and r.f == next(iter(thresholds)))
        good_all = sum(r["count"] for r in cells if r.good != 0 and r.f == next(iter(thresholds)))
        if not bad_all or not good_all:
            break
        best = None
        for f, cuts in thresholds.items():
            own = [r for r in cells if r.f == f and r.bin is not None]
            for k, threshold in enumerate(cuts):
                for above in (True, False):
                    part = [r for r in own if (r.bin > k) == above]
                    bad = sum(r["count"] for r in part if r.good == 0)
                    good = sum(r["count"] for r in part if r.good != 0)
                    if bad and good < good_all:
                        # Bad rows kept, weighted by how much purer they are than before.
                        gain = bad * (bad / (bad + good) - bad_all / (bad_all + good_all))
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, Condition(f, above, threshold))
        if best is None:
            break
        conditions.append(best[1])
    return conditions


def _widen(rows: DataFrame, conditions: list[Condition]) -> list[Condition]:
    """Thresholds moved half-way to the bad rows they cover, which leaves good rows a margin."""
    if not conditions:
        return []
    bad = rows.where(Rule(tuple(conditions)).sql()).where("good = 0")
    edges = bad.agg(
        *[
            F.percentile_approx(c.feature, 0.05 if c.above else 0.95, 2000).alias(f"c{k}")
            for k, c in enumerate(conditions)
        ]
    ).first()
    return [
        Condition(c.feature, c.above, (c.threshold + edges[f"c{k}"]) / 2) for k, c in enumerate(conditions)
    ]


def _prune(held: DataFrame, conditions: list[Condition], min_precision: float, min_covered: int) -> Rule | None:
    """The shortest head of the conditions that is most precise on rows held back."""
    heads = [Rule(tuple(conditions[: k + 1])) for k in range(len(conditions))]
    if not heads:
        return None
    sums = []
    for k, head in enumerate(heads):
        hit = F.expr(head.sql())
        sums += [F.sum((hit & (F.col("good") == 0)).cast("int")).alias(f"bad{k}"), F.sum((hit & (F.col("good") != 0)).cast("int")).alias(f"good{k}")]
    found = held.agg(*sums).first()
    worth = []
    for k in range(len(heads)):
        bad, good = found[f"bad{k}"] or 0, found[f"good{k}"] or 0
        worth.append(((bad + 1) / (bad + good + 2), -k, bad))
    precision, k, bad = max(worth)
    return heads[-k] if bad >= min_covered and precision >= min_precision else None


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The ordered conditional expression: true for documents no rule rejects."""
    chain = None
    for rule in rules:
        sql = " and ".join(Condition(f"{prefix}{c.feature}", c.above, c.threshold).sql() for c in rule.conditions)
        chain = F.when(F.expr(sql), False) if chain is None else chain.when(F.expr(sql), False)
    return F.lit(True) if chain is None else chain.otherwise(True)


def base_failed(prefix: str = "") -> Column:
    return F.expr(f"{prefix}n_words < 10 or 100 * {prefix}n_repeat_words > 20 * {prefix}n_words")


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` plus counts, statistics, ``base_failed`` and ``kept``, all after ``prefix``.

    A null or empty text fails the base rule. Rows are judged one by one, repeated ones alike.
    """
    judged = with_features(with_counts(docs, text_col, prefix), prefix)
    return judged.withColumn(f"{prefix}base_failed", base_failed(prefix)).withColumn(
        f"{prefix}kept", ~F.col(f"{prefix}base_failed") & verdict(rules, prefix)
    )


def keep(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows that pass, with their own columns only; names that clash get a spare prefix."""
    prefix = spare_name(docs, "rule_")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    # The row number keeps the condition above the counts: pushed below them, it would hold a copy
    # of every nested expression.
    judged = judge(docs, rules, text_col, prefix).withColumn(f"{prefix}row", F.monotonically_increasing_id())
    kept = judged.where(F.col(f"{prefix}kept") & (F.col(f"{prefix}row") >= 0))
    return kept.select(*[f"`{c}`" for c in docs.columns])
