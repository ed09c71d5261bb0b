"""Weak supervision of text quality: rules vote or abstain, EM weighs them.

Every rule looks at counts of one document and votes good (+1), bad (-1) or abstains (0).
Documents are compressed to their vote patterns (at most 3**rules of them, whatever the
corpus size), and expectation-maximisation over that table estimates, for the two hidden
classes, how often each rule gives each vote. A document is kept when the posterior
probability of its pattern being good reaches ``threshold``.

Everything is a DataFrame expression. The counts are computed once and settled; the EM
loop is a single fold over iterations inside one row.

Edge cases: a null or empty text has zero words, fails the base rule and still votes;
repeated rows and repeated ids are separate rows with equal results; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import GAP, count_of, let, words
from motionlake.session import settle

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = "".join(chr(c) for c in (0x20, *range(0x09, 0x0E)))
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!#$%&*/;<=>?[]^_{|}~"
ITERATIONS = 12
SMOOTHING = 1.0
PRIOR_GOOD = 0.8
#: Where EM starts: a bad vote is rare among good texts, a good vote less rare among bad.
START_GOOD = (0.02, 0.18, 0.8)
START_BAD = (0.4, 0.2, 0.4)

#: name -> (SQL condition for a bad vote, SQL condition for a good vote)
RULES = {
    "symbols": ("10 * n_symbols > n_words", "FALSE"),
    "marks": ("100 * n_marks > 6 * word_chars", "100 * n_marks <= 2 * word_chars"),
    "exclamations": ("5 * n_exclamations > n_words", "FALSE"),
    "capitals": ("2 * n_capitals > word_chars", "5 * n_capitals <= word_chars"),
    "repeats": ("100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    "echoes": ("5 * n_echoes > n_words", "FALSE"),
    "lines": ("n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines", "FALSE"),
    "word_length": ("word_chars > 14 * n_words OR word_chars < 2 * n_words", "FALSE"),
}


def repeated_words(words_of: Column, size: int = 3) -> Column:
    """Words inside ``size``-word windows that occur twice or more in the array.

    Windows are sorted by their digest, so equal ones are neighbours; the covered words
    are the union of the windows' extents. Sorting keeps this n log n in the text length.
    """

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - size)
        windows = F.transform(
            starts, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(size)]).alias("h"), i.alias("i"))
        )
        return F.when(F.size(w) < size, F.lit(0)).otherwise(let(F.array_sort(windows), covered))

    def covered(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]),
        )
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), extent)

    def extent(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))),
            F.lit(0),
            lambda a, x: a + x,
        )

    return let(words_of, of)


def echoes(words_of: Column) -> Column:
    """Words that equal the word before them."""
    return let(words_of, lambda w: F.size(F.filter(w, lambda x, i: F.get(w, i - 1) == x)))


def text_counts(docs: DataFrame, *carry: Column) -> DataFrame:
    """Counts that the rules look at, one row per document, all from the whole text.

    The columns ``carry`` of the input go along.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*[c.alias(f"carry_{i}") for i, c in enumerate(carry)], text.alias("text"))
    along = [f"carry_{i}" for i in range(len(carry))]
    lines = F.filter(
        F.split(F.col("text"), "\n", -1), lambda x: F.char_length(F.translate(x, SPACES, "")) > 0
    )
    split = base.select(*along, "text", words(F.col("text")).alias("w"), lines.alias("l"))
    as_long = lambda c: c.cast("bigint")
    return split.select(
        *along,
        as_long(F.size("w")).alias("n_words"),
        as_long(F.char_length(F.translate("text", SPACES, ""))).alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        as_long(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        as_long(repeated_words(F.col("w"))).alias("n_repeat_words"),
        as_long(F.size("l")).alias("n_lines"),
        as_long(echoes(F.col("w"))).alias("n_echoes"),
        count_of(F.col("text"), MARKS).alias("n_marks"),
        count_of(F.col("text"), "!").alias("n_exclamations"),
        count_of(F.col("text"), CAPITALS).alias("n_capitals"),
    )


def votes() -> list[Column]:
    """One column per rule: its place 0 (bad), 1 (abstains) or 2 (good) plus 3 * rule."""
    return [
        (F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1) + 3 * j).cast("int")
        for j, (bad, good) in enumerate(RULES.values())
    ]


def weigh_patterns(patterns: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """Posterior of every vote pattern: ``(votes array<int>, n bigint)`` plus ``posterior``.

    The table has at most 3**rules rows, so it fits in one row as an array, over which a
    fold runs the EM iterations.
    """
    places = 3 * len(RULES)
    start_good = "array(" + ",".join(f"{x}D" for _ in RULES for x in START_GOOD) + ")"
    start_bad = "array(" + ",".join(f"{x}D" for _ in RULES for x in START_BAD) + ")"
    post = (
        "transform(array(struct(aggregate(p.votes, {s}.prior, (a, i) -> a * {s}.good[i]) AS g,"
        " aggregate(p.votes, 1D - {s}.prior, (a, i) -> a * {s}.bad[i]) AS b)), x -> x.g / (x.g + x.b))[0]"
    )
    weights = f"transform(pats, p -> struct(p.votes AS votes, CAST(p.n AS DOUBLE) AS n, {post.format(s='s')} AS q))"
    share = (
        f"transform(sequence(0, {places - 1}), i -> (aggregate(w, 0D, (a, p) ->"
        f" a + IF(array_contains(p.votes, i), {{x}}, 0D)) + {SMOOTHING}D)"
        f" / (aggregate(w, 0D, (a, p) -> a + {{x}}) + {3 * SMOOTHING}D))"
    )
    step = (
        f"transform(array({weights}), w -> named_struct("
        "'prior', (aggregate(w, 0D, (a, p) -> a + p.n * p.q) + 1D) / (aggregate(w, 0D, (a, p) -> a + p.n) + 2D),"
        f" 'good', {share.format(x='p.n * p.q')}, 'bad', {share.format(x='p.n * (1D - p.q)')}))[0]"
    )
    model = (
        f"aggregate(sequence(1, {iterations}), named_struct('prior', {PRIOR_GOOD}D, 'good', {start_good},"
        f" 'bad', {start_bad}), (s, t) -> {step})"
    )
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("pats"))
    fitted = one.select("pats", F.expr(model).alias("m")).selectExpr("m", "explode(pats) AS p")
    return fitted.selectExpr("p.votes AS votes", "p.n AS n", f"{post.format(s='m')} AS posterior")


def verdict(threshold: float) -> tuple[Column, Column]:
    """Whether the base rules fail, and whether the document stays."""
    failed = F.expr(
        f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    )
    return failed, ~failed & (F.col("posterior") >= threshold)


def pattern_posteriors(voted: DataFrame, iterations: int) -> DataFrame:
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    # Bounded by construction: at most 3**rules patterns, never a function of the rows.
    return F.broadcast(weigh_patterns(patterns, iterations).select("votes", "posterior"))


def quality_rules(docs: DataFrame, threshold: float = 0.5, iterations: int = ITERATIONS) -> DataFrame:
    """Counts, base rule, votes, posterior quality and verdict of every document."""
    counts = settle(
        text_counts(docs, F.col("doc_id")).withColumnRenamed("carry_0", "doc_id").withColumn("votes", F.array(*votes()))
    )
    posterior = pattern_posteriors(counts, iterations)
    failed, kept = verdict(threshold)
    return counts.join(posterior, "votes").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        kept.alias("kept"),
        F.round("posterior", 3).alias("posterior"),
    )


def kept_documents(docs: DataFrame, threshold: float = 0.5, iterations: int = ITERATIONS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Texts are counted once: the rows are settled with their votes, the pattern table reads
    the votes alone, and no text is shuffled.
    """
    failed, _ = verdict(threshold)
    counted = text_counts(docs, F.struct("*")).withColumn("votes", F.array(*votes()))
    counted = settle(counted.select("carry_0", "votes", failed.alias("failed")))
    judged = counted.join(pattern_posteriors(counted, iterations), "votes")
    return judged.where(~F.col("failed") & (F.col("posterior") >= threshold)).select("carry_0.*")


def oracle(docs: str = "documents") -> str:
    """The same rows as DuckDB SQL, with the EM iterations written out."""
    split = f"list_filter(string_split_regex(coalesce(text, ''), '{GAP}'), lambda x: x <> '')"
    has_word = "regexp_matches(x, '[^\\x20\\x09-\\x0D]')"
    count = "len(regexp_extract_all(t, '{}'))"
    ctes = [
        f"d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {split} AS w,"
        f" list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {has_word}) AS l FROM {docs})",
        "tri AS (SELECT r, i, row(w[i], w[i+1], w[i+2]) AS g FROM"
        " (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d))",
        "twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1)",
        "cover AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r)",
        "f AS (SELECT d.r, doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT)"
        f" AS word_chars, {count.format('[#*$%&|<>]')} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,"
        " coalesce(cover.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1])) AS n_echoes,"
        f" {count.format('[!#$%&*/;<=>?' + chr(92) + '[' + chr(92) + ']^_{|}~]')} AS n_marks,"
        f" {count.format('!')} AS n_exclamations, {count.format('[A-Z]')} AS n_capitals FROM d LEFT JOIN cover USING (r))",
        "v AS (SELECT *, [" + ", ".join(
            f"CASE WHEN {bad} THEN {3 * j} WHEN {good} THEN {3 * j + 2} ELSE {3 * j + 1} END"
            for j, (bad, good) in enumerate(RULES.values())
        ) + "] AS votes FROM f)",
        "pats AS (SELECT votes, count(*) AS n FROM v GROUP BY votes)",
        "pl AS (SELECT votes, n, unnest(votes) AS i FROM pats)",
        "m0 AS (SELECT CAST(i AS INTEGER) AS i, " + ", ".join(
            f"CASE i % 3 WHEN 0 THEN {s[0]}::DOUBLE WHEN 1 THEN {s[1]}::DOUBLE ELSE {s[2]}::DOUBLE END AS {name}"
            for s, name in ((START_GOOD, "pg"), (START_BAD, "pb"))
        ) + f", {PRIOR_GOOD}::DOUBLE AS prior FROM range({3 * len(RULES)}) x(i))",
    ]
    post = (
        "SELECT votes, any_value(n) AS n, any_value(prior) * exp(sum(ln(pg))) / (any_value(prior) * exp(sum(ln(pg)))"
        " + (1 - any_value(prior)) * exp(sum(ln(pb)))) AS q FROM pl JOIN m{} USING (i) GROUP BY votes"
    )
    for t in range(ITERATIONS):
        ctes.append(f"q{t} AS MATERIALIZED ({post.format(t)})")
        ctes.append(
            f"m{t + 1} AS MATERIALIZED (SELECT m0.i, (coalesce(sum(n * q), 0) + {SMOOTHING}) / (any_value(tg) + {3 * SMOOTHING}) AS pg,"
            f" (coalesce(sum(n * (1 - q)), 0) + {SMOOTHING}) / (any_value(tn) - any_value(tg) + {3 * SMOOTHING}) AS pb,"
            " (any_value(tg) + 1) / (any_value(tn) + 2) AS prior"
            f" FROM m0 CROSS JOIN (SELECT sum(n * q) AS tg, sum(n) AS tn FROM q{t})"
            f" LEFT JOIN (SELECT pl.i, pl.n, q FROM pl JOIN q{t} USING (votes)) z USING (i) GROUP BY m0.i)"
        )
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    ctes.append(f"qq AS ({post.format(ITERATIONS)})")
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,"
        f" {failed} AS base_failed, NOT {failed} AND q >= 0.5 AS kept, round(q, 3) AS posterior FROM v JOIN qq USING (votes)"
    )
