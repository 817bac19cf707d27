"""Quality rules with risk-controlled thresholds.

Each rule scores a document (the higher, the worse) and has a fixed ladder of cutoffs.
A document is rejected if a score is over the cutoff of its rule. The cutoffs of all rules
of one stratum (language) are chosen together on a labelled holdout: of all combinations,
a rule left out among them, those are safe for which the exact binomial test shows, for
the documents that the labels call good, that at most max_risk of them would be rejected
by any of the rules. For n good documents of which k are rejected, a combination is safe
if P(Binomial(n, max_risk) <= k) is at most the error level. The error level is shared
among the tests of all combinations in all strata (Bonferroni), so that with probability
1 - error the verdicts of every stratum keep their promise at once, whichever of the safe
combinations is chosen. It is the one that rejects most documents that the labels call
bad, then the strictest by the order of the rules. A stratum without a safe combination
rejects nothing. Two hard rules stand before and have no part in that promise: too few
words, and too many words in repeated windows.

The holdout is all labelled rows of the stratum, counted where they are. Everything covers
all rows: the statistics of each text are columns of its own row, so hot sources and
copies cost no more than other rows, and nothing but scores and a few counts is shuffled.

Defined results: a null or blank text has no words and fails; a null language is a
stratum of its own, apart from the empty name; labels that are null or without document are ignored; repeated
rows are judged alike, and repeated labels count once, as good if any says so; an
empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored, table, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MAX_RISK = 0.01
ERROR = 0.05
LOOSE_RISK = 0.2
#: Rules: share of symbols among the characters of words, share of lines that repeat, and mean length of words.
LADDERS = {
    "symbols": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5],
    "dup_lines": [0.05, 0.1, 0.2, 0.3, 0.5, 0.7],
    "long_words": [8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
}


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def repeat_words(ws: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the list, every copy included."""

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(WINDOW)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def in_order(pairs: Column) -> Column:
        same = lambda p, q: F.coalesce(p.getField("h") == q.getField("h"), F.lit(False))
        twice = F.filter(pairs, lambda p, i: same(p, F.get(pairs, i + 1)) | same(p, F.get(pairs, i - 1)))
        return _bound(F.sort_array(F.transform(twice, lambda p: p.getField("i"))), covered)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bound(pairs, in_order))

    return _bound(ws, lambda w: F.when(F.size(w) <= F.lit(WINDOW), F.lit(0)).otherwise(_bound(hashes(w), count))).cast("long")


def measured(docs: DataFrame, text: str = "text", repeats: bool = True) -> DataFrame:
    """docs with the struct column stats of n_words, word_chars, n_symbols, n_lines, n_dup_lines and, where asked for, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    ws = words(F.col(text))
    long = lambda c, name: c.cast("long").alias(name)
    stats = F.struct(
        long(F.size(ws), "n_words"),
        long(F.length(F.regexp_replace(t, SPACE, "")), "word_chars"),
        long(F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", "")), "n_symbols"),
        long(F.size(lines), "n_lines"),
        long(F.size(lines) - F.size(F.array_distinct(lines)), "n_dup_lines"),
        *([long(repeat_words(ws), "n_repeat_words")] if repeats else []),
    )
    return docs.withColumn("stats", stats)


def scores(stats: Column) -> Column:
    """The rules' scores as an array in the order of LADDERS."""
    share = lambda a, b: F.coalesce(stats[a] / F.nullif(stats[b], F.lit(0)), F.lit(0.0))
    return F.array(share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("word_chars", "n_words"))


def _log_factorial(n: Column) -> Column:
    """Stirling's series at n + 9, brought back by the factors between; exact to 1e-12 or so."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return series - sum((F.log(n + i) for i in range(1, 9)), F.lit(0.0))


def tail(n: Column, k: Column, risk: float) -> Column:
    """P(Binomial(n, risk) <= k) for k below the mean, else 1: the terms from k downwards, as far as they count in a double."""
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(risk) + (n - k) * math.log1p(-risk)
    steps = F.least(k, (12 * F.sqrt(n * F.lit(risk)) + 60).cast("long"))
    odds = (1 - risk) / risk

    def add(state: Column, i: Column) -> Column:
        term = state["term"] * (k - i + 1) / (n - k + i) * odds
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    lower = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1).cast("long"))), one, add)["sum"]).otherwise(F.lit(1.0))
    return F.when(k > n * risk, F.lit(1.0)).otherwise(F.exp(top) * lower)


def cutoffs(labelled: DataFrame, max_risk: float = MAX_RISK, error: float = ERROR) -> DataFrame:
    """labelled: (stratum, scores) and, unless all are good, good. Rows (stratum, cuts): a cutoff or null for each rule.

    Each row counts once, by the number of cutoffs that it is over in each ladder; a combination accepts the cells at or below it.
    """
    good = F.col("good") if "good" in labelled.columns else F.lit(True)
    names = [f"l{r}" for r in range(len(LADDERS))]
    levels = [sum((F.get(F.col("scores"), F.lit(r)) > c).cast("int") for c in ladder).alias(f"l{r}") for r, ladder in enumerate(LADDERS.values())]
    cells = stored(labelled.select("stratum", good.alias("good"), *levels).groupBy("stratum", *names).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")), "holdout")
    accepted = cells
    for name, ladder in zip(names, LADDERS.values(), strict=True):
        accepted = accepted.withColumn(name, F.explode(F.sequence(F.col(name), F.lit(len(ladder)))))
    accepted = accepted.groupBy("stratum", *names).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    totals = cells.groupBy("stratum").agg(F.sum("good").alias("n"), F.sum("bad").alias("of_bad"))  # a row for each stratum
    tests = math.prod(len(ladder) + 1 for ladder in LADDERS.values()) * totals.count()
    safe = accepted.join(F.broadcast(totals), "stratum").where(tail(F.col("n"), F.col("n") - F.col("good"), max_risk) <= error / max(1, tests))
    best = F.min(F.struct((F.col("bad") - F.col("of_bad")).alias("rejected"), *names)).alias("best")
    cuts = [F.get(F.array(*map(F.lit, ladder)), F.col(f"best.l{r}")) for r, ladder in enumerate(LADDERS.values())]
    return safe.groupBy("stratum").agg(best).select("stratum", F.array(*cuts).alias("cuts"))


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", **options) -> DataFrame:
    """One row for each row of docs: doc (the whole row), stats, base_failed, kept."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col(f"`{stratum}`").cast("string")), F.lit("n")).alias("stratum"), F.col(f"`{text}`").alias("text"))
    light = measured(rows.select("doc_id", "stratum", "text"), repeats=False).drop("text").withColumn("scores", scores(F.col("stats")))
    rows = measured(rows).drop("text").withColumn("scores", scores(F.col("stats")))
    base_failed = (F.col("stats.n_words") < MIN_WORDS) | (100 * F.col("stats.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("stats.n_words"))
    rows = rows.withColumn("base_failed", base_failed)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    # Measured before they meet the labels: only scores are shuffled, never texts.
    held = light.where(F.col("stats.n_words") >= MIN_WORDS).select("doc_id", "stratum", "scores").join(known, "doc_id")
    cuts = cutoffs(held.select("stratum", "scores", "good"), **options)
    # A row for each stratum with a safe cutoff; each of those has hundreds of labels at least, so the list stays small.
    out = rows.join(F.broadcast(cuts), "stratum", "left")
    over = F.coalesce(F.array_max(F.transform(F.arrays_zip("scores", "cuts"), lambda x: F.coalesce(x["scores"] > x["cuts"], F.lit(False)))), F.lit(False))
    # One expression of both: a filter on it is not split and pushed down, where it would measure every text again.
    kept = ~F.array_contains(F.array("base_failed", over), True)
    return out.select("doc", "stats", "base_failed", kept.alias("kept"))


def op10_quality_verdicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = judged(docs, table(spark, sf_dir, "labels"))
    return out.select("doc.doc_id", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines", "stats.n_repeat_words", "base_failed", "kept")


def quality_at_loose_risk(spark, sf_dir):
    """The verdicts at a risk of a fifth, for which the labels of small tables are enough to choose cutoffs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judged(docs, table(spark, sf_dir, "labels"), max_risk=LOOSE_RISK).select("doc.doc_id", "base_failed", "kept")


_LEVELS = ", ".join(f"len(list_filter({ladder}, lambda c: scores[{r + 1}] > c)) AS l{r}" for r, ladder in enumerate(LADDERS.values()))
_GRID = ", ".join(f"unnest(range(l{r}, {len(ladder) + 1})) t{r}(c{r})" for r, ladder in enumerate(LADDERS.values()))
_OVER = " OR ".join(f"coalesce(s.scores[{r + 1}] > {ladder}[c.c{r} + 1], false)" for r, ladder in enumerate(LADDERS.values()))
_TESTS = math.prod(len(ladder) + 1 for ladder in LADDERS.values())
_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce('s' || lang, 'n') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
grams AS (SELECT doc_id, s, array_to_string(ws[s:s + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS s FROM d)),
again AS (SELECT doc_id, s FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(s, s + 5)) AS word FROM again) GROUP BY doc_id),
stats AS (
  SELECT doc_id, stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeats USING (doc_id)),
scored AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         [coalesce(n_symbols / nullif(word_chars, 0), 0), coalesce(n_dup_lines / nullif(n_lines, 0), 0), coalesce(word_chars / nullif(n_words, 0), 0)] AS scores FROM stats),
known AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
cells AS (
  SELECT stratum, l0, l1, l2, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad
  FROM (SELECT stratum, good, {_LEVELS} FROM scored JOIN known USING (doc_id) WHERE n_words >= {MIN_WORDS}) GROUP BY ALL),
totals AS (SELECT stratum, sum(good)::BIGINT AS n, sum(bad)::BIGINT AS of_bad, count(*) OVER () * {_TESTS} AS tests FROM cells GROUP BY stratum),
accepted AS (SELECT stratum, c0, c1, c2, sum(good)::BIGINT AS good, sum(bad)::BIGINT AS bad FROM cells, {_GRID} GROUP BY ALL),
tested AS (
  SELECT *, n - good AS k, CASE WHEN n - good > n * SHARE THEN 1 ELSE list_sum(list_transform(range(0, n - good + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(SHARE::DOUBLE) + (n - i) * ln(1 - SHARE::DOUBLE)))) END AS p
  FROM accepted JOIN totals USING (stratum)),
cuts AS (SELECT * FROM tested WHERE p <= {ERROR} / tests QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY bad - of_bad, c0, c1, c2) = 1),
rejected AS (SELECT DISTINCT s.doc_id FROM scored s JOIN cuts c ON c.stratum = s.stratum AND ({_OVER}))
SELECT COLUMNS_ base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM scored
"""
SQL = _SQL.replace("SHARE", f"({MAX_RISK})").replace("COLUMNS_", "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,")
SQL_LOOSE = _SQL.replace("SHARE", f"({LOOSE_RISK})").replace("COLUMNS_", "doc_id,")
