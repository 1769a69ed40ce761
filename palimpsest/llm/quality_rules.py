"""Quality rules as weak supervision, in DataFrame functions only.

Seven rules over statistics of the whole text vote good, bad or abstain.  The counts of the vote patterns (at most
``3 ** 7`` rows whatever the corpus) are all that expectation-maximisation needs: it estimates, for each rule, how
often it votes bad on bad and good on good documents, and the share of good ones.  A document is kept if its
posterior probability of being good reaches a threshold, so one doubtful sign does not reject it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

SYMBOLS = r"[#*$%&|<>]"
UPPER = "[A-ZÀ-ÖØ-Þ]"
GRAM = 8
ABSTAIN, GOOD, BAD = 0, 1, 2
RULES = ("symbols", "density", "shouting", "repeated_words", "repeated_lines", "word_length", "variety")
#: Start of the estimation: a share of good documents, and how reliable votes are.
#: Rules are written to spare good documents, and a bad document usually fails only some of them.
PRIOR_GOOD, START_ON_GOOD, START_ON_BAD, ROUNDS, SMOOTHING = 0.85, 0.995, 0.4, 20, 1.0
KEEP_AT = 0.5


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(hashes: Column) -> Column:
    """Words covered by runs of eight that are found twice or more; hashes: of the words."""

    def covered(grams: Column) -> Column:
        def repeated(ranked: Column) -> Column:
            twin = lambda x, k: F.coalesce((x["h"] == F.get(ranked, k - 1)["h"]) | (x["h"] == F.get(ranked, k + 1)["h"]), x["h"] == F.get(ranked, k - 1)["h"], x["h"] == F.get(ranked, k + 1)["h"], F.lit(False))
            places = F.sort_array(F.transform(F.filter(ranked, twin), lambda x: x["i"]))
            return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(GRAM), F.coalesce(F.get(p, k + 1) - x, F.lit(GRAM)))), F.lit(0), lambda a, x: a + x))

        ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(ranked, repeated))

    grams = F.transform(F.sequence(F.lit(1), F.size(hashes) - (GRAM - 1)), lambda i: F.xxhash64(F.slice(hashes, i, GRAM)))
    return F.when(F.size(hashes) <= GRAM, 0).otherwise(let(grams, covered))


def statistics(text: Column) -> Column:
    """A struct of counts (long) over a whole text; null is the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words,
        lambda w: let(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: F.struct(
                F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), F.size(F.array_distinct(h)).alias("n_distinct"), _repeat_words(h).alias("n_repeat_words")
            ),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    both = let(F.struct(of_words.alias("w"), of_lines.alias("l")), lambda s: F.struct(*(s["w"][k].cast("long").alias(k) for k in ("n_words", "word_chars", "n_distinct", "n_repeat_words")), *(s["l"][k].cast("long").alias(k) for k in ("n_lines", "n_dup_lines"))))
    return F.struct(both.alias("c"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.regexp_count(text, F.lit(UPPER)).cast("long").alias("n_upper"))


def _vote(bad: str, good: str) -> str:
    return f"CASE WHEN {bad} THEN {BAD} WHEN {good} THEN {GOOD} ELSE {ABSTAIN} END"


#: SQL that both engines read, over the counts.  A text of few words gives little to judge: most rules abstain.
VOTES = {
    "symbols": _vote("n_words > 0 AND 10 * n_symbols > n_words", "n_words >= 20 AND 50 * n_symbols <= n_words"),
    "density": _vote("50 * n_symbols > word_chars", "n_words >= 20 AND 400 * n_symbols <= word_chars"),
    "shouting": _vote("n_words >= 10 AND 2 * n_upper > word_chars", "n_words >= 10 AND 5 * n_upper <= word_chars"),
    "repeated_words": _vote("n_words >= 20 AND 4 * n_repeat_words > n_words", "n_words >= 20 AND 20 * n_repeat_words <= n_words"),
    "repeated_lines": _vote("n_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines", "n_lines >= 3 AND 10 * n_dup_lines <= n_lines"),
    "word_length": _vote("n_words >= 20 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)", "n_words >= 20 AND word_chars BETWEEN 3 * n_words AND 11 * n_words"),
    "variety": _vote("n_words >= 50 AND 20 * n_distinct < n_words", "n_words >= 50 AND 10 * n_distinct >= n_words"),
}
BASE_FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
PATTERN = " + ".join(f"{3**k} * ({VOTES[name]})" for k, name in enumerate(RULES))


def estimate(counts: dict[int, int]) -> dict[int, float]:
    """Posterior probability of good for each vote pattern (base 3, first rule lowest) by expectation-maximisation."""
    patterns = sorted(counts)
    votes = {p: [p // 3**k % 3 for k in range(len(RULES))] for p in patterns}
    good, on_good, on_bad = PRIOR_GOOD, [START_ON_GOOD] * len(RULES), [START_ON_BAD] * len(RULES)

    def posterior() -> dict[int, float]:
        out = {}
        for p in patterns:
            a, b = good, 1 - good
            for k, v in enumerate(votes[p]):
                a *= on_good[k] if v == GOOD else 1 - on_good[k] if v == BAD else 1.0
                b *= on_bad[k] if v == BAD else 1 - on_bad[k] if v == GOOD else 1.0
            out[p] = a / (a + b)
        return out

    for _ in range(ROUNDS):
        q = posterior()
        total = sum(counts.values())
        good = (sum(counts[p] * q[p] for p in patterns) + SMOOTHING) / (total + 2 * SMOOTHING)
        for k in range(len(RULES)):
            said = lambda v, w: sum(counts[p] * w(q[p]) for p in patterns if votes[p][k] == v)
            gg, gb = said(GOOD, lambda x: x), said(BAD, lambda x: x)
            bb, bg = said(BAD, lambda x: 1 - x), said(GOOD, lambda x: 1 - x)
            on_good[k] = (gg + SMOOTHING) / (gg + gb + 2 * SMOOTHING)
            on_bad[k] = (bb + SMOOTHING) / (bb + bg + 2 * SMOOTHING)
    return posterior()


def _fit(patterns: DataFrame) -> Column:
    """The posterior as a column over ``pattern``; the driver sees one row per vote pattern, at most 2187."""
    counts = {r["pattern"]: r["n"] for r in patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = estimate(counts)
    return F.element_at(F.array(*(F.lit(float(found.get(p, PRIOR_GOOD))) for p in range(3 ** len(RULES)))), F.col("pattern") + 1)


def _judged(docs: DataFrame, text_col: str, *columns) -> DataFrame:
    flat = docs.select(*columns, statistics(F.col(text_col)).alias("_s"))
    counts = [F.col(f"_s.c.{k}").alias(k) for k in ("n_words", "word_chars", "n_distinct", "n_repeat_words", "n_lines", "n_dup_lines")]
    flat = flat.select(*(c for c in flat.columns if c != "_s"), *counts, F.col("_s.n_symbols").alias("n_symbols"), F.col("_s.n_upper").alias("n_upper"))
    return flat.select("*", F.expr(BASE_FAILED).alias("base_failed"), F.expr(PATTERN).cast("int").alias("pattern"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``pattern`` (the votes), ``posterior`` and ``kept`` of every row.

    Null and empty texts have zero counts and fail the base rules.  Repeated rows are judged alike and counted each
    time; null ids are judged as any other.  Other columns are not read.  An empty input gives an empty result.
    """
    stats = materialize(_judged(docs, text_col, F.col(id_col).cast("long").alias("doc_id")), "quality-counts")
    scored = stats.withColumn("posterior", _fit(stats))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))


def keep_good(docs: DataFrame, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns only; no shuffle and no join, so ids need not be unique.

    Rows that pass the base rules are written once beside their votes, so no text is judged twice.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    passed = F.when(~F.col("base_failed"), F.col("_row")).alias("_row")
    judged = materialize(_judged(rows, "_text", "_row").select("pattern", passed), "judged")
    kept = judged.filter(F.col("_row").isNotNull() & (_fit(judged.select("pattern")) >= keep_at))
    return kept.select("_row.*")


def _oracle() -> str:
    """The same in SQL with the estimation unrolled: one round is one common table."""
    vote = lambda k: f"(pattern // {3**k}) % 3"
    posterior = lambda t: "SELECT p.pattern, p.n, (m.good * " + " * ".join(f"CASE {vote(k)} WHEN {GOOD} THEN m.g{k} WHEN {BAD} THEN 1 - m.g{k} ELSE 1.0::DOUBLE END" for k in range(len(RULES))) + ") AS a, ((1 - m.good) * " + " * ".join(f"CASE {vote(k)} WHEN {BAD} THEN m.b{k} WHEN {GOOD} THEN 1 - m.b{k} ELSE 1.0::DOUBLE END" for k in range(len(RULES))) + f") AS b FROM counts p, {t} m"
    rounds = ["m0 AS MATERIALIZED (SELECT " + ", ".join([f"{PRIOR_GOOD}::DOUBLE AS good"] + [f"{START_ON_GOOD}::DOUBLE AS g{k}, {START_ON_BAD}::DOUBLE AS b{k}" for k in range(len(RULES))]) + ")"]
    for r in range(ROUNDS):
        share = lambda k, v, w: f"coalesce(sum(n * ({w})) FILTER (WHERE {vote(k)} = {v}), 0)"
        cells = [f"(sum(n * q) + {SMOOTHING}) / (sum(n) + {2 * SMOOTHING}) AS good"]
        for k in range(len(RULES)):
            cells.append(f"({share(k, GOOD, 'q')} + {SMOOTHING}) / ({share(k, GOOD, 'q')} + {share(k, BAD, 'q')} + {2 * SMOOTHING}) AS g{k}")
            cells.append(f"({share(k, BAD, '1 - q')} + {SMOOTHING}) / ({share(k, BAD, '1 - q')} + {share(k, GOOD, '1 - q')} + {2 * SMOOTHING}) AS b{k}")
        rounds.append(f"q{r} AS MATERIALIZED (SELECT pattern, n, a / (a + b) AS q FROM ({posterior(f'm{r}')}))")
        rounds.append(f"m{r + 1} AS MATERIALIZED (SELECT {', '.join(cells)} FROM q{r})")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
grams AS (SELECT doc_id, i, words[i:i + {GRAM - 1}] AS gram FROM w, range(1, len(words) - {GRAM - 2}) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, sum(least({GRAM}, coalesce(lead_i - i, {GRAM})))::BIGINT AS n FROM
        (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead_i FROM twice) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(list_distinct(words))::BIGINT AS n_distinct, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '{UPPER}'))::BIGINT AS n_upper
      FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
v AS MATERIALIZED (SELECT *, {BASE_FAILED} AS base_failed, ({PATTERN})::INTEGER AS pattern FROM s),
counts AS MATERIALIZED (SELECT pattern, count(*) AS n FROM v GROUP BY pattern),
{", ".join(rounds)},
final AS (SELECT pattern, a / (a + b) AS posterior FROM ({posterior(f'm{ROUNDS}')}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND posterior >= {KEEP_AT}) AS kept FROM v JOIN final USING (pattern)"""


ORACLE_SQL = _oracle()
