"""Quality rules: a table of thresholds compiled into one projection.

All measures are built-in expressions of the row's own text: no shuffle, no user
functions.  Words found in repeated three-word windows are counted without
comparing windows pairwise: the windows' hashes are sorted with the window's
place in their low bits, so that equal windows are neighbours; only places whose
truncated hash has a neighbour are compared by their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that parts words, and the symbols, of the contract.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
#: What is trimmed from a word before it is compared with the function words.
AROUND = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
PLACE_BITS = 24

#: Frequent function words of the languages of the corpus.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "was", "for", "on", "are",
    "der", "die", "das", "und", "ist", "nicht", "mit", "von", "zu", "ein",
    "le", "la", "les", "de", "des", "et", "est", "que", "une", "en", "du",
    "el", "los", "las", "y", "del", "se", "un", "una", "por", "con", "a",
)


@dataclass(frozen=True)
class Rule:
    """A document fails if ``measure`` is below ``least`` or above ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: ``base`` rules are the contract's; the others are the method's own.
BASE_RULES = (
    Rule("few_words", "n_words", least=50),
    Rule("repeated_windows", "100 * n_repeat_words - 50 * n_words", most=0),
)
RULES = (
    Rule("word_length", "mean_word_chars", least=1.5, most=25.0),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5),
    Rule("upper_case", "upper_ratio", most=0.6),
    Rule("stop_words", "stop_word_ratio", least=0.02),
)


def _sum_of_gaps(places: Column) -> Column:
    """Words covered by three-word windows at the given ascending places."""
    gaps = F.transform(places, lambda p, i: F.coalesce(F.least(F.lit(3), F.get(places, i + 1) - p), F.lit(3)))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def measures(text: str = "text") -> list[dict[str, Column]]:
    """Named expressions in steps; a step's may use the steps' before it."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    mask = (1 << PLACE_BITS) - 1
    words = F.col("q_words")
    keys, places = F.col("q_keys"), F.col("q_places")
    # a place is kept if its truncated hash equals a neighbour's: a superset of the repeated windows
    near = F.filter(
        F.transform(keys, lambda k, i: F.when(
            (F.shiftright(k, PLACE_BITS) == F.shiftright(F.get(keys, i - 1), PLACE_BITS)) | (F.shiftright(k, PLACE_BITS) == F.shiftright(F.get(keys, i + 1), PLACE_BITS)),
            k.bitwiseAND(F.lit(mask)).cast("int"))),
        lambda p: p.isNotNull(),
    )
    window = lambda p: F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2))
    named = F.col("q_named")
    exact = F.array_sort(F.filter(
        F.transform(named, lambda s, i: F.when((s["w"] == F.get(named, i - 1)["w"]) | (s["w"] == F.get(named, i + 1)["w"]), s["p"])),
        lambda p: p.isNotNull(),
    ))
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), PLACE_BITS).bitwiseOR(i.cast("long")),
    )
    # texts of more words than the low bits can number compare all windows by their words
    long_text = F.size(words) > mask
    return [
        {"q_text": t},
        {
            "q_words": F.filter(F.split("q_text", SPACE), lambda w: w != ""),
            "q_lines": F.filter(F.split("q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        },
        {"q_keys": F.when((F.size(words) >= 3) & ~long_text, F.sort_array(hashes)).otherwise(F.array().cast("array<bigint>"))},
        {"q_places": F.when(long_text, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(near)},
        {
            "q_named": F.when(F.size(places) > 0, F.sort_array(F.transform(places, lambda p: F.struct(window(p).alias("w"), p.alias("p")))))
            .otherwise(F.array().cast("array<struct<w:string,p:int>>"))
        },
        {"q_exact": exact},
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.regexp_replace("q_text", SPACE, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("q_text", SYMBOLS, "")).cast("long"),
            "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            # an expression that isn't deterministic keeps later filters from being pushed, copied out many times, below it
            "n_repeat_words": F.when(F.monotonically_increasing_id() >= 0, _sum_of_gaps(F.col("q_exact"))).otherwise(F.lit(0)),
            "n_upper": F.length(F.regexp_replace("q_text", r"[^\p{Lu}]+", "")).cast("long"),
            "n_lines": F.size("q_lines").cast("long"),
            # most words have nothing to trim
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS) | (w.rlike(AROUND) & F.lower(F.regexp_replace(w, AROUND, "")).isin(*STOP_WORDS)))).cast("long"),
        },
        {
            "mean_word_chars": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
            "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "upper_ratio": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
            "stop_word_ratio": F.col("n_stop_words") / F.greatest(F.col("n_words"), F.lit(1)),
        },
    ]


def fails(rule: Rule) -> Column:
    """Whether a row with the measures breaks the rule."""
    value, out = F.expr(rule.measure), F.lit(False)
    if rule.least is not None:
        out = out | (value < F.lit(rule.least))
    if rule.most is not None:
        out = out | (value > F.lit(rule.most))
    return out


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """doc_id, the measures, base_failed, failed (names of the broken rules) and kept for every row.

    A null text is an empty one (no words, so it fails ``few_words``); ratios of
    nothing are 0.  Null and repeated ids are rows like any other, an empty table
    gives an empty one, and other columns, whatever their names, are left out.
    """
    out = docs.select(F.col("doc_id").alias("q_id"), F.col("text").cast("string").alias("q_text"))
    for columns in measures("q_text"):
        out = out.withColumns(columns)
    out = out.withColumn("base_failed", F.array_contains(F.array(*(fails(r) for r in base)), True))
    broken = F.filter(F.array(*(F.when(fails(r), F.lit(r.name)) for r in (*base, *rules))), lambda n: n.isNotNull())
    out = out.withColumn("failed", broken).withColumn("kept", F.size("failed") == 0)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("q_id").alias("doc_id"), *counts, "mean_word_chars", "symbol_ratio", "dup_line_ratio", "upper_ratio", "stop_word_ratio", "base_failed", "failed", "kept")


ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM words WHERE len(w) >= 3),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
gaps AS (SELECT r, least(3, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 3)) AS gap FROM repeated),
covered AS (SELECT r, sum(gap)::BIGINT AS n FROM gaps GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         list_count(list_filter(w, lambda x: list_contains([@STOPS@], lower(regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')))))::DOUBLE AS n_stops,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::DOUBLE AS n_upper, greatest(len(lines), 1)::DOUBLE AS n_lines
  FROM words LEFT JOIN covered c USING (r)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         word_chars::DOUBLE / greatest(n_words, 1) AS mean_chars, n_symbols::DOUBLE / greatest(word_chars, 1) AS symbols, n_dup_lines / n_lines AS dups, n_upper / greatest(word_chars, 1) AS upper, n_stops / greatest(n_words, 1) AS stop_word_ratio
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, stop_word_ratio, base_failed,
       NOT (base_failed OR mean_chars < 1.5 OR mean_chars > 25.0 OR symbols > 0.1 OR dups > 0.5 OR upper > 0.6 OR stop_word_ratio < 0.02) AS kept
FROM judged
""".replace("@STOPS@", ", ".join(f"'{w}'" for w in STOP_WORDS))
