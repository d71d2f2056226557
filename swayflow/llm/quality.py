"""Quality rules: a threshold table compiled into one Spark projection.

Every figure is a built-in expression over the row's own text, so the operator has no
shuffle, no user function and no state; a text of any length is one row of one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, load, words_of

#: Frequent function words of four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "was", "for", "with", "be", "this",
    "der", "die", "und", "das", "von", "den", "ist", "mit", "des", "ein", "zu", "im",
    "de", "la", "le", "les", "et", "des", "en", "un", "une", "que", "pour", "dans",
    "el", "los", "las", "y", "del", "se", "por", "con", "una", "su", "para", "es",
)

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Keeps a row if low * den <= 1000 * num <= high * den (no den: 1); counted only from `least` words on."""

    name: str
    num: str
    den: str | None
    low: int | None = None
    high: int | None = None
    least: int = 0

    def broken(self) -> Column:
        value, den = F.col(self.num) * 1000, F.lit(1) if self.den is None else F.col(self.den)
        out = F.lit(False)
        if self.low is not None:
            out = out | (value < den * self.low)
        if self.high is not None:
            out = out | (value > den * self.high)
        return out & (F.col("n_words") >= self.least)


#: Ratios in thousandths; the first two are the base rules.
RULES = (
    Rule("too_few_words", "n_words", None, low=10_000),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=200),
    Rule("word_length", "word_chars", "n_words", low=2_000, high=20_000),
    Rule("symbols", "n_symbols", "n_words", high=250),
    Rule("stop_words", "n_stop_words", "n_words", low=20, least=40),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=500),
)
BASE = ("too_few_words", "repeated_windows")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts the rules speak of; null text counts as empty. Columns of `docs` with the names of counts are replaced, all others stay."""
    n = 5
    words, lines, hashed, windows, found = fresh(docs, "_words", "_lines", "_hashes", "_windows", "_places")
    w, x = F.col(words), F.coalesce(F.col(text), F.lit(""))
    line = F.filter(F.split(x, "\n"), lambda s: s.rlike(r"[^ \t-\r]"))
    out = docs.withColumns({words: words_of(F.col(text)), lines: line})
    last = F.size(w) - n
    none = F.array().cast("array<bigint>")
    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))).otherwise(none)
    out = out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(x) - F.length(F.regexp_replace(x, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_stop_words": F.size(F.filter(w, lambda s: s.isin(*dict.fromkeys(STOP_WORDS)))).cast("long"),
        hashed: hashes,
    })
    # Equal windows have equal hashes: with distinct hashes nothing repeats. Otherwise the windows themselves are sorted and compared.
    again = F.size(hashed) > F.size(F.array_distinct(hashed))
    window = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.array_join(F.slice(w, i + 1, n), " ").alias("w"), i.alias("i")))
    out = out.withColumn(windows, F.when(again, F.sort_array(window)))
    s = F.col(windows)

    def at(j: Column) -> Column:
        return F.get(s, j)["w"]

    places = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(F.equal_null(at(j), at(j - 1)) | F.equal_null(at(j), at(j + 1)), F.get(s, j)["i"]))
    out = out.withColumn(found, F.when(again, F.sort_array(F.array_compact(places))))
    p = F.col(found)
    m = F.size(p)
    steps = F.zip_with(F.slice(p, 1, F.greatest(m - 1, F.lit(0))), F.slice(p, 2, F.greatest(m - 1, F.lit(0))), lambda a, b: F.least(F.lit(n), b - a))
    covered = F.aggregate(steps, F.lit(n), lambda a, b: a + b)
    return out.withColumn("n_repeat_words", F.when(again & (m > 0), covered).otherwise(0).cast("long")).drop(words, lines, hashed, windows, found)


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """`measured` plus base_failed, kept and the names of the broken rules.

    Null or empty texts have no words and fail the base. Repeated rows are judged alike; there
    are no ties; a text of any length is one row of one task; an empty table gives none. Columns
    with the names of the results are replaced, all others pass through.
    """
    out = measured(docs, text)
    broken = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]))
    out = out.withColumn("broken", broken)
    base = [r.broken() for r in rules if r.name in BASE]
    failed = base[0] | base[1] if len(base) == 2 else F.lit(False)
    return out.withColumns({"base_failed": failed, "kept": F.size("broken") == 0})


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LIST = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text,
         list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls
  FROM d
), p AS (
  SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i + 4], ' ')) AS n FROM p
), r AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM g WHERE n > 1) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(list_filter(ws, lambda x: x IN ({_LIST})))::BIGINT AS n_stop_words,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 1000 * n_symbols > 250 * n_words
            OR (n_words >= 40 AND 1000 * n_stop_words < 20 * n_words)
            OR 1000 * n_dup_lines > 500 * n_lines) AS kept
FROM b
"""
