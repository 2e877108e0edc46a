"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every rule is a row of THRESHOLDS: a metric, the least and the most allowed value. compile_rules() turns the rows
into one boolean expression over the metric columns, so that adding a rule adds no pass over the data. All
metrics are higher-order SQL functions over the array of words and the array of lines of one text; no shuffle.

Defined results: a null text counts as empty; an empty text has zero of everything, fails the base rule and is not
kept; a null doc_id passes through; repeated rows are judged alike, each on its own; a metric that equals its bound passes; very
long texts are measured whole; an empty table gives no rows; extra columns are kept by quality_metrics() unless their name is
one that it computes, which is then replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with is are was for from this by in it on as at or "
    "der die das und ist nicht von mit für auf den des im zu sich als "
    "le la les et de du un une dans que qui pour par sur est pas avec au "
    "el los las del y en se no una su para con por "
).split()

#: (metric, least, most), both inclusive; None: no bound.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("mean_word_chars", 2, 14),
    ("symbol_ratio", None, 0.1),
    ("stop_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.5),
)

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop", "n_lines", "n_bullet_lines", "n_ellipsis_lines")

WHITE = r"[ \x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The runs of characters other than blank and \\x09-\\x0D."""
    ends = lambda x: (x[0] == "") | (F.element_at(x, -1) == "")
    return let(F.split(text, WHITE), lambda x: F.when(ends(x), F.array_remove(x, "")).otherwise(x))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))


def repeated_words(w: Column, size: int = 3) -> Column:
    """Words in windows of `size` words that the text has twice or more, the first one included. A text whose
    windows all hash differently has none. In others the windows are sorted with their place; one that equals a
    neighbour is repeated, and the places it covers are counted once."""
    starts = lambda x: F.sequence(F.lit(0), F.size(x) - size)

    def hashes(x: Column) -> Column:
        return F.transform(starts(x), lambda i: F.xxhash64(*[x[i + k] for k in range(size)]))

    def windows(x: Column) -> Column:
        return F.sort_array(F.transform(starts(x), lambda i: F.struct(F.concat_ws(" ", *[x[i + k] for k in range(size)]).alias("t"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda i: (F.get(s, i - 1)["t"] == s[i]["t"]) | (F.get(s, i + 1)["t"] == s[i]["t"])
        again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i), F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(*[s[i]["i"] + k for k in range(size)])))))

    repeats = let(hashes(w), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((F.size(w) > size) & repeats, let(windows(w), places)).otherwise(0)


def quality_metrics(docs: DataFrame, text: str = "text", stop_words: Sequence[str] = tuple(STOP_WORDS)) -> DataFrame:
    """docs with the columns of METRICS (long); columns of docs with these names, or those of quality_rules(), in any case, are replaced."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(list(stop_words)))).alias("n_stop"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: F.ltrim(y).rlike(r"^(?:[-*•‣·]|[0-9]+[.)])\s"))).alias("n_bullet_lines"),
            F.size(F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…"))).alias("n_ellipsis_lines"),
        )

    keep = [c for c in docs.columns if c.lower() not in {*METRICS, "base_failed", "kept"}]  # Spark's names have no case
    row = F.struct(*[F.col(f"`{c}`") for c in keep])  # names of docs' columns can't clash with those below
    measured = docs.select(row.alias("row"), let(words(t), of_words).alias("w"), let(lines_with_words(t), of_lines).alias("l"), (F.size(F.split(t, SYMBOLS)) - 1).alias("s"))
    at = {"n_symbols": "s"} | {c: "w." + c for c in ("n_words", "word_chars", "n_repeat_words", "n_stop")}
    return measured.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *[F.col(at.get(c, "l." + c)).cast("long").alias(c) for c in METRICS])


def ratios() -> dict[str, Column]:
    """The metrics that thresholds can name, over the columns of quality_metrics()."""
    per = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
    return {c: F.col(c) for c in METRICS} | {
        "mean_word_chars": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "stop_ratio": per("n_stop", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"), "bullet_line_ratio": per("n_bullet_lines", "n_lines"), "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
    }


def compile_rules(thresholds: Sequence[tuple[str, float | None, float | None]] = THRESHOLDS) -> Column:
    """True where every threshold holds."""
    at, out = ratios(), F.lit(True)
    for name, least, most in thresholds:
        for bound, holds in ((least, lambda b, c=at[name]: c >= b), (most, lambda b, c=at[name]: c <= b)):
            if bound is not None:
                out = out & holds(bound)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """quality_metrics() with base_failed and kept: false if the base rule failed, else the threshold table's verdict."""
    return quality_metrics(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compile_rules(thresholds))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with the columns of docs."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return quality_rules(marked).filter("kept").select("row.*")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    kept = " AND ".join(f"{name} {op} {bound}" for name, least, most in THRESHOLDS for op, bound in ((">=", least), ("<=", most)) if bound is not None)
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    white = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: translate(x, {white}, '') <> '') AS l FROM d),
g AS (SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 3)),
dup AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(t, {white}, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop, len(l) AS n_lines,
    len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^(?:[-*•‣·]|[0-9]+[.)])\\s'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipsis_lines
  FROM w LEFT JOIN rep USING (r)),
q AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words = 0 THEN 0 ELSE word_chars / n_words END AS mean_word_chars, CASE WHEN n_words = 0 THEN 0 ELSE n_symbols / n_words END AS symbol_ratio,
    CASE WHEN n_words = 0 THEN 0 ELSE n_stop / n_words END AS stop_ratio, CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines / n_lines END AS dup_line_ratio,
    CASE WHEN n_lines = 0 THEN 0 ELSE n_bullet_lines / n_lines END AS bullet_line_ratio, CASE WHEN n_lines = 0 THEN 0 ELSE n_ellipsis_lines / n_lines END AS ellipsis_line_ratio
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {kept} AS kept FROM q"""


QUERIES = {"op8_quality": op8_quality}
ORACLE_SQL = {"op8_quality": _sql()}
