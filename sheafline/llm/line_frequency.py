"""Quality rules by cross-document line frequency, in DataFrame functions only.

Normalised lines (ASCII lower case, white space runs as one blank, trimmed) are hashed and counted once a document and
host. Lines that more than ``max_documents`` documents of a host hold are cut out of the texts, and a document whose text
lost more than half of its words, or has fewer than ``min_words`` left, is rejected. The counts cover all rows: every
document sends one short row a distinct line, aggregated before the shuffle. Texts meet the places of their frequent lines
in one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

MAX_DOCUMENTS = 25
MIN_KEPT = 0.5
MIN_WORDS = 10
#: The separators of the word contract but the blank, the symbols and the ASCII capitals.
SPACES = "\t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_list(text: str) -> str:
    """SQL of the words of a string expression. Splitting by one expression costs half of translating characters first."""
    return rf"filter(split({text}, '[\\x20\\x09-\\x0D]+'), x -> x <> '')"


def base_rules(documents: DataFrame) -> DataFrame:
    """Per-row counts of the contract beside the columns of the rows, of which ``text`` has no nulls.

    Words are hashed once and a five-word window is a hash of five numbers. A document without a repeated window, the usual
    one, is told by the number of distinct hashes; only others sort their windows to find the words that repeated windows
    cover.
    """
    rows = documents.withColumn("w", F.expr(word_list("text")))
    windows = "CASE WHEN size(h) < 5 THEN array() ELSE transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])) END"
    rows = rows.withColumn("g", F.expr(f"transform(array(transform(w, x -> xxhash64(x))), h -> {windows})[0]"))
    sorted_windows = "array_sort(transform(g, (h, p) -> named_struct('h', h, 'p', p)))"
    repeats = "transform(array(%s), s -> filter(s, (e, j) -> (j > 0 AND s[j - 1].h = e.h) OR (j < size(s) - 1 AND s[j + 1].h = e.h)))[0]" % sorted_windows
    places = f"array_sort(transform({repeats}, e -> e.p))"
    count = f"aggregate({places}, named_struct('n', 0L, 'last', -5), (a, p) -> named_struct('n', a.n + least(5, p - a.last), 'last', p), a -> a.n)"
    lines = r"filter(split(text, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"
    rows = rows.select(
        *documents.columns,
        F.size("w").cast("long").alias("n_words"),
        F.expr("aggregate(w, 0L, (a, x) -> a + length(x))").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
        F.expr(f"transform(array({lines}), l -> size(l) - size(array_distinct(l)))[0]").cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE {count} END").alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def row_keys(documents: DataFrame) -> DataFrame:
    """The rows with host, d and t, equal for repeated rows of one host only, and the text without nulls."""
    rows = documents.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    # A row without doc_id has another hash of the text, so that its key is no document's.
    t = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit("no doc_id"))).otherwise(F.xxhash64("text"))
    return rows.select("doc_id", "source", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), t.alias("t"), "text")


def normal_lines(documents: DataFrame) -> DataFrame:
    """(host, line hashes, document key, place in the text) of every line with a word."""
    lines = F.split(F.translate("text", SPACES.replace("\n", "") + CAPITALS, " " * 4 + CAPITALS.lower()), "\n")
    rows = row_keys(documents).select("host", "d", "t", F.posexplode(lines).alias("place", "line"))
    rows = rows.withColumn("line", F.trim(F.regexp_replace("line", " +", " "))).where("line <> ''")
    return rows.select("host", F.xxhash64("line").alias("h"), F.xxhash64(F.reverse("line")).alias("h2"), "d", "t", "place")


def without_lines(text: str, places: str) -> str:
    """SQL of a text without the lines at some places, of which none may be null."""
    return rf"transform(array(split({text}, '\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), {places}), i -> l[i]), '\n'))[0]"


def frequent_lines(spark: SparkSession, documents: DataFrame, max_documents: int = MAX_DOCUMENTS, min_kept: float = MIN_KEPT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row with the base counts, ``text`` without its frequent lines, n_removed_words, n_removed_lines
    (distinct) and the verdict ``kept`` on what is left. The base counts are those of the whole text.

    Null texts are empty; a null source is the host ''. Rows with the same doc_id and text are one document in the counts
    and share a verdict. A document without a word fails the base rules. Extra columns are ignored.
    """
    scratch = Scratch(spark, "line-frequency")
    lines = scratch.put(normal_lines(documents), "lines")
    # A table of its own: the join reads two exchanges, so a line of millions of documents can be split between tasks.
    held = lines.select("host", "h", "h2", "d", "t").distinct()
    common = scratch.put(held.groupBy("host", "h", "h2").agg(F.count("*").alias("documents")).where(F.col("documents") > max_documents), "common")
    found = lines.join(common, ["host", "h", "h2"]).groupBy("d", "t", "host")
    lost = scratch.put(found.agg(F.collect_set("place").alias("places"), F.size(F.collect_set(F.struct("h", "h2"))).cast("long").alias("n_removed_lines")), "lost")
    scratch.keep("lost")
    # One plan at every size: how many documents lose lines grows with the corpus, so their places are no broadcast.
    rows = base_rules(row_keys(documents)).join(lost.hint("merge"), ["d", "t", "host"], "left").na.fill(0, ["n_removed_lines"])
    rows = rows.withColumn("text", F.expr(f"CASE WHEN places IS NULL THEN text ELSE {without_lines('text', 'places')} END"))
    left = F.expr(f"CASE WHEN places IS NULL THEN n_words ELSE cast(size({word_list('text')}) AS long) END")
    verdict = (F.col("left") >= min_words) & (F.col("left") >= min_kept * F.col("n_words"))
    out = rows.withColumn("left", left).withColumn("n_removed_words", F.col("n_words") - F.col("left")).withColumn("kept", ~F.col("base_failed") & verdict)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "n_removed_lines", "text")


#: The same in DuckDB's SQL.
SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM words WHERE len(w) >= 5),
grams AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS g FROM windows),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeated AS (SELECT doc_id, sum(least(5, p - coalesce(before, -5)))::BIGINT AS n_repeat_words
             FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM twice) GROUP BY doc_id),
lines AS (SELECT DISTINCT doc_id, host, line, count(*) OVER (PARTITION BY doc_id, line) * (length(line) - length(replace(line, ' ', '')) + 1) AS n
          FROM (SELECT doc_id, host, trim(regexp_replace(regexp_replace(translate(line, '{CAPITALS}', '{CAPITALS.lower()}'), '[\x20\x09-\x0D]', ' ', 'g'), ' +', ' ', 'g')) AS line
                FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM docs)) WHERE line <> ''),
frequent AS (SELECT host, line FROM lines GROUP BY host, line HAVING count(*) > {MAX_DOCUMENTS}),
lost AS (SELECT doc_id, sum(n)::BIGINT AS words, count(*)::BIGINT AS lines FROM lines JOIN frequent USING (host, line) GROUP BY doc_id),
counted AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
       (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       coalesce(lost.words, 0)::BIGINT AS n_removed_words, coalesce(lost.lines, 0)::BIGINT AS n_removed_lines
FROM words LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= {MIN_WORDS} AND n_words - n_removed_words >= {MIN_KEPT} * n_words AS kept,
       n_removed_words, n_removed_lines
FROM counted
"""
