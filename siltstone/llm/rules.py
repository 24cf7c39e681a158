"""Quality rules: a ledger of failure bits and measurements, policies on top, ablations by bits.

Every rule is evaluated once for each text, in one scan without a shuffle. The ledger, a written table, keeps a
bit for each failed rule and the measurements; a policy is a version and the set of rules that
reject, so a new policy needs only the ledger. Ablations come from the counts of equal ledgers.

The rules are of the published families: length, repetition, symbols, repeated lines, mean length of words, words with
letters, lines of bullets and of ellipses, different stop words, the share of the most frequent pair of words.

Repeated words are found within the row: each window of eight words is hashed; if no two hashes are
equal nothing repeats, else the sorted hashes show the windows that do, and the gaps between
their places the words they cover. (Windows are compared by 64-bit hashes.)

Nulls: a null text has no words, like an empty one, and fails few_words. Rows are kept apart, repeated
ones too. An empty table gives an empty ledger. Only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, bound, staged, texts

WINDOW = 8
LETTER_WORD = r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*"
BULLET, ELLIPSIS = r"^[ \t]*[•‣▪*\-]", r"(?:\.\.\.|…)[ \t\r]*\z"

#: Frequent function words of the languages that are judged.
STOP_WORDS = (
    "the be to of and that have with in is it for on as this are was "
    "der die das und ist in den von zu mit nicht ein eine es auf für "
    "le la les de des et en un une est que dans pour pas sur "
    "el los las y que en un una es por con no del para"
).split()
#: Rules by bit: name and the condition under which a text fails, over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    ("letters", "100 * n_letter_words < 80 * n_words"),
    ("bullets", "100 * n_bullet_lines > 90 * n_lines"),
    ("ellipses", "100 * n_ellipsis_lines > 30 * n_lines"),
    ("stop_words", "n_stop_words < 2"),
    ("top_pair", "10 * n_top_pair > n_words"),
]
BASE = ("few_words", "repeated_words")
#: Policies by version: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "1": BASE,
    "2": (*BASE, "symbols", "letters", "bullets", "ellipses", "stop_words", "top_pair"),
    "3": tuple(name for name, _ in RULES),
}
CURRENT = "2"


def mask(rules) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def _repeated(hashes: Column, n_words: Column) -> Column:
    """Words within windows whose hash occurs twice or more; hashes: by place."""
    return F.when(
        (n_words > WINDOW) & (F.size(F.array_distinct(hashes)) < F.size(hashes)),
        bound(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), _covered),
    ).otherwise(0)


def _covered(by_hash: Column) -> Column:
    def twice(x: Column, i: Column) -> Column:
        return x["h"].eqNullSafe(F.get(by_hash, i - 1)["h"]) | x["h"].eqNullSafe(F.get(by_hash, i + 1)["h"])

    def words(places: Column) -> Column:
        # the last window counts in full, any other up to the next window's start
        gaps = F.zip_with(places, F.slice(places, F.lit(2), F.size(places)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    return bound(F.array_sort(F.transform(F.filter(by_hash, twice), lambda x: x["i"])), words)


def _most_frequent(sorted_hashes: Column) -> Column:
    """Length of the longest run of equal numbers."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, h: Column) -> Column:
        run = F.when(s["last"].eqNullSafe(h), s["run"] + 1).otherwise(1)
        return F.struct(h.alias("last"), run.alias("run"), F.greatest(run, s["most"]).alias("most"))

    return F.aggregate(sorted_hashes, start, step)["most"]


def ledger(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, the measurements, and failed: a bit for each rule."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    word_hashes = F.transform(F.col("words"), lambda w: F.xxhash64(w))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(1)).cast("int")), lambda i: F.xxhash64(F.slice(F.col("word_hashes"), i, F.lit(WINDOW))))
    pairs = F.zip_with(F.slice("word_hashes", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))), F.slice("word_hashes", F.lit(2), F.size("words")), lambda a, b: F.xxhash64(a, b))
    measured = (
        docs.select("doc_id", text.alias("t"))
        .withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
        .withColumn("lines", lines)
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_hashes", word_hashes)
        .withColumn("windows", F.when(F.col("n_words") > WINDOW, windows))
        .select(
            "doc_id",
            "n_words",
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.regexp_count("t", F.lit(LETTER_WORD)).cast("long").alias("n_letter_words"),
            F.size(F.filter("lines", lambda x: F.rlike(x, F.lit(BULLET)))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter("lines", lambda x: F.rlike(x, F.lit(ELLIPSIS)))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.array_intersect(F.transform("words", lambda w: F.lower(w)), F.lit(STOP_WORDS))).cast("long").alias("n_stop_words"),
            _most_frequent(F.sort_array(pairs)).cast("long").alias("n_top_pair"),
            _repeated(F.col("windows"), F.col("n_words")).cast("long").alias("n_repeat_words"),
        )
    )
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, condition) in enumerate(RULES)]
    return measured.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def verdicts(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with kept, by a policy."""
    return ledger.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablations(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that stay kept without it."""
    spark, rules = ledger.sparkSession, [(r, mask([r])) for r in POLICIES[policy]]
    counts = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))).alias("bits")).count()
    one = spark.createDataFrame(rules, "rule string, bit long")
    per = counts.select("count", "bits", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for r, b in rules))).alias("r"))
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    found = per.groupBy("r.rule").agg(
        F.coalesce(F.sum(F.when(fails, F.col("count"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count"))), F.lit(0)).alias("n_only_it"),
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("r.bit")) == 0, F.col("count"))), F.lit(0)).alias("n_kept_without"),
    )
    return one.join(found, "rule", "left").na.fill(0).select("rule", "n_failed", "n_only_it", "n_kept_without")


MEASURED = ("n_lines", "n_letter_words", "n_bullet_lines", "n_ellipsis_lines", "n_stop_words", "n_top_pair", "failed")


def op6_rule_ledger(spark, sf_dir: str) -> DataFrame:
    kept = staged(ledger(texts(spark, sf_dir)), "rule-ledger")
    for version in POLICIES:
        kept = verdicts(kept, version).withColumnRenamed("kept", f"kept_{version}")
    base = (F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0).alias("base_failed")
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base, F.col(f"kept_{CURRENT}").alias("kept"), *(f"kept_{v}" for v in POLICIES), *MEASURED)


def rule_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of each policy does, from one written ledger."""
    made = staged(ledger(texts(spark, sf_dir)), "rule-ledger")
    return reduce(DataFrame.unionByName, (ablations(made, v).withColumn("policy", F.lit(v)) for v in POLICIES))


_BITS = " + ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, (_, condition) in enumerate(RULES))
_LEDGER = rf"""
WITH t AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT row_no, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT row_no, i, list_slice(words, i, i + 7) AS win
        FROM (SELECT row_no, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)),
rep AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT row_no, sum(least(coalesce(nxt - i, 8), 8)) AS n
        FROM (SELECT row_no, i, lead(i) OVER (PARTITION BY row_no ORDER BY i) AS nxt FROM rep) GROUP BY row_no),
pairs AS (SELECT row_no, max(c) AS n FROM (SELECT row_no, count(*) AS c FROM (SELECT row_no, words[i] AS x, words[i + 1] AS y FROM (SELECT row_no, words, unnest(range(1, len(words))) AS i FROM w)) GROUP BY row_no, x, y) GROUP BY row_no),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_append(words, ''), 'string_agg', '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_letter_words,
        CAST(len(list_filter(lines, lambda x: regexp_matches(x, '{BULLET}'))) AS BIGINT) AS n_bullet_lines,
        CAST(len(list_filter(lines, lambda x: regexp_matches(x, '{ELLIPSIS}'))) AS BIGINT) AS n_ellipsis_lines,
        CAST(len(list_intersect(list_distinct(list_transform(words, lambda x: lower(x))), {STOP_WORDS})) AS BIGINT) AS n_stop_words,
        CAST(coalesce(pairs.n, 0) AS BIGINT) AS n_top_pair,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (row_no) LEFT JOIN pairs USING (row_no)),
f AS (SELECT *, CAST({_BITS} AS BIGINT) AS failed FROM m)
"""
SQL = _LEDGER + f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {mask(BASE)}) <> 0 AS base_failed, (failed & {mask(POLICIES[CURRENT])}) = 0 AS kept,
       {", ".join(f"(failed & {mask(rules)}) = 0 AS kept_{v}" for v, rules in POLICIES.items())}, {", ".join(MEASURED)} FROM f
"""
ABLATIONS_SQL = _LEDGER + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, count(*) FILTER ((failed & {mask([rule])}) <> 0) AS n_failed, count(*) FILTER ((failed & {mask(rules)}) = {mask([rule])}) AS n_only_it, count(*) FILTER ((failed & {mask(rules) & ~mask([rule])}) = 0) AS n_kept_without, '{v}' AS policy FROM f"
    for v, rules in POLICIES.items()
    for rule in rules
)
