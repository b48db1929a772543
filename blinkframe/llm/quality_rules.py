"""Quality rules by distribution divergence, in DataFrame functions alone.

A text's histogram of character classes and its histogram of common words are compared with those of its language by
Jensen-Shannon distance. A language's reference is the mean of the shares of all its texts that pass the base rules and are
long enough, summed as whole millionths, so it is the same in whatever order rows come. Texts that are too short for a
histogram pass its rule.
References are one row for each language with a word list and one for all others: that bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blinkframe.llm.frames import checkpoint

MIN_CHARS = 200
MIN_WORDS = 100
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.29

#: Frequent function words by language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "er", "so"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "are", "as", "with", "be", "by", "at", "this", "from", "or", "have", "an", "not"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como", "o", "pero"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "plus", "au", "ne", "se", "ce", "il"],
}

SPACE = r"[\x20\x09-\x0D]"
#: Letters a-z and blanks make up most of a text; the classes are counted in what is left without them.
PLAIN = r"[a-z \n]+"
#: Character classes by pattern; white space and what is in none of them are classes of their own.
CLASSES = {"upper": "[A-Z]+", "digit": "[0-9]+", "stop": "[.,;:!?'\"()-]+", "symbol": "[#*$%&|<>]+", "beyond": r"[^\x00-\x7F]+"}


def _sum(counts: str | Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda t, x: t + x)


def _millionths(counts: Column) -> Column:
    return F.transform(counts, lambda x: F.floor(x * 1_000_000 / F.greatest(_sum(counts), F.lit(1))).cast("long"))


def distance(a: str, b: str) -> Column:
    """Jensen-Shannon distance, in bits, of two columns with arrays of shares."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y)) / 2).otherwise(0.0)

    total = F.aggregate(F.zip_with(a, b, lambda x, y: part(x, y) + part(y, x)), F.lit(0.0), lambda t, x: t + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _histograms(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Columns q_text, q_lang, q_words (array), q_word_chars, q_classes and q_common beside those of ``docs``."""
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    clean = docs.withColumn("q_text", F.coalesce(F.col(text), F.lit("")))
    clean = clean.withColumn("q_lang", F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang)).otherwise(""))
    clean = clean.withColumn("q_words", F.array_remove(F.split("q_text", SPACE + "+", -1), ""))
    clean = clean.withColumn("q_n_words", F.size("q_words").cast("long"))
    clean = clean.withColumn("q_n_chars", F.length("q_text").cast("long"))
    clean = clean.withColumn("q_word_chars", F.length(F.array_join("q_words", "")).cast("long"))
    clean = clean.withColumn("q_rest", F.regexp_replace("q_text", PLAIN, ""))
    named = [(F.length("q_rest") - F.length(F.regexp_replace("q_rest", p, ""))).cast("long") for p in CLASSES.values()]
    clean = clean.withColumn("q_named", F.array(*named, F.col("q_n_chars") - F.col("q_word_chars")))
    clean = clean.withColumn("q_classes", F.concat("q_named", F.array(F.col("q_n_chars") - _sum("q_named"))))
    clean = clean.withColumn("q_listed", F.coalesce(lists[F.col("q_lang")], F.array().cast("array<string>")))
    clean = clean.withColumn("q_at", F.array_remove(F.transform("q_words", lambda w: F.array_position("q_listed", w)), F.lit(0).cast("long")))
    longest = max(map(len, COMMON_WORDS.values()))
    hits = [(F.size("q_at") - F.size(F.array_remove("q_at", F.lit(i + 1).cast("long")))).cast("long") for i in range(longest)]
    clean = clean.withColumn("q_hits", F.slice(F.array(*hits), 1, F.size("q_listed")))
    common = F.when(F.size("q_hits") > 0, F.concat("q_hits", F.array((F.size("q_words") - F.size("q_at")).cast("long")))).otherwise(F.array().cast("array<long>"))
    return clean.withColumn("q_common", common)


def references(found: DataFrame) -> DataFrame:
    """Reference shares from rows with histograms that pass the base rules, a row for each language: r_lang, r_classes, r_common."""
    bins = len(CLASSES) + 2
    words = max(map(len, COMMON_WORDS.values())) + 1
    shares = found.filter("not q_base_failed").select(
        F.col("q_lang").alias("r_lang"),
        F.when(F.col("q_n_chars") >= MIN_CHARS, _millionths(F.col("q_classes"))).alias("c"),
        F.when((F.col("q_n_words") >= MIN_WORDS) & (F.size("q_common") > 0), _millionths(F.col("q_common"))).alias("w"),
    )
    summed = shares.groupBy("r_lang").agg(*[F.coalesce(F.sum(F.get("c", F.lit(i))), F.lit(0)).alias(f"c{i}") for i in range(bins)], *[F.coalesce(F.sum(F.get("w", F.lit(i))), F.lit(0)).alias(f"w{i}") for i in range(words)])
    shares = lambda c, n: F.transform(F.array(*[f"{c}{i}" for i in range(n)]), lambda x: F.try_divide(x, _sum(F.array(*[f"{c}{i}" for i in range(n)]))))
    return summed.select("r_lang", shares("c", bins).alias("r_classes"), shares("w", words).alias("r_common"))


def _repeated(docs: DataFrame) -> DataFrame:
    """q_repeated: words in 3-word windows that occur twice or more in the text."""
    # Equal windows have equal hashes: only texts with some of these get their windows as strings.
    starts = F.sequence(F.lit(0), F.size("q_words") - 3)
    window = lambda i: [F.get("q_words", i + k) for k in range(3)]
    docs = docs.withColumn("q_hashes", F.when(F.size("q_words") >= 3, F.transform(starts, lambda i: F.xxhash64(*window(i)))))
    several = F.size(F.array_distinct("q_hashes")) < F.size("q_hashes")
    docs = docs.withColumn("q_sorted", F.when(several, F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i"))))))
    before, behind = (lambda j: F.get("q_sorted", j - 1)["w"]), (lambda j: F.get("q_sorted", j + 1)["w"])
    twice = F.filter("q_sorted", lambda x, j: x["w"].eqNullSafe(before(j)) | x["w"].eqNullSafe(behind(j)))
    docs = docs.withColumn("q_starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    new = F.transform("q_starts", lambda s, j: F.least(F.lit(3), F.coalesce(F.get("q_starts", j + 1) - s, F.lit(3))))
    return docs.withColumn("q_repeated", F.coalesce(F.aggregate(new, F.lit(0).cast("long"), lambda t, x: t + x), F.lit(0).cast("long")))


def _base(rows: DataFrame) -> DataFrame:
    """Add the measures that need no reference to rows with histograms."""
    rows = _repeated(rows)
    rows = rows.withColumn("q_lines", F.filter(F.split("q_text", "\n", -1), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0))
    return rows.withColumns({
        "q_n_symbols": F.get("q_classes", F.lit(list(CLASSES).index("symbol"))),
        "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "q_base_failed": (F.col("q_n_words") < 50) | (100 * F.col("q_repeated") > 50 * F.col("q_n_words")),
    })


def _judged(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Add distances and verdict to rows with all measures."""
    rows = rows.join(F.broadcast(known), rows["q_lang"] == known["r_lang"], "left")
    shares = lambda c: F.transform(c, lambda x: x / F.greatest(_sum(c), F.lit(1)))
    rows = rows.withColumns({"q_class_shares": shares("q_classes"), "q_common_shares": shares("q_common"), "r_fit": F.slice("r_common", 1, F.size("q_common"))})
    rows = rows.withColumns({
        "q_class_distance": F.when(F.col("q_n_chars") >= MIN_CHARS, distance("q_class_shares", "r_classes")),
        "q_word_distance": F.when((F.col("q_n_words") >= MIN_WORDS) & (F.size("q_common") > 0), distance("q_common_shares", "r_fit")),
    })
    # A language without a text of sufficient length has no reference; its rows are never measured against one.
    # One comparison: a conjunction would be split, and its part without references pushed into the measures and expanded there.
    over = F.greatest(
        F.coalesce("q_class_distance", F.lit(0.0)) - MAX_CLASS_DISTANCE,
        F.coalesce("q_word_distance", F.lit(0.0)) - MAX_WORD_DISTANCE,
        F.when(F.col("q_base_failed"), 1.0).otherwise(-1.0),
    )
    return rows.withColumn("q_kept", over <= 0)


MEASURES = ["q_lang", "q_n_chars", "q_n_words", "q_word_chars", "q_classes", "q_common", "q_n_symbols", "q_n_dup_lines", "q_repeated", "q_base_failed"]


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the distances.

    Null text counts as empty and fails the base rule; languages without a word list, null among them, share one
    reference of character classes and have no word rule. Rows that repeat give equal rows. Other columns are ignored.
    Texts are read once: their measures are checkpointed, references come from those.
    """
    own = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    rows = checkpoint(_base(_histograms(own, "text", "lang")).select("doc_id", *MEASURES))
    return _judged(rows, references(rows)).select(
        "doc_id", F.col("q_n_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"), F.col("q_n_symbols").alias("n_symbols"),
        F.col("q_n_dup_lines").alias("n_dup_lines"), F.col("q_repeated").alias("n_repeat_words"), F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"),
        F.round(F.coalesce("q_class_distance", F.lit(0.0)), 4).alias("class_distance"), F.round(F.coalesce("q_word_distance", F.lit(0.0)), 4).alias("word_distance"),
    )


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of ``docs`` that pass, with all their columns.

    Texts are measured once and never shuffled: rows are checkpointed with their measures.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(docs.columns)]).alias("q_row"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    # Not filtered before: a condition would be pushed below the measures, which then are expanded in it.
    rows = checkpoint(_base(_histograms(own, "text", "lang")).select("q_row", *MEASURES))
    kept = _judged(rows, references(rows)).filter("q_kept")
    return kept.select(*[F.col(f"q_row.c{n}").alias(c) for n, c in enumerate(docs.columns)])


def duckdb_sql() -> str:
    """The same over a view ``documents`` in DuckDB."""
    listed = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON_WORDS.items())
    codes = ", ".join(f"'{k}'" for k in COMMON_WORDS)
    classes = ", ".join("length(rest) - length(regexp_replace(rest, '{}', '', 'g'))".format(p.replace("'", "''")) for p in CLASSES.values())
    bins, words = len(CLASSES) + 2, max(map(len, COMMON_WORDS.values())) + 1
    sums = lambda c, n: "[" + ", ".join(f"coalesce(sum({c}[{i + 1}]), 0)" for i in range(n)) + "]"
    share = lambda c: f"list_transform({c}, lambda x: floor(x * 1000000 / greatest(list_sum({c}), 1))::BIGINT)"
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) / 2 ELSE 0.0 END"

    def far(c: str, r: str) -> str:
        x, y = f"(z[1] / greatest(list_sum({c}), 1))", "z[2]"
        total = f"list_sum(list_transform(list_zip({c}, {r}[:len({c})]), lambda z: {part(x, y)} + {part(y, x)}))"
        return f"sqrt(greatest({total}, 0.0))"

    return rf"""
    WITH a AS (
      SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({codes}) THEN lang ELSE '' END AS l FROM documents
    ), b AS (
      SELECT *, list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '') AS w,
             length(regexp_replace(t, '{SPACE}+', '', 'g')) AS word_chars, regexp_replace(t, '{PLAIN}', '', 'g') AS rest,
             [{classes}, length(t) - word_chars] AS named,
             CASE l {listed} ELSE [] END AS listed
      FROM a
    ), c AS (
      SELECT *, list_append(named, length(t) - list_sum(named)::BIGINT) AS classes,
             list_transform(listed, lambda x: len(list_filter(w, lambda y: y = x))) AS hits
      FROM b
    ), d AS (
      SELECT *, CASE WHEN len(hits) > 0 THEN list_append(hits, len(w) - list_sum(hits)::BIGINT) ELSE [] END AS common FROM c
    ), v AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
    g AS (SELECT doc_id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) AS k(o) GROUP BY doc_id),
    e AS (
      SELECT d.*, len(w)::BIGINT AS n_words, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed
      FROM d LEFT JOIN rep USING (doc_id)
    ), s AS (
      SELECT l, {sums("c", bins)} AS r_classes, {sums("w", words)} AS r_common FROM (
        SELECT l, CASE WHEN length(t) >= {MIN_CHARS} THEN {share("classes")} END AS c,
               CASE WHEN len(w) >= {MIN_WORDS} AND len(common) > 0 THEN {share("common")} END AS w FROM e WHERE NOT base_failed) GROUP BY l
    ), r AS (
      SELECT l, list_transform(r_classes, lambda x: x / list_sum(r_classes)) AS r_classes, list_transform(r_common, lambda x: x / list_sum(r_common)) AS r_common FROM s
    ), m AS (
      SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, classes[{list(CLASSES).index("symbol") + 1}]::BIGINT AS n_symbols,
             (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
             n_repeat_words, base_failed,
             coalesce(CASE WHEN length(t) >= {MIN_CHARS} THEN {far("classes", "r_classes")} END, 0.0) AS c_far,
             coalesce(CASE WHEN len(w) >= {MIN_WORDS} AND len(common) > 0 THEN {far("common", "r_common")} END, 0.0) AS w_far
      FROM e LEFT JOIN r USING (l)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND c_far <= {MAX_CLASS_DISTANCE} AND w_far <= {MAX_WORD_DISTANCE} AS kept,
           round(c_far, 4) AS class_distance, round(w_far, 4) AS word_distance
    FROM m
    """
