"""Quality rules: how far a document's histograms lie from those of its language (Jensen-Shannon distance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm import text

#: Words of a repeated window, and the marks counted as symbols.
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: Character classes of the histogram, in order: lower case and caseless, upper case, digits, white space, symbols, other marks.
CLASSES = ("lower", "upper", "digit", "space", "symbol", "mark")
#: Words of the histogram's reference, of the wide reference (those with a letter), and slots in which both are looked up by hash.
COMMON, WIDE, SLOTS = 24, 400, 512
#: Lower-case and caseless letters and white space, the characters most texts are made of.
LETTERS = r"[\p{Ll}\p{Lo}\x20\x09-\x0D]+"
#: Most languages whose references are sent to every executor (about 20 kB each); more are joined by a shuffle.
BROADCAST_LANGUAGES = 500
#: Fewest words of the wide reference that a text must be expected to have to be judged by them.
LEAST_EXPECTED = 20
#: Codes of reference words: a capital for each common one, in small if it has no letter, and one character for all others.
CAPITALS, OTHER = "ABCDEFGHIJKLMNOPQRSTUVWX", "*"
#: A word's first letter, found once for each word that has one.
LETTERED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}"


def base(docs: DataFrame) -> DataFrame:
    """``docs`` with _words and the base counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and _classes.

    Row-wise. Window hashes are 64 bits wide and only compared within one text.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_words", text.words(F.col("text")))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def pairs_of(step: int):
        """Hash of each value and the one ``step`` further: windows twice as long."""
        return lambda v: F.transform(F.slice(v, 1, F.greatest(F.size(v) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(v, i + step)))

    windows = F.transform("_words", lambda w: F.xxhash64(w))
    for step in (1, 2, 4):  # WINDOW is 8
        windows = text.let(windows, pairs_of(step))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_dup_lines": text.let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "_odd": F.regexp_replace(raw, LETTERS, ""),
        "_windows": windows,
    })

    def covered(starts: Column) -> Column:
        """Words in windows that start at these sorted places."""
        steps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")

    def repeated(pairs: Column) -> Column:
        same = F.filter(pairs, lambda x, i: (x["h"] == F.get(pairs, i - 1)["h"]) | (x["h"] == F.get(pairs, i + 1)["h"]))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = text.let(text.let(pairs, repeated), covered)
    df = df.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), again).otherwise(F.lit(0).cast("long")))

    found = _odd_counts("_odd")
    df = df.withColumns({"n_symbols": found["symbol"], "_upper": found["upper"], "_digit": found["digit"]}).drop("_windows")
    rest = F.length("_odd") - F.col("n_symbols") - F.col("_upper") - F.col("_digit")
    histogram = F.array(
        F.col("word_chars") - F.length("_odd"), F.col("_upper"), F.col("_digit"), F.length(raw) - F.col("word_chars"), F.col("n_symbols"), rest
    ).cast("array<double>")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumns({"_classes": histogram, "base_failed": failed}).drop("_odd", "_upper", "_digit")


def _odd_counts(column: str) -> dict[str, Column]:
    """Symbols, upper-case letters and digits in what is left of a text without ``LETTERS``."""
    patterns = {"symbol": SYMBOLS + "+", "upper": r"[\p{Lu}\p{Lt}]+", "digit": r"\p{N}+"}
    return {name: (F.length(column) - F.length(F.regexp_replace(column, p, ""))).cast("long") for name, p in patterns.items()}


def slot(w: Column) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")


def references(docs: DataFrame) -> DataFrame:
    """One row per language over all documents: character classes, common words and the wide reference.

    _word_ref counts the ``COMMON`` most frequent words, which _common lists, and all others; _share is the share of the ``WIDE`` most frequent words with a
    letter among all words with a letter. Both kinds are looked up in _slot_words, lists of words by the hash of a word, and
    their codes in _slot_codes. Words of any length count, repeated rows count each, equal counts rank by the word. An empty table
    gives no rows; a language without words has no word references. Counts are added before each shuffle.
    """
    with text.scratch():
        return text.keep(_references(docs), "divergence-references")


def _references(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").alias("_lang")
    seen = docs.select(lang, F.explode(text.words(F.col("text"))).alias("w"))
    counted = text.stored(seen.groupBy("_lang", "w").agg(F.count("*").alias("n")), "divergence-words")
    lettered = F.col("w").rlike(r"\p{L}").alias("lettered")
    ranked = {}
    for name, rows, most in (("common", counted, COMMON), ("wide", counted.where(lettered), WIDE)):
        rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "w"))
        ranked[name] = rows.withColumn("k", rank).where(F.col("k") <= most)
    capital = F.substring(F.lit(CAPITALS), F.col("k"), F.lit(1))
    top = ranked["common"].select("_lang", "w", "n", F.when(lettered, capital).otherwise(F.lower(capital)).alias("code"), F.lit(True).alias("common"))
    wide = ranked["wide"].select("_lang", "w", "n", F.lit(OTHER).alias("code"), F.lit(False).alias("common"))
    entry = F.struct(slot(F.col("w")).alias("s"), "w", F.col("code"))
    both = top.unionByName(wide).groupBy("_lang", "w").agg(F.max("code").alias("code"), F.max("common").alias("common"), F.max("n").alias("n"), (F.count("*") - F.max("common").cast("int")).alias("wide"))
    sums = both.groupBy(F.col("_lang").alias("_l1")).agg(
        F.collect_list(entry).alias("entries"), F.array_sort(F.collect_list(F.when(F.col("common"), F.struct(F.upper("code").alias("k"), "n", "w")))).alias("common"),
        F.sum(F.col("n") * F.col("wide")).alias("_n"),
    )
    # characters of the classes are counted in the distinct words; what is not in a word is white space
    letters = counted.withColumn("_odd", F.regexp_replace("w", LETTERS, "")).groupBy(F.col("_lang").alias("_l2")).agg(
        F.sum("n").alias("_total"), F.sum(F.when(lettered, F.col("n"))).alias("_all"), F.sum(F.col("n") * F.length("w")).alias("_chars"),
        *[F.sum(F.col("n") * c).alias(name) for name, c in (("odd", F.length("_odd")), *_odd_counts("_odd").items())],
    )
    out = docs.groupBy(lang).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("_length"))
    for other, name in ((sums, "_l1"), (letters, "_l2")):
        out = out.join(other, F.col("_lang").eqNullSafe(F.col(name)), "left").drop(name)
    none = F.lit(0).cast("long")
    odd, upper, digit, symbol, chars = (F.coalesce(c, none) for c in ("odd", "upper", "digit", "symbol", "_chars"))
    out = out.withColumn("_class_ref", F.array(chars - odd, upper, digit, F.col("_length") - chars, symbol, odd - upper - digit - symbol).cast("array<double>"))

    def by_slot(field: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.transform(F.filter("entries", lambda e: e["s"] == i), lambda e: e[field]))

    counts = F.transform("common", lambda e: e["n"])
    words = F.concat(counts, F.array(F.col("_total") - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x))).cast("array<double>")
    common = F.transform("common", lambda e: e["w"]).alias("_common")
    return out.select("_lang", "_class_ref", words.alias("_word_ref"), common, by_slot("w").alias("_slot_words"), by_slot("code").alias("_slot_codes"), (F.col("_n") / F.col("_all")).alias("_share"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of equal length; null if one is empty."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def side(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def terms(t: Column) -> Column:
        def term(a: Column, b: Column) -> Column:
            x, y = a / t["p"], b / t["q"]
            return side(x, (x + y) / 2) + side(y, (x + y) / 2)

        return F.sqrt(F.greatest(total(F.zip_with(p, q, term)) / 2, F.lit(0.0)))

    return F.when((total(p) > 0) & (total(q) > 0), text.let(F.struct(total(p).alias("p"), total(q).alias("q")), terms))


def judge(docs: DataFrame, refs: DataFrame, max_classes: float = 0.28, max_words: float = 0.42, min_chars: int = 200, min_words: int = 50, least_cover: float = 0.4) -> DataFrame:
    """``docs`` with the base counts, class_distance, word_distance and ``kept``.

    ``kept`` is false if the base rules fail, if a text of at least ``min_chars`` characters is further than ``max_classes`` from
    its language's character classes, or one of at least ``min_words`` words further than ``max_words`` from its common words.
    The common words alone cannot tell languages apart: a text with none of them is still within ``max_words``. So ``kept`` is also
    false if a text has less than ``least_cover`` of the words of its language's wide reference that are expected among its words
    with a letter, as texts in another language or of invented letters do; it is judged if ``LEAST_EXPECTED`` or more are expected.

    Shorter texts are too noisy to judge by a histogram and pass it. Null texts have no words and fail the base rules; a null
    language is a language of its own. Repeated rows are judged alike, an empty table gives no rows. Texts of any length are
    judged whole, in one row. Row-wise, with the references joined by language.
    """
    few = refs.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    df = base(docs).join(F.broadcast(refs) if few else refs, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")

    def code(w: Column) -> Column:
        return F.get(F.get("_slot_codes", slot(w)), F.array_position(F.get("_slot_words", slot(w)), w).cast("int") - 1)

    # a character for each known word
    df = df.withColumn("_known", F.array_join(F.transform("_words", code), ""))
    df = df.withColumn("_own", F.upper(F.translate("_known", OTHER, "")))
    # a language may have fewer common words than others
    own = F.slice(F.array(*[F.length("_own") - F.length(F.replace("_own", F.lit(c))) for c in CAPITALS]), 1, F.size("_word_ref") - 1)
    df = df.withColumn("_own", F.when(F.col("_word_ref").isNotNull(), F.concat(own, F.array(F.col("n_words").cast("int") - F.length("_own")))).cast("array<double>"))
    df = df.withColumns({"class_distance": js_distance(F.col("_classes"), F.col("_class_ref")), "word_distance": js_distance(F.col("_own"), F.col("_word_ref"))})
    odd_classes = (F.length("text") >= min_chars) & (F.col("class_distance") > max_classes)
    odd_words = (F.col("n_words") >= min_words) & (F.col("word_distance") > max_words)
    df = df.withColumn("n_known", F.length(F.translate("_known", CAPITALS.lower(), "")).cast("long"))
    # words with a letter are counted where the text has too few known words even if not all of its words have one
    lettered = F.when(F.col("n_known") < least_cover * (F.col("n_words") * F.col("_share")), F.regexp_count("text", F.lit(LETTERED)))
    df = df.withColumn("_expected", lettered * F.col("_share"))
    foreign = (F.col("_expected") >= LEAST_EXPECTED) & (F.col("n_known") < least_cover * F.col("_expected"))
    kept = ~F.col("base_failed") & ~F.coalesce(odd_classes, F.lit(False)) & ~F.coalesce(odd_words, F.lit(False)) & ~F.coalesce(foreign, F.lit(False))
    return df.withColumn("kept", kept).drop("_words", "_own", "_known", "_classes", "_class_ref", "_word_ref", "_common", "_slot_words", "_slot_codes", "_share", "_expected")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rate_documents(docs: DataFrame) -> DataFrame:
    """Every document with its counts, verdicts, distances (rounded to 6 digits) and n_known, its words of the wide reference.

    Only doc_id, text and lang are read. Nulls, ties, repeated rows and empty tables: see ``judge`` and ``references``.
    """
    docs = docs.select("doc_id", "text", "lang")
    rated = judge(docs, references(docs))
    return rated.select("doc_id", *COUNTS, "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"), "n_known")


def rules_stage(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep (``judge``), with the columns of ``docs``. Null texts go, an empty table stays empty."""
    own = docs.select(text.row_of(docs), "text", "lang")
    # the id keeps the optimizer from moving the filter below the projections, which would repeat each of them in the next
    judged = judge(own, references(docs)).select("_row", "kept", F.monotonically_increasing_id().alias("_id"))
    return judged.where("kept AND _id >= 0").select("_row.*")


def op2_distribution_divergence(spark, sf_dir: str) -> DataFrame:
    return rate_documents(text.load(spark, sf_dir, "documents"))


def _side(x: str, y: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"


OP2_SQL = rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM x), (SELECT unnest(range(8)) AS j) WHERE n > 1 GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM d),
b AS (SELECT d.doc_id, lang, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '[\p{{Ll}}\p{{Lo}}\x20\x09-\x0D]+', '', 'g')) AS odd,
    length(t) - length(regexp_replace(t, '[\p{{Lu}}\p{{Lt}}]+', '', 'g')) AS upper_, length(t) - length(regexp_replace(t, '\p{{N}}+', '', 'g')) AS digit_
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
e AS (SELECT doc_id, lang, unnest([word_chars - odd, upper_, digit_, length(t) - word_chars, n_symbols, odd - n_symbols - upper_ - digit_]) * 1e0 AS n, unnest(range(6)) AS k FROM b),
r AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM e GROUP BY 1, 2),
p AS (SELECT doc_id, lang, k, n / nullif(sum(n) OVER (PARTITION BY doc_id), 0) AS p FROM e),
cd AS (SELECT doc_id, sqrt(greatest(sum({_side("p", "q")} + {_side("q", "p")}) / 2, 0)) AS class_distance FROM p JOIN r ON p.lang IS NOT DISTINCT FROM r.lang AND p.k = r.k WHERE p IS NOT NULL GROUP BY 1),
f AS (SELECT lang, s, count(*) AS n FROM (SELECT lang, unnest(w) AS s FROM d) GROUP BY 1, 2),
tt AS (SELECT lang, sum(n) AS total FROM f GROUP BY 1),
top AS (SELECT * FROM (SELECT lang, s, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, s) AS k FROM f) WHERE k <= 24),
wide AS (SELECT * FROM (SELECT lang, s, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, s) AS k FROM f WHERE regexp_matches(s, '\p{{L}}')) WHERE k <= 400),
share AS (SELECT w.lang, w.n / a.n AS share FROM (SELECT lang, sum(n) * 1e0 AS n FROM wide GROUP BY 1) w JOIN (SELECT lang, sum(n) * 1e0 AS n FROM f WHERE regexp_matches(s, '\p{{L}}') GROUP BY 1) a ON a.lang IS NOT DISTINCT FROM w.lang),
kn AS (SELECT doc_id, count(*) AS n_known FROM (SELECT doc_id, lang, unnest(w) AS s FROM d) u JOIN wide ON wide.s = u.s AND wide.lang IS NOT DISTINCT FROM u.lang GROUP BY 1),
ex AS (SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) * share AS expected FROM d JOIN share ON share.lang IS NOT DISTINCT FROM d.lang),
own AS (SELECT doc_id, s, count(*) AS n FROM (SELECT doc_id, lang, unnest(w) AS s FROM d) u WHERE EXISTS (SELECT 1 FROM top WHERE top.s = u.s AND top.lang IS NOT DISTINCT FROM u.lang) GROUP BY 1, 2),
m AS (SELECT b.doc_id, coalesce(own.n, 0) * 1e0 / b.n_words AS p, top.n * 1e0 / total AS q FROM b JOIN top ON b.lang IS NOT DISTINCT FROM top.lang JOIN tt ON tt.lang IS NOT DISTINCT FROM b.lang
    LEFT JOIN own ON own.doc_id = b.doc_id AND own.s = top.s WHERE b.n_words > 0),
wd AS (SELECT doc_id, sqrt(greatest((sum({_side("p", "q")} + {_side("q", "p")}) + any_value(0e0) + {_side("greatest(1 - sum(p), 0)", "greatest(1 - sum(q), 0)")} + {_side("greatest(1 - sum(q), 0)", "greatest(1 - sum(p), 0)")}) / 2, 0)) AS word_distance
  FROM m GROUP BY 1),
z AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id) LEFT JOIN kn USING (doc_id) LEFT JOIN ex USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(length(t) >= 200 AND class_distance > 28e-2, false) AND NOT coalesce(n_words >= 50 AND word_distance > 42e-2, false)
  AND NOT coalesce(expected >= 20 AND coalesce(n_known, 0) < 4e-1 * expected, false) AS kept, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM z"""
