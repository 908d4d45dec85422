"""Quality rules: how far a document's histograms are from those of its language.

Two histograms are made of every whole text: of character classes, and of the common words of
the supported languages with all other words as one class. The reference of a language is
the mean histogram of all its documents. A document is judged by the language that is
nearest to it, in Jensen-Shannon distance (base 2, so between 0 and 1). All of it is
DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelark.llm._common import WORD, stored

# Common words of the supported languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "as", "with", "be", "by", "this", "are"],
    "fr": ["de", "la", "le", "et", "les", "des", "un", "une", "du", "en", "que", "qui", "pour", "dans", "par", "sur", "au", "est"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "auch"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para", "es", "al"],
}
WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
MIN_WORDS, MIN_CHARS = 50, 200
FAR_CHARS, FAR_WORDS = 0.32, 0.37
SPACE = r"[\x20\x09-\x0D]+"


def _ranked(win: Column) -> Column:
    """Values with their places, in order of values; win: values by place."""
    return F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))


def _again(ranked: str) -> Column:
    """Places, in ascending order, of values that occur twice or more; ranked: a column, so that it is made once."""
    r, last = F.col(ranked), F.size(ranked) - 1
    same = lambda a, k: ((k > 0) & (F.get(r, k - 1)["x"] == a["x"])) | ((k < last) & (F.get(r, k + 1)["x"] == a["x"]))
    return F.array_sort(F.transform(F.filter(r, same), lambda a: a["i"]))


def _covered(places: str, n: int) -> Column:
    """How many places lie in windows of n places from the given ones."""
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(n), i + n - acc["end"])).cast("int").alias("n"), (i + n).cast("int").alias("end"))
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]


def _shares(counts: str) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.try_divide(x, total))


def text_counts(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, text_hash, lang, the counts of the rules and the two histograms (arrays of shares) of every text; with ``whole`` the row as well."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if whole else F.lit(None)
    text = docs.select(row.alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    t = text.select("row", "doc_id", "text_hash", "lang", "text", F.array_remove(F.split("text", SPACE), "").alias("words"))
    t = t.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("words")
    windows = F.when(n >= 8, F.transform(F.sequence(F.lit(0), n - 8), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(8))))).otherwise(F.array().cast("array<bigint>"))
    known = [*WORDS, *(w.capitalize() for w in WORDS)]
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    t = t.select(
        "row",
        "doc_id",
        "text_hash",
        "lang",
        "text",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("win"),
        F.lower(F.concat(F.lit(" "), F.array_join(F.filter("words", lambda w: w.isin(known)), "  "), F.lit(" "))).alias("common"),
        F.regexp_count("text", F.lit(r"[A-Z]")).alias("c_upper"),
        F.regexp_count("text", F.lit(r"[0-9]")).alias("c_digit"),
        F.regexp_count("text", F.lit(r"[!\"'(),./:;?@\[\\\]^_`{}~+=-]")).alias("c_punct"),
        F.regexp_count("text", F.lit(r"[^\x00-\x7F]")).alias("c_wide"),
    )
    c_space = F.col("n_chars") - F.col("word_chars")
    rest = F.col("word_chars") - F.col("n_symbols") - F.col("c_upper") - F.col("c_digit") - F.col("c_punct") - F.col("c_wide")
    counted = F.transform(F.array(*(F.lit(f" {w} ") for w in WORDS)), lambda w: ((F.length("common") - F.length(F.replace("common", w, F.lit("")))) / F.length(w)).cast("double"))
    t = t.select(
        "row",
        "doc_id",
        "text_hash",
        "lang",
        "n_words",
        "word_chars",
        "n_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("win")) < F.size("win"), _ranked(F.col("win"))).alias("ranked"),
        F.array(*(c.cast("double") for c in (c_space, F.col("n_symbols"), F.col("c_upper"), F.col("c_digit"), F.col("c_punct"), F.col("c_wide"), rest))).alias("chars"),
        counted.alias("common"),
    )
    t = t.withColumn("again", _again("ranked"))
    t = t.withColumn("n_repeat_words", F.coalesce(_covered("again", 8), F.lit(0)).cast("long")).drop("ranked", "again")
    others = F.greatest(F.col("n_words") - F.aggregate("common", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    t = t.withColumn("common", F.array_append("common", others))
    t = t.withColumns({"chars": _shares("chars"), "common": _shares("common")})
    return t if whole else t.drop("row")


def references(counts: DataFrame) -> DataFrame:
    """lang, chars, common: the mean histograms of each supported language, over all its documents of enough text."""
    use = counts.where(F.col("lang").isin([*COMMON_WORDS]) & (F.col("n_words") >= MIN_WORDS) & (F.col("n_chars") >= MIN_CHARS))
    n = {"chars": 7, "common": len(WORDS) + 1}
    means = use.groupBy("lang").agg(*(F.avg(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in n for i in range(n[c])))
    return means.select("lang", *(F.array(*(F.col(f"{c}{i}") for i in range(n[c]))).alias(c) for c in n))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, far_chars: float = FAR_CHARS, far_words: float = FAR_WORDS) -> DataFrame:
    """Counts of the rules and the verdict for every document.

    docs: doc_id, text, lang; other columns are left aside. A null text has no words and a
    null or unknown language gives no reference, but is judged like any other: by the
    nearest reference. A document of fewer than MIN_WORDS words or MIN_CHARS characters is
    not measured, nor is any where no language has a reference; these pass. Repeated rows
    are judged one by one, and an empty table gives an empty result.

    Returns doc_id, text_hash (to find the row again), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    chars_distance and words_distance (null where not measured), kept.
    """
    t = _judged(stored(text_counts(docs), "quality-counts"), far_chars, far_words)
    return t.select("doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_distance", "words_distance", "kept")


def kept_rows(docs: DataFrame, far_chars: float = FAR_CHARS, far_words: float = FAR_WORDS) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with all their columns, whatever their names; rows travel with their counts, not by a join."""
    return _judged(stored(text_counts(docs, whole=True), "quality-rows"), far_chars, far_words).where("kept").select("row.*")


def _judged(counts: DataFrame, far_chars: float, far_words: float) -> DataFrame:
    refs = [r for r in references(counts).collect() if r["chars"][0] is not None]  # one row a supported language at most
    lit = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    t, measured = counts, (F.col("n_words") >= MIN_WORDS) & (F.col("n_chars") >= MIN_CHARS)
    if refs:
        pairs = t.withColumn("d", F.array(*(F.struct(js_distance(F.col("chars"), lit(r["chars"])).alias("c"), js_distance(F.col("common"), lit(r["common"])).alias("w")) for r in refs)))
        near = F.array_min(F.transform("d", lambda d: F.struct((d["c"] / far_chars + d["w"] / far_words).alias("s"), d["c"].alias("c"), d["w"].alias("w"))))
        t = pairs.withColumn("near", F.when(measured, near)).withColumns({"chars_distance": F.col("near.c"), "words_distance": F.col("near.w")})
    else:
        t = t.withColumns({"chars_distance": F.lit(None).cast("double"), "words_distance": F.lit(None).cast("double")})
    t = t.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    far = F.coalesce((F.col("chars_distance") > far_chars) | (F.col("words_distance") > far_words), F.lit(False))
    return t.withColumn("kept", ~F.col("base_failed") & ~far)
