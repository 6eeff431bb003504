"""Quality rules (native): base counts, and the divergence of a document from its language.

References are the summed histograms of all documents of a language (null is a language too): one of character classes,
one of common words. A document is compared with them by Jensen-Shannon distance (base 2, the square root of the
divergence). Both tests have a minimum length, below which they pass. Texts are read once: counts and histograms are
written as a narrow table, from which the references and the verdicts follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, materialize, table

#: Common words by language.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on are this from an or at the".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus avec".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como".split(),
}
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "punct", "symbol", "space", "other")
WINDOW = 8
MIN_WORDS = 40
MAX_CLASS_DISTANCE = 0.30
#: The bin of all other words holds most of a reference, so that a text without any common word is only some 0.34 away.
MAX_WORD_DISTANCE = 0.336
N_COMMON = max(map(len, COMMON.values()))


def _count(text: Column, inside: str) -> Column:
    """Code points of a class; runs of all others are cut out."""
    return F.length(F.regexp_replace(text, f"[^{inside}]+", ""))


def stats(docs: DataFrame, *, id_col: str, text: str, lang: str) -> DataFrame:
    t = F.coalesce(F.col("t"), F.lit(""))
    d = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("t")
    ).select("doc_id", "lang", t.alias("t"))
    # a to z, most of a text, go first and white space next, so that the other classes are counted in the little that is left.
    d = d.withColumn("marks", F.regexp_replace("t", "[a-z]+", "")).withColumn(
        "rest", F.regexp_replace("marks", f"[{WS}]+", "")
    )
    rest = F.col("rest")
    d = d.select(
        "doc_id",
        "lang",
        F.length("t").alias("n_chars"),
        (F.length("marks") - F.length("rest")).alias("space"),
        _count(rest, r"#*$%&|<>").alias("symbol"),
        _count(rest, r"\p{Lu}").alias("upper"),
        _count(rest, "0-9").alias("digit"),
        _count(rest, r".,;:!?'\"()\-").alias("punct"),
        F.length(F.regexp_replace("rest", r"[\p{Ll}\p{Lu}0-9.,;:!?'\"()\-#*$%&|<>]+", "")).alias("other"),
        F.filter(F.split("t", rf"[{WS}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n", -1), lambda x: F.rlike(x, F.lit(rf"[^{WS}]"))).alias("lines"),
    )
    lists = {k: list(dict.fromkeys(v)) for k, v in COMMON.items()}
    every = sorted({w for v in lists.values() for w in v})
    by_lang = F.create_map(*[x for k, v in lists.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    h = F.transform("words", lambda w: F.xxhash64(w))
    d = d.withColumn("h", h).withColumn("common", F.filter(F.transform("words", F.lower), lambda w: w.isin(every)))
    n = F.size("words")
    # Hashes of 2, 4 and 8 words, each of two of the step before; those that would reach past the end are cut off.
    grams, span = F.col("h"), 1
    while span < WINDOW:
        grams, span = F.zip_with(grams, F.slice(grams, span + 1, n), lambda a, b: F.xxhash64(a, b)), 2 * span
        d = d.withColumn(f"h{span}", grams)
        grams = F.col(f"h{span}")
    d = d.withColumn("grams", F.slice(grams, 1, F.greatest(F.lit(0), n - WINDOW + 1)))
    hist = F.transform(
        F.coalesce(F.try_element_at(by_lang, F.col("lang")), F.array().cast("array<string>")),
        lambda w: F.size(F.filter("common", lambda x: x == w)),
    )
    return d.select(
        "doc_id",
        "lang",
        n.cast("long").alias("n_words"),
        (F.col("n_chars") - F.col("space")).cast("long").alias("word_chars"),
        F.col("symbol").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("grams")) < F.size("grams"), repeated(F.col("grams"))
        ).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*[F.col(c).cast("long") for c in CLASSES[1:]]).alias("classes"),
        F.col("n_chars").cast("long").alias("n_chars"),
        hist.alias("hist"),
    )


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated(grams: Column) -> Column:
    """Words under windows whose hash occurs twice or more; linear steps after one sort."""
    after = lambda xs: F.slice(xs, 2, F.greatest(F.size(xs), F.lit(1)))
    # Each window as an array of at most two: whether the next equal one follows, told to both.
    twin = lambda xs: F.zip_with(
        xs,
        after(xs),
        lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    steps = lambda at: F.zip_with(at, after(at), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    at = _let(placed, lambda xs: F.sort_array(F.array_distinct(F.flatten(twin(xs)))))
    return _let(at, lambda xs: F.aggregate(steps(xs), F.lit(0), lambda s, x: s + x))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts; null where either is empty of counts."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    unit = lambda c: F.transform(
        F.arrays_zip(c.alias("c"), F.array_repeat(total(c), F.size(c)).alias("n")), lambda x: x["c"] / x["n"]
    )
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(unit(p), unit(q), lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), total(parts))))


def apply_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    min_words: int = MIN_WORDS,
    max_class: float = MAX_CLASS_DISTANCE,
    max_word: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """Per row: doc_id, lang, the base counts, base_failed, class_distance, word_distance, kept.

    Character classes are counts of code points: lower and upper letters, digits, punctuation, symbols, white space, and
    all others. Null texts have no words and fail. Null languages are compared with each other. A language without a word list, and
    documents or references without any common word, skip the word test. Repeated rows keep a row each.
    """
    s = materialize(stats(docs, id_col=id_col, text=text, lang=lang), "quality-stats")
    lower = F.col("n_chars") - F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    s = s.withColumn("classes", F.transform(F.concat(F.array(lower), F.col("classes")), lambda x: x.cast("double")))
    common = F.aggregate("hist", F.lit(0), lambda a, x: a + x)
    s = s.withColumn(
        "hist",
        F.transform(
            F.concat("hist", F.array(F.greatest(F.lit(0).cast("long"), F.col("n_words") - common).cast("int"))),
            lambda x: x.cast("double"),
        ),
    )
    refs = s.groupBy("lang").agg(
        F.array(*[F.sum(F.get("classes", F.lit(i))) for i in range(len(CLASSES))]).alias("ref_classes"),
        F.filter(
            F.array(*[F.sum(F.get("hist", F.lit(i))) for i in range(N_COMMON + 1)]), lambda x: x.isNotNull()
        ).alias("ref_hist"),
    )
    r = refs.withColumnRenamed("lang", "ref_lang")
    j = s.join(r, s["lang"].eqNullSafe(r["ref_lang"]), "left")
    long_enough = F.col("n_words") >= min_words
    j = j.withColumn("class_distance", F.when(long_enough, js_distance(F.col("classes"), F.col("ref_classes"))))
    j = j.withColumn(
        "word_distance", F.when(long_enough & (F.size("hist") > 1), js_distance(F.col("hist"), F.col("ref_hist")))
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class) | (F.coalesce("word_distance", F.lit(0.0)) > max_word)
    return j.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        "class_distance",
        "word_distance",
        (~failed & ~far).alias("kept"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = apply_rules(table(spark, sf_dir, "documents")).drop("lang")
    # Rounded as in the SQL; the verdict comes from the whole numbers.
    return got.withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in ("class_distance", "word_distance")})
