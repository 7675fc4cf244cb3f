"""Which language a text is in, and whether it is English. Undecided texts count as English.

Fixed values: script ranges, function words and thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.common import extract_all, kept_length, member

# script, language, code point ranges
SCRIPTS = (
    ("Devanagari", "hi", r"\x{900}-\x{97F}"),
    ("Bengali", "bn", r"\x{980}-\x{9FF}"),
    ("Gurmukhi", "pa", r"\x{A00}-\x{A7F}"),
    ("Gujarati", "gu", r"\x{A80}-\x{AFF}"),
    ("Tamil", "ta", r"\x{B80}-\x{BFF}"),
    ("Telugu", "te", r"\x{C00}-\x{C7F}"),
    ("Kannada", "kn", r"\x{C80}-\x{CFF}"),
    ("Malayalam", "ml", r"\x{D00}-\x{D7F}"),
    ("Arabic", "ar", r"\x{600}-\x{6FF}\x{750}-\x{77F}"),
    ("Hebrew", "he", r"\x{590}-\x{5FF}"),
    ("Cyrillic", "ru", r"\x{400}-\x{4FF}"),
    ("Greek", "el", r"\x{370}-\x{3FF}"),
    ("Thai", "th", r"\x{E00}-\x{E7F}"),
    ("Hangul", "ko", r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}"),
    ("Kana", "ja", r"\x{3040}-\x{30FF}"),
    ("Han", "zh", r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"),
)
STOPWORDS = {
    "en": "the and you for that with your this have from are will not has been our please",
    "es": "que de la el en los las por para con una un su es del se no usted",
    "pt": "que de não para com uma os as do da em seu sua por mais você",
    "fr": "que de le la les des est pour vous dans un une et votre nous sur pas",
    "de": "der die das und ist sie ihre nicht mit für den von ein eine auf wir haben",
    "it": "che di il la per non una con del sono questo come alla nel suo",
    "nl": "de het een van en is op voor met dat niet aan uw zijn wordt",
    "id": "yang dan untuk dengan ini dari anda tidak akan pada adalah kami sudah",
    "tr": "bir ve bu için ile olarak daha sonra var olan size hesap",
    "pl": "nie się jest na do że aby przez który twoje konto jak",
    "vi": "của và là được cho trong với không bạn này các để",
}
MIN_WORDS, MIN_LETTERS, MIN_SHARE = 12, 30, 0.25
MARGIN, MIN_FOREIGN_RATE, MIN_DISTINCT = 1.6, 0.15, 4
WORD = r"\p{L}+"


def script_of(df: DataFrame, text: str) -> DataFrame:
    """Add letters, script, script_lang and script_share: the script most letters belong to (Latin first on a tie)."""
    t = F.col(text)
    letters = F.regexp_replace(t, r"\P{L}+", "")
    df = df.withColumn("_l", letters).withColumn("letters", F.length("_l"))
    latin = kept_length(F.col("_l"), r"[^\x{0}-\x{36F}]+")
    counts = [F.struct(latin.alias("n"), F.lit(0).alias("ord"), F.lit("Latin").alias("script"), F.lit("en").alias("lang"))]
    for i, (name, lang, rng) in enumerate(SCRIPTS):
        counts.append(F.struct(
            F.when(F.col("_l").rlike(f"[{rng}]"), kept_length(F.col("_l"), f"[^{rng}]+")).otherwise(F.lit(0)).alias("n"),
            F.lit(-1 - i).alias("ord"), F.lit(name).alias("script"), F.lit(lang).alias("lang")))
    df = df.withColumn("_top", F.array_max(F.array(*counts)))
    none = F.col("letters") == 0
    return df.withColumns({
        "script": F.when(none, F.lit("Latin")).otherwise(F.col("_top.script")),
        "script_lang": F.when(none, F.lit("en")).otherwise(F.col("_top.lang")),
        "script_share": F.when(none, F.lit(0.0)).otherwise(F.col("_top.n") / F.col("letters")),
    }).drop("_l", "_top")


def stopword_scores(words: Column) -> Column:
    """array of (lang, hits, seen): function-word hits and distinct function words per language, in list order."""
    def one(lang, text):
        sw = text.split()
        hits = F.filter(words, lambda w: member(w, sw))
        return F.struct(F.lit(lang).alias("lang"), F.size(hits).alias("hits"), F.size(F.array_distinct(hits)).alias("seen"))
    return F.array(*[one(k, v) for k, v in STOPWORDS.items()])


def with_language(df: DataFrame, text: str) -> DataFrame:
    """Add lang, is_english and the evidence for it. Row-local: no shuffle."""
    df = script_of(df.withColumn("_t", F.trim(F.coalesce(F.col(text), F.lit("")))), "_t")
    df = df.withColumn("_w", extract_all(F.lower("_t"), WORD)).withColumn("n_words", F.size("_w"))
    df = df.withColumn("_s", stopword_scores(F.col("_w")))
    foreign = F.filter("_s", lambda s: s.lang != "en")
    # most hits; the earlier language on a tie
    best = F.aggregate(foreign, F.get(foreign, F.lit(0)), lambda a, s: F.when(s.hits > a.hits, s).otherwise(a))
    df = df.withColumn("_best", best).withColumn("_en", F.get("_s", F.lit(0)))
    n = F.greatest(F.col("n_words"), F.lit(1))
    other, en = F.col("_best.hits") / n, F.col("_en.hits") / n
    short = F.when(F.col("script") == "Latin", F.col("n_words") < MIN_WORDS).otherwise(F.col("letters") < MIN_LETTERS)
    by_script = ~short & (F.col("script") != "Latin") & (F.col("script_share") >= MIN_SHARE)
    by_words = ~short & ~by_script & (other >= MIN_FOREIGN_RATE) & (other / F.greatest(en, F.lit(1e-9)) >= MARGIN) & (
        F.col("_best.seen") >= MIN_DISTINCT)
    return df.withColumns({
        "lang_detected": F.when(by_script, F.col("script_lang")).when(by_words, F.col("_best.lang")).otherwise(F.lit("en")),
        "is_english": ~(by_script | by_words),
        "lang_confidence": F.when(short, F.lit(0.0))
        .when(by_script, F.round(F.least(F.lit(1.0), F.col("script_share") * 1.5), 3))
        .when(by_words, F.round(F.least(F.lit(1.0), other * 6), 3))
        .otherwise(F.round(F.least(F.lit(1.0), en * 6), 3)),
    }).drop("_t", "_w", "_s", "_best", "_en")
