"""Guards of the feature row: a pattern is skipped only where it cannot match."""

import re
import unicodedata

from pyspark.sql import functions as F

from lurewatch.functions import body as B
from lurewatch.functions import lexicon as LX
from lurewatch.functions import style as ST
from lurewatch.functions.common import extract_all
from lurewatch.rules import patterns as P
from lurewatch.rules.lexicons import at_first_chars, compile_banks, first_chars, word_seeds

BODIES = [
    "", "contact during hotel stay, factory restoring", "Act now! Please CALL our support team on 1-833-555-0142.",
    "Your subscription was renewed for $399.99. To cancel this order call +44 20 7946 0958", "see report.pdf.exe and setup.EXE, a.docm",
    "redelivery of your parcel was re-scheduled; please enable content", "ÉCOLE Straße Привет МИР 12 Λόγος", "ask İn K the next of kin of late husband",
    "WWW2.site.org and HTTPS://a.b/c ftp://x.y", "[click here now] *[verify your account]*", "cost 5 usd, € 20, 1,000 pounds​⁠", "supplier invoice;password is in the zip file",
    "(212) 555-0100 x.1-800-555-0100 900-555-0100", "buy gift\ncards", "I need you to buy gift cards for a client today, kindly send me some money",
]


def frame(spark):
    rows = [(i, s, b) for i, b in enumerate(BODIES) for s in ("Re: ALERT", "", "Bank details have changed")]
    df = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "message_id bigint, subject string, body string")
    return LX.with_triggers(df.withColumn("body_text", F.col("body"))).withColumn("body_words", F.split("body_low", r"\s+"))


def test_seeds_begin_words(spark):
    assert word_seeds(r"\bact now\b") == (("act now",), ())
    assert word_seeds(r"(?:re)?delivery") == ((), ("delivery",))
    assert word_seeds(r"\b(?:pay |)now") == (("now",), ())
    assert word_seeds(r"(?:a|b)?") is None
    found = {r["body"]: set(r["triggers"]) for r in frame(spark).where("subject = ''").collect()}
    assert not found[BODIES[1]] & {"act", "ring"}  # parts of contact, during
    assert {"act", "call", "support"} <= found[BODIES[2]]


def test_guards_change_no_count(spark):
    df, pats = frame(spark), compile_banks()
    whole = F.concat("subject", F.lit("\n"), "body_text")
    pairs = {n: (c, F.regexp_count(F.col("subject" if n.startswith("lexsubj") else "body_text"), F.lit(
        pats[n[8:] if n.startswith("lexsubj") else n[4:-6]])).cast("double")) for n, c in LX.lexicon_counts().items()}
    pairs |= {n: (c, F.col("both_text").rlike(P.TEXT_FLAGS[n])) for n, c in LX.text_flags().items()}
    pairs["cta"] = (LX.guard(P.CALL_TO_ACTION) & whole.rlike(P.CALL_TO_ACTION), whole.rlike(P.CALL_TO_ACTION))
    pairs["bill"] = (LX.guard(P.BILLING_PRETEXT) & whole.rlike(P.BILLING_PRETEXT), whole.rlike(P.BILLING_PRETEXT))
    pairs["phones"] = (F.transform(B.phones(whole), lambda p: p.raw), F.array_distinct(extract_all(whole, P.PHONE)))
    pairs["url"] = (extract_all(whole, P.URL_START + P.URL), extract_all(whole, P.URL))
    pairs["files"] = (B.extract_where(whole.rlike(P.FILENAME_GUARD), whole, P.FILENAME), extract_all(whole, P.FILENAME))
    pairs["double"] = (B.extract_where(whole.rlike(P.DOUBLE_EXT_GUARD), whole, P.DOUBLE_EXT), extract_all(whole, P.DOUBLE_EXT))
    text = B.text_features()
    pairs["money"] = (text["txt_currency_mentions"], F.regexp_count("body_text", F.lit(P.CURRENCY)).cast("double"))
    pairs["zero"] = (text["txt_zero_width_chars"], F.regexp_count("body_text", F.lit(P.ZERO_WIDTH)).cast("double"))
    confusable = F.regexp_count(F.concat("subject", F.lit(" "), "body_text"), F.lit("[" + P.CONFUSABLE + "]")).cast("double")
    pairs["homoglyphs"] = (text["txt_homoglyph_chars"], confusable)
    wrong = df.select(*[(~a.eqNullSafe(b)).cast("int").alias(n) for n, (a, b) in pairs.items()])
    bad = wrong.agg(*[F.sum(n).alias(n) for n in wrong.columns]).first().asDict()
    assert {n: v for n, v in bad.items() if v} == {}


def test_first_characters(spark):
    told = {r"(?i)\b(?:Pay|send|[0-9a]{2,}x)\b": "0123456789aps", r"\b(?:re-?)?verify": "rv", r"(?:a|b)?c+": "abc", r"^(?:x|(?:y|z))": "xyz"}
    assert {p: first_chars(p) for p in told} == told
    assert [p for p in (r"a?", r"\d+", r"[^a]b", r"(?:é|e)", r".a", r"(?=a)b", r"(?iu)k", r"\s*x", r"(a)?\1b", r"[a-é]") if first_chars(p)] == []
    assert at_first_chars(r"\d+") == r"\d+"
    assert all(at_first_chars(p).startswith("(?=[") for p in compile_banks().values())
    for p in (*told, r"(?i)\b(?:[-^\]]x|&k|~)"):
        df = spark.createDataFrame([(v,) for v in ("PAY now, send, 12x aax 1x", "reverify VERIFY verify re-verify", "cc abc ac b", "x\ny", "-x ^X ]x \u212ax &K ~ a&k", "")], "t string")
        assert df.where(F.regexp_count("t", F.lit(p)) != F.regexp_count("t", F.lit(at_first_chars(p)))).count() == 0, p


def test_share_of_capitals(spark):
    rows = frame(spark).select("subject", "body", *[B.text_features()[f"txt_{n}_upper_ratio"].alias(n) for n in ("subject", "body")]).collect()
    for r in rows:
        kinds = [unicodedata.category(c) for c in r[1]]
        letters = sum(k[0] == "L" for k in kinds)
        assert abs(r[3] - (kinds.count("Lu") / letters if letters else 0.0)) < 1e-12, r


def test_style_traits_are_plain_counts(spark):
    prose = "Don't wait, we've all cannot (or can't) go; he said \"it's of no use\" to us and to them. Shouldn't O'Neil's APPLICATIONS work? "
    rows = [(0, prose * 5), (1, None), (2, "too short"), (3, "see https://a.b/c?x=1 or www.d.e, mail me at a.b@c.de! " * 12 + prose), (4, "Über the İstanbul\n> quoted a@b.cc\n\n" + "the of 'a' & / : " * 30)]
    df = ST.with_traits(spark.createDataFrame(rows, "doc_id int, text string"), "text")
    got = {r["doc_id"]: r.asDict() for r in df.collect()}
    assert set(got) == {0, 3, 4}
    for i, text in ((0, rows[0][1]), (4, rows[4][1].replace("> quoted a@b.cc", ""))):
        own = text.strip()
        toks = re.findall("[a-z']+", own.lower())
        want = {f"fw_{w}": 1000 * toks.count(w) / len(toks) for w in ST.FUNCTION_WORDS}
        want |= {f"pn_{k}": 1000 * own.count(c) / len(own) for k, c in ST.PUNCTUATION.items()}
        want |= {"st_word_len": sum(map(len, toks)) / len(toks), "st_long_words": 100 * sum(len(t) > 6 for t in toks) / len(toks),
                 "st_hapax": 100 * sum(toks.count(t) == 1 for t in toks) / len(toks), "st_contractions": 1000 * len(re.findall(ST.CONTRACTION, own)) / len(toks)}
        assert {k: got[i][k] for k, v in want.items() if abs(got[i][k] - v) > 1e-9} == {}, want
    assert got[3]["pn_slash"] == 0.0  # links and addresses are blanked
    # the least number of words is tested on the tokens already made, not on a second reading of the text
    assert df._jdf.queryExecution().optimizedPlan().toString().count("[a-z']+, 0") == 1
