"""Nothing is lost without a word: odd senders, missing state, landed files, unreadable and 8-bit mail; and lexicon phrases
that ordinary mail shares do not count."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lurewatch.rules.lexicons import compile_banks, load_banks

MAIL = "message_id bigint, mailbox string, source string, sender string, receiver string, sent_at timestamp, subject string, body string, reply_to string, auth_results string, attachments string"


def mail(i, sender, body="I need you to buy gift cards today. This is strictly confidential, the CEO asks urgently."):
    return (i, "b", "s", sender, "me@corp.example", datetime(2024, 1, 1), "Quick favour", body, "", "", "")


def test_a_sender_without_an_address_is_scored(spark, tmp_path):
    from lurewatch.operators.intent import fit_intent
    from lurewatch.plans.scoring import scored_rows
    from lurewatch.streaming.jobs import alerts
    batch = spark.createDataFrame([mail(1, "IT Helpdesk"), mail(2, None), mail(3, "Ann <a@b.example>", None)], MAIL)
    model = fit_intent(scored_rows(batch).withColumn("label", F.lit(1)))
    alerts(str(tmp_path), model, floor="INFORMATIONAL")(batch, 0)
    assert {r["message_id"] for r in spark.read.parquet(f"{tmp_path}/alerts").collect()} == {1, 2, 3}
    assert spark.read.parquet(f"{tmp_path}/dead_letter/batch=0").count() == 0


def test_state_reads_committed_segments_only(spark, tmp_path):
    from lurewatch.streaming.jobs import history_state, history_update
    rows = spark.createDataFrame([("a@x.example", "received", datetime(2024, 1, 1))], "address string, direction string, ts timestamp")
    state = history_state(str(tmp_path / "h"))
    each = history_update(state)
    each(rows, 0)
    (tmp_path / "h" / "s=1-1").mkdir()  # begun, never committed
    assert state.read(spark).first()["received"] == 1
    each(rows, 1)
    assert state.read(spark).first()["received"] == 2
    with pytest.raises(RuntimeError):
        history_update(history_state(str(tmp_path / "other")))(rows, 1)


def test_a_landed_file_is_in_the_next_query(spark, tmp_path):
    from lurewatch.plans.memo import planned
    seen = planned(lambda s, d: s.read.parquet(f"{d}/t.parquet"))
    spark.range(5).write.parquet(f"{tmp_path}/t.parquet")
    assert seen(spark, str(tmp_path)).count() == 5
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert seen(spark, str(tmp_path)).count() == 6


def test_unreadable_mail_is_told(spark, monkeypatch):
    from lurewatch.sources import mail as M
    names = [c.split()[0] for c in M.MAIL_SCHEMA.split(", ")]
    import pandas as pd

    def broken(raw):
        raise ValueError("no mail")
    monkeypatch.setattr(M, "_parse_one", broken)
    out = next(M._decode_batches([pd.DataFrame({"path": ["p"], "content": [b"x"]})]))
    assert list(out.columns) == names and out.iloc[0]["path"] == "p" and out.iloc[0]["error"] == "ValueError: no mail"


def test_mbox_keeps_the_charset_of_a_part(spark, tmp_path):
    from lurewatch.sources.mail import read_mbox
    body = "Grüße aus Köln\n>From here on"
    (tmp_path / "m.mbox").write_bytes(b"From a@b Tue Jan  2 10:00:00 2024\nFrom: a@b.example\nSubject: one\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\n\n"
                                      + body.encode("latin-1") + b"\n\nFrom c@d Tue Jan  2 11:00:00 2024\nFrom: c@d.example\nSubject: two\nContent-Type: text/plain; charset=utf-8\n\n\xc3\xa4\n")
    got = {r["subject"]: r["body"].strip() for r in read_mbox(spark, str(tmp_path)).collect()}
    assert got == {"one": "Grüße aus Köln\nFrom here on", "two": "ä"}


@pytest.mark.parametrize("bank, ordinary, lure", [
    ("delivery_scam", "The package manager ships three packages and a courier module; see the shipment table.", "We were unable to deliver your parcel."),
    ("job_scam", "The conference registration fee is 100 euros, pay the registration fee by May.", "You pay a registration fee for the job before you start; no experience needed."),
    ("charity_fraud", "A contribution of code, and each donation of time, is listed.", "Donate now so that families who lost everything can eat."),
    ("urgency", "We are open 24 hours a day.", "Reply within the next 2 hours."),
    ("tech_support_scam", "Remote assistance is part of the course.", "Your computer has been infected, call our technician."),
    ("credential_request", "The verification process of the compiler is slow.", "Please verify your account."),
])
def test_structure_counts_and_bare_nouns_do_not(bank, ordinary, lure):
    pattern = compile_banks()[bank]
    assert not re.search(pattern, ordinary) and re.search(pattern, lure)


def test_banks_are_read_by_spark(spark, tmp_path):
    (tmp_path / "b.csv").write_text('position,lexicon,pattern\n2,x,"b, c"\n1,x,a\n3,y,d\n')
    assert load_banks(spark, str(tmp_path / "b.csv")) == {"x": ("a", "b, c"), "y": ("d",)}
