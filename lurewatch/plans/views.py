"""Derived views over the given tables: one SQL text, read by both engines.

`{name}` stands for a source relation. Spark binds it to a DataFrame, the oracle to a table or CTE name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

VIEWS["messages"] = (('documents',), r"""
WITH lure(i, kind, subj, txt) AS (VALUES
  (0,  'benign_notes',   'Planning notes',        'Minutes from the planning call are in the shared folder.'),
  (1,  'credential_url', 'Sign-in blocked',       'Please verify your account within 24 hours at https://login.paypa1.com/verify?id=7'),
  (2,  'gift_card',      'Quick favour',          'I need you to buy gift cards for a client today. Keep this between us.'),
  (3,  'wire_secret',    'Confidential',          'The CEO asks for an urgent wire transfer. This is strictly confidential.'),
  (4,  'bank_change',    'Updated remittance',    'Our bank details have changed. Kindly settle the outstanding invoice of $4,200 to the new account.'),
  (5,  'callback',       'Subscription renewed',  'Your subscription was renewed for $399.99. To cancel this order call our support team on 1-833-555-0142.'),
  (6,  'anchor',         'Statement ready',       '<a href="http://track.mailer.top/x?u=1">https://www.hsbc.com</a> shows your statement.'),
  (7,  'shortener',      'Photos',                'Photos are here: https://bit.ly/3abcXYZ and http://203.0.113.9/setup.exe'),
  (8,  'double_ext',     'Scanned copy',          'Please open the attached file scan.pdf.exe and enable content.'),
  (9,  'extortion',      'I recorded you',        'I recorded you on your webcam. Send 900 USD in bitcoin or your contacts will see it.'),
  (10, 'reward',         'You have won',          'You have won the lottery. The next of kin may claim your prize of 2 million dollars.'),
  (11, 'newsletter',     'Monthly digest',        'You received this newsletter because you joined the mailing list. Unsubscribe at https://news.example.org/out'),
  (12, 'parcel',         'Delivery attempt',      'We could not deliver your parcel. Pay a customs fee of $2.99 at http://dhl.com.parcel-fee.xyz/pay'),
  (13, 'quoted',         'Schedule',              concat('On Tue, Ann wrote:', chr(10), '> the room is booked for nine and the agenda is attached for all who join the call from the other office')),
  (14, 'job',            'Part-time job',         'Work from home two hours per day, no experience needed. WhatsApp me on +44 20 7946 0958.'),
  (15, 'opener',         'Are you available?',    'Are you at your desk? I need a quick favour.')),
dom(i, domain, auth) AS (VALUES
  (0, 'corp.example.com', 'mx; dkim=pass header.i=@corp.example.com; spf=pass smtp.mailfrom=corp.example.com'),
  (1, 'gmail.com',        'mx; dkim=pass header.i=@gmail.com'),
  (2, 'paypa1.com',       'mx; spf=fail smtp.mailfrom=paypa1.com'),
  (3, 'micros0ft.com',    'mx; dkim=fail header.i=@micros0ft.com'),
  (4, 'mail.vendor.co.uk','mx; dkim=pass header.d=vendor.co.uk'),
  (5, 'promo.win',        ''),
  (6, 'news.example.org', 'mx; dkim=pass header.i=@esp.example.net'),
  (7, 'hsbc.com',         'mx; dkim=pass header.d=hsbc.com'),
  (8, 'acme-hr.co',       ''),
  (9, 'partner.example.net', 'mx; spf=pass smtp.mailfrom=bounce.partner.example.net'),
  (10,'faceb00k.com',     ''))
SELECT d.doc_id AS message_id,
       concat('box', cast(d.doc_id % 5 AS string)) AS mailbox,
       d.source AS source,
       concat('"', CASE WHEN d.doc_id % 11 IN (2, 3, 10) THEN 'PayPal Support' ELSE concat('User ', cast(d.doc_id % 37 AS string)) END,
              '" <u', cast(d.doc_id % 37 AS string), '@', m.domain, '>') AS sender,
       CASE WHEN d.doc_id % 13 = 0 THEN 'undisclosed-recipients:;' ELSE 'team@corp.example.com' END AS receiver,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '37' MINUTE * d.doc_id AS sent_at,
       concat(CASE WHEN d.doc_id % 6 = 0 THEN 'Re: ' ELSE '' END, l.subj) AS subject,
       concat(l.txt, chr(10), d.text) AS body,
       CASE WHEN d.doc_id % 7 = 0 THEN concat('<help@', 'reply-desk.top', '>') ELSE '' END AS reply_to,
       m.auth AS auth_results,
       CASE WHEN l.i = 8 THEN 'scan.pdf.exe' WHEN l.i = 4 THEN 'INV-1.pdf|terms.zip' ELSE '' END AS attachments,
       CASE WHEN d.doc_id > 40 AND d.doc_id % 6 = 0 THEN concat('<', cast(d.doc_id - 30 AS string), '@box>') ELSE '' END AS in_reply_to,
       l.kind AS kind,
       CASE WHEN l.i IN (0, 11, 13) THEN 0 ELSE 1 END AS label
FROM {documents} d
JOIN lure l ON l.i = (d.doc_id * 7 + 3) % 16
JOIN dom  m ON m.i = d.doc_id % 11
""")

VIEWS["mail_log"] = (('events',), r"""
SELECT event_id,
       concat('u', cast(user_id AS string), '@d', cast(user_id % 23 AS string), '.example.com') AS address,
       concat('d', cast(user_id % 23 AS string), '.example.com') AS domain,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'sent' ELSE 'received' END AS direction,
       ts
FROM {events}
""")

VIEWS["threads"] = (('conversations',), r"""
WITH c AS (
  SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM {conversations})
SELECT concat('mb', cast(conv_id % 6 AS string)) AS mailbox,
       concat('c', cast(conv_id AS string), '-', cast(turn AS string)) AS message_id,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '3' MINUTE * (conv_id * 20 + turn) AS sent_at,
       CASE WHEN prev IS NULL THEN ''
            WHEN (conv_id + turn) % 4 = 0 THEN reverse(prev)
            ELSE prev END AS quoted,
       text AS body
FROM c
""")

VIEWS["answers"] = (('events',), r"""
SELECT event_id AS answer_id, user_id AS learner, ts AS answered_at,
       CASE event_id % 10 WHEN 0 THEN 'sender_identity' WHEN 1 THEN 'urgency' WHEN 2 THEN 'authority'
            WHEN 3 THEN 'links' WHEN 4 THEN 'credentials' WHEN 5 THEN 'payment' WHEN 6 THEN 'attachments'
            WHEN 7 THEN 'pretext' WHEN 8 THEN 'reply_channel' ELSE 'context' END AS tactic,
       CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS correct
FROM {events}
""")

VIEWS["scored"] = (('messages',), r"""
SELECT message_id, source, kind, label AS y,
       CAST(round(0.25 + 0.3 * label + ((message_id * 37) % 100) / 250.0, 6) AS double) AS p
FROM {messages}
""")

VIEWS["attachment_files"] = (('messages',), r"""
SELECT message_id, 'scan.pdf.exe' AS filename,
       md5(concat('f', cast(message_id % 9 AS string))) AS digest, sent_at
FROM {messages} WHERE attachments = 'scan.pdf.exe'
""")

VIEWS["hash_reputation"] = ((), r"""
SELECT md5(concat('f', cast(i AS string))) AS digest, bad, total
FROM (VALUES (0, 41, 70), (1, 0, 68), (3, 5, 71), (4, 66, 72)) AS t(i, bad, total)
""")

VIEWS["domain_registry"] = ((), r"""
SELECT domain, registered FROM (VALUES
  ('paypa1.com', DATE '2024-01-02'), ('micros0ft.com', DATE '2023-10-01'), ('promo.win', DATE '2023-12-20'),
  ('vendor.co.uk', DATE '2009-05-11'), ('hsbc.com', DATE '1996-03-04'), ('gmail.com', DATE '1995-08-13')) AS t(domain, registered)
""")

VIEWS["labellers"] = (('messages',), r"""
SELECT message_id, kind AS rule_vector, kind AS a_vector,
       CASE WHEN message_id % 9 = 0 THEN 'benign_notes' ELSE kind END AS b_vector,
       CASE WHEN message_id % 50 = 0 THEN kind ELSE '' END AS human_vector
FROM {messages}
""")

VIEWS["token_weights"] = ((), r"""
SELECT token, CAST(weight AS double) AS weight FROM (VALUES ('verify', 1.9), ('wire', 1.4), ('gift', 1.7), ('unsubscribe', -0.6),
  ('minutes', -1.1), ('bitcoin', 2.2), ('customs', 0.9), ('agenda', -0.8)) AS t(token, weight)
""")

VIEWS["claims"] = (('messages',), r"""
SELECT message_id, claim_no, quote, CAST(0.9 AS double) AS strength FROM (
  SELECT message_id, 1 AS claim_no, substr(body, 1, 30) AS quote FROM {messages}
  UNION ALL SELECT message_id, 2, CASE WHEN message_id % 3 = 0 THEN 'words that never occur here' ELSE substr(subject, 1, 20) END FROM {messages}
  UNION ALL SELECT message_id, 3, substr(body, 11, 25) FROM {messages}) q
""")



TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def spread(df: DataFrame, key: str, always: bool = False) -> DataFrame:
    """Redistribute by a unique key when the scan has fewer splits than the cluster has cores.

    Per-message work is CPU-bound regex matching. A large scan has many splits and is left alone (no shuffle). `always` is for few files:
    one that holds a single row group is cut into as many splits as others, but one task gets all its rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if always or df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a given table when no view has that name."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sources, sql = VIEWS[name]
    return spark.sql(sql, **{s: view(spark, sf_dir, s) for s in sources})


def oracle_view(name: str) -> str:
    """The same text for the oracle, with sources bound to their own names."""
    sources, sql = VIEWS[name]
    return sql.format(**{s: s for s in sources})
