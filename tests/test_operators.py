"""Skew helpers, near-duplicate joins, components, kNN and streaming against brute force on small inputs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import campaigns as CP
from lurewatch.operators import evaluate as EV
from lurewatch.operators import learner as LN
from lurewatch.operators import retrieval as RT
from lurewatch.operators.skew import first_per_key, prefix_before, salted_lookup, top_per_group
from lurewatch.rules.lexicons import BANKS, compile_bank, prefix_free, seeds, trie_pattern


@pytest.mark.parametrize("bucket", [None, "tens"])
def test_prefix_before_counts_strictly_earlier_rows(spark, bucket):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", rng.randrange(200)) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, k string, t bigint")
    out = prefix_before(df, ["k"], F.col("t"), F.floor(F.col("t") / 10) if bucket else None, {"n": ("sum", F.lit(1).cast("bigint")), "lo": ("min", F.col("t"))}).collect()
    for r in out:
        before = [t for _, k, t in rows if k == r["k"] and t < r["t"]]
        assert r["n"] == len(before) and r["lo"] == (min(before) if before else None)


def test_salted_lookup_and_first_per_key(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(300)], "id bigint, k string")
    small = spark.createDataFrame([("hot", 1), ("other", 2)], "k string, v int")
    out = salted_lookup(big, small, "k", "left", salts=8)
    assert out.count() == 300 and out.where("v = 1").count() == 200
    first = {r["k"]: r["id"] for r in first_per_key(big, ["k"], [F.col("id")]).collect()}
    assert first == {"cold": 0, "hot": 1}


def test_top_per_group_is_exact(spark):
    rows = [(i, i % 2, (i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, g int, v int")
    got = sorted((r["g"], r["rank"], r["id"]) for r in top_per_group(df, ["g"], [F.desc("v"), F.col("id")], 5, F.col("id"), parts=7).collect())
    want = []
    for g in (0, 1):
        best = sorted([r for r in rows if r[1] == g], key=lambda r: (-r[2], r[0]))[:5]
        want += [(g, i + 1, r[0]) for i, r in enumerate(best)]
    assert got == sorted(want)


def spanning(vals, limit):
    """Group of every value that has a near one, by brute force."""
    root = {v: v for v in vals}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    near, m = set(), (1 << 64) - 1
    for i, a in enumerate(vals):
        for b in vals[:i]:
            if bin((a ^ b) & m).count("1") <= limit:
                near |= {a, b}
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in near}


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_near_groups_equal_brute_force(spark, most):
    """Small `most` sends buckets through the second filing, and clouds through leaders and who is left out."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    vals = set(base)
    for i, b in enumerate(base):
        for n in (1, 3, 6, 7, 9) + (2, 4, 5) * (20 if i == 0 else 0):
            v = b
            for bit in rng.sample(range(64), n):
                v ^= 1 << bit
            vals.add(v)
    chain = rng.getrandbits(64)
    for i in range(0, 60, 5):  # each step five bits away from the last
        chain ^= 0b11111 << i
        vals.add(chain)
    signed = sorted(v - (1 << 64) if v >= 1 << 63 else v for v in vals)
    df = spark.createDataFrame([(v,) for v in signed * 2], "simhash bigint")
    got = {r["simhash"]: r["root"] for r in CP.near_groups(df, most=most).collect()}
    assert got == spanning(signed, 6) and got


def near_values(rng, centres, around):
    """Signed 64-bit values in clouds of up to `around` values some bits apart."""
    vals = set()
    for i in range(centres):
        b = rng.getrandbits(64)
        for _ in range(around if i == 0 else 6):
            v = b
            for bit in rng.sample(range(64), rng.randint(0, 7)):
                v ^= 1 << bit
            vals.add(v - (1 << 64) if v >= 1 << 63 else v)
    return sorted(vals)


def apart(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


@pytest.mark.parametrize("most, chunk", [(1, 7), (1000, 1 << 14), (1000, 20)])
def test_near_pairs_equal_brute_force(spark, most, chunk):
    """Every pair once, whatever the number of blocks and however buckets are cut into tiles."""
    vals = near_values(random.Random(8), 30, 90)
    df = spark.createDataFrame([(v,) for v in vals * 2], "simhash bigint")
    got = [tuple(r) for r in CP.near_pairs(df, most=most, chunk=chunk).collect()]
    assert sorted(got) == [(a, b, apart(a, b)) for i, a in enumerate(vals) for b in vals[i + 1:] if apart(a, b) <= 6]


@pytest.mark.parametrize("chunk", [13, 1 << 14])
def test_same_sender_pairs_equal_brute_force(spark, chunk):
    vals = near_values(random.Random(9), 25, 70)
    rows = [(i, v, (None, "a.com", "b.com", "c.com")[i % 4 if i % 5 else 1]) for i, v in enumerate(vals * 2)]
    first = {}
    for i, v, s in rows:
        if s:
            first.setdefault((s, v), i)
    hashes = spark.createDataFrame([r[:2] for r in rows], "message_id bigint, simhash bigint")
    got = CP.same_sender_pairs(hashes, spark.createDataFrame([(i, s) for i, _, s in rows], "message_id bigint, sender string"), chunk=chunk)
    want = [(s, i, j) for (s, x), i in first.items() for (t, y), j in first.items() if s == t and x < y and apart(x, y) <= 12]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_filing_keeps_buckets_small():
    for n in (10, 10 ** 4, 10 ** 6, 10 ** 8):
        blocks = CP.filing(n)
        assert n >> (64 * (blocks - 6) // blocks) <= CP.BUCKET


def test_edges_fall_every_round(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(500)] + [(1000, 1001 + i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(64)]
    sizes, real = [], CP.cut_lineage

    def seen(df):
        out = real(df)
        if df.columns == ["a", "b"]:
            sizes.append(out.count())
        return out
    monkeypatch.setattr(CP, "cut_lineage", seen)
    got = {r["id"]: r["root"] for r in CP.groups(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {}
    for a, b in edges:
        x, y = want.get(a, a), want.get(b, b)
        want.setdefault(a, a), want.setdefault(b, b)
        if want[a] != want[b]:
            lo, hi = sorted((want[a], want[b]))
            want = {k: lo if v == hi else v for k, v in want.items()}
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert all(y < x for x, y in zip(sizes, sizes[1:])) and sizes[-1] == 0 and len(sizes) < 12


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 60)]
    nodes = sorted({x for e in edges for x in e} | {500})
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    n = spark.createDataFrame([(x,) for x in nodes], "message_id bigint")
    got = {r["message_id"]: r["component"] for r in CP.components(n, e).collect()}
    assert all(got[x] == (1 if x <= 40 else 100 if x < 200 else 500) for x in nodes)


def test_knn_blocks_equal_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["neighbour_id"] for r in RT.knn(df, df, 3, min_sim=-1.0, block=25).collect()}
    x = x.astype("float32").astype("float64")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    for i in range(90):
        assert [got[(i, k + 1)] for k in range(3)] == list(np.argsort(-s[i], kind="stable")[:3])


def test_roc_auc_handles_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (0, 0.5), (1, 0.7)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert EV.roc_auc(df).first()["auc"] == pytest.approx(want)


def test_streaks_cross_midnight(spark):
    marks = [1, 1, 0, 1, 1, 1, 1, 0, 0, 1, 1]
    rows = [(i, 1, datetime(2024, 1, 1, 20) + timedelta(hours=2 * i), m) for i, m in enumerate(marks)]
    df = spark.createDataFrame(rows, "answer_id bigint, learner bigint, answered_at timestamp, correct int")
    r = LN.streaks(df).first()
    assert (r["streak"], r["best_streak"]) == (2, 4)


def test_seeds_are_necessary_literals():
    """Every literal set is one each match must touch, checked on the phrases the banks are written from."""
    for bank in ("urgency", "reward", "crypto"):
        pat = compile_bank(BANKS[bank])
        assert seeds(pat)
    assert seeds(r"(?:a|b)?") is None
    assert prefix_free(["pay", "payment", "wire"]) == ("pay", "wire")
    assert trie_pattern(("ab", "ac", "b")) == "(?:a(?:b|c)|b)"


def test_raw_mail_and_mbox(spark, tmp_path):
    from lurewatch.sources.mail import read_eml, read_mbox
    one = b"From: =?utf-8?q?J=C3=BCrgen?= <j@example.org>\nTo: a@b.example\nSubject: =?utf-8?b?SGFsbG8=?=\nDate: Tue, 2 Jan 2024 10:00:00 +0200\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: text/html\n\n<b>html</b>\n--x\nContent-Type: text/plain\n\nplain text\n--x\nContent-Type: application/pdf\nContent-Disposition: attachment; filename=a.pdf\n\nxx\n--x--\n"
    (tmp_path / "one.eml").write_bytes(one)
    (tmp_path / "empty.eml").write_bytes(b"From: x@y.example\n\n")
    rows = read_eml(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["subject"], r["attachments"], r["body"].strip()) == ("Hallo", "a.pdf", "plain text")
    assert r["sender"].startswith("Jürgen") and str(r["sent_at"]).startswith("2024-01-02")
    box = tmp_path / "m.mbox"
    box.write_text("From a@b Tue Jan  2 10:00:00 2024\nFrom: a@b.example\nSubject: first\n\nhello\n\nFrom c@d Tue Jan  2 11:00:00 2024\nFrom: c@d.example\nSubject: second\n\nworld\n")
    assert {r["subject"] for r in read_mbox(spark, str(box)).collect()} == {"first", "second"}



@pytest.mark.parametrize("held", [199, 200])
def test_thread_verdict_needs_an_index_of_two_hundred(spark, held):
    """A genuine quote matches and an invented one is fabricated, but only where the mailbox holds enough mail before."""
    from lurewatch.operators.threads import verify
    start, words = datetime(2024, 1, 1), "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    said = [" ".join(words[(i + j * (1 + i % 7)) % 24] + str(i) for j in range(40)) for i in range(held)]
    rows = [("m", f"o{i}", start + timedelta(minutes=i), t, "") for i, t in enumerate(said)]
    later = start + timedelta(days=2)
    rows += [("m", "genuine", later, "Yes.", said[3]), ("m", "invented", later, "Yes.", " ".join(f"never{i}" for i in range(40))), ("m", "short", later, "Yes.", "never said this"), ("m", "new", later, "Hi.", "")]
    got = {r["message_id"]: (r["matched"], r["fabricated"], r["indeterminate"]) for r in verify(spark.createDataFrame(rows, "mailbox string, message_id string, sent_at timestamp, body string, quoted string")).collect()}
    unsure = (False, False, True)
    assert got["genuine"] == ((True, False, False) if held == 200 else unsure) and got["invented"] == ((False, True, False) if held == 200 else unsure)
    assert got["short"] == unsure and got["new"] == got["o1"] == (False, False, False)


def test_ranges_hold_equal_shares_of_piled_up_scores(spark):
    from lurewatch.operators.skew import in_ranges
    rng = random.Random(4)
    rows = [(round(rng.uniform(0.99, 1) if rng.random() < 0.9 else rng.random(), 9),) for _ in range(20_000)]
    sizes = sorted(r["count"] for r in in_ranges(spark.createDataFrame(rows, "p double").repartition(6), ["p"]).groupBy("_b").count().collect())
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_exercises_are_the_first_of_the_pool(spark):
    """Told by a search that ends at the first tell, with the spans of the chosen ones only."""
    from lurewatch.functions.lexicon import with_hits
    from lurewatch.operators.sampling import order_hash
    from lurewatch.plans.features import prepare
    from lurewatch.plans.q_corpus import exercises, told
    from lurewatch.rules.lexicons import TELL_BANKS
    bodies = ["Verify your account now, it is urgent.", "Nothing here.", "URGENT: keep this confidential, urgent!", "<b>urgent</b> news", None, "", "Lunch at noon?", "Please open the attached file"]
    rows = [(i, f"urgent {i}", "a@b.c", bodies[i % len(bodies)], i % 3 and 1, "web") for i in range(60)]
    df = spark.createDataFrame(rows, "message_id bigint, subject string, sender string, body string, label int, source string")
    want = told(with_hits(prepare(df).where("label = 1"), only=TELL_BANKS)).where(F.size("spans") > 0).orderBy(order_hash(F.col("message_id"), "highlight")).limit(9)
    got = {r["message_id"]: r["n_tells"] for r in exercises(df, 9).collect()}
    assert got == {r["message_id"]: len(r["spans"]) for r in want.collect()} and len(got) == 9


def test_nearest_neighbours_sort_only_what_is_near(spark, monkeypatch):
    """Ties, copies, a zero vector and a repeated id, against a plain sort; and no sort of a whole block."""
    import numpy as np
    from lurewatch.operators import retrieval as RT
    rng = np.random.default_rng(5)
    vec = rng.normal(size=(150, 6))
    vec[20:60] = vec[20]
    vec[60:75] = 2 * vec[60]
    vec[80] = 0
    ids = np.arange(150)
    ids[31] = 30
    with np.errstate(invalid="ignore"):
        unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    sims = unit @ unit.T
    asked, longest = np.nan_to_num(sims, nan=-2.0), []
    plain = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: longest.append(len(keys[0])) or plain(keys))
    for k, least in ((5, 0.45), (3, -1.0), (200, 0.9)):
        q, x, s = RT._best(k, least)(sims, ids, ids)
        want = []
        for i in range(150):
            near = sorted((-asked[i, j], ids[j]) for j in range(150) if ids[i] != ids[j] and asked[i, j] >= least)
            want += [(ids[i], j, -v) for v, j in near[:k]]
        assert sorted(zip(q, x, np.round(s, 9))) == sorted((a, b, round(c, 9)) for a, b, c in want)
    far = rng.normal(size=(300, 64))
    far /= np.linalg.norm(far, axis=1, keepdims=True)
    longest.clear()
    RT._best(5, 0.45)(far @ far.T, np.arange(300), np.arange(300))
    assert longest[0] < 300 * 300 // 50
    rows = [(int(i), [float(y) for y in v]) for i, v in enumerate(far[:80])]
    v = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    few = [sorted(map(tuple, RT.knn(v, v, 4, 0.1, block=b).select("query_id", "neighbour_id", F.round("similarity", 5), "rank").collect())) for b in (7, 1000)]
    assert few[0] == few[1] and few[0]
