"""Each operator against a plain version, on small tables with nulls, empty and long texts, ties, repeated rows, empty
tables and columns with clashing names."""

import random
from collections import Counter

import numpy as np
import pytest
from brute import op1 as plain1, op3 as plain3, op5 as plain5, op6 as plain6, op10 as plain10
from pyspark.sql import functions as F

from lurewatch.llm import chat, decontaminate, jaccard_join, mixing, quality, recompress, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter
from lurewatch.llm.common import Words, flat

DOCS = "doc_id long, text string, lang string, source string, n_chars int, k long, name string, size int, w string, row string"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def docs_frame(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 1, "x", 2, "y", "z") for i, t in rows], schema)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(1.1) * 3) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, runs, odd white space, nulls and one long text."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice((3, 20, 60, 150, 300)))) for i in range(60)]
    passage = prose(rng, 60)
    for i in range(60, 90):
        a = prose(rng, 40)
        rows.append((i, f"{a} {passage} {prose(rng, 25)}" if i % 2 else f"{passage}\n\t{a}"))
    base = prose(rng, 200).split(" ")
    for i in range(90, 125):  # a group longer than a short list
        near = list(base)
        for _ in range(rng.randrange(7)):
            near[rng.randrange(len(near))] = f"n{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(near)))
    rows += [(125, rows[3][1]), (126, rows[5][1]), (127, rows[5][1]), (128, ""), (129, None), (130, " \n\t "), (131, "one"), (132, "One"), (133, "na " * 90),
             (134, "na " * 120 + "ba"), (135, "ba ba " * 60), (136, prose(rng, 6000)), (137, "é" * 900), (138, "ß" + "é" * 700 + " x"), (139, "x " * 34), (140, "a\x0bb\x0cc\rd\x1ce\x85f\u2003g"),
             (None, prose(rng, 50)), (None, None), (141, rows[7][1]), (141, rows[7][1])]
    return rows


def test_substring_dedup(spark, corpus):
    df = substring_dedup.remove_repeats(docs_frame(spark, corpus))
    assert rows_of(df, "doc_id", "n_words", "n_removed", "kept_sha256") == plain1(corpus)
    assert rows_of(substring_dedup.remove_repeats(docs_frame(spark, corpus), width=8), "doc_id", "n_words", "n_removed", "kept_sha256") == plain1(corpus, 8)


def test_suffix_dedup_works_on_slices_of_a_megabyte(spark, monkeypatch, corpus):
    """Arrays of a worker grow with its slice, so every step over texts names the same small one."""
    seen = []
    spans, cut = suffix_dedup.repeated_spans, suffix_dedup.batches
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda *a: (seen.append(a[5]), spans(*a))[1])
    monkeypatch.setattr(suffix_dedup, "batches", lambda *a: (seen.append(a[3]), cut(*a))[1])
    df = suffix_dedup.remove_repeated_bytes(docs_frame(spark, corpus))
    assert seen == [1 << 20, 1 << 20]
    assert rows_of(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain5(corpus)


def test_substring_dedup_of_an_empty_table(spark):
    empty = docs_frame(spark, [])
    assert substring_dedup.remove_repeats(empty).count() == 0 and suffix_dedup.remove_repeated_bytes(empty).count() == 0
    assert substring_dedup.cut_documents(empty).columns == empty.columns


@pytest.mark.parametrize("doc_id", [7, None])
def test_spans_of_repeated_rows_are_those_of_one_row(spark, monkeypatch, doc_id):
    rng, sizes = random.Random(9), {}
    text = prose(rng, 400, 4000)
    for module, run, plain in ((substring_dedup, substring_dedup.remove_repeats, plain1), (suffix_dedup, suffix_dedup.remove_repeated_bytes, plain5)):
        def spans(*a, f=module.repeated_spans):
            out = f(*a)
            sizes[copies] = out.agg(F.max(F.size("spans"))).first()[0]
            return out
        monkeypatch.setattr(module, "repeated_spans", spans)
        for copies in (2, 60):
            rows = [(doc_id, text)] * copies + [(1, prose(rng, 80))]
            got = run(docs_frame(spark, rows))
            assert rows_of(got, *got.columns[:-1]) == plain(rows)
        assert sizes[60] == sizes[2] > 0


def test_settled_symbols_are_the_same_in_equal_windows():
    import pyarrow as pa
    rng = random.Random(2)
    middle = prose(rng, 200, 40)
    sets = []
    for side in range(2):
        words = Words(*flat(pa.array([f"{prose(rng, 50, 40)} {middle} {prose(rng, 50, 40)}"])))
        doc = words.doc()
        name, start, end, left, right = recompress.symbols(words.names(), words.first[:-1][doc], words.first[1:][doc], 35)
        inside = (left >= 50) & (right <= 250)
        sets.append({(int(n), int(s), int(e)) for n, s, e in zip(name[inside], start[inside], end[inside])})
    assert sets[0] == sets[1] and max(e - s for _, s, e in sets[0]) > 4


def test_suffix_dedup(spark, corpus):
    df = suffix_dedup.remove_repeated_bytes(docs_frame(spark, corpus))
    assert rows_of(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain5(corpus)
    df = suffix_dedup.remove_repeated_bytes(docs_frame(spark, corpus), width=60, gram=12)
    assert rows_of(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain5(corpus, 60)


def test_jaccard_components(spark, corpus):
    assert rows_of(jaccard_join.jaccard_components(docs_frame(spark, corpus))) == plain10(corpus)
    assert jaccard_join.jaccard_components(docs_frame(spark, [])).count() == 0


def test_jaccard_without_any_link(spark):
    rows = [(i, " ".join(f"{i}x{j}" for j in range(30))) for i in range(5)]
    assert rows_of(jaccard_join.jaccard_components(docs_frame(spark, rows))) == plain10(rows)


def test_jaccard_long_lists(spark):
    """Lists above SHORT: a text with edited copies, copies of copies far from it, and strangers that share a passage."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(90)]

    def edited(words, n):
        words = list(words)
        for p in rng.sample(range(len(words)), n):
            words[p] = f"e{rng.random()}"
        return words
    far = edited(base, 4)
    texts = [base] + [edited(base, 1 + i % 4) for i in range(40)] + [edited(far, i % 3) for i in range(25)]
    texts += [base[20:60] + [f"s{i}x{j}" for j in range(i % 12)] for i in range(30)]
    rng.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    want = plain10(rows)
    assert len({c for _, _, c in want}) > 2 and max(Counter(c for _, _, c in want).values()) > jaccard_join.SHORT
    assert rows_of(jaccard_join.jaccard_components(docs_frame(spark, rows))) == want


def test_jaccard_shuffles_no_texts(spark, monkeypatch):
    """Rows that repeat, copies and near copies: no step deals texts out, and batches to workers are bounded in bytes."""
    rng = random.Random(8)
    base = prose(rng, 120).split(" ")
    rows = [(i, " ".join(base[:-1] + [f"e{i % 4}"])) for i in range(8)] + [(1, " ".join(base[:-1] + ["e1"]))] * 3
    rows += [(20 + i, prose(rng, 90)) for i in range(4)]
    moved, own = [], jaccard_join.step

    def step(df, done=()):
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        moved.extend(part for part in plan.split("\n\n") if "Exchange" in part and "text#" in part.partition("Input")[2].split("\n")[0])
        return own(df, done)
    monkeypatch.setattr(jaccard_join, "step", step)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rows_of(jaccard_join.jaccard_components(docs_frame(spark, rows)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == plain10(rows) and not moved
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)


def test_one_document_of_each_group_stays(spark, corpus):
    kept = jaccard_join.one_of_each(docs_frame(spark, corpus))
    root = {}
    for i, n, c in plain10(corpus):
        root.setdefault(c if n else ("empty", i, n), []).append(i)
    ids = sorted((r[0] for r in kept.select("doc_id").collect()), key=repr)
    one = [c for c in root if not isinstance(c, tuple)]
    empty = [i for c, g in root.items() if isinstance(c, tuple) for i in g]
    assert ids == sorted(one + empty, key=repr) and kept.columns == docs_frame(spark, []).columns


def test_decontamination(spark, corpus):
    words = corpus[10][1].split(" "), corpus[60][1].split(" ")
    items = [(1, corpus[60][1]), (2, "one"), (3, None), (4, "..."), (None, " ".join(words[0][3:30])), (10, " ".join(words[0][20:32]).upper()), (10, "It's, a  MIX"), (5, "never seen words of an item that is not there at all")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    texts = corpus + [(200, "it-s a mix: IT S A MIX"), (201, "Éa it s a mix É")]
    df = decontaminate.contamination(docs_frame(spark, texts), frame).withColumn("sha", F.sha2(F.array_join("items", ","), 256))
    named = [("" if i is None else i, t) for i, t in items]
    assert rows_of(df, "doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated") == plain6(texts, named)
    clean = decontaminate.clean_documents(docs_frame(spark, texts), frame)
    assert clean.count() == sum(not r[-1] for r in plain6(texts, named)) and clean.columns == docs_frame(spark, []).columns
    assert decontaminate.contamination(docs_frame(spark, texts), frame.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs_frame(spark, []), frame).count() == 0
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_mixing(spark):
    rows = [(i, "w " * (i % 17), "en", s, 0) for i, s in enumerate(["a", "b", "b", None, "c"] * 40)] + [(7, None, "en", "empty", 0), (None, "x y", "en", "a", 0), (3, "q", "en", "b", 0)]
    df = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, target int"))
    got = df.toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"].where(got["size"] > 0, 1) == 0).all()
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"), whole=("source_size", "first"))
    assert (per["size"] == per["whole"]).all() and abs(per["target"].sum() - got["size"].sum()) < 1e-6
    assert ((per["taken"] - per["target"]).abs() <= per["most"]).all()
    # water-filling by rounds
    order = sorted((s for s in per.index if isinstance(s, str))) + [None]
    size = [int(per[per.index.isna() if s is None else per.index == s]["size"].iloc[0]) for s in order]
    weight, cap, target, free = [(5, 2, 1)[i % 3] for i in range(len(order))], [3 * x for x in size], [0.0] * len(order), set(range(len(order)))
    while True:
        left = sum(size) - sum(cap[i] for i in range(len(order)) if i not in free)
        share = {i: left * weight[i] / sum(weight[j] for j in free) for i in free}
        over = {i for i in free if share[i] > cap[i]}
        if not over:
            break
        free -= over
    for i, s in enumerate(order):
        target = float(per[per.index.isna() if s is None else per.index == s]["target"].iloc[0])
        assert abs(target - (share[i] if i in free else cap[i])) < 1e-6
    assert rows_of(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, target int"))) == rows_of(df)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_quality_features_and_verdicts(spark, corpus):
    texts = corpus + [(300, "a b c\na b c\n\n d # * <>\n"), (301, "x|y %\u00e9 x|y %\u00e9 x|y")]
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    df = quality.judge(docs_frame(spark, texts), labels)
    want = sorted(((i, *plain3(t)) for i, t in texts), key=repr)
    assert rows_of(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in df.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    assert quality.judge(docs_frame(spark, []), labels).count() == 0


def test_quality_cutoffs_keep_their_bound(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(2400):
        bad = i % 6 == 0
        words = [f"u{rng.randrange(10 ** 6)}" + "###" * bad for _ in range(60)]
        rows.append((i, " ".join(words)))
        marks.append((i, int(not bad), 0))
    df = quality.judge(docs_frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    kept = {r["doc_id"] for r in df.where("kept").collect()}
    assert kept == {i for i, q, _ in marks if q}
    few = quality.judge(docs_frame(spark, rows), spark.createDataFrame(marks[:300], "doc_id long, quality int, toxic int"))
    assert few.where("NOT kept").count() == 0  # nothing can be proven, so nothing is rejected


def test_exact_binomial_tail():
    from math import comb
    for n, p, x in ((20, 0.1, 2), (50, 0.01, 0), (400, 0.02, 5)):
        assert abs(quality.at_most(x, n, p) - sum(comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(x + 1))) < 1e-12


URLS = [(1, "http://WWW.Example.com/en/x?y#z"), (2, "https://a.b.example.com/en/"), (3, "http://example.com/en"), (4, "http://com/"), (5, "http://x.com"), (6, "x.com/en/"), (7, None),
        (8, "http://net/es/1"), (9, "ftp://q.net/fr/?"), (10, "http://badexample.com/en/1"), (11, "http://example.com:80/en/1"), (12, "http:///es/"), (13, "http://a://b.com/"), (14, ""), (15, "http://www.example.com/en/x"), (15, "http://www.example.com/en/x")]


def test_url_filters(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in URLS], "page_id long, url string, html string, rule string")
    got = rows_of(url_filter.filter_urls(pages, url_filter.rules_frame(spark)))
    want = []
    for i, u in URLS:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(r), r, v) for r, v in url_filter.RULES if (host == r[:r.index("/")] or host.endswith("." + r[:r.index("/")])) and path.startswith(r[r.index("/"):])]
        best = max(fit, default=(0, None, "allow"))
        want.append((i, host, path, best[1], best[2]))
    assert got == sorted(want, key=repr)
    many = spark.createDataFrame([(f"h{i % 7}.d{i % 11}.t{i % 3}", f"/p{i % 5}", "block" if i % 2 else "allow") for i in range(60)] + [("t0", "/", "block"), ("d1.t1", "", "block")], "host string, path string, verdict string")
    asked = [(i, f"http://{'x.' * (i % 2)}h{i % 13}.d{i % 12}.t{i % 4}/p{i % 6}/q") for i in range(500)]
    rules = [tuple(r) for r in many.collect()]
    got = dict(rows_of(url_filter.filter_urls(spark.createDataFrame(asked, "page_id long, url string"), many), "page_id", "verdict"))
    for i, u in asked:
        host, path = u[7:].split("/", 1)[0], "/" + u[7:].split("/", 1)[1]
        fit = [(len(h) + len(p), v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == max(fit, default=(0, "allow"))[1]
    assert url_filter.filter_urls(pages, many.limit(0)).where("verdict = 'allow'").count() == len(URLS)
    assert url_filter.filter_urls(pages.limit(0), many).count() == 0


def test_token_counts(spark, corpus):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(token_counts.vocabulary_path())
    texts = corpus + [(400, "It's  <|endoftext|> don't\u00a0STOP\x1cnow\u2003A\u0301 e\u0301 12345 \U0001f600!! \u03a3\u03a3 \u03a3"), (401, "x" * 5000)]
    want = sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False)), len(t.encode(x or "", add_special_tokens=False)) > 2048) for i, x in texts), key=repr)
    df = token_counts.token_counts(docs_frame(spark, texts), prefixes=True)
    assert rows_of(df, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert all(r["n_within"] == max(x for x in r["prefix_tokens"] if x <= 2048) and r["prefix_tokens"][-1] == r["n_tokens"] for r in df.collect())
    c = token_counts.PrefixCounter(token_counts.vocabulary_path())
    text = texts[-2][1] + " " + texts[0][1]
    counts = c.prefix_counts(text)
    pieces = c.pieces(text)
    assert counts == [len(t.encode(" ".join(pieces[:n]), add_special_tokens=False)) for n in range(len(pieces) + 1)]
    for budget in (0, 1, 5, 17, 10 ** 6):
        chars, tokens = c.longest_prefix(text, budget)
        assert (chars, tokens) == max((n, k) for n in range(len(text) + 1) if (k := len(t.encode(text[:n], add_special_tokens=False))) <= budget)
    assert token_counts.token_counts(docs_frame(spark, [])).count() == 0


def test_preference_pairs(spark):
    turns = [(1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 1, "assistant", "no"), (1, "chosen", 2, None, None),
             (2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"), (3, "chosen", 5, "user", "only"), (None, "chosen", 0, "user", "lost"), (4, "chosen", None, "user", "b"), (4, "chosen", None, "user", "a"),
             (4, "rejected", 3, "user", "a"), (4, "rejected", 4, "user", "c")]
    df = chat.preference_pairs(spark.createDataFrame([(*t, "p") for t in turns], "pair_id long, side string, turn long, role string, text string, prompt string"))
    got = {r["pair_id"]: r for r in df.collect()}
    assert set(got) == {1, 2, 3, 4} and [got[i]["n_prefix"] for i in (1, 2, 3, 4)] == [1, 1, 0, 1]
    one = got[1]
    assert one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and one["chosen"].startswith("<|im_start|>assistant\nyes<|im_end|>\n") and "no" in one["rejected"]
    for side in ("chosen", "rejected"):
        mask = "".join(m.split("x")[0] * int(m.split("x")[1]) for m in one[f"{side}_mask"].split(" "))
        assert len(mask) == len(one[side])
        trained = "".join(c for c, m in zip(one[side], mask) if m == "1")
        assert trained == {"chosen": "yes<|im_end|>", "rejected": "no<|im_end|>"}[side]
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[3]["rejected"] == "" and got[4]["prompt"] == "<|im_start|>user\na<|im_end|>\n"
    assert chat.preference_pairs(chat.neighbour_answers(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_toxicity(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(900):
        words = prose(rng, 120).split(" ")
        toxic = i % 5 == 0
        for _ in range(rng.randrange(1, 4) * toxic):
            words[rng.randrange(len(words))] = rng.choice(("Grumf,", "blarg", "SNIRK!"))
        rows.append((i, " ".join(words)))
        if i % 10 != 1:
            marks.append((i, 1, int(toxic)))
    docs = docs_frame(spark, rows + [(5000, None), (5001, ""), (5002, "blarg"), (5002, "blarg"), (None, "x " * 3000 + "snirk grumf")])
    labels = spark.createDataFrame(marks + [(5000, None, None), (None, 1, 1), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, spans=True).collect()}
    assert len(model.names) == 3 and all(0 <= r["score"] <= 1 for r in got.values())
    for i, t in rows:
        assert (got[i]["score"] >= toxicity.THRESHOLD) == (i % 5 == 0)
        low = t.lower()
        assert {low[s["start"]: s["end"]] for s in got[i]["spans"]} <= {"grumf", "blarg", "snirk"} and bool(got[i]["spans"]) == (i % 5 == 0)
    assert got[5000]["score"] == got[5001]["score"] < 0.5 < got[5002]["score"] and got[None]["score"] > 0.5
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {i for i, _ in rows if i % 5} | {5000, 5001}
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("score >= 0.5").count() == 0 and toxicity.score(docs.limit(0), model).count() == 0


def test_chain_over_stretches_equals_the_whole_chain():
    rng = np.random.default_rng(0)
    w = rng.normal(size=18) * 0.7
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), w, np.zeros(3))
    own = np.where(rng.random(300) < 0.05, rng.integers(1, 5, 300), 0)
    first = np.array([0, 40, 40, 41, 180, 300])

    class Stub:
        start = np.arange(300)
    Stub.first = first
    model.graded = lambda _: own
    _, _, near, p = model.evidence(Stub)
    chain, full = toxicity.Chain(w), np.zeros(300)
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        g = own[a:b]
        e = np.exp(chain.emission(g, np.concatenate(([0], g[:-1])), np.concatenate((g[1:], [0]))))
        f, r = np.zeros((b - a, 2)), np.ones((b - a, 2))
        for t in range(b - a):
            f[t] = (np.array([1, np.exp(chain.start)]) if t == 0 else f[t - 1] @ chain.trans) * [1, e[t]]
            f[t] /= f[t].sum()
        for t in range(b - a - 2, -1, -1):
            r[t] = chain.trans @ (r[t + 1] * [1, e[t + 1]])
            r[t] /= r[t].sum()
        full[a:b] = (f * r)[:, 1] / (f * r).sum(1)
    assert np.allclose(full[near], p)
