"""The pipeline's stages against plain versions, each on its own input; the registry; results on whole small tables."""

import duckdb
import pytest
from brute import WORD, cut, op6, op10

import __spark_entry__ as entry
import corpus_pipeline
from lurewatch.llm import toxicity
from lurewatch.llm.common import table
from lurewatch.session import cut_lineage

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs, kept = table(SF, "documents", spark), []
    for name, stage in corpus_pipeline.STAGES:
        after = cut_lineage(stage(spark, docs, SF))
        kept.append((name, docs, after))
        docs = after
    (_, start, calm), (_, _, single), (_, _, short), (_, _, clean), (_, _, mixed) = kept
    assert all(df.columns == COLUMNS for _, _, df in kept[:-1])
    model = toxicity.fit(start, table(SF, "labels", spark))
    assert {i for i, _ in pairs(calm)} == {r[0] for r in toxicity.score(start, model).where(f"score < {toxicity.THRESHOLD}").collect()}
    groups = op10(pairs(calm))
    assert {i for i, _ in pairs(single)} == {c if n else i for i, n, c in groups}
    before = pairs(single)
    words = [WORD.findall(t or "") for _, t in before]
    want = {i: " ".join(x for x, y in zip(w, g) if not y) if any(g) else t for (i, t), w, g in zip(before, words, cut(words, 35))}
    assert dict(pairs(short)) == want and all(r["n_chars"] == len(r["text"]) for r in short.collect())
    items = [(r["item_id"], r["text"]) for r in table(SF, "benchmark", spark).collect()]
    assert {i for i, _ in pairs(clean)} == {r[0] for r in op6(pairs(short), items) if not r[-1]}
    assert {r["doc_id"]: r["size"] for r in mixed.collect()} == {i: len(WORD.findall(t or "")) for i, t in pairs(clean)}


def test_near_copies_from_four_fifths_of_five_word_shingles(spark):
    def words(a, n):
        return [f"{a}{i}" for i in range(n)]
    rows = []
    for g, more in enumerate((18, 22, 24, 25, 26, 30)):  # of 104 - 4 shingles, 100 / (100 + more) are shared
        base = words(f"g{g}x", 104)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base + words(f"g{g}y", more)))]
    long = words("z", 1004)
    swapped = [w if i % 47 != 23 else f"other{i}" for i, w in enumerate(long)]  # about 2.1% of the words
    rows += [(20, " ".join(long)), (21, " ".join(swapped)), (22, None), (23, ""), (None, " ".join(long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[p: p + 5]) for p in range(len(t.split()) - 4)} for i, t in rows if t and i is not None}
    share = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in (0, 2, 4, 6, 8, 10, 20)}
    assert sum(0.8 <= s < 0.85 for s in share.values()) >= 4 and min(share.values()) < 0.8
    kept = [i for i, _ in pairs(dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, SF))]
    assert sorted(kept) == sorted(i for i, _, c in op10(rows, 5, 80) if i is not None and i == c)
    assert {i for i in share if i + 1 not in kept} == {i for i, s in share.items() if s >= 0.8}


def test_empty_documents_pass_all_stages(spark):
    docs = table(SF, "documents", spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF))
    assert docs.count() == 0


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_source_mixing", "op4_url_filters", "op6_decontamination", "op8_preference_formatting"])
def test_query_equals_sql(spark, name):
    from tools.check_oracle import canon
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(cols, cur.fetchall())


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    df = entry.queries()["op9_toxicity"](spark, d).where("held_out").join(table(d, "labels", spark), "doc_id").toPandas()
    toxic = df[df["toxic"] == 1]
    assert (toxic["predicted"] == 1).mean() > 0.85 and (df[df["toxic"] == 0]["predicted"] == 1).mean() < 0.01
