"""The corpus pipeline, stage by stage, against brute force."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from svspark.llm import toxicity
from svspark.llm.store import Workspace

SF = "/root/testdata/sf0.001"


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_equal_brute_force(spark):
    work = Workspace(spark, "t")
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "toxic word here", None, None, 15), (9003, "toxic word here", None, None, 15)]
    docs = work.save(raw.unionByName(spark.createDataFrame(odd, raw.schema)).withColumn("k2", F.lit("clash")), "in")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs = work.save(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == [*raw.columns, "k2"]
    rows = {n: d.orderBy("doc_id").collect() for n, d in out.items()}

    first = raw.unionByName(spark.createDataFrame(odd, raw.schema))
    bad = {r.doc_id for r in toxicity.score(first, toxicity.fit(first, spark.read.parquet(f"{SF}/labels.parquet"))).where("predicted = 1").collect()}
    assert sorted(r.doc_id for r in rows["toxicity"]) == sorted(r.doc_id for r in first.collect() if r.doc_id not in bad)

    a = rows["toxicity"]
    sets = [_shingles(r.text) for r in a]
    comp = list(range(len(a)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(a)):
        for j in range(i):
            same = a[i].doc_id == a[j].doc_id and a[i].text == a[j].text
            if same or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    assert [r.doc_id for r in rows["ngram_jaccard"]] == sorted(a[i].doc_id for i in range(len(a)) if find(i) == i)

    b, window, seen = rows["ngram_jaccard"], 50, set()
    for before, after in zip(b, rows["substring_dedup"], strict=True):
        w = (before.text or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        assert (after.text or "").encode().split() == [x for i, x in enumerate(w) if i not in gone]
        assert after.n_chars == len(after.text or "")

    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in rows["substring_dedup"] if any(i in " ".join((r.text or "").split()) for i in items)}
    assert [r.doc_id for r in rows["decontamination"]] == [r.doc_id for r in rows["substring_dedup"] if r.doc_id not in leaks]
    assert sum(r.n_tokens for r in rows["packing"]) == sum(len((r.text or "").encode().split()) for r in rows["decontamination"])


def test_stages_take_clashing_columns_null_ids_and_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text, 1), (None, text + " more", 2), (None, text, 3), (5, "other words here " * 20, 4), (5, "other words here " * 20, 5), (6, None, 6), (6, None, 7), (7, "", 8)]
    names = "_text _id _gone _k2 k2 _key _gone_id score n_words spans".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({n: F.lit("clash") for n in names})
    work = Workspace(spark, "t")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = work.save(stage(spark, docs, SF), name)
        kept[name] = docs
        assert name == "packing" or docs.columns == columns
    assert sorted(((r.doc_id, (r.text or "")[:5]) for r in kept["ngram_jaccard"].collect()), key=repr) == sorted([(None, "word0"), (5, "other"), (6, ""), (7, "")], key=repr)
    empty = kept["toxicity"].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = work.save(stage(spark, empty, SF), name)
        assert empty.count() == 0


def test_freed_memory_of_the_driver_goes_back():
    import psutil

    from svspark.llm.store import trim

    held = [bytearray(60_000) for _ in range(3000)]
    held = held[-1:]  # the last one keeps the others' place
    before = psutil.Process().memory_info().rss
    trim()
    assert before - psutil.Process().memory_info().rss > 100 << 20 and held
