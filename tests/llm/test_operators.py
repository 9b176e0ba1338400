"""Each operator against a brute-force version, and its defined edge cases, on small tables."""

import hashlib
import html
import io
import math
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from svspark.llm import chat, decontaminate, extract, jaccard, packing, queries, repeats, store, topk, toxicity, urls, warc, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, k2 long, n int"


def texts(seed=0, n=60):
    """Documents with exact, near and partial copies, nulls, empty texts, repeated rows and a long one."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(150)]
    say = lambda k: " ".join(rng.choices(vocab, k=k))
    base = [say(rng.randint(1, 160)) for _ in range(n)]
    passage = say(60)
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(12):
        near = base[3].split() if len(base[3].split()) > 100 else base[3].split() + say(120).split()
        near[rng.randrange(len(near))] = "edit%d" % i
        rows.append((100 + i, " ".join(near)))
    rows += [(200 + i, say(10) + "\n " + passage + "\t" + say(7)) for i in range(5)]
    rows += [(300, base[5]), (301, base[5].upper()), (302, None), (303, ""), (304, " \n\t"), (305, say(4000)), (305, base[7]), (7, base[7]), (None, base[9]), (306, "one"), (307, "one")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 5, 1) for i, t in texts()], DOCS)


def test_words_and_hashes_follow_the_definition():
    rows = ["a b\u00a0c  d\x0be\x1cf", "", None, "Ünï cödé\r\nx", "q" * 3000, " lead"]
    got = []
    for _, _, b in words.blocks(pa.array(rows, pa.string()), limit=10):
        raw = b.data.tobytes()
        got += [[raw[s:e] for s, e in zip(b.starts[b.first[i] : b.first[i + 1]], b.ends[b.first[i] : b.first[i + 1]], strict=True)] for i in range(len(b.counts))]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in rows]
    for n in (3, 35):
        t = " ".join(map(str, range(50)))
        (_, _, one), (_, _, two) = (next(words.blocks(pa.array([x]))) for x in (t, "zz " + t))
        a, b = one.ngrams(one.hashes(), n)[0], two.ngrams(two.hashes(), n)[0]
        assert (a == b[1:]).all() and len(np.unique(a)) == len(a)


def brute_components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(docs, n, num):
    got = jaccard.ngram_jaccard(docs, ngram=n, num=num).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(texts(), n, num, 100)


@pytest.mark.parametrize("short,block", [(2, 256), (2, 6), (32, 4)])
def test_jaccard_long_lists_are_cut_into_blocks(spark, monkeypatch, short, block):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(3)
    base = ["b%d" % i for i in range(60)]
    rows = []
    for i in range(40):
        t = base[:]
        for _ in range(rng.choice([1, 3, 5])):
            t[rng.randrange(60)] = "e%d" % rng.randrange(400)
        rows.append((i, " ".join(t)))
    got = jaccard.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), ngram=3, num=80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows, 3, 80, 100)


def brute_repeats(rows, window):
    toks = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in toks for k in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, toks, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,batches", [(35, 2), (9, 5)])
def test_repeats_equal_brute_force(spark, docs, window, batches):
    extra = spark.createDataFrame([(400, "rep eat " * 40, "en", 1, 1)], DOCS)
    got = repeats.remove_repeats(docs.unionByName(extra), window=window, batches=batches)
    got = got.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats([*texts(), (400, "rep eat " * 40)], window)


def test_repeats_keep_first_leaves_one_copy_and_other_text(spark):
    a, b = " ".join(f"p{i}" for i in range(60)), " ".join(f"x{i}" for i in range(20))
    rows = [(2, f"{b}\n\n{a}  tail"), (1, a + "\nown words"), (3, f"lead {a}"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r.doc_id: (r.text, r.lang) for r in repeats.remove_repeats(df, window=50, keep_first=True, original=True, carry=["lang"]).collect()}
    assert got == {1: (a + "\nown words", "en"), 2: (b + "\n\n  tail", "en"), 3: ("lead ", "en"), 4: ("", "en")}


def test_hot_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 5)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"own{i} {passage[: 90 + i]} more{i % 3} {passage}") for i in range(40)] + [(7, f"own7 {passage}"), (None, passage), (None, passage)]
    for batches in (1, 4):
        got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=12, batches=batches)
        assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()), key=repr) == brute_repeats(rows, 12)


def test_index_is_kept_and_later_batches_meet_history(spark, tmp_path):
    rng = random.Random(4)
    lines = [" ".join(f"{c}{i}" for i in range(14)) for c in "abcdefgh"]
    rows = [(i, " ".join(rng.choice(lines) if rng.random() < 0.4 else f"own{i}x{k} only{i}" for k in range(5))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.text for r in repeats.remove_repeats(df, window=10, keep_first=True, batches=1).collect()}
    path, got = str(tmp_path / "index"), {}
    for k in range(4):  # every call opens the index anew; doc_ids rise, so the first occurrence is the same one
        index = repeats.FingerprintIndex.open(spark, path, buckets=3, fan_in=2)
        assert index.batches == 2 * k and len(index.runs) <= 2
        part = df.where(f"doc_id >= {15 * k} and doc_id < {15 * k + 15}")
        out = repeats.remove_repeats(part, window=10, keep_first=True, batches=2, index=index, history=df.where(f"doc_id < {15 * k}"))
        got |= {r.doc_id: r.text for r in out.collect()}
    assert got == whole
    last = repeats.FingerprintIndex.open(spark, path)
    plan = last.read(last.runs[0]).join(last.read(last.runs[-1]).select("a"), "a", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # runs are joined bucket by bucket
    last.close()
    with pytest.raises(ValueError):
        repeats.remove_repeats(df, window=10, index=repeats.FingerprintIndex.open(spark, path))


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(260)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)] + [(2000, None), (2001, [1.0, None] * 4), (2002, [math.nan] * 8), (2003, [math.inf] * 8), (2050, [0.5, 0.5, 0.5]), (2051, [0.5, -0.5, 0.5]), (None, rows[100][1]), (100, rows[100][1]), (2100, [])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in {i for i, _ in ok if i is not None and i % 50 == 0}:
        answers = [(-sum(a * b for a, b in zip(x, y, strict=True)), math.inf if j is None else j) for i, x in ok if i == q for j, y in ok if j != q and len(x) == len(y)]
        want += [(q, k, None if j == math.inf else j, -s) for k, (s, j) in enumerate(sorted(answers)[:5], 1)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def brute_top(rows, k=5):
    """Exact answers in Python's integers of (vec_id, vector) rows."""
    scaled = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in scaled:
        if q is not None and q % 50 == 0:
            all_of = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), math.inf if i is None else i) for i, w in scaled if i != q and len(w) == len(v))
            out += [(q, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(all_of[:k], 1)]
    return sorted(out, key=repr)


def test_top_k_of_large_components_is_exact(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 9e6]), (2, [1e6, -1.0]), (50, [2e7, 5.0]), (3, [2.5, 2.5]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, None), (100, [1.0]), (7, [2.0]), (None, [0.5, 0.25])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("clash")))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_top(rows)
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>")).collect()


def test_top_k_stops_early_on_clusters_only(spark, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(24, 16))
    shares = {}
    for name, x in (("clusters", centres[np.arange(3000) % 24] + 0.05 * rng.normal(size=(3000, 16))), ("random", rng.normal(size=(3000, 16)))):
        x /= np.linalg.norm(x, axis=1)[:, None]
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        stats = {}
        got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), stats=stats)
        assert sorted(map(tuple, got.collect()), key=repr) == brute_top(rows)
        shares[name] = stats["visits"] / stats["possible"]
        print("top_k", name, stats)
    assert shares["clusters"] < 0.25


def test_chat_folds_events(spark):
    log = [(1, 0, 0, "start", "user", ""), (1, 1, 0, "delta", "user", "hel"), (1, 2, 0, "delta", "user", "lo"), (1, 3, 1, "start", "assistant", ""), (1, 4, 1, "delta", "assistant", "bad"), (1, 5, 1, "regenerate", "assistant", ""), (1, 6, 1, "delta", "assistant", "good</s>")]
    log += [(1, 7, 0, "edit", "user", "hi"), (1, 8, 2, "start", "user", "bye"), (1, 9, 2, "delete", "user", None), (1, 10, 0, "unknown", None, "x"), (None, 0, 0, "start", None, None)]
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string").orderBy(F.rand(1))
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text, r.formatted) for r in chat.parse(chat.format_chats(events)).collect()}
    assert got[1][:2] == ([("user", "hi"), ("assistant", "good</s>")], "good</s>")
    assert "</s>" not in got[1][2]
    assert got[None][:2] == ([("", "")], "")


def test_chat_round_trip_of_control_strings(spark):
    nasty = ["<|im_end|>\n", "<\\|im_end|>", "</s>[INST] ok [/INST]", "\\[INST]", "[\\\\INST]<s>", "<<|im_start|>user\n", "", "a\nb", "x<|im_end|>\n<|im_start|>assistant\nq"]
    rows = [(i, t, r, x) for i, x in enumerate(nasty) for t, r in enumerate(["user", "assistant", "ro\nle\\n<s>"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in chat.parse(chat.format_chats(chat.events_of(df))).collect()}
    assert got == {i: ([(r, x) for r in ("user", "assistant", "ro\nle\\n<s>")], x) for i, x in enumerate(nasty)}


def test_chat_query_equals_direct_digests(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(["user", "assistant"])]
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, turns in by.items():
        loss = "".join(x for _, r, x in sorted(turns) if r == "assistant")
        want[c] = (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in sorted(turns))), len(loss), digest(loss))
    assert {r.conv_id: tuple(r)[1:5] for r in queries.op3_chat(spark, SF).collect()} == want


def test_urls(spark):
    cases = [
        ("http://A.B.ORG/x?y/z#q", "a.b.org", "/x", "org/", "allow"), ("https://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"), ("x://m.example.org/en/12", "m.example.org", "/en/12", "example.org/en/1", "block"),
        ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"), ("http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"), ("http://a.com/fr", "a.com", "/fr", None, None), ("http://de.com/de/q", "de.com", "/de/q", "com/de/", "block"),
        ("http://x.org", "x.org", "", None, None), (None, "", "", None, None), ("nourl", "", "", None, None), ("a://ÀB?://c", "Àb", "", None, None), ("http://org/", "org", "/", "org/", "allow"), ("http://h#://z/", "h", "", None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge_urls(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if got[i].score >= 0.5 else "allow"))
    w = urls.train(urls.labelled_urls())
    held = [("http://ads.newname.com/ad/click?id=3", "block"), ("http://news.newname.com/article/2021/05", "allow"), ("http://free-zz-casino.biz/casino/bonus", "block"), ("http://blog.zz.net/docs/guide", "allow")]
    out = urls.judge_urls(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string"), rules=[], weights=w).orderBy("page_id").collect()
    assert [r.verdict for r in out] == [v for _, v in held]
    for r in out:  # the plan's score is the plain sum
        g = urls._grams(r.host, r.path)
        assert math.isclose(r.score, 1 / (1 + math.exp(-(w[-1] + sum(w[x] for x in g) / len(g)))), rel_tol=1e-9)


def test_decontamination(spark):
    item = "Anna buys 12 apples at 3 dollars each from the old market near the river and later sells 12 of them to Peter for profit"
    other = "Maria buys 40 apples at 7 dollars each from the old market near the river and later sells 40 of them to Lucas for profit"
    broken = "Maria buys 40 apples at 7 dollars each from the old market near the river and later sells 41 of them to Lucas for profit"
    benchmark = spark.createDataFrame([(1, item), (2, "a quite different question about nothing that anyone asks in these short texts at all"), (3, None), (4, "")], "item_id long, text string")
    rows = [(1, f"before this. {item} and after"), (2, f"Look here: {other}"), (3, broken), (4, "nothing shared with " * 20), (5, None), (6, ""), (None, item), (7, " ".join(item.split()[:11])), (7, item), (7, item)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9))
    got = sorted(((r.doc_id, r.contaminated, tuple(r.item_ids)) for r in decontaminate.decontaminate(df, benchmark).collect()), key=repr)
    want = [(1, True, (1,)), (2, True, (1,)), (3, False, ()), (4, False, ()), (5, False, ()), (6, False, ()), (None, True, (1,)), (7, False, ()), (7, True, (1,)), (7, True, (1,))]
    assert got == sorted(want, key=repr)
    assert decontaminate.decontaminate(df, benchmark.limit(0)).where("contaminated").count() == 0


def test_decontamination_query_finds_verbatim_items(spark):
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if any(i in " ".join(r.text.split()) for i in items)}
    assert {r.doc_id for r in queries.op5_decontaminate(spark, SF).where("contaminated").collect()} == want


def test_chain_marginals_equal_brute_force():
    rng = np.random.default_rng(1)
    chain = toxicity.Chain([], 0.0, rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2))
    counts = np.array([1, 5, 0, 9, 40])
    e = rng.normal(0, 2, counts.sum())
    p, pairs, begin = chain.marginals(e, counts, True)
    at, expected, starts = 0, np.zeros((2, 2)), np.zeros(2)
    for n in counts:
        if n == 0:
            continue
        if n <= 9:
            total, one, trans = 0.0, np.zeros(n), np.zeros((2, 2))
            first = np.zeros(2)
            for bits in range(1 << n):
                y = [bits >> i & 1 for i in range(n)]
                w = math.exp(chain.start[y[0]] + sum(e[at + i] for i in range(n) if y[i]) + sum(chain.trans[a, b] for a, b in zip(y[:-1], y[1:], strict=True)))
                total += w
                one += w * np.array(y)
                first[y[0]] += w
                for a, b in zip(y[:-1], y[1:], strict=True):
                    trans[a, b] += w
            assert np.allclose(p[at : at + n], one / total)
            expected += trans / total
            starts += first / total
        else:
            v = np.exp(chain.start)
            fore = []
            for i in range(n):
                v = (v if i == 0 else v @ np.exp(chain.trans)) * np.array([1, math.exp(e[at + i])])
                v = v / v.sum()
                fore.append(v)
            b = np.ones(2)
            for i in range(n - 1, -1, -1):
                m = fore[i] * b
                assert math.isclose(p[at + i], m[1] / m.sum(), rel_tol=1e-9)
                b = np.exp(chain.trans) @ (b * np.array([1, math.exp(e[at + i])]))
                b = b / b.sum()
        at += n
    few, trans, first = chain.marginals(e[:15], counts[:4], True)
    assert np.allclose(trans, expected) and np.allclose(first, starts)


def test_toxicity_learns_held_out_documents(spark):
    rng = random.Random(4)
    vocab = ["v%d" % i for i in range(300)]
    rows = []
    for i in range(500):
        w = rng.choices(vocab, k=rng.randint(5, 80))
        if i % 5 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["idiotic", "scummy" + rng.choice("abc")]))
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "v1 v2")], "doc_id long, text string").withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == y for i, _, y in held) >= 0.95 * len(held)
    hit = next(i for i, _, y in held if y and got[i].spans)
    text = dict((i, t) for i, t, _ in rows)[hit]
    assert all(re.match("idiotic|scummy", text[s.begin : s.end]) for s in got[hit].spans)
    assert got[900].predicted == got[901].predicted == 0 and 0 <= got[901].score <= 1
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0}
    constant = toxicity.fit(df, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(df, constant).collect()} == {0.0}


def test_toxicity_of_repeated_ids_long_texts_and_signs(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        text = " ".join(word() for _ in range(30)) + (f" vilewort!! {word()} grimslur" if bad else "") + " " + " ".join(word() for _ in range(10))
        rows.append((i, text))
        labels.append((i, 0, int(bad)))
    rows += [(3, rows[8][1]), (3, rows[3][1]), (None, "x vilewort%%% grimslur y"), (900, "kappa " * 60_000 + "vilewort grimslur"), (901, "*** &&& ??"), (902, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "_text": F.lit(1)})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    models = [toxicity.fit(d, known) for d in (docs, docs.orderBy(F.rand(3)).repartition(5))]
    assert all((a == b).all() for a, b in zip(models[0]["weights"], models[1]["weights"], strict=True))
    found = toxicity.score(docs, models[0]).collect()
    assert {r.doc_id: r.predicted for r in found if r.doc_id in (None, 900, 901, 902)} == {None: 1, 900: 1, 901: 0, 902: 0}
    spans = {dict((r for r in rows if r[0] == 900))[900][s["begin"] : s["end"]] for r in found if r.doc_id == 900 for s in r.spans}
    assert spans == {"vilewort", "grimslur"}
    kept = toxicity.keep_clean(docs, models[0])
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in found)
    with_bound = toxicity.fit(docs, known, max_bytes=4000)
    assert with_bound.keys() == models[0].keys() or "constant" in with_bound


def test_extraction(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies on this site today ok</div><header><h1>Site name here</h1></header>"
        "<article><h1>Real\n  title &amp; more</h1><p><b>First part.<br><p>Second <i>par</i>t with <a href='x>y'>a link</a> a &lt; b &amp c.<ul><li>one item here<li>two items here</ul><script>var x = '</p>';</script><div class=ad>Buy now this thing</div><p>Last.</p></article>"
        "<aside>other stories for you to read</aside><div id='comments'><p>I think this is great, says a reader</p></div><footer>&copy; me</footer>"
    )
    want = "Real title & more\nFirst part.\nSecond part with a link a < b & c.\none item here\ntwo items here\nLast."
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<nav>only menu here</nav>"), (4, "u", "plain words only"), (5, "u", "<p>a &am b &#x41;&#66; <!-- c --> d"), (1, "u", page)]
    got = extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert sorted(((r.page_id, r.text) for r in got), key=repr) == sorted([(1, want), (2, ""), (3, ""), (None, ""), (4, "plain words only"), (5, "a &am b AB d"), (1, want)], key=repr)


def test_extraction_query_equals_the_article_element(spark):
    def plain(page):
        a = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br|article)>", a)]
        return "\n".join(x for x in parts if x)

    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op8_html_extraction(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_extraction_scan_equals_the_brute_force_maximum():
    rng = random.Random(6)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(rng.randrange(0, 14))]
        a, b = extract.best_run(scores)
        sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)]
        assert sum(scores[a:b]) == max([0.0, *sums])


def test_no_class_name_empties_a_page():
    article = "<h1>A title here</h1><p>It was a long day, and they walked home in the rain. Nobody spoke.</p><p>Later they did.</p>"
    want = "A title here\nIt was a long day, and they walked home in the rain. Nobody spoke.\nLater they did."
    shell = "<html><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>{}<footer>c me</footer></body>"
    for wrap in ('<article class="comment-free">{}</article>', '<div class="social-science">{}</div>', '<div id="search-engines">{}</div>', "<main>{}</main>", "{}"):
        assert extract.extract(shell.format(wrap.format(article)), extract.default_model()) == want
    for name in "trending teaser outbrain toc disclaimer paywall gdpr most-read unheard-of".split():
        part = f"<div class={name}><ul><li><a href=x>One more story</a><li><a href=y>Other story</a></ul></div>"
        assert extract.extract(shell.format(f"<article>{article}{part}</article>{part}"), extract.default_model()) == want
    for name in "teaser outbrain toc disclaimer paywall gdpr".split():
        assert extract.extract(shell.format(f"<article>{article}</article><div class={name}><p>Read this now, it is good.</p></div>"), extract.default_model()) == want


def test_extraction_of_held_out_labelled_pages():
    """Words of generated pages that training has not seen, with other class names: F1 of kept words."""
    right = kept = real = 0
    for page in extract.labelled_pages(200, seed="held out"):
        got = Counter(extract.extract("".join(p for p, _ in page), extract.default_model()).split())
        want = Counter(re.sub("<[^>]*>", " ", " ".join(p for p, good in page if good)).split())
        right, kept, real = right + sum((got & want).values()), kept + sum(got.values()), real + sum(want.values())
    print("extraction: precision", right / kept, "recall", right / real)
    assert 2 * right / (kept + real) >= 0.97


def test_packing(docs):
    capacities = (16, 64, 256)
    got = packing.best_fit(docs, capacities=capacities, shard=20).collect()
    total = sum(len((t or "").encode().split()) for _, t in texts())
    assert sum(r.n_tokens for r in got) == total
    bins = defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: (r.offset, r.n_tokens)):
            assert r.offset == at
            at += r.n_tokens
        assert {r.capacity for r in rows} == {min(c for c in capacities if c >= at)}
    assert sum(rows[0].capacity for rows in bins.values()) <= 1.25 * total + 256
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert sorted((r.start, r.n_tokens) for r in by[305] if r.start >= 256)[0] == (256, 256)


def test_packing_costs_less_than_one_size_and_little_more_than_the_optimum(spark):
    rng = random.Random(2)
    caps = (512, 1024, 2048, 4096)
    total = lambda placed: sum(packing.price(c) for c in dict((b, c) for b, _, c in placed).values())
    for kind in range(6):
        lengths = sorted((min(4096, max(1, int(rng.lognormvariate(5 + kind / 3, 0.9)))) for _ in range(800)), reverse=True)
        placed = packing.pack(lengths, caps)
        assert len({c for _, _, c in placed}) > 1
        assert total(placed) <= total(packing.pack(lengths, (4096,))) and total(placed) <= 1.2 * sum(packing.price(512) / 512 * n if n <= 512 else packing.price(n) for n in lengths)

    def best(lengths, caps):  # least cost over all partitions
        costs = [math.inf]

        def place(i, bins):
            if i == len(lengths):
                costs[0] = min(costs[0], sum(packing.price(next(c for c in caps if c >= b)) for b in bins))
                return
            for k in range(len(bins)):
                if bins[k] + lengths[i] <= caps[-1]:
                    place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
            place(i + 1, [*bins, lengths[i]])

        place(0, [])
        return costs[0]

    worst = 1.0
    for _ in range(40):
        lengths = sorted((rng.randint(1, 60) for _ in range(7)), reverse=True)
        worst = max(worst, total(packing.pack(lengths, (16, 32, 64))) / best(lengths, (16, 32, 64)))
    assert worst <= 1.35


def test_packing_deals_repeated_rows_to_all_shards(spark):
    rows = [(None, "same text")] * 300
    got = packing.best_fit(spark.createDataFrame(rows, "doc_id long, text string"), shard=30).collect()
    assert len(got) == 300 and len({r.bin.split("-")[0] for r in got}) > 5


def test_roles_of_any_characters_come_back(spark):
    roles = ["a\0b", "\\", "\\n", "\n", "\\\n\\n", "x\\\\ny</s>", "a\\0b\x00"]
    df = spark.createDataFrame([(i, 0, r, "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.turns[0]["role"] for r in chat.parse(chat.format_chats(chat.events_of(df))).collect()}
    assert got == dict(enumerate(roles))


def test_url_rules_equal_sql_and_the_model_holds_out(spark):
    import duckdb

    found = urls.judge_urls(spark.read.parquet(f"{SF}/pages.parquet")).select("page_id", "host", "path", "rule").collect()
    sql = f"""
    with u as (select page_id, case when url like '%://%' then substring(url, instr(url, '://') + 3) else '' end as rest from '{SF}/pages.parquet'),
    h as (select page_id, regexp_extract(rest, '^[^/?#]*') as host, rest from u),
    p as (select page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substring(rest, length(host) + 1), '^[^?#]*') as path from h),
    r as (select * from (values ('org/'), ('example.org/es/'), ('example.org/en/1'), ('com/fr/'), ('com/de/')) t(rule)),
    f as (select page_id, arg_max(rule, length(rule)) as rule from p join r on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substring(rule, instr(rule, '/'))) group by 1)
    select page_id, host, path, rule from p left join f using (page_id)"""
    assert sorted(map(tuple, found), key=repr) == sorted(duckdb.sql(sql).fetchall(), key=repr)
    df = spark.createDataFrame([(1, "http://a.b/x")], "page_id long, url string")
    assert urls.judge_urls(df, rules=[("block", "a.b/"), ("allow", "b/x/"), ("allow", "a.b/")]).first().verdict == "block"  # the first listed of equal length
    held = urls.labelled_urls(1, 400)
    out = urls.judge_urls(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string"), rules=[]).collect()
    good, bad = ([r.score for r in out if held[r.page_id][1] == y] for y in (0, 1))
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(good) / len(bad)
    right = sum((r.verdict == "block") == bool(held[r.page_id][1]) for r in out) / len(out)
    print("urls: AUC", auc, "accuracy", right)
    assert auc >= 0.95 and right >= 0.88


def test_warc_round_trip(spark):
    big, rows = "ü" * 80, []
    rows = [(3, "a\nb", big), (1, "b", big), (2, None, None), (None, "q", big), (5, "c", ""), (7, "d", "x" * 99), (8, "d", "x" * 99), (9, "http://x/", "<html>\r\n\r\nWARC/1.1\r\n")]
    got = {r.page_id: r for r in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))).collect()}
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        revisit = i in (3, None)
        assert (got[i].record_type, got[i].refers_to, got[i].payload) == (("revisit", 1, None) if revisit else ("response", None, raw))


def test_packages_are_zip_and_zip64_directories_are_read():
    parts = [warc._gzip(warc.record(i, "u", b"body%d" % i, hashlib.sha256(b"body%d" % i).hexdigest(), "response", None)) for i in range(3)]
    places = [(sum(map(len, parts[:i])), len(p)) for i, p in enumerate(parts)]
    raw = warc.package(b"".join(parts), places)
    assert zipfile.ZipFile(io.BytesIO(raw)).testzip() is None
    assert [b for _, b in warc.Package(io.BytesIO(raw), len(raw)).records()] == [b"body0", b"body1", b"body2"]
    # the same archive with a ZIP64 end of directory and full 32-bit fields
    end = raw.rfind(b"PK\x05\x06")
    entries, length, start = struct.unpack_from("<HII", raw, end + 10)
    directory, at = b"", start
    while at < start + length:
        fixed = bytearray(raw[at : at + 46])
        n, extra, comment = struct.unpack_from("<HHH", raw, at + 28)
        packed, full = struct.unpack_from("<II", raw, at + 20)
        local = struct.unpack_from("<I", raw, at + 42)[0]
        more = struct.pack("<HHQQQ", 1, 24, full, packed, local)
        struct.pack_into("<II", fixed, 20, 0xFFFFFFFF, 0xFFFFFFFF)
        struct.pack_into("<H", fixed, 30, len(more))
        struct.pack_into("<I", fixed, 42, 0xFFFFFFFF)
        directory += bytes(fixed) + raw[at + 46 : at + 46 + n] + more
        at += 46 + n + extra + comment
    big_end = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, entries, entries, len(directory), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(directory), 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    made = raw[:start] + directory + big_end + locator + tail
    assert [b for _, b in warc.Package(io.BytesIO(made), len(made)).records()] == [b"body0", b"body1", b"body2"]


def test_components(spark):
    work = store.Workspace(spark, "t")
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (105, 101), (7, 7)]
    got = {r.v: r.label for r in store.components(work, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 105: 100}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.ngram_jaccard(docs).count() == 0
    assert repeats.remove_repeats(docs).count() == 0
    assert decontaminate.decontaminate(docs, items).count() == 0
    assert packing.best_fit(docs).count() == 0
    assert warc.archive(pages).count() == 0
    assert extract.main_text(pages).count() == 0
    assert urls.judge_urls(pages).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, seq long, message long, kind string, role string, text string")).count() == 0
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == 0
