"""Operator 4 against brute force, and the pipeline stage by stage."""

import random

import corpus_pipeline
from codeloom.llm import decontaminate as D
from codeloom.llm import language_id, queries, secret_scan, simhash


def test_lcs():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(1, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert D.lcs(a, b) == t[-1][-1]


def corpus(seed=2):
    rnd = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    words = lambda n: [rnd.choice(common) if rnd.random() < 0.4 else f"w{rnd.randrange(4000)}" for _ in range(n)]
    items = [words(rnd.randrange(10, 60)) for _ in range(50)]
    items[0] = [*words(30), "Answer:", "w1", "w2", "w3"]
    docs, leaks = [], set()
    for d in range(300):
        w = words(rnd.randrange(0, 300))
        if d % 3 == 0:
            k = rnd.randrange(50)
            x = list(items[k])
            if d % 2:                                          # a paraphrase: every eighth word another, some more words
                x = [f"w{rnd.randrange(4000)}" if i % 8 == 4 else y for i, y in enumerate(x)]
                x.insert(3, "extra")
            at = rnd.randrange(len(w) + 1)
            w[at:at] = [y.upper() if d % 5 == 0 else y for y in x]
            leaks.add((d, k))
        docs.append((d, " ".join(w)))
    return docs, [(k, " ".join(x)) for k, x in enumerate(items)], leaks


def test_recall_and_precision(spark):
    docs, items, leaks = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(df, bench).collect()}
    assert len(got & leaks) >= 0.98 * len(leaks)
    # brute force over all windows of every document: nothing that is no leak is reported
    text = dict(docs)
    by_item = dict(items)
    for d, k in got - leaks:
        a, b = D.words_of(by_item[k]), D.words_of(text[d])
        assert D.lcs(a, b) >= 0.6 * len(a)
    assert len(got - leaks) <= 0.02 * len(leaks)
    blocks = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(df, bench, block_items=20).collect()}
    assert len(blocks & leaks) >= 0.98 * len(leaks)


def test_edges(spark):
    _, items, _ = corpus()
    bench = spark.createDataFrame([*items, (90, None), (91, "too short"), (92, ""), (0, items[0][1])], "item_id long, text string")
    df = spark.createDataFrame([(1, None, 5), (None, items[3][1], 5), (2, items[3][1], 5), (2, items[3][1], 5), (3, "", 5), (4, "too short", 5)], "doc_id long, text string, item_id int")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in D.find_leaks(df, bench).collect())
    assert got == [("2", 3), ("2", 3), ("4", 91), ("None", 3)]
    assert D.find_leaks(df.limit(0), bench).count() == 0 and D.find_leaks(df, bench.limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf).toPandas().set_index("doc_id")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "secret_scan", "byte_bpe"]
    ok = language_id.identify(docs, declared_col="lang", host_col="source").filter("accepted").drop("language", "confidence", "accepted")
    one = {r["doc_id"] for r in simhash.near_duplicates(ok).collect() if r["component_id"] == r["doc_id"]}
    leaks = D.find_leaks(ok, spark.read.parquet(f"{sf}/benchmark.parquet"))
    left = one - {r["doc_id"] for r in leaks.collect()}
    assert set(got.index) == left and len(left) > 100
    found, _ = secret_scan.scan(docs.filter(docs["doc_id"].isin(sorted(left))))
    for r in found.collect():
        want = list(r["text"])
        for s in r["spans"] or []:
            want[s["start"]: s["end"]] = "*" * (s["end"] - s["start"])
        assert got.loc[r["doc_id"], "text"] == "".join(want)
    import base64

    import public_tokenizers as P
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(queries.BYTE_BPE), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(enc.encode_ordinary(r.text) == list(r.ids) and r.n_tokens == len(r.ids) for r in got.itertuples())


def test_pipeline_stages_take_empty_and_null_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "src1", 0), (1, "", "en", None, 0)], docs.schema)
    for rows in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            assert out.columns[: len(docs.columns)] == docs.columns or name == "byte_bpe"
            assert out.count() <= rows.count()
