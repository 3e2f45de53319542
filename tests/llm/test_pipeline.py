import numpy as np

import corpus_pipeline


def test_stages_keep_the_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, sf), "test-stage")
        if name != "best-fit packing":
            assert docs.columns == columns
            counts.append(docs.select("doc_id").distinct().count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[-1] > counts[0] / 2
    assert {"sequence_id", "offset", "ids_crc32"} <= set(docs.columns)


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(n))


def test_stages_on_edge_cases(spark, tmp_path):
    """Nulls in all columns, empty and long texts, repeated rows, clashing names and empty tables go through run()."""
    schema = "doc_id long, text string, lang string, n_chars long, score double, `a.b` int, n_bytes long"
    whole = words(1, 200)
    rows = [(1, whole, "en", len(whole), 0.5, 1, 7), (2, whole, None, None, None, None, None), (3, None, None, None, None, None, None), (4, "", "en", 0, 0.1, 2, 8), (None, "no key", None, None, None, None, None), (5, words(2, 30_000), "en", 1, 0.1, 3, 9)]
    rows += [(6, words(3, 120), "en", 1, 0.1, 4, 10)] * 2 + [(7, f"{words(4, 60)} {words(9, 40)} {words(5, 60)}", "en", 1, 0.1, 5, 11)]
    labels = [(k, k % 2) for k in range(20)]
    for name, docs in (("some", rows), ("none", [])):
        sf = tmp_path / name
        spark.createDataFrame(docs, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(labels if docs else [], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, words(9, 40)), (2, None), (3, "")] if docs else [], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        kept = spark.read.parquet(f"{sf}/documents.parquet")
        columns = kept.columns
        for stage, function in corpus_pipeline.STAGES[1:4]:
            kept = corpus_pipeline.settle(function(spark, kept, str(sf)), stage.replace(" ", "-"))
            assert kept.columns == columns
        got = {(r.doc_id, r.n_bytes) for r in kept.collect()}
        assert got == ({(1, 7), (3, None), (4, 8), (None, None), (5, 9), (6, 10)} if docs else set())
        packed = corpus_pipeline.run(spark, str(sf))
        assert {r.doc_id for r in packed.collect()} <= {k for k, _ in got}


def test_run_equals_brute_force(spark, tmp_path):
    """The stages behind the classifier, one by one, against all pairs, all strings and edit distances."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from flowmill.llm import minhash

    passage, item = words(50, 40), words(51, 12)
    texts = [words(60 + k, 60 + 5 * k) for k in range(8)]
    texts += [texts[0] + " end", texts[3], f"{words(70, 30)} {passage} {words(71, 30)}", f"{words(72, 30)} {passage} {words(73, 30)}", f"{words(74, 30)} {item[:20]}x{item[21:]} {words(75, 20)}"]
    rng = np.random.default_rng(3)
    rows = [(int(k), texts[k], "en", "s", len(texts[k])) for k in rng.permutation(len(texts))]
    sf = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(len(texts))], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    idf = minhash.bucket_weights(minhash.document_frequencies(docs, "text"), len(texts))
    sets = []
    for t in texts:
        _, h, n = minhash.shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        sets.append((h, minhash.weights(h, n, idf)))
    kept = []
    for k in range(len(texts)):
        if not any(minhash.weighted_jaccard(*sets[k], *sets[j]) >= 0.8 for j in range(k)):
            kept.append(k)
    assert kept == [k for k in range(len(texts)) if k not in (8, 9)]
    seen, left = set(), {}
    for k in kept:
        data = texts[k].encode()
        covered = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                covered[p : p + 100] = True
            seen.add(data[p : p + 100])
        left[k] = np.frombuffer(data, np.uint8)[~covered].tobytes().decode()
    assert len(left[11]) < len(texts[11]) - 150
    for k in list(left):
        row = [0] * (len(left[k]) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(left[k], 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        if min(row) <= len(item) // 10:
            del left[k]
    assert sorted(left) == [*range(8), 10, 11]
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    size = {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in left.items()}
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == size
