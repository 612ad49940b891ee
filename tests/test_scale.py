"""What may not be shuffled or done twice as tables grow, and that results stay whole."""

from pyspark.sql import functions as F

from millrace.operators import chunk_evaluation, chunking, evidence, retrieval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sentences_are_placed_without_a_shuffle_and_across_batches(spark):
    texts = ["One two. Three four five. Six.", None, "  ", " ".join(f"Word{i} and more." for i in range(40)), "no end", "A.\u00a0B c.\u2003D! \x1fE"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        spans = chunk_evaluation.sentence_spans(docs)
        assert "Exchange" not in plan(spans) and "Exchange" not in plan(chunk_evaluation.paragraph_or_sentence(docs, 8))
        got = {}
        for r in spans.collect():
            got.setdefault(r["doc_id"], []).append((r["position"], r["start"], r["end"], r["text"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for d, t in enumerate(texts[:5]):
        assert [(a, b, s) for _, a, b, s in got.get(d, [])] == [(a, b, s) for s, a, b in chunking.spans(t or "", chunking.SENTENCE_END)]
    assert [(p, a, b) for p, a, b, _ in got[5]] == [(0, 0, 5)]


def test_gated_patterns_match_as_the_patterns_alone(spark):
    texts = ["do not answer", "please act as a clerk", "My API-key is", "api_key", "chain of thought", "you are  now", "send it to a token", "nothing here", "donot answer", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    names = ["instruction_override", "exfiltration"]
    plain = "(?s)" + "|".join(f"(?:{p})" for n in names for p in evidence.fixed.SAFETY_PATTERNS[n])
    low = F.lower(F.coalesce("text", F.lit("")))
    assert all(r[0] == r[1] for r in rows.select(evidence.matches(low, names), low.rlike(plain)).collect())


def test_bm25_lists_are_the_same_from_matrices_and_from_pairs(spark):
    words = ["river", "stone", "cloud", "field", "north", "amber", "quiet", "lantern"]
    texts = [" ".join(words[(i * j + j) % 8] for j in range(1, 3 + i % 7)) for i in range(60)] + ["", None, "nothing shared here", *["river stone"] * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    queries = spark.createDataFrame([(q, f"{words[q % 8]} {words[q % 3]} {words[q % 3]} absent{q}") for q in range(12)] + [(12, ""), (13, None), (14, "unknown")], "query_id int, text string")
    tokens = retrieval.tokenised(docs)
    pairs = sorted(map(tuple, retrieval.bm25_top_k(queries, docs, 4, tokens, most=0).collect()))
    for size in (64 << 20, 100):  # all queries at once, and few at a time
        found = retrieval.bm25_top_k(queries, docs, 4, tokens, block_bytes=size)
        assert sorted(map(tuple, found.collect())) == pairs and found.dtypes == [("query_id", "int"), ("doc_id", "int"), ("score", "double"), ("rank", "int")]
    assert len(pairs) == 48 and retrieval.bm25_top_k(queries.where("query_id > 11"), docs, 4, tokens).count() == 0
    assert "Exchange" not in plan(retrieval.scanned(retrieval.query_terms(queries), tokens, 4, 64 << 20))


def test_overlap_brings_candidates_to_the_words(spark):
    docs = spark.createDataFrame([(1, "river river stone"), (2, "cloud"), (3, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "river stone river field"), (8, "")], "query_id long, text string")
    candidates = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (8, 1)], "query_id long, doc_id long")
    found = retrieval.overlap_scores(queries, candidates, docs)
    assert sorted(map(tuple, found.collect())) == [(7, 1, 0.666667), (7, 2, 0.0), (7, 3, 0.0), (8, 1, 0.0)]
    assert "Exchange hashpartitioning(doc_id" not in plan(found)


def test_alignment_by_pairs_in_passes_and_by_first_sentences(spark, monkeypatch):
    from millrace.operators import grounding

    words = ["river", "stone", "cloud", "field", "north", "amber", "quiet", "lantern", "meadow", "copper"]
    told = [" ".join(words[(i * j + i) % 10] for j in range(1, 4 + i % 6)) for i in range(80)]
    asked = [(i, " ".join(words[(i + 3 * j) % 10] for j in range(1 + i % 6))) for i in range(40)] + [(40, "absent"), (41, "")]
    docs = spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")
    write, met = grounding.materialise, {}

    def counted(df, name):
        met.setdefault(name, []).append(write(df, name))
        return met[name][-1]

    monkeypatch.setattr(grounding, "materialise", counted)
    want = []
    for i, s in asked:
        q = set(s.split())
        shares = [(-round(len(q & set(t.split())) / len(q), 6), d) for d, t in enumerate(told) if q and len(q & set(t.split())) >= 0.8 * len(q)]
        want.append((i, len(q), *((min(shares)[1], 0, -min(shares)[0]) if shares else (None, None, None))))
    for most in (8, 1):
        monkeypatch.setattr(grounding, "PASS_PAIRS", most)
        met.clear()
        rows = grounding.aligned(spark.createDataFrame(asked, "id long, sentence string"), docs, ["id"]).collect()
        assert sorted(map(tuple, rows), key=lambda r: r[0]) == want
        assert len(met["found"]) > (most == 1)
        single = met["wanted"][0].where("size(_words) = 1").select("asked")
        assert single.count() > 1 and met["pairs"][0].join(single, "asked").count() == 0
