"""Operators 11 to 13 against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import decontaminate, merkle, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)


def clashing(docs):
    """Columns with the names that operators use inside."""
    names = ["rest", "hits", "items", "spans", "idx", "part", "leaf", "tree", "unit", "nodes", "w", "word", "n", "back", "node", "unused"]
    return docs.withColumns({n: F.lit("x") for n in names})


# Operator 11


def test_backward_search_finds_every_place():
    rng = random.Random(1)
    for _ in range(60):
        text = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 60))] + [0])
        index = decontaminate.FmIndex(text, 5, sample=rng.choice([1, 3, 16]))
        phrases = [[rng.randint(1, 4) for _ in range(rng.randint(1, 4))] for _ in range(20)]
        rows = np.zeros((20, 4), int)
        for row, p in zip(rows, phrases, strict=True):
            row[4 - len(p) :] = p
        low, high = index.search(rows, np.array(list(map(len, phrases))))
        for p, a, b in zip(phrases, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(len(text) - len(p) + 1) if text[k : k + len(p)].tolist() == p]


def terms(text):
    return [(m.start(), m.end(), m.group().translate(ASCII_LOWER)) for m in re.finditer("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", text or "")]


def passages(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        ws = [w for _, _, w in terms(t)]
        for k in range(max(1, len(ws) - 9) if ws else 0):
            windows[tuple(ws[k : k + 10])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        found, hit, ws = set(), set(), terms(t)
        for n in {len(w) for w in windows}:
            for k in range(len(ws) - n + 1):
                if ids := windows.get(tuple(w for _, _, w in ws[k : k + n])):
                    found |= ids
                    hit |= set(range(k, k + n))
        spans = []
        for k in sorted(hit):
            if spans and k - 1 in hit:
                spans[-1][1] = ws[k][1]
            else:
                spans.append([ws[k][0], ws[k][1]])
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), ",".join(f"{a}:{b}" for a, b in spans)))
    return out


def test_passages(spark):
    rng = random.Random(4)
    words = ["One", "two", "THREE", "vier", "fünf", "s1x", "日本", "Éa", "zz"]
    draw = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--", " 'n "]) for _ in range(n))
    items = [(k, draw(rng.choice([1, 3, 9, 10, 11, 25]))) for k in range(25)] + [(3, draw(12)), (None, draw(14)), (90, None), (91, "?!"), (92, "")]
    docs = [(d, draw(rng.randint(0, 60)) + (rng.choice(items)[1] or "").upper() + draw(rng.randint(0, 9))) for d in range(80)]
    docs += [(0, docs[0][1]), (None, docs[1][1]), (200, None), (201, ""), (202, " \n"), (203, "x" * 40_000), (204, ("one two " * 6000) + items[20][1])]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(passages(docs, items), key=key)
    given, bench = clashing(table(spark, docs)), spark.createDataFrame(items, "item_id long, text string")
    for shard, block in ((8 << 20, 8 << 20), (900, 400)):
        got = sorted((tuple(r) for r in decontaminate.find_passages(given, bench, shard, block).collect()), key=key)
        assert got == want
    cleaned = decontaminate.remove_passages(given, bench, 900, 400)
    assert cleaned.columns == given.columns
    removed = {}
    for d, *_, spans in want:
        edges = [0, *(int(x) for s in spans.split(",") if s for x in s.split(":")), None]
        text = next(t for a, t in docs if a == d)
        removed[d] = None if text is None else "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    assert {r["doc_id"]: r["text"] for r in cleaned.collect() if r["doc_id"] not in (200, None)} == {d: t for d, t in removed.items() if d not in (200, None)}


def test_passages_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate.find_passages(table(spark, []), bench).count() == 0
    for none in (bench.limit(0), spark.createDataFrame([(1, None), (2, "..")], "item_id long, text string")):
        (row,) = decontaminate.find_passages(table(spark, [(1, "one two three")]), none).collect()
        assert (row["n_words"], row["n_hit"], row["contaminated"], row["items_sha256"]) == (3, 0, False, hashlib.sha256(b"").hexdigest())


def test_words_that_share_a_hash_are_told_apart():
    phrases = decontaminate.Phrases(["1"], ["alpha beta"])
    data = np.frombuffer(b"alpha betas alphb", np.uint8)
    starts, ends = decontaminate.word_bounds(data, np.array([0, len(data)]))
    assert phrases.same(data, starts, ends, np.array([1, 2, 1])).tolist() == [True, False, False]


# Operator 12


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(docs):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(ASCII_LOWER)):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = []
    for w in sorted(counts):
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def test_variants(spark):
    rng = random.Random(6)
    alphabet = "abÀ×"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.choice([6, 7, 8, 12, 30, 47, 48, 49, 60]))) for _ in range(70)] + ["a" * n for n in (6, 7, 8, 47, 48, 49, 50)]
    words = list(base)
    for w in base:
        for _ in range(2):
            k = rng.randrange(len(w))
            kind = rng.randrange(3)
            words.append(w[:k] + rng.choice(alphabet) * (kind != 0) + w[k + (kind != 2) :])
    # Chains of forms: each a fifth as frequent as the next.
    chain = ["colour" * 2, "colourcolouq", "colourcolopq", "colourcolzpq"]
    docs = [(rng.choice([None, d]), " ".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(30))) for d in range(300)]
    docs += [(1000 + d, (chain[k] + " ") * (700, 130, 25, 5)[k]) for d, k in enumerate((0, 1, 2, 3))] + [(2000, None), (2001, ""), (2002, "é" * 30_000), docs[0]]
    got = sorted(tuple(r) for r in spelling.spelling_variants(clashing(table(spark, docs))).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == sorted(variants(docs))
    assert {r[2] for r in got if r[0] in chain[1:]} == {chain[0]}


def test_no_words(spark):
    assert spelling.spelling_variants(table(spark, [])).count() == 0
    assert spelling.spelling_variants(table(spark, [(1, None), (2, "short words only")])).count() == 0


# Operator 13


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {s: levels([leaf(r, r["text"]) for r in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            hit = r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            found, proof = leaf(r, r["text"].translate(ASCII_LOWER) if hit else r["text"]), []
            for tree, at in ((trees[s], i), (top, k)):
                for nodes in tree[:-1]:
                    run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
                    proof += run[: at % 16] + run[at % 16 + 1 :]
                    found, at = sha(run[: at % 16] + [found] + run[at % 16 + 1 :]), at // 16
            out.append((r["doc_id"], leaf(r, r["text"]), trees[s][-1][0], top[-1][0], sha(proof), found, found == top[-1][0]))
    return out


def test_manifest(spark):
    rng = random.Random(3)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    for n, n_sources, height in ((0, 1, 3), (1, 1, 3), (17, 1, 1), (290, 1, 1), (400, 30, 1), (700, 2, 2)):
        sources = [None, "", "é", *(f"s{k}" for k in range(n_sources))] if n_sources > 1 else ["a"]
        rows = [(rng.choice([None, *range(n)]), rng.choice([None, "", "Ab", "É xY", "zz"]), rng.choice([None, "en"]), rng.choice(sources), rng.choice([None, 3])) for _ in range(n)]
        docs = spark.createDataFrame(rows, DOCS)
        got = sorted(map(tuple, merkle.manifest(clashing(docs), height=height).collect()), key=key)
        assert got == (sorted(manifest([r.asDict() for r in docs.collect()]), key=key) if n else [])


def test_states_resume_before_every_slot():
    children = [sha([str(k)]) for k in range(16)]
    for n in (1, 2, 16):
        parent = merkle.Parent(children[:n])
        assert parent.digest == sha(children[:n])
        for k in range(n):
            changed = [*children[:k], "0" * 64, *children[k + 1 : n]]
            assert parent.fold(k, "0" * 64) == sha(changed) == merkle.Resumed(children[:k], children[k + 1 : n]).fold("0" * 64)
            assert parent.fold(k, children[k]) == parent.digest


# Additions to operators 1, 4 and 10


def test_the_sum_index_finds_a_filling_whenever_there_is_one():
    from itertools import combinations_with_replacement

    from millrace.llm import packing

    rng = random.Random(7)
    for _ in range(120):
        size = rng.randint(4, 40)
        have = np.array([0] + [rng.choice([0, 0, 0, 1, 2]) for _ in range(size)])
        index = packing.SumIndex(have)
        for _ in range(30):
            gap = rng.randint(1, size)
            lengths = [int(x) for x in np.flatnonzero(have)]
            exists = any(sum(c) == gap and all(c.count(x) <= have[x] for x in c) for n in (1, 2, 3) for c in combinations_with_replacement(lengths, n))
            found = index.find(gap)
            assert bool(found) == exists
            if found:
                assert sum(found) == gap and len(found) <= 3 and all(found.count(x) <= have[x] for x in found)
                for x in found:
                    have[x] -= 1
            elif rng.random() < 0.3:  # lengths come back, as when a pattern is taken back
                have[rng.randint(1, size)] += 1


def test_shards_give_every_row_back(spark, tmp_path):
    from millrace.llm import packing

    docs = table(spark, [(d, "word " * (d * 37 % 90)) for d in range(60)] + [(100, None), (101, "x " * 300)])
    matrix = packing.pack_matrix(docs, capacity=64)
    want = {r["sequence_id"]: (bytes(r["ids"]), r["cu_lengths"]) for r in matrix.collect()}
    path = f"file://{tmp_path}/shards"
    packing.write_shards(matrix, path, shard_rows=8)
    got = packing.read_shards(spark, path, 64).collect()
    assert {r["sequence_id"]: (bytes(r["ids"]), r["cu_lengths"]) for r in got} == want and all(r["intact"] for r in got) and len(got) == len(want)
    some = [3, 9, 10**9]
    assert {r["sequence_id"] for r in packing.read_shards(spark, path, 64, some).collect()} == {3, 9}
    index = spark.read.parquet(f"{path}/index").collect()
    assert sum(r["n_rows"] for r in index) == len(want) and len(index) == -(-len(want) // 8)


def test_short_lines_are_compared_like_long_ones(spark):
    from millrace.llm import lines

    # 19 characters, the last one changed: 14 of 16 windows in common. Four characters: one window each.
    texts = ["abcdefghijklmnopqrs\nabcd\nab", "abcdefghijklmnopqrt\nabce\nab"]
    got = {r["doc_id"]: r["dropped"] for r in lines.line_report(table(spark, list(enumerate(texts)))).collect()}
    assert got == {0: "", 1: "0,2"}


def test_lines_take_no_python_and_fold_space_as_python_does(spark):
    from pyspark.sql import functions as F

    from millrace.llm import lines

    odd = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
    texts = [f" One{a}{b}Two{b} \n{a}\n\nthree  four{b}" for a, b in zip(odd, odd[1:] + " ", strict=True)] + ["", "\n", " a \n b ", "Ünï Cödé  x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["x"] for r in df.select("doc_id", lines.normal_lines(F.col("text")).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [[" ".join(line.lower().split()) for line in t.split("\n")] for t in texts]
    plan = lines.line_report(table(spark, list(enumerate(texts))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_lines_of_all_kinds_meet(spark):
    from millrace.llm import lines

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    spaced = " ".join(word() for _ in range(40))
    run = "".join(rng.choice("abcdefghijklmnop") for _ in range(300))
    ideographs = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(120))
    long_line = " ".join(word() for _ in range(3000))
    # Without spaces, of another script, repeated characters and phrases, a part moved, one that is long, one by a character longer.
    pairs = [(run, run[:150] + "z" + run[151:]), (ideographs, ideographs[:60] + "x" + ideographs[61:]), ("-" * 6, "-" * 90), ("=" * 50, "=" * 70), ("ab c " * 9, "ab c " * 40), (spaced, spaced[100:] + " " + spaced[:99]), (long_line, long_line[:9000] + "zz" + long_line[9003:]), ("hello wo", "hello wor")]
    rows = [(i, line) for i, line in enumerate(x for pair in pairs for x in pair)]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.line_report(table(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == [0, 1] * len(pairs)


def test_lines_that_share_a_passage_alone_make_few_pairs(spark, monkeypatch):
    from millrace.llm import lines

    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    passage = words(20)
    rows = [(i, f"{words(30)} {passage} {words(30)}") for i in range(300)]
    made = {}
    write = lines.materialise

    def counted(df, name):
        out = write(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(lines, "materialise", counted)
    assert all(r["n_dropped"] == 0 for r in lines.line_report(table(spark, rows)).collect())
    assert sum(made["near"]) == 0 and max(made["pairs"]) < 40 * len(rows)
