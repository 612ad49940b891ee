"""The ten operators and the pipeline on small tables: brute force, exact round trips and edge cases."""

import hashlib
import itertools
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import bpe, classifier, fingerprints, lexicon, lines, neardup, packing, pii, prefixes, rules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WEIRD = [None, "", "  \n\t ", "x", "é" * 3, "日本語のテキスト ΣΑΣ", "a" * 30_000, "<|endoftext|> <|startoftext|>", "Don't STOP 'twas 12 \x1c\x85", "word " * 300]


def table(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    """Columns with the names that operators use inside."""
    names = ["k", "h", "lines", "node", "component", "base", "found", "kept", "n_words", "_text", "_words", "dropped", "length"]
    return docs.withColumns({n: F.lit(1) for n in names})


@pytest.fixture(scope="module")
def library():
    return bpe.load(bpe.default_path()).library


def test_encoding_is_the_librarys(library):
    texts = [t or "" for t in WEIRD]
    got = bpe.PieceEncoder(bpe.load(bpe.default_path())).encode(texts)
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_lexicon_finds_exactly_its_words():
    words = {w.encode(): (i, i + 1) for i, w in enumerate(["a", "ab", "tap", "taps", "top", "tops", "é"])}
    found = lexicon.Lexicon(lexicon.build(words))
    assert found(list(words)) == list(words.values())
    assert found([b"", b"t", b"tapsx", b"zz"]) == [None] * 4
    assert lexicon.Lexicon(lexicon.build({}))([b"a"]) == [None]


def test_encode_decode(spark, library):
    rows = {r["doc_id"]: r for r in lexicon.encode_decode(clashing(table(spark, WEIRD)), with_ids=True).collect()}
    for i, t in enumerate(WEIRD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (rows[i]["ids"], rows[i]["decoded"]) == (ids, decoded)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert lexicon.encode_decode(table(spark, [])).count() == 0


def check_places(rows, capacity):
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity


def test_packing_covers_everything(spark, library):
    texts = [*WEIRD, "same words here", "same words here", "one two three four five six seven eight nine ten eleven"]
    rows = packing.pack_best_fit(clashing(table(spark, texts)), capacity=8).collect()
    check_places(rows, 8)
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), 8)):
            part = ids[start : start + 8]
            r = pieces.pop((i, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    assert not pieces
    assert packing.pack_best_fit(table(spark, [])).count() == 0


@pytest.mark.parametrize("plan", [packing.exact_complement_plan, packing.best_fit_decreasing_plan])
def test_plans_place_every_rank_once(plan):
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = np.zeros(33, np.int64)
        counts[1:] = rng.integers(0, 30, 32) * (rng.random(32) < 0.6)
        seen, fill = Counter(), Counter()
        for length, rank, n, sequence, offset, copies in plan(counts, 32):
            for r in range(n):
                seen[(length, rank + r)] += 1
                fill[sequence + r // copies] += length
        assert seen == Counter({(a, r): 1 for a in range(33) for r in range(counts[a])})
        total = int((counts * np.arange(33)).sum())
        assert all(v <= 32 for v in fill.values()) and len(fill) <= total / 32 * 1.25 + 2


def test_matrix_gives_the_ids_back(spark, library):
    import numpy as np

    texts = ["a b c d e f g h i j", None, "hello world"]
    ids = {}
    for row in packing.pack_matrix(table(spark, texts), capacity=8).collect():
        flat, positions = (np.frombuffer(row[c], "<u4") for c in ("ids", "position_ids"))
        assert len(flat) == 8
        for doc, piece, a, b in zip(row["doc_ids"], row["pieces"], row["cu_lengths"][:-1], row["cu_lengths"][1:], strict=True):
            ids[(doc, piece)] = flat[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
    for i, t in enumerate(texts):
        whole = [x for k in sorted(k for d, k in ids if d == i) for x in ids[(i, k)]]
        assert whole == library.encode(t or "", add_special_tokens=False).ids + [1]


def test_fingerprints(spark):
    texts = ["Straße  Ａ", " STRASSE a", "é x", "é  X", None, "", "odd"]
    docs = clashing(table(spark, texts))
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect()}
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] != rows[2]["fingerprint"] == rows[3]["fingerprint"]
    assert rows[4]["fingerprint"] == rows[5]["fingerprint"] and rows[4]["near_next"] == 0.0 and rows[5]["near_next"] == 1.0
    assert (rows[1]["class_id"], rows[1]["members"], rows[6]["members"]) == (0, 2, 1)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i - 1) % len(texts)] or ""
        half = len(t) // 2
        assert rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert len(rows[i]["fingerprint"]) == 64
    assert fingerprints.fingerprint_documents(table(spark, [])).count() == 0
    assert fingerprints.fingerprint_documents(table(spark, ["ab"])).first()["near_next"] == 1.0
    assert unicodedata.normalize("NFKC", "Ａ") == "A"


def fingerprint_by_force(text):
    form = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    form = re.sub(r"[\s\x85]+", " ", form).strip(" ").encode()
    return "".join(f"{xxhash.xxh64_intdigest(form, xxhash.xxh64_intdigest(k.to_bytes(4, 'little'), 42)):016x}" for k in range(4))


def test_fingerprints_by_brute_force(spark):
    texts = ["Plain words\n and  MORE", "Ｆｕｌｌ ｗｉｄｔｈ ﬁne", "Straße Äpfel ½", "", "x" * 300_000 + " END", "tab\tand\u00a0space", "plain words and more"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, ""), (None, "Null id")], "doc_id long, text string")
    by_id = {}
    for r in fingerprints.fingerprint_documents(rows).collect():
        by_id.setdefault(r["doc_id"], []).append(r)
    order = [(None, "Null id"), *enumerate(texts)]
    for (i, t), (_, after) in zip(order, [order[-1], *order[:-1]], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        for r in by_id[i]:
            assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint_by_force(t), fingerprint_by_force(edited))
            assert (r["near_edited"], r["near_next"]) == (float(fingerprint_by_force(t) == fingerprint_by_force(edited)), float(fingerprint_by_force(t) == fingerprint_by_force(after)))
    assert len(by_id[3]) == 2 and by_id[0][0]["class_id"] == 0 and by_id[6][0]["members"] == 2


PII = [
    "mail a.b@x.org, or c@d.e_f@g.hi from 10.0.0.1 and 300.1.1.1",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, call +1 (974) 555-3436 now",
    "1" * 3000 + " " + "a" * 20_000 + "@",
    "x@a" + ".b" * 2000,
    "+1" + " " * 5000,
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end',
    None,
    "",
    "nothing private 12 34",
]


def base_spans(t):
    found = []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for kind, p in enumerate(patterns):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if (kind == 0, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), kind == 2 and 14 <= len(d) <= 19 and luhn, kind == 3 and 10 <= len(d) <= 15)[kind]:
                found.append((m.start(), kind, m.end()))
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{e}" for a, k, e in sorted(found))


def test_private_data(spark):
    rows = {r["doc_id"]: r for r in pii.find_private(clashing(table(spark, PII))).collect()}
    for i, t in enumerate(PII):
        base = base_spans((t or "")[:]) if i != 2 else ""
        assert rows[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(rows[i]["spans"].split(","))
    assert rows[8]["spans"] == ""
    assert pii.find_private(table(spark, [])).count() == 0
    masked = {r["doc_id"]: r["text"] for r in pii.mask(clashing(table(spark, PII))).collect()}
    assert masked[1] == "card [CARD] or 4111-1111-1111-1112, call [PHONE] now" and masked[6] is None


def test_private_data_without_caps(spark):
    secret = 'secret = "' + "a1" * 150 + '"'
    runs = " ".join(f"{i % 10000:04d}x" for i in range(20_000))
    mails = " ".join(f"u{i}@a.org" for i in range(3000))
    far = "n" * 90 + " at " + "m" * 80 + " dot com"
    rows = {r["doc_id"]: r for r in pii.find_private(table(spark, [secret, runs, mails, far])).collect()}
    assert rows[0]["spans"] == f"secret:0:{len(secret)}"
    assert rows[1]["spans"] == "" and rows[2]["n_email"] == 3000
    assert rows[2]["base_sha256"] == hashlib.sha256(base_spans(mails).encode()).hexdigest()
    assert rows[3]["spans"] in ("", f"email:0:{len(far)}")


def test_span_model_without_data():
    assert not pii.SpanModel([]).weights.any()


def shingles(t, width):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def classes_by_force(texts, width=5):
    sets = [shingles(t, width) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                label[i] = label[j] = min(label[i], label[j])
    return label, [len(s) for s in sets]


def variants(n, words=80):
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for k in range(i % 7):
            w[(i * 13 + k * 11) % words] = f"x{i}_{k}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_by_brute_force(spark):
    texts = [None, "", "A b c", "a B C", *variants(60), *(f"other text number {i} about thing {i * i} and more of {i}" for i in range(10)), *variants(3)]
    label, sizes = classes_by_force(texts)
    rows = {r["doc_id"]: r for r in neardup.near_duplicates(clashing(table(spark, texts))).collect()}
    assert [(rows[i]["component_id"], rows[i]["n_shingles"], rows[i]["kept"]) for i in range(len(texts))] == [(label[i], sizes[i], label[i] == i) for i in range(len(texts))]
    kept = neardup.keep_one(clashing(table(spark, texts)))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if label[i] == i]
    assert neardup.near_duplicates(table(spark, [])).count() == 0


def test_pipeline_drops_near_copies_from_four_fifths(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = []
    for g in range(60):
        words = [f"w{g}_{i}" for i in range(54 + g % 7)]
        texts += [" ".join(words), " ".join([*words[:20], f"x{g}", *words[21:]])]
    sets = [shingles(t, 5) for t in texts]
    likeness = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert all(0.8 <= x < 0.85 for x in likeness)
    docs = table(spark, texts)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(0, 120, 2))
    assert neardup.near_duplicates(docs).where("kept").count() == 120


def test_prefix_pairs_miss_nothing(spark):
    import random

    rng = random.Random(5)
    sets = [(i, i, s) for i in range(60) for s in [sorted(rng.sample(range(14), rng.randint(3, 12)))]]
    df = spark.createDataFrame([(n, c, len(s), s, prefixes.bitmap(np.array(s)).tolist()) for n, c, s in sets], "node long, component long, size int, tokens array<long>, bits array<long>")
    got = {(r["u"], r["v"]) for r in prefixes.prefix_pairs(df, 80).collect()}
    for (i, _, a), (j, _, b) in itertools.combinations(sets, 2):
        n = len(set(a) & set(b))
        if 100 * n >= 80 * (len(a) + len(b) - n):
            assert (i, j) in got


def test_line_dedup(spark):
    long = "the quick brown fox jumps over the lazy dog while seven wise owls watch from tall green trees nearby and a few small grey mice run home along their old stone wall before night falls over these quiet hills"
    texts = [f"{long}\nshort\nfirst only line of this text", f"Second text has its own line\n{long.upper()}  \nshort", long.replace("seven", "eight") + "\n" + long, None, "", long]
    rows = {r["doc_id"]: r for r in lines.line_report(clashing(table(spark, texts))).collect()}
    assert [rows[i]["dropped"] for i in range(6)] == ["", "1,2", "0,1", "", "", "0"]
    assert rows[1]["kept_sha256"] == hashlib.sha256(b"Second text has its own line").hexdigest() and rows[3]["n_lines"] == 0
    kept = {r["doc_id"]: r for r in lines.drop_repeated_lines(clashing(table(spark, texts))).collect()}
    assert set(kept) == {0, 1, 3, 4} and kept[1]["text"] == "Second text has its own line" and kept[1]["n_chars"] == 28
    assert lines.line_report(table(spark, [])).count() == 0


def edited_lines(n, edits, chars, seed=3):
    """``n`` lines of words and copies with ``edits`` characters replaced, at a window Jaccard of at least 0.8."""
    import random

    rng, out = random.Random(seed), []
    while len(out) < n:
        line = ""
        while len(line) < chars:
            line += " " * bool(line) + "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
        copy = list(line)
        for i in rng.sample(range(len(copy)), edits):
            copy[i] = "z"
        x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (line, "".join(copy)))
        if line != "".join(copy) and 10 * len(x & y) >= 8 * len(x | y):
            out.append((line, "".join(copy)))
    return out


def test_line_dedup_finds_edited_characters(spark):
    pairs = [*edited_lines(60, 1, 60), *edited_lines(60, 2, 150), *edited_lines(60, 4, 300)]
    rows = lines.line_report(table(spark, [t for pair in pairs for t in pair])).where("n_dropped > 0")
    found = {r["doc_id"] for r in rows.collect()}
    assert all(i % 2 for i in found)
    for part in range(3):
        assert len([i for i in found if i // 120 == part]) >= 57


def kept_places(texts):
    """Brute force of the line stage: the places that are dropped in each text."""
    norm = [[" ".join(line.lower().split()) for line in (t.split("\n") if t is not None else [])] for t in texts]
    distinct = sorted({n for ns in norm for n in ns if n})
    at = {n: i for i, n in enumerate(distinct)}
    label = list(range(len(distinct)))
    sets = [{n[i : i + 5] for i in range(len(n) - 4)} if len(n) >= 20 else set() for n in distinct]
    for i, j in itertools.combinations(range(len(distinct)), 2):
        if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and label[i] != label[j]:
            label = [label[j] if x == label[i] else x for x in label]
    seen, gone = set(), []
    for ns in norm:
        places = []
        for pos, n in enumerate(ns):
            if n and label[at[n]] in seen:
                places.append(pos)
            elif n:
                seen.add(label[at[n]])
        gone.append(",".join(map(str, places)))
    return gone


def test_line_dedup_by_brute_force(spark):
    import random

    rng = random.Random(11)
    base = "".join(rng.choice("abcdefg hijk lmnop") for _ in range(260))
    family = []
    for i in range(150):  # a crowd of copies with one to forty characters changed, of which some are too far apart
        line = list(base)
        for at in rng.sample(range(len(line)), rng.choice([1, 2, 3, 4, 8, 20, 40])):
            line[at] = rng.choice("uvwxyz")
        family.append("".join(line))
    others = [x for pair in edited_lines(40, 3, 200, seed=5) for x in pair]
    lines_ = [*family, *others, *family[:20], *["same short"] * 5, "", "   "]
    rng.shuffle(lines_)
    texts = ["\n".join(lines_[i : i + 4]) for i in range(0, len(lines_), 4)]
    got = {r["doc_id"]: r["dropped"] for r in lines.line_report(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == kept_places(texts)


def test_line_dedup_edge_cases(spark):
    long = "x" * 400_000 + "\n" + "many\n" * 3000 + "".join(chr(97 + i % 23) + str(i) for i in range(60_000))
    docs = spark.createDataFrame([(None, "a line of some length here", "en", "s", 1), (7, "A line  of some length here", "en", "s", 1), (7, "A line  of some length here", "en", "s", 1), (8, long, None, None, None), (9, long.replace("x", "X"), "en", "s", 1), (10, None, "en", "s", 0)], DOCS)
    rows = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in lines.line_report(clashing(docs)).collect()), key=str)
    assert rows == sorted([(None, 1, 0), (7, 1, 1), (7, 1, 1), (8, 3002, 2999), (9, 3002, 3002), (10, 0, 0)], key=str)
    assert sorted(r["doc_id"] or 0 for r in lines.drop_repeated_lines(docs).collect()) == [0, 8, 10]


def test_quality_rules(spark):
    good = [" ".join(f"word{(i * j) % 97} the of and" for j in range(1, 40)) + "." for i in range(1, 41)]
    texts = [*good, None, "", "a b c", "the same words again " * 40, "!!! ### $$$ *** " * 5 + " ".join(f"#{i}$" for i in range(200))]
    rows = {r["doc_id"]: r for r in rules.quality_rules(clashing(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) for k in range(3) if windows[tuple(w[i : i + 3])] > 1}
        symbols = sum((t or "").count(s) for s in "#*$%&|<>")
        assert (rows[i]["n_words"], rows[i]["word_chars"], rows[i]["n_symbols"], rows[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), symbols, len(covered))
        assert rows[i]["base_failed"] == (len(w) < 50 or 2 * len(covered) > len(w))
    assert not rows[len(texts) - 1]["kept"] and rules.quality_rules(table(spark, [])).count() == 0
    assert [r["doc_id"] for r in rules.keep_good(clashing(table(spark, texts))).collect()] == [i for i in range(len(texts)) if rows[i]["kept"]]


def test_quality_classifier(spark):
    texts = [("fine words in many forms number%d here now and then " % i) * 3 if i % 2 else "bad bad bad bad !!! ### " * 8 for i in range(80)]
    docs = clashing(table(spark, [*texts, None, ""]))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in classifier.quality_scores(docs, labels).collect()}
    assert all(rows[i]["predicted"] == i % 2 for i in range(80)) and len(rows) == 82
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(82)) and 0 <= rows[80]["score"] == rows[81]["score"] <= 1
    assert classifier.quality_scores(docs, labels.limit(0)).first()["score"] == 0.5


def test_quality_classifier_on_held_out_documents(spark):
    import random

    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdklmnprst" for b in "aeiou" for c in ("n", "ra", "lo", "mi")]

    def text(good):
        noise = 0.06 if good else 0.22  # overlapping: some good texts are noisier than some bad ones
        return " ".join(rng.choice(["!!!", "##", "WIN", "x x x"]) if rng.random() < noise * rng.uniform(0.3, 1.7) else rng.choice(words) for _ in range(rng.randint(30, 150)))

    labels = [(i, int(rng.random() < 0.5), 0) for i in range(600)]
    docs = table(spark, [text(q) for _, q, _ in labels])
    scored = {r["doc_id"]: r for r in classifier.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [(scored[i]["score"], q) for i, q, _ in labels if scored[i]["held_out"]]
    good, bad = ([s for s, q in held if q == x] for x in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert len(held) > 150 and auc > 0.85


def test_archives(spark):
    rows = [(1, "http://a.b/x", "<p>" + "y" * 1200), (2, "https://c.d:443/q?r=1#f", "<p>" + "y" * 1200), (3, None, None), (4, "http://a.b/x", "a\r\n\r\nb"), (5, "u\tv\n", "a\r\n\r\nb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.write_and_read(pages).collect()}
    for i, _, html in rows:
        payload = (html or "").encode()
        assert got[i] == (len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if i == 1 else "response", 2 if i == 1 else None)
    assert warc.write_and_read(pages.limit(0)).count() == 0
    assert warc.url_key("https://u@A.b.com:8080/p?q#f") == "com,b,a:8080)/p?q"


def test_repeated_windows_at_every_length(spark):
    import random

    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(n)) for n in (1, 2, 3, 4, 5, 8, 13, 40, 300)]
    texts.append(" ".join(str(rng.randrange(30)) for _ in range(20_000)))
    got = {r["doc_id"]: r["n_repeat_words"] for r in rules.quality_rules(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        windows = Counter(zip(w, w[1:], w[2:]))
        assert got[i] == len({i + k for i in range(len(w) - 2) for k in range(3) if windows[tuple(w[i : i + 3])] > 1})


def test_pipeline_stages_on_odd_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    good = " ".join(f"{a}{b}{c} the" for a in "bdklm" for b in "aeiou" for c in ("n", "ra", "lo")) + "."
    rows = [(None, good, "en", "s", None), (5, good, None, None, 3), (5, good, None, None, 3), (6, None, "en", "s", 0), (7, "", "en", "s", 0), (8, good + "\n" + "tail " * 20_000, "en", "s", 1)]
    for docs in (spark.createDataFrame([], DOCS), clashing(spark.createDataFrame(rows, DOCS))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            assert {r["doc_id"] for r in out.collect()} <= {None, 5, 6, 7, 8}, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").where("doc_id = 5").count() == (2 if docs.count() else 0)


def test_pipeline_keeps_the_columns_of_documents(spark):
    import random

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(2)
    vocabulary = [f"{a}{b}{c}" for a in "bdklmnprst" for b in "aeiou" for c in ("n", "ra", "lo", "mi")]
    good = [" ".join(rng.choice(["the", "of", *rng.sample(vocabulary, 4)]) for _ in range(120)) + "." for _ in range(40)]
    docs = table(spark, [*good, good[0], None, "junk"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(40))
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()} == set(range(40))
