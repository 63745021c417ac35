"""Operators on documents against brute force, on tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flightgrid.llm import fm_decontam, golay_near, golay_simhash, induced_dedup, induced_sort, ngram_lm, pu_toxicity, registry, sentencepiece_bpe, template_lines
from flightgrid.llm._words import hash_text
from flightgrid.llm.induced_sort import suffix_order


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def spaced(s):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low(s)) if w]


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    words = [f"w{i}" for i in range(30)] + ["the", "of", "über", "naïve", "3rd", "É", "Ab,", "x."]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = " ".join(f"p{i}" for i in range(60))
    line = "licensed under version 2.0 of the usual terms by all"
    texts = [None, "", " ", "\n\n", "one", "Two words", "a  b\tc\x0bd", "<s>[INST]▁ \x00 \U0001f600"]
    texts += [say(r.randint(1, 80)) + "\n" + say(5) for _ in range(30)]
    texts += [f"{say(20)} {passage} {say(20)}" for _ in range(4)]
    texts += [f"{say(12)}\n{line.replace('2.0', f'{i}.0')}\n{say(12)}" for i in range(14)]
    texts += [texts[20]] * 5 + [texts[20] + " more"] + ["ab" * 900, "z" * 700, say(6000)]
    return list(enumerate(texts)) + [(5, "Two words"), (None, "no id at all")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_ngram_scores(spark, docs, rows):
    got = by_row(ngram_lm.digests(docs, least=2))
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    toks = [[*spaced(t), "</s>\n"] for _, t in rows]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for w, h in zip(toks, held, strict=True):
        if not h:
            x = ["<s>", *w]
            c1.update(w), c2.update(zip(x, w, strict=False)), c3.update(zip(x, w, w[1:], strict=False))
    n, v, d = sum(c1.values()), len(c1), 0.75
    total = lambda a: held.count(False) if a == "<s>" else c1[a]
    s2, s3 = defaultdict(float), defaultdict(float)
    for (a, _), c in c2.items():
        s2[a] += (c - d) / total(a) if c > 1 else 0
    for (a, b, _), c in c3.items():
        s3[a, b] += (c - d) / c2[a, b] if c > 1 else 0

    def log(x, i):
        w, a = x[i], x[i - 1]
        p = (c1[w] - d) / n if c1[w] else d * v / n
        if a == "<s>" or c1[a]:
            p = ((c2[a, w] - d) / total(a) if c2[a, w] > 1 else 0) + (1 - s2[a]) * p
            if i > 1 and c2[x[i - 2], a] > 1:
                b = (x[i - 2], a)
                p = ((c3[(*b, w)] - d) / c2[b] if c3[(*b, w)] > 1 else 0) + (1 - s3[b]) * p
        return math.log10(p)

    want = []
    for (i, _), h, w in zip(rows, held, toks, strict=True):
        x = ["<s>", *w]
        want.append((i, h, len(w), sum(c1[y] > 0 for y in w), n, sum(math.log10((c1[y] + 1) / (n + v + 1)) for y in w), sum(log(x, k) for k in range(1, len(x)))))
    want.sort(key=repr)
    key = lambda r: (repr(r[0]), r[2], round(r[5], 3))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=2e-3, abs=0.02)
    # The heavy contexts' way gives the same model.
    assert any(len(x.heavy) for x in ngram_lm.train(docs).levels[1:])


def test_ngram_query_counts_what_occurs_once(spark, tmp_path):
    texts = ["a b c d", "a b c e", "a b f", "", "b c d g h", "x y z"]
    rows = [(i, texts[i % 6]) for i in range(12) if i % 6 != 5 or i == 5]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    toks = [["<s>", *t.split(), "</s>\n"] for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c1 = Counter(w for x in toks for w in x[1:])
    c2 = Counter(p for x in toks for p in zip(x, x[1:], strict=False))
    c3 = Counter(p for x in toks for p in zip(x, x[1:], x[2:], strict=False))
    assert 1 in c2.values() and 1 in c3.values()
    n, v, d = sum(c1.values()), len(c1), 0.75

    def log(x, k):
        w, p = x[k], (c1[x[k]] - d) / n if c1[x[k]] else d * v / n
        for counts, context in ((c2, (x[k - 1],)), (c3, (x[k - 2], x[k - 1]) if k > 1 else None)):
            after = {g[-1]: c for g, c in counts.items() if g[:-1] == context}
            if after:
                total = sum(after.values())
                p = max(after.get(w, 0) - d, 0) / total + d * len(after) / total * p
        return math.log10(p)

    got = {x.doc_id: x.score for x in registry.op1_ngram_lm(spark, str(tmp_path)).collect()}
    for i, t in rows:
        x = ["<s>", *t.split(), "</s>\n"]
        assert got[i] == pytest.approx(sum(log(x, k) for k in range(1, len(x))), rel=2e-3, abs=0.02)


def test_ngram_odd_tables(spark):
    """No rows, no training rows, and columns named like the results."""
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_lm.digests(none).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    x = ngram_lm.digests(spark.createDataFrame([(held, "a b")], none.schema)).first()
    assert x.held_out and (x.n_tokens, x.n_known, x.train_tokens) == (3, 0, 0) and x.base_score == x.score == 0
    docs = spark.createDataFrame([(1, "a b", "u", 2), (2, None, "v", 3)], "doc_id long, text string, score string, extra long")
    got = ngram_lm.score(docs, ngram_lm.train(docs))
    assert got.columns == ["doc_id", "extra", "n_tokens", "n_known", "base_score", "score"]
    assert {(r.doc_id, r.extra, r.n_tokens) for r in got.collect()} == {(1, 2, 3), (2, 3, 1)}


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((1, 5), (3000, 3000), (3000, 1 << 62), (70_000, 1 << 33)):
        v = np.sort(r.choice(top, n, replace=False)) if top < 1 << 20 else np.unique(r.integers(0, top, n))
        ef = ngram_lm._ef(ngram_lm.unpack(np.frombuffer(ngram_lm.pack(x=ngram_lm.ef_encode(v, top)), np.uint8)), "x")
        assert (ef.find(v) == np.arange(len(v))).all()
        q = r.integers(0, top, 500)
        assert ((ef.find(q) >= 0) == np.isin(q, v)).all()


def test_toxicity_learns_and_handles_odd_rows(spark, rows):
    r = random.Random(3)
    made = [(i, " ".join(r.choices(["sun", "rain", "road", "tree", "house"], k=30)) + (" vile" if i % 5 == 0 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 600, 2)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([*made, (1000, None), (1001, ""), (None, "vile")], "doc_id long, text string")
    got = pu_toxicity.digests(docs, labels).collect()
    assert len(got) == 603
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.3)
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2)
        if x.doc_id is not None and x.doc_id < 600:
            assert x.predicted == (x.doc_id % 5 == 0)
    # The scores by brute force, of the model that the same rows give.
    model = pu_toxicity.fit(docs, labels, pu_toxicity.is_held_out(F.col("doc_id")))
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    text = {i: t for i, t in [*made, (1000, None), (1001, ""), (None, "vile")]}
    for x in got:
        words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text[x.doc_id])))
        z = model.bias + sum(weight.get(hash_text(w), 0.0) for w in words)
        assert x.score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)
    none = pu_toxicity.digests(docs.limit(0), labels)
    assert none.count() == 0 and none.columns == ["doc_id", "held_out", "score", "predicted"]
    assert pu_toxicity.digests(docs, labels.limit(0)).count() == 603
    kept = pu_toxicity.keep_clean(docs.selectExpr("*", "1 as score", "2 as __x"), labels)
    assert kept.columns == ["doc_id", "text", "score", "__x"]
    assert kept.where("doc_id % 5 = 0 and doc_id < 600").count() == 0


def test_nnpu_stays_non_negative():
    r = np.random.default_rng(0)
    noise = lambda: np.unique(r.integers(100, 4000, 40)).astype(np.uint64)
    p = [np.append(noise(), np.uint64(5)) for _ in range(60)]
    u = [np.append(noise(), np.uint64(5)) if i % 10 == 0 else noise() for i in range(400)]
    m = pu_toxicity.train(p, u, 0.1)
    s = m.score(np.array([5, 200], np.uint64), np.array([0, 1]), 2)
    assert s[0] > 0.5 > 0.3 > s[1]


def test_sentencepiece(spark, docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    want = []
    for i, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids).encode())))
    assert by_row(sentencepiece_bpe.round_trip_digests(docs)) == sorted(want, key=repr)
    got = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs.selectExpr("*", "9 as extra")))
    assert got.columns == ["doc_id", "text", "extra", "ids", "decoded"]
    for x in got.collect():
        ids = sp.encode(x.text or "", add_bos=True, add_eos=True)
        assert x.ids == ids and x.decoded == sp.decode(ids)
    assert sentencepiece_bpe.round_trip_digests(docs.limit(0)).count() == 0


def test_sentencepiece_random_texts_and_ids():
    import sentencepiece

    with open(sentencepiece_bpe.default_model(), "rb") as f:
        bpe = sentencepiece_bpe.Bpe(f.read())
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    r = random.Random(5)
    texts = ["".join(r.choice(a) for _ in range(r.randint(0, 40))) for a in ("ab", "aeth n", "\n\t ▁ab", "éàçñ ßü", "一二 a☃", "01 .,-") for _ in range(300)]
    bpe.prepare(texts)
    for t in texts:
        ids = bpe.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t, add_bos=True, add_eos=True)
    for _ in range(500):
        ids = [r.randrange(32000) for _ in range(r.randint(0, 9))] if r.random() < 0.5 else [r.randrange(0, 260) for _ in range(6)]
        assert bpe.decode(np.array(ids, "<u4").tobytes()).decode() == sp.decode(ids)


def keys_of(line):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
    n = len(w)
    if n < 4:
        return []
    w = ["*" if re.search("[0-9]", x) else x for x in w]
    if 2 * w.count("*") > n:
        return []
    more = [(n, p, *(x if j < 2 or j * 5 // n != p else None for j, x in enumerate(w))) for p in range(5)] if n >= 10 else []
    return [(n, -1, *w), *more]


def test_line_templates(spark, docs, rows):
    big = 2**63 - 1
    seen = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        for key in {key for x in (t or "").split("\n") for key in keys_of(x)}:
            seen[key].append((big if i is None else i, k))
    first = {k: min(v)[0] for k, v in seen.items() if len(v) >= 10}
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not any(first.get(k, big) < (big if i is None else i) for k in keys_of(x))]
        want.append((i, 0 if t is None else len(lines), 0 if t is None else len(lines) - len(left), sha("\n".join(left).encode())))
    assert sum(w[2] for w in want) >= 13
    assert by_row(template_lines.digests(docs)) == sorted(want, key=repr)
    assert by_row(template_lines.digests(docs.repartition(7))) == sorted(want, key=repr)  # other slices
    assert {tuple(x) for x in template_lines.recurring(docs).select("docs", "first").collect()} == {(len(v), min(v)[0]) for v in seen.values() if len(v) >= 10}
    kept = template_lines.drop_recurring(docs.selectExpr("doc_id", "text", "length(text) as n_chars", "1 as template", "2 as id"))
    assert kept.columns == ["doc_id", "text", "n_chars", "template", "id"] and kept.count() == len(rows)
    assert kept.where("n_chars <> length(text)").count() == 0
    assert template_lines.digests(docs.limit(0)).count() == 0


def test_passages_of_two_documents(spark):
    r = random.Random(11)
    say = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    passages = [say(n) for n in (50, 60, 120)]
    short, long = say(30), say(70)
    texts = []
    for k, p in enumerate(passages):  # within lines, and across a line break
        texts += [f"{say(20)} {p} {say(20)}", f"{say(9 + k)}\n{p.replace(' ', chr(10), 1)} {say(25)}"]
    texts += [f"{say(5)}\n{long}", f"{say(5)}\n{long}", f"{say(5)}\n{short}", f"{say(5)}\n{short}", say(200)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = [x.text for x in template_lines.drop_recurring(docs).orderBy("doc_id").collect()]
    for k, p in enumerate(passages):
        assert got[2 * k] == texts[2 * k]
        left, was = set(got[2 * k + 1].split()), set(texts[2 * k + 1].split())
        assert was - set(p.split()) <= left and len(left & set(p.split())) <= 20
    assert got[6] == texts[6] and got[7] == texts[7].split("\n")[0]
    assert got[8:] == texts[8:]
    a = template_lines.dedup(docs.repartition(5, "doc_id"), passage=50)
    assert by_row(a) == by_row(template_lines.dedup(docs.coalesce(1), passage=50))


def test_line_ids_and_names(spark):
    """Repeated ids with other texts, null ids, ids as strings, and columns with names used inside."""
    long = " ".join(f"a{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(4, f"x\n{long}"), (4, long), (4, "kept line of five words"), (None, f"{long}\ny"), (9, f"{long}"), (9, f"z z\n{long}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as __id", "2 as __row", "3 as place", "4 as rest", "5 as key", "6 as __places")
    got = template_lines.dedup(df, passage=50)
    assert got.columns == [*df.columns, "lines"]
    assert sorted((str(r.doc_id), r.lines.kept) for r in got.collect()) == sorted([("4", f"x\n{long}"), ("4", long), ("4", "kept line of five words"), ("None", "y"), ("9", ""), ("9", "z z")])
    assert by_row(template_lines.dedup(df.withColumn("doc_id", df.doc_id.cast("string")), passage=50).select("lines.kept")) == by_row(got.select("lines.kept"))


def fingerprint(t):
    w = spaced(t)
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash(spark, docs, rows):
    prints = [fingerprint(t) for _, t in rows]
    kinds = sorted(set(prints))
    root = {f: f for f in kinds}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    want = [(i, f"{f:016x}", least.get(find(f))) for (i, _), f in zip(rows, prints, strict=True)]
    assert by_row(golay_simhash.digests(docs)) == sorted(want, key=repr)
    assert golay_simhash.digests(docs.limit(0)).count() == 0
    kept = golay_simhash.keep_one(docs.selectExpr("*", "1 as simhash", "2 as component_id"))
    assert kept.columns == ["doc_id", "text", "simhash", "component_id"]
    assert {r.doc_id for r in kept.collect()} == {*least.values(), None}  # the row without an id is a class of its own


def test_simhash_null_ids_and_names(spark):
    rows = [(None, "one two three"), (3, "one two three"), (None, "quite another text here"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "8 as component_id", "9 as simhash")
    got = golay_simhash.components(docs)
    assert got.columns == ["doc_id", "simhash", "component_id"]
    assert sorted((x.component_id for x in got.collect()), key=repr) == [3, 3, 7, None]
    kept = golay_simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(x) for x in kept.collect()), key=repr) == [(3, "one two three", 8, 9), (7, None, 8, 9), (None, "quite another text here", 8, 9)]


def test_near_copies_of_null_and_digits(spark):
    docs = spark.createDataFrame([(5, None), (None, "5"), (3, None)], "doc_id long, text string")
    assert sorted((x.doc_id for x in golay_near.keep_one(docs).collect()), key=repr) == [3, None]


def test_near_copies_with_a_hot_passage(spark):
    """Texts that share a passage, which is hot, and pairs among them that are near."""
    r = random.Random(12)
    say = lambda n: ["".join(r.choices("abcdefgh", k=6)) for _ in range(n)]
    passage = say(30)
    texts = []
    for _ in range(30):
        own = say(60)
        texts.append(" ".join(own[:20] + passage + own[20:]))
    texts += [t.replace(" ", "  ", 1) + " " + " ".join(say(10)) for t in texts[:5]] + [" ".join(passage), " ".join(passage + say(4))]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    want = near_classes(texts)
    assert len(want) == 31
    for hot in (5, 1000):
        assert sorted(x.doc_id for x in golay_near.keep_one(docs, hot=hot).collect()) == want


def test_near_copies(spark):
    r = random.Random(6)
    vocabulary = ["".join(r.choices("abcdefgh", k=5)) for _ in range(2000)]
    base = [[r.choice(vocabulary) for _ in range(300)] for _ in range(30)]
    texts = [" ".join(w) for w in base]
    for w in base[:20]:  # one to three words changed: similarity 0.9 or more
        for n in range(1, 4):
            c = list(w)
            for at in r.sample(range(300), n):
                c[at] = r.choice(vocabulary)
            texts.append(" ".join(c).upper())
    for w in base[20:]:  # a half shared: similarity a third
        texts.append(" ".join(w[:150] + [r.choice(vocabulary) for _ in range(150)]))
    n = len(texts)
    rows = [*enumerate(texts), (n, texts[0]), (5, texts[5]), (n + 1, None), (n + 2, ""), (n + 3, " "), (None, "alone here"), (n + 4, "Two words"), (n + 5, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as f", "2 as row", "3 as id")
    kept = golay_near.keep_one(docs)
    assert kept.columns == docs.columns
    want = [*range(30), 5, *range(90, 100), n + 1, n + 4, None]
    assert sorted((x.doc_id for x in kept.collect()), key=repr) == sorted(want, key=repr)
    assert by_row(golay_near.keep_one(docs, small=1)) == by_row(kept)
    assert golay_near.keep_one(docs.limit(0)).count() == 0


def near_classes(texts, width=5, least=0.8):
    """The first text of each class, by brute force."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            if min(len(sets[i]), len(sets[j])) >= least * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [i for i in range(len(texts)) if find(i) == i]


def test_near_copies_at_the_threshold(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdefgh", k=5)) for _ in range(2000)]
    texts = []
    for n in [*range(5, 16)] * 4:  # short texts, and the same with a word more
        w = r.choices(vocabulary, k=n)
        texts += [" ".join(w), " ".join([*w, r.choice(vocabulary)])]
    for _ in range(60):  # similarity 0.80 to 0.85, by words put at the end
        w = r.choices(vocabulary, k=204)
        texts += [" ".join(w), " ".join(w + r.choices(vocabulary, k=r.randint(36, 50)))]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    want = near_classes(texts)
    assert 104 < len(want) < 160
    assert sorted(x.doc_id for x in golay_near.keep_one(docs).collect()) == want


def chained_variants():
    """300 texts of which each is near to its neighbours only, in a mixed order."""
    r = random.Random(9)
    vocabulary = ["".join(r.choices("abcdefgh", k=5)) for _ in range(2000)]
    words = r.choices(vocabulary, k=204 + 299 * 20)
    texts = [" ".join(words[i * 20 : i * 20 + 204]) for i in range(300)]
    r.shuffle(texts)
    return texts


def test_near_copies_in_large_buckets(spark):
    texts = chained_variants()
    assert near_classes(texts) == [0]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert [x.doc_id for x in golay_near.keep_one(docs, small=1).collect()] == [0]


def test_golay_keys_cover_two_errors():
    r = random.Random(2)
    for _ in range(400):
        w = r.randrange(1 << 23)
        e = w ^ (1 << r.randrange(23)) ^ (1 << r.randrange(23))
        a, b = (set(golay_simhash.codewords(np.array([x]))[0].tolist()) - {-1} for x in (w, e))
        assert a & b and len(a) in (1, 6)


def test_links_and_long_chains(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    chain = [base[0]]
    for b in range(60):
        chain.append(chain[-1] ^ (1 << b))
    values = sorted({x - (1 << 64) if x >> 63 else x for x in [*base, *chain, *(b ^ 5 for b in base)]})
    nodes = spark.createDataFrame([(v,) for v in values], "f long")
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    got = golay_simhash.links(nodes)
    assert {tuple(x) for x in got.collect()} == want
    roots = {x.node: x.root for x in golay_simhash.connected(nodes, got).collect()}
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a, b in want:
            m = min(root[a], root[b])
            changed |= (root[a], root[b]) != (m, m)
            root[a] = root[b] = m
    assert roots == root


def test_induced_sort_random():
    r = random.Random(0)
    for _ in range(400):
        t = [r.randint(1, r.choice([1, 2, 5])) for _ in range(r.randint(0, 50))] + [0]
        sa, shared = suffix_order(np.array(t), 100, memory=r.choice([3, 1000]))
        order = sorted(range(len(t)), key=lambda i: t[i:])
        assert sa.tolist() == order
        for j in range(1, len(t)):
            a, b = t[order[j - 1] :], t[order[j] :]
            assert shared[j] == next((d for d in range(min(len(a), len(b))) if a[d] != b[d]), min(len(a), len(b)))


@pytest.mark.parametrize("few", [1, 64, 10**9])
def test_induced_sort_batches(monkeypatch, few):
    monkeypatch.setattr(induced_sort, "FEW", few)
    r = random.Random(few)
    for _ in range(120):
        monkeypatch.setattr(induced_sort, "BATCH", r.choice([1, 7, 1 << 16]))
        core = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(1, 150))]
        t = core + core[: r.randint(0, 99)] + [1] * r.randint(0, 30) + core + [0]
        sa, shared = suffix_order(np.array(t), most := r.choice([1, 5, 100]), memory=r.choice([3, 20, 1000]))
        order = sorted(range(len(t)), key=lambda i: t[i:])
        assert sa.tolist() == order
        for j in range(1, len(t)):
            a, b = t[order[j - 1] :], t[order[j] :]
            assert shared[j] == next((d for d in range(min(len(a), len(b), most)) if a[d] != b[d]), min(len(a), len(b), most))


def test_suffix_dedup(spark, docs, rows):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    want = []
    for (i, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want.append((i, len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), sha(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]))))
    want.sort(key=repr)
    assert sum(w[2] for w in want) > 2000
    assert by_row(induced_dedup.digests(docs)) == want
    # Joins instead of broadcasts, many small shards, queues on disk.
    assert by_row(induced_dedup.dedup(docs, digest=True, most=0, shard_bytes=500, memory=50)) == want
    assert induced_dedup.digests(docs.limit(0)).count() == 0
    named = induced_dedup.dedup(docs.selectExpr("*", "1 as row", "2 as spans", "3 as n_bytes", "4 as doc"))
    assert named.columns == ["doc_id", "text", "row", "spans", "doc", "n_bytes", "n_removed", "n_spans", "kept"]
    assert named.where("row = 1 and spans = 2 and doc = 4").count() == len(rows)
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert (induced_dedup._places(h, 7, 10) == [i + int(np.argmin(h[i : i + 7] >> np.uint64(10))) for i in range(len(h) - 6)]).all()


def test_decontamination(spark, docs, rows):
    items = [("9", " ".join(f"P{i}" for i in range(5, 40))), ("10", "one"), ("11", None), ("12", "..."), ("13", rows[12][1]), ("14", rows[12][1]), (None, "Two words")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))
    windows = defaultdict(set)
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])] |= {name} - {None}
    want = []
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for x, owners in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    names |= owners
        want.append((i, len(w), len(hit), len(names), sha(",".join(sorted(names)).encode()), len(hit) > 0 and 20 * len(hit) >= len(w)))
    want.sort(key=repr)
    assert sum(x[5] for x in want) >= 5
    assert by_row(fm_decontam.digests(docs, benchmark)) == want
    split = fm_decontam.find_contamination(docs, benchmark, block_words=3)
    assert by_row(split) == by_row(fm_decontam.find_contamination(docs, benchmark))
    kept = fm_decontam.decontaminate(docs.selectExpr("*", "1 as found", "2 as n_hit"), benchmark)
    assert kept.columns == ["doc_id", "text", "found", "n_hit"] and kept.count() == sum(not x[5] for x in want)
    assert fm_decontam.digests(docs.limit(0), benchmark).count() == 0
    assert fm_decontam.digests(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
