"""Chat formatting, WARC archives, nearest neighbours, and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flightgrid.llm import chat_format, vp_search, warc

TURNS = [
    (1, 0, "user", "hi <|end|> there"),
    (1, 1, "assistant", "\\<s> yes\\\\ [INST] é\U0001f600"),
    (1, 2, None, None),
    (1, 2, "assistant", ""),
    (2, None, "assistant", "first\nlines"),
    (2, 0, "<|text|>", "<<|turn|>"),
    (None, 0, "user", "no id"),
    (3, 0, "user", "same"),
    (3, 0, "user", "same"),
]


def test_chat_digests(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.with_control_case(df)).collect()}
    rows = [*TURNS, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        x = got[key]
        assert x.n_turns == len(own)
        assert x.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = chat_format.format_turns(df.where("conv_id = 1")).first()
    assert all(one.formatted.count(s) == 4 for s in (chat_format.START, chat_format.SEP, chat_format.END)) and "<s>" not in one.formatted
    assert chat_format.digests(df.limit(0)).count() == 0


def test_layouts(spark):
    listed = spark.createDataFrame([(4, [("user", "a"), ("assistant", "b")])], "id long, messages array<struct<role:string,content:string>>")
    rows = [tuple(r) for r in chat_format.canonical_turns(listed, "id").collect()]
    assert rows == [(4, 0, "user", "a"), (4, 1, "assistant", "b")]
    asked = spark.createDataFrame([(5, "do", "this", "done"), (6, "do", None, None)], "id long, instruction string, input string, output string")
    assert {tuple(r) for r in chat_format.canonical_turns(asked, "id").collect()} == {(5, 0, "user", "do\n\nthis"), (5, 1, "assistant", "done"), (6, 0, "user", "do"), (6, 1, "assistant", None)}
    json = spark.createDataFrame(
        [(1, '{"prompt": "p", "response": "r"}'), (2, '{"conversations": [{"from": "human", "value": "v"}]}'), (3, '{"other": 1}'), (4, "not json"), (5, None), (6, '{"question": null, "answer": "a"}')],
        "id long, j string",
    )
    got = {r.conv_id: r for r in chat_format.canonical_json(json, "id", "j").collect()}
    assert got[1].layout == "prompt and response" and [tuple(t) for t in got[1].turns] == [("user", "p"), ("assistant", "r")]
    assert [tuple(t) for t in got[2].turns] == [("user", "v")]
    trained = spark.createDataFrame([(8, [("human", "ask"), ("gpt", "reply"), ("narrator", "so")])], "id long, conversations array<struct<from:string,value:string>>")
    assert chat_format.digests(chat_format.canonical_turns(trained, "id")).first().loss_chars == 5
    assert all(got[k].turns is None for k in (3, 4, 5))
    assert [tuple(t) for t in got[6].turns] == [("user", None), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat_format.canonical_turns(spark.range(1))


def test_warc_round_trip(spark, tmp_path):
    same, small = "x" * 150, "y" * 99
    rows = [(5, "http://a/\r\nX: 1", same), (3, None, same), (9, "http://b", same), (1, "u", small), (2, "u", small), (4, "u", None), (6, "u", ""), (7, "u", "é" * 60), (8, "u", "é" * 60), (7, "u", "é" * 60), (None, "n", same)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages, folder, roll=400)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 2
    names = {r.file for r in manifest.collect()}
    assert {p.name for p in (tmp_path / "w").iterdir()} - {"manifest"} == names
    for r in manifest.collect():
        raw = (tmp_path / "w" / r.file).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (r.bytes, r.sha256)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read(spark, folder).collect()}
    want = set()
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min(k for k, _, o in rows if (o or "") == (h or "") and k is not None)
        back = len(raw) >= 100 and i is not None and first != i
        want.add((i, "revisit" if back else "response", first if back else None, len(raw), hashlib.sha256(raw).hexdigest()))
    assert got == want
    assert warc.digests(pages).where("page_id is null and record_type = 'response'").count() == 1
    full = {r.page_id: r.payload for r in warc.read(spark, folder, payloads=True).where("record_type = 'response'").collect()}
    assert bytes(full[3]) == same.encode() and bytes(full[4]) == b""
    assert warc.digests(pages.limit(0)).count() == 0
    # The same rows in another order give the same files.
    warc.write(pages.orderBy(F.desc("page_id")).coalesce(1), f"file://{tmp_path}/v", roll=400, most=0)
    key = lambda d: sorted((p.name, p.read_bytes()) for p in (tmp_path / d).iterdir() if p.is_file())
    assert key("w") == key("v")
    many = spark.range(5000).selectExpr("id * id as page_id", "'u' as url", "repeat(md5(string(id)), 3) as html")
    for name, layout in (("x", many.repartition(9)), ("y", many.orderBy(F.desc("page_id")).coalesce(1))):
        warc.write(layout, f"file://{tmp_path}/{name}", roll=100_000)
    assert len(key("x")) > 4 and key("x") == key("y")


def test_nearest(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 8)).astype(np.float32)
    x[100:140] = x[7]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(2000, None), (2050, []), (2100, [0.0] * 8), (2150, [1.0, None] + [0.0] * 6), (2200, [float("nan")] * 8), (2250, [1.0, 2.0]), (50, rows[50][1])]
    df = spark.createDataFrame([(*t, 1.0) for t in rows], "vec_id long, embedding array<float>, score double")
    fine = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    want = []
    for q, a in fine[:-1]:  # the last is a repeat of 50
        if q % 50 == 0 and len(a) == 8:
            s = sorted((-float(a @ b) / np.sqrt((a @ a) * (b @ b)), i) for i, b in fine if i != q and len(b) == 8)
            want.append((q, [round(-t, 12) for t, _ in s[:5]]))
    for shard in (32_768, 300):
        got = {}
        for g in vp_search.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=shard, block_rows=7).collect():
            got.setdefault(g.query_id, []).append((g.rank, g.vec_id, round(g.score, 12)))
        assert set(got) == {q for q, _ in want}
        for q, s in want:
            own = sorted(got[q])
            assert [g[0] for g in own] == [1, 2, 3, 4, 5] and [g[2] for g in own] == pytest.approx(s, abs=1e-9)
        assert [g[1] for g in sorted(got[100])] == [7, 101, 102, 103, 104]
    apart = spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])], "vec_id long, embedding array<float>")
    assert [(g.query_id, g.rank, g.vec_id) for g in vp_search.digests(apart).orderBy("query_id", "rank", "vec_id").collect()] == [(50, 1, 1), (50, 1, 2), (50, 2, 1), (50, 2, 2)]
    loose = vp_search.nearest(df, df.where("vec_id % 50 = 0"), factor=0.6)
    assert loose.count() <= vp_search.nearest(df, df.where("vec_id % 50 = 0")).count()
    assert vp_search.digests(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    clean = [say(80) for _ in range(60)]
    item = say(40)
    texts = clean + [say(70) + " vile" for _ in range(40)] + [clean[0]] * 3 + [item + " " + say(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 100)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in got} == set(range(60))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "tokenisation"]
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert f(spark, docs.limit(0), str(tmp_path)).count() == 0
