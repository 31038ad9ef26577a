"""The corpus pipeline on small tables with nulls, repeated rows, clashing names, and none at all."""

import hashlib

import numpy as np

import corpus_pipeline
from cohortmill.llm import bpe, common, simhash


def write(spark, path, rows, labels):
    kind = "doc_id long, text string, lang string, source string, n_chars long, total long, `__x` string"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(200):
        t = list(rng.choice(words, 40))
        if i % 5 == 0:
            t[3:6] = ["grumblefish"] * 3
        rows.append((i, " ".join(t), "en", f"s{i % 3}", 1, 2, "x"))
        labels.append((i, 1, int(i % 5 == 0)))
    clean = [r for r in rows if r[0] % 5]
    rows += [(500 + i, r[1], "en", "s0", 1, 2, "x") for i, r in enumerate(clean[:10])]  # exact copies
    rows += [(600 + i, r[1] + " Tail", "en", None, 1, 2, "x") for i, r in enumerate(clean[10:15])]  # near copies
    rows += [(None, None, None, None, None, None, None), (None, "", "en", "s1", 1, 2, "x"), (1, rows[1][1], "en", "s1", 1, 2, "x"), (None, clean[20][1], "en", "s1", 1, 2, "x")]
    write(spark, str(tmp_path), rows, labels)
    docs, kept = common.table(spark, str(tmp_path), "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.save(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns
        docs = out
        kept.append(out.collect())
    toxic, exact, near, mixed = kept
    assert not any("grumblefish" in (r.text or "") for r in toxic) and sum(r.doc_id is not None and r.doc_id < 200 for r in toxic) >= 155
    assert sorted(r.text or "" for r in exact) == sorted({r.text or "" for r in toxic})  # one row of every text
    assert all(max((x.doc_id for x in toxic if x.text == r.text and x.doc_id is not None), default=None) == r.doc_id for r in exact if r.text)
    prints = [simhash.fingerprint(r.text) for r in near]
    assert all(bin(a ^ b).count("1") > 3 for i, a in enumerate(prints) for b in prints[:i]) and len(near) < len(exact)
    assert {r.text for r in mixed} <= {r.text for r in near} and all(sum(x == r for x in mixed) <= 3 for r in near)
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    enc = bpe.encoder(bpe.vocabulary())
    want = sorted(hashlib.sha256(",".join(map(str, enc.encode([r.text])[0].tolist())).encode()).hexdigest() for r in mixed)
    assert sorted(r.ids_sha256 for r in last) == want


def test_pipeline_of_nothing(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
