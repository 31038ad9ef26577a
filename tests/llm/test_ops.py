"""The training-data operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from cohortmill.llm import bpe, cuckoo, embeddings, licences, mixing, pages, secrets, simhash, tokens_out, toxicity

TEXTS = [
    None, "", " \n\t ", "One two three four five six", "one TWO three four five six", "One two three four five six", "a", "a b", "x" * 5000, "token=abc12345 and AKIA" + "Z9" * 8,
    "café voilà  \n x's !'s <|endoftext|> done", "deadbeef" * 4 + " " + "Released under the MIT License.", "中文 \U0001f642 " * 40,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", "extra") for i, t in enumerate(TEXTS)] + [(None, "a b", None, "s1", None), (3, TEXTS[3], "en", "s0", "extra")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp string").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def test_bpe(docs, empty, tokenizer):
    for r in bpe.digests(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.digests(empty).count() == 0


def test_bpe_random(tokenizer):
    rng = np.random.default_rng(5)
    alphabet = list("ab's'tre ll  \n\t!?,. 　éàß9١²'AZ_-=/\"#中́\x85\x1c") + ["<|endoftext|>", "\U0001f642"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(3000)]
    enc = bpe.encoder(bpe.vocabulary())
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert got.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
        assert enc.decode(got) == t


def test_token_files(docs, empty, tokenizer):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    start = 0
    for r in sorted(tokens_out.read_shards(tokens_out.write_shards(rows)).collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, list(r.ids)) == (start, len(ids), ids)
        start += len(ids)
    assert tokens_out.read_shards(tokens_out.write_shards(empty)).count() == 0


def test_token_query(spark, tmp_path, docs, tokenizer, monkeypatch):
    monkeypatch.setattr(tokens_out, "SHARD_IDS", 40)
    monkeypatch.setattr(tokens_out, "RANGE_BYTES", 700)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = tokens_out.op9_token_output(spark, str(tmp_path)).collect()
    want = sorted((tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()), key=len)
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in want)
    rows = sorted(got, key=lambda r: r.start)  # null ids first, then ascending; nothing lies between
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]


def test_grammar_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 2, 500, 20_000):
        counts = rng.integers(1, 40, n)
        ids = rng.choice([5, 5, 5, 6, 7, 50_000], int(counts.sum())).astype(np.uint32)
        s = tokens_out.Shard(tokens_out.compress(ids, counts, 50_257))
        assert (s.ids(0, n) == ids).all() and (s.ids(n - 1, n) == ids[-counts[-1] :]).all()
        assert n < 500 or len(s.seq) < len(ids) / 2


def test_exact(docs, empty):
    got = {(r.doc_id, r.text_sha256): r for r in cuckoo.exact_groups(docs).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got[0, sha("")].keep_id == 1 and got[1, sha("")].kept and got[1, sha("")].group_size == 2
    assert (got[3, sha(TEXTS[3])].keep_id, got[3, sha(TEXTS[3])].group_size) == (5, 3)
    assert got[None, sha("a b")].keep_id == 7 and not got[None, sha("a b")].kept
    assert cuckoo.exact_groups(empty).count() == 0
    kept = cuckoo.keep_last(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 4, 5, *range(6, len(TEXTS))]


def test_stages_decide_by_row(spark):
    rows = [(None, "no id here at all", 0), (None, "no id here at all", 1), (4, "given twice with one text", 2), (4, "given twice with one text", 3)]
    rows += [(5, "a copied text of some words", 4), (5, "an unlike text under that same id", 5), (6, "a copied text of some words", 6), (None, "a copied text of some words", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for stage, left in ((cuckoo.keep_last, 6), (simhash.keep_first, 4)):
        got = stage(df)
        assert got.columns == df.columns
        n = sorted(r.n for r in got.collect())
        assert len(n) == 4 and len({0, 1} & set(n)) == 1 and len({2, 3} & set(n)) == 1 and set(n) - {0, 1, 2, 3} == {5, left}


def test_cuckoo_grows_and_deletes():
    live = cuckoo.LiveIndex(16)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        live.add(k, i, 1)
    assert live.rebuilt > 0 and all(live.get(k) == (i, 1) for i, k in enumerate(keys))
    assert all(live.delete(k) for k in keys[::2]) and not live.delete(keys[0])
    assert len(live) == 1500 and all(live.maybe(k) for k in keys[1::2])
    assert sum(live.maybe(hashlib.sha256(b"x%d" % i).digest()) for i in range(3000)) < 10  # false hits are rare
    # two keys of one mark and bucket are told apart by their content
    twin = keys[1][:16] + bytes(16)
    live.add(twin, 77, 5)
    again = cuckoo.LiveIndex.from_bytes(live.to_bytes())
    for x in (live, again):
        assert all(x.get(k) is None for k in keys[::2]) and all(x.get(k) == (i, 1) for i, k in enumerate(keys) if i % 2) and x.get(twin) == (77, 5)
    again.add(keys[0], None, 2)
    assert again.get(keys[0]) == (None, 2) and again.delete(twin) and again.get(keys[1]) == (1, 1)


def test_index_outlives_its_session(spark):
    def rows(pairs):
        return spark.createDataFrame([(bytearray(hashlib.sha256(t.encode()).digest()), i) for t, i in pairs], "digest binary, doc_id long")

    index = cuckoo.build(rows([("a", 1), ("a", 4), ("b", 2), ("c", None)]))
    index = cuckoo.delete(cuckoo.insert(index, rows([("b", 9), ("d", 3)])), rows([("a", 0), ("x", 0)]).select("digest"))
    path = index.inputFiles()[0].rsplit("/", 1)[0]
    index = spark.read.parquet(path)  # as another session would
    got = [(r.live, r.keep_id, r.group_size) for t in "abcdx" for r in cuckoo.look_up(index, rows([(t, 0)]).select("digest")).collect()]
    assert got == [(False, None, None), (True, 9, 2), (True, None, 1), (True, 3, 1), (False, None, None)]
    again = {bytes(r.digest): (r.keep_id, r.group_size) for r in cuckoo.entries(cuckoo.insert(index, rows([("a", 2)]))).collect()}
    assert again[hashlib.sha256(b"a").digest()] == (2, 1) and len(again) == 4


def brute_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(simhash.LOWER))
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, empty, spark):
    for r in simhash.fingerprints(docs.where("doc_id is not null")).collect():
        assert r.fp % (1 << 64) == brute_fingerprint(TEXTS[r.doc_id])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got[0] == got[1] == got[2] == 0 and got[3] == got[4] == got[5] == 3 and got[7] == 7
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("cell", [8192, 16])
def test_links_by_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 40, np.uint64)
    fps = []
    for b in base:
        for _ in range(30):
            x = int(b)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    want = np.arange(len(f))
    while (now := np.array([want[near[i]].min() for i in range(len(f))])).tolist() != want.tolist():
        want = now
    rows = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x, i) for i, x in enumerate(fps)], "fp long, node long")
    got = {r.node: r.root for r in simhash.link_fingerprints(rows).collect()}
    assert [got.get(i, i) for i in range(len(f))] == want.tolist()


@pytest.mark.parametrize("cell", [4096, 32])
def test_embeddings(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings, "CELL", cell)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 64))
    x[100:200] = x[0] + rng.standard_normal((100, 64)) * 0.16
    x[250] = x[251]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [None] * 64), (905, [1.0, 2.0])]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert [got[i].n_links for i in range(300)] == (near.sum(1) - 1).tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 906))
    assert got[251].component_id == 250 and not got[251].kept


@pytest.mark.parametrize("k", [32, 100, 300])
def test_lone_pairs_share_a_filter(k):
    rng = np.random.default_rng(6)
    x, z = embeddings._unit(rng.standard_normal((3000, 64))), rng.standard_normal((3000, 64))
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * embeddings._unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    code = embeddings.ProductCode(64, k)
    (ra, fa), (rb, fb) = code.filters(x), code.filters(y)
    a, b = ra * 10**9 + fa, rb * 10**9 + fb
    assert len(np.unique(np.intersect1d(a, b) // 10**9)) >= 2997
    assert abs(len(ra) / 3000 / len(code.codes) / embeddings.LISTED - 1) < 0.15


def test_mixing(docs, empty):
    rows = mixing.measured(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    from pyspark.sql import functions as F

    narrow = rows.select("doc_id", F.col("__sk").alias("sk"), F.col("__size").alias("size"))
    got = mixing.with_copies(rows, mixing.plan(narrow)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r["__size"] == len(re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r.doc_id] or "")) and 0 <= r["__copies"] <= 3
    assert abs(sum({r["__sk"]: r["__target"] for r in got}.values()) - sum(r["__size"] for r in got)) < 1e-6
    assert mixing.mix(empty).count() == 0


def test_mixing_multipliers_by_bisection(spark):
    rng = np.random.default_rng(8)
    cells = [(f"s{k}", int(size), int(n)) for k in range(7) for size, n in zip(*np.unique(rng.integers(1, 60, 80 * (k + 1) ** 2), return_counts=True), strict=True)]
    hist = spark.createDataFrame(cells, "sk string, size long, n long")
    goals = mixing.targets(hist).collect()
    total = {k: sum(s * n for q, s, n in cells if q == k) for k in {q for q, _, _ in cells}}
    # targets: by weight, what is above three times the source's words goes to the others
    left, open_, want = sum(total.values()), {f"s{k}": k % 3 + 1 for k in range(7)}, {}
    while open_:
        level = left / sum(open_.values())
        full = [k for k, w in open_.items() if w * level > 3 * total[k]]
        for k in full or list(open_):
            want[k] = min(3 * total[k], open_.pop(k) * level)
            left -= want[k]
    assert all(abs(r.target - want[r.sk]) < 1e-6 for r in goals)
    for r in mixing.multipliers(hist, mixing.targets(hist)).collect():
        own = np.array([(s, n) for q, s, n in cells if q == r.sk], float)
        def words(lam):
            return float((own[:, 0] * own[:, 1] * np.minimum(np.exp(np.minimum(lam * own[:, 0], 5)), 3)).sum())
        low, high = -50.0, 5.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if words(mid) < want[r.sk] else (low, mid)
        assert abs(words(r.lam / r.scale) - words(low)) <= 1e-6 * want[r.sk]


def test_mix_with_clashing_columns(spark, empty):
    names = ["total", "m", "parts", "base", "ep", "eh", "ei", "pk", "ps", "target", "size", "sk", "n", "rate", "copies", "hash", "id", "part"]
    rows = [(i, "w " * (1 + i % 9), f"s{i % 3}", *range(len(names))) for i in range(60)] + [(None, None, None, *range(len(names))), (None, "", "s0", *range(len(names))), (3, "w", "s1", *range(len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    out = mixing.mix(df)
    got = out.collect()
    assert out.columns == df.columns and got and all([r[n] for n in names] == list(range(len(names))) for r in got)
    assert sum(r.doc_id is None and not r.text for r in got) == 2
    assert mixing.mix(empty).collect() == []


def test_mixing_reaches_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.lognormal(3, 1)), None, f"s{int(rng.integers(0, 5))}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    m = mixing.measured(df)
    from pyspark.sql import functions as F

    got = mixing.with_copies(m, mixing.plan(m.select("doc_id", F.col("__sk").alias("sk"), F.col("__size").alias("size")))).groupBy("__sk").agg(F.sum(F.col("__copies") * F.col("__size")).alias("got"), F.first("__target").alias("target")).collect()
    assert all(abs(r.got - r.target) <= 0.01 * r.target for r in got)


def test_secrets(docs, empty, spark):
    ratios = secrets.train(secrets.samples(spark))
    got = {r.doc_id: r["__all"] for r in secrets.scan(docs, ratios).collect()}
    t = TEXTS[9]
    assert [(s["start"], s["kind"], s["end"]) for s in got[9]] == [(0, 0, 14), (t.index("AKIA"), 1, len(t))]
    assert [(s["start"], s["kind"], s["end"]) for s in got[11]] == [(0, 2, 32)] and got[0] == [] and got[8] == []
    more = spark.createDataFrame([(1, "key Zk3vQ9xLm2Tp8WcR5bYh7NdF here user_account_name_value_index")], "doc_id long, text string")
    assert [s["kind"] for s in secrets.scan(more, ratios).first()["__all"]] == [3]
    assert secrets.scan(empty, ratios).count() == 0


def test_secrets_base_spans_as_re(spark):
    rng = np.random.default_rng(11)
    bits = ["password=", "API_KEY: ", "token = '", "AKIA", "Z9QX7", "deadbeef01", "0123456789abcdef01234567", "é\U0001f642", " ", "\n", "x", "secret:", "apikey=abc", "ABCDEFGH12345678", "fapi_key=", "-._/+="]
    texts = ["".join(rng.choice(bits, int(rng.integers(1, 40)))) for _ in range(300)] + [None, "", "a" * 100, " ".join(["deadbeef" * 4] * 700)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, start int, kind int")
    got = {r.doc_id: [(s["start"], s["kind"], s["end"]) for s in r["__base"]] for r in secrets.scan(df, [0.0] * 67 * 67).collect()}
    for i, t in enumerate(texts):
        want = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t or "") if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        assert got[i] == sorted(want)


def test_secrets_on_held_out_samples(spark):
    ratios = secrets.train(secrets.samples(spark))
    held = secrets.samples(spark, 800, secrets.HELD_OUT).withColumn("doc_id", secrets.F.monotonically_increasing_id())
    rows = secrets.scan(held.where("length(text) >= 20").withColumn("text", secrets.F.concat(secrets.F.lit("see "), "text", secrets.F.lit(" here"))), ratios).collect()
    hit = {y: [bool(r["__all"]) for r in rows if r.random == y] for y in (0, 1)}
    assert sum(hit[1]) >= 0.98 * len(hit[1]) and sum(hit[0]) <= 0.04 * len(hit[0])  # identifiers of one style, words without a gap, come near


def test_secrets_long_text(spark):
    import time

    text = " ".join(f"{i:032x}" for i in range(1, 24_001)) + " " + "QUJD" * 50_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ratios = secrets.train(secrets.samples(spark))
    began = time.time()
    r = secrets.scan(df, ratios).selectExpr("size(__base) as n", "__base[23999].end as end").first()
    assert (r.n, r.end) == (24_000, 24_000 * 33 - 1) and time.time() - began < 20


def test_secrets_glued_to_names(spark):
    rng = np.random.default_rng(12)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    rows = []
    for i in range(150):
        value = "".join(rng.choice(letters, 24 if i % 3 else 20))
        name = ["SIGNING_MATERIAL_FOR_SERVICE=", "encryption_master_key=", "/hooks/services/incoming/"][i % 3]
        rows.append((i, f"deadbeef{'0f' * 8}/ set {name}{value} now", len(f"deadbeef{'0f' * 8}/ set {name}"), len(value)))
    df = spark.createDataFrame(rows, "doc_id long, text string, at int, n int")
    got = secrets.scan(df, secrets.train(secrets.samples(spark))).collect()
    found = [(r["at"], r["at"] + r.n) in [(s["start"], s["end"]) for s in r["__all"] if s["kind"] == 3] for r in got]
    assert sum(found) >= 147
    plain = spark.createDataFrame([(1, "user_account_name_value_index/create_update_delete-read_write_open"), (2, "secret=abcdef123/" + "Zk3vQ9xLm2Tp8WcR5bYh7NdF")], "doc_id long, text string")
    assert [[s["kind"] for s in r["__all"]] for r in secrets.scan(plain, secrets.train(secrets.samples(spark))).orderBy("doc_id").collect()] == [[], [0]]


def test_licences(docs, empty, spark):
    mit = licences.TEMPLATES["mit"].split()
    wrapped = "int f() { return 1; }\n" + "\n".join(" * " + " ".join(mit[i : i + 12]) for i in range(0, len(mit), 12)) + "\nint g();"
    rows = [
        (1, "x y z\nReleased under the MIT License.\nend"), (2, licences.TEMPLATES["mit"]), (3, None), (4, wrapped), (5, "licence of software"), (None, "a\nLicensed under CC BY-NC 4.0."),
        (6, "This work is licensed under the GNU Lesser General Public License, version 3."), (7, "word " * 30_000 + "Licensed under the Apache License, Version 2.0." + " word" * 30_000),
        (8, "Released under the MIT License. " * 300),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, template string, r int")
    found = licences.matches(df).collect()
    got = {(r.doc_id, r.template, r.word): r.dice for r in found if r.doc_id != 8}
    assert got.pop((4, "mit", 5)) == 1.0 and got.pop((4, "mit-grant", 5)) == 1.0
    assert got == {(1, "mit-released", 4): 1.0, (2, "mit", 1): 1.0, (2, "mit-grant", 1): 1.0, (None, "cc-by-nc-4.0-licensed", 2): 1.0, (6, "lgpl-3.0-licensed", 1): 1.0, (7, "apache-2.0-licensed", 30_001): 1.0}
    assert sorted(r.word for r in found if r.doc_id == 8) == list(range(1, 1500, 5))
    assert licences.matches(empty).count() == 0


def test_licences_are_all_windows():
    """Every window whose Dice coefficient reaches LEAST has an anchor and shares two thirds of the template."""
    rng, anchors = np.random.default_rng(7), set(licences.anchors(licences.TEMPLATES))
    for text in licences.TEMPLATES.values():
        words, bigrams = licences.words_of(text), set(licences.bigrams_of(text))
        for _ in range(40):
            w = [x if rng.random() > 0.12 else "zzz" for x in words]
            b = set(zip(w, w[1:], strict=False))
            common = sum(f"{x} {y}" in bigrams for x, y in b)
            if 2 * common >= licences.LEAST * (len(b) + len(bigrams)):
                assert anchors & set(w) and 3 * common >= 2 * len(bigrams)


def test_pages(spark):
    site = "<html><body><div class='x'>Buy our special offers today only here</div><div><p>%s</p></div><div>All rights reserved.</div></body></html>"
    rows = [(i, f"http://h.com/{i}", site % f"Unique story number {i} about thing {i * 7}") for i in range(30)]
    rows += [(90, None, None), (91, "x", ""), (92, "http://q", "<div class='comments'>no</div><p>a &amp; b&nbsp;c<script>x</script><p>d<!-- zz"), (93, "http://q", "<article><h1>T</h1><p class=notice>n<p>keep</article><p>out")]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Unique story number {i} about thing {i * 7}" for i in range(30))
    assert (got[90], got[91], got[92], got[93]) == ("", "", "a & b c\nd", "T\nkeep")


def test_pages_in_articles(spark):
    page = "<article><h1>Title %d</h1><p>A story of its own with number %d in it</p><p>Share this story with your friends today</p></article>"
    rows = [(i, f"http://h.com/{i}", page % (i, i * 7)) for i in range(4)] + [(None, "http://h.com/4", page % (4, 28)), (5, "http://other.com/", page % (5, 35))]
    got = {r.url: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[f"http://h.com/{i}"] == f"Title {i}\nA story of its own with number {i * 7} in it" for i in range(5))
    assert got["http://other.com/"].endswith("friends today")


@pytest.mark.parametrize("limits", [(12_000_000, 4_000_000), (500, 4_000_000), (500, -1)])
def test_pages_large_host(spark, monkeypatch, limits):
    monkeypatch.setattr(pages, "HELD", limits[0])
    monkeypatch.setattr(pages, "BROADCAST_RUNS", limits[1])
    page = "<div><p>A story of its own with number %d in it</p>%s</div>"
    note = {7: "<p>Rare notice of three pages only here</p>", 40: "<p>Found on two pages and kept there</p>"}
    has = {3: 7, 55: 7, 117: 7, 20: 40, 90: 40}
    rows = [(i, f"http://h.com/{i}", page % (i, note.get(has.get(i), ""))) for i in range(120)]
    rows += [(200 + i, "http://h.com/same", page % (777, "<p>A copied page is not its own witness here</p>")) for i in range(9)] + [(300, None, None)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert len(got) == 130 and got[300] == ""
    assert all("Rare" not in got[i] for i in range(120)) and [i for i in range(120) if "kept there" in got[i]] == [20, 90]
    assert all(got[i].startswith(f"A story of its own with number {i} in it") for i in range(120))
    assert all(got[200 + i].endswith("witness here") for i in range(9))


def test_pages_near_copies_and_empty_table(spark):
    text = ["First paragraph of the copied article stands here", "Second paragraph of it with some more words", "Third one and the end"]
    page = "<article>%s</article>"
    rows = [(i, "http://h.com/x", page % "".join(f"<p>{t}</p>" for t in [*text, f"edited {i}"])) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert all(got[i] == "\n".join([*text, f"edited {i}"]) for i in range(6))
    assert pages.main_text(df.limit(0)).collect() == []


def test_covered_is_substring_counting():
    rng = np.random.default_rng(3)
    for _ in range(30):
        host = [[" ".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(rng.integers(1, 4))] for _ in range(int(rng.integers(3, 9)))]
        streams = [" ".join("| " + b for b in p).split() + ["|"] for p in host]
        windows = [{tuple(s[i : i + pages.RUN]) for i in range(len(s) - pages.RUN + 1)} for s in streams]
        found = pages.Suffixes(host)
        runs, n = found.runs("h")
        assert len(set(runs.tolist())) == len(runs) == len(set().union(*windows)) and sorted(n.tolist()) == sorted(sum(w in x for x in windows) for w in set().union(*windows))
        for s, marks in zip(streams, found.covered(), strict=True):
            inside = [False] * len(s)
            for i in range(len(s) - pages.RUN + 1):
                if sum(tuple(s[i : i + pages.RUN]) in w for w in windows) >= pages.PAGES:
                    inside[i : i + pages.RUN] = [True] * pages.RUN
            want, k = [], -1
            for token, x in zip(s[:-1], inside, strict=False):
                if token == "|":
                    want.append(True)
                    k += 1
                else:
                    want[k] &= x
            assert marks == want
    runs = np.unique(rng.integers(0, 1 << pages.BITS, 1000).astype(np.uint64))
    assert (pages.unpack(pages.pack(runs)) == runs).all()


def test_toxicity(spark, empty):
    rng = np.random.default_rng(3)
    words = ["lorem", "ipsum", "dolor", "amet", "tempor", "magna", "aliqua", "veniam", "nostrud", "laboris"]
    rows, labels = [(-1, None, "a", "b"), (-2, "", "a", "b")], []
    for i in range(600):
        t = list(rng.choice(words, 30))
        if i % 4 == 0:
            t[int(rng.integers(0, 30))] = "grumblefish"
        rows.append((i, " ".join(t), "en", "s"))
        labels.append((i, int(i % 4 == 0)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(df, toxicity.train(df, known)).withColumn("held", toxicity.held_out(toxicity.F.col("doc_id"))).collect()
    got = {r.doc_id: r["__score"] for r in out}
    assert {r.doc_id for r in out if r.held} == {i for i in [-1, -2, *range(600)] if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all((got[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in range(600)) and got[-1] == got[-2]
    assert toxicity.keep_clean(empty, known).count() == 0


def test_toxicity_keeps_rare_features(spark):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}{c}" for a in ("lo", "ip", "do", "am") for b in ("rem", "sum", "lor", "et") for c in ("us", "a", "ibus")]
    rows, labels = [], []
    for i in range(900):
        t = list(rng.choice(words, 20))
        toxic = i % 3 == 0
        if toxic:
            t[int(rng.integers(0, 20))] = "zwickelmurk" if i % 90 == 0 else "grumblefish"
        rows.append((i, " ".join(t), "en", "s"))
        labels.append((i, int(toxic)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rare = spark.createDataFrame([(-1, "lorema zwickelmurk ipsuma"), (-2, "lorema dolora ipsuma")], "doc_id long, text string")
    got = {r.doc_id: r["__score"] for r in toxicity.score(rare, toxicity.train(df, known)).collect()}
    assert got[-1] >= toxicity.THRESHOLD > got[-2]


def test_embeddings_of_any_magnitude(spark):
    x = [(1, [1e200, 1e200, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [1e200, 1.01e200, 0.0]), (4, [1e-200, 1e-200, 0.0]), (5, [0.0, 0.0, 1.0]), (6, [0.0, 0.0, 0.0]), (7, None), (8, [float("nan"), 1.0, 1.0]), (None, [5.0, 5.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in x], "vec_id long, embedding array<double>, vector int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert all(got[i] == (4, 1) for i in (1, 2, 3, 4)) and got[None][0] == 4 and all(got[i] == (0, i) for i in (5, 6, 7, 8))
    assert embeddings.near_vectors(df.limit(0)).collect() == []
