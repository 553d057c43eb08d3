"""The operators against plain versions, on the smallest tables and on odd rows."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import catalog, chat, decontaminate, embeddings, langid, minhash, mixing, pages, repeats, secrets, toxicity
from loomtext.llm.words import prefix_hashes, span_hashes
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, ties, copies and near copies."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    base = rng.choices(words, k=300)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "!!! ???"), (7, "12345 678"), (7, "12345 678"), (8, "\x00 zero"), (9, "ſ K é ü")]
    for i in range(12):
        copy = list(base)
        for _ in range(i):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((20 + i, " ".join(copy)))
    rows += [(40, " ".join(base)), (41, " ".join(base).upper()), (42, " ".join(rng.choices(words, k=30000))), (43, "a" * 5000), (44, "ab " * 900)]
    rows += [(None, "null id here"), (None, None)]
    return spark.createDataFrame([(d, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), len(t or "")) for d, t in rows], DOCS)


# --- embeddings ---------------------------------------------------------------------------------------------


def near_vectors(rng, n=240, dim=64):
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        c = centres[rng.integers(6)]
        e = (c + rng.uniform(0, 0.5) * rng.normal(size=dim)).astype(np.float32)
        rows.append((i, int(rng.integers(2)), [float(x) for x in e]))
    return rows


def test_embeddings_equal_brute_force(spark):
    rows = near_vectors(np.random.default_rng(4))
    rows += [(300, 1, None), (301, None, rows[0][2]), (302, 1, [0.0] * 64), (303, 1, [float("nan")] * 64), (304, 1, [None] * 64), (305, 1, [1.0, 2.0]), (306, 1, [2.0, 4.0]), (307, 1, []), (308, 0, [float("inf")] + [1.0] * 63)]
    rows += [(310 + i, 1, rows[5][2]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.cluster(df.withColumn("class_id", F.lit(1))).collect()}
    want = brute.vectors([(v, lab, e) for v, lab, e in rows])
    missed = sum(w[0] for w in want.values()) - sum(g[0] for g in got.values())
    assert missed == 0
    assert all(got[k][0] <= want[k][0] for k in want)
    assert all(got[k] == (0, k) for k in (300, 301, 302, 303, 304, 307, 308))
    assert got[305] == (1, 305) and got[306] == (1, 305)


def test_every_pair_at_the_threshold_links(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(2, 4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = 0.9301
    rows = [(2 * i + j, i, v.tolist()) for i, pair in enumerate(zip(x, c * x + (1 - c * c) ** 0.5 * y)) for j, v in enumerate(pair)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert embeddings.cluster(df).filter("n_links = 1 and component_id = vec_id - vec_id % 2").count() == len(rows)


def test_embeddings_blocks(spark, monkeypatch):
    """Small blocks and no pairwise path give the same counts."""
    rows = near_vectors(np.random.default_rng(5), 120)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    whole = sorted(map(tuple, embeddings.cluster(df).collect()))
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    assert sorted(map(tuple, embeddings.cluster(df).collect())) == whole


@pytest.mark.parametrize("dim", (2, 16, 64, 100))
def test_estimates_are_unbiased_and_bounded(dim):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, dim))
    y = x + rng.uniform(0, 1.5, (400, 1)) * rng.normal(size=(400, dim))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    code, factor = embeddings.encoded(x)
    assert code.shape[1] == -(-dim * embeddings.ROTATIONS // 8) and (factor > 0).all() and (dim < 64 or (factor > 0.85).all())
    with_code = embeddings.decoded(code, dim) @ y.T
    true = x @ y.T
    if dim >= 16:
        error = np.diagonal(with_code) / factor - np.diagonal(true)
        assert abs(error.mean()) < 4 * error.std() / 20
    reached = true >= 0.93
    assert (with_code >= embeddings.least_cosine(factor, 0.93)[:, None])[reached].all()
    if dim >= 64:
        assert (with_code >= embeddings.least_cosine(factor, 0.93)[:, None])[true < 0.4].mean() < 0.01


def test_embeddings_empty(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert embeddings.cluster(df).count() == 0


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", (512, 1024, 2048))
def test_strings_that_meet_modulo_powers_of_two(spark, n):
    """Words without a letter in common at any place have hashes of their own."""
    for letters in ("ab", "Ga"):
        texts = [thue_morse(n, letters), thue_morse(n, letters[::-1])]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        hashes = span_hashes(prefix_hashes(data), np.array([0, n]), np.array([n, 2 * n]))
        assert hashes[0] != hashes[1]
    texts = [thue_morse(n, "ab"), thue_morse(n, "ba")]
    docs = spark.createDataFrame([(i, t, None, None, n) for i, t in enumerate(texts)], DOCS)
    assert {r["component_id"] for r in minhash.cluster(docs, size=3, percent=85).collect()} == {0, 1}
    assert [r["contaminated"] for r in decontaminate.report(docs, spark.createDataFrame([(1, texts[0])], "item_id long, text string")).orderBy("doc_id").collect()] == [True, False]


# --- secrets ------------------------------------------------------------------------------------------------

SECRETS = [
    'password = "hunter2hunter2" and PassWd:short', "secret: token: abcdefgh1", "api_key=ABCDEFGH12345678 apikey: 'x.y-z_1234'", "AKIAABCDEFGHIJKL AKIAx AKIA1234",
    "0123456789abcdef0123456789abcdef0 deadbeef", "é token=ünïcode token==a=b=c=d=e", "ſecret=abcdefghij toKen=abcdefghij", None, "", "token=secret=password=12345678", "x" * 3000 + "token=abcdefgh" * 3,
]


def test_secrets_equal_regular_expressions(spark, tables):
    rows = [(i, t, None, "s", 0) for i, t in enumerate(SECRETS)]
    for docs in (spark.createDataFrame(rows + rows[:1], DOCS).withColumn("base", F.lit(1)), tables("documents")):
        for r in secrets.report(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
            want = brute.secrets(r["text"])
            assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
            assert [x for x in r["spans"].split(",") if x and not x.startswith("owned")] == [f"{k}:{s}:{e}" for k, s, e in want]


def test_ownership_separates_copies_from_live_values(spark):
    live, copied = "Zq8Rt5Lm2Xv9Bn4Ks7Wd1Pf6", "Ab3Cd4Ef5Gh6Ij7Kl8Mn9Op0"
    rows = [(1, f"use {live} here", "en", "s1", 0)] + [(10 + i, f"example {copied} text", "en", f"s{i}", 0) for i in range(4)]
    got = {r["doc_id"]: (r["spans"], r["n_live"], r["n_copied"]) for r in secrets.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == ("owned:4:28", 1, 0)
    assert all(got[10 + i] == ("", 0, 1) for i in range(4))


def test_repositories_decide_as_owners_do(spark):
    few, many = "Zq8Rt5Lm2Xv9Bn4Ks7Wd1Pf6", "Ab3Cd4Ef5Gh6Ij7Kl8Mn9Op0"
    rows = [(i, f"use {few} here", "en", "s1", 0) for i in range(secrets.COPIED_REPOSITORIES - 1)] + [(100 + i, f"use {many} here", "en", "s1", 0) for i in range(secrets.COPIED_REPOSITORIES)]
    got = {r["doc_id"]: r["spans"] for r in secrets.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(x == ("owned:4:28" if d < 100 else "") for d, x in got.items())


def test_many_matches_in_one_text(spark):
    text = " é ".join(f"token=abcdefgh{i} " + "0a" * 16 for i in range(30_000))
    row = secrets.report(spark.createDataFrame([(1, text, None, "s", 0)], DOCS)).first()
    assert [x for x in row["spans"].split(",") if not x.startswith("owned")] == [f"{k}:{s}:{e}" for k, s, e in brute.secrets(text)]


def test_redaction(spark):
    rows = [(1, 'a password="hunter2hunter2" b', "en", "s", 29), (2, "clean", "en", "s", 5), (3, None, "en", "s", 0)]
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit("x"))).collect()}
    assert out == {1: ('a [REDACTED]" b', 15), 2: ("clean", 5), 3: (None, 0)}


# --- language -----------------------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark, tables):
    docs = tables("documents")
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and held
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark, tables):
    odd = odd_documents(spark).withColumn("_letter", F.lit("x"))
    known = tables("documents").withColumn("_letter", F.lit("y"))
    got = langid.report(odd.unionByName(known)).collect()
    assert len(got) == odd.count() + known.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (6,)} >= {"und"}
    nothing = langid.report(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert langid.report(odd.filter("false")).count() == 0


def test_junk_with_letters_is_rejected(spark, tables):
    """Random letters, encoded bytes and unlearned scripts go; clean texts stay, short ones and those with secrets too."""
    rng = random.Random(2)
    drawn = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(n))
    junk = [f(n) for n in (8, 60) for f in (lambda n: drawn("bcdfghjklmnpqrstvwxz", n), lambda n: drawn("αβγδεζηθικλμνξοπρστυφχψω", n), lambda n: drawn("абвгдежзийклмнопрстуфхцчшщыьэюя", n), lambda n: "".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(n)), lambda n: rng.randbytes(n).hex(), lambda n: base64.b64encode(rng.randbytes(5 * n)).decode())]
    clean = ["The and attion to thanedble the.", "Avec.", 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" From reha reenti oution thti.', "Of and and ly esor.", "Die der und in das."]
    docs = tables("documents").select("doc_id", "text", "lang")
    planted = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(junk + clean)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    kept = {r[0] for r in langid.keep(docs.unionByName(planted)).select("doc_id").collect()}
    assert {10**9 + i for i in range(len(junk))}.isdisjoint(kept)
    assert {10**9 + len(junk) + i for i in range(len(clean))} <= kept
    assert {r[0] for r in docs.select("doc_id").collect()} <= kept


def test_scores_do_not_depend_on_neighbours(spark, tables):
    docs = tables("documents").select("doc_id", "text", "lang")
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    got = [dict(langid.predict(docs.repartition(n).select("doc_id", "text"), model).select("doc_id", "_lang_score").collect()) for n in (3, 16)]
    assert got[0].keys() == got[1].keys() and max(abs(got[0][k] - got[1][k]) for k in got[0]) < 2e-6


def test_positions_equal_a_plain_network():
    """Word by word and byte by byte, without batches or padding."""
    rng = np.random.default_rng(4)
    model = langid.LanguageModel(["a", "b", "c"], hidden=5)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 7, 3, 30, 2)]
    x, size, inside = langid.padded(words)
    got = model.positions(x, size)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(gru, text):
        h, n, out = np.zeros(5), 5, []
        for c in text:
            a, g = gru.w["x"][c].astype(float) + gru.w["b"], h @ gru.w["u"].astype(float)
            z, r = sigmoid(a[:n] + g[:n]), sigmoid(a[n : 2 * n] + g[n : 2 * n])
            h = (1 - z) * np.tanh(a[2 * n :] + r * g[2 * n :]) + z * h
            out.append(h)
        return out

    for k, w in enumerate(words):
        text = b" " + w + b" "
        ahead, behind = states(model.ahead, text), states(model.behind, text[::-1])[::-1]
        for t in range(1, len(text) - 1):
            logits = np.concatenate((ahead[t], behind[t])) @ model.top["v"] + model.top["c"]
            p = np.exp(logits - logits.max())
            assert np.allclose(got[t, k], p / p.sum(), atol=1e-5)


def test_gradients():
    rng = np.random.default_rng(2)
    gru = langid.ByteGRU(rng, 3)
    gru.w = {k: v.astype(np.float64) for k, v in gru.w.items()}
    x = rng.integers(0, 5, (4, 2)).astype(np.uint8)
    weight = rng.normal(size=(4, 2, 3))
    loss = lambda: (gru.run(x)[0].astype(np.float64) * weight).sum()
    out, tape = gru.run(x, keep=True)
    grads = gru.back(x, tape, weight)
    for key, at in (("u", (1, 4)), ("u", (2, 8)), ("x", (int(x[0, 0]), 2)), ("b", (5,))):
        h = 1e-3
        gru.w[key][at] += h
        up = loss()
        gru.w[key][at] -= 2 * h
        down = loss()
        gru.w[key][at] += h
        assert abs((up - down) / (2 * h) - grads[key][at]) < 2e-2


# --- near duplicates ----------------------------------------------------------------------------------------


def test_near_duplicates_equal_brute_force(spark, tables):
    for docs, size, percent in ((tables("documents"), 3, 85), (odd_documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]), 5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.cluster(docs.withColumn("node", F.lit(0)), size, percent).collect()}
        assert got == brute.near_duplicates(texts_of(docs), size, percent)


def test_families_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(minhash, "EXACT_BLOCK", 5)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "PER_CENTRE", 3)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=120)
    rows = []
    for i in range(70):
        copy = list(base)
        for k in rng.sample(range(120), rng.randint(0, 9)):
            copy[k] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.cluster(docs, 3, 85).collect()}
    assert got == brute.near_duplicates(rows, 3, 85)


def test_rows_that_share_an_id(spark):
    rng = random.Random(13)
    a, b, c = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60)) for _ in "abc")
    rows = [(3, a), (7, a), (7, b), (7, b), (8, c + " x"), (8, c + " y"), (9, c), (4, None), (4, ""), (None, a), (5, b + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("group", F.lit("g"))
    left = sorted(((r["doc_id"], r["text"]) for r in minhash.keep_one(docs).collect()), key=str)
    assert [x for x in left if x[0] != 8] == sorted([(3, a), (5, b + " z"), (4, None), (4, "")], key=str)
    assert [d for d, _ in left].count(8) == 1 and len({t for d, t in left if d == 8} & {c + " x", c + " y"}) == 1


def test_near_duplicates_odd_rows(spark):
    odd = odd_documents(spark)
    got = minhash.cluster(odd, 3, 85).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["doc_id"] == 7} == {7}
    kept = minhash.keep_one(odd.withColumn("of_id", F.lit(1)), 3, 85)
    assert kept.columns == [*odd.columns, "of_id"]
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(7) == 1 and 20 in ids and 40 not in ids and 41 not in ids
    assert minhash.cluster(odd.filter("false")).count() == 0


# --- repeated passages --------------------------------------------------------------------------------------


def test_longest_previous_factors():
    rng = np.random.default_rng(3)
    for n, depth in ((1, 9), (40, 20), (150, 20), (200, 400)):
        x = rng.integers(97, 99, n).astype(np.uint8)
        b = bytes(x)

        def common(i, j):
            k = 0
            while k < depth and max(i, j) + k < n and b[i + k] == b[j + k]:
                k += 1
            return k

        length, source, _ = repeats.longest_previous_factors(prefix_hashes(x), depth)
        assert length.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in range(n)]
        assert all(source[i] < i and common(i, source[i]) == length[i] for i in range(n) if length[i])


def passages(spark, seed=6):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("abcdefghij é\n", k=n))
    shared = [text(420), text(900), text(410)]
    rows = [(i, text(rng.randint(0, 700)) + rng.choice(shared) + text(rng.randint(0, 700))) for i in range(40)]
    return rows + [(100, None), (101, ""), (102, "x" * 399), (103, "x" * 400), (104, "y" * 401), (105, rows[0][1]), (106, rows[1][1][:-5]), (7, rows[7][1]), (107, "ab" * 700), (108, text(430) * 2)]


@pytest.mark.parametrize("per_shard", [512, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, per_shard):
    monkeypatch.setattr(repeats, "PER_SHARD", per_shard)
    rows = passages(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gram", F.lit(1))
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.report(docs).collect())
    assert got == sorted((d, *x) for (d, _), x in zip(rows, brute.repeats(rows, 400)))


def test_strings_split_over_salts(spark, monkeypatch):
    """What recurs within a shard, or in copies of a context, goes from the other shards of its anchor too."""
    monkeypatch.setattr(repeats, "PER_SHARD", 1)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 1)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcdefghij", k=n))
    rows = []
    for _ in range(8):
        core = text(390)
        for left, right in (("k" * 20, "l" * 20), ("m" * 20, "n" * 20)):  # each surrounding of the core in three texts, one of them apart
            near = left + core + right
            rows += [text(300) + near + text(300), text(300) + near + text(300), near[5:] + text(500)]
        copied = text(200) + "o" * 20 + core + "p" * 20 + text(200)
        rows += [copied + text(50), copied + text(50), "q" * 300 + copied[200:-200] + text(300)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.report(docs).collect())
    assert got == sorted((d, *x) for (d, _), x in zip(rows, brute.repeats(rows, 400)))


@pytest.mark.parametrize("shards", [None, (2, 1), (1, 1)])
def test_shared_passages_equal_brute_force(spark, monkeypatch, shards):
    """Passages of short words, below the bytes of a removed string: within a document, in copies, in many documents, over salts."""
    if shards:
        monkeypatch.setattr(repeats, "PER_SHARD", shards[0])
        monkeypatch.setattr(repeats, "SHARD_BYTES", shards[1])
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared = [text(n) for n in (51, 50, 60, 70)]
    rows = [(i, f"{text(rng.randint(0, 90))} {shared[i % 4]}\n{text(rng.randint(0, 60))}") for i in range(40)]
    twice, own = text(55), text(300)
    rows += [(50, f"{twice} x {twice}"), (51, own), (52, own.upper()), (52, own), (53, None), (54, ""), (55, text(50)), (60, " ".join([shared[2]] * 3)), (61, "la " * 400), (62, f"{text(9)} " + "la " * 52), (63, "mi " * 300)]
    rows += [(None, f"{text(20)} {twice}"), (64, text(100)), (64, text(100)), (65, f"{text(60)} é {shared[3]}")]
    rows += [(70, "la " * 60 + shared[0]), (71, shared[0] + " " + shared[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_shared_words"], r["n_passages"]) for r in repeats.report(docs).collect())
    assert got == sorted((len((t or "").encode()), *x) for (_, t), x in zip(rows, brute.shared_words(rows, 51)))
    assert sum(x[2] for x in got) > 30


def test_repeats_on_the_table(spark, tables):
    rows = texts_of(tables("documents"))
    found = repeats.report(tables("documents")).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found}
    assert got == {d: x for (d, _), x in zip(rows, brute.repeats(rows, 400))}
    assert {r["doc_id"]: (r["n_shared_words"], r["n_passages"]) for r in found} == {d: x for (d, _), x in zip(rows, brute.shared_words(rows, 51))}
    assert repeats.report(tables("documents").filter("false")).count() == 0


# --- pages --------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><div id="main-nav"><a>Home</a></div><div class="content"><h1>Hi &amp; low</h1>
<p>One<br>two <b>three</b>&nbsp;x<p>Four <!-- c --> five<ul><li>a<li>b</ul><div class="comments"><p>reader says</p></div><p>end</p></div><div>Copyright X</div></body>"""
ARTICLE = "<nav>menu</nav><div class='ad'>buy</div><article><header><h1>T</h1></header><p>a &lt; b &eacute;<p>c<form>f</form><aside>s</aside></article><footer>&copy;</footer><script>if (a</b) {}</script>"


def test_page_lines(spark):
    other = PAGE.replace("Four", "Six").replace("One", "Uno").replace("Hi", "Ho").replace(">end", ">fin").replace("<li>a<li>b", "<li>c<li>d")
    rows = [(1, "http://h/a/1", PAGE), (2, "http://h/a/2", other), (3, "http://k/x", ARTICLE), (4, None, None), (5, "http://k/x", ARTICLE), (6, "http://k/y", ""), (7, "bad", "plain text"), (8, "http://z/", "<p>unclosed <b"), (8, "http://z/", "<p>unclosed <b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.extract(df).collect()}
    assert pages.extract(df).count() == len(rows)
    assert sorted(map(tuple, pages.extract(df, 1).collect())) == sorted(map(tuple, pages.extract(df.repartition(9), 1).collect()))
    assert got[1][0] == "Hi & low\nOne two three x\nFour five\na\nb\nend"
    assert got[3] == ("T\na < b é\nc", 11) and got[5] == got[3]
    assert got[4] == ("", 0) and got[6] == ("", 0) and got[7][0] == "plain text" and got[8][0] == "unclosed"
    assert pages.extract(df.filter("false")).count() == 0


def test_common_lines():
    a, b = list("abcbdab"), list("bdcaba")
    rest = iter(b)
    found = [a[i] for i in sorted(pages.common_lines(a, b))]
    assert len(found) == 4 and all(x in rest for x in found)
    assert pages.common_lines([], ["a"]) == set()


def test_common_lines_are_longest():
    """Both ways of solving against the table of lengths, and lines that recur without end."""
    rng = random.Random(8)
    for _ in range(300):
        a, b = (rng.choices("abcd"[: rng.randint(1, 4)], k=rng.randint(0, 14)) for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        known = set(a) & set(b)
        inner = [x for x in a if x in known], [x for x in b if x in known]
        for found, (u, v) in ((pages.common_lines(a, b), (a, b)), (pages._by_bits(*inner), inner), (pages._by_matches(*inner), inner)):
            rest = iter(v)
            assert len(found) == table[-1][-1] and all(u[i] in rest for i in sorted(found))
    a, b = rng.choices("xy", k=20_000), rng.choices("xy", k=20_000)
    assert len(pages.common_lines(a, b)) > 14_000


def plain_pages(rows):
    """page_id -> text, host by host, each page beside the nearest that differ."""
    from urllib.parse import urlsplit

    def place(r):
        at = urlsplit(r[1] or "")
        return (at.hostname or "", at.path, r[0])

    out, ordered = {}, sorted(rows, key=place)
    read = [(place(r)[0], pages.lines(r[2] or "")) for r in ordered]
    for i, r in enumerate(ordered):
        sides = []
        for step in (-1, 1):
            j = i
            while 0 <= j < len(read) and read[j] == read[i]:
                j += step
            if 0 <= j < len(read) and read[j][0] == read[i][0]:
                sides.append(read[j][1])
        out[r[0]] = "\n".join(pages.main_lines(read[i][1], sides)[0])
    return out


def test_pages_beside_their_nearest(spark):
    """Pages without an article: shared lines go across parts and copies, as the plain version has it."""
    rng = random.Random(9)
    rows = []
    for i in range(120):
        body = "".join(f"<p>own {rng.randint(0, 10**9)}</p>" for _ in range(3)) if i % 10 else "<p>copy</p><p>of one</p>"
        rows.append((i, f"http://h{i % 3}/p/{i // 12}/{i}", f"<div>Welcome</div><div>Menu</div>{body}<div>Imprint</div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for apart in (1000, 7):
        got = pages.extract(df, apart).collect()
        assert {r["page_id"]: r["text"] for r in got} == plain_pages(rows)
    assert sum(r["n_shared"] for r in got) >= 300


@pytest.mark.parametrize("parts", (1, 2, 3, 250))
def test_copies_over_cuts(spark, parts):
    """Runs of equal pages that cuts part, and that fill whole parts, read as they do in one part."""
    rows = [(0, "http://h/a/0", "<div>Terms of use</div><p>first</p>")]
    rows += [(i, f"http://h/b/{i}", "<div>Terms of use</div><p>copy</p>") for i in range(1, 30)]
    rows += [(30, "http://h/c/1", "<div>Other</div><p>copy</p>"), *((i, f"http://h/d/{i}", "<div>Other</div><p>again</p>") for i in range(31, 50)), (50, "http://i/a", "<div>Other</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract(df, parts).collect()}
    assert got == plain_pages(rows) and len({got[i] for i in range(1, 30)}) == 1


def test_pages_of_the_table(spark, tables):
    import html
    import re

    for r in pages.extract(tables("pages")).join(tables("pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " " if True else "", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(x for x in blocks if x)


# --- chat ---------------------------------------------------------------------------------------------------


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_conversations_round_trip(spark, tables):
    odd = [(-1, 0, "user", "a\\ <|im_end|> \\<| [INST]"), (-1, 1, "assistant", None), (-1, 1, "assistant", None), (-2, None, None, "x\\"), (-2, 3, "assistant", "é" * 5000), (-3, 0, "<|im_sep|>", "</s>"), (-4, 0, "assistant", "<|im_start|>\n<|im_end|>\n"), (-5, 0, "a", "<</SYS>>\\\\")]
    odd += [(-6, t, r, x) for t, r, x in ((0, "user", "ok"), (1, "assistant", "fine"), (2, "user", "ok"), (3, "assistant", "fine"), (4, "user", None), (5, "user", None), (5, "user", ""))]
    odd = random.Random(5).sample(odd, len(odd))
    rows = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").unionByName(tables("conversations")).withColumn("message", F.lit(1))
    want = {}
    for r in rows.collect() + chat.planted(spark).collect():
        want.setdefault(r["conv_id"], []).append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    got = {r["conv_id"]: r for r in chat.formatted_conversations(rows).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), digest(turns))
        assert (g["loss_chars"], g["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert g["formatted_chars"] >= sum(len(r) + len(t) for r, t in turns)


def test_texts_hold_no_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_start|>", "<<SYS>>", "a<|b|>c", "<" * 5 + "|", "\\</s>", "<s><s>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).collect()
    for r in rows:
        assert not any(c in r["e"] for c in chat.CONTROL) and chat.unescaped(r["e"]) == r["t"]


def test_log_is_folded(spark):
    log = [(1, 0, "m1", "user", "delta", 0, "he"), (1, 1, "m1", "user", "delta", 0, "llo"), (1, 2, "m2", "assistant", "delta", 0, "bad"), (1, 3, "m2", "assistant", "regenerate", 0, None), (1, 4, "m2", "assistant", "delta", 0, "good"), (1, 5, "m1", "user", "edit", 0, "HELLO"), (1, 6, "m1", "user", "delta", 0, "!"), (1, 7, "m3", "user", "delta", 0, "x"), (1, 8, "m3", "user", "retract", 0, None)]
    df = spark.createDataFrame(log, "conv_id long, seq long, message string, role string, kind string, part int, text string")
    got = [(r["role"], r["text"]) for r in chat.reconstruct(df).orderBy("place").collect()]
    assert got == [("user", "HELLO!"), ("assistant", "good")]
    assert chat.conversation_digests(chat.render(chat.reconstruct(df.filter("false")))).count() == 0


def test_the_querys_log_edits_and_regenerates(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi " * 30), (1, 1, "assistant", "yes"), (1, 2, "user", None)], "conv_id long, turn long, role string, text string")
    log = chat.log_of_turns(turns, delta_chars=10)
    kinds = [r["kind"] for r in log.orderBy("seq", "part").collect()]
    assert kinds.count("edit") == 2 and kinds.count("regenerate") == 1 and kinds.count("delta") == 3 + 8 + 1
    assert [r["text"] for r in chat.reconstruct(log).orderBy("place").collect()] == ["hi " * 30, "yes", ""]
    plan = chat.conversation_digests(chat.render(chat.reconstruct(log)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


# --- decontamination ----------------------------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark, tables):
    base = texts_of(tables("documents"))
    items = [(r["item_id"], r["text"]) for r in tables("benchmark").collect()] + [(900, None), (901, ""), (902, "A-b c"), (903, "1 2 3 4 5 6 7 8 9 10 11"), (903, "é"), (None, "zz yy")]
    rows = base + [(5000, None), (5001, ""), (5002, "x a B,c d"), (5003, "0 1 2 3 4 5 6 7 8 9 10 11 12"), (5004, "a b"), (5005, "É é"), (5006, "b c a"), (5007, items[0][1] + " " + items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_spans", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {d: (n, h, len(i.split(",")) if i else 0, hashlib.sha256(i.encode()).hexdigest(), h > 0) for (d, _), (n, h, i) in zip(rows, brute.contamination(rows, items))}
    want[5000] = (0, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    read = lambda: {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.report(docs, bench).collect()}
    assert read() == want


def test_benchmark_blocks(spark, tables, monkeypatch):
    whole = sorted(map(tuple, decontaminate.report(tables("documents"), tables("benchmark")).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 700)
    assert sorted(map(tuple, decontaminate.report(tables("documents"), tables("benchmark")).collect())) == whole
    clean = decontaminate.remove(tables("documents"), tables("benchmark"))
    assert clean.columns == tables("documents").columns
    assert decontaminate.report(clean, tables("benchmark")).filter("contaminated").count() == 0
    assert decontaminate.report(tables("documents"), tables("benchmark").filter("false")).filter("contaminated").count() == 0


def test_removal_over_benchmark_blocks(spark, tables, monkeypatch):
    """Items that repeat, overlap or follow on each other in other blocks change nothing that is removed."""
    word = [f"w{i}" for i in range(60)]
    text = lambda a, b: " ".join(word[a:b])
    items = [("a", text(0, 40)), ("b", text(0, 40)), ("c", text(30, 40)), ("d", text(40, 50)), ("e", text(5, 25))]
    bench = spark.createDataFrame(items, "item_id string, text string").coalesce(1)
    docs = spark.createDataFrame([(1, text(0, 40) + " " + " ".join(f"x{i}" for i in range(20))), (2, text(0, 60)), (3, text(0, 50)), (4, "clean"), (5, None)], "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    removed = lambda d, b: sorted(map(str, decontaminate.remove(d, b).collect()))
    own = tables("benchmark").unionByName(tables("benchmark"))
    whole, of_table = removed(docs, bench), removed(tables("documents"), own)
    assert {r["doc_id"] for r in decontaminate.remove(docs, bench).collect()} == {1, 2, 4, 5}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1)
    assert removed(docs, bench) == whole
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 700)
    assert removed(tables("documents"), own) == of_table


def test_fm_index():
    rng = np.random.default_rng(9)
    sequence = rng.integers(1, 4, 300)
    sequence[[0, 50, 51, 200]] = 0
    sequence = np.append(sequence, 0)
    index = decontaminate.FMIndex(sequence, 3, sample=7)
    for n in (1, 2, 5):
        pattern = rng.integers(1, 4, n)
        padded = np.zeros((1, 6), np.int64)
        padded[0, 6 - n :] = pattern
        which, low, high = index.search(padded, np.array([n]))
        got = sorted(index.locate(np.arange(low[0], high[0]))) if len(which) else []
        assert got == [i for i in range(len(sequence) - n + 1) if (sequence[i : i + n] == pattern).all()]


# --- mixing -------------------------------------------------------------------------------------------------


def test_targets(spark):
    rng = random.Random(3)
    for case in ({"a": 10, "b": 500, "c": 90, None: 40}, {"a": 0, "b": 0}, {None: 7}, {chr(97 + i): rng.randint(0, 50) for i in range(20)}):
        rows = spark.createDataFrame([(k, v) for k, v in case.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
        assert got.keys() == case.keys() and all(abs(got[k] - v) < 1e-6 for k, v in brute.targets(case).items())


def test_mix_follows_the_plan(spark, tables):
    docs = tables("documents").withColumn("size", F.lit(1)).withColumn("copies", F.lit(99))
    plan = {r["doc_id"]: r["copies"] for r in mixing.report(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in plan.items() if n} and max(plan.values()) <= 3
    assert sorted(map(tuple, mixing.report(docs).collect())) == sorted(map(tuple, mixing.report(docs.repartition(7)).collect()))
    odd = odd_documents(spark)
    assert mixing.report(odd).count() == odd.count() and mixing.report(odd.filter("false")).count() == 0


def test_rows_without_ids_have_draws_of_their_own(spark):
    rows = [(None if i % 2 else i, f"w{i} " * (1 + i * 7 % 23), None, f"s{i % 3}", 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, DOCS)
    taken = mixing.plan_mix(docs).groupBy("doc.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(taken) == 3 and all(abs(r["taken"] - r["target"]) <= 0.03 * r["target"] for r in taken)


@pytest.mark.parametrize("bits", (8, 2))
def test_sources_meet_their_targets(spark, tables, monkeypatch, bits):
    """A source misses its target by little more than its longest document, in the table and with a hot source and many equal sizes."""
    monkeypatch.setattr(mixing, "HIST_BITS", bits)
    rng = random.Random(6)
    made = spark.createDataFrame([(i, "w " * rng.choice((1, 2, 7, 7, 40)), None, rng.choice(["hot", "hot", "b", "c", None]), 0) for i in range(900)], DOCS)
    for docs in (tables("documents"), made):
        rows = mixing.report(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
        for source in {r["source"] for r in rows}:
            own = [r for r in rows if r["source"] == source]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1.5 * max(r["size"] for r in own)


# --- toxicity -----------------------------------------------------------------------------------------------


def test_toxicity_learns_stems_and_scopes(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    rows, labels = [], []
    for i in range(600):
        text = rng.choices(words, k=40)
        toxic = i % 4 == 0
        if toxic:
            text[rng.randrange(40)] = rng.choice(["vilex", "vilely", "vileish"])
        elif i % 4 == 1:
            text[10:14] = ["she", "said", "you", "vilex"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9000, None)], "doc_id long, text string").withColumn("score", F.lit(1))
    known = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.report(docs, known).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum((r["score"] >= 0.3) == bool(truth[r["doc_id"]]) for r in held) / len(held) > 0.95
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (9000, 9001)}) == 1
    none = toxicity.report(docs, known.filter("toxic = 0")).collect()
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.report(docs.filter("false"), known).count() == 0 and toxicity.report(docs, known.filter("false")).count() == docs.count()


def test_toxicity_on_held_out_rows(spark, tables):
    big = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    got = toxicity.report(big("documents"), big("labels")).join(big("labels"), "doc_id").filter("held_out").collect()
    toxic, clean = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    assert np.mean([(t > np.array(clean)).mean() + 0.5 * (t == np.array(clean)).mean() for t in toxic]) > 0.9


def test_grammar_scopes():
    t = toxicity
    machine = t.grammar(t.PRIORS)

    def run(classes):
        state, out = 0, []
        for c in classes:
            state, kind, weight = machine.step[state][c]
            out.append((kind, weight))
        return out

    negated, reported, addressed = (t.PRIORS[k] for k in ("negated", "reported", "addressed"))
    assert run([t.INSULT])[0] == (16, 0.0)
    assert [k for k, _ in run([t.NEGATION, t.OTHER, t.INSULT, t.OTHER, t.INSULT])] == [0, 4, 20, 4, 16]
    assert run([t.REPORT, t.TARGET, t.INSULT])[2] == (19, reported + addressed)
    assert [k & 8 for k, _ in run([t.THREAT, t.OTHER, t.TARGET, t.THREAT])] == [0, 0, 8, 8]
    assert [k & 8 for k, _ in run([t.THREAT, t.END, t.TARGET])] == [0, 0, 0]
    assert run([t.NEGATION, t.THREAT, t.TARGET])[2] == (12, t.PRIORS["threat"] + negated)


def plain_score(model, text):
    """Clause by clause and word by word, scopes looked up backwards."""
    import re

    t, total = toxicity, 0.0
    listed = {w: c for c, ws in ((t.TARGET, t.TARGETS), (t.NEGATION, t.NEGATIONS), (t.REPORT, t.REPORTS), (t.THREAT, t.THREATS)) for w in ws}
    for clause in re.split(r"[.;:!?\n]", text or ""):
        kinds = []
        for w in re.findall(r"[0-9a-z'\u0080-\U0010ffff]+", brute.lower(clause)):
            weight = max((v for s, v in model.stems.items() if w.encode().startswith(s)), default=0.0)
            kinds.append((t.INSULT if weight else listed.get(w, t.OTHER), weight))
        best, waiting, targeted = 0.0, False, False
        for i, (c, weight) in enumerate(kinds):
            before = [k for k, _ in kinds[:i]]
            arc = sum(model.weights[n] for n, x in (("negated", t.NEGATION in before[-t.REACH :]), ("reported", t.REPORT in before), ("addressed", t.TARGET in before)) if x)
            if c == t.INSULT:
                best = max(best, np.exp(arc + model.weights["lexicon"] * weight))
            if c == t.THREAT and targeted or c == t.TARGET and waiting and not targeted:
                best = max(best, np.exp(arc + model.weights["threat"]))
            waiting |= c == t.THREAT
            targeted |= c == t.TARGET
        total += best
    return 1 / (1 + np.exp(-np.clip(model.slope * np.log1p(total) + model.bias, -30, 30)))


def test_scores_equal_a_plain_reading(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.train(docs, labels, F.lit(True))
    assert model.stems and model.slope > 0
    stem = max(model.stems, key=len).decode()
    made = [f"you {stem}", f"not a {stem} at all {stem}", f"he said you {stem}; kill them", "I will kill you", "you will die. kill! you", "not kill you", "", None, f"x {stem}. {stem} {stem} no no {stem}"]
    import pyarrow as pa

    texts = made + [t for _, t in texts_of(docs)]
    got = model.scores(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_score(model, x) for x in texts], atol=1e-9)


# --- the catalogue ------------------------------------------------------------------------------------------


def test_catalogue(spark, sf_dir):
    from tests.oracle import same

    assert sorted(int(k[2:].split("_")[0]) for k in catalog.QUERIES) == list(range(1, 14))
    for name, sql in catalog.ORACLE_SQL.items():
        same(catalog.QUERIES[name](spark, sf_dir), sql, sf_dir)


def test_extra_columns_that_clash(spark, sf_dir, monkeypatch):
    """Columns that differ in case only, or are named as the operators' own."""
    names = "TEXT Doc_Id Source LANG of_id spans node size doc copies gram salt _extra_0 _spans _letter base added".split()

    def widened(table, read=catalog._table):
        return lambda s, d, name: read(s, d, name).select("*", *(F.lit("x").alias(n) for n in names if n not in read(s, d, name).columns))

    plain = {k: f(spark, sf_dir) for k, f in catalog.QUERIES.items()}
    want = {k: sorted(map(str, df.collect())) for k, df in plain.items()}
    monkeypatch.setattr(catalog, "_table", widened(None))
    for k, f in catalog.QUERIES.items():
        assert sorted(map(str, f(spark, sf_dir).collect())) == want[k], k


@pytest.mark.parametrize("per_shard", [512, 2])
def test_first_occurrences_stay(spark, monkeypatch, per_shard):
    """What is left holds every string of 400 bytes of the input once at least, and none twice within the first texts."""
    monkeypatch.setattr(repeats, "PER_SHARD", per_shard)
    rows = [r for r in passages(spark, 11) if r[0] != 7]
    got = {r["doc_id"]: r for r in repeats.strip(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=True).collect()}
    seen, want = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        cover = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - 399):
            if raw[i : i + 400] in seen:
                cover[i] += 1
                cover[i + 400] -= 1
            seen.add(raw[i : i + 400])
        hit = np.cumsum(cover)[:-1] > 0
        want[d] = np.frombuffer(raw, np.uint8)[~hit].tobytes()
    assert {d: bytes(r["rest"]) for d, r in got.items()} == want


def test_elements_that_name_furniture():
    furniture = ['class="siteNav-menu"', "class=sideBar", 'id="commentList"', 'role="navigation"', "hidden", 'aria-hidden="true"', 'class="a cookie-bar b"', 'class="site-header"']
    content = ['data-class="ad"', 'title="hidden menu"', 'class="article-body"', 'class="headline"', 'aria-hidden="false"', 'href="/nav"', 'class="adapter"', ""]
    assert [x.furniture for a in furniture for x in pages.lines(f"<div {a}>x</div>")] == [True] * len(furniture)
    assert [x.furniture for a in content for x in pages.lines(f"<div {a}>x</div>")] == [False] * len(content)
    assert not pages.lines('<article><div class="entry-header">x</div></article>')[0].furniture
    assert [x.text for x in pages.lines("<select><option>a</select><p>a</p><table><tr><td>b<td>c</table>d &#65;&amp;&nbsp; e")] == ["a", "b", "c", "d A& e"]


def test_a_context_joins_its_places_once(spark):
    """All strings of a context that recur are one row, so that places times strings are never formed."""
    from loomtext.llm.repeats import spans_by_context

    rows = [(1, 1, [(5, 405)]), (1, 1, [(6, 406)]), (1, 1, [(406, 500), (900, 1300)]), (1, 1, [(0, 3)]), (1, 2, [(7, 8)]), (2, 1, [(7, 9), (8, 8)])]
    made = spans_by_context(spark.createDataFrame(rows, "gram long, context long, spans array<struct<start:int,end:int>>"))
    got = {(r["gram"], r["context"]): [tuple(s) for s in r["spans"]] for r in made.collect()}
    assert made.count() == 3 and got == {(1, 1): [(0, 3), (5, 500), (900, 1300)], (1, 2): [(7, 8)], (2, 1): [(7, 9)]}


def test_component_rounds_open_few_files(spark, monkeypatch):
    """Few links in many shuffle partitions: tables of a round have files by their rows, and a graph of stars is done when it is seen."""
    from loomtext.llm import graph
    from loomtext.storage import settle

    names, files = [], []

    def counted(df, name):
        out = settle(df, name)
        names.append(name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(graph, "settle", counted)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        chain = [(i, i + 1) for i in range(200)] + [(500, 500), (-7, 900), (900, 300), (None, 4)]
        got = graph.components(spark.createDataFrame(chain, "a long, b long")).collect()
        assert sorted((r["node"], r["label"]) for r in got) == [(-7, -7), *((i, 0) for i in range(201)), (300, -7), (900, -7)]
        assert max(n for n, name in zip(files, names) if name != "edges") <= spark.sparkContext.defaultParallelism + 1
        names.clear()
        stars = [(9, i) for i in range(10, 99)] + [(2, 3)]
        got = graph.components(spark.createDataFrame(stars, "a long, b long")).collect()
        assert sorted((r["node"], r["label"]) for r in got) == [(2, 2), (3, 2), (9, 9), *((i, 9) for i in range(10, 99))]
        assert names == ["edges", "least-neighbours"]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
