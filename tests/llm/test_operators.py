import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from graphloft.llm import bytesvec, decontaminate, jaccard, language, mixing, quality, secrets, suffixes, tokens, toxicity, warc
from graphloft.llm.common import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: str(r))


def sample_docs(spark, seed, n=60, words=14, copies=True):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        t = [rng.choice(voc) for _ in range(rng.choice([0, 1, 3, 5, words, 3 * words]))]
        if copies and out and rng.random() < 0.5:
            t = (rng.choice(out)[1] or "").split(" ")
            for _ in range(rng.choice([0, 1, 2])):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(voc)
        out.append((i, " ".join(t)))
    return out, spark.createDataFrame(out, "doc_id long, text string")


# 1 Suffix-array dedup


def brute_dedup(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        out[i] = (len(b), int(gone.sum()), len(edges), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b"").hexdigest())
    return out


def test_suffix_dedup_against_brute_force(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abé \n") for _ in range(rng.choice([30, 90, 120, 200]))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 6])))) for i in range(40)] + [(50, None), (51, "a" * 5000), (52, "a" * 99)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_dedup(docs)


def test_suffix_order_spills_to_disk(tmp_path, monkeypatch):
    monkeypatch.setattr(suffixes, "HELD", 50)
    t = np.random.default_rng(0).integers(1, 4, 900).astype(np.int16)
    key = lambda i: bytes(t[i : i + 100].astype(np.uint8))
    order = np.concatenate(list(suffixes.suffix_order(t, str(tmp_path))))
    assert sorted(order) == list(range(900)) and [key(i) for i in order] == sorted(map(key, range(900)))


def test_suffix_dedup_cases(docs, empty):
    got = suffixes.dedup(docs).collect()
    assert len(got) == 11 and {r["n_bytes"] for r in got if r["doc_id"] in (3, 4)} == {0}
    assert suffixes.dedup(empty).isEmpty()


# 2 Quality rules


def brute_base(t):
    t = t or ""
    ws = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    hit = {j for i in range(len(ws) - 4) if c[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(ws), sum(map(len, ws)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(hit)


def test_quality_against_brute_force(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0), (9, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = quality.judge(docs, model).collect()
    assert len(got) == 11
    for r in got:
        base = brute_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)
    assert {r["score"] for r in quality.judge(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.0}


def spark_hash(x, seed=42):
    """The engine's 64-bit hash of a string or of a whole number."""
    return xxhash.xxh64(x.encode() if isinstance(x, str) else struct.pack("<q", x), seed=seed & (2**64 - 1)).intdigest()


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def brute_scores(docs, good):
    """Mean log ratio of each document's words and word pairs, from Counters."""
    size, prior = quality.BUCKETS, quality.PRIOR

    def grams(text):
        hs = [signed(spark_hash(w)) for w in WORD.findall((text or "").lower())]
        return [h % size for h in hs] + [signed(spark_hash(b, signed(spark_hash(a)))) % size for a, b in zip(hs, hs[1:])]

    raw, aim = Counter(), Counter()
    for i, x in docs:
        raw.update(grams(x))
        if i in good:
            aim.update(grams(x))
    if not aim:
        return {i: 0.0 for i, _ in docs}
    n, m = sum(raw.values()) + prior * size, sum(aim.values()) + prior * size
    wide = prior * n / m
    ratio = lambda g: round(math.log((aim[g] + prior) / m) - math.log((raw[g] + wide) / (n + (wide - prior) * size)), 4)
    return {i: sum(map(ratio, grams(x))) / max(1, len(grams(x))) for i, x in docs}


def test_quality_score_against_brute_force(spark):
    rng = random.Random(4)
    voc = ["Good", "words", "ÉTÉ", "x1", "tail", "%%", "Other"]
    data = [(i, " ".join(rng.choice(voc) for _ in range(rng.choice([0, 1, 2, 12, 40])))) for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int")
    want = brute_scores(data, {i for i in range(0, 40, 2) if i % 3})
    got = {r["doc_id"]: r["score"] for r in quality.judge(docs, quality.fit(docs, labels)).collect()}
    assert got == {i: pytest.approx(x, abs=1e-9) for i, x in want.items()}


def test_quality_takes_any_column_names(spark):
    names = ["doc_id", "text", "ws", "low", "lines", "h", "s", "at", "c0", "c7", "row", "kept", "score", "_lines", "_h", "_s", "_at", "_g", "x", "is_target", "bucket", "n_words"]
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)), *["z"] * 20), (2, "short", *["z"] * 20)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names[2:]))
    model = [0.0] * quality.BUCKETS
    assert [r["kept"] for r in quality.judge(docs, model).orderBy("doc_id").collect()] == [True, False]
    assert set(quality.judge(docs, model).columns) == set(names) | set(quality.ADDED)


def test_quality_ratio(spark):
    docs = spark.createDataFrame([(i, "good words are here " * 5) for i in range(20)] + [(100 + i, "@@ ## junk%% %%% " * 5) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    score = {r["doc_id"]: r["score"] for r in quality.judge(docs, quality.fit(docs, labels)).collect()}
    assert score[1] > 0 > quality.THRESHOLD > score[101]


def test_quality_empty(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(empty, quality.fit(empty, labels)).isEmpty()


# 3 Mixing


def brute_targets(size, share=1.5, most=2):
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, goal = share * sum(size.values()), {}
    while True:
        open_ = [s for s in names if s not in goal]
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * size[s]]
        if not over:
            return {**goal, **{s: left * w[s] / total for s in open_}}
        for s in over:
            goal[s] = most * size[s]
        left = share * sum(size.values()) - sum(goal.values())


def test_mixing(spark):
    rng = random.Random(3)
    data = [(i, " ".join(["w"] * rng.choice([0, 1, 10, 50, 400])), rng.choice(["s1", "s2", "s3", "s4", None])) for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(docs, fan=8).collect()
    again = mixing.mix(docs.repartition(7), fan=8).collect()
    assert len(got) == 900 and {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in again}
    size = defaultdict(int)
    for _, t, s in data:
        size[s] += len(t.split())
    goal, taken = brute_targets(size), defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - goal[s]) <= 400  # the last open document at most


def test_mixing_cases(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == 11 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(empty).isEmpty()


# 4 Toxicity


def test_toxicity_learns(spark):
    rng = np.random.default_rng(0)
    calm, bad = [f"wort{i}" for i in range(200)], ["vile", "viler", "vilest"]
    texts, y = [], []
    for i in range(240):
        t = list(rng.choice(calm, 60))
        y.append(int(i % 4 == 0))
        if y[-1]:
            t[rng.integers(60)] = str(rng.choice(bad[:2]))
        texts.append(" ".join(t))
    net = toxicity.fit(texts, np.array(y, np.float32))
    test = [" ".join([*rng.choice(calm, 400), w]) for w in ("vilest", "wort3")] + [""]
    s = toxicity.score_texts(net, test)
    assert s[0] > toxicity.PREDICT > s[1] and 0 <= s[2] <= 1


def test_toxicity_cases(docs, empty):
    net = toxicity.Network()
    got = toxicity.classify(docs, net).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert toxicity.classify(empty, net).isEmpty()
    assert toxicity.train([]) == (None, {}) and not toxicity.score_texts(None, ["a"]).any()


def test_toxicity_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)) for n in rng.integers(0, 9, 300)]
    for seed in range(3):
        net = toxicity.Network(seed)
        alone = np.array([toxicity.score_texts(net, [x])[0] for x in texts])
        order = rng.permutation(len(texts))
        assert np.allclose(toxicity.score_texts(net, texts), alone, atol=1e-6)
        assert np.allclose(toxicity.score_texts(net, [texts[i] for i in order]), alone[order], atol=1e-6)


def test_toxicity_scores_do_not_depend_on_tiles(monkeypatch):
    net, rng = toxicity.Network(3), np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)) for n in (0, 1, 5, 63, 64, 65, 700, 2)]
    whole = toxicity.score_texts(net, texts)
    for tile in (1, 7, 64):
        monkeypatch.setattr(toxicity, "TILE", tile)
        assert np.allclose(toxicity.score_texts(net, texts), whole, atol=1e-6)


def test_toxicity_sample_is_bounded_repeatable_and_not_held_out(spark):
    data = [(i, f"text {i}", "en") for i in range(200)] + [(i, f"another {i}", "de") for i in range(50)] + [(300, "x" * (toxicity.TRAIN_BYTES + 1), "en"), (None, "no id", "en")]
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(200), 300, 7]] + [(None, 1), (8, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = toxicity.sample(docs, labels, limit=20)
    assert got == toxicity.sample(docs.repartition(5), labels.repartition(3), limit=20)
    assert [r["toxic"] for r in got].count(1) == 20 and [r["toxic"] for r in got].count(0) == 40
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["doc_id"] != 300 for r in got)
    assert all(r["text"].startswith("another") for r in got if r["doc_id"] < 50) and all(r["toxic"] == 1 for r in got if r["doc_id"] == 8)


def test_toxicity_query_learns_on_rows_that_are_not_held_out(spark, tmp_path):
    rng = np.random.default_rng(2)
    texts = [" ".join([*rng.choice([f"wort{k}" for k in range(150)], 30), *(["vile", "nasty"] if i % 4 == 0 else [])]) for i in range(400)]
    spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)] + [(500, None, None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.op4(spark, str(tmp_path)).collect()}
    assert len(got) == 401 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    asked = [(r["predicted"], int(i % 4 == 0)) for i, r in got.items() if r["held_out"] and i < 400]
    assert sum(a == b for a, b in asked) >= 0.95 * len(asked) and all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())


# 5 WARC


def test_warc_round_trip(spark):
    trap = "x" * 150 + "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    data = [(5, "u", trap), (3, "u", trap), (3, "v", trap), (9, None, None), (1, "u\n", "short"), (2, "u", "short"), (None, "n", trap), (7, "z", "y" * 70_000), (8, "z", "é" * 60)]
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame(data, "page_id long, url string, html string"), path)
    got = warc.read(spark, path).collect()
    key = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got)
    d = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    n = lambda t: len((t or "").encode())
    want = [("3", "response", None), ("3", "revisit", 3), ("5", "revisit", 3), ("None", "revisit", 3)]
    assert key == sorted([(*w, n(trap), d(trap)) for w in want] + [(str(i), "response", None, n(t), d(t)) for i, _, t in data if t != trap])


def test_warc_chain_and_damage(spark, tmp_path):
    assert warc.chain(np.array([0, 5, 9, 20]), np.array([9, 9, 20, 99])).tolist() == [True, False, True, True]
    (tmp_path / "part-0").write_bytes(b"WARC/1.1\r\nContent-Length: 50\r\n\r\ntoo short\r\n\r\n")
    with pytest.raises(ValueError):
        warc.read(spark, str(tmp_path))


def test_warc_empty(spark):
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).isEmpty()


# 6 Token counts


def brute_tokens(word, voc):
    least = min(voc.values()) + tokens.UNKNOWN
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        n = len(word[e - 1].encode())
        tries = [(best[e - 1][0] + least * n, -(best[e - 1][1] + n))]
        tries += [(best[s][0] + voc[word[s:e]], -(best[s][1] + 1)) for s in range(e) if word[s:e] in voc]
        top = max(tries)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_tokens_against_brute_force(docs, empty):
    voc = {"▁": -3.0, "a": -4.0, "b": -4.0, "ab": -5.0, "▁ab": -5.5, "ba": -7.0, "aba": -9.0, "é": -6.0}
    rng = random.Random(1)
    words = {"▁" + "".join(rng.choice("abéz") for _ in range(rng.randrange(9))) for _ in range(300)}
    assert tokens.count(list(words), voc) == {w: brute_tokens(w, voc) for w in words}
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, voc).collect()}
    assert got[3] == got[4] == got[5] == 0 and got[9] == 30_000 * brute_tokens("▁lang", voc)
    assert tokens.token_counts(empty, voc).isEmpty()


def test_pieces_have_unigram_scores():
    voc = tokens.pieces()
    assert sum(math.exp(x) for x in voc.values()) == pytest.approx(1) and len(voc) > 30_000
    assert tokens.count(["▁the", "▁international"], voc)["▁the"] == 1


def test_words_that_read_alike_once_decoded(spark):
    voc = {"▁": -3.0, "a": -4.0, "\ufffd": -5.0}
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'FFFE61' AS STRING) || ' ' || CAST(X'FDFE61' AS STRING) AS text")
    r = tokens.token_counts(docs, voc).first()
    assert (r["n_words"], r["n_tokens"]) == (2, 2 * brute_tokens("▁\ufffd\ufffda", voc))


# 7 Secrets


def brute_spans(t):
    words = "".join
    ci = lambda w: words(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    key = "|".join([ci("password"), ci("passwd"), ci("secret"), ci("token"), ci("api") + "_?" + ci("key")])
    a = [(m.start(), 0, m.end()) for m in re.finditer(rf"(?:{key})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[1]) >= 6]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(a + b + c)


def test_secrets_against_brute_force(spark, docs, empty):
    rng = random.Random(2)
    bits = ["password", "PassWd", "secret", "token", "API_KEY", "apikey", " ", "=", ":", '"', "'", "abc", "hunter22", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é𝒳", "\n", "token=", "-._"]
    data = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(300)]
    got = secrets.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()
    for r in got:
        assert [(x["start"], x["kind"], x["end"]) for x in r["base"]] == brute_spans(r["text"])
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["marks"]))
    assert len(secrets.scan(docs).collect()) == 11 and secrets.scan(empty).isEmpty()


def test_secret_models(spark):
    d = spark.createDataFrame([(1, "see kQ7fXz92LmPq0sVtB4wYhJ8n ok"), (2, "call the_user_profile_page_v2_handler now"), (3, "token = abcdef123456, kQ7fXz92LmPq0sVtB4wYhJ8n")], "doc_id long, text string")
    n = {r["doc_id"]: r["n_markov"] for r in secrets.scan(d).collect()}
    assert n == {1: 1, 2: 0, 3: 1}
    assert {r["doc_id"]: r["text"] for r in secrets.masked(spark, d, "").collect()}[3] == "[SECRET], [SECRET]"


def brute_evidence(run, sample):
    """Greatest sum of log ratios over the families, from Counters of transitions."""
    letters = [c for c in map(chr, range(128)) if re.match(r"[A-Za-z0-9+/_-]", c)]
    counts = defaultdict(Counter)
    for text, label in sample:
        counts[label].update(zip(text, text[1:]))
    rows = {k: Counter() for k in counts}
    for k, c in counts.items():
        for (x, _), n in c.items():
            rows[k][x] += n
    chance = lambda k, x, y: secrets.FLOOR / len(letters) + (1 - secrets.FLOOR) * counts[k][x, y] / rows[k][x] if rows[k][x] else 1 / len(letters)
    return max(sum(round(math.log(chance(k, x, y) / chance(None, x, y)), 2) for x, y in zip(run, run[1:])) for k in secrets.FAMILIES)


def test_markov_spans_against_brute_force(spark):
    rng = random.Random(8)
    sample = secrets.labelled(200)
    parts = ["the", "user_name", "Kd9", "x7Qp", "q", "+", "/", "ZZ", "deadbeef", "-", "42", "Gr7"]
    data = [(i, " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(4))) for i in range(120)]
    got = {r["doc_id"]: r["marks"] for r in secrets.scan(spark.createDataFrame(data, "doc_id long, text string"), models=secrets.train(sample)).collect()}
    n = 0
    for i, text in data:
        base = brute_spans(text)
        want = [(m.start(), 3, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_-]+", text) if not any(a < m.end() and m.start() < e for a, _, e in base) and brute_evidence(m[0], sample) >= secrets.THRESHOLD]
        assert sorted([*base, *want]) == [tuple(x) for x in got[i]]
        n += len(want)
    assert n > 20


def test_secret_models_recall_and_precision():
    rng, models = random.Random(9), secrets.train(secrets.labelled())
    at = lambda x, y: secrets.ALPHABET.index(x) * len(secrets.ALPHABET) + secrets.ALPHABET.index(y)
    flagged = lambda run: max(sum(m[at(x, y)] for x, y in zip(run, run[1:])) for m in models.values()) >= secrets.THRESHOLD
    for letters in secrets.FAMILIES.values():
        for size, least in ((20, 0.88), (24, 0.95), (32, 0.98)):
            assert np.mean([flagged("".join(rng.choice(letters) for _ in range(size))) for _ in range(300)]) >= least
    # none of these names and words is in the training sample
    usual = """getElementById2 http2_server_connection com/example/project/module3/Main2 IllegalArgumentException webpack4-babel-preset-env2
        parse_iso8601_timestamp DEFAULT_MAX_RETRY_COUNT src/main/java/org/apache/spark/Dataset x86_64-unknown-linux-gnu kubernetes-dashboard-metrics
        Donaudampfschifffahrtsgesellschaft anticonstitutionnellement otorrinolaringologo supercalifragilisticexpialidocious release-2024-10-31
        threadPoolExecutorService BACKUP_2023_12_31 interoperability_matrix_v2 float64_to_string_fast thumbnails/2021/05/17/index""".split()
    assert not [x for x in usual if flagged(x)]


def test_secrets_take_any_column_names(spark):
    names = ["doc_id", "text", "base", "marks", "_assign", "assign", "run", "found", "hex", "c0", "n_hex", "n_chars"]
    d = spark.createDataFrame([(1, "token = abcdef123456", *["z"] * 9, 20)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names[2:-1]) + ", n_chars int")
    assert secrets.scan(d).count() == 1
    out = secrets.masked(spark, d, "")
    assert out.dtypes == d.dtypes and out.first()["text"] == "[SECRET]" and out.first()["n_chars"] == 8


# 8 Decontamination


def brute_leaks(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    win = defaultdict(set)
    for i, t in items:
        ws = split(t)
        k = min(10, len(ws))
        for s in range(len(ws) - k + 1 if ws else 0):
            win[tuple(ws[s : s + k])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        ws, hit, ids = split(t), set(), set()
        for k in {len(w) for w in win}:
            for s in range(len(ws) - k + 1):
                if (w := tuple(ws[s : s + k])) in win:
                    hit |= set(range(s, s + k))
                    ids |= win[w]
        out.append((i, len(ws), len(hit), sorted(ids)))
    return sorted(out, key=str)


def test_leaks_against_brute_force(spark, docs, empty):
    rng = random.Random(4)
    data, frame = sample_docs(spark, 4, 40, 30)
    items = [(1, "W1 w2"), (2, "w7"), (3, None), (4, "")] + [(10 + i, " ".join((rng.choice(data)[1] or "x").split(" ")[3:17])) for i in range(12)] + [(10, "w3, w4")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.check(frame, bench).collect()), key=str)
    assert got == brute_leaks(data, items)
    few = [(1, "quick brown fox"), (None, "lang lang")]
    got = decontaminate.check(docs, spark.createDataFrame(few, "item_id long, text string")).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == brute_leaks(texts, few)
    assert {r["n_hit"] for r in decontaminate.check(docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.check(empty, bench).isEmpty()


# 9 Jaccard join


def brute_components(docs):
    sets = {}
    for i, t in docs:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(ws[j : j + 5]) for j in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed,words,common", [(1, 14, 100_000), (2, 40, 3)])
def test_components_against_brute_force(spark, monkeypatch, seed, words, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    data, frame = sample_docs(spark, seed, 80, words)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(frame).collect()}
    assert got == brute_components(data)


def near_copies(seed, n=70, words=60):
    """One text with 0 to 8 words replaced, so that many members fail the similarity with many others."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        ws = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 3, 4, 8])):
            ws[rng.randrange(words)] = f"x{rng.randrange(40)}"
        out.append((i, " ".join(ws)))
    return out


@pytest.mark.parametrize("wide,block,elements", [(64, 512, 1 << 20), (1, 8, 1 << 20), (3, 512, 300)])
def test_near_copies_in_rows_and_in_blocks(spark, monkeypatch, wide, block, elements):
    for name, value in (("WIDE", wide), ("BLOCK", block), ("ELEMENTS", elements), ("ROUNDS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    data = near_copies(wide)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    want = brute_components(data)
    assert got == want and 1 < len({c for _, c in want.values()}) < 60


def test_deduped_keeps_rows_of_one_id_apart(spark):
    text = "one two three four five six seven eight"
    data = [(1, text, "a"), (1, "other words than those of the first row of that id", "b"), (2, text, "c"), (None, text, "d"), (None, "a text that no other row has in it", "e"), (3, None, "f"), (3, None, "g"), (2, text, "h")]
    names = ["doc_id", "text", "k", "t", "k2", "c0", "mark", "root", "nth", "_id", "_twice", "tag"]
    frame = spark.createDataFrame([(*r, *["z"] * 9) for r in data], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names[2:]))
    out = jaccard.deduped(spark, frame, "")
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert out.columns == names
    assert got == sorted([(1, text), (1, data[1][1]), (None, data[4][1]), (3, None)], key=str)


def test_signatures_meet_for_every_similar_pair():
    rng = np.random.default_rng(0)
    ends = jaccard.bands(400)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        k = int(rng.integers(0, max(1, len(a) // 6) + 1))
        b = np.unique(np.concatenate([a[k:], rng.integers(0, 2**63, int(rng.integers(0, k + 1)), dtype=np.uint64)]))
        same = len(np.intersect1d(a, b))
        if not len(b) or 100 * same < 75 * (len(a) + len(b) - same) or len(a) == len(b) == same:
            continue
        common = rng.choice(a, min(len(a), int(rng.integers(0, 5))), replace=False)
        common.sort()
        sa, sb = ({(i, need): set(g.tolist()) for g, i, need in jaccard._signatures(x, common, ends)} for x in (a, b))
        met = [(na, nb, len(x & y)) for (i, na), x in sa.items() for (j, nb), y in sb.items() if i == j]
        assert any(c >= max(na, nb) for na, nb, c in met), (len(a), len(b), same)


def test_component_cases(docs, empty):
    got = rows(jaccard.classes(docs))
    assert len(got) == 11
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[3]["n_shingles"] == 0 and by[6]["n_shingles"] == 1 and by[None]["component_id"] is None
    assert jaccard.classes(empty).isEmpty()


# 10 Language ID


def test_language(spark, empty):
    words = {"en": "the house and garden with trees", "fr": "la maison et le jardin avec arbres"}
    docs = spark.createDataFrame([(i, words[x], x) for i, x in enumerate(["en", "fr"] * 20)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    html = lambda lang, text: f'<html lang="{lang}"><body><script>la la la</script><p>{text}</p></body></html>'
    data = [(i, "http://a.fr/x", html("fr", words["fr"])) for i in range(6)] + [(10, "http://b.com/y", html("en", words["en"])), (11, "http://b.com/z", html("", "the trees")), (12, "http://a.fr/q", ""), (13, None, None)]
    got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(data, "page_id long, url string, html string"), model).collect()}
    assert len(got) == 10 and got[0]["lang"] == "fr" and got[10]["lang"] == got[11]["lang"] == "en" and got[12]["lang"] == "fr"
    assert all(0 < r["confidence"] <= 1 for r in got.values())
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert language.identify(none, model).isEmpty() and language.fit(empty) == {}
    assert {r["lang"] for r in language.identify(spark.createDataFrame(data, "page_id long, url string, html string"), {}).collect()} == {"und"}


def brute_language(pages, model):
    """Best language of each page by the sum of the four kinds of evidence, with plain loops."""
    langs, size = sorted(model), language.BUCKETS
    rows = {}
    for i, url, html in pages:
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html or "")
        ws = [w for w in re.split(r"[\x00-\x60\x7B-\x7F]+", re.sub(r"&#?[A-Za-z0-9]+;", " ", text).translate({c: c + 32 for c in range(65, 91)})) if w]
        lik = [language.TEMPER * sum(model[x][signed(spark_hash(w)) % size] for w in ws) for x in langs]
        u = (url or "").lower()
        host = (re.match(r"[a-z][a-z0-9+.-]*://([^/:?#]*)", u) or [0, ""])[1]
        said = (re.search(r"""(?i)<html[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", html or "") or [0, ""])[1][:2].lower()
        part, end = re.match(r"[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:/|$)", u), re.search(r"\.([a-z]{2})$", host)
        known = lambda m: m[1] if m and m[1] in langs else ""
        rows[i] = (lik, lik.index(max(lik)) if min(lik) < max(lik) else None, said if said in langs else "", known(part) or known(end), host, (re.search(r"([^.]*\.[^.]*)$", host) or [0, ""])[1])

    def votes(key, value):
        return [sum(1 for r in rows.values() if key(r) == value and r[1] == k) for k in range(len(langs))]

    def mixed(v, up):
        return [(x + language.STRENGTH * y) / (sum(v) + language.STRENGTH) for x, y in zip(v, up)]

    every = votes(lambda r: 0, 0)
    base = [(x + 1) / (sum(every) + len(langs)) for x in every]
    out = {}
    for i, (lik, _, said, address, host, domain) in rows.items():
        prior = mixed(votes(lambda r: r[4], host), mixed(votes(lambda r: r[5], domain), base))
        post = [a + math.log(p) for a, p in zip(lik, prior)]
        for at, value in ((2, said), (3, address)):
            v, sums = votes(lambda r: r[at], value), every
            post = [p + math.log((x + language.PRIOR) / (s + language.PRIOR * (len(langs) + 1))) for p, x, s in zip(post, v, sums)]
        out[i] = (langs[post.index(max(post))], 1 / sum(math.exp(p - max(post)) for p in post))
    return out


def test_language_against_brute_force(spark):
    rng = random.Random(6)
    voc = {"en": "the house and garden with trees", "fr": "la maison et le jardin avec arbres", "de": "das haus und der garten mit la le"}
    docs = spark.createDataFrame([(i, " ".join(rng.choices(voc[x].split(), k=8)), x) for i, x in enumerate(["en", "fr", "de"] * 12)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    hosts = ["a.fr", "www.a.fr", "b.com", "x.b.com", "c.de", ""]
    pages = []
    for i in range(60):
        text = " ".join(rng.choices(" ".join(voc.values()).split(), k=rng.randrange(7)))
        pages.append((i, rng.choice([f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/de/x', '/fr', '/enx/'])}", None]), rng.choice([f"<html lang='{rng.choice(['en', 'fr-CA', 'xx', 'de'])}'><p>{text}</p></html>", f"<p>{text}&nbsp;</p><!-- das haus -->", None])))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: language.F.lit("z") for c in ("host", "lang", "guess", "prior", "b")})
    got = {r["page_id"]: (r["lang"], r["confidence"]) for r in language.identify(frame, model).collect()}
    want = brute_language(pages, model)
    assert {i: c for i, (_, c) in got.items()} == {i: pytest.approx(c, rel=1e-6) for i, (_, c) in want.items()}
    assert all(got[i][0] == x for i, (x, c) in want.items() if c > 0.51)


# Bytes


def test_word_hashes_do_not_depend_on_place():
    texts = ["Aa bb", None, "", "x aa  BB\tcc", "ä é aa"]
    out = []
    for size in (1, 6, 1 << 20):
        got = []
        for _, _, data, off in bytesvec.blocks(pa.array(texts), size):
            h, at = bytesvec.word_hashes(data, off)
            got += [h[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        out.append(got)
    assert out[0] == out[1] == out[2] and [len(x) for x in out[0]] == [2, 0, 0, 4, 3]
    assert out[0][0] == out[0][3][1:3] and out[0][4][2] == out[0][0][0]
