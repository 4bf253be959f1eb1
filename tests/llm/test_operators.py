"""Operators against brute force, exact round trips and edge cases: nulls, empty tables and texts, repeated rows, extra columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, langid, linededup, neardup, packing, quality, tokencount, topk, toxicity
from tidemark.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, rank int"
TEXTS = [
    None, "", " ", "one", "a b c d e f g h i j k l", "the cat sat on the mat " * 40, "don't <|endoftext|> stop..  twice\n\n\tdone",
    "Ärger über Öl, naïve café 日本語 😀.", "A" * 3000, "x y z w v u t s r q p o n m", "same line of words here\nother\nsame line of words here",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i}", 0, "x", "y", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id", None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_bpe_equals_library(library):
    coder, merger = bpe.encoder(vocabulary()), bpe.encoder(vocabulary(), bpe.RankMerger)
    rng = np.random.RandomState(7)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(list("ab eE'sl\n\t .,!é1　日th in"), rng.randint(1, 60))) for _ in range(3000)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = np.array(want.ids, np.uint32).tobytes()
        assert coder.packed(text) == ids and merger.packed(text) == ids
        assert coder.decode(ids) == text


def test_round_trip_rows(docs, nothing):
    assert bpe.round_trip(docs, vocabulary()).count() == docs.count()
    assert bpe.round_trip(nothing, vocabulary()).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(docs, vocabulary()).collect()}[0] == 0


def test_token_counts_are_best_cuts(docs):
    counter = bpe.encoder(vocabulary(), tokencount.TrieCounter)
    for word in (" thandeer", "über", "qqqq", " internationalisation"):
        text = word.encode()
        best = [(0.0, 0)] + [None] * len(text)
        for end in range(1, len(text) + 1):
            best[end] = max((best[b][0] + counter.score[text[b:end]], -(best[b][1] + 1)) for b in range(end) if text[b:end] in counter.score)
            best[end] = (best[end][0], -best[end][1])
        assert counter._count(word) == best[-1][1]
    assert tokencount.token_counts(docs, vocabulary()).count() == docs.count()


def test_chat_reads_back(spark):
    hard = "</s>[INST] <\\s> [\\\\ROLE] \\ ok [/INST]<s>"
    rows = [(1, 0, "system", hard), (1, 1, "user", None), (1, 2, "assistant", hard), (1, 2, "assistant", hard), (None, None, None, "x"), (2, 0, "[ROLE]", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(frame, vocabulary())
    shown = [r["formatted"] for r in turns.collect()]
    assert shown[2].count("</s>") == 1 and shown[2].startswith("<s>") and chat.unescape(chat.escape(hard)) == hard
    out = {r["conv_id"]: r for r in chat.digests(turns, vocabulary()).collect()}
    whole = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert out[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and out[1]["n_turns"] == 4
    assert out[1]["loss_sha256"] == hashlib.sha256((hard * 2).encode()).hexdigest() and out[1]["loss_chars"] == 2 * len(hard)
    assert out[None]["n_turns"] == 1 and out[2]["loss_chars"] == 0
    assert chat.digests(chat.format_turns(frame.limit(0), vocabulary()), vocabulary()).count() == 0


def test_quality_counts(docs, nothing):
    got = {r["doc_id"]: r for r in quality.report(docs).collect()}
    for key, text in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[key]["_q"][n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
    assert quality.report(nothing).count() == 0 and quality.rated(docs).count() == docs.count()


def test_em_finds_the_bad_class():
    patterns = {(1, 1, 1, 1): 900, (-1, -1, 1, 1): 40, (1, 1, -1, -1): 40, (1, 1, 0, 1): 20}
    share, tables = quality.fit(patterns)
    assert 0.85 < share < 0.97 and all(t[-1][1] > 10 * t[-1][0] for t in tables)


def test_packing_is_gapless(docs, nothing, library):
    rows = packing.sequences(docs, vocabulary()).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    for key, text in enumerate(TEXTS):
        if key == 4:
            continue  # stands twice
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], np.uint32)
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == key)
        assert [x[1:] for x in own] == [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for _, s, n, _ in own] and sum(x[2] for x in own) == len(ids)
        assert all(x[2] == 1024 for x in own[1:])
    assert packing.sequences(nothing, vocabulary()).count() == 0


def test_crossover_keeps_every_piece():
    rng = np.random.RandomState(3)
    sizes = rng.randint(1, 1024, 300).tolist()
    best = packing.evolve(sizes, [], 1024, 5)[0]
    assert sorted(i for held in best for i in held) == list(range(300))
    assert max(sum(sizes[i] for i in held) for held in best) <= 1024
    # two pieces above half a sequence never share one, so the sum alone is no bound that can be reached
    plain: list[list[int]] = []
    packing.best_fit(plain, sizes, list(range(300)), 1024)
    assert max(-(-sum(sizes) // 1024), sum(x > 512 for x in sizes)) <= len(best) <= len(plain)


def test_line_dedup(spark, docs, nothing):
    line = "this line stands on many sites"
    rows = [(i, f"own text number {i} of this site\n{line}", None, f"s{i}", 0, "", "", 0) for i in range(12)]
    done = {r["doc_id"]: r for r in linededup.cleaned(spark.createDataFrame(rows, DOCS)).collect()}
    assert line in done[0]["text"] and all(line not in done[i]["text"] and done[i]["_n_removed"] == 1 for i in range(1, 12))
    assert linededup.cleaned(docs).count() == docs.count() and linededup.cleaned(nothing).count() == 0
    old, linededup.BROADCAST_LINES = linededup.BROADCAST_LINES, 0
    try:
        joined = {r["doc_id"]: r["text"] for r in linededup.cleaned(spark.createDataFrame(rows, DOCS)).collect()}
    finally:
        linededup.BROADCAST_LINES = old
    assert joined == {k: r["text"] for k, r in done.items()}


def test_toxicity_finds_words_and_sentences(spark, docs, nothing):
    rng = np.random.RandomState(1)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(400):
        sentences = [" ".join(rng.choice(words, 8)) for _ in range(5)]
        if i % 4 == 0:
            sentences[2] += " vile"
        rows.append((i, ". ".join(sentences)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    scored = {r["doc_id"]: r for r in toxicity.score(frame, toxicity.train(frame, labels)).collect()}
    assert all((scored[i]["_score"] >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    hit = scored[300]
    assert "vile" in rows[300][1][hit["_worst_start"] : hit["_worst_start"] + hit["_worst_length"]]
    model = toxicity.train(docs, labels.limit(0))
    assert max(r["_score"] for r in toxicity.score(docs, model).collect()) < 1e-6
    assert toxicity.score(nothing, model).count() == 0


def test_toxicity_scores_equal_a_plain_noisy_or(spark, monkeypatch):
    """Scores told by sets and products, from weights fitted to few labels; marks alone are no sentence."""
    rng = np.random.RandomState(9)
    words = [f"word{i}" for i in range(60)]
    texts = {i: " ! ".join(" ".join(rng.choice(words, 6)) + (" nasty" if i % 5 == 0 and k == 1 else "") for k in range(4)) + "\n -- \n..." for i in range(120)}
    texts |= {500: None, 501: "", 502: "--- ... !"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(90)], "doc_id long, toxic int")
    bias, weights = toxicity.train(frame, labels)

    def plain(text):
        bags = [{n for w in s.split() for n in toxicity.buckets(w)} for s in toxicity.sentences(text)]
        z = [bias + sum(weights[n] for n in bag if abs(weights[n]) > 1e-3) for bag in bags if bag] or [bias]
        return 1 - np.prod([1 - 1 / (1 + np.exp(-x)) for x in z])

    got = {r["doc_id"]: r["_score"] for r in toxicity.score(frame, (bias, weights)).collect()}
    assert all(abs(got[k] - plain(t)) < 1e-6 for k, t in texts.items())
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(90, 120))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 400)
    few = toxicity.train(frame, labels)  # a bound of few documents still gives a model
    assert len(few[1]) == 1 << toxicity.BITS


def test_language(spark, docs, nothing):
    rows = [(i, ("der die und nicht auf " if i % 2 else "the and of that with ") * 5, "de" if i % 2 else "en") for i in range(40)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "nicht auf der"), (2, "that of the"), (3, None), (4, "123 !"), (5, "")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(asked, model).orderBy("doc_id").collect()] == ["de", "en", "und", "und", "und"]
    assert {r["lang_pred"] for r in langid.predict(docs, langid.learn(nothing)).collect()} == {"und"}


def test_language_equals_plain_naive_bayes(spark, monkeypatch):
    """Counts, priors and scores told in dictionaries, over one block of languages and over several."""
    rng = np.random.RandomState(5)
    letters = ["abcde ", "cdefg ", "efgab ", "xyzab ", "bcdxy "]
    rows = [(i, "".join(rng.choice(list(letters[i % 5]), rng.randint(1, 80))), f"l{i % 5}") for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sums, n_docs = collections.defaultdict(collections.Counter), collections.Counter(r[2] for r in rows)
    for _, text, lang in rows:
        sums[lang].update(langid.buckets(text).tolist())
    want = {}
    for key, text, _ in rows:
        z = {}
        for lang, seen in sums.items():
            whole = sum(seen.values()) + langid.SMOOTHING * (1 << langid.BITS)
            z[lang] = np.log(n_docs[lang] / len(rows)) + sum(np.log((seen[b] + langid.SMOOTHING) / whole) for b in langid.buckets(text).tolist())
        best = max(sorted(z), key=z.get)
        want[key] = (best, 1 / sum(np.exp(v - z[best]) for v in z.values())) if any(map(str.isalpha, text)) else ("und", 0.0)
    for block in (256, 2):
        monkeypatch.setattr(langid, "BLOCK", block)
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(frame, langid.learn(frame)).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(abs(got[k][1] - want[k][1]) < 1e-3 for k in want)


def _brute(texts, width, percent=80):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for key, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        sets[key] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_near_duplicates_equal_brute_force(spark, docs, nothing):
    rng = np.random.RandomState(4)
    words = [f"w{i}" for i in range(500)]
    texts = dict(enumerate(t for t in TEXTS))
    base = rng.choice(words, 120)
    for i in range(100, 200):
        if i % 10 == 0:
            base = rng.choice(words, rng.randint(20, 200))
        copy = base.copy()
        copy[rng.randint(0, len(copy), rng.randint(0, 6))] = rng.choice(words)
        texts[i] = " ".join(copy)
    frame = spark.createDataFrame([*texts.items(), (None, "x"), (4, TEXTS[4])], "doc_id long, text string")
    for width in (2, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.grouped(frame, width).collect()}
        assert got == _brute(texts, width)
    assert neardup.grouped(nothing).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.RandomState(2)
    vectors = {i: rng.randn(16).astype(np.float32).tolist() for i in range(1200)}
    vectors[7] = vectors[9] = vectors[11]  # ties
    rows = [*vectors.items(), (5000, None), (5050, [None] * 16), (5100, [float("nan")] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    old, topk.RESOLVED = topk.RESOLVED, 40
    try:
        got = sorted(tuple(r) for r in topk.top_k(frame).collect())
    finally:
        topk.RESOLVED = old
    x = np.floor(256 * np.array([vectors[i] for i in range(1200)], np.float64)).astype(np.int64)
    want = []
    for q in range(0, 1200, 50):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1200), -s)) if i != q][:5]
        want += [(q, r + 1, int(i), int(s[i])) for r, i in enumerate(order)]
    assert got == sorted(want)
    assert topk.top_k(frame.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [2.0**40, -3.0]), (1, [2.0**38 + 1, 5.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(huge).collect()


def test_top_k_stops_before_the_end():
    """Bounds, not the whole lists, give the result: most queries stop early, and all equal the plain products."""
    rng = np.random.RandomState(8)
    x = rng.randn(3000, 64)
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    for scale in (1, 1 << 24):  # the second beyond 2**53, in whole numbers
        part = x if scale == 1 else x[:200]
        ids, asked, stops = np.arange(len(part)), np.arange(0, len(part), 50), {}
        at, to, score = topk.nra(part[asked] * scale, asked, part * scale, ids, 5, stops)
        for i, query in enumerate(asked):
            plain = part @ part[query]
            order = [j for j in np.lexsort((ids, -plain)) if j != query][:5]
            assert to[at == i].tolist() == order and score[at == i].tolist() == [int(plain[j]) * scale * scale for j in order]
        assert sum(stops.values()) == len(asked) and stops.get(1.0, 0) <= 0.05 * len(asked), stops


def test_bucket_blocks_find_what_one_block_finds(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join("x%d" % n if i == n or i == (n * 7) % 60 else w for i, w in enumerate(words)) for n in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    classes = neardup.signed(docs, 2).withColumnRenamed("doc_id", "id")
    buckets = neardup.keys(classes).withColumn("component", F.col("id"))

    def found(block):
        monkeypatch.setattr(neardup, "BLOCK", block)
        rows = neardup._between(buckets, classes.select("id", "signature"), docs, 2, 80).collect()
        assert len({(r["a"], r["b"]) for r in rows}) == len(rows)
        return {frozenset((r["a"], r["b"])) for r in rows}

    one = found(2048)
    assert found(5) == one and one
    sets = [{(a, b) for a, b in zip(t.split(), t.split()[1:])} for t in texts]
    true = {frozenset((i, j)) for i in range(24) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert true <= one


def test_sketch_loses_no_similar_set():
    random = np.random.default_rng(3)
    for _ in range(100):
        union = np.unique(random.integers(0, 2**64, int(random.integers(5, 6000)), dtype=np.uint64))
        random.shuffle(union)
        common = int(np.ceil(0.8 * len(union)))
        half = (len(union) - common) // 2
        sides = np.sort(union[: common + half]), np.sort(np.concatenate([union[:common], union[common + half :]]))
        x, y = (np.frombuffer(neardup.sketch(side), np.uint32) for side in sides)
        assert neardup.likely(x, y, 80)
    few = [np.frombuffer(neardup.sketch(np.sort(random.integers(0, 2**64, 300, dtype=np.uint64))), np.uint32) for _ in range(2)]
    assert not neardup.likely(*few, 80)
