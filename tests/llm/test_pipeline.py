"""Stages of the pipeline, and the whole of it, against plain formulations on small documents."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import linededup, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


def _documents():
    rng = np.random.RandomState(12)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "tra") for b in ("ne", "ru", "so") for c in ("k", "lt", "ma", "r", "nd")]
    shared = "a passage that stands on many sites and is long enough to matter to all of them"
    rows, base = [], None
    for i in range(260):
        if base is None or i % 13 == 0:
            base = rng.choice(words, rng.randint(30, 90)).tolist()
        own = list(base)
        for at in rng.randint(0, len(own), rng.randint(0, 3)):
            own[at] = rng.choice(words)
        parts = [" ".join(own[k : k + 9]) for k in range(0, len(own), 9)]
        if i % 9 == 0:
            parts.insert(1, shared)
        if i % 17 == 0:
            parts[0] += " vermin filth vermin"
        if i % 23 == 0:
            parts = ["# $ % & * | < >" for _ in range(6)]
        rows.append((i, "\n".join(parts), "en", f"s{i % 11}", 1))
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, "word " * 400, "en", "s2", 2000), (303, rows[5][1], "en", "s3", 1), (303, rows[5][1], "en", "s3", 1), (None, rows[7][1], "en", "s4", 1)]
    rows += [(400, "one text that is alone but for its own second row and has a good many words", "en", "s5", 1)] * 2
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = _documents()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, int("vermin" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] % 3 != 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _plain_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(s) for s in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_lines": len(lines), "n_exclaims": text.count("!"), "n_upper": sum(c.isupper() for c in text), "n_distinct": len(set(words)),
    }


def _plain_votes(q):
    words, chars = max(q["n_words"], 1), max(q["word_chars"], 1)
    length, per = q["word_chars"] / words, lambda name: q[name] / words
    rules = [
        (q["n_words"] < 5, q["n_words"] >= 10), (length < 2 or length > 14, 3 <= length <= 11), (per("n_symbols") >= 0.15, per("n_symbols") <= 0.03), (q["n_symbols"] / chars >= 0.04, q["n_symbols"] / chars <= 0.01),
        (per("n_repeat_words") > 0.2, per("n_repeat_words") <= 0.05), (q["n_words"] >= 40 and per("n_distinct") < 0.02 + 1.5 / math.sqrt(words), q["n_words"] < 40 or per("n_distinct") >= 0.02 + 3 / math.sqrt(words)),
        (q["n_upper"] / chars > 0.4, q["n_upper"] / chars <= 0.15), (per("n_exclaims") >= 0.3, per("n_exclaims") <= 0.1), (q["n_lines"] >= 4 and q["n_dup_lines"] / max(q["n_lines"], 1) > 0.3, q["n_dup_lines"] == 0),
    ]
    return [-1 if bad else 1 if good else 0 for bad, good in rules]


def _plain_em(votes):
    """EM row by row, without patterns: responsibilities of every document in every round."""
    share, weight, n_rules = 0.85, quality.PRIOR_SHARE * len(votes), len(votes[0])
    good = [dict(quality.PRIOR_GOOD) for _ in range(n_rules)]
    bad = [dict(quality.PRIOR_BAD) for _ in range(n_rules)]

    def posterior(v):
        p, q = share * math.prod(t[x] for t, x in zip(good, v)), (1 - share) * math.prod(t[x] for t, x in zip(bad, v))
        return p / (p + q)

    for _ in range(quality.ROUNDS):
        r = [posterior(v) for v in votes]
        total = sum(r)
        new_good = [{x: (weight * quality.PRIOR_GOOD[x] + sum(p for p, v in zip(r, votes) if v[j] == x)) / (total + weight) for x in (1, -1, 0)} for j in range(n_rules)]
        new_bad = [{x: (weight * quality.PRIOR_BAD[x] + sum(1 - p for p, v in zip(r, votes) if v[j] == x)) / (len(votes) - total + weight) for x in (1, -1, 0)} for j in range(n_rules)]
        share, good, bad = (total + 0.85 * weight) / (len(votes) + weight), new_good, new_bad
    return [posterior(v) for v in votes]


def _plain_poor(rows):
    counts = [_plain_counts(r[1]) for r in rows]
    keep = [p >= quality.KEEP_AT for p in _plain_em([_plain_votes(q) for q in counts])]
    return [r for r, q, k in zip(rows, counts, keep) if k and q["n_words"] >= 10 and 100 * q["n_repeat_words"] <= 20 * q["n_words"]]


def _plain_lines(rows):
    sites, first = collections.defaultdict(set), {}
    for key, text, _, source, _ in rows:
        if key is None:
            continue
        for at, line in enumerate((text or "").split("\n") if text is not None else ()):
            if re.search(WORD, line):
                sites[line] |= {source} - {None}
                first[line] = min(first.get(line, (key, at)), (key, at))
    out = []
    for key, text, lang, source, n in rows:
        if key is None or text is None:
            out.append((key, text, lang, source, n))
            continue
        parts = text.split("\n")
        kept = [x for at, x in enumerate(parts) if len(sites.get(x, ())) < linededup.MIN_SITES or first[x] == (key, at)]
        if len(kept) < len(parts) and not re.search(WORD, "\n".join(kept)):
            continue
        out.append((key, "\n".join(kept), lang, source, n if len(kept) == len(parts) else len("\n".join(kept))))
    return out


def _plain_near(rows, width=5):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for key, text, *_ in rows:
        if key is not None:
            w = re.findall(WORD, (text or "").translate(fold))
            sets[key] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out, seen = [], set()
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if r[0] is None or find(r[0]) == r[0] and r[0] not in seen:
            out.append(r)
            seen.add(r[0])
    return out


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_toxic_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    bias, weights = toxicity.train(docs, labels)

    def score(text):
        bags = [{n for w in s.split() for n in toxicity.buckets(w)} for s in toxicity.sentences(text)]
        z = [bias + sum(weights[n] for n in bag if abs(weights[n]) > 1e-3) for bag in bags if bag] or [bias]
        return 1 - np.prod([1 - 1 / (1 + np.exp(-x)) for x in z])

    want = [r for r in _documents() if score(r[1]) < toxicity.THRESHOLD]
    got = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert got.columns == docs.columns and _rows(got) == sorted(want, key=str)
    toxic = {r[0] for r in _documents() if "vermin" in (r[1] or "")}
    assert not toxic & {r[0] for r in want} and len(want) == len(_documents()) - len(toxic)


def test_quality_stage_and_posterior(spark, folder):
    rows = _documents()
    docs = spark.createDataFrame(rows, DOCS)
    assert _rows(corpus_pipeline.drop_poor(spark, docs, folder)) == sorted(_plain_poor(rows), key=str)
    clash = docs.withColumns({"_q": F.lit(1), "_keep": F.lit("x"), "_row": F.lit(2), "_text": F.lit(3)})
    rated = quality.rated(clash)
    assert rated.where("_keep").count() == len(_plain_poor(rows)) and rated.where("_row = 2 AND _text = 3").count() == len(rows)
    # what EM adds: estimates from the rows reject what fixed tables alone would not tell apart
    assert quality.rated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [linededup.BROADCAST_LINES, 0])
def test_line_stage(spark, folder, monkeypatch, most):
    monkeypatch.setattr(linededup, "BROADCAST_LINES", most)
    rows = _documents()
    got = corpus_pipeline.drop_boilerplate(spark, spark.createDataFrame(rows, DOCS), folder)
    assert _rows(got) == sorted(_plain_lines(rows), key=str)


def test_documents_emptied_of_boilerplate_are_dropped(spark):
    copied = "first line of a copied text\n\nsecond line of a copied text"
    rows = [(i, copied, "en", f"s{i % 12}", len(copied)) for i in range(40)]
    rows += [(100, "", "en", "s1", 0), (101, None, "en", "s1", None), (102, f"{copied}\nand its own", "en", "s2", 70), (None, copied, "en", "s3", len(copied))]
    done = {r["doc_id"]: r for r in corpus_pipeline.drop_boilerplate(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert set(done) == {0, 100, 101, 102, None}
    assert done[0]["text"] == done[None]["text"] == copied and done[100]["text"] == "" and done[101]["text"] is None
    assert done[102]["text"].strip() == "and its own" and done[102]["n_chars"] == len(done[102]["text"])


def test_near_duplicate_stage(spark, folder):
    rows = _documents()
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), folder)
    assert _rows(got) == sorted(_plain_near(rows), key=str)


def test_whole_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    clean = [tuple(r)[:5] for r in toxicity.score(docs, model).where(F.col("_score") < toxicity.THRESHOLD).collect()]
    left = _plain_near(_plain_lines(_plain_poor(clean)))
    out = corpus_pipeline.run(spark, folder).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.vocabulary())
    want = collections.Counter()
    for key, text, *_ in left:
        want[key, zlib.crc32(np.array(library.encode(text or "", add_special_tokens=False).ids + [2], np.uint32).tobytes())] += 1
    whole = collections.Counter((r["doc_id"], r["ids_crc32"]) for r in out if r["start"] == 0)
    assert whole == want and len(out) == len(left)
