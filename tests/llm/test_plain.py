"""Plain versions of the classifier and of the pipeline's stages, on small tables with planted cases."""

from __future__ import annotations

import base64
import math
import random
import re
from collections import Counter

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
pytest.importorskip("matchloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from matchloom.llm import decontaminate, line_dedup, toxicity  # noqa: E402
from test_operators import DOCUMENTS, groups, prose  # noqa: E402

# -- classifier


def plain_features(text):
    words = re.findall(r"[a-z0-9]+", (text or "").lower())
    found = {("bias",)} | {("stem", w[: toxicity.STEM]) for w in words} | {("word", w) for w in words}
    return found | {(step, a, b) for step in (1, 2) for a, b in zip(words, words[step:])}


def plain_ftrl(rows):
    z, n = Counter(), Counter()

    def weight(f):
        if abs(z[f]) <= toxicity.L1:
            return 0.0
        shrunk = math.copysign(abs(z[f]) - toxicity.L1, z[f])
        return -shrunk / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for label, features in rows:
            w = {f: weight(f) for f in features}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for f in features:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
                n[f] += g * g
    return lambda features: 1 / (1 + math.exp(-sum(weight(f) for f in features)))


def test_scores_equal_plain_ftrl(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(["ab", "cd", "efghij", "Bad", "x1"]) for _ in range(1 + i % 6))) for i in range(60)]
    marks = [(i, int("Bad" in t)) for i, t in docs if i % 3]
    documents, labels = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, label int")
    found = dict(toxicity.scored(documents, toxicity.fit(documents, labels)).select("doc_id", "score").collect())
    turns = dict(spark.range(60).select("id", F.xxhash64(F.col("id").cast("string"))).collect())
    texts = dict(docs)
    score = plain_ftrl([(label, plain_features(texts[i])) for i, label in sorted(marks, key=lambda m: turns[m[0]])])
    assert max(abs(found[i] - score(plain_features(t))) for i, t in docs) < 1e-9
    assert max(found.values()) > 0.5 > min(found.values())


# -- stages of the pipeline


def plain_lines(docs, sketches):
    """Lines above a tenth of a source's documents go, documents of one sketch counting once."""
    pages, carried = {}, {}
    for place, text, _, source, _ in docs:
        pages.setdefault(source or "", set()).add(sketches[place])
        for line in re.split(r"\r\n|\n|\r", text or ""):
            if line.strip():
                carried.setdefault((source or "", line.strip()), set()).add(sketches[place])
    bad = {key for key, of in carried.items() if len(of) > 1 and len(of) > 0.1 * len(pages[key[0]])}
    out = []
    for i, text, lang, source, n_chars in docs:
        lines = re.split(r"\r\n|\n|\r", text or "")
        kept = [line for line in lines if (source or "", line.strip()) not in bad]
        if len(kept) < len(lines) and any(line.strip() for line in kept):
            text, n_chars = "\n".join(kept), len("\n".join(kept))
        out.append((i, text, lang, source, n_chars))
    return out


def plain_near(docs):
    kept = [place for place, _, _, kept in groups([t for _, t, *_ in docs]) if kept]
    return [docs[place] for place in kept]


def plain_words(text):
    return re.findall(decontaminate.WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_clean(docs, items):
    windows = set()
    for text in items:
        words = plain_words(text)
        size = min(10, len(words))
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        words = plain_words(text)
        return any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    return [d for d in docs if not hit(d[1])]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with planted cases, and what each is; labels and benchmark beside them as files."""
    rng = random.Random(8)
    text = lambda seed: "\n".join(prose(seed, 4, 30))
    exam = [" ".join(f"exam{rng.randrange(900)}" for _ in range(n)) for n in (14, 12, 4)]
    rows, kinds = [], []

    def add(kind, body, source):
        rows.append((len(rows), body, "en", source, len(body or "")))
        kinds.append(kind)

    for i in range(60):
        add("clean", text(100 + i), f"s{i % 3}")
    for i in range(30):
        add("clean", f"Menu Home\n{text(200 + i)}\n© all rights", "s0")
    for i in range(24):
        add("toxic", f"{' '.join(rng.choice(['vile', 'curse', 'scum', 'hateful']) for _ in range(40))} {prose(300 + i, 1, 20)[0]}", f"s{i % 2}")
    base = [text(400), text(401)]
    for i in range(40):  # more than a tenth of their source: exact and near copies
        add("copy", base[0] if i % 2 else base[0] + f" tail{i}", "s1")
    for i in range(5):
        add("copy2", base[1], f"s{i}")
    for i in range(9):
        add("leak", f"{text(500 + i)} {exam[i % 2].upper() if i % 4 else exam[2]} end", "s2")
    add("menu", "Menu Home", "s0")
    for odd in (None, "", " \n\n ", "one two"):
        add("odd", odd, None)
    folder = tmp_path_factory.mktemp("planted")
    marks = [(i, 1, int(kind == "toxic")) for i, kind in enumerate(kinds) if i % 2 or kind == "clean"]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = list(enumerate([*exam, None, ""]))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, kinds, [t for _, t in items], str(folder)


def test_stages_equal_plain_versions(spark, planted):
    rows, kinds, items, folder = planted
    stages = dict(corpus_pipeline.STAGES)
    collected = lambda frame: sorted(map(tuple, frame.collect()))
    docs = stages["toxicity"](spark, spark.createDataFrame(rows, DOCUMENTS), folder)
    kept = collected(docs)
    assert {r[0] for r in kept} == {i for i, kind in enumerate(kinds) if kind != "toxic"}
    assert kept == [r for r in rows if kinds[r[0]] != "toxic"]
    values = docs.select("doc_id", line_dedup.sketch(F.col("text")).alias("s")).collect()
    sketches = {r.doc_id: r.s for r in values}
    copies = [i for i, kind in enumerate(kinds) if kind == "copy"]
    assert len({sketches[i] for i in copies}) <= 3 and len(set(sketches.values())) > 90
    for name, plain in (("line_dedup", lambda d: plain_lines(d, sketches)), ("near_dedup", plain_near), ("decontamination", lambda d: plain_clean(d, items))):
        want = plain(kept)
        kept = collected(stages[name](spark, spark.createDataFrame(kept, DOCUMENTS), folder))
        assert kept == want, name
    left = Counter(kinds[r[0]] for r in kept)
    assert left == {"clean": 90, "copy": 1, "copy2": 1, "menu": 1, "odd": 4}
    assert not any("Menu Home" in (r[1] or "") for r in kept if kinds[r[0]] == "clean")
    ranks = dict((base64.b64decode(a), int(b)) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb")))
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = stages["byte_bpe"](spark, spark.createDataFrame(kept, DOCUMENTS), folder).collect()
    assert {r.doc_id: r.ids for r in out} == {r[0]: known.encode_ordinary(r[1] or "") for r in kept}
    assert all(r.decodes_back and r.n_tokens == len(r.ids) for r in out)
