"""Every operator against a plain version of itself, and on rows that usually break things."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
pytest.importorskip("matchloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from matchloom.llm import (  # noqa: E402
    bpe, decontaminate, graphs, line_dedup, near_dup, pii, pitman_yor, substring_dedup, token_files, toxicity,
    vector_search,
)

RANKS, TOKENIZER = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside.
CLASHING = ", label int, score double, part bigint, site string, lines array<string>, found string, ids int, class int, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

ODD_TEXTS = [
    None, "", "   \t\n ", "one", "One one ONE", "a b c d e", "a b c d e", "a b c d e", "\x00\x1c\x85\xa0 é 中文  x",
    "word " * 3000, "x" * 20000, " mail me@example.org now ", "<|endoftext|> hi <|endoftext|>", "🙂 🙂🙂   end",
]


def frame(spark, texts, extra=True):
    rows = [(i, t, "en", "src", len(t or "")) + ((7, 0.5, 1, "s", ["l"], "f", 3, 4, 5) if extra else ()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS + (CLASHING if extra else ""))


def prose(seed, n, size=40):
    rng = random.Random(seed)
    words = ["w" + "".join(rng.choice("abcde") for _ in range(3)) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = frame(spark, ODD_TEXTS).union(frame(spark, [None]).withColumn("doc_id", F.lit(None).cast("bigint"))).cache()
    yield rows
    rows.unpersist()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).limit(0)


# -- near duplicates


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    return [(i, len(s), x, i == x) for i, (s, x) in enumerate(zip(sets, label))]


def edited(text, rng, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(99))
    return " ".join(words)


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(3)
    texts = [t for t in prose(1, 60, 60) if len(t.split()) > 20]
    texts += [edited(rng.choice(texts), rng, rng.choice([0, 1, 1, 2])) for _ in range(150)] + ODD_TEXTS
    rng.shuffle(texts)
    found = near_dup.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == groups(texts)


@pytest.mark.parametrize("slots", [1 << 20, 64])
def test_crowded_keys_meet_by_rare_shingles(spark, monkeypatch, slots):
    monkeypatch.setattr(near_dup, "ROW_PAIRS", 3)
    monkeypatch.setattr(near_dup, "RARITY_SLOTS", slots)
    rng, base = random.Random(4), " ".join(f"p{i}" for i in range(40))
    # One passage with endings of growing length: links in chains, and many pairs that are none.
    texts = [base + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 14))) for _ in range(90)]
    texts += [edited(base + " " + " ".join(f"r{i}" for i in range(rng.randrange(30))), rng, rng.randrange(5)) for _ in range(90)]
    found = near_dup.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == groups(texts)


def test_prefixes_of_linked_sets_share_a_shingle():
    rng = random.Random(5)
    for _ in range(3000):
        n, m = sorted((rng.randrange(1, 60), rng.randrange(1, 60)))
        both = rng.randrange(n + 1)
        if 100 * both < 75 * (n + m - both):
            continue
        order = rng.sample(range(n + m - both), n + m - both)  # the worst a common order can do is not avoided
        one, two = sorted(order[:n]), sorted(order[n - both :])
        short = n - -(-6 * n // 7) + 1
        assert set(one[:short]) & set(two[: near_dup._prefix(m, 75, 100)])
        assert near_dup._prefix(m, 75, 100) == m - -(-3 * m // 4) + 1


def test_hamming_keys_cover_the_distance():
    rng = np.random.RandomState(0)
    one = rng.randint(0, 2**16, near_dup.SYMBOLS).astype(np.uint16)
    for _ in range(50):  # 23 changed symbols of 48: some chunk of 4 has at most one
        two = one.copy()
        two[rng.permutation(near_dup.SYMBOLS)[:23]] ^= 1
        chunks = (one != two).reshape(-1, near_dup.CHUNK).sum(axis=1)
        assert chunks.min() <= 1


def test_near_duplicates_of_odd_rows(odd, empty):
    found = {r.doc_id: r for r in near_dup.near_duplicates(odd).collect()}
    assert found[None].component_id is None and found[None].kept
    assert (found[0].n_shingles, found[0].kept, found[2].kept) == (0, True, True)
    assert [found[i].component_id for i in (5, 6, 7)] == [5, 5, 5]
    assert near_dup.deduplicated(odd).columns == odd.columns
    assert near_dup.deduplicated(odd).count() == odd.count() - 2
    assert near_dup.near_duplicates(empty).count() == 0


def test_components_of_a_long_path(spark):
    path = spark.range(200).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    assert graphs.components(path).where("label <> 0").count() == 0


# -- personal data

PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_plain_search(spark):
    rng = random.Random(5)
    parts = ["a@b.co", "x.y@c-d.e.f_g@h.i", "@", ".", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.1.1.255", "4111 1111 1111 1111",
             "4111-1111-1111-1111-9", "12345678901234567890", "+49 (30) 1234567", "+1", "+12 3", "🙂", " ", "é", "9", "-", "+5-5-5-5-5-5-5-5)"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += ["a" * 50000, "1" * 50000, "1 " * 20000, "a." * 20000 + "@", "a@" + "b." * 20000 + "c", "+1" + "2" * 9999, *ODD_TEXTS]
    rows = pii.digests(pii.with_personal_data(frame(spark, texts))).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        base = base_spans(text)
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        assert (row.n_email, row.n_phone) == (sum(s[:2] == "em" for s in base), sum(s[:2] == "ph" for s in base))


def test_checksums_and_context_decide_on_added_kinds(spark, odd, empty):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "IBAN DE89 3704 0044 0532 0130 01.", "xDE89370400440532013000",
             "SSN 123-45-6789", "part 123-45-6789", "SSN 000-45-6789"]
    rows = pii.digests(pii.with_personal_data(frame(spark, texts))).orderBy("doc_id").collect()
    assert [r.spans for r in rows] == ["iban:5:32", "", "", "ssn:4:15", "", ""]
    out = pii.redacted(frame(spark, ["to a@b.co or +49 30 1234567!", "none", None])).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["to [EMAIL] or [PHONE]!", "none", None]
    assert pii.with_personal_data(odd).count() == odd.count() and pii.with_personal_data(empty).count() == 0


# -- tokens


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_decodes(spark, odd, empty, encoding):
    texts = [*ODD_TEXTS, *prose(2, 20), "aaaaaaaaaaaaaaaaaaaaab" * 500, "naïve façade ½ ² \x1c \x1d\x85", "don't we'll 12345", "\n\n  a  \n b"]
    rows = bpe.decoded(bpe.encoded(frame(spark, texts), RANKS, P.PATTERN), RANKS).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        assert row.ids == encoding.encode_ordinary(text or "")
        assert bytes(row.data) == (text or "").encode()
    assert bpe.encoded(odd, RANKS, P.PATTERN).count() == odd.count()
    assert bpe.decoded(bpe.encoded(empty, RANKS, P.PATTERN), RANKS).count() == 0
    with pytest.raises(Exception, match="rank file"):
        bpe.decoded(spark.createDataFrame([([60000],)], "ids array<int>"), RANKS).collect()


def test_merges_of_random_bytes_equal_tiktoken(encoding):
    merger, rng = bpe.Merger(bpe.read_ranks(RANKS)), random.Random(6)
    for size in (1, 2, 3, 7, 30, 3000):
        piece = "".join(rng.choice("abTheion ing") for _ in range(size)).replace(" ", "")
        assert merger.ids(piece.encode()) == encoding.encode_ordinary(piece) or not piece


def test_token_files_round_trip(spark, odd, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_TOKENS", 3000)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    token_files.write(odd, str(tmp_path / "t"), TOKENIZER, 2)
    rows = token_files.read(spark, str(tmp_path / "t"), lambda t: t.tolist(), "array<bigint>").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    texts, start = [None, *ODD_TEXTS], 0
    for row, text in zip(rows, texts, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.start, row.n_tokens, row.value) == (start, len(ids), ids)
        start += len(ids)
    token_files.write(empty, str(tmp_path / "e"), TOKENIZER, 2)
    assert token_files.read(spark, str(tmp_path / "e"), token_files.crc32, "bigint").count() == 0


@pytest.mark.parametrize("top", [3, 50_257, 70_000])
def test_grammar_expands_to_its_tokens(top):
    rng = np.random.RandomState(7)
    tokens = np.minimum(rng.geometric(0.02, 60_000), top - 1).astype(np.int32)
    tokens[100:4000] = 1  # runs of one pair
    packed = token_files.compress(tokens)
    assert len(packed[3]) < len(tokens)
    assert (token_files.expand(*packed) == tokens).all()
    for a, b in ((0, 1), (99, 105), (59_990, 60_000), (5, 40_000)):
        assert (token_files.tokens_at(*packed, a, b) == tokens[a:b]).all()


# -- vectors


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 16)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vector_search, "PIVOTS", 5)
    rng = np.random.RandomState(8)
    vectors = {i: rng.randn(6).round(2).tolist() for i in range(300)}
    vectors |= {i: [1.0] * 6 for i in range(300, 400)}  # many equal ones
    vectors |= {400: [2.0, 1.0], 401: [], 402: [-3e5] * 6}
    bad = {500: None, 501: [1.0, None], 502: [float("nan")] * 6, 503: [float("inf")] * 6}
    rows = [(i, v, 1) for i, v in (vectors | bad).items()] + [(7, vectors[7], 1), (None, [1.0] * 6, 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    found = vector_search.top_k(table, F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect()
    whole = {i: np.pad(np.floor(256 * np.array(v, float)), (0, 6 - len(v))).astype(np.int64) for i, v in vectors.items()}
    wanted = []
    for q in sorted(i for i in whole if i % 20 == 0):
        best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:5]
        wanted += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == wanted


def test_top_k_of_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in vector_search.top_k(table, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1, 256 * 512)]
    assert vector_search.top_k(table.limit(0), F.col("vec_id") == 0, 5).count() == 0


# -- decontamination

BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items):
    words, hit, names = BENCH_WORD.findall((text or "").translate(LOWER)), set(), set()
    for name, item in items:
        w = BENCH_WORD.findall((item or "").translate(LOWER))
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if size else ():
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit |= set(range(j, j + size))
                    names |= {str(name)} if name is not None else set()
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("part_bytes", [10**6, 400])
def test_decontamination_equals_plain_search(spark, odd, empty, part_bytes):
    rng = random.Random(9)
    items = list(enumerate(prose(10, 12, 30))) + [(90, "solo"), (91, None), (92, "!!"), (None, "Nameless item"), (3, "solo"), (10, "É中 ok")]
    texts = prose(11, 30)
    for _ in range(40):
        item = rng.choice(items)[1] or "x"
        cut = item.split()[rng.randrange(3) :]
        texts.append(f"{rng.choice(texts)}, {'; '.join(cut).upper()} {rng.choice(texts)}")
    texts += ["Solo solo", "nameless ITEM twice nameless item", "É中-OK", *ODD_TEXTS]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.contamination(frame(spark, texts), bench, part_bytes=part_bytes).orderBy("doc_id").collect()
    wanted = [contamination(t, items) for t in texts]
    assert [(r.n_words, r.n_hit, r["items"]) for r in rows] == wanted
    clean = decontaminate.clean_documents(frame(spark, texts), bench, part_bytes=part_bytes)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, w in enumerate(wanted) if not w[1]]
    spans = decontaminate.clean_spans(frame(spark, texts, False), bench, part_bytes=part_bytes).orderBy("doc_id").collect()
    assert all((r.text == texts[r.doc_id]) == (not wanted[r.doc_id][1]) for r in spans)
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def test_repeated_benchmark_rows_count_once(spark):
    items = [(1, "one two three four")] * 100 + [(2, "five six"), (3, "five six"), (None, "seven")] * 2
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    parts = list(decontaminate._parts(bench, "item_id", "text", 10, 1000))
    assert len(parts) == 1 and sorted(map(str, parts[0].names)) == ["1", "2", "3", "None"]


# -- substrings


def kept_words(rows):
    windows, out = {}, []
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i, w in words.items():
        for j in range(len(w) - 49):
            key = tuple(w[j : j + 50])
            windows[key] = min(i, windows.get(key, i))
    for i, w in words.items():
        gone = {k for j in range(len(w) - 49) if windows[tuple(w[j : j + 50])] < i for k in range(j, j + 50)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substring_dedup_equals_plain_search(spark, odd, empty):
    rng = random.Random(12)
    passages = [" ".join(f"v{rng.randrange(500)}" for _ in range(n)) for n in (49, 50, 51, 80, 140)]
    texts = []
    for _ in range(80):
        parts = [" ".join(f"u{rng.randrange(9999)}" for _ in range(rng.randrange(40))) for _ in range(3)]
        cut = rng.choice(passages).split()
        texts.append("\t".join([parts[0], " ".join(cut[rng.randrange(5) :]), parts[1], rng.choice(passages), parts[2]]))
    texts += [texts[3], texts[3], "loop " * 120, "loop " * 60, "aé 中 " * 40, "aé 中 " * 30, *ODD_TEXTS]
    found = substring_dedup.without_repeats(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == kept_words(list(enumerate(texts)))
    rows = substring_dedup.without_repeats(odd.union(odd)).where("n_removed > 0").collect()
    assert rows == []  # rows of one id are not compared
    p, q = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    rows = [(1, p), (2, f"lead {p}"), (2, q), (3, q), (3, q.replace(" ", "  ")), (3, f"{q} {p}"), (None, p)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = Counter((r.doc_id, r.n_words, r.kept_text) for r in substring_dedup.without_repeats(table).collect())
    assert found == Counter([(1, 60, p), (2, 61, "lead"), (2, 60, q), (3, 60, ""), (3, 60, ""), (3, 120, ""), (None, 60, p)])
    assert substring_dedup.without_repeats(empty).count() == 0


# -- lines


def test_line_dedup_equals_plain_count(spark, odd, empty):
    rng = random.Random(13)
    rows = []
    for i in range(400):
        site = rng.choice(["a", "a", "a", "b", "c", None])
        lines = [rng.choice(["menu", " menu\t", "footer", "", "x"] + [f"line {rng.randrange(60)}"] * 4) for _ in range(rng.randrange(6))]
        rows.append((i, site, None if i % 50 == 0 else rng.choice(["\n", "\r\n"]).join(lines)))
    rows += [(900 + i, f"tiny{i // 3}", f"same\nsame\nown {i}" if i % 3 else "else") for i in range(9)]  # hosts of three pages
    rows += [(950, "alone", "one page\nsame"), (951, "pair", "same\none"), (952, "pair", "same\ntwo")]
    table = spark.createDataFrame(rows, "page_id int, site string, text string")
    found = {r.page_id: r.text for r in line_dedup.without_boilerplate(table, F.col("site")).collect()}
    pages, carried = Counter(r[1] for r in rows), Counter()
    cut = lambda t: re.split(r"\r\n|\n|\r", t)
    for _, site, text in rows:
        carried.update({(site, x.strip()) for x in (cut(text) if text is not None else []) if x.strip()})
    bad = {k for k, n in carried.items() if n > 1 and n > 0.1 * pages[k[0]]}
    assert ("tiny0", "same") in bad and ("pair", "same") in bad and not any(site == "alone" for site, _ in bad)
    for i, site, text in rows:
        lines = [] if text is None else cut(text)
        kept = [x for x in lines if (site, x.strip()) not in bad]
        assert found[i] == (text if len(kept) == len(lines) else "\n".join(kept))
    clashing = line_dedup.without_boilerplate(odd, F.col("source"))
    assert clashing.columns == odd.columns and clashing.count() == odd.count()
    assert line_dedup.without_boilerplate(empty, F.col("source")).count() == 0


def test_page_text_of_long_runs(spark):
    n = 100_000
    pages = {
        "breaks": "a" + "\n" * n + "b", "tags": "a" + "<p>" * n + "b", "mixed": "a" + "<br> \n\t</p>" * n + "b", "open": "a" + "<" * n + "b",
        "never closed": "a" + "<p " * n + "b", "inline": "a" + "<b>" * n + "</b>" * n + "c", "inline open": "a" + "<b " * n,
        "scripts": "a" + "<script>x" * n + "</script>b", "script open": "a<p>" + "<script" * n, "comments": "a" + "<!--" * n,
    }
    rows = spark.createDataFrame(list(pages.items()), "name string, html string")
    found = {r.name: r.text for r in rows.select("name", line_dedup.page_text(F.col("html")).alias("text")).collect()}
    assert found == {
        "breaks": "a\nb", "tags": "a\nb", "mixed": "a\nb", "open": pages["open"], "never closed": pages["never closed"], "inline": "ac",
        "inline open": pages["inline open"], "scripts": "ab", "script open": "a", "comments": "a",
    }


# -- toxicity


def test_toxicity_learns_and_generalises(spark, odd, empty):
    rng, texts = random.Random(14), prose(15, 600)
    toxic = [rng.random() < 0.3 for _ in texts]
    texts = [t + rng.choice([" vile", " nastyness", " such scum"]) if x else t for t, x in zip(texts, toxic)]
    documents = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(toxic) if i < 400] + [(5, None), (None, 1), (10**6, 1)], "doc_id bigint, label int")
    model = toxicity.fit(documents, labels)
    scores = {r.doc_id: r.score for r in toxicity.scored(documents, model).collect()}
    held = [(scores[i] >= 0.3) == toxic[i] for i in range(400, 600)]
    assert np.mean(held) > 0.95 and toxicity.fit(documents, labels) == model
    assert all(0 <= r.score <= 1 for r in toxicity.scored(odd, model).collect())
    nothing = toxicity.fit(documents, labels.limit(0))
    assert {r.score for r in toxicity.scored(odd, nothing).collect()} == {0.0}
    assert toxicity.scored(empty, model).count() == 0


# -- language model


def test_language_model_counts_and_probabilities(spark, odd, empty):
    texts = [*prose(16, 120), *ODD_TEXTS]
    rows = pitman_yor.scored(frame(spark, texts), toxicity.remainder(F.col("doc_id"), 10) != 0).orderBy("doc_id").collect()
    words = [WORD.findall((t or "").translate(LOWER)) + [None] for t in texts]
    train = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(texts))]
    counts = Counter(w for ws, t in zip(words, train) if t for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for row, ws, t in zip(rows, words, train, strict=True):
        base = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        assert (row.trained, row.n_tokens, row.n_known, row.train_tokens) == (t, len(ws), sum(counts[w] > 0 for w in ws), total)
        assert row.base_score == pytest.approx(base) and row.score < 0
    # Probabilities of all known words and the unknown one sum to one.
    vocabulary = sorted(w for w in counts if w)
    probe = frame(spark, texts + vocabulary + ["neverseenword", ""])
    end = len(texts)
    found = pitman_yor.scored(probe, (F.col("doc_id") < end) & (toxicity.remainder(F.col("doc_id"), 10) != 0)).where(F.col("doc_id") >= end)
    scores = [r.score for r in found.orderBy("doc_id").collect()]
    p_end = 10 ** scores[-1]
    assert sum(10**s / p_end for s in scores[:-1]) + p_end == pytest.approx(1, abs=1e-6)
    assert pitman_yor.scored(odd, F.lit(False)).where("n_known > 0").count() == 0
    assert pitman_yor.scored(empty, F.lit(True)).count() == 0


def test_language_model_scores_word_order(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 300)
    rng = random.Random(17)
    follows = {w: rng.sample("abcdefgh", 2) for w in "abcdefgh"}

    def walk():
        out = [rng.choice("abcdefgh")]
        while len(out) < 30:
            out.append(rng.choice(follows[out[-1]]))
        return out

    texts, held = [walk() for _ in range(120)], [walk() for _ in range(20)]
    turned = [rng.sample(w, len(w)) for w in held]
    probe = [[a, b] for a in "abcdefgh" for b in [*"abcdefgh", "neverseenword"]] + [[a] for a in "abcdefgh"]
    rows = frame(spark, [" ".join(w) for w in texts + held + turned + probe])
    found = [r.score for r in pitman_yor.scored(rows, F.col("doc_id") < 120).orderBy("doc_id").collect()]
    held_scores, turned_scores, of_probe = found[120:140], found[140:160], found[160:]
    # Two words may follow each: about log10(2) a token, and much less in another order.
    assert np.mean(held_scores) / 30 > -0.45 and all(a > b + 5 for a, b in zip(held_scores, turned_scores))
    # What follows a word, known or not, and the end sum to one.
    single = dict(zip("abcdefgh", of_probe[-8:]))
    p_end = 1 - sum(10 ** (s - single["a"]) for s in of_probe[:9])
    for i, a in enumerate("abcdefgh"):
        assert sum(10 ** (s - single[a]) for s in of_probe[9 * i : 9 * i + 9]) == pytest.approx(1 - p_end, abs=1e-5)
    assert 0.02 < p_end < 0.6


def test_seating_has_a_table_for_each_dish():
    customers = np.array([1, 2, 50, 10_000])
    tables = pitman_yor.seat(customers, np.full(4, 0.5), 0.5, np.arange(4).astype(np.uint64), 1)
    assert tables[0] == 1 and (tables >= 1).all() and (tables <= customers).all() and tables[3] > tables[1]
    letters = pitman_yor.Letters(*(np.array(x) for x in ([256 * 257 + 256, 5], [97, 98], [3, 1])), 1)
    assert np.exp(letters.logs).sum(axis=1) == pytest.approx(1)
    assert letters.word_logs(pa.array(["a", ""])).shape == (2,)
