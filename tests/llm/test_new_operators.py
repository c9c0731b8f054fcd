"""Product codes, url rules and fill-in-middle against plain versions, and on rows that usually break things."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
pytest.importorskip("matchloom.llm")
zstandard = pytest.importorskip("zstandard")

from pyspark.sql import functions as F  # noqa: E402

from matchloom.llm import fill_middle, queries, url_rules, vector_codes  # noqa: E402

VECTORS = "vec_id bigint, embedding array<float>, label int"


# -- vector codes


def plain_codes(rows, parts, entries, rounds):
    """(vec_id, vector) rows as codes and errors, one step after the other with Python's whole numbers."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    width = -(-max((len(v) for _, v in kept), default=1) // parts) * parts
    kept = [(i, v + [0] * (width - len(v))) for i, v in kept]
    size = width // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def assign():
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        return [[min((far(c[p], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for i in range(len(books[p])):
                mine = [cut[k][p] for k in range(len(cut)) if found[k][p][1] == i]
                if mine:
                    books[p][i] = [sum(xs) // len(mine) for xs in zip(*mine)]
    found = assign()
    return [(kept[k][0], [i for _, i in f], sum(d for d, _ in f)) for k, f in enumerate(found)], books


def coded(spark, rows, parts=4, entries=8, rounds=2):
    frame = spark.createDataFrame(rows, VECTORS)
    kept, width = vector_codes.integer_vectors(frame, "embedding", parts)
    books = vector_codes.train(kept, "vec_id", "embedding", width, parts, entries, rounds)
    return vector_codes.encoded(kept, "embedding", books), books


def test_codes_equal_the_plain_version(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], rng.randrange(3)) for i in range(150)]
    rows += [(200 + i, rows[3][1], None) for i in range(60)] + [(7, rows[9][1], 1), (None, rows[0][1], 2)]  # copies, an id again
    rows += [(300, [0.5] * 5, 1), (301, [], 1)]  # shorter ones
    frame, books = coded(spark, rows)
    single = lambda v: [float(np.float32(x)) for x in v]
    want, want_books = plain_codes([(i, single(v)) for i, v, _ in rows], 4, 8, 2)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.vec_id, r.code, r.error) for r in frame.collect()], key=key) == sorted(want, key=key)
    assert books.tolist() == want_books
    assert vector_codes.books_text(books).startswith(",".join(map(str, want_books[0][0])))


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [-inf, 0.0], 1), (5, [1.0, -2.0], 1), (6, [0.0, 0.0], None)]
    frame, books = coded(spark, rows, parts=2)
    assert sorted((r.vec_id, r.code, r.error) for r in frame.collect()) == [(5, [0, 0], 0), (6, [1, 1], 0)]
    back = vector_codes.decoded(frame.drop("embedding"), books)
    assert {r.vec_id: r.vector for r in back.collect()} == {5: [256, -512], 6: [0, 0]}
    assert coded(spark, rows[:4])[0].count() == 0
    with pytest.raises(ValueError, match="too large"):
        coded(spark, [(1, [1e17, 1.0], 1)])


def test_code_and_error_columns_are_replaced(spark):
    frame = spark.createDataFrame([(1, [1.0], 2)], VECTORS).withColumns({"code": F.lit("x"), "error": F.lit("y"), "slot": F.lit(1)})
    kept, width = vector_codes.integer_vectors(frame, "embedding", 1)
    out = vector_codes.encoded(kept, "embedding", vector_codes.train(kept, "vec_id", "embedding", width, 1, 4, 1))
    assert out.columns == ["vec_id", "label", "slot", "code", "error"] and out.first().code == [0]


@pytest.mark.parametrize("top", [3, 2**20, 2**27, 2**28])
def test_products_are_exact(top):
    rng = np.random.RandomState(0)
    left, right = rng.randint(-top, top, (50, 16)), rng.randint(-top, top, (7, 16))
    assert (vector_codes.products(left, right) == left @ right.T).all()
    for bits in (3, 10, 25):
        assert sum(x.astype(np.int64) << (bits * i) for i, x in enumerate(vector_codes.limbs(left, bits))).tolist() == left.tolist()
        assert all(np.abs(x).max() <= 1 << bits for x in vector_codes.limbs(left, bits))


# -- url rules

URLS = [
    None, "", "no scheme/en/", "http://net", "http://net/", "HTTP://WWW.Example.NET/en/1?x=http://a.org/fr/", "http://example.net/de/",
    "http://sub.example.com/de/1#x", "http://notexample.com/de/", "http://a.org/fr/login/", "http://a.org/en/login/", "http://a.org/de?login/",
    "http://org/fr/", "://net/x", "a://b://net/", "https://m.ads-track.example.com/en/1", "https://mads-track.example.com/en/1",
    "https://x.example.org/my-cart/1", "https://x.example.org/cart", "https://x.example.org/en?sessionid=3", "http://a.com/\n/login/",
    "https://x.example.org/en?nosessionid=3", "http://x.com/buy-now/a/b/checkout?x", "http://net:80/", "x" * 100000 + "://a.net/",
    "http://x.com/login/help", "http://free-bets.example.com/en/help/responsible-gaming", "http://a.com/print/", "http://a.com/print/x",
    "http://a.com/Login/", "http://\u0130.org/fr/", "http://a.net#/", "http://a.net?/",
]


def plain_verdict(url, patterns):
    import re

    found = [p for p in map(url_rules.pattern, patterns) if re.search(p.regex, url_rules.lowered(url or ""), re.DOTALL)]
    return "block" if found and not any(p.exception for p in found) else "allow"


def test_urls_equal_the_plain_version(spark):
    patterns = [*queries.URL_PATTERNS, "bets", "*ads*track*", "|https://x.example.org/en", "en|", "@@nosession"]  # some without a token
    frame = spark.createDataFrame([(u, "h") for u in URLS * 2], "url string, verdict string")
    out = url_rules.judged(frame, "url", queries.HOST_RULES, patterns).collect()
    assert len(out) == 2 * len(URLS)
    for row in out:
        assert row.verdict == (dict((t, v) for v, t in queries.HOST_RULES)[row.rule] if row.rule else plain_verdict(row.url, patterns)), row
    rules = {r.url: (r.host, r.path, r.rule) for r in out}
    assert rules["http://net"] == ("net", "", None) and rules["http://net/"] == ("net", "/", "net/")
    assert rules[URLS[5]] == ("www.example.net", "/en/1", "example.net/en/")
    assert rules["http://notexample.com/de/"] == ("notexample.com", "/de/", None)
    assert rules["http://sub.example.com/de/1#x"] == ("sub.example.com", "/de/1", "example.com/de/")
    assert rules["://net/x"] == ("net", "/x", "net/") and rules["a://b://net/"] == ("b:", "//net/", None)
    assert rules[None] == rules["no scheme/en/"] == ("", "", None)


def test_only_candidates_of_the_rarest_token_run():
    patterns = [url_rules.pattern(t) for t in ("/login/rare^", "^login^", "x*", "||shop.example.")]
    assert [p.tokens for p in patterns] == [("login", "rare"), ("login",), (), ("shop", "example")]
    index = url_rules.PatternIndex(patterns, {"login": 90, "rare": 2, "example": 99, "shop": 99})
    names = lambda url: {p.text for p in index.candidates(url)}
    assert names("http://a/login/1") == {"^login^", "x*"} and names("http://a/rare") == {"/login/rare^", "x*"}
    assert names("http://example.com/") == {"||shop.example.", "x*"}  # of equal counts the longer token


def test_urls_of_an_empty_table_and_no_rules(spark):
    frame = spark.createDataFrame([("http://a.net/login/",)], "url string")
    assert url_rules.judged(frame.limit(0), "url", queries.HOST_RULES, queries.URL_PATTERNS).count() == 0
    assert url_rules.judged(frame, "url", [], []).first().verdict == "allow"
    with pytest.raises(ValueError, match="more than"):
        url_rules.judged(frame, "url", [], ["x" * (url_rules.RULE_BYTES + 1)])


# -- fill in the middle


def plain_output(doc_id, text):
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


ODD = [None, "", "a", "<", "<P", "P><S", "é中🙂" * 40, "<P> marked", "x<M>", "line\n\n" * 9, "\x00\x00", "<S <M <P" * 30, "z" * 20000]


def test_fill_middle_equals_the_plain_version(spark):
    rng = random.Random(2)
    texts = ODD * 12 + ["".join(rng.choice("<>PSM ab\n🙂") for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(i, t, "en", 5) for i, t in enumerate(texts)] + [(None, "no id at all", "en", 5), (3, "an id again", "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n int")
    store = fill_middle.framed(docs, size=7)
    assert "text" not in store.columns and store.where("size(frames) > 1").count() > 100
    out = fill_middle.transformed(store)
    want = {(i, t or "") for i, t, *_ in rows}
    made = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_middle.texts(out).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(made, key=key) == sorted([(i, len(t), *plain_output(i, t)) for i, t in want], key=key)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = [(r.doc_id, r.n, r.output_sha256, r.restored_sha256) for r in fill_middle.digests(out).collect()]
    assert sorted(found, key=key) == sorted([(i, len(t), sha(plain_output(i, t)[3]), sha(t)) for i, t in want], key=key)


def test_only_cut_frames_are_opened():
    class Counting(fill_middle.Codec):
        opened_frames = 0

        def opened(self, frame):
            self.opened_frames += 1
            return super().opened(frame)

    codec = Counting()
    text = "".join(chr(97 + i % 26) for i in range(5000))
    ends, frames = fill_middle.frames_of(text, codec, 100)
    out = fill_middle.rearranged(ends, frames, "psm", 1234, 3210, codec)
    assert codec.opened_frames == 4  # each cut frame once for what lies before and once for what lies behind
    assert set(frames[:12]) <= set(out[1])
    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True)
    assert whole.decompress(b"".join(out[1])).decode() == f"<P>{text[:1234]}<S>{text[3210:]}<M>{text[1234:3210]}"
    assert "".join(fill_middle.restored_texts(*out, "psm", codec)) == text


def test_fill_middle_of_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", "x")], "doc_id bigint, text string, frames string")
    assert fill_middle.digests(fill_middle.transformed(fill_middle.framed(docs.limit(0)))).count() == 0
    row = fill_middle.texts(fill_middle.transformed(fill_middle.framed(docs))).first()
    assert row.output == plain_output(1, "abc")[3]
