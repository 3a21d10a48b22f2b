"""Periodic runs, SimHash near duplicates and collocations against plain versions, on odd rows and the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash

from wegloom.llm import collocations, periodic, queries, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Rows of doc_id, text, lang with columns that clash with the operators' own."""
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], "doc_id bigint, text string, lang string, fp bigint, component_id string, n_words int")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# periodic runs


def plain_runs(words, min_exp=4, min_length=6):
    n, best = len(words), {}
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exp * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def plain_row(doc_id, words):
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return doc_id, len(runs), *best, hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def odd_texts():
    rng = random.Random(3)
    noise = lambda n, v=40: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "x y x y x y x y z"),
        (None, "x y x y x y x y z"), (6, "a b a b a b a b a"), (7, noise(9000, 2000)), (8, noise(30) + " " + "p q r " * 50 + noise(30)),
        (9, "é ü " * 12 + "A a A a"), (10, "a a b a a b a a b a a b"), (11, noise(300, 2)), (12, "long" * 40_000 + " b" * 7), (13, "\x0bk\x0ck\rk\tk k\nk"),
    ]


@pytest.mark.parametrize("work", [periodic.WORK, 500])
def test_runs_of_odd_rows(spark, monkeypatch, work):
    """Also with ranges of so few lags that most documents are scanned in several places."""
    monkeypatch.setattr(periodic, "WORK", work)
    rows = odd_texts()
    if work < 1000:
        rows = [r for r in rows if r[0] != 7]
    got = rows_of(periodic.runs(frame(spark, [(i, t, "en") for i, t in rows])), *COLUMNS)
    assert got == sorted((plain_row(i, WORD.findall((t or "").encode())) for i, t in rows), key=str)


def test_long_period_and_nested_runs():
    words = (["x"] * 8 + ["y"]) * 5
    assert plain_runs(words) == periodic.smallest(periodic.scan(*numbers(words), 1, len(words) // 4, 4, 6))
    assert (0, 45, 9) in plain_runs(words)


def numbers(words):
    import numpy as np

    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.uint32), np.array([len(words)])


def test_planted_rows_of_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = []
    for d in docs:
        words = WORD.findall((d.text or "").encode())
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        want.append(plain_row(d.doc_id, words))
    assert rows_of(queries.QUERIES["op11_periodic"](spark, SF), *COLUMNS) == sorted(want, key=str)


# SimHash


def plain_fingerprint(text):
    words = WORD.findall((text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """pairs: doc_id, fingerprint; the component of each row."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in pairs), key=str)


def test_simhash_of_odd_rows(spark):
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (5, "quite another text of some words"), (None, base), (None, "nothing else is like this one at all"), (8, "long " * 60_000), (9, "ä ö ü ß"), (9, "ä ö ü ß")]
    rows += [(100 + i, base.replace(f"w{i}", f"v{i}", 1)) for i in range(60)]
    got = simhash.near_duplicates(frame(spark, [(i, t, "en") for i, t in rows]))
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == plain_components([(i, plain_fingerprint(t)) for i, t in rows])


@pytest.mark.parametrize("direct", [simhash.DIRECT, 3])
def test_links_between_fingerprints(spark, monkeypatch, direct):
    """Families around centres, at all distances, chained, and in all pairs of segments; also with nearly every bucket cut again."""
    from wegloom.llm import common
    from wegloom.operators.components import components

    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            y = x
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                y ^= 1 << b
            fps.add(y)
            x = y if rng.random() < 0.3 else x
    shared = rng.getrandbits(32)
    fps |= {shared << 32 | rng.getrandbits(32) & rng.getrandbits(32) & 0x0F0F0F for _ in range(150)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    scratch = common.Scratch(spark)
    links = scratch.keep(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), scratch), "links")
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in links.collect())
    comp = {r.node: r.component for r in components(links).collect()}
    rows = [(comp.get(s, s), f) for s, f in zip(signed, fps)]
    want = plain_components([(i, f) for i, f in enumerate(fps)])
    of = {f"{f:016x}": c for c, f in rows}
    groups = lambda pairs: sorted(Counter(pairs).values())
    assert groups(c for _, _, c in want) == groups(c for c, _ in rows)
    assert len({(of[f], c) for _, f, c in want}) == len({c for _, _, c in want})


def test_simhash_of_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert rows_of(queries.QUERIES["op12_simhash"](spark, SF), "doc_id", "fingerprint", "component_id") == plain_components([(d.doc_id, plain_fingerprint(d.text)) for d in docs])


# collocations


def plain_collocations(rows, least, top=2000):
    counts, total = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        data = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", data):
            words = tuple(w.decode() for w in re.findall(rb"[^\x20\x09]+", piece))
            total[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            own.update(words[i : i + k] for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            score, k = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items())
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out, key=str)


def test_collocations_of_odd_rows(spark):
    rng = random.Random(6)
    some = lambda n: " ".join(rng.choice(["New", "york", "city", "of", "the", "a-b", "ä", "big apple", "in the", "\x0b", "x.\ty", "stop,", "É"]) for _ in range(n))
    rows = [(i, some(rng.randrange(0, 60)), rng.choice(["en", "de", None, "und"])) for i in range(80)]
    rows += [(1, None, "en"), (1, "", None), (None, "new york city " * 5, "fr"), (None, "new york city " * 5, "fr"), (3, "only, commas; here.", "xx"), (4, "word " * 30_000, "yy")]
    got = collocations.collocations(frame(spark, rows), least=5, top=40)
    assert rows_of(got, "lang", "rank", "phrase", "a", "l", "r", "n", "score") == plain_collocations(rows, 5, 40)


def test_scores_past_64_bits(spark):
    n, a, f = 9 * 10**15, 8 * 10**12, 9 * 10**12
    totals = spark.createDataFrame([("en", n)], "lang string, n bigint")
    counts = spark.createDataFrame([("en", "x", 1, f), ("en", "y", 1, f + 1), ("en", "x y", 2, a)], "lang string, gram string, k int, f bigint")
    assert collocations.scored(totals, counts).collect()[0].score == 1000 * a * n // (f * (f + 1))


@pytest.mark.parametrize("small", [1 << 10, 1 << 30])
def test_many_parts_and_one(spark, monkeypatch, small):
    monkeypatch.setattr(collocations, "PART_BYTES", small)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", small)
    rows = [(i, f"a b c{i % 7} d. e f a b, a b d d d d d", "en") for i in range(90)]
    assert rows_of(collocations.collocations(frame(spark, rows), least=4), "lang", "rank", "phrase", "a", "l", "r", "n", "score") == plain_collocations(rows, 4)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert periodic.runs(none).count() == simhash.near_duplicates(none).count() == collocations.collocations(none).count() == 0


def test_collocations_of_the_query(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLES["op13_collocations"].replace(">= 100)", ">= 8)"))
    got = collocations.collocations(spark.read.parquet(f"{SF}/documents.parquet"), least=8)
    assert rows_of(got, *want.columns) == sorted(want.fetchall(), key=str)
