"""Each operator against a plain version, an exact round trip or held-out accuracy; nulls, empty, repeated, odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wegloom.llm import common, fingerprints, media, minhash, packing, ppm, quality, sentencepiece_codec, sharding, substring_dedup, warc
from wegloom.llm.words import Words

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeäñ") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    texts = [" ".join(rng.choice(vocab) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(rng.randint(3, 120))) for _ in range(n)]
    texts += texts[:6] + [None, "", " \n\t", "x", "日本 語▁ <s> \x00 \x1c é́", "Don't <|endoftext|> stop", "long" * 3000, " ".join(vocab * 40)]
    texts += [t.replace("a", "A") for t in texts[:4]]
    for i in range(40):  # near copies with a hot common part
        words = texts[0].split() * 2
        words[rng.randrange(len(words))] = f"edit{i}"
        texts.append(" ".join(words))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y") for i, t in rows], KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], KIND)


def collected(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r.asDict() for r in df.collect()}


def test_sentencepiece(docs, rows, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = collected(sentencepiece_codec.encode_decode(docs, path), "doc_id")
    for i, t in rows:
        ids = sp.encode(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    plain = collected(sentencepiece_codec.encode_decode(docs, path, digest=False), "doc_id")
    assert plain[0]["ids"] == sp.encode(rows[0][1])
    assert sentencepiece_codec.encode_decode(nothing, path).count() == 0
    with open(path, "rb") as f:
        codec = sentencepiece_codec.codec(f.read())
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.randrange(0, 300 if rng.random() < 0.5 else 32000) for _ in range(6)]
        assert codec.decode(ids) == sp.decode(ids)


def test_sharding(docs, rows, nothing):
    got = collected(sharding.assign(docs), "doc_id")
    sizes = Counter(r["shard"] for r in got.values())
    assert set(got) == {i for i, _ in rows} and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    for s in range(8):
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sizes[s]))
    together = 0
    for k in range(6):
        together += got[k]["shard"] == got[60 + k]["shard"]
    assert together >= 5
    for i, t in rows:
        data = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["grown_shard"]) == (len(data) + 1, zlib.crc32(data), None)
    assert sharding.assign(nothing).count() == 0


def test_sharding_of_a_third(spark):
    d = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"text {i}") for i in range(400)], "doc_id bigint, text string")
    got = collected(sharding.assign(d), "doc_id")
    sizes, same = Counter(r["shard"] for r in got.values()), Counter(r["shard"] for i, r in got.items() if i % 3 == 0)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and max(same.values()) >= 45


def plain_substring(rows):
    first, words = {}, {}
    for i, t in rows:
        w = words[i] = WORD.findall(t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_substring(docs, rows, nothing, batches):
    got = collected(substring_dedup.deduplicate(docs, batches=batches), "doc_id")
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == plain_substring(rows)
    assert substring_dedup.deduplicate(nothing, batches=2).count() == 0


def test_substring_hits_are_verified(spark):
    """With 9-bit hashes most windows collide: only words that an earlier document has may go, and copies still do."""
    rng = random.Random(8)
    rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(40))) for i in range(30)]
    rows += [(40, rows[0][1]), (41, "na " * 60), (42, "na " * 30), (43, "na " * 90), (41, "a second row of 41"), (None, rows[0][1]), (44, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain_substring(sorted([r for r in rows if r[0] not in (None, 41)] + [(41, "na " * 60)]))
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_dedup.deduplicate(d, batches=2).collect()}
    assert {k: v for k, v in got.items() if k[0] is not None} == {(i, n): gone for i, (n, gone, _) in want.items()} | {(41, 5): 0}
    assert got[None, 40] == 0 and len(got) == len(rows)
    weak = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_dedup.deduplicate(d, batches=2, bits=9).collect()}
    assert all(weak[k] <= got[k] for k in got) and 0 < sum(weak.values()) < sum(got.values())
    clash = d.selectExpr("doc_id", "text", "1 as n_words", "'x' as kept", "2 as hits", "'r' as row", "3 as n_removed", "bigint(9) as n_chars")
    out = {(r["doc_id"], r["text"]): r for r in substring_dedup.remove(clash, batches=2).collect()}
    assert out[44, None]["n_chars"] == 9 and out[1, rows[1][1]]["kept"] == "x" and out[1, rows[1][1]]["row"] == "r" and (40, rows[0][1]) not in out and substring_dedup.remove(clash, batches=1).columns == clash.columns


def test_index_compaction(docs, spark):
    index = substring_dedup.FingerprintIndex(spark, 4)
    for lo in range(0, 120, 20):
        index.add(docs.where((F.col("doc_id") >= lo) & (F.col("doc_id") < lo + 20)))
    assert [level for level, _ in index.runs] == [2, 1]
    kept = index.history().collect()
    hashes = [substring_dedup.unplanes(r["data"]) for r in kept]
    assert all(len(substring_dedup.back_again(r["witnesses"])) == len(h) for r, h in zip(kept, hashes))
    every = np.concatenate(hashes)
    assert all((np.diff(h.astype(object)) > 0).all() for h in hashes) and len(np.unique(every)) == len(every)


def test_warc(spark):
    html = ["<p>" + "a" * 200, "<p>" + "a" * 200, "short", "short", None, "", "é" * 60, "<p>" + "a" * 200]
    pages = spark.createDataFrame([(10 - i, f"http://x/{i}\r\n" if i else None, h, 1) for i, h in enumerate(html)], "page_id bigint, url string, html string, digest int")
    got = collected(warc.round_trip(pages), "page_id")
    for i, h in enumerate(html):
        data = (h or "").encode()
        r = got[10 - i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        later = i in (0, 1)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if later else ("response", None))
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_of_repeated_pages(spark):
    rows = [(3, "x" * 200), (7, "x" * 200), (7, "y" * 150), (8, "y" * 150), (3, "x" * 200), (7, "z")]
    got = warc.round_trip(spark.createDataFrame([(i, None, h) for i, h in rows], "page_id bigint, url string, html string")).collect()
    own = lambda c: hashlib.sha256(c.encode()).hexdigest()
    want = [(3, own("x" * 200), "response", None), (3, own("x" * 200), "response", None), (7, own("x" * 200), "revisit", 3), (7, own("y" * 150), "response", None), (7, own("z"), "response", None), (8, own("y" * 150), "revisit", 7)]
    assert sorted((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(want)


def test_warc_files(spark, tmp_path):
    raw = b"".join(warc.record(i, None, b"x" * i, hashlib.sha256(b"x" * i).hexdigest(), None) for i in range(5))
    (tmp_path / "a.warc.gz").write_bytes(raw)
    assert {r["page_id"]: r["payload"] for r in warc.read_files(spark, str(tmp_path), payload=True).collect()} == {i: b"x" * i for i in range(5)}
    stored = warc.write(spark.createDataFrame([(1, None, "x" * 200), (2, "http://a", "x" * 200), (None, None, "x" * 200), (3, None, None)], "page_id bigint, url string, html string"))
    warc.export(stored, str(tmp_path / "out")).collect()
    again = warc.read_files(spark, str(tmp_path / "out" / "*.warc.gz")).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in again) == [(0, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None)]
    with pytest.raises(ValueError):
        list(warc.members([raw[:-3]]))
    member = next(warc.members([raw[i : i + 7] for i in range(0, len(raw), 7)]))
    with pytest.raises(ValueError):
        warc.parse(member.replace(b"HTTP/1.1 200", b"HTTP/1.1 404"))


def test_warc_of_others(spark, tmp_path):
    """Records as other writers make them: info, request, metadata, UUIDs, SHA-1 in base 32, chunks without length."""
    import base64
    import gzip

    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()

    def one(kind, block, **more):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Length: {len(block)}", *[f"{k.replace('_', '-')}: {v}" for k, v in more.items()]]
        return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = "application/http; msgtype=response"
    page = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n<p>hello"
    raw = one("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields") + one("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request", WARC_Target_URI="http://a/")
    raw += one("response", page, Content_Type=http, WARC_Payload_Digest=sha1(b"<p>hello"), WARC_Block_Digest=sha1(page)) + one("metadata", b"a: b", WARC_Block_Digest="md9:xyz") + one("revisit", b"", WARC_Payload_Digest=sha1(b"q"), WARC_Refers_To="<urn:uuid:response>")
    (tmp_path / "b.warc.gz").write_bytes(raw)
    got = {r["record_type"]: r for r in warc.read_files(spark, str(tmp_path), payload=True).collect()}
    assert list(sorted(got)) == ["metadata", "request", "response", "revisit", "warcinfo"] and all(r["page_id"] is None for r in got.values())
    assert got["response"]["payload"] == b"<p>hello" and got["response"]["payload_bytes"] == 8 and got["request"]["record_id"] == "<urn:uuid:request>" and got["warcinfo"]["payload"] == b"software: x\r\n" and got["revisit"]["payload"] is None
    with pytest.raises(ValueError, match="digest"):
        warc.parse(gzip.decompress(one("response", page, Content_Type=http, WARC_Payload_Digest=sha1(b"other"))))
    records = spark.createDataFrame([(1, "response", "a", None), (2, "revisit", "a", 1), (3, "revisit", "b", 1)], "page_id bigint, record_type string, payload_digest string, refers_to bigint")
    assert [tuple(r) for r in warc.unmet(records).collect()] == [(1, "b")]


def test_packing_of_repeated_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    d = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "other words"), (None, "a"), (None, None)], "doc_id bigint, text string")
    got = packing.pack(d, path, 8).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in got) == [(0, 1), (0, 2), (1, 3), (1, 4), (1, 4)]
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 5


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer as Any
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import WhitespaceSplit

    t = Any(WordLevel({"[UNK]": 0, "Ab": 1, "c": 2, "a": 3}, unk_token="[UNK]"))
    t.pre_tokenizer = WhitespaceSplit()
    coder = packing.Coder(t.to_str())
    assert not coder.apart and [np.frombuffer(b, "<u4").tolist() for b in coder.bytes_of(["Ab c", "ab a,c", ""])] == [[1, 2], [0, 0], []]


def test_packing(docs, rows, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for i, x in rows}
    for window in (64, 4096):
        got = packing.pack(docs, path, window).collect()
        pieces, sequences = {}, {}
        for r in got:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
            pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for i, p in pieces.items():
            assert sum(n for _, n in p) == len(ids[i]) and [s for s, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1].tolist()]
        for s in sequences.values():
            at = 0
            for offset, n in sorted(s):
                assert offset == at
                at += n
            assert at <= window
        assert set(pieces) == set(ids)
    assert packing.pack(nothing, path).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(2)
    have = np.bincount(rng.integers(1, 65, 3000), minlength=65)
    used, full = np.zeros(65, int), 0
    for times, lengths in packing.plan(have, 64):
        assert times > 0 and sum(lengths) <= 64
        for v in lengths:
            used[v] += times
        full += times
    assert (used == have).all() and full * 64 <= 1.05 * (have * np.arange(65)).sum() + 64


def test_coder_parts():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        coder = packing.Coder(f.read())
    rng = random.Random(3)
    texts = ["".join(rng.choice("aBcßÉÖñ12½²ªµÀĀİıſƒΣ日本 \n\t\x1c\x85\xa0.,'!s<|_-tń̈e") for _ in range(rng.randint(0, 50))) for _ in range(2000)] + ["<|endoftext|> a", "it's 'section", "x<|startoftext|>y"]
    assert coder.bytes_of(texts) == [np.array(ids, "<u4").tobytes() for ids in coder.encode(texts)]


def test_quality(spark):
    rng = random.Random(5)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randint(20, 90)))
    bad = lambda: rng.choice([" ".join([rng.choice(["spam", "deal"])] * 60), good().replace(" ", "### "), good().upper().replace(" ", "!! ")])
    y = [int(rng.random() < 0.8) for _ in range(1500)]
    d = spark.createDataFrame([(i, good() if v else bad(), i) for i, v in enumerate(y)] + [(2000, None, 0), (2001, "", 0)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y) if i % 2] + [(None, 1), (7777, 1), (5, None)], "doc_id bigint, quality int")
    got = collected(quality.classify(d, labels), "doc_id")
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items()) and len(got) == 1502
    held = [i for i in range(1500) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == y[i] for i in held) / len(held) > 0.95
    kept = quality.keep(d, labels)
    assert kept.columns == d.columns and kept.count() == sum(r["predicted"] for r in got.values())
    assert quality.classify(d.where("false"), labels).count() == 0
    assert {r["score"] for r in quality.classify(d.where("doc_id < 9"), labels.where("false")).collect()} == {0.5}
    share = np.bincount(rng.choices(range(40, 100), k=700), minlength=quality.BINS), np.bincount(rng.choices(range(40), k=300), minlength=quality.BINS)
    assert quality.estimated_prior(share[0], share[0] + share[1]) == pytest.approx(0.7, abs=0.15)


def plain_groups(rows, like=85):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= like * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("short", [24, 3])
def test_minhash(docs, rows, nothing, short, monkeypatch):
    monkeypatch.setattr(minhash, "SHORT", short)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    got = collected(minhash.near_duplicates(docs), "doc_id")
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == plain_groups(rows)
    if short == 24:
        assert minhash.near_duplicates(nothing).count() == 0
        kept = minhash.keep_first(docs)
        assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got.values())


def test_minhash_of_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(None, t), (5, t), (9, t), (9, "quite other words here and there too"), (7, t + " end"), (8, None)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(d).collect())
    assert got == [(0, 26, None, True), (5, 26, 5, True), (7, 27, 5, False), (8, 0, 8, True), (9, 3, 9, True), (9, 26, 5, False)]
    # the other text of document 9 is in no group: it stays
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in minhash.keep_first(d).collect()) == [(0, len(t)), (5, len(t)), (8, 0), (9, 36)]


def test_minhash_of_repeated_ids(spark):
    """Two classes whose first document is the same one, and rows that are there several times."""
    t = " ".join(f"w{i}" for i in range(30))
    other = "quite other words here and there too"
    d = spark.createDataFrame([(5, t), (9, t + " end"), (9, other), (9, other), (12, other + " x"), (9, t + " end")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(d).collect())
    assert got == [(5, 26, 5, True), (9, 3, 9, True), (9, 3, 9, True), (9, 27, 5, False), (9, 27, 5, False), (12, 4, 12, True)]
    assert sorted((r["doc_id"], r["text"]) for r in minhash.keep_first(d).collect()) == sorted([(5, t), (9, other), (9, other), (12, other + " x")])


def test_fingerprints(docs, rows, nothing):
    got = collected(fingerprints.edited_fingerprints(docs), "doc_id")
    order = sorted(i for i, _ in rows)
    texts = {i: t or "" for i, t in rows}
    for k, i in enumerate(order):
        t, n = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(t) // 4
        e = t[: len(t) - cut] + n[:cut]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        if e == t:
            assert got[i]["fingerprint"] == got[i]["edited_fingerprint"]
    for a in texts:
        for b in texts:
            assert texts[a] != texts[b] or got[a]["fingerprint"] == got[b]["fingerprint"]
    assert fingerprints.edited_fingerprints(nothing).count() == 0
    assert fingerprints.edited_fingerprints(docs.where("doc_id = 0")).first()["near_next"] == 1.0


def plain_fingerprint(t):
    """The sums of paragraphs and of clauses' signs, by the definition."""
    import struct

    import xxhash

    words = [sum(xxhash.xxh64(p.encode(), seed=xxhash.xxh64(struct.pack("<i", j), seed=42).intdigest()).intdigest() for p in t.split("\n") if p) % 2**32 for j in range(fingerprints.WORDS)]
    clauses = [c.strip(" ") for c in re.split(r"[.,;:!?\n]+", t)]
    hashes = [xxhash.xxh64(c.encode(), seed=42).intdigest() for c in clauses if c]
    return words, np.array([sum(1 if h >> i & 1 else -1 for h in hashes) for i in range(64)], float)


def test_fingerprints_by_definition(spark):
    rows = [(3, "a b. c d\ne, f!"), (1, "c d\na b. zz"), (2, ""), (7, "one; two; three. four\nfive " * 3), (7, "another"), (7, "another"), (None, "x y. z"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fingerprints.edited_fingerprints(d)
    assert got.count() == len(rows)
    texts = sorted({t or "" for _, t in rows})
    printed = {r["text"]: r for r in fingerprints.fingerprint(spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.col("text").alias("k")), ["k"]).selectExpr("k as text", "words", "fingerprint").collect()}
    like = lambda a, b: 1.0 if (a[0] == b[0] and (a[1] == b[1]).all()) else (max(0.0, min(1.0, 2 * (a[1] @ b[1]) / n)) if (n := a[1] @ a[1] + b[1] @ b[1]) else 0.0)
    for t in texts:
        assert list(printed[t]["words"]) == plain_fingerprint(t)[0]
    ids = {r["doc_id"]: r for r in got.collect() if r["doc_id"] in (1, 2, 3)}
    for i, (t, after) in {1: (rows[1][1], rows[2][1]), 2: (rows[2][1], rows[0][1])}.items():
        cut = len(t) // 4
        e = t[: len(t) - cut] + after[:cut]
        p, q, n = plain_fingerprint(t), plain_fingerprint(e), plain_fingerprint(after)
        assert ids[i]["near_edited"] == pytest.approx(like(p, q)) and ids[i]["near_next"] == pytest.approx(like(p, n)) and ids[i]["fingerprint"] == printed[t]["fingerprint"]


def test_fingerprint_is_homomorphic(spark):
    d = spark.createDataFrame([(1, "a b.\nc d\ne"), (2, "e\na b.\nc d"), (3, "c d"), (4, "e\na b.")], "doc_id bigint, text string")
    f = collected(fingerprints.fingerprint(d, ["doc_id"]), "doc_id")
    assert f[1]["fingerprint"] == f[2]["fingerprint"] != f[3]["fingerprint"]
    w = spark.createDataFrame([(f[1]["words"], f[3]["words"])], "a array<bigint>, b array<bigint>")
    assert w.select(fingerprints.combine(F.col("a"), F.col("b"), -1).alias("x")).first()["x"] == f[4]["words"]


def test_media(docs, rows, nothing):
    got = collected(media.digests(docs), "doc_id")
    for i, t in rows:
        data = (t or "").encode()
        full = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert media.digests(nothing).count() == 0
    stored = media.encode_column(docs)
    c = media.clips(stored).where("doc_id = 0").orderBy("clip").collect()
    frames = got[0]["payload_bytes"] // 576
    assert c[0]["first_frame"] == 0 and c[-1]["last_frame"] == frames - 1 and c[-1]["end_s"] == pytest.approx(frames / 25)


def test_media_codec():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 256, (40, 576), np.uint8)
    f[0], f[1, ::2], f[1, 1::2] = 255, 255, 0
    frames = [media.head() + s + b"\xff\xd9" for s in media.encode_scans(f)]
    file = media.avi(frames)
    assert media.parse_avi(file) == (25.0, frames) and (media.Decoder().samples(frames) == f).all()
    with pytest.raises(ValueError):
        media.parse_avi(file[:40] + file[60:])
    still, other = np.full((10, 576), 20, np.uint8), np.full((10, 576), 200, np.uint8)
    assert media.shots(media.histograms(np.concatenate([still, other, still]))) == [(0, 9), (10, 19), (20, 29)]


def test_ppm(docs, rows, nothing):
    got = collected(ppm.score(docs), "doc_id")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: [*WORD.findall((t or "").translate(lower)), "\n"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = Counter(w for i, x in tokens.items() if not held[i] for w in x)
    n, v = sum(count.values()), len(count)
    contexts = {}
    for i, t in rows:
        if not held[i]:
            p = b"\0" * 4 + (t or "").encode()
            for k in range(4, len(p)):
                for d in range(5):
                    contexts.setdefault(p[k - d : k], Counter())[p[k]] += 1

    def bits(before, s):
        out, gone = 0.0, set()
        for d in range(4, -1, -1):
            left = {x: c for x, c in contexts.get(before[4 - d :], {}).items() if x not in gone}
            if left:
                total, kinds = sum(left.values()), len(left)
                if s in left:
                    return out + math.log10(left[s] / (total + kinds))
                out += math.log10(kinds / (total + kinds))
                gone |= set(left)
        return out - math.log10(256 - len(gone))

    for i, t in rows:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens[i]))
        p = b"\0" * 4 + (t or "").encode()
        if len(p) < 800:
            assert r["score"] == pytest.approx(sum(bits(p[k - 4 : k], p[k]) for k in range(4, len(p))), rel=1e-5, abs=1e-6)
    assert ppm.score(nothing).count() == 0


def test_words():
    rng = random.Random(2)
    for _ in range(60):
        texts = ["".join(rng.choice("ab \n\tcé\x1c") for _ in range(rng.choice([0, 1, 5, 30, 200]))).encode() + b"x" * rng.choice([0, 0, 7, 8, 9, 1030, 2000]) for _ in range(rng.randint(1, 8))]
        w = Words(texts)
        plain = [re.findall(common.WORD, t) for t in texts]
        assert plain == [[w.data[w.start[j] : w.end[j]] for j in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
        for k in (1, 5, 13):
            h, first = w.runs(k)
            seen = {}
            runs = [tuple(p[i : i + k]) for p in plain for i in range(len(p) - k + 1)]
            assert len(runs) == len(h) == first[-1] and all(seen.setdefault(r, x) == x for r, x in zip(runs, h.tolist())) and len(set(seen.values())) == len(seen)


def test_ranks(spark):
    d = spark.createDataFrame([(i % 3, i) for i in range(50)] + [(None, 99)], "k int, i bigint")
    got = common.two_level_rank(d, ["k"], ["i"], 4, "rank").collect()
    assert {k: sorted(r["rank"] for r in got if r["k"] == k) for k in (0, 1, 2, None)} == {0: list(range(17)), 1: list(range(17)), 2: list(range(16)), None: [0]}
