"""Scores under all contexts, however many there are."""

import math
import random
from collections import Counter

import pytest

from wegloom.llm import ppm


def plain_scores(rows):
    contexts = {}
    for i, t in rows:
        if not ppm.held_out(i):
            p = b"\0" * 4 + t.encode()
            for k in range(4, len(p)):
                for d in range(5):
                    contexts.setdefault(p[k - d : k], Counter())[p[k]] += 1

    def length(before, s):
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

    return {i: sum(length(p[k - 4 : k], p[k]) for p in [b"\0" * 4 + t.encode()] for k in range(4, len(p))) for i, t in rows}


def stored(spark, rows, path):
    """The rows as a table of files, of which Spark knows the size."""
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(path))
    return spark.read.parquet(str(path))


def test_rare_contexts_count(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz éß日") for _ in range(900))) for i in range(60)]
    rows += [(100 + i, rows[i][1][100:500]) for i in range(20)]  # strings that are learnt once or twice, in both folds
    seen = {t.encode()[k : k + 4] for i, t in rows if not ppm.held_out(i) for k in range(len(t) - 4)}
    assert len(seen) > 30000 and {ppm.held_out(i) for i, _ in rows} == {True, False}
    got = {r["doc_id"]: r["score"] for r in ppm.score(stored(spark, rows, tmp_path / "docs")).collect()}
    want = plain_scores(rows)
    assert got.keys() == want.keys()
    for i, x in want.items():
        assert got[i] == pytest.approx(x, rel=1e-5)


def test_batch_without_learning_documents(spark, tmp_path):
    held = [i for i in range(200) if ppm.held_out(i)][:3]
    known = [i for i in range(200) if not ppm.held_out(i)][:3]
    rows = [(i, f"some text {i}") for i in held + known]
    docs = stored(spark, rows[:3], tmp_path / "a").union(stored(spark, rows[3:], tmp_path / "b"))
    got = {r["doc_id"]: r["score"] for r in ppm.score(docs).collect()}
    for i, x in plain_scores(rows).items():
        assert got[i] == pytest.approx(x, rel=1e-5)
