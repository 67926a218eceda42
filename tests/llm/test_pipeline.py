"""The corpus pipeline end to end, stage by stage against what was planted."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pipeline = pytest.importorskip("corpus_pipeline")


def _prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnoprstuvw"), int(rng.integers(2, 9)))) for _ in range(n)).capitalize() + "."


def _run(spark, folder, docs, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept, read = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, read, folder).write.parquet(f"{folder}/stage{k}")
        before, read = read, spark.read.parquet(f"{folder}/stage{k}")
        if k < len(pipeline.STAGES) - 1:
            assert read.columns == before.columns
        kept.append(sorted((r.doc_id for r in read.select("doc_id").collect()), key=str))
    return kept, read


def test_planted_cases(spark, tmp_path):
    rng = np.random.default_rng(4)
    clean = [_prose(rng, 150) for _ in range(30)]
    items = [("q0", _prose(rng, 25)), ("q1", _prose(rng, 6)), ("q2", None)]
    bad = "\n".join(["WIN!!! $$$ ### NOW!!! ***"] * 40)
    docs = [(k, t, "abc"[k % 3]) for k, t in enumerate(clean)]
    docs += [(100 + k, clean[k], "a") for k in range(5)]  # exact copies
    docs += [(200 + k, clean[k].replace(" ", "  ", 3) + " end", "b") for k in range(5, 10)]  # near copies
    docs += [(300 + k, _prose(rng, 60) + " " + items[k % 2][1] + " " + _prose(rng, 60), "c") for k in range(4)]  # leaks
    docs += [(400 + k, bad + f" {k}", "a") for k in range(6)]
    docs += [(500, clean[20], "c"), (500, clean[20], "c"), (None, clean[21], None)]
    kept, out = _run(spark, str(tmp_path), docs, items)
    assert all(k in kept[0] for k in range(30)) and not any(k in kept[0] for k in range(400, 406))
    assert [k for k in kept[1] if k is not None and k < 300] == sorted(range(30), key=str) and kept[1].count(500) == 0 and None not in kept[1]
    assert [k for k in kept[2] if k >= 300] == [] and [k for k in kept[2]] == sorted(range(30), key=str)
    assert set(kept[3]) <= set(kept[2]) and len(kept[3]) > 5
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(kept[3], key=int) and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_empty_tables(spark, tmp_path):
    kept, out = _run(spark, str(tmp_path), [], [])
    assert kept == [[]] * 5 and out.count() == 0


def test_null_and_repeated_rows(spark, tmp_path):
    docs = [(1, None, None), (1, None, None), (2, "", "a"), (None, "one two three", None), (3, "one two three", "a"), (3, "one two three", "a")]
    kept, out = _run(spark, str(tmp_path), docs, [(None, None), ("x", "")])
    assert len(kept[1]) <= 2 and kept[2] == kept[1]
