import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm.quality_cnn import CHUNK, STEP, WIDTH, _gradient, _initial, chunk_codes, chunk_maxima, quality_scores, scores, training_sample


def test_held_out_rows_are_told_apart(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/labels.parquet")
    rows = quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_held_out_labels_change_nothing(spark, documents):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, int(i % 3 > 0)) for i in range(200)]
    turned = [(i, 1 - q if i in held else q) for i, q in rows]
    a, b = (
        {r.doc_id: r.score for r in quality_scores(documents, spark.createDataFrame(x, "doc_id long, quality int")).collect()}
        for x in (rows, turned)
    )
    assert a == b


def test_messy_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality_scores(messy, labels).collect()
    assert len(got) == messy.count()
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert quality_scores(nothing, labels).count() == 0
    none = quality_scores(messy, labels.filter("doc_id > 1000"))
    assert {r.score for r in none.collect()} == {0.5}
    one = quality_scores(messy, labels.filter("quality = 1")).select(F.min("score"), F.max("score")).first()
    assert one[0] == one[1] > 0.9


def test_chunks_cover_the_whole_text():
    """A pattern anywhere, also across the edge of two chunks, raises the score of a detector alike."""
    w = _initial(np.random.default_rng(0), 0.5)
    texts = [b" " * at + b"PATTERN!" + b" " * (3000 - at) for at in range(2900)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    codes, first = chunk_codes(np.frombuffer(b"".join(texts), np.uint8), offsets)
    seen = [codes[first[i] : first[i + 1]] for i in range(len(texts))]
    for i, chunks in enumerate(seen):
        want = np.frombuffer(b"PATTERN!", np.uint8).astype(int) + 1
        windows = np.lib.stride_tricks.sliding_window_view(chunks, WIDTH, axis=1)[:, ::STEP]
        assert (windows == want).all(axis=2).any(), i
    assert codes.shape[1] == CHUNK + WIDTH - STEP
    assert scores(np.zeros(0, np.uint8), np.array([0, 0]), w).shape == (1,)


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in _initial(rng, 0.4).items()}
    data = rng.integers(0, 255, 1500).astype(np.uint8)
    offsets, target = np.array([0, 700, 700, 1500]), np.array([1.0, 0.0, 0.0])
    codes, first = chunk_codes(data, offsets)

    def loss(w):
        p = scores(data, offsets, w)
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()

    g = _gradient(codes, first, target, {k: v.astype(np.float32) for k, v in w.items()})
    for k in ("filters", "shift", "out", "bias", "embed"):
        flat = w[k].reshape(-1)
        for i in {0, len(flat) // 2, len(flat) - 1, int(np.abs(g[k]).argmax())}:
            keep, found = flat[i], []
            for d in (1e-3, -1e-3):
                flat[i] = keep + d
                found.append(loss(w))
            flat[i] = keep
            assert np.ravel(g[k])[i] == pytest.approx((found[0] - found[1]) / 2e-3, abs=2e-3)


def test_every_offset_counts_alike():
    """A byte put in front moves every window, and the network sees them all the same: in a text of one chunk the maxima stay
    as they are."""
    w = _initial(np.random.default_rng(3), 0.5)
    body = np.random.default_rng(4).integers(97, 123, 300).astype(np.uint8)
    texts = [np.concatenate([np.full(n, 32, np.uint8), body, np.full(20 - n, 32, np.uint8)]) for n in range(8, 13)]
    found = [chunk_maxima(chunk_codes(t, np.array([0, len(t)]))[0], w) for t in texts]
    for f in found[1:]:
        assert np.allclose(f, found[0], atol=1e-6)


def test_a_hot_id_does_not_swell_the_sample(spark):
    docs = spark.range(5000).selectExpr("7 AS doc_id", "concat('text ', id) AS text").unionByName(spark.createDataFrame([(8, "other")], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in (7, 8)], "doc_id long, quality int")
    assert training_sample(docs, labels, "quality", "doc_id", "text", 50, 1 << 20).count() <= 50
