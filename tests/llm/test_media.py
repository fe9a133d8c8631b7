import hashlib
import zlib

import numpy as np

from bookloom.llm import media as M

TEXTS = [None, "", "a" * 192, "a" * 193, "é" * 100, "hello world " * 3000, "a" * 193, "\x00\x01" * 500, "x" * 100000]


def test_round_trip_and_query(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, media string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in M.op5_media(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert len(payload) % 192 == 0 and payload
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes == len(M.to_wav(payload)) and M.from_wav(M.to_wav(payload)) == payload
    assert rows[3][1:] == rows[6][1:]
    assert rows[2].feature != rows[5].feature


def test_peaks_find_a_tone():
    n = np.arange(192 * 20)
    tone = (128 + 100 * np.sin(2 * np.pi * 24 * n / M.FRAME)).astype(np.uint8)
    peaks = M.spectral_peaks(tone)
    assert (peaks == 24).any(axis=1).all()
    times, codes = M.peak_pairs(peaks)
    assert len(times) == len(codes) and (np.diff(times) >= 0).all()


def test_steps_change_nothing(monkeypatch):
    s = np.random.default_rng(1).integers(0, 255, 192 * 50).astype(np.uint8)
    whole = M.spectral_peaks(s)
    monkeypatch.setattr(M, "STEP", 7)
    assert (M.spectral_peaks(s) == whole).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.media_fingerprints(M.store_media(df)).count() == 0


def brute_feature(text):
    """Peaks by the definition of the Fourier transform, pairs by loops."""
    raw = (text or "").encode()
    x = np.frombuffer(raw + b" " * (-len(raw) % 192 if raw else 192), np.uint8).astype(float)
    k, n = np.arange(97)[:, None], np.arange(192)[None]
    basis, window = np.exp(-2j * np.pi * k * n / 192), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(192) / 191)
    peaks = []
    for at in range(0, len(x) - 191, 96):
        frame = x[at : at + 192]
        power = np.abs(basis @ ((frame - frame.mean()) * window)) ** 2
        peaks.append(sorted(sorted(range(1, 97), key=lambda b: (-power[b], b))[:3]))
    pairs = [(t, a << 10 | b << 2 | gap) for t in range(len(peaks)) for gap in (1, 2) if t + gap < len(peaks) for a in peaks[t] for b in peaks[t + gap]]
    code = hashlib.md5(np.array([t for t, _ in pairs], "<i4").tobytes() + np.array([c for _, c in pairs], "<i4").tobytes()).hexdigest()
    return f"{len(pairs)}:{len({c for _, c in pairs})}:{code}"


def test_feature_against_brute_force(spark, tmp_path):
    draw = np.random.default_rng(4)
    texts = ["".join(chr(c) for c in draw.integers(97, 123, draw.integers(1, 3000))) for _ in range(30)] + [None, "", " " * 500, "a" * 192, "b" * 1920]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in M.op5_media(spark, str(tmp_path)).collect():
        assert r.feature == brute_feature(texts[r.doc_id])
        assert r.feature.endswith(hashlib.md5(np.array(r.times, "<i4").tobytes() + np.array(r.codes, "<i4").tobytes()).hexdigest()) and r.times == sorted(r.times)
    both = M.media_fingerprints(M.store_media(df)).collect()
    assert {r.doc_id: len(r.codes) for r in both} == {i: int(brute_feature(t).split(":")[0]) for i, t in enumerate(texts)}


def test_equal_powers_take_the_lower_bin():
    assert (M.spectral_peaks(np.full(192 * 4, 97, np.uint8)) == [1, 2, 3]).all()


def test_very_long_text(spark):
    text = "many words of a text " * 500_000  # 10 MB
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    one, two = M.media_digests(df).drop("doc_id").collect()
    assert one == two and one.n_bytes == len(text) and one.payload_bytes == len(text) + -len(text) % 192
