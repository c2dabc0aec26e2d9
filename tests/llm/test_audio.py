"""Audio: exact round trips, resampling and segments on known signals, and sameness of features."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import audio


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=1, max_size=500))
def test_stored_bytes_come_back(payload):
    assert audio.decode_wav(audio.encode_wav(payload)) == payload


def tone(hertz, seconds=1.0):
    t = np.arange(int(audio.RATE * seconds)) / audio.RATE
    return np.sin(2 * np.pi * hertz * t)


def test_resampling_keeps_a_tone_and_stops_aliases():
    x = np.concatenate([np.zeros(audio.TAPS - 1), tone(1000)])
    y = audio.resample(x)
    assert len(y) == audio.RATE * audio.UP // audio.DOWN
    spectrum = np.abs(np.fft.rfft(y * np.hanning(len(y))))
    assert abs(np.fft.rfftfreq(len(y), 1 / audio.OUT_RATE)[spectrum.argmax()] - 1000) < 3
    high = audio.resample(np.concatenate([np.zeros(audio.TAPS - 1), tone(7800)]))
    assert (high**2).mean() < 0.2 * (y**2).mean()


def test_resampling_is_that_of_upsampling_filtering_and_dropping():
    x = np.random.default_rng(0).standard_normal(320)
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    h = np.zeros(audio.UP * audio.TAPS)
    for p, taps in enumerate(audio._phases()):
        h[p :: audio.UP] = taps[::-1]
    want = np.convolve(up, h)[: len(up)][:: audio.DOWN]
    assert np.allclose(audio.resample(np.concatenate([np.zeros(audio.TAPS - 1), x])), want)


def test_long_payloads_are_worked_through_in_blocks(monkeypatch):
    samples = np.random.default_rng(1).integers(0, 256, 64 * 400, np.uint8)
    whole = audio.log_mel(samples)
    monkeypatch.setattr(audio, "BLOCK", audio.DOWN * audio.HOP * 4)
    parts = audio.log_mel(samples)
    assert np.abs(whole[0] - parts[0]).max() <= 1 and np.allclose(whole[1], parts[1])


def test_segments_have_hysteresis():
    energy = np.array([0, 0, 0, 0, 5, 1, 1, 5, -5, 0, 0, 0, -5, 0, 0])
    step = audio.HOP / audio.OUT_RATE
    assert audio.segments(energy) == [(round(4 * step, 4), round(8 * step, 4))]
    assert audio.segments(np.zeros(0)) == []


def test_log_mel_is_that_of_a_plain_version():
    samples = np.random.default_rng(2).integers(0, 256, 64 * 40, np.uint8)
    x = (samples.astype(float) - 128) / 128
    taps = np.zeros(audio.UP * audio.TAPS)
    for p, h in enumerate(audio._phases()):
        taps[p :: audio.UP] = h[::-1]
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    y = np.convolve(up, taps)[: len(up)][:: audio.DOWN]
    y = np.concatenate([np.zeros(audio.FRAME - audio.HOP), y, np.zeros(-len(y) % audio.HOP)])
    hertz = lambda m: 700 * (10 ** (m / 2595) - 1)
    top = 2595 * np.log10(1 + audio.OUT_RATE / 2 / 700)
    edges = [hertz(top * i / (audio.MELS + 1)) for i in range(audio.MELS + 2)]
    frames = []
    for at in range(0, len(y) - audio.FRAME + 1, audio.HOP):
        frame = [y[at + n] * (0.5 - 0.5 * np.cos(2 * np.pi * n / audio.FRAME)) for n in range(audio.FRAME)]
        spectrum = [abs(sum(v * np.exp(-2j * np.pi * k * n / audio.FRAME) for n, v in enumerate(frame))) ** 2 for k in range(audio.FRAME // 2 + 1)] if at < 3 * audio.HOP else np.abs(np.fft.rfft(frame)) ** 2
        row = []
        for m in range(audio.MELS):
            low, mid, high = edges[m : m + 3]
            f = [k * audio.OUT_RATE / audio.FRAME for k in range(audio.FRAME // 2 + 1)]
            row.append(sum(s * max(0, min((x - low) / (mid - low), (high - x) / (high - mid))) for s, x in zip(spectrum, f, strict=True)))
        frames.append(row)
    mel, energy = audio.log_mel(samples)
    assert mel.shape == (len(frames), audio.MELS) == (len(energy), audio.MELS)
    assert np.abs(mel - np.maximum(audio.FLOOR, 1000 * np.log10(np.array(frames) + 1e-10))).max() <= 1


def test_features(spark, awkward, none, tmp_path):
    rows = audio.media_features(awkward, str(tmp_path / "a")).collect()
    assert len(rows) == awkward.count() and audio.media_features(none, str(tmp_path / "none")).collect() == []
    order = lambda r: (r[0] is None, r[0] or 0, r[1] if isinstance(r[1], int) else len((r[1] or "").encode()))
    media = sorted(audio.read_media(spark, str(tmp_path / "a")).collect(), key=order)
    texts = sorted(awkward.select("doc_id", "text").collect(), key=order)
    by_sha = {r["media_sha256"]: r for r in rows}
    for r, (doc_id, text) in zip(media, texts, strict=True):
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        wav = bytes(r["media"])
        assert (r["doc_id"], r["n_bytes"]) == (doc_id, len(raw)) and wav[-len(padded) :] == padded
        f = by_sha[hashlib.sha256(wav).hexdigest()]
        assert f["payload_bytes"] == len(padded) and f["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert f["tail_crc32"] == zlib.crc32(padded[-64:]) and f["media_bytes"] == len(wav)
    assert len({r["feature"] for r in rows}) == len({r["payload_sha256"] for r in rows})
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"]) for r in rows) == sorted((d is None, d or 0, len((t or "").encode())) for d, t in texts)


def test_stored_tensors_have_one_arrow_shape(spark, awkward, tmp_path):
    path = str(tmp_path / "a")
    figures = {r["doc_id"]: r for r in audio.media_features(awkward.where("doc_id IN (3, 5, 6)"), path).collect()}
    stored = spark.read.parquet(f"{path}/features").collect()
    tables = [audio.tensors_of(bytes(r["tensors"])) for r in stored]
    assert all(t.schema.field("tensor").type == pa.fixed_shape_tensor(pa.int16(), (audio.FRAMES, audio.MELS)) for t in tables)
    got = {}
    for r in sorted(audio.read_tensors(spark, path).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {3, 5, 6} and sum(map(len, got.values())) == sum(t.num_rows for t in tables)
    for doc, rows in got.items():
        _, tensors, times = audio.features(audio.encode_wav({3: b"a", 5: b"x" * 3000, 6: b"word " * 600}[doc].ljust(64, b"\0") + bytes(-max(64, len({3: b"a", 5: b"x" * 3000, 6: b"word " * 600}[doc])) % 64)))
        assert [(r["start"], r["end"]) for r in rows] == times and (np.array([r["tensor"] for r in rows]) == tensors.reshape(len(rows), -1)).all()
        assert f"x{len(rows)}:" in figures[doc]["feature"]
