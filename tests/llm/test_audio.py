import hashlib
import zlib

import numpy as np
import pytest

from sparkrecall.llm import audio
from tests.llm.helpers import ROWS, docs, none


def test_tables():
    mu, a = audio.mulaw_table(), audio.alaw_table()
    assert [mu[k] for k in (0, 127, 128, 254, 255)] == [-32124, 0, 32124, 8, 0]
    assert [a[k] for k in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    assert (mu[:128] == -mu[128:]).all() and (a[:128] == -a[128:]).all()


def scalar_ima(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.IMA_STEPS[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(audio.IMA_INDEX[code & 7])))
            out.append(value)
    return out


def test_adpcm_across_blocks():
    blocks = np.random.default_rng(0).integers(0, 256, (40, 36)).astype(np.uint8)
    assert audio.decode_ima(blocks).tolist() == [scalar_ima(b.tobytes()) for b in blocks]


@pytest.mark.parametrize("code,data", [(audio.MULAW, b"abc"), (audio.ALAW, b"abcd"), (audio.PCM, b"\1\2\3\4"), (audio.IMA, bytes(72))])
def test_wav_round_trip(code, data):
    block = 36 if code == audio.IMA else 1
    found = audio.read_wav(audio.write_wav(code, data, 8000, block))
    assert (found[0], found[1], found[3]) == (code, 8000, data)
    assert audio.samples(found[0], found[2], found[3]).dtype == np.int16


def test_resample():
    x = np.array([0, 100, 200, 300], np.int16)
    assert audio.resample(x, 8000, 16000).tolist() == [0, 50, 100, 150, 200, 250, 300, 300]
    assert audio.resample(x, 8000, 8000).tolist() == x.tolist() and len(audio.resample(x, 16000, 8000)) == 2 and audio.resample(x[:0], 8000, 4000).tolist() == []


def test_columns(spark, tmp_path):
    tone = (10000 * np.sin(np.arange(800) / 5)).astype("<i2")
    rows = [("ulaw", audio.write_wav(audio.MULAW, bytes(range(256)))), ("pcm", audio.write_wav(audio.PCM, tone.tobytes())), ("none", None), ("bad", b"RIFFxxxxWAVE"), ("text", b"hello")]
    table = spark.createDataFrame(rows, "name string, media binary")
    got = {r["name"]: r for r in audio.decode(table).collect()}
    assert len(got["ulaw"]["pcm"]) == 1024 and abs(got["pcm"]["seconds"] - 0.1) < 1e-9 and [got[k]["pcm"] for k in ("none", "bad", "text")] == [None] * 3
    audio.store_pcm(table, f"{tmp_path}/p", to=8000)
    back = {r["name"]: r["pcm"] for r in spark.read.parquet(f"{tmp_path}/p").collect()}
    assert bytes(back["pcm"]) == tone.tobytes()


def plain_features(x):
    x = [int(v) for v in x]
    return f"peak={max(map(abs, x))};rms={int((sum(v * v for v in x) / len(x)) ** 0.5)};zero={sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))}"


def half_rate(x):
    """8,000 to 4,000 a second: the mean of each sample and the next (the last stands for itself), every other one."""
    x = [int(v) for v in x]
    return np.rint([(x[k] + x[min(k + 1, len(x) - 1)]) / 2 for k in range(0, len(x) // 2 * 2, 2)]).astype("<i2")


def test_query(spark, tmp_path):
    """op8's columns, each made anew in plain Python, through the stored tables."""
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = audio.op8_telephony_audio(spark, str(tmp_path)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        own = {t for i, t, *_ in ROWS if i == r["doc_id"]}
        data = (own.pop() or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        media = audio.write_wav(audio.MULAW, padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        if len(padded) < 20_000:
            pcm = half_rate(audio.mulaw_table()[list(padded)])
            ima = [v for k in range(0, len(padded), 192) for v in scalar_ima(padded[k : k + 192])]
            want = f"mulaw:{plain_features(pcm)};pcm_crc32={zlib.crc32(pcm.tobytes())}|alaw:{plain_features(audio.alaw_table()[list(padded)])}|ima:{plain_features(ima)}"
            assert r["feature"] == want
    assert len({r["feature"] for r in got if r["doc_id"] in (0, 1)}) == 1
    assert audio.read_features(audio.decode_texts(audio.store_texts(none(spark)))).count() == 0


def test_clashing_columns(spark):
    with pytest.raises(ValueError):
        audio.decode(spark.createDataFrame([(b"x", b"y")], "media binary, pcm binary"))
