import hashlib
import hmac
import ipaddress
import random

from pyspark.sql import functions as F

from voxloom.functions import audio, guards


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluate(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_hmac_matches_python(spark):
    for secret in ("s", "whsec-şifre", "k" * 200):
        bodies = ["", '{"a":1}', "ğüşiöç" * 50]
        df = column(spark, bodies)
        got = evaluate(df, guards.sign(secret, F.lit("1775130000"), F.col("v")))
        want = ["sha256=" + hmac.new(secret.encode(), f"1775130000.{b}".encode(), hashlib.sha256).hexdigest() for b in bodies]
        assert got == want and len(got[0]) == 71
        ok = lambda ts, now: evaluate(df, guards.signature_valid(secret, F.lit(ts), F.col("v"), guards.sign(secret, F.lit(ts), F.col("v")), F.lit(now)))[0]
        assert ok("1000", 1300) and not ok("1000", 1301) and not ok("soon", 1000)


def test_public_addresses_match_ipaddress(spark):
    rng = random.Random(1)
    ips = [f"{rng.choice([0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 8, 93])}.{rng.choice([0, 2, 16, 18, 51, 64, 168, 254])}.{rng.choice([0, 2, 100, 113])}.{rng.randint(0, 255)}" for _ in range(2500)]
    ips += ["::1", "::", "fe80::1", "fc00::1", "2001:db8::5", "2606:4700::1111", "ff02::1", "2002::1", "2001:3::1", "::ffff:10.0.0.1", "64:ff9b::1"]

    def public(text):
        ip = ipaddress.ip_address(text)
        return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified)

    got = evaluate(column(spark, ips), guards.ip_is_public(F.col("v")))
    bad = [(i, g) for i, g in zip(ips, got) if g != public(i)]
    assert not bad, bad[:5]
    assert evaluate(column(spark, ["300.1.1.1", "abc", "", "1.2.3"]), guards.ip_is_public(F.col("v"))) == [False] * 4


def test_callback_policy(spark):
    urls = ["https://a.com/x", "http://a.com", "ftp://a.com", "", None, "  ", "nonsense", "https://", "HTTPS://User@A.com:8443/p"]
    df = column(spark, urls)
    public, private = F.array(F.lit("93.184.216.34")), F.array(F.lit("93.184.216.34"), F.lit("169.254.169.254"))
    none = F.array().cast("array<string>")
    assert evaluate(df, guards.callback_allowed(F.col("v"), public)) == [True, False, False, True, True, True, False, False, True]
    assert evaluate(df, guards.callback_allowed(F.col("v"), public, development=True))[1]
    assert not evaluate(df, guards.callback_allowed(F.col("v"), private))[0]
    assert not evaluate(df, guards.callback_allowed(F.col("v"), none))[0]
    assert evaluate(df, guards.callback_allowed(F.col("v"), public, allowed_hosts=["A.com"]))[8]
    assert not evaluate(df, guards.callback_allowed(F.col("v"), public, allowed_hosts=["b.com"]))[0]


def test_errors(spark):
    msgs = [r"C:\Users\x\a.wav: gone", "open /var/lib/x.wav failed", "/tmp only", "a/b/c", "x//y"]
    import re

    def plain(m):
        m = re.sub(r"[A-Za-z]:\\[^\s:]+", "[FILE_PATH]", m)
        return "OSError: " + re.sub(r"/(?:[^\s:]+/)+[^\s:]+", "[FILE_PATH]", m)

    rng = random.Random(2)
    msgs += ["".join(rng.choice(["/", "a", ":", " ", "b/", "//"]) for _ in range(9)) for _ in range(800)]
    assert evaluate(column(spark, msgs), guards.sanitise_error(F.lit("OSError"), F.col("v"))) == [plain(m) for m in msgs]
    kinds = column(spark, ["PermanentJobError", "TransientJobError", "ValueError", "TypeError", "OSError"])
    flag = lambda m: evaluate(kinds, guards.error_is_transient(F.col("v"), F.lit(m)))
    assert flag("disk") == [False, True, False, False, True]
    assert flag("Dosya BOZUK") == [False, True, False, False, False]


def test_names_and_keys(spark):
    df = column(spark, ["a.WAV", "x/y.mp3", ".wav", "noext", "a.b.flac", "name.", "a.toolongext1", "evil.w*v"])
    assert evaluate(df, guards.extension(F.col("v"))) == [".wav", ".mp3", "", "", ".flac", "", ".toolongext1", ".w*v"]
    assert evaluate(df, guards.safe_extension(F.col("v"))) == [".wav", ".mp3", ".bin", ".bin", ".flac", ".bin", ".bin", ".bin"]
    uris = column(spark, ["disk://k.wav", "disk://../k", "s3://b/a/c.wav", "ram://x_y", "s3://b"])
    p = evaluate(uris, guards.uri_parts(F.col("v")))
    assert [(x.scheme, x.bucket, x.key, x.safe) for x in p] == [
        ("disk", None, "k.wav", True), ("disk", None, "../k", False), ("s3", "b", "a/c.wav", True), ("ram", None, "x_y", True), ("s3", "b", "", True)]
    keys = column(spark, [" abc ", "", None])
    want = ["key_hash:" + hashlib.sha256(b"abc").hexdigest()[:16], "ip:10.0.0.1", "ip:10.0.0.1"]
    assert evaluate(keys, guards.client_key(F.col("v"), F.lit("10.0.0.1"))) == want
    assert evaluate(column(spark, [1, 2, 3, 9], "int"), guards.webhook_backoff_seconds(F.col("v"))) == [5, 10, 20, 1280]
    assert evaluate(column(spark, [0, 1, 3, 9], "int"), guards.worker_backoff_seconds(F.col("v"))) == [1.0, 1.0, 4.0, 30.0]


def test_sniff(spark):
    blobs = [b"RIFF\0\0\0\0WAVEfmt ", b"ID3" + b"\0" * 12, b"\xff\xfb" + b"\0" * 12, b"fLaC" + b"\0" * 12, b"OggS" + b"\0" * 12,
             b"\0\0\0\x18ftypM4A ", b"<html></html>xx", b"RIFF", b"", b"RIFF\0\0\0\0AVI LIST"]
    got = evaluate(column(spark, [bytearray(b) for b in blobs], "binary"), audio.sniff(F.col("v")))
    assert got == ["WAV", "MP3", "MP3", "FLAC", "OGG", "M4A", None, None, None, None]


def test_wav_metadata_and_scan(spark, tmp_path):
    import wave

    from voxloom.sources import tables

    for name, ch, rate, n in (("a", 1, 16000, 800), ("b", 2, 44100, 4410)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(ch)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(b"\0\0" * ch * n)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.mp3").write_bytes(b"ID3" + b"\0" * 20)
    got = {r.path.rsplit("/", 1)[1]: r for r in tables.scan_recordings(spark, str(tmp_path)).collect()}
    a, b, c = got["a.wav"].meta, got["b.wav"].meta, got["c.mp3"].meta
    assert (a.channels, a.sample_rate, a.frames, a.duration_sec, a.format) == (1, 16000, 800, 0.05, "WAV")
    assert (b.channels, b.sample_rate, b.frames, b.duration_sec) == (2, 44100, 4410, 0.1)
    assert (c.channels, c.sample_rate, c.frames, c.duration_sec, c.format, c.file_size_bytes) == (1, 16000, None, 0.0, "MP3", 23)
    assert got["c.mp3"].container == "MP3"
    assert tables.scan_recordings(spark, str(tmp_path), "*.wav", metadata=False).count() == 2


def test_wav_chunks_beyond_the_first_hundreds(spark):
    import struct

    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16)
    small = (b"junk" + struct.pack("<I", 2) + b"xx") * 300
    body = b"WAVE" + small + fmt + b"data" + struct.pack("<I", 40) + b"\0" * 40
    blob = b"RIFF" + struct.pack("<I", len(body)) + body
    got = spark.createDataFrame([(blob, "a.wav")], "content binary, path string").select(audio.wav_metadata(F.col("content"), F.col("path")).alias("m")).first().m
    assert (got.channels, got.sample_rate, got.frames) == (2, 8000, 10)
