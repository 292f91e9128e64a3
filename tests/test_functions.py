import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakestrata.errors import Corruption, InvalidArgument, StoreError, UnsupportedCodec
from lakestrata.functions import bindiff, checksums, codecs
from lakestrata.functions.paths import normalize, normalize_path
from lakestrata.plans.running import running_sums


def test_crc32c_vectors(spark):
    assert checksums.crc32c(b"") == 0 and checksums.crc32c(b"123456789") == 0xE3069283
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 63, 64, 65, 129, 5000):
        data, register = rng.randbytes(n), 0xFFFFFFFF
        for b in data:
            register = int(checksums._TABLE[(register ^ b) & 0xFF]) ^ register >> 8
        assert checksums.crc32c(data) == register ^ 0xFFFFFFFF
    assert checksums.crc32c_zeroed(b"abWXYZcd", 2) == checksums.crc32c(b"ab\0\0\0\0cd")
    got = spark.createDataFrame([(bytearray(b"123456789"),), (None,)], "d binary").select(checksums.crc32c_column(F.col("d"))).collect()
    assert [r[0] for r in got] == [0xE3069283, 0]


def test_mixer_vectors():
    for (hi, lo), want in {(0, 0): 0xE220A8397B1DCDAF, (0, 1): 0x219FC13D6BC5B015, (1, 0): 0xE4D971771B652C20, (0xDEADBEEFCAFEBABE, 0x1122334455667788): 0x4DA28B137D6AE086}.items():
        assert checksums.mix128(hi, lo) == want
    assert checksums.domain_hash("a", b"b") != checksums.domain_hash("ab", b"")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from(["none", "lz4"]))
def test_codecs_round_trip(raw, codec):
    kept, payload = codecs.encode(codec, raw)
    assert len(payload) <= len(raw) and codecs.decode(kept, payload, len(raw), checksums.crc32c(raw)) == raw


def test_codec_errors():
    with pytest.raises(UnsupportedCodec):
        codecs.encode("zstd", b"x")
    with pytest.raises(StoreError):
        codecs.decode("lz4", b"\x10garbage", 900)
    with pytest.raises(StoreError):
        codecs.decode("none", b"abc", 3, 1)


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=400), st.lists(st.tuples(st.integers(0, 400), st.integers(0, 30), st.binary(max_size=30)), max_size=5))
def test_deltas_round_trip(old, edits):
    new = bytearray(old)
    for at, n, data in edits:
        new[at : at + n] = data
    assert bindiff.patch(old, bindiff.diff(old, bytes(new))) == bytes(new)


def test_delta_sizes():
    rng = random.Random(3)
    old = rng.randbytes(1 << 20)
    new = bytearray(old)
    for _ in range(len(old) // 100):
        new[rng.randrange(len(new))] ^= rng.randrange(1, 256)
    assert len(bindiff.diff(old, bytes(new))) < len(new) // 10
    moved = old[:300_000] + rng.randbytes(4096) + old[300_000:600_000] + old[602_048:900_000] + old[100_000:108_192] + old[900_000:]
    delta = bindiff.diff(old, moved)
    assert len(delta) < 4096 + len(moved) // 50 and bindiff.patch(old, delta) == moved


def test_damaged_deltas_fail():
    rng = random.Random(4)
    old = rng.randbytes(500)
    new = old[:200] + b"xx" * 30 + old[220:]
    delta = bindiff.diff(old, new)
    for k in range(len(delta)):
        broken = delta[:k] + bytes([delta[k] ^ 0x41]) + delta[k + 1 :]
        try:
            assert bindiff.patch(old, broken) == new
        except StoreError:
            pass
    with pytest.raises(StoreError):
        bindiff.patch(old + b"x", delta)
    assert bindiff.header_ok(delta) and not bindiff.header_ok(delta[:-1])


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=500))
def test_runs_and_varints(data):
    assert bindiff.rle_decode(bindiff.rle_encode(data), len(data)) == data
    out = bytearray()
    for v in (*data, -5, 1 << 40, -(1 << 40)):
        bindiff.put_signed(out, v)
    c = bindiff.Cursor(bytes(out))
    assert [c.signed() for _ in range(len(data) + 3)] == [*data, -5, 1 << 40, -(1 << 40)]
    with pytest.raises(Corruption):
        c.varint()


def test_paths(spark):
    cases = {"/a//b\\c": "a/b/c", "a": "a", "//x/": "x", "": None, "/": None, "a/../b": None, "./a": None, "a\0b": None}
    got = spark.createDataFrame([(p,) for p in cases], "p string").select("p", normalize_path(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in got} == cases
    for path, want in cases.items():
        if want is None:
            with pytest.raises(InvalidArgument):
                normalize(path)
        else:
            assert normalize(path) == want


def test_running_sums(spark):
    rows = [(i % 3, i * 7, i % 5) for i in range(500)]
    got = running_sums(spark.createDataFrame(rows, "g long, o long, v long"), ["g"], "o", {"before": F.col("v")}, step=50).collect()
    totals, want = {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        want[o] = totals.get(g, 0)
        totals[g] = want[o] + v
    assert {r.o: r.before for r in got} == want
