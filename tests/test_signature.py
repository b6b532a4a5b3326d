"""Signatures and codecs: recorded facts of the synthetic images, edge cases and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumisig.functions import codec, haar
from lumisig.schema import FULL, Geometry
from lumisig.sources import synthetic

# Recorded means (six digits) of the synthetic images.
MEANS = {
    0: (0, 0, 0), 1: (0.99596, -5.55037e-17, -5.55037e-17), 2: (0.499933, -2.77518e-17, -2.77518e-17), 3: (0.297792, 0.593592, 0.211144),
    4: (0.584629, -0.273889, -0.520887), 5: (0.113539, -0.319703, 0.309744), 6: (0.00390573, -2.16811e-19, -2.16811e-19), 7: (0.496027, -2.70506e-17, -1.3134e-17),
    9: (0.496027, -2.94373e-17, -1.96248e-17), 11: (0.316266, 0.0805556, 0.153202), 14: (0.233634, -1.36479e-17, -1.36479e-17), 18: (0.498681, -0.0011096, -0.00288393),
    19: (0.49842, 0.000760416, 0.0023176), 20: (0.496931, 0.00339577, 0.00340846), 21: (0.497488, 0.00197357, -0.000448907), 22: (0.496401, 0.00231801, 0.000824527),
    23: (0.49967, -0.00249317, 0.0024155), 24: (0.013711, -7.16495e-06, -8.80943e-05), 25: (0.931538, -0.000210951, -0.000147912), 26: (0.420744, -0.150062, -0.0533778),
    27: (0.469126, 0.0857232, -0.0364606), 28: (6.07886e-05, -3.38768e-21, -3.38768e-21), 29: (0.467066, 0.0595526, -0.0576973),
}
COLOURED = {3, 4, 5, 11, 20, 26, 27, 29}


@pytest.fixture(scope="module")
def signed():
    return haar.signatures(np.stack([np.stack(synthetic.case(i)) for i in range(synthetic.CASES)]))


def test_means(signed):
    for i, m in MEANS.items():
        assert np.allclose(signed[0][i], m, rtol=5e-6, atol=1e-25), i


def test_grayscale(signed):
    gray = np.abs(signed[0][:, 1]) + np.abs(signed[0][:, 2]) < 0.006
    assert set(np.flatnonzero(~gray)) == COLOURED


def test_ties(signed):
    coefs = signed[1]
    assert (coefs[0] == np.arange(-40, 0)).all()  # black: zeros count as negative
    assert coefs[13][0].tolist() == [*range(-40, -1), 1]
    # of equal magnitudes the first seeds leave first
    assert coefs[29][0].tolist() == [-128, *range(-40, -3), -1, 129]
    assert coefs[10][0].min() >= 1032 and coefs[10][0].max() <= 1551
    assert coefs[12][0].min() >= 4128 and coefs[12][0].max() <= 4263
    assert (coefs[8][0][np.abs(coefs[8][0]) > 40] % 128 == 0).all()
    assert (np.diff(coefs.astype(int), axis=2) > 0).all()


def test_mean_bits():
    h = codec.to_hash([0.76577718136597, -0.00011652168713282838, 0.004947875142783265], np.zeros((3, 40)))
    assert h[:48] == "3fe8813f25bfad46" "bf1e8ba3578fff32" "3f7444391ec46274"


def test_tie_rule_of_small_images():
    g = Geometry(8, 4, "index")
    v = np.zeros(64)
    v[[5, 9, 11, 30, 40]] = [2, -2, 2, 2, 2]
    assert haar.largest(v, g).tolist() == [-9, 5, 11, 30]


@given(st.lists(st.floats(width=64), min_size=3, max_size=3), st.lists(st.integers(-16383, 16383), min_size=120, max_size=120))
@settings(max_examples=60, deadline=None)
def test_hash_round_trip(means, coefs):
    h = codec.to_hash(means, np.array(coefs).reshape(3, 40))
    a, s = codec.from_hash(h.upper())
    assert np.asarray(means).tobytes() == a.tobytes() and s.ravel().tolist() == coefs
    assert codec.from_blob(codec.to_blob(s)).ravel().tolist() == coefs


def test_errors():
    assert "240 bytes" in codec.blob_error(b"x")
    assert "out of range" in codec.blob_error(np.full(120, 16384, "<i2").tobytes())
    assert codec.blob_error(np.zeros(120, "<i2").tobytes()) is None
    assert "528" in codec.hash_error("0" * 527)
    assert "528" in codec.hash_error("é" + "0" * 527)  # bytes are counted
    assert "hex" in codec.hash_error("g" + "0" * 527)
    assert "range" in codec.hash_error("0" * 524 + "7fff")


def test_functions_in_spark(spark):
    from pyspark.sql import functions as F

    rows = [(i, *(bytes(p) for p in synthetic.case(i))) for i in (0, 3, 16, 29)]
    d = spark.createDataFrame(rows, "id int, r binary, g binary, b binary").withColumn("s", haar.haar_signature(F.col("r"), F.col("g"), F.col("b")))
    d = d.withColumn("h", codec.encode_hash(F.col("s.avglf"), F.col("s.sig"))).withColumn("blob", codec.encode_blob(F.col("s.sig")))
    for r in d.select("*", codec.hash_valid(F.col("h")).alias("ok"), codec.dc_prefix(F.col("h")).alias("dc"), codec.coefs_from_hash(F.col("h")).alias("cs")).collect():
        m, c = haar.signatures(np.stack(synthetic.case(r["id"]))[None])
        assert r["h"] == codec.to_hash(m[0], c[0]) and bytes(r["blob"]) == codec.to_blob(c[0]) and r["ok"]
        assert r["cs"] == c[0].ravel().tolist() and (r["dc"] == "0" * 16) == (r["id"] == 0)
    haar.register(spark)
    got = spark.sql("SELECT is_grayscale(0.003D, 0.0029999D) a, is_grayscale(0.003D, 0.003D) b, is_grayscale(-0.004D, 0.0021D) c, bucket_index(2, -5) d, coef_bin(129) e").first()
    assert tuple(got) == (True, False, False, 2 * 32768 + 16384 + 5, 1)


def test_decode_of_bad_hashes(spark):
    from pyspark.sql import functions as F

    good = codec.to_hash([0.5, float("nan"), -0.0], np.zeros((3, 40)))
    d = spark.createDataFrame([(good,), ("zz",), (None,)], "h string").select(codec.decode_hash(F.col("h")).alias("x")).collect()
    assert d[0].x.error is None and str(d[0].x.avglf) == "[0.5, nan, -0.0]"
    assert d[1].x.sig is None and "528" in d[1].x.error and d[2].x.error is None
    assert FULL.dc_divisor == 32768
