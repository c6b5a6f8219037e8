"""Hand-computed values of the vector functions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.config import SearchParams
from orrery.functions import vector as V
from orrery.operators import pq, signcode


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_distances_and_norms(spark):
    r = one(spark, d=V.sqr_l2(arr(1, 2), arr(4, 6)), dot=V.dot(arr(1, 2), arr(3, 4)), n=V.norm(arr(3, 4)), u=V.normalize(arr(3, 4)), z=V.normalize(arr(0, 0)), s=V.add(arr(1, 2), arr(3, 4)), q=V.scale(arr(2, 4), 2.0))
    assert (r.d, r.dot, r.n, r.u, r.z, r.s, r.q) == (25.0, 11.0, 5.0, [0.6, 0.8], [0.0, 0.0], [4.0, 6.0], [1.0, 2.0])


def test_padding_and_validation(spark):
    r = one(spark, p=V.pad(arr(1, 2), 4), same=V.pad(arr(1, 2), 2), inf=V.has_inf(arr(1, float("-inf"))), ok=V.is_finite(arr(1, 2)), nan=V.is_finite(arr(1, float("nan"))))
    assert (r.p, r.same, r.inf, r.ok, r.nan) == ([1, 2, 0, 0], [1, 2], True, True, False)
    assert (V.code_dim(64), V.code_dim(65), V.code_dim(96)) == (64, 128, 128)


def test_sign_words_put_entry_0_in_the_highest_bit(spark):
    first, last, both = [1.0] + [0.0] * 63, [0.0] * 63 + [1.0], [1.0] + [0.0] * 63 + [0.0] * 63 + [2.0]
    r = one(spark, a=V.sign_words(arr(*first)), b=V.sign_words(arr(*last)), c=V.sign_words(arr(*both)))
    assert (r.a, r.b, r.c) == ([-(2**63)], [1], [-(2**63), 1])
    r = one(spark, p=V.popcount(V.sign_words(arr(*both))), ip=V.binary_dot(V.sign_words(arr(*both)), V.sign_words(arr(*([1.0] * 128)))))
    assert (r.p, r.ip) == (2, 2)


def test_bit_serial_product_equals_direct_one(spark):
    rng = np.random.default_rng(0)
    q, bits = rng.integers(0, 16, 64), rng.standard_normal(64)
    code, planes = V.sign_words(arr(*bits)), V.bit_planes(F.array(*[F.lit(int(x)) for x in q]))
    r = one(spark, serial=V.byte_binary_dot(planes, code), direct=signcode.code_dot(F.array(*[F.lit(int(x)) for x in q]), code))
    assert r.serial == r.direct == int(q[bits > 0].sum())


def test_hadamard_is_orthogonal(spark):
    h = np.array(one(spark, h=V.hadamard(64)).h)
    assert np.allclose(h @ h.T, np.eye(64))
    p = signcode.random_rotation(16)
    assert np.allclose(p @ p.T, np.eye(16))
    got = one(spark, r=V.rotate(arr(*range(16)), signcode.rotation_columns(p))).r
    assert np.allclose(got, np.arange(16) @ p)


def test_quantised_query_micro_fixture(spark):
    t = arr(2, -1, 1, 0)
    r = one(spark, c=V.quantize(t, F.lit(-1.0), F.lit(0.2)), flat=V.quantize(t, F.lit(-1.0), F.lit(0.0)))
    assert r.c == [15, 0, 10, 5] and r.flat == [0, 0, 0, 0]


def test_bucket_codes(spark):
    d = [0, 0.4, 0.9, 1.2, 1.9, 2.5, 3.9, 4.0, -1.0]
    r = one(spark, c=F.transform(arr(*d), lambda x: V.bucket_code(x, F.lit(0.0), F.lit(1.0), 4)), flat=V.bucket_code(F.lit(3.0), F.lit(3.0), F.lit(0.0), 4))
    assert r.c == [0, 0, 0, 1, 1, 2, 3, 3, 0] and r.flat == 0


def test_product_code_table(spark):
    book = F.array(F.array(arr(0, 0, 0, 0), arr(1, 0, 0, 0), arr(0, 2, 0, 0)))
    lut = pq.table_of(arr(1, 1, 0, 0), book)
    r = one(spark, lut=lut, q=pq.quantized_table(lut), flat=pq.quantized_table(F.array(arr(3, 3))))
    assert r.lut == [[2, 1, 2]] and (r.q.low, r.q.scale, r.q.lut8) == (1.0, 255.0, [[255, 0, 255]]) and r.flat.scale == 1.0
    r = one(spark, d=pq.quantized_distance(pq.quantized_table(lut), F.array(F.lit(0))), f=pq.float_distance(lut, F.array(F.lit(1))))
    assert (r.d, r.f) == (2.0, 1.0)


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        SearchParams(k=0)
    with pytest.raises(ValueError):
        SearchParams(logical=8, physical=16)
