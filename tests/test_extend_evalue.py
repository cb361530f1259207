"""log_evalue of more differences than symbols."""

import math

import pytest

from seqloom.operators import extend


@pytest.mark.parametrize("length, distance", [(50, 130), (50, 51), (50, -51), (3, 100)])
def test_more_differences_than_symbols(length, distance):
    assert extend.log_evalue(length, distance, 4) == -math.inf


def test_as_many_differences_as_symbols():
    assert extend.log_evalue(10, -10, 4) == pytest.approx(12 * math.log(0.75))
