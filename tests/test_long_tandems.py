"""Tandem repeats of long periods, as the registered query finds them."""

import random

import numpy as np
import pytest

from seqloom import registry
from seqloom.operators import tandem
from tests import brute


def test_periods_above_forty(spark, tmp_path):
    r = random.Random(4)
    part = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    sentence = part(57)
    texts = [part(30) + sentence * 2 + part(20), (x := part(90)) * 3, part(200), (y := part(12)) * 4 + y[:5]]
    spark.createDataFrame([(1, i, "u", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = registry.QUERIES["tandem_repeats"](spark, str(tmp_path)).collect()
    want = brute.tandems({1000 + i: t for i, t in enumerate(texts)}, 4)
    assert {(x.seqnum, x.pos, x.period) for x in found} == want and len(found) == len(want)
    assert {57, 90} <= {w[2] for w in want}


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_all_periods(seed):
    r = random.Random(seed)
    part = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    texts = ["", "#", "a" * 150, "ab" * 70 + "#" + "ab" * 70]
    for _ in range(12):
        unit = part(r.randint(1, 130), r.choice(["ab", "abcdefgh#", "\U0001f600é ab"]))
        twice = (unit * 4)[: r.randint(len(unit), 3 * len(unit) + 1)]
        texts.append(part(r.randint(0, 70), "ab") + twice + part(r.randint(0, 70), "ab"))
    for least in (1, 4, 31, 40, 64):
        found = list(zip(*(a.tolist() for a in tandem.squares(texts, least)), strict=True))
        assert len(found) == len(set(found)) and set(found) == brute.tandems(dict(enumerate(texts)), least)


def test_no_text_and_batches(spark, monkeypatch):
    assert [len(a) for a in tandem.squares([], 4)] == [0, 0, 0]
    empty = spark.createDataFrame([], "seqnum long, seq string")
    assert tandem.tandem_repeats(empty, 4).count() == 0
    texts = {i: ("xyzw" * i)[: 3 * i] + "q" * (i % 7) for i in range(40)}
    rows = spark.createDataFrame(list(texts.items()), "seqnum long, seq string").coalesce(1)
    assert {tuple(x) for x in tandem.tandem_repeats(rows, 2).collect()} == brute.tandems(texts, 2)


def test_one_very_long_text():
    r = np.random.default_rng(5)
    unit = "".join(chr(97 + x) for x in r.integers(0, 20, 70_001))
    text, place, period = tandem.squares([unit * 2 + "!" + unit[:9000] * 3], 1000)
    assert set(zip(text.tolist(), place.tolist(), period.tolist(), strict=True)) == {(0, 0, 70_001), (0, 140_003 + 9000, 9000)}
