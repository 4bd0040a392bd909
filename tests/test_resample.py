import hashlib

import numpy as np
import pytest

from limnos.operators import extremes as X
from limnos.operators import resample as Z


@pytest.mark.parametrize("prefixes", [[b"1:42:", b"7:42:"], [b"59999:42:3:", b"59999:42:4:", b"11111:42:4:"], [b"x" * 60 + b":"], [b"x" * 51]])
def test_places_are_digests(prefixes):
    want = [[[int(hashlib.md5(p + b"%d:%d" % (r, i)).hexdigest()[:15], 16) % 13 for i in range(13)] for r in range(7, 27)] for p in prefixes]
    assert (Z.places(prefixes, 7, 20, 13) == np.array(want)).all()


def test_blocks_do_not_matter(monkeypatch):
    x = np.random.default_rng(1).gamma(2, 5, (3, 11))
    whole = Z.Fits(x, [b"a:", b"b:", b"c:"], 50)
    monkeypatch.setattr(Z, "BLOCK", 100)
    parts = Z.Fits(x, [b"a:", b"b:", b"c:"], 50)
    np.testing.assert_allclose(whole.level(0.9), parts.level(0.9))
    one = Z.Fits(x[1:2], [b"b:"], 50)
    np.testing.assert_allclose(whole.level(0.9)[1:2], one.level(0.9))


def test_draws_are_no_expressions(spark, capsys):
    am = spark.createDataFrame([("s", 1950 + i, float(i * i % 17)) for i in range(20)], "station_id string, year int, value double")
    for d in (X.gev_bootstrap(am, n_boot=60), X.coverage(am, n_boot=60)):
        d.explain()
        plan = capsys.readouterr().out
        assert "MapInArrow" in plan and "conv(" not in plan  # an interpreted digest a draw took minutes for a thousand stations
        assert d.count() > 0
