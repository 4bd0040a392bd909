import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.functions.special import _gammainc, _gammainc_all
from limnos.sources import readers as R

TEXTS = ["2020-01-31", "2020-02-31", "+12020-01-31", "12020-01-31", "20-01-31", "2020-01-31 10:11:12", "2020-01-31 10:11", "2020-01-31T10:11:12", "2020-01-31t10:11:12z", "2020-01-31T10:11:12+01",
         "2020-01-31T10:11:12+01:30", "2020-01-31T10:11:12+0130", "2020/01/31", "20200131", "120200131", "+120200131", "01/31/2020", "01/31/2020 10:11", "31.01.2020", "31/01/2020", "1/2/2020", "12", "1.5", "1234", "12345678",
         "99999999", "A", "", "-2020-01-31", "2020-01-31 ", "2020-01-31x", "2020-01-31T24:00:00", "٢٠٢٠-٠١-٣١", "31.01.+12020", "2020-01-31\n"]


def test_dates_as_without_the_look(spark):
    d = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    plain = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in R.DATE_FORMATS]).isNotNull()
    rows = d.select("t", F.coalesce(R._parses(F.col("t")), F.lit(False)).alias("got"), plain.alias("want")).collect()
    assert [r for r in rows if r.got != r.want] == [] and sum(r.want for r in rows) >= 15


def test_numbers_are_not_tried_as_dates():
    import re
    for text in ("12", "1.5", "-3,5", "1234567", "A", "0.028316846592"):
        assert not any(re.search(R._look(f), text) for f in R.DATE_FORMATS)


def test_gammainc_side_by_side():
    r = np.random.default_rng(3)
    a, x = np.exp(r.uniform(-5, 7, 4000)), np.exp(r.uniform(-8, 7, 4000))
    a[:6], x[:6] = [1, math.nan, 0, 2, -1, 1e-9], [0, 1, 1, math.nan, 1, 50]
    want = np.array([_gammainc(p, q) for p, q in zip(a.tolist(), x.tolist())])
    with np.errstate(all="ignore"):
        np.testing.assert_allclose(_gammainc_all(a, x), want, rtol=1e-9, atol=1e-14)
        assert len(_gammainc_all(a[:0], x[:0])) == 0


@pytest.mark.parametrize("fmt", R.DATE_FORMATS)
def test_every_format_is_met(spark, fmt):
    d = spark.range(1).select(F.date_format(F.lit("2024-11-23 04:05:06").cast("timestamp"), fmt).alias("t"))
    assert d.select(R._parses(F.col("t"))).first()[0]
