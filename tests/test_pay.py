"""Pay ranges out of text (S10) and pay objects (S11): the literal cases."""

import pytest

from lantern.operators.pay import pay_object, salary_range
from tests.conftest import rows

RANGES = [
    ("Yearly salary: $91,000 - $118,500", (91000, 118500)),
    ("Pay $72K-$96K", (72000, 96000)),
    ("a salary from $134,000 to $151,000", (134000, 151000)),
    ("Salary range at hiring:$88,400—$131,700 USD", (88400, 131700)),
    ("salary of $140 to $190", (140000, 190000)),
    ("Salary: $101,250.00/yr - $149,750.00/yr", (101250, 149750)),
    ("Salary: $31 - $44 per hour", None),
    ("Compensation: $28.50 - $39.75 per hour", None),
    ("$28.50 - $39.75", None),
    ("Salary: $85.00/hr - $97.00/hr", None),
    ("Pay: $9,500/mo - $11,000/mo", None),
    ("Stock of 0.2% - 0.4%, and the salary is $126,000 to $163,000", (126000, 163000)),
    ("nothing about money", None),
    ("", None),
    (None, None),
    ("Salary in most towns:$97,300—$142,600 USD Salary in the two dear ones:$113,900—$166,200 USD", (97300, 142600)),
    ("Salary in Ohio: $104,500 - $139,900 USD with a bonus. Salary in Montreal: $121,000 - $158,000 CAD with a bonus.",
     (104500, 139900)),
    ("Up to $900 for a desk. The salary range is $115,000 - $137,000.", (115000, 137000)),
    ("Sales went from $300,000 to $450,000. Pay: $109,000 - $128,000", (109000, 128000)),
]


def test_salary_ranges(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RANGES)], "i int, text string")
    got = {r[0]: (None if r[1] is None else (r[1], r[2]))
           for r in rows(salary_range(df).repartition(3), "i", "salary_low", "salary_high")}
    assert [got[i] for i in range(len(RANGES))] == [e for _, e in RANGES]


@pytest.mark.parametrize("js,expected", [
    ('{"min": 93000, "max": 127000, "unitOfWork": "YEAR", "currencyCode": "USD"}', (93000, 127000, "year")),
    ('{"min": 33, "max": 41, "unitOfWork": "HOUR"}', (33, 41, "hour")),
    ('{"@type": "MonetaryAmount", "currency": "USD", "value": {"minValue": 84000, "maxValue": 99000, '
     '"unitText": "YEAR"}}', (84000, 99000, "year")),
    ('{"min": 70000}', None), ('{}', None), ('null', None), ('"70000"', None),
    ('[70000, 80000]', None), ('{"min": null, "max": 80000}', None),
])
def test_pay_objects(spark, js, expected):
    df = spark.createDataFrame([(js,)], "j string")
    r = rows(df.select(pay_object("j").alias("p")))[0][0]
    assert (None if r is None else (r.low, r.high, r.unit)) == expected


def test_long_texts_cost_in_proportion_and_nothing_is_cut(spark):
    """10,000 small amounts, then the one range that counts; context reaches over pieces."""
    small = "$10-20 " * 10_000
    df = spark.createDataFrame([(0, small + "salary $90,000 - $110,000"), (1, "pay " + "$10-20" * 9 + "$90k-$95k"),
                                (2, "pay " + "$10-20" * 10 + "$90k-$95k" + "." * 40 + "$70k-$80k per year"), (3, "$90k-$95k" + "$10-20" * 4 + " a year")],
                               "i int, text string")
    got = {r[0]: (r[1], r[2]) for r in rows(salary_range(df), "i", "salary_low", "salary_high")}
    assert got == {0: (90000, 110000), 1: (90000, 95000), 2: (70000, 80000), 3: (90000, 95000)}
