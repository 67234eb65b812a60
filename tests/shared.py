"""What several test files use."""

from datetime import datetime

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 10, 10, 0, 0)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]
