"""Helpers of these tests."""


def as_rows(df):
    return [tuple(r) for r in df.collect()]
