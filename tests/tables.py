"""Helpers of tests."""


def rows(df, *order):
    """The rows as tuples, sorted."""
    found = [tuple(r) for r in df.collect()]
    return sorted(found, key=lambda r: tuple((v is not None, v) if not isinstance(v, (list, dict)) else (True, str(v)) for v in r))
