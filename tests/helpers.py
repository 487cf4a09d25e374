"""Helpers that the tests of the library share."""


def records(df, *columns):
    """Rows as plain tuples of the given (or all) columns, sorted."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))
