"""Rows in a comparable form."""


def rows(df, *columns):
    """The rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((v is not None, str(type(v)), v) if not isinstance(v, list) else (True, "", str(v)) for v in t))
