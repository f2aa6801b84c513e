def rows(df):
    """All rows as a set of tuples; fails on a repeated row."""
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out)), "a row came twice"
    return set(out)
