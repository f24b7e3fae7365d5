"""What several test files share."""


def rows(df, *order):
    """Rows as dicts, sorted."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[c]) for c in order)) if order else out
