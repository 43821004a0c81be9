"""Helpers of the tests."""


def rows(df) -> list[tuple]:
    """Sorted rows of a pandas frame, by column name."""
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(repr(x.item() if hasattr(x, "item") else x) for x in r) for r in df.where(df.notna(), None).itertuples(index=False, name=None))
