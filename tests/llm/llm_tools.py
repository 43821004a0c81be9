"""Helpers of the tests."""


def texts_of(df):
    """[(doc_id, text)] in ascending id, null last."""
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
