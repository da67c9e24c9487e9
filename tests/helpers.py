"""What the tests share."""

SF = "/root/testdata/sf0.001"


def rows_of(frame) -> list[tuple]:
    """Rows of a pandas frame by sorted column names, as comparable text."""
    import pandas as pd

    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return ""
        if isinstance(v, (bool, str)):
            return str(v)
        return f"{float(v):.6f}" if hasattr(v, "__float__") else str(v)

    names = sorted(frame.columns)
    return sorted(tuple(text(v) for v in row) for row in frame[names].astype(object).itertuples(index=False))
