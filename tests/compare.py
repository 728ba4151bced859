from __future__ import annotations


def rows(frame) -> list[tuple]:
    """A pandas frame's rows by column name, in an order of their own, floats to 6 decimals."""

    def plain(v):
        if v is None or v != v:
            return ""
        return f"{float(v):.6f}" if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))
