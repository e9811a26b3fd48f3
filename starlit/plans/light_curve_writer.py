"""Light-curve file bytes for the derived inputs of the ingest queries and for tests."""

from __future__ import annotations

import numpy as np

from starlit.sources.fits import BLOCK, CARD, _FORMS, _padded


def _card(key: str, value) -> str:
    if isinstance(value, bool):
        v = "T" if value else "F"
        text = f"{key:<8}= {v:>20}"
    elif isinstance(value, (int, np.integer)):
        text = f"{key:<8}= {int(value):>20}"
    elif isinstance(value, float):
        text = f"{key:<8}= {repr(value):>20}"
    else:
        s = "'" + str(value).replace("'", "''").ljust(8) + "'"
        text = f"{key:<8}= {s:<20}"
    return text.ljust(CARD)[:CARD]


def _header_bytes(cards: list[tuple[str, object]]) -> bytes:
    text = "".join(_card(k, v) for k, v in cards) + "END".ljust(CARD)
    raw = text.encode("ascii")
    return raw + b" " * (_padded(len(raw)) - len(raw))


def encode_light_curve(columns: dict[str, np.ndarray], forms: dict[str, str],
                       primary: dict | None = None, table: dict | None = None) -> bytes:
    """FITS bytes: primary header (no data) + one binary table of the given columns."""
    names = list(columns)
    n = len(next(iter(columns.values()))) if names else 0
    dtype = np.dtype([(c, _FORMS[forms[c]][0]) for c in names])
    rec = np.zeros(n, dtype=dtype)
    for c in names:
        rec[c] = columns[c]
    head = [("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)] + list((primary or {}).items())
    tcards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", dtype.itemsize),
              ("NAXIS2", n), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(names))]
    for k, c in enumerate(names, start=1):
        tcards += [(f"TTYPE{k}", c), (f"TFORM{k}", forms[c])]
    tcards += list((table or {}).items())
    data = rec.tobytes()
    return _header_bytes(head) + _header_bytes(tcards) + data + b"\0" * (_padded(len(data)) - len(data))
