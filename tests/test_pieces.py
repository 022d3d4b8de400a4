"""The hierarchy of many pieces made at once."""

from __future__ import annotations

import numpy as np
import pandas as pd

from voxmill.operators import density


def pieces(count, rng):
    """Trees of their own points, a few edges each, ranks in one row."""
    rows, point = [], 0
    for piece in range(count):
        size = int(rng.integers(1, 6))
        for k in range(size):
            a, b = -(point + int(rng.integers(0, k + 1))) - 1, -(point + k + 1) - 1
            rows.append((piece, float(rng.random()), a, 1.0, b, 1.0))
        point += size + 1
    frame = pd.DataFrame(rows, columns=["piece", "w", "a", "wa", "b", "wb"])
    return frame.assign(rank=frame["w"].rank().astype("int64")).sort_values("piece", kind="stable", ignore_index=True)


def test_pieces_at_once_equal_pieces_one_by_one():
    rows = pieces(40, np.random.default_rng(2))
    order = ["piece", "id", "is_link"]
    once = density._piece_hierarchy(rows, 2, 50.0).sort_values(order, ignore_index=True)
    each = pd.concat([density._piece_hierarchy(part, 2, 50.0) for _, part in rows.groupby("piece")])
    each = each.sort_values(order, ignore_index=True)
    pd.testing.assert_frame_equal(once, each[once.columns], check_dtype=False)


def test_frames_hold_many_whole_pieces():
    rows = pieces(200, np.random.default_rng(3))
    batches = [rows[i : i + 16] for i in range(0, len(rows), 16)]
    frames = list(density._whole_pieces(iter(batches), 60))
    assert pd.concat(frames).equals(rows)
    told = [set(frame["piece"]) for frame in frames]
    assert sum(map(len, told)) == 200  # none is cut in two
    assert len(frames) <= len(rows) // 30 and max(map(len, frames)) <= 80
