"""What a task takes of slabs at once stays small, however many there are."""

import numpy as np

from orbweave.operators import slabs as S


def test_groups_are_taken_in_small_lots():
    x = np.zeros((64, 1 << 14))  # 128 KB each
    batches = (b for lot in range(5) for b in S._rows(np.repeat(np.arange(lot * 32, lot * 32 + 32), 2), np.zeros(64, dtype=int), np.tile([0, 1], 32), x))
    lots = [(len(vol), raw.nbytes) for vol, _, raw in S._groups(batches, 2)]
    assert sum(n for n, _ in lots) == 160 and max(size for _, size in lots) <= 8 << 20
