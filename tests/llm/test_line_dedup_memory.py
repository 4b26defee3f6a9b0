"""What a task of line dedup holds of lines that have come together."""

import numpy as np

from argolith.llm import line_dedup


def test_merged_lines_let_go_of_what_they_came_in():
    r = np.random.default_rng(2)
    lines = [r.integers(0, 1 << 64, n, np.uint64) for n in (3, 70, 8, 900)]
    got = line_dedup.Gathered(50_000)
    most = 0
    for k in range(400):
        e = np.zeros(2, line_dedup._BODY)
        some = [k % 4, (k + 1) % 4]
        e["word"], e["sig"], e["n"] = 7, [x + 1 for x in some], [len(lines[x]) for x in some]
        e["doc"], e["line"] = 1000 - k, [0, 1]
        got.add(e, np.concatenate([lines[x] for x in some]))
        most = max(most, sum(x.nbytes for x in got.e + got.words))
    got.merge()
    assert most < 100_000 and sum(len(x) for x in got.words) == sum(map(len, lines)) and got.words[0].base is None
    (e,) = got.e
    assert sorted(e["sig"].tolist()) == [1, 2, 3, 4] and e["doc"].max() < 610
    assert all((got[k] == lines[int(e["sig"][k]) - 1]).all() for k in range(4))
