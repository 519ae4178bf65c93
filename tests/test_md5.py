"""MD5 of many texts at once against hashlib."""

from hashlib import md5

import numpy as np

from cadenza.functions import md5 as D


def test_heads_are_those_of_hashlib(monkeypatch):
    before = ["", "a", "sys_a:clean:c12_3_0:", "é:", "x" * 53, "y" * 54, "z" * 55, "w" * 200, "none", "c-9223372036854775808_2147483647_12:"]
    groups = [[b"", b"0"], [b"7"], [str(i).encode() for i in range(120)], [b"39"] * 3, [b"", b"1", b"22"], [b"", b"1", b"22"], [b""], [b"5", b"123"], [], [b"0", b"38"]]
    names, cuts = [n for g in groups for n in g], np.concatenate([[0], np.cumsum([len(g) for g in groups])]).tolist()
    expected = [int(md5(u.encode() + n).hexdigest()[:8], 16) for u, g in zip(before, groups, strict=True) for n in g]
    for at_once in (D.AT_ONCE, 7):
        monkeypatch.setattr(D, "AT_ONCE", at_once)
        assert D.heads(before, cuts, names).tolist() == expected
    assert D.heads([], [0], []).tolist() == [] and D.heads(["a"], [0, 2], [b"", b""]).tolist() == [int(md5(b"a").hexdigest()[:8], 16)] * 2
    calls = []
    monkeypatch.setattr(D, "md5", lambda x: calls.append(x) or md5(x))
    D.heads(["d:c1_0_0:"] * 2, [0, 40, 80], [str(i).encode() for i in range(40)] * 2)
    assert calls == []  # no call a text
