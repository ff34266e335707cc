import random
from collections import defaultdict

import numpy as np

from labspark.llm.op3_packing import Capacities, PackParams, _encoded, best_fit_decreasing, encoder, pack, read_bin, write_bin


def test_best_fit_against_linear_search():
    rng = random.Random(5)
    for _ in range(20):
        width = rng.choice([8, 31, 64])
        lengths = np.array([rng.randint(1, width) for _ in range(200)])
        room, want = [], []
        for p in sorted(range(200), key=lambda i: (-lengths[i], i)):
            fits = [(c, r) for r, c in enumerate(room) if c >= lengths[p]]
            if not fits:
                room.append(width)
                want.append([])
                r = len(room) - 1
            else:
                r = min(fits)[1]
            room[r] -= lengths[p]
            want[r].append(p)
        got = best_fit_decreasing(lengths, width)
        assert len(got) == len(want) and sorted(x for row in got for x in row) == list(range(200))
        assert sorted(sum(lengths[p] for p in r) for r in got) == sorted(sum(lengths[p] for p in r) for r in want)


def test_tree_finds_least_capacity():
    tree = Capacities(10)
    for capacity, row in ((3, 0), (7, 1), (5, 2)):
        tree.add(capacity, row)
    assert tree.take(4) == (5, 2) and tree.take(4) == (7, 1) and tree.take(4) is None and tree.take(1) == (3, 0)


def unpacked(rows, width):
    back = defaultdict(dict)
    for r in rows:
        assert len(r.input_ids) == len(r.position_ids) == width and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for a, b, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_starts, strict=False):
            back[doc].setdefault(start, []).append(r.input_ids[a:b])
            assert r.position_ids[a:b] == list(range(b - a))
    return back


def test_round_trip(spark, docs, tmp_path):
    p = PackParams(width=32, buffer=500)
    enc = encoder(p.ranks)
    rows = [(1, "plain words here"), (2, None), (3, ""), (4, "long " * 500), (5, "<|endoftext|> <s> é中😀"), (None, "no id"), (6, "a\n\nb \n c\r\n")]
    got = pack(docs(*rows), p)
    write_bin(got, str(tmp_path / "bin"))
    for made in (got.collect(), read_bin(spark, str(tmp_path / "bin")).collect()):
        back = unpacked(made, 32)
        for doc, text in rows:
            assert [x for k in sorted(back[doc]) for x in back[doc][k][0]] == enc.encode_ordinary(text or "") + [p.pad]
    assert pack(docs(), p).collect() == []


def test_long_text_in_runs_has_the_same_ids():
    enc = encoder(PackParams().ranks)
    text = ("Some words, it's 12 \n\n  And\nmore\n" * 20000) + "\n\n end"
    got = np.concatenate(list(_encoded(enc, text)))
    assert len(list(_encoded(enc, text))) > 1 and got.tolist() == enc.encode_ordinary(text)
