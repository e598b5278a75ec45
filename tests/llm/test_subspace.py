import numpy as np
import pytest

from arcloom.llm import subspace

ROWS = "vec_id bigint, embedding array<double>, label int, node bigint, n string, q int"


def plain(rows, cosine):
    """``(vec_id, n_links, component_id)`` by comparing all pairs."""
    units = []
    for _, v, label, *_ in rows:
        good = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.asarray(v) / np.linalg.norm(v) if good else None)
    linked = [
        [
            j for j in range(len(rows))
            if i != j and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2]
            and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine
        ]
        for i in range(len(rows))
    ]
    out = []
    for i in range(len(rows)):
        seen, open_ = {i}, [i]
        while open_:
            for j in linked[open_.pop()]:
                if j not in seen:
                    seen.add(j)
                    open_.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(linked[i]), min(ids, default=None)))
    return sorted(out, key=str)


def found(spark, rows, how):
    docs = spark.createDataFrame([(*r, None, "n", 3) for r in rows], ROWS)
    return sorted([(r.vec_id, r.n_links, r.component_id) for r in how.classes(docs).collect()], key=str)


def clouds(seed, dim, spread, sizes):
    rnd = np.random.default_rng(seed)
    out = []
    for size in sizes:
        centre = rnd.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        out += [(centre * rnd.uniform(0.1, 9) + 0).tolist()] if size == 1 else [
            ((centre + rnd.standard_normal(dim) * s / np.sqrt(dim)) * rnd.uniform(0.1, 9)).tolist()
            for s in rnd.uniform(0, spread, size)
        ]
    return out


@pytest.mark.parametrize("dim, cell", [(64, 4096), (64, 16), (13, 40), (3, 25)])
def test_all_links_of_clouds_are_counted(spark, dim, cell):
    """Clouds wider than a link, small cells (grid cuts and tiles), lengths that no block divides."""
    vectors = clouds(dim + cell, dim, 0.5, [60, 20, 20, 1, 1, 1, 5])
    rows = [(100 - i, v, i % 5 and 1) for i, v in enumerate(vectors)]
    assert found(spark, rows, subspace.NearVectors(cell=cell)) == plain(rows, 0.98)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    v, w = [0.6, 0.8, 0.0], [0.6, 0.8, 0.01]
    rows = [
        (1, v, 1), (2, v, 1), (2, v, 1), (3, w, 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1),
        (9, [0.6, None, 0.8], 1), (10, [inf, 0.0, 0.0], 1), (11, [nan, 0.0, 1.0], 1), (None, v, 1), (None, [1.0, 0.0, 0.0], 1),
        (12, [6e200, 8e200, 0.0], 1), (13, [6e-200, 8e-200, 0.0], 1), (14, [0.6, 0.8], 1), (15, [1.0], 1), (2**60 + 1, [-0.6, -0.8, 0.0], 1),
    ]
    made = found(spark, rows, subspace.NearVectors())
    # Plain norms overflow where the operator's do not; these are parallel to the first.
    same = [(r[0], v if r[0] in (12, 13) else r[1], r[2]) for r in rows]
    assert made == plain(same, 0.98)


def test_close_to_the_threshold(spark):
    """Pairs within the shell that steps cannot tell are decided in double precision."""
    rows, rnd = [], np.random.default_rng(3)
    for k in range(60):
        turn = np.linalg.qr(rnd.standard_normal((16, 16)))[0]
        c = 0.98 + (k - 30) * 2e-6
        rows += [(2 * k, turn[0].tolist(), k), (2 * k + 1, (c * turn[0] + np.sqrt(1 - c * c) * turn[1]).tolist(), k)]
    assert found(spark, rows, subspace.NearVectors()) == plain(rows, 0.98)


def test_a_large_group(spark):
    """Copies of one vector are one node; a chain of links is one component."""
    step = np.arccos(0.985)
    rows = [(i, [1.0, 0.0], 1) for i in range(3000)]
    rows += [(5000 + i, [float(np.cos(step * i)), float(np.sin(step * i))], 1) for i in range(1, 20)]
    made = dict((r[0], r[1:]) for r in found(spark, rows, subspace.NearVectors(cell=8)))
    assert made[0] == (3000, 0) and made[5001] == (3001, 0) and made[5010] == (2, 0) and made[5019] == (1, 0)


def test_no_rows(spark):
    assert subspace.NearVectors().classes(spark.createDataFrame([], ROWS)).collect() == []


def test_blocks_lose_no_pair():
    """Whatever is close enough holds its share in some block, in steps too."""
    rnd = np.random.default_rng(1)
    for dim in (5, 8, 20, 64):
        share, _, most = subspace.budgets(dim, 0.98)
        starts, turn = subspace.block_starts(dim), subspace.rotation(dim)
        u = rnd.standard_normal((300, dim))
        v = u / np.linalg.norm(u, axis=1, keepdims=True) + rnd.standard_normal((300, dim)) * 0.19 / np.sqrt(dim)
        u, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (u, v))
        close = (u * v).sum(1) >= 0.98
        assert 30 < close.sum()
        d = np.rint(u @ turn * subspace.STEP) - np.rint(v @ turn * subspace.STEP)
        parts = np.stack([(d[:, a:b] ** 2).sum(1) for a, b in zip(starts, starts[1:])], 1)
        assert ((parts <= share).any(1) | ~close).all() and (parts.sum(1)[close] <= most).all()
